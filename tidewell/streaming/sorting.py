"""A group's rows of a micro-batch in order, in the memory of some of them."""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator
from typing import IO

import numpy as np
import pandas as pd

#: Rows that are sorted in memory, and rows that are read at once of each sorted run.
HELD, BLOCK = 100_000, 2_000


def _written(frame: pd.DataFrame, by: str) -> IO[bytes]:
    """A run of rows sorted by a number, in a file of the executor's own that is gone when it is closed."""
    frame = frame.iloc[np.argsort(frame[by].to_numpy(), kind="stable")]
    file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
    for at in range(0, len(frame), BLOCK):
        pickle.dump(frame.iloc[at : at + BLOCK], file, protocol=pickle.HIGHEST_PROTOCOL)
    file.seek(0)
    return file


def _next(file: IO[bytes]) -> pd.DataFrame | None:
    try:
        return pickle.load(file)
    except EOFError:
        return None


def in_order(frames: Iterator[pd.DataFrame], by: str) -> Iterator[pd.DataFrame]:
    """The rows in frames of which each has only larger numbers `by` than those before; rows of one number come together, as they
    came, and are not sorted further. NaN comes last. More than HELD rows wait in files, in sorted runs."""
    runs: list[IO[bytes]] = []
    held: list[pd.DataFrame] = []
    rows = 0
    try:
        for frame in frames:
            held.append(frame)
            rows += len(frame)
            if rows >= HELD:
                runs.append(_written(pd.concat(held, ignore_index=True), by))
                held, rows = [], 0
        if held and not runs:
            yield pd.concat(held, ignore_index=True)
            return
        if held:
            runs.append(_written(pd.concat(held, ignore_index=True), by))
            held = []
        yield from _merged(runs, by)
    finally:
        for file in runs:
            file.close()


def _merged(runs: list[IO[bytes]], by: str) -> Iterator[pd.DataFrame]:
    front: list[pd.DataFrame | None] = [_next(f) for f in runs]  #: rows of each run not yet given
    more = [True] * len(runs)
    while True:
        ends = [(x[by].iloc[-1], k) for k, x in enumerate(front) if more[k] and x is not None]
        if not ends:
            rest = [x for x in front if x is not None and len(x)]
            if rest:
                yield pd.concat(rest, ignore_index=True)
            return
        # what is below the least end that is known is all there
        bound = np.sort(np.array([e for e, _ in ends]))[0]
        piece = []
        for k, x in enumerate(front):
            if x is None:
                continue
            cut = int(np.searchsorted(x[by].to_numpy(), bound, side="left"))
            if cut:
                piece.append(x.iloc[:cut])
                front[k] = x.iloc[cut:]
        if piece:
            yield pd.concat(piece, ignore_index=True)
        for end, k in ends:
            if end == bound or (end != end and bound != bound):
                new = _next(runs[k])
                more[k] = new is not None
                if new is not None:
                    front[k] = pd.concat([front[k], new], ignore_index=True)

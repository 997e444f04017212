"""Best-fit packing of documents into training sequences under several capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, cut, lean, slices
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
#: Bytes of what a worker remembers.
CACHE = 192 << 20


@lean
def _pieces(batches: Iterator[pa.RecordBatch], path: str, size: int, end: int, cache: int, forget: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(path, cache).encode_flat
    for whole in batches:
        for batch in slices(whole, "text", 4 << 20):
            ids, ends = encode(pc.fill_null(batch.column("text"), ""))
            rows = np.arange(batch.num_rows)
            ids, ends = np.insert(ids, ends[1:], end).astype("<u4"), ends + np.arange(len(ends))  # `end` behind every text
            n = np.diff(ends)
            pieces = -(-n // size)
            row = np.repeat(rows, pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * size
            length = np.minimum(n[row] - start, size)
            at = ends[row] + start
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [batch.column("doc_id").take(pa.array(row)), *(pa.array(c, t) for c, t in zip((piece, start, length, crc), kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, NAMES)
    if forget:
        encoder.cache_clear()


def tokenize(docs: DataFrame, path: str, size: int = 2048, end: int = 0, cache: int = CACHE, forget: bool = False) -> DataFrame:
    """Pieces of at most `size` ids of every text, `end` appended; a null text counts as empty (one piece: `end`)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(partial(_pieces, path=path, size=size, end=end, cache=cache, forget=forget), PIECES)


def best_fit(items: np.ndarray, capacity: np.ndarray, weights: np.ndarray, score: str = "norm") -> np.ndarray:
    """Bin of each item (rows: tokens, documents, attention cost), largest first.

    Every item goes to an open bin that can hold it in every dimension: the one with the least weighted norm of
    what stays free ("norm"), or the largest weighted product of item and free room ("dot"); ties go to the
    oldest bin. An item that no open bin can hold opens one. An item beyond the capacity gets a bin of its own.
    """
    scaled = items / capacity
    order = np.lexsort((np.arange(len(items)), -(scaled**2 @ weights), -scaled[:, 0]))
    bins = np.empty(len(items), dtype=np.int64)
    free = np.empty((len(items), items.shape[1]))
    name = np.empty(len(items), dtype=np.int64)
    least = scaled.min(axis=0) if len(items) else None
    n = made = 0
    for i in order:
        item, best = scaled[i], -1
        room = free[:n]
        fits = np.flatnonzero((room >= item - 1e-12).all(axis=1)) if n else ()
        if len(fits):
            left = room[fits] - item
            best = int(fits[np.argmin((left**2) @ weights) if score == "norm" else np.argmax(room[fits] @ (weights * item))])
        else:
            best, free[n], name[n] = n, 1.0, made
            n, made = n + 1, made + 1
        bins[i] = name[best]
        free[best] -= item
        if (free[best] < least - 1e-12).any():  # no item fits any more
            n -= 1
            free[best : n], name[best : n] = free[best + 1 : n + 1].copy(), name[best + 1 : n + 1].copy()
    return bins


def _pack(group: pa.Table, capacity: tuple, weights: tuple, score: str) -> pa.Table:
    group = group.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("length", "ascending"), ("ids_crc32", "ascending")])
    length = group.column("length").to_numpy()
    items = np.column_stack([length, np.ones(len(length)), length.astype(np.float64) ** 2]).astype(np.float64)
    bins = best_fit(items, np.array(capacity, dtype=np.float64), np.array(weights), score)
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(length[order]) - length[order]
    first = np.concatenate([[True], np.diff(bins[order]) > 0])
    offset = np.empty(len(length), dtype=np.int64)
    offset[order] = before - before[first][np.cumsum(first) - 1]
    sequence = (group.column("g").to_numpy() << 32) + bins
    return group.select(NAMES).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset))


def pack(pieces: DataFrame, *, tokens: int = 2048, documents: int | None = None, attention: float | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), score: str = "norm", group_rows: int = 6000) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32) by vector best-fit.

    Capacities of a sequence: ids, pieces, and attention cost (the sum of squared lengths); the last two do not
    bind when None. Rows are dealt by a hash of (doc_id, piece) into groups of about `group_rows`, one task at a
    time packs a group, so memory is bounded and no key can be hot; a group loses one part-filled sequence at
    most. No rows give no rows; repeated rows are separate items; a null doc_id is kept.
    """
    pieces = cut(pieces)
    n = max(1, -(-pieces.count() // group_rows))
    spread = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(n)).cast("long"))
    limits = (tokens, documents or tokens, attention or float(tokens) ** 2)
    return by_group(spread, ["g"], _pack, f"{PIECES}, sequence_id long, offset long", capacity=limits, weights=weights, score=score)


def pack_documents(docs: DataFrame, path: str, size: int = 2048, cache: int = CACHE, forget: bool = False) -> DataFrame:
    """Tokenizes and packs `docs` (doc_id, text); other columns are ignored. A worker remembers parts of words in up to
    `cache` bytes, and with `forget` lets go of them when a task ends."""
    return pack(tokenize(docs, path, size, cache=cache, forget=forget), tokens=size)

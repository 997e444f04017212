"""What a stream does with a group's rows: stages that keep a state of bounded size and hand rows, or ended windows, on."""

from __future__ import annotations

from typing import Any

import numpy as np

from ..functions.timeunits import as_size
from ..operators import aggs
from ..operators.scan import IS_ROW, Carry, Columns, Cusum, Kernel, Node, RowNumber, Sessions, advance, part_of, start

TICK = "__tick"


def rows_of(data: Columns) -> int:
    return len(data[TICK][0])


def taken(data: Columns, name: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    x, ok = data[name]
    return x[at], None if ok is None else ok[at]


def joined(parts: list[Columns]) -> Columns:
    if len(parts) == 1:
        return parts[0]
    out: Columns = {}
    for c in parts[0]:
        oks = [p[c][1] for p in parts]
        ok = None if all(o is None for o in oks) else np.concatenate([np.ones(len(p[c][0]), dtype=bool) if o is None else o for p, o in zip(parts, oks, strict=True)])
        out[c] = np.concatenate([p[c][0] for p in parts]), ok
    return out


class Rows:
    """Kernels over rows: their outputs are added to the data. With `pick` columns are handed on under new names."""

    def __init__(self, nodes: list[Node], pick: dict[str, str] | None = None):
        self.nodes, self.pick = nodes, pick
        self.kernels: list[Kernel] | None = None

    def feed(self, data: Columns) -> Columns:
        if not rows_of(data):
            return data
        if self.kernels is None:
            self.kernels = start(self.nodes, data)
        advance(self.nodes, self.kernels, data, rows_of(data))
        return data if self.pick is None else {TICK: data[TICK]} | {new: data[old] for new, old in self.pick.items()}

    def due(self) -> float | None:
        return None

    def close(self, now: float) -> Columns | None:
        return None


class Given:
    """Parameters that come among the rows: carried on to the rows behind them under new names, and left out themselves."""

    def __init__(self, names: dict[str, str]):
        self.names, self.kernel = names, Carry(len(names))

    def feed(self, data: Columns) -> Columns:
        if not rows_of(data):
            return data
        got = self.kernel.step_nulls(*(data[c] for c in self.names))
        rows = data[IS_ROW][0] > 0
        out = {c: taken(data, c, rows) for c in data}
        return out | {new: (np.ma.getdata(y)[rows], ~np.ma.getmaskarray(y)[rows]) for new, y in zip(self.names.values(), got, strict=True)}

    def due(self) -> float | None:
        return None

    def close(self, now: float) -> Columns | None:
        return None


class Trigger:
    """Numbers the window of each row and tells whether it ends with that row: ("tumbling", size), ("counter", rows),
    ("session", gap) or ("cusum", (threshold, column))."""

    def __init__(self, kind: str, size: Any):
        if kind not in ("tumbling", "time", "counter", "session", "cusum"):
            raise ValueError(f"no such window on a stream: {kind!r}")
        self.kind = "tumbling" if kind == "time" else kind
        self.size = size if kind == "counter" else size[0] if kind == "cusum" else as_size(size)
        self.column = size[1] if kind == "cusum" else None
        make = {"counter": RowNumber, "session": lambda: Sessions(self.size), "cusum": lambda: Cusum(self.size)}.get(self.kind)
        self.kernel = make() if make else None

    def step(self, data: Columns) -> tuple[np.ndarray, np.ndarray]:
        tick = data[TICK][0]
        n = len(tick)
        if self.kind == "tumbling":
            return np.floor(tick / self.size).astype(np.int64), np.zeros(n, dtype=bool)
        if self.kind == "counter":
            (row,) = self.kernel.step(valid=np.ones(n, dtype=bool))
            return (row // self.size).astype(np.int64), (row + 1) % self.size == 0
        if self.kind == "session":
            (number,) = self.kernel.step(tick.astype(np.float64))
            return number.astype(np.int64), np.zeros(n, dtype=bool)
        x, ok = data[self.column]
        ok = np.ones(n, dtype=bool) if ok is None else ok
        bar = np.full(n, -1, dtype=np.int64)  # a null ends nothing and stands in no window
        fired = np.zeros(n, dtype=bool)
        if ok.any():
            got, on = self.kernel.step(x[ok])
            bar[ok], fired[ok] = got.astype(np.int64), on > 0
        return bar, fired

    def time(self, number: int, last: float) -> float:
        """The window's time: a tumbling window's end, else its last row's."""
        return (number + 1) * self.size if self.kind == "tumbling" else last

    def due(self, number: int, last: float) -> float | None:
        """When the window ends though no row comes."""
        return (number + 1) * self.size if self.kind == "tumbling" else last + self.size if self.kind == "session" else None


class Aggregates:
    """Aggregators of a window, by parts: a few numbers whatever the window's rows. spec: (output names, aggregator, columns)."""

    def __init__(self, spec: list[tuple[list[str], aggs.Mergeable, list[str]]]):
        self.spec = spec
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple | None] = [None] * len(self.spec)

    def feed(self, data: Columns) -> None:
        for k, (_, agg, cols) in enumerate(self.spec):
            x = [data[c] for c in cols] or [data[TICK]]
            ok = np.logical_and.reduce([np.ones(len(v), dtype=bool) if o is None else o for v, o in x])
            if ok.any():
                state = agg.lift(*(v[ok] for v, _ in x))
                self.states[k] = state if self.states[k] is None else agg.merge(self.states[k], state)

    def values(self) -> dict[str, float | None]:
        out: dict[str, float | None] = {}
        for (names, agg, _), state in zip(self.spec, self.states, strict=True):
            out |= dict(zip(names, agg.finish(state) if state is not None else [None] * len(names), strict=True))
        return out


class Functors:
    """A graph's kernels that start anew with every window; its values are the outputs of the latest row."""

    def __init__(self, nodes: list[Node], pick: dict[str, str]):
        self.nodes, self.pick = nodes, pick
        self.reset()

    def reset(self) -> None:
        self.kernels: list[Kernel] | None = None
        self.last: dict[str, float | None] = dict.fromkeys(self.pick)

    def feed(self, data: Columns) -> None:
        if self.kernels is None:
            self.kernels = start(self.nodes, data)
        data = dict(data)
        advance(self.nodes, self.kernels, data, rows_of(data))
        self.last = {new: None if data[old][1] is not None and not data[old][1][-1] else float(data[old][0][-1]) for new, old in self.pick.items()}

    def values(self) -> dict[str, float | None]:
        return self.last


class Windows:
    """Rows by window: one row on where a window ends, with the window's time (`__window`) and the body's values.

    What is handed on has the time of the row that ended the window, or of the watermark where none did. A window that is
    still open has its trigger's and its body's state, nothing else.
    """

    def __init__(self, trigger: Trigger, body: Aggregates | Functors, names: list[str]):
        self.trigger, self.body, self.names = trigger, body, names
        self.open: int | None = None
        self.last: float = 0

    def _end(self, arrival: float, out: list) -> None:
        out.append((arrival, self.trigger.time(self.open, self.last), self.body.values()))
        self.body.reset()
        self.open = None

    def _table(self, out: list) -> Columns:
        data: Columns = {TICK: (np.array([o[0] for o in out]), None), "__window": (np.array([o[1] for o in out]), None)}
        for n in self.names:
            ok = np.array([o[2][n] is not None for o in out], dtype=bool)
            data[n] = np.array([0.0 if o[2][n] is None else o[2][n] for o in out]), None if ok.all() else ok
        return data

    def feed(self, data: Columns) -> Columns:
        out: list = []
        if rows_of(data):
            ids, ends = self.trigger.step(data)
            tick = data[TICK][0]
            cuts = np.flatnonzero((ids[1:] != ids[:-1]) | ends[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                number = int(ids[a])
                if number < 0:
                    continue
                if self.open is not None and number != self.open:
                    self._end(tick[a].item(), out)
                self.open = number
                self.body.feed(part_of(data, a, b))
                self.last = tick[b - 1].item()
                if ends[b - 1]:
                    self._end(self.last, out)
        return self._table(out)

    def due(self) -> float | None:
        return None if self.open is None else self.trigger.due(self.open, self.last)

    def close(self, now: float) -> Columns | None:
        """The open window, if it has ended by `now` though no row came."""
        due = self.due()
        if due is None or due > now:
            return None
        out: list = []
        self._end(due, out)
        return self._table(out)


class Chain:
    """Stages one behind another; a window that time ends is handed on like one that a row ends."""

    def __init__(self, stages: list[Given | Rows | Windows]):
        self.stages = stages

    def feed(self, data: Columns, first: int = 0) -> Columns:
        for stage in self.stages[first:]:
            data = stage.feed(data)
        return data

    def due(self) -> float | None:
        return min((d for s in self.stages if (d := s.due()) is not None), default=None)

    def close(self, now: float) -> list[Columns]:
        out = []
        while (due := self.due()) is not None and due <= now:
            at = next(k for k, s in enumerate(self.stages) if s.due() == due)
            out.append(self.feed(self.stages[at].close(now), at + 1))
        return out

"""Sequential operators: recurrences over a group's rows, run as one pass with bounded memory.

A kernel is an object with `outputs` and `step(*columns)`: it gets the next rows of its group as arrays of doubles and
returns one array an output, keeping what it needs for the rows after them. All kernels of a graph run in the same
pass: rows are dealt by group, sorted, and streamed in Arrow batches, so a group of any size needs the memory of a
batch and of its kernels' states.

Nulls: a row with a null in any input of a kernel is skipped by it. Its outputs are null, and the kernel goes on from the
row before as if there were no such row. Kernels that treat nulls otherwise say so (takes_nulls). NaN and infinities are
values and follow the arithmetic of doubles: a recurrence that has met a NaN stays NaN. Neither depends on where the rows
are cut into batches.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import partial
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import TINY
from .carry import Guessed, Last, Part, Smooth, Tail, Total
from .frames import Order

#: Most rows that a kernel may hold for its state to be carried over a cut.
CARRIED = 256
LARGEST = float(np.finfo(np.float64).max)


def smoothing(a: float) -> float:
    """Weight of a new value: 2 / (p + 1) for a period p of 1 or more, else the weight itself."""
    return 2.0 / (a + 1) if a >= 1 else a


def slow_smoothing(a: float) -> float:
    """1 / (p + 1) for a period of 1 or more, else the weight itself."""
    return 1.0 / (a + 1) if a >= 1 else a


class Kernel:
    """`step` may return masked arrays, whose masked values are null. With `takes_nulls` it gets all rows and `valid`, which
    tells the rows without a null; else only these. on_param(), where a kernel has it, changes options in mid-run.

    parts() names the pieces of its state, each with a level: what a piece makes of rows may depend on pieces of lower levels. A
    kernel that names all of them can go on from a cut in its group's rows (see ranges); None: it can't.
    """

    inputs = 1
    outputs: tuple[str, ...] = ("value",)
    takes_nulls = False

    def step(self, *x: np.ndarray) -> tuple[np.ndarray, ...]:
        raise NotImplementedError

    def parts(self) -> list[tuple[int, Part]] | None:
        return None


class Ema(Kernel):
    """Exponential average that starts at the first value."""

    outputs = ("ema",)

    def __init__(self, alpha: float):
        self.s = Smooth(smoothing(alpha))

    def on_param(self, alpha: float) -> None:
        self.s.alpha = smoothing(alpha)

    def step(self, x):
        return (self.s(x),)

    def parts(self):
        return [(1, self.s)]


class EmaUnbiased(Kernel):
    """Exponential average from 0, divided by the weight given so far."""

    outputs = ("ema",)

    def __init__(self, alpha: float):
        self.a = smoothing(alpha)
        self.s, self.n = Smooth(self.a, 0.0), Total()

    def on_param(self, alpha: float) -> None:
        self.a = self.s.alpha = smoothing(alpha)

    def step(self, x):
        n = self.n.value + np.arange(1, len(x) + 1)
        self.n.value += len(x)
        return (self.s(x) / (1 - (1 - self.a) ** n),)

    def parts(self):
        return [(1, self.s), (1, self.n)]


class Ewma(EmaUnbiased):
    """Average with weights (1 - alpha)^k of the value k rows ago: the same weights as the unbiased form."""

    outputs = ("ewma",)


class EmaTime(Kernel):
    """Exponential average whose weight follows the time passed: 1 - exp(-dt / tau); inputs x, dt."""

    inputs = 2
    outputs = ("ema",)

    def __init__(self, tau: float):
        self.tau, self.s = tau, Smooth(0.0)

    def on_param(self, tau: float) -> None:
        self.tau = tau

    def step(self, x, dt):
        return (self.s.weigh(x, -np.expm1(-np.asarray(dt) / self.tau)),)

    def parts(self):
        return [(1, self.s)]


class VarEw(Kernel):
    """Exponentially weighted mean and variance; 0 on the first row."""

    outputs = ("mean", "var")

    def __init__(self, alpha: float):
        self.a = smoothing(alpha)
        self.m, self.v = Smooth(self.a), Smooth(self.a, 0.0)

    def step(self, x):
        before = self.m.m
        m = self.m(x)
        d = x - np.concatenate([[x[0] if before is None else before], m[:-1]])
        return m, self.v(d * (x - m))

    def on_param(self, alpha: float) -> None:
        self.a = self.m.alpha = self.v.alpha = smoothing(alpha)

    def parts(self):
        return [(1, self.m), (2, self.v)]


class StdEw(VarEw):
    outputs = ("mean", "std")

    def step(self, x):
        m, v = super().step(x)
        return m, np.sqrt(v)


class CovEw(Kernel):
    inputs = 2
    outputs = ("mean_x", "mean_y", "cov")

    def __init__(self, alpha: float):
        self.a = smoothing(alpha)
        self.x, self.y, self.c = Smooth(self.a), Smooth(self.a), Smooth(self.a, 0.0)

    def step(self, x, y):
        bx, by = self.x.m, self.y.m
        mx, my = self.x(x), self.y(y)
        dx = x - np.concatenate([[x[0] if bx is None else bx], mx[:-1]])
        dy = y - np.concatenate([[y[0] if by is None else by], my[:-1]])
        return mx, my, self.c((1 - self.a) * dx * dy)

    def on_param(self, alpha: float) -> None:
        self.a = self.x.alpha = self.y.alpha = self.c.alpha = smoothing(alpha)

    def parts(self):
        return [(1, self.x), (1, self.y), (2, self.c)]


class ZscoreEw(StdEw):
    """Distance from the exponentially weighted mean in deviations; 0 while there is none."""

    outputs = ("mean", "z")

    def step(self, x):
        m, s = super().step(x)
        return m, np.divide(x - m, s, out=np.zeros(len(x)), where=s != 0)


class Zband(Kernel):
    """Mean and deviation of values pulled back to the last one where they leave the band; the first deviation is
    the largest double."""

    outputs = ("mean", "std")

    def __init__(self, alpha: float, threshold: float, influence: float):
        self.a, self.threshold, self.influence = smoothing(alpha), threshold, influence
        self.m: float | None = None
        self.v, self.last, self.sd = 0.0, 0.0, LARGEST

    def on_param(self, **options: float) -> None:
        self.a = smoothing(options["alpha"]) if "alpha" in options else self.a
        self.threshold, self.influence = options.get("threshold", self.threshold), options.get("influence", self.influence)

    def step(self, x):
        ms, sds = [], []
        for v in x.tolist():
            if self.m is None:
                self.m = self.last = v
            else:
                if abs(v - self.m) > self.threshold * self.sd:
                    v = self.last + self.influence * (v - self.last)
                d = v - self.m
                self.m += self.a * d
                self.v += self.a * (d * (v - self.m) - self.v)
                self.last, self.sd = v, self.v**0.5
            ms.append(self.m)
            sds.append(self.sd)
        return np.array(ms), np.array(sds)


class Macd(Kernel):
    """Difference of a fast and a slow average, its smoothed signal, and what is between them."""

    inputs = 2
    outputs = ("macd", "signal", "hist")

    def __init__(self, alpha: float = 9):
        self.s = Smooth(smoothing(alpha))

    def step(self, fast, slow):
        cd = fast - slow
        sig = self.s(cd)
        return cd, sig, cd - sig

    def on_param(self, alpha: float) -> None:
        self.s.alpha = smoothing(alpha)

    def parts(self):
        return [(1, self.s)]


class Rsi(Kernel):
    """Relative strength from smoothed gains and losses that start at 0 (weight 1 / (p + 1)); 100 without losses."""

    outputs = ("rsi",)

    def __init__(self, period: float = 14):
        a = slow_smoothing(period)
        self.g, self.l, self.prev = Smooth(a, 0.0), Smooth(a, 0.0), Last()

    def on_param(self, period: float) -> None:
        self.g.alpha = self.l.alpha = slow_smoothing(period)

    def parts(self):
        return [(1, self.prev), (2, self.g), (2, self.l)]

    def step(self, x):
        d = np.diff(np.concatenate([[x[0] if self.prev.value is None else self.prev.value], x]))
        self.prev.value = float(x[-1])
        g, loss = self.g(np.maximum(d, 0)), self.l(np.maximum(-d, 0))
        ratio = np.divide(g, loss, out=np.full(len(x), np.nan), where=loss >= TINY)
        return (np.where(loss < TINY, 100.0, 100 - 100 / (1 + ratio)),)


class Atr(Kernel):
    """Smoothed true range from 0 (weight 2 / (p + 1)); inputs high, low, close."""

    inputs = 3
    outputs = ("atr",)

    def __init__(self, period: float = 14):
        self.s, self.c = Smooth(smoothing(period), 0.0), Last()

    def on_param(self, period: float) -> None:
        self.s.alpha = smoothing(period)

    def parts(self):
        return [(1, self.c), (2, self.s)]

    def step(self, h, lo, c):
        before = np.concatenate([[np.nan if self.c.value is None else self.c.value], c[:-1]])
        self.c.value = float(c[-1])
        return (self.s(np.fmax(h - lo, np.fmax(np.abs(h - before), np.abs(lo - before)))),)


class Dm(Kernel):
    """Smoothed directional movement up and down from 0 (weight 1 / (p + 1)); inputs high, low; 0 on the first row."""

    inputs = 2
    outputs = ("plus", "minus")

    def __init__(self, period: float = 14):
        a = slow_smoothing(period)
        self.u, self.d, self.prev = Smooth(a, 0.0), Smooth(a, 0.0), Last()

    def on_param(self, period: float) -> None:
        self.u.alpha = self.d.alpha = slow_smoothing(period)

    def parts(self):
        return [(1, self.prev), (2, self.u), (2, self.d)]

    def step(self, h, lo):
        ph, pl = self.prev.value or (float(h[0]), float(lo[0]))
        self.prev.value = float(h[-1]), float(lo[-1])
        up = h - np.concatenate([[ph], h[:-1]])
        down = np.concatenate([[pl], lo[:-1]]) - lo
        return self.u(np.where((up > 0) & (up > down), up, 0.0)), self.d(np.where((down > 0) & (down > up), down, 0.0))


def mfm(h: np.ndarray, lo: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Money flow multiplier; 0 where high and low are equal."""
    return np.divide((c - lo) - (h - c), h - lo, out=np.zeros(len(h)), where=h != lo)


class Adosc(Kernel):
    """Fast less slow average of the accumulated money flow; inputs high, low, close, volume."""

    inputs = 4
    outputs = ("adosc",)

    def __init__(self, fast: float = 3, slow: float = 10):
        self.f, self.s, self.ad = Smooth(smoothing(fast)), Smooth(smoothing(slow)), Total()

    def on_param(self, **periods: float) -> None:
        for k, s in (("fast", self.f), ("slow", self.s)):
            s.alpha = smoothing(periods[k]) if k in periods else s.alpha

    def parts(self):
        return [(1, self.ad), (2, self.f), (2, self.s)]

    def step(self, h, lo, c, v):
        ad = np.cumsum(np.concatenate([[self.ad.value], mfm(h, lo, c) * v]))[1:]
        self.ad.value = float(ad[-1])
        return (self.f(ad) - self.s(ad),)


class Kdj(Kernel):
    """Stochastic K, D and J = 3D - 2K over the last `rows` rows, from the first row on, seeded with the first value;
    50 where the range is tiny. Inputs high, low, close."""

    inputs = 3
    outputs = ("k", "d", "j")

    def __init__(self, rows: int = 9, k: float = 3, d: float = 3):
        self.rows, self.k, self.d = rows, Smooth(smoothing(k)), Smooth(smoothing(d))
        self.held = Tail(rows - 1, 2)

    def on_param(self, **periods: float) -> None:
        for k, s in (("k", self.k), ("d", self.d)):
            s.alpha = smoothing(periods[k]) if k in periods else s.alpha

    def parts(self):
        return [(1, self.held), (2, self.k), (3, self.d)] if self.rows <= CARRIED else None

    def step(self, h, lo, c):
        hs, ls = self.held.push(h, lo)
        hh = pd.Series(hs).rolling(self.rows, min_periods=1).max().to_numpy()[len(hs) - len(h) :]
        ll = pd.Series(ls).rolling(self.rows, min_periods=1).min().to_numpy()[len(ls) - len(lo) :]
        wide = np.abs(hh - ll) >= TINY
        fast = np.where(wide, 100 * np.divide(c - ll, hh - ll, out=np.zeros(len(c)), where=wide), 50.0)
        k = self.k(fast)
        d = self.d(k)
        return k, d, 3 * d - 2 * k


class DynwinAvg(Kernel):
    """Rolling mean whose window doubles each time the spread since the last doubling exceeds threshold^2."""

    outputs = ("mean",)

    def __init__(self, rows: int, threshold: float):
        self.rows, self.limit = rows, threshold**2
        self.x: deque = deque()
        self.mean = self.m2 = 0.0

    def on_param(self, threshold: float) -> None:
        self.limit = threshold**2

    def step(self, x):
        out = []
        for v in x.tolist():
            self.x.append(v)
            d = v - self.mean
            self.mean += d / len(self.x)
            self.m2 += d * (v - self.mean)
            if self.m2 > self.limit:
                self.rows, self.m2 = 2 * self.rows, 0.0
            while len(self.x) > self.rows:
                old = self.x.popleft()
                d = old - self.mean
                self.mean -= d / len(self.x)
                self.m2 = max(0.0, self.m2 - d * (old - self.mean))
            out.append(self.mean)
        return (np.array(out),)


class Cusum(Kernel):
    """Number of the bar that each row belongs to: a bar ends with the row whose accumulated log-returns leave
    (-threshold, threshold) on one side; and whether the row ends a bar. Input x > 0; from and to 0 log-returns are infinite,
    and one that is NaN (from 0 to 0, or beside x < 0) lies above any threshold, as NaN is SQL's largest number."""

    outputs = ("bar", "fired")

    def __init__(self, threshold: float):
        self.threshold = abs(threshold)
        self.last, self.run = Last(), Guessed((0.0, 0.0))

    def on_param(self, threshold: float) -> None:
        self.threshold = abs(threshold)

    def parts(self):
        return [(1, self.last), (2, self.run)]

    def step(self, x):
        bars, fired = [], []
        (up, down), bar = self.run.value
        with np.errstate(all="ignore"):
            logs = np.log(x).tolist()
        last = self.last.value
        for v in logs:
            g, last = 0.0 if last is None else v - last, v
            up, down = max(up + g, 0.0), min(0.0, down + g)  # in this order a NaN stays in the first and not in the second
            on = up > self.threshold or up != up or down < -self.threshold
            bars.append(bar)
            fired.append(float(on))
            if on:
                up = down = 0.0
                bar += 1
        self.last.value, self.run.value = last, ((up, down), bar)
        return np.array(bars, dtype=np.float64), np.array(fired)


class RowNumber(Kernel):
    """Number of the row in its group, from 0."""

    inputs = 0
    outputs = ("row",)
    takes_nulls = True

    def __init__(self) -> None:
        self.n = Total()

    def parts(self):
        return [(1, self.n)]

    def step(self, *x, valid):
        n = self.n.value + np.arange(len(valid))
        self.n.value += len(valid)
        return (n.astype(np.float64),)


class Carry(Kernel):
    """The latest value of each input that is no null, this row's included; null before there is one."""

    takes_nulls = True

    def __init__(self, inputs: int):
        self.inputs, self.outputs = inputs, tuple(f"value{k}" for k in range(inputs))
        self.held = [Last() for _ in range(inputs)]

    def parts(self):
        return [(1, p) for p in self.held]

    def step_nulls(self, *x):
        out = []
        for last, (v, ok) in zip(self.held, x, strict=True):
            ok = np.ones(len(v), dtype=bool) if ok is None else ok
            at = np.cumsum(ok)
            known = np.concatenate([[np.nan if last.value is None else last.value], v[ok]])
            out.append(np.ma.masked_array(known[at], (at == 0) & (last.value is None)))
            last.value = last.value if at[-1] == 0 else float(known[-1])
        return tuple(out)


class Sessions(Kernel):
    """Number of the session of each row: another begins where a row comes `gap` or more after the one before. Input: the time."""

    outputs = ("session",)

    def __init__(self, gap: float):
        self.gap, self.last, self.n = gap, Last(), Total()

    def parts(self):
        return [(1, self.last), (2, self.n)]

    def step(self, t):
        breaks = np.diff(np.concatenate([[t[0] if self.last.value is None else self.last.value], t])) >= self.gap
        n = self.n.value + np.cumsum(breaks)
        self.last.value, self.n.value = float(t[-1]), int(n[-1])
        return (n.astype(np.float64),)


class Functor(Kernel):
    """A user's stateful callable, row by row: a number or a tuple of numbers for each row."""

    def __init__(self, make: Callable[[], Callable], inputs: int, outputs: tuple[str, ...] = ("value",)):
        self.f, self.inputs, self.outputs = make(), inputs, outputs

    def step(self, *x):
        rows = [self.f(*r) for r in zip(*(c.tolist() for c in x), strict=True)]
        return tuple(np.array(c, dtype=np.float64) for c in (zip(*rows, strict=True) if len(self.outputs) > 1 else [rows]))


class Arrays(Kernel):
    """A function of arrays that looks at no other row."""

    def __init__(self, f: Callable[..., list[np.ndarray]], inputs: int, outputs: tuple[str, ...]):
        self.f, self.inputs, self.outputs = f, inputs, outputs

    def step(self, *x):
        with np.errstate(all="ignore"):
            return tuple(self.f(*x))

    def parts(self):
        return []


KERNELS: dict[str, type[Kernel]] = {
    "ema": Ema,
    "ema_unbiased": EmaUnbiased,
    "ewma": Ewma,
    "ema_time": EmaTime,
    "var_ew": VarEw,
    "std_ew": StdEw,
    "cov_ew": CovEw,
    "zscore_ew": ZscoreEw,
    "zband": Zband,
    "macd": Macd,
    "rsi": Rsi,
    "atr": Atr,
    "dm": Dm,
    "adosc": Adosc,
    "kdj": Kdj,
    "dynwin_avg": DynwinAvg,
    "cusum": Cusum,
}


class Node:
    """A kernel in a pass: how to make it, the columns it reads, and the columns it adds.

    An option whose value is a string names a column: each group's first value of it is the option (a parameter
    table joined to the rows gives every group its own). With `live`, later values of these columns change the options
    from their row on, by the kernel's on_param(); rows without such a value, a null or NaN, count as if they were not there.
    """

    def __init__(self, make: type[Kernel] | Callable[..., Kernel], args: list[str], names: list[str], options: dict[str, Any] | None = None, live: bool = False):
        self.make, self.args, self.names, self.options, self.live = make, args, names, dict(options or {}), live
        self.asked = {k: v for k, v in self.options.items() if isinstance(v, str) and k not in ("name", "fill", "sized")}
        self.columns = list(self.asked.values())
        if live and self.columns and not callable(getattr(self.start(lambda c: 1.0), "on_param", None)):
            raise ValueError(f"the options of {self.names} can't change in mid-run: the kernel has no on_param()")

    def start(self, value: Callable[[str], float]) -> Kernel:
        return self.make(**{k: value(v) if k in self.asked else v for k, v in self.options.items()})


Columns = dict[str, tuple[np.ndarray, np.ndarray | None]]  #: values and, where there are nulls, which are none


def start(nodes: list[Node], data: Columns) -> list[Kernel]:
    def first(c: str, live: bool) -> float:
        x = data[c][0]
        if not live:
            return float(x[0])
        known = np.flatnonzero(~np.isnan(x))
        return float(x[known[0]]) if len(known) else 1.0  # to be changed before a row counts

    return [n.start(partial(first, live=n.live)) for n in nodes]


def _run(kernel: Kernel, cols: list[np.ndarray], valid: np.ndarray | None, n: int, outputs: int) -> list[tuple[np.ndarray, np.ndarray | None]]:
    split = lambda y: (np.ma.getdata(y), ~np.ma.getmaskarray(y)) if isinstance(y, np.ma.MaskedArray) else (y, None)
    if getattr(kernel, "takes_nulls", False):
        if isinstance(kernel, Carry):
            raise ValueError("values that are carried come with their own nulls")
        return [split(y) for y in kernel.step(*cols, valid=np.ones(n, dtype=bool) if valid is None else valid)]
    if valid is None or valid.all():
        return [split(y) for y in kernel.step(*cols)]
    out = [(np.zeros(n), valid.copy()) for _ in range(outputs)]
    if valid.any():
        for (y, ok), (z, fine) in zip(out, map(split, kernel.step(*(c[valid] for c in cols))), strict=True):
            y[valid] = z
            if fine is not None:
                ok[valid] = fine
    return out


def advance(nodes: list[Node], kernels: list[Kernel], data: Columns, n: int) -> None:
    """Runs the next n rows of one group through its kernels; `data` gets their outputs."""
    for node, kernel in zip(nodes, kernels, strict=True):
        cols = [data[c][0] for c in node.args]
        oks = [data[c][1] for c in node.args if data[c][1] is not None]
        valid = np.logical_and.reduce(oks) if oks else None
        if isinstance(kernel, Carry):
            for name, y in zip(node.names, kernel.step_nulls(*(data[c] for c in node.args)), strict=True):
                data[name] = np.ma.getdata(y), None if not np.ma.getmaskarray(y).any() else ~np.ma.getmaskarray(y)
            continue
        cuts = [0, n]
        if node.live and node.columns:
            known = ~np.logical_or.reduce([np.isnan(data[c][0]) for c in node.columns])
            if not known.all():  # as long as there is no option a row is as if it were not there
                valid = known if valid is None else valid & known
            changed = np.zeros(n, dtype=bool)
            changed[0] = True
            for c in node.columns:
                v = data[c][0]
                changed[1:] |= (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))
            cuts = [*np.flatnonzero(changed).tolist(), n]
        parts = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if node.live and node.columns and known[a]:
                kernel.on_param(**{k: float(data[c][0][a]) for k, c in node.asked.items()})
            parts.append(_run(kernel, [c[a:b] for c in cols], None if valid is None else valid[a:b], b - a, len(node.names)))
        for k, name in enumerate(node.names):
            ok = None if all(p[k][1] is None for p in parts) else np.concatenate([np.ones(len(p[k][0]), dtype=bool) if p[k][1] is None else p[k][1] for p in parts])
            data[name] = (parts[0][k][0] if len(parts) == 1 else np.concatenate([p[k][0] for p in parts])), ok


def read_columns(nodes: list[Node]) -> list[str]:
    """Columns of the table that kernels read."""
    made = {n for node in nodes for n in node.names}
    return sorted({a for n in nodes for a in (*n.args, *n.columns)} - made)


def group_key(batch: pa.RecordBatch, groups: list[str], row: int) -> tuple:
    """The row's group; NaN equals itself."""
    return tuple("nan" if isinstance(v, float) and v != v else v for v in (batch.column(g)[row].as_py() for g in groups))


def runs(batch: pa.RecordBatch, groups: list[str]) -> Iterator[tuple[int, int]]:
    """Where the batch's rows of one group begin and end."""
    change = np.zeros(batch.num_rows, dtype=bool)
    for g in groups:
        codes = np.asarray(batch.column(g).dictionary_encode("encode").indices)
        change[1:] |= codes[1:] != codes[:-1]
    starts = [0, *np.flatnonzero(change).tolist()]
    return zip(starts, [*starts[1:], batch.num_rows], strict=True)


def values(batch: pa.RecordBatch, read: list[str]) -> Columns:
    """The columns as doubles."""
    out: Columns = {}
    for c in read:
        x = batch.column(c).cast(pa.float64(), safe=False)
        out[c] = np.asarray(x.fill_null(float("nan"))), np.asarray(x.is_valid()) if x.null_count else None
    return out


def part_of(data: Columns, a: int, b: int) -> Columns:
    return {c: (x[a:b], None if ok is None else ok[a:b]) for c, (x, ok) in data.items()}


def outputs_of(nodes: list[Node], df: DataFrame) -> tuple[list[str], StructType]:
    """Names of the columns that nodes add, and the schema with them; ValueError if a name is taken."""
    made = [n for node in nodes for n in node.names]
    if len(set(made)) < len(made) or set(made) & set(df.columns):
        raise ValueError(f"output names are taken: {sorted(n for n in made if n in df.columns or made.count(n) > 1)}")
    schema = StructType(list(df.schema.fields))
    for n in made:
        schema = schema.add(n, "double")
    return made, schema


def replay(batches: Iterator[pa.RecordBatch], nodes: list[Node], groups: list[str], held: list[str], begin: Callable[[pa.RecordBatch, Columns, bool], list[Kernel]]) -> Iterator[pa.RecordBatch]:
    """The batches with the nodes' outputs; begin(batch, a group's first values, whether it is the first group) makes kernels."""
    made, read = [n for node in nodes for n in node.names], read_columns(nodes)
    last: tuple | None = None
    kernels: list[Kernel] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        whole = values(batch, read)
        out, fine = {c: np.empty(n) for c in made}, {c: np.ones(n, dtype=bool) for c in made}
        for a, b in runs(batch, groups):
            data = part_of(whole, a, b)
            key = group_key(batch, groups, a)
            if key != last:
                kernels = begin(batch, data, last is None)
                last = key
            advance(nodes, kernels, data, b - a)
            for c in made:
                out[c][a:b] = data[c][0]
                if data[c][1] is not None:
                    fine[c][a:b] = data[c][1]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), *(pa.array(out[c], mask=None if fine[c].all() else ~fine[c]) for c in made)], [*held, *made])


def dealt(df: DataFrame, groups: list[str], number: int | None = None) -> DataFrame:
    """Rows dealt by group. Not by the columns themselves: over a join on these Spark takes the rows for dealt already, and while the
    query runs may yet turn that join into one that leaves them where they were read, or split its larger partitions."""
    by = F.xxhash64(*groups)
    return df.repartition(number, by) if number else df.repartition(by)


def scan(df: DataFrame, order: Order, nodes: list[Node], ready: bool = False, number: int | None = None) -> DataFrame:
    """Adds the outputs of all nodes, in one pass over each group's rows in order. Nodes may read earlier nodes' outputs.

    An empty table stays empty; a null group is a group. A node must not name an output like a column of the table or like
    another output. A group is one task's work; see ranges for groups that are cut. With `ready` the rows come from windows over the
    groups, whose shuffle will do; else `number` is that of partitions.
    """
    _, schema = outputs_of(nodes, df)
    groups, held = list(order.groups), list(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return replay(batches, nodes, groups, held, lambda batch, data, first: start(nodes, data))

    rows = df.repartition(*groups) if ready else dealt(df, groups, number)
    return rows.sortWithinPartitions(*groups, *order.keys).mapInArrow(run, schema)


IS_ROW = "__is_row"


def among(df: DataFrame, order: Order, versions: DataFrame, since: str) -> tuple[DataFrame, list[str]]:
    """The rows (IS_ROW 1) and among them the versions (0), with a version's parameters as __v_<name>; and these names."""
    names = [c for c in versions.columns if c not in order.groups and c != since]
    if set(names) & set(df.columns):
        raise ValueError(f"columns are taken: {sorted(set(names) & set(df.columns))}")
    kinds = dict(df.dtypes)
    marks = versions.select(*order.groups, F.col(since).cast(kinds[order.time]).alias(order.time), *(F.col(c).cast("double").alias(f"__v_{c}") for c in names), F.lit(0).alias(IS_ROW))
    return df.withColumn(IS_ROW, F.lit(1)).unionByName(marks, allowMissingColumns=True), names


def with_versions(df: DataFrame, order: Order, versions: DataFrame, since: str) -> DataFrame:
    """Adds to each row the parameters of the latest version of its group whose time `since` is not later than the row's.

    Versions are put among the rows, each before the rows of its time, and their values carried on in one pass over both; with
    several versions of one time any may count. Rows before the first version have nulls. Groups match by value, null by null;
    other columns of `versions` must be numbers, and new ones.
    """
    from .ranges import scan_ranges, wanted

    both, names = among(df, order, versions, since)
    node = [Node(partial(Carry, len(names)), [f"__v_{c}" for c in names], names)]
    inner = Order(order.groups, order.time, (IS_ROW, *order.ties))
    number = wanted(both, order)
    out = scan_ranges(both, inner, node, number) if number else scan(both, inner, node)
    return out.filter(f"{IS_ROW} = 1").select(*df.columns, *names)


def with_parameters(df: DataFrame, parameters: DataFrame, on: list[str]) -> DataFrame:
    """Joins a table of parameters by group; Spark broadcasts it only where its size allows."""
    return df.join(parameters, on, "left")


def mfm_column(h: str, lo: str, c: str):
    """Money flow multiplier as a column."""
    h, lo, c = F.col(h), F.col(lo), F.col(c)
    return F.when(h != lo, ((c - lo) - (h - c)) / (h - lo)).otherwise(0.0)


def directional_index(plus: str, minus: str, atr: str):
    """+DI, -DI and DX from smoothed movement and range; 0 where a denominator is 0."""
    p, m, a = F.col(plus), F.col(minus), F.col(atr)
    pdi, mdi = F.when(a != 0, p / a).otherwise(0.0), F.when(a != 0, m / a).otherwise(0.0)
    return pdi, mdi, F.when(p + m != 0, F.abs(p - m) / (p + m) * 100).otherwise(0.0)

"""Rolling operators: sums, moments, two-series statistics, lags, extremes.

Over rows, and over all rows so far, they are Spark's window functions; over a time they are kernels (see spans), since a
RANGE frame does not follow the rows' order among equal times. A row with a null in any input is not counted in either.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalar import TINY
from ..functions.timeunits import as_size
from .frames import Frame, Span
from .spans import SpanLag, SpanStatistic


@dataclass(frozen=True)
class Rolling:
    """An operator over a span: its inputs, its outputs by name, and the columns that compute them."""

    name: str
    inputs: int
    outputs: tuple[str, ...]
    make: Callable[..., list[Column]]
    span: Span = Span()
    options: dict = field(default_factory=dict)

    def columns(self, frame: Frame, args: list[Column]) -> list[Column]:
        if len(args) > 1:  # pairs count as a whole
            both = F.lit(True)
            for a in args:
                both = both & a.isNotNull()
            args = [frame.keep(F.when(both, a)) for a in args]
        return self.make(frame, *args, **self.options)

    def kernel(self) -> tuple[type, dict]:
        """The same operator as a kernel, whose inputs are the operator's and the time as a number, and its options."""
        extent = {self.span.kind: self.span.rows if self.span.kind == "rows" else float(as_size(self.span.time))} if self.span.kind != "all" else {}
        return (SpanLag, extent | self.options) if self.name == "lag" else (SpanStatistic, {"name": self.name} | extent | self.options)


def _sum(f: Frame, x: Column) -> list[Column]:
    return [f.total(x)]


def _avg(f: Frame, x: Column) -> list[Column]:
    return [f.mean(x)]


def _avg_weighted(f: Frame, x: Column, w: Column) -> list[Column]:
    s = f.total(w)
    return [F.when(s != 0, f.total(x * w) / s).otherwise(float("nan"))]


def _moment2(f: Frame, x: Column) -> list[Column]:
    return [f.mean(x), f.covariance(x, x, unbiased=False) * f.count(x)]


def _var(f: Frame, x: Column, unbiased: bool = True) -> list[Column]:
    return [f.mean(x), f.covariance(x, x, unbiased)]


def _stddev(f: Frame, x: Column, unbiased: bool = True) -> list[Column]:
    return [f.mean(x), F.sqrt(f.covariance(x, x, unbiased))]


def _var_vw(f: Frame, x: Column, w: Column) -> list[Column]:
    y, m = f.centred(x)
    n, sw, sww, swx, swxx = f.count(x), f.total(w), f.total(w * w), f.total(w * y), f.total(w * y * y)
    mean = f.keep(F.when(sw != 0, swx / sw).otherwise(float("nan")))
    spread = F.greatest(swxx - 2 * mean * swx + mean * mean * sw, F.lit(0.0))
    below = f.keep(F.when(sw != 0, sw - sww / sw).otherwise(0.0))
    return [mean + m, F.when((n <= 1) | (below <= TINY), F.lit(0.0)).otherwise(spread / below)]


def _std_vw(f: Frame, x: Column, w: Column) -> list[Column]:
    mean, var = _var_vw(f, x, w)
    return [mean, F.sqrt(var)]


def _cov(f: Frame, x: Column, y: Column) -> list[Column]:
    return [f.mean(x), f.mean(y), f.covariance(x, y)]


def _corr(f: Frame, x: Column, y: Column) -> list[Column]:
    c = f.covariance(x, y)
    d = f.keep(F.sqrt(f.covariance(x, x)) * F.sqrt(f.covariance(y, y)))
    return [f.mean(x), f.mean(y), c, F.when(d > 0, c / d).otherwise(0.0)]


def _beta(f: Frame, x: Column, y: Column) -> list[Column]:
    c, v = f.covariance(x, y), f.covariance(x, x)
    return [f.mean(x), f.mean(y), c, F.when(v > 0, c / v).otherwise(0.0)]


def _zscore(f: Frame, x: Column) -> list[Column]:
    m, s = f.mean(x), f.keep(F.sqrt(f.covariance(x, x)))
    return [m, F.when(s != 0, (x - m) / s).otherwise(0.0)]


def _min(f: Frame, x: Column) -> list[Column]:
    return [f.extreme(x, False)]


def _max(f: Frame, x: Column) -> list[Column]:
    return [f.extreme(x, True)]


def _lag(f: Frame, x: Column, fill: str = "nan") -> list[Column]:
    """x of `rows` rows ago; before there is one: NaN, 0, the present x ("last") or the first x ("oldest")."""
    if fill not in ("nan", "zero", "last", "oldest"):
        raise ValueError(f"unknown fill {fill!r}")
    w = f.order.window()
    if f.span.kind == "all":
        raise ValueError("a lag needs rows or a time above 0")
    old = f.keep(F.lag(F.struct(x.alias("x")), f.span.rows).over(w))
    gone, value = old.isNotNull(), old["x"]
    other = {"nan": lambda: F.lit(float("nan")), "zero": lambda: F.lit(0.0), "last": lambda: x, "oldest": lambda: F.first(x).over(f.order.running())}[fill]()
    return [F.when(gone, value).otherwise(f.keep(other))]


_OPS: dict[str, tuple[int, tuple[str, ...], Callable]] = {
    "sum": (1, ("sum",), _sum),
    "avg": (1, ("mean",), _avg),
    "avg_weighted": (2, ("mean",), _avg_weighted),
    "moment2": (1, ("mean", "m2"), _moment2),
    "var": (1, ("mean", "var"), _var),
    "stddev": (1, ("mean", "std"), _stddev),
    "var_vw": (2, ("mean", "var"), _var_vw),
    "std_vw": (2, ("mean", "std"), _std_vw),
    "cov": (2, ("mean_x", "mean_y", "cov"), _cov),
    "corr": (2, ("mean_x", "mean_y", "cov", "corr"), _corr),
    "beta": (2, ("mean_x", "mean_y", "cov", "beta"), _beta),
    "zscore": (1, ("mean", "z"), _zscore),
    "lag": (1, ("lag",), _lag),
    "min": (1, ("min",), _min),
    "max": (1, ("max",), _max),
}
NAMES = tuple(_OPS)


def rolling(name: str, *, rows: int | None = None, time: object = None, **options: object) -> Rolling:
    """A rolling operator by name; rows = 0 or neither: cumulative. Extremes need a span."""
    if name not in _OPS:
        raise ValueError(f"unknown rolling operator {name!r}")
    span = Span(rows=rows, time=time)
    if name in ("min", "max") and span.kind == "all":
        raise ValueError("an extreme needs rows or a time above 0")
    inputs, outputs, make = _OPS[name]
    return Rolling(name, inputs, outputs, make, span, dict(options))

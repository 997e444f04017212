"""Groups, strict order and frames: what a rolling operator sees at a row."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.timeunits import Duration, as_size, time_key

_names = count()


@dataclass(frozen=True)
class Order:
    """Series of a table: group columns, the time column, and columns that break ties of time.

    The three together must order a group strictly; nothing else fixes which of two equal rows comes first.
    """

    groups: tuple[str, ...]
    time: str
    ties: tuple[str, ...] = ()

    def __init__(self, groups: list[str] | tuple[str, ...] | str, time: str, ties: list[str] | tuple[str, ...] | str = ()):
        tup = lambda x: (x,) if isinstance(x, str) else tuple(x)
        object.__setattr__(self, "groups", tup(groups))
        object.__setattr__(self, "time", time)
        object.__setattr__(self, "ties", tup(ties))

    @property
    def keys(self) -> tuple[str, ...]:
        return (self.time, *self.ties)

    @property
    def columns(self) -> tuple[str, ...]:
        return (*self.groups, *self.keys)

    def seq(self) -> Column:
        """Sort key of a row within its group."""
        return F.struct(*self.keys)

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.groups).orderBy(*self.keys)

    def running(self) -> WindowSpec:
        return self.window().rowsBetween(Window.unboundedPreceding, 0)

    def tick(self, df: DataFrame) -> Column:
        """Time as a number: microseconds for timestamps."""
        return time_key(F.col(self.time), df.schema[self.time].dataType.simpleString())


@dataclass(frozen=True)
class Span:
    """Extent of a rolling operator: the last `rows` rows, the last `time` of time (t - time, t], or all rows so far."""

    rows: int | None = None
    time: int | float | str | Duration | None = None

    def __post_init__(self) -> None:
        if self.rows is not None and self.time is not None:
            raise ValueError("a span has rows or a time, not both")
        if self.rows is not None and (not isinstance(self.rows, int) or self.rows < 0):
            raise ValueError("rows must be a whole number, 0 or more")
        if self.time is not None and as_size(self.time) < 0:
            raise ValueError("time must not be negative")

    @property
    def kind(self) -> str:
        return "rows" if self.rows else "time" if self.time is not None and as_size(self.time) > 0 else "all"


@dataclass
class Frame:
    """Statistics over a span at every row. Holds the table, to which it adds helper columns as needed.

    Row spans and cumulative spans are Spark's own frames; spans of time are kernels (see spans).
    """

    df: DataFrame
    order: Order
    span: Span
    added: list[str] = field(default_factory=list)

    def keep(self, column: Column) -> Column:
        """The column under a name of its own, so that windows can be stacked on it."""
        name = f"__{next(_names)}"
        self.df = self.df.withColumn(name, column)
        self.added.append(name)
        return F.col(name)

    def _rolling(self) -> WindowSpec:
        return self.order.window().rowsBetween(-(self.span.rows - 1), 0) if self.span.kind == "rows" else self.order.running()

    def total(self, x: Column) -> Column:
        """Sum of x over the span. A sum of all rows so far is given back what rounding took from it at each row, so that its
        error does not grow with the rows."""
        total = self.keep(F.sum(x).over(self._rolling()))
        if self.span.kind == "rows":
            return total
        before = self.keep(F.coalesce(F.sum(x).over(self.order.window().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        added = total - before
        lost = (before - (total - added)) + (F.coalesce(x, F.lit(0.0)) - added)
        lost = self.keep(F.when(F.abs(lost) < float("inf"), lost).otherwise(0.0))
        return self.keep(total + F.sum(lost).over(self._rolling()))

    def count(self, x: Column) -> Column:
        return self.keep(F.count(x).over(self._rolling()).cast("double"))

    def centred(self, x: Column) -> tuple[Column, Column]:
        """x less the series' first value, and that value: sums of squares keep more of their digits."""
        first = F.first(x, ignorenulls=True).over(self.order.running())
        first = self.keep(F.when(F.abs(first) < float("inf"), first).otherwise(0.0))
        return self.keep(x - first), first

    def mean(self, x: Column) -> Column:
        if self.span.kind == "rows":
            return self.keep(F.avg(x).over(self._rolling()))
        n = self.count(x)
        return self.keep(F.when(n > 0, self.total(x) / n))

    def covariance(self, x: Column, y: Column, unbiased: bool = True) -> Column:
        """Covariance (variance if y is x); 0 while the span has one row, null while it has none."""
        f = (F.var_samp if unbiased else F.var_pop)(x) if x is y else (F.covar_samp if unbiased else F.covar_pop)(x, y)
        return self.keep(F.when(F.count(x).over(self._rolling()) > 0, F.coalesce(f.over(self._rolling()), F.lit(0.0))))

    def extreme(self, x: Column, largest: bool) -> Column:
        return self.keep((F.max if largest else F.min)(x).over(self._rolling()))

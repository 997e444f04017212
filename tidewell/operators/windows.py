"""Windows of rows: every assigner numbers each row's window, says where windows end and which one is still open."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeunits import Duration, as_size
from .frames import Order
from .ranges import can_carry, scan_ranges, wanted
from .scan import KERNELS, Kernel, Node, RowNumber, Sessions, scan

WID = "__wid"


@dataclass(frozen=True)
class Windows:
    """A table with the window number of each row in WID. `ends` gives a window's time from its rows, `open` tells
    from a window's rows whether it is the group's last one and still open, given whether it is the last one."""

    df: DataFrame
    ends: Column
    shut: Column | None
    inclusive: bool


def as_time(df: DataFrame, order: Order, tick: Column) -> Column:
    kind = df.schema[order.time].dataType.simpleString()
    if kind.startswith("timestamp") or kind == "date":
        return F.timestamp_micros(tick.cast("long")).cast("timestamp" if kind == "date" else kind)
    return tick


def _numbered(df: DataFrame, order: Order, node: Node, ranges: int | None, report: dict | None = None) -> DataFrame:
    """The node's outputs, the first as a whole number; with groups cut into ranges where that is asked for or needed."""
    ranges = (wanted(df, order) if ranges is None else ranges) if can_carry(node) else 0
    df = scan_ranges(df, order, [node], ranges, report) if ranges else scan(df, order, [node])
    return df.withColumn(node.names[0], F.col(node.names[0]).cast("long")).filter(F.col(node.names[0]).isNotNull())


def tumbling(size: int | float | str | Duration) -> Callable[[DataFrame, Order], Windows]:
    """[k size, (k + 1) size) since the epoch, also before it; a window's time is its end; empty windows are skipped."""
    w = as_size(size)
    if w <= 0:
        raise ValueError("size must be above 0")

    def assign(df: DataFrame, order: Order) -> Windows:
        df = df.withColumn(WID, F.floor(order.tick(df) / F.lit(w)).cast("long"))
        return Windows(df, as_time(df, order, (F.col(WID) + 1) * F.lit(w)), None, False)

    assign.on_stream = ("tumbling", size)
    return assign


def counter(n: int, ranges: int | None = None) -> Callable[[DataFrame, Order], Windows]:
    """Every n rows of a group; a window's time is its last row's. `ranges`, here and below, is that of Graph.run()."""
    if n <= 0:
        raise ValueError("n must be above 0")

    def assign(df: DataFrame, order: Order) -> Windows:
        if number := wanted(df, order) if ranges is None else ranges:
            df = _numbered(df, order, Node(RowNumber, [], [WID]), number)
            df = df.withColumn(WID, F.floor(F.col(WID) / F.lit(n)).cast("long"))
        else:
            df = df.withColumn(WID, F.floor((F.row_number().over(order.window()) - 1) / F.lit(n)).cast("long"))
        return Windows(df, F.max(order.time), F.count("*") == n, True)

    assign.on_stream = ("counter", n)
    return assign


def session(gap: int | float | str | Duration, ranges: int | None = None) -> Callable[[DataFrame, Order], Windows]:
    """A window ends where the next row comes `gap` or more after its last; a window's time is its last row's."""
    w = as_size(gap)
    if w <= 0:
        raise ValueError("gap must be above 0")

    def assign(df: DataFrame, order: Order) -> Windows:
        df = df.withColumn("__tick", order.tick(df))
        if number := wanted(df, order) if ranges is None else ranges:
            df = _numbered(df, order, Node(Sessions, ["__tick"], [WID], {"gap": float(w)}), number).drop("__tick")
        else:
            breaks = F.coalesce(F.col("__tick") - F.lag("__tick").over(order.window()) >= F.lit(w), F.lit(False))
            df = df.withColumn("__break", breaks.cast("long"))
            df = df.withColumn(WID, F.sum("__break").over(order.running())).drop("__tick", "__break")
        return Windows(df, F.max(order.time), None, False)

    assign.on_stream = ("session", gap)
    return assign


def cusum(threshold: float, column: str, ranges: int | None = None, report: dict | None = None) -> Callable[[DataFrame, Order], Windows]:
    """A window ends with the row whose accumulated log-returns of `column` go beyond the threshold on one side. Where groups
    are cut, `report` gets how many ranges and rows were run again (see scan_ranges)."""

    def assign(df: DataFrame, order: Order) -> Windows:
        df = _numbered(df, order, Node(KERNELS["cusum"], [column], [WID, "__fired"], {"threshold": threshold}), ranges, report)
        return Windows(df, F.max(order.time), F.max("__fired") > 0, True)

    assign.on_stream = ("cusum", (threshold, column))
    return assign


def custom(make: Callable[[], Kernel], columns: list[str], ranges: int | None = None) -> Callable[[DataFrame, Order], Windows]:
    """Windows numbered by a user's kernel, whose one output is each row's number; a window's time is its last row's. Groups
    can be cut where the kernel names the parts of its state."""

    def assign(df: DataFrame, order: Order) -> Windows:
        df = _numbered(df, order, Node(make, columns, [WID]), ranges)
        return Windows(df, F.max(order.time), None, False)

    return assign


def hopping(size: int | float | str | Duration, step: int | float | str | Duration) -> Callable[[DataFrame, Order], Windows]:
    """Windows of `size` that start every `step`; a row is in each window that covers it. A graph whose aggregators can be put together
    from parts makes windows of four steps or more from panes, and copies no row (see overlap)."""
    w, s = as_size(size), as_size(step)
    if w <= 0 or s <= 0:
        raise ValueError("size and step must be above 0")

    def assign(df: DataFrame, order: Order) -> Windows:
        tick = order.tick(df)
        ids = F.sequence((F.floor((tick - F.lit(w)) / F.lit(s)) + 1).cast("long"), F.floor(tick / F.lit(s)).cast("long"))
        df = df.withColumn(WID, F.explode(ids))
        return Windows(df, as_time(df, order, F.col(WID) * F.lit(s) + F.lit(w)), None, False)

    assign.hops = (w, s)
    return assign


def emitter(make: Callable[[], object], columns: list[str] | tuple[str, ...] = ()) -> Callable[[DataFrame, Order], Windows]:
    """Windows of a user's emitter over the queue of rows, which may overlap and leave rows out: see overlap.Emitting. Aggregators
    must be those that can be put together from parts; windows that the last row leaves in the queue are not emitted."""

    def assign(df: DataFrame, order: Order) -> Windows:
        raise ValueError("windows of an emitter have no number for each row; they are aggregated by a graph")

    assign.emitter = (make, list(columns))
    return assign


ASSIGNERS = {"tumbling": tumbling, "time": tumbling, "counter": counter, "session": session, "cusum": cusum, "cusum_filter": cusum, "hopping": hopping, "custom": custom}


def last_of(order: Order) -> Column:
    """Number of the group's last window, over a table with one row a window."""
    from pyspark.sql import Window

    return F.max(WID).over(Window.partitionBy(*order.groups))

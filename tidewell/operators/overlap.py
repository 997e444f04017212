"""Windows that overlap: a row in many windows is read once, and what windows share is put together from parts.

Hopping windows are made of panes, stretches of time that every window holds whole or not at all. Windows of a user's emitter are
ranges of row numbers, made of blocks of rows and of pieces of blocks at both ends.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .aggs import What, finished, states
from .aggs import combined as combine
from .frames import Order
from .scan import Kernel, Node, scan

#: Rows of a block.
BLOCK = 1024


def pane_of(size: float, step: float) -> float | None:
    """Longest stretch that size and step are multiples of; None where they are no whole numbers and size is no multiple."""
    if float(size).is_integer() and float(step).is_integer():
        return math.gcd(int(size), int(step))
    return step if abs(size / step - round(size / step)) < 1e-9 else None


def paned(df: DataFrame, order: Order, size: float, step: float, pane: float, number: str, what: What) -> DataFrame:
    """Groups, window number and values: rows become a state a pane, and only states are copied for the windows that share a pane."""
    ids = [*order.groups, "__pane"]
    keys = [k for k in order.keys if k not in ids]
    df = df.withColumn("__pane", F.floor(order.tick(df) / F.lit(pane)).cast("long"))
    panes = combine(states(df, order, ids, what), ids, keys, what)
    at = F.col("__pane") * F.lit(pane)
    first, last = F.floor((at - F.lit(size)) / F.lit(step)) + 1, F.floor(at / F.lit(step))
    shared = panes.withColumn(number, F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return finished(shared.drop("__pane"), [*order.groups, number], keys, what)


class Emitting(Kernel):
    """A user's emitter: an object whose on_row(time, *x) gives None, or (offset, size, evict) where a window is emitted.

    Rows wait in a queue; a window is `size` of them, `offset` behind the queue's head, and `evict` of them leave it. Outputs: the
    row's number, and the numbers of the window's first row and of the row behind its last one, null where there is none.
    A row with a null in an input the emitter does not see: it is not in the queue.
    """

    outputs = ("row", "first", "end")

    def __init__(self, make, inputs: int):
        self.emitter, self.inputs = make(), inputs + 1
        self.n = self.head = 0

    def step(self, *columns):
        *x, t = columns
        first, end = np.zeros(len(t)), np.zeros(len(t))
        none = np.ones(len(t), dtype=bool)
        for k, row in enumerate(zip(t.tolist(), *(c.tolist() for c in x), strict=True)):
            self.n += 1
            if (got := self.emitter.on_row(*row)) is not None:
                offset, size, evict = got
                if not (0 <= offset and 0 <= size and offset + size <= self.n - self.head and 0 <= evict <= self.n - self.head):
                    raise ValueError(f"a window of {size} rows behind {offset}, {evict} to leave, of {self.n - self.head} rows that wait")
                first[k], end[k], none[k] = self.head + offset, self.head + offset + size, False
                self.head += evict
        row = self.n - len(t) + np.arange(len(t), dtype=np.float64)
        return row, np.ma.masked_array(first, none), np.ma.masked_array(end, none)


def _pieces(key: tuple, rows: pa.Table, asked: pa.Table, groups: list[str], named: list, outs: list[str]) -> pa.Table:
    """States of the pieces [from, to) of one block's rows that windows ask for; equal pieces are made once."""
    rows = rows.sort_by("__row")
    number = rows.column("__row").to_numpy()
    known: dict[tuple[int, int], list] = {}
    got: list[list] = []
    for a, b in zip(asked.column("__from").to_pylist(), asked.column("__to").to_pylist(), strict=True):
        if (a, b) not in known:
            lo, hi = np.searchsorted(number, [a, b])
            part = []
            for agg, cols, _ in named:
                x = [rows.column(f"__x_{c}").slice(lo, hi - lo).combine_chunks() for c in cols]
                ok = np.logical_and.reduce([np.asarray(c.is_valid()) for c in x]) if x else np.ones(hi - lo, dtype=bool)
                x = [np.asarray(c.fill_null(0.0))[ok] for c in x] or [np.empty(hi - lo)]
                part.append(list(agg.lift(*x)) if ok.any() else None)
            known[a, b] = part
        got.append(known[a, b])
    named_states = [pa.array([g[k] for g in got], pa.list_(pa.float64())) for k in range(len(named))]
    return pa.Table.from_arrays([*(asked.column(c) for c in outs), *named_states], names=[*outs, *(f"__s{k}" for k in range(len(named)))])


def emitted(df: DataFrame, order: Order, make, columns: list[str], what: What, time_name: str, block: int | None = None) -> DataFrame:
    """Groups, the time of the row that emitted the window, and its values, one row a window.

    The emitter sees a group's rows in order. Rows are then dealt by blocks of row numbers, each once; windows ask the blocks they
    touch for the state of their piece, so a row in many windows is copied for none. A window without rows has null values.
    """
    block = block or BLOCK
    groups = list(order.groups)
    read = list(dict.fromkeys(c for _, cols, _ in what.values() for c in cols))
    df = df.select(*dict.fromkeys([*order.columns, *read, *columns]), order.tick(df).cast("double").alias("__tick"))
    df = scan(df, order, [Node(lambda: Emitting(make, len(columns)), [*columns, "__tick"], ["__row", "__first", "__end"])])
    df = df.filter("__row is not null").withColumns({c: F.col(c).cast("long") for c in ("__row", "__first", "__end")})
    dealt = {f"__g{k}": F.col(g) for k, g in enumerate(groups)}  # names of one side, as columns of both must not clash
    rows = df.select(*(c.alias(n) for n, c in dealt.items()), F.floor(F.col("__row") / block).alias("__block"), "__row", *(F.col(c).cast("double").alias(f"__x_{c}") for c in read))
    windows = df.filter("__first is not null").select(*groups, F.col(order.time).alias(time_name), F.col("__row").alias("__id"), "__first", "__end")
    last = F.greatest(F.floor((F.col("__end") - 1) / block), F.floor(F.col("__first") / block))
    asked = windows.withColumn("__block", F.explode(F.sequence(F.floor(F.col("__first") / block), last)))
    asked = asked.select(*groups, "__id", time_name, "__block", F.greatest("__first", F.col("__block") * block).alias("__from"), F.least("__end", (F.col("__block") + 1) * block).alias("__to"))
    named = list(what.values())
    outs = [*groups, "__id", time_name, "__block"]
    kinds = {f.name: f for f in asked.schema.fields}
    schema = StructType([*(kinds[c] for c in outs), *StructType.fromDDL(", ".join(f"`__s{k}` array<double>" for k in range(len(named)))).fields])

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _pieces(key, left, right, groups, named, outs)

    parts = rows.groupBy(*dealt, "__block").cogroup(asked.groupBy(*groups, "__block")).applyInArrow(run, schema)
    return finished(parts, [*groups, "__id", time_name], ["__block"], what).drop("__id")

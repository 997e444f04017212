"""Aggregators of a window's rows; each is a grouped aggregate with a partial step before the shuffle.

A row with a null in any input that an output is made of is as if it were not there, for first and last values as for sums;
rows alone are counted with their nulls. Where no row is left the output is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalar import TINY, ieee_div, ieee_ln
from .frames import Order
from .scan import group_key, runs


def together(*cols: str) -> list[Column]:
    """The columns, null where any of them is."""
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    return [F.when(whole, F.col(c)) for c in cols]


def _ends(p: str, seq: Column) -> tuple[Column, Column]:
    at = F.when(F.col(p).isNotNull(), seq)
    return F.min_by(p, at), F.max_by(p, at)


def _ohlc(seq: Column, p: str) -> list[Column]:
    first, last = _ends(p, seq)
    return [first, F.max(p), F.min(p), last]


def _stddev(seq: Column, *cols: str, ddof: int = 1) -> list[Column]:
    """Deviation dividing by n - ddof; 0 for one row."""

    def one(c: str) -> Column:
        n = F.count(c)
        if ddof == 1:
            return F.when(n > 0, F.coalesce(F.stddev_samp(c), F.lit(0.0)))
        if ddof == 0:
            return F.stddev_pop(c)
        return F.when(n > max(1, ddof), F.sqrt(F.var_pop(c) * n / F.greatest(n - ddof, F.lit(1)))).when(n > 0, 0.0)

    return [one(c) for c in cols]


def _vwap(seq: Column, p: str, v: str) -> list[Column]:
    price, volume = together(p, v)
    s = F.sum(volume)
    return [F.when(F.abs(s) < TINY, F.lit(0.0)).otherwise(F.sum(price * volume) / s)]


def _avg_weighted(seq: Column, x: str, w: str) -> list[Column]:
    value, weight = together(x, w)
    s = F.sum(weight)
    return [F.when(s != 0, F.sum(value * weight) / s).when(s.isNotNull(), float("nan"))]


def _simple_return(seq: Column, p: str) -> list[Column]:
    first, last = _ends(p, seq)
    return [ieee_div(last - first, first)]


def _log_return(seq: Column, p: str) -> list[Column]:
    first, last = _ends(p, seq)
    return [ieee_ln(ieee_div(last, first))]


def _order_flow(seq: Column, buy: str, sell: str) -> list[Column]:
    b, s = together(buy, sell)
    return [F.sum(b) - F.sum(s)]


def _book_imba(seq: Column, bid: str, ask: str) -> list[Column]:
    b, a = (F.sum(c) for c in together(bid, ask))
    return [ieee_div(b - a, b + a)]


#: name: (number of columns, None for any; output names or None for one a column; columns from the row order and inputs)
AGGREGATORS: dict[str, tuple[int | None, tuple[str, ...] | None, Callable[..., list[Column]]]] = {
    "count": (0, ("count",), lambda seq: [F.count("*").cast("double")]),
    "sum": (None, None, lambda seq, *c: [F.sum(x) for x in c]),
    "avg": (None, None, lambda seq, *c: [F.avg(x) for x in c]),
    "stddev": (None, None, _stddev),
    "ohlc": (1, ("open", "high", "low", "close"), _ohlc),
    "vwap": (2, ("vwap",), _vwap),
    "simple_return": (1, ("simple_return",), _simple_return),
    "log_return": (1, ("log_return",), _log_return),
    "order_flow": (2, ("order_flow",), _order_flow),
    "book_imba": (2, ("book_imba",), _book_imba),
    "avg_weighted": (2, ("avg_weighted",), _avg_weighted),
}


class Mergeable:
    """An aggregator by parts, for users and for streams: rows become a state, states are merged, the last one gives the values.

    lift() gets rows in order as arrays, without rows that hold a null, and returns a state: a tuple of doubles of a fixed
    length. merge() puts two states together, the first one's rows before the second's; finish() gives the values.
    Unless `ordered`, states may be merged in any order. Windows of any size need the memory of a batch and of a state.
    """

    outputs: tuple[str, ...] = ("value",)
    ordered = False

    def lift(self, *x: np.ndarray) -> tuple[float, ...]:
        raise NotImplementedError

    def merge(self, a: tuple[float, ...], b: tuple[float, ...]) -> tuple[float, ...]:
        raise NotImplementedError

    def finish(self, state: tuple[float, ...]) -> tuple[float, ...]:
        raise NotImplementedError


class Parts(Mergeable):
    """A built-in aggregator by parts: each part of its state by how it is merged, and the values."""

    ordered = True
    _MERGE = {"first": lambda a, b: a, "last": lambda a, b: b, "add": lambda a, b: a + b, "max": np.maximum, "min": np.minimum}

    def __init__(self, kinds: tuple[str, ...], lift: Callable, finish: Callable):
        self.kinds, self._lift, self._finish = kinds, lift, finish

    def lift(self, *x):
        with np.errstate(all="ignore"):
            return tuple(float(v) for v in self._lift(*x))

    def merge(self, a, b):
        return tuple(float(self._MERGE[k](u, v)) for k, u, v in zip(self.kinds, a, b, strict=True))

    def finish(self, state):
        with np.errstate(all="ignore"):
            return tuple(float(v) for v in self._finish(*map(np.float64, state)))


class _Deviation(Mergeable):
    """Number, mean and squared deviations; the deviation divides by n - ddof, 0 for one row."""

    def __init__(self, ddof: int = 1):
        self.ddof = ddof

    def lift(self, x):
        return float(len(x)), float(x.mean()), float(((x - x.mean()) ** 2).sum())

    def merge(self, a, b):
        n, d = a[0] + b[0], b[1] - a[1]
        return n, a[1] + d * b[0] / n, a[2] + b[2] + d * d * a[0] * b[0] / n

    def finish(self, state):
        n, _, m2 = state
        return ((m2 / (n - self.ddof)) ** 0.5 if n > max(1, self.ddof) else 0.0,)


def _return(ratio: Callable) -> Parts:
    return Parts(("first", "last"), lambda x: (x[0], x[-1]), lambda a, b: (ratio(a + 0.0, b),))  # a negative zero counts as zero


def by_parts(name: str, **options: object) -> Mergeable:
    """A built-in aggregator by parts; those of any number of columns work on one."""
    sums, weighted = ("add", "add"), lambda none: Parts(("add", "add"), lambda x, w: ((x * w).sum(), w.sum()), lambda s, w: (none(w) if none(w) is not None else s / w,))
    made: dict[str, Callable[[], Mergeable]] = {
        "count": lambda: Parts(("add",), lambda *x: (len(x[0]),), lambda n: (n,)),
        "sum": lambda: Parts(("add",), lambda x: (x.sum(),), lambda s: (s,)),
        "avg": lambda: Parts(sums, lambda x: (len(x), x.sum()), lambda n, s: (s / n,)),
        "stddev": lambda: _Deviation(**options),
        "ohlc": lambda: Parts(("first", "max", "min", "last"), lambda x: (x[0], x.max(), x.min(), x[-1]), lambda *s: s),
        "simple_return": lambda: _return(lambda a, b: (b - a) / a),
        "log_return": lambda: _return(lambda a, b: np.log(b / a)),
        "vwap": lambda: weighted(lambda w: 0.0 if abs(w) < TINY else None),
        "avg_weighted": lambda: weighted(lambda w: np.nan if w == 0 else None),
        "order_flow": lambda: Parts(sums, lambda a, b: (a.sum(), b.sum()), lambda a, b: (a - b,)),
        "book_imba": lambda: Parts(sums, lambda a, b: (a.sum(), b.sum()), lambda a, b: ((a - b) / (a + b),)),
    }
    out = made[name]()
    out.outputs = AGGREGATORS[name][1] or (name,)
    return out


What = dict[str, tuple[Mergeable, list[str], list[str]]]  #: by name: aggregator, columns, outputs


def states(df: DataFrame, order: Order, ids: list[str], what: What) -> DataFrame:
    """One row a window (by the columns `ids`) and partition: the order's keys of its first row and a state of each aggregator.

    Each partition is sorted by window and order and its rows become one state a window before anything is shuffled, so a window
    that holds all rows is a state a partition. Ordered aggregators need partitions that are ranges of the order.
    """
    columns = list(dict.fromkeys(c for _, cols, _ in what.values() for c in cols))
    keys = [k for k in order.keys if k not in ids]
    df = df.select(*ids, *keys, *(F.col(c).cast("double").alias(f"__{c}") for c in columns))
    if any(a.ordered for a, _, _ in what.values()):
        df = df.repartitionByRange(*order.groups, *order.keys)
    named = list(what.values())

    def lift(batch: pa.RecordBatch, a: int, b: int) -> list:
        out = []
        for agg, cols, _ in named:
            x = [batch.column(f"__{c}").slice(a, b - a) for c in cols]
            ok = np.logical_and.reduce([np.asarray(c.is_valid()) for c in x]) if x else np.ones(b - a, dtype=bool)
            x = [np.asarray(c.fill_null(0.0))[ok] for c in x] or [np.empty(b - a)]
            out.append(agg.lift(*x) if ok.any() else None)
        return out

    return df.sortWithinPartitions(*ids, *keys).mapInArrow(lambda batches: _fold_runs(batches, ids, keys, lift, named, [*ids, *keys]), _states_schema(df, [*ids, *keys], named))


def _states_schema(df: DataFrame, head: list[str], named: list) -> StructType:
    kinds = {f.name: f for f in df.schema.fields}
    return StructType([*(kinds[c] for c in head), *StructType.fromDDL(", ".join(f"`__s{k}` array<double>" for k in range(len(named)))).fields])


def _read(named: list) -> Callable[[pa.RecordBatch, int, int], list]:
    def read(batch: pa.RecordBatch, a: int, b: int) -> list:
        out = []
        for k, (agg, _, _) in enumerate(named):
            state = None
            for row in batch.column(f"__s{k}").slice(a, b - a).to_pylist():
                state = _put(agg, state, None if row is None else tuple(row))
            out.append(state)
        return out

    return read


def combined(parts: DataFrame, ids: list[str], keys: list[str], what: What) -> DataFrame:
    """States of the same window put together in the order of `keys`."""
    named = list(what.values())
    dealt = parts.repartition(*ids).sortWithinPartitions(*ids, *keys)
    return dealt.mapInArrow(lambda batches: _fold_runs(batches, ids, keys, _read(named), named, [*ids, *keys]), _states_schema(parts, [*ids, *keys], named))


def finished(parts: DataFrame, ids: list[str], keys: list[str], what: What) -> DataFrame:
    """One row a window: `ids` and the aggregators' values, of states put together in the order of `keys`. Where an aggregator
    has no row without a null, its values are null."""
    named = list(what.values())
    outs = [n for _, _, names in named for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _fold_runs(batches, ids, keys, _read(named), named, list(ids)):
            got: list[list] = [[] for _ in outs]
            for row in zip(*(batch.column(f"__s{k}").to_pylist() for k in range(len(named))), strict=True):
                flat = [v for (agg, _, names), state in zip(named, row, strict=True) for v in (agg.finish(tuple(state)) if state is not None else [None] * len(names))]
                for column, v in zip(got, flat, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ids), *(pa.array(c, pa.float64()) for c in got)], [*ids, *outs])

    kinds = {f.name: f for f in parts.schema.fields}
    schema = StructType([*(kinds[c] for c in ids), *StructType.fromDDL(", ".join(f"`{n}` double" for n in outs)).fields])
    return parts.repartition(*ids).sortWithinPartitions(*ids, *keys).mapInArrow(run, schema)


def merged(df: DataFrame, order: Order, ids: list[str], what: What) -> DataFrame:
    """One row a window, by the columns `ids`, and the values of mergeable aggregators."""
    keys = [k for k in order.keys if k not in ids]
    return finished(states(df, order, ids, what), ids, keys, what)


def _put(agg: Mergeable, a: tuple | None, b: tuple | None) -> tuple | None:
    return b if a is None else a if b is None else agg.merge(a, b)


def _fold_runs(batches: Iterator[pa.RecordBatch], ids: list[str], keys: list[str], lift: Callable[[pa.RecordBatch, int, int], list], named: list, head: list[str]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by `ids`: the columns `head` of each run's first row and its states, put together across batches."""
    held: tuple | None = None  # first row, key, states

    def ready(done: list[tuple]) -> pa.RecordBatch:
        rows = pa.concat_batches([d[0] for d in done])
        states = [pa.array([d[2][k] for d in done], pa.list_(pa.float64())) for k in range(len(named))]
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in head), *states], [*head, *(f"__s{k}" for k in range(len(named)))])

    for batch in batches:
        done: list[tuple] = []
        for a, b in runs(batch, ids) if batch.num_rows else ():
            key, states = group_key(batch, ids, a), lift(batch, a, b)
            if held is not None and held[1] == key:
                held = held[0], key, [_put(agg, s, t) for (agg, _, _), s, t in zip(named, held[2], states, strict=True)]
                continue
            if held is not None:
                done.append(held)
            held = batch.slice(a, 1), key, states
        if done:
            yield ready(done)
    if held is not None:
        yield ready([held])


def python_aggregate(f: Callable[..., float], columns_read: int) -> Callable[..., list[Column]]:
    """A user's function of a window's columns, as numpy arrays in row order. It needs a window's rows at once; an aggregator that
    can be put together from parts should be a Mergeable."""

    def make(seq: Column, *cols: str) -> list[Column]:
        if len(cols) != columns_read:
            raise ValueError(f"the aggregate reads {columns_read} columns, not {len(cols)}")

        @F.pandas_udf("double")
        def run(rows: pd.DataFrame) -> pd.Series:
            return pd.Series([float(f(*(np.asarray(r[c], dtype=np.float64) for c in rows.columns))) for r in rows.to_dict("records")], index=rows.index, dtype="float64")

        ordered = F.sort_array(F.collect_list(F.struct(seq.alias("seq"), *(F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)))))
        return [run(F.struct(*(ordered.getField(f"c{k}").alias(f"c{k}") for k in range(len(cols)))))]

    return make


def outputs(name: str, cols: list[str]) -> list[str]:
    if name not in AGGREGATORS:
        raise ValueError(f"unknown aggregator {name!r}")
    n, names, _ = AGGREGATORS[name]
    if n is not None and len(cols) != n:
        raise ValueError(f"{name} reads {n} columns, not {len(cols)}")
    if n is None and not cols:
        raise ValueError(f"{name} reads one column at least")
    return list(names) if names else [f"{name}_{c}" for c in cols]


def columns(name: str, seq: Column, cols: list[str], **options: object) -> list[Column]:
    return AGGREGATORS[name][2](seq, *cols, **options)

"""The same kernels, graphs, windows and pipelines over Structured Streaming.

A group's rows go through a chain of stages (see stages) in one stateful operator, whose state is that of the kernels and of the
open windows by parts, and never a window's rows. Rows are taken as they come, or, given how late they may come, held until
the watermark has passed them and taken in order; timers then end windows that no row ends.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators import aggs
from ..operators.frames import Order
from ..operators.scan import IS_ROW, Columns, Node, outputs_of, read_columns
from ..plans.graph import Graph, TumbleGraph
from .sorting import in_order
from .stages import TICK, Aggregates, Chain, Functors, Given, Rows, Trigger, Windows

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Columns that travel have names of their own, since others may not do as fields of a row in Python; this is the time.
AT = "tw_at"
#: Types whose nulls pandas would turn into floats; they travel as a value and a flag.
GUARDED = ("byte", "short", "integer", "long", "float", "double", "boolean")


class _Run(StatefulProcessor):
    """Feeds a group's rows to its chain. `keys` are the columns to sort by, `carried` those to hand on with each row."""

    def __init__(self, chain: Chain, read: list[str], keys: list[str], carried: list[str], outs: list[str], window: bool, groups: list[str], held: bool):
        self.fresh = cloudpickle.dumps(chain)
        self.read, self.keys, self.carried, self.outs, self.window, self.groups, self.held = read, keys, carried, outs, window, groups, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("chain", "chain binary")
        self.waiting = handle.getListState("waiting", "rows binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.held:
            chain = self._chain()
            for frame in in_order(rows, AT):
                yield from self._feed(key, chain, frame)
            self._keep(chain)
            return
        for frame in rows:
            self.waiting.appendValue((pickle.dumps(frame),))
        yield from self._release(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues.getCurrentWatermarkInMs())

    def _chain(self) -> Chain:
        return pickle.loads(self.state.get()[0] if self.state.exists() else self.fresh)

    def _keep(self, chain: Chain) -> None:
        self.state.update((cloudpickle.dumps(chain),))

    def _release(self, key: tuple, watermark: int) -> Iterator[pd.DataFrame]:
        """Takes the rows that the watermark has passed, ends the windows that it has passed, and asks to be called again."""
        chain, now = self._chain(), watermark * 1000
        early: list[pd.DataFrame] = []
        if self.waiting.exists():

            def ready() -> Iterator[pd.DataFrame]:
                for r in self.waiting.get():
                    frame = pickle.loads(r[0])
                    passed = frame[AT].to_numpy() <= now
                    if not passed.all():
                        early.append(frame[~passed])
                    if passed.any():
                        yield frame[passed]

            for frame in in_order(ready(), AT):
                yield from self._feed(key, chain, frame)
            if early:
                self.waiting.put([(pickle.dumps(frame),) for frame in early])
            else:
                self.waiting.clear()
        for data in chain.close(now):
            if len(data[TICK][0]):
                yield self._table(key, data)
        self._keep(chain)
        asked = {chain.due()} | ({int(min(f[AT].min() for f in early)), int(max(f[AT].max() for f in early))} if early else set())
        for at in asked - {None}:
            self.handle.registerTimer(max(int(-(-at // 1000)), watermark + 1))

    def _feed(self, key: tuple, chain: Chain, frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        at = frame[AT].to_numpy()
        if not (at[1:] > at[:-1]).all():
            by_time = np.argsort(at, kind="stable")
            frame = frame.iloc[by_time] if (np.diff(at[by_time]) > 0).all() else frame.sort_values(self.keys, kind="stable")
        data: Columns = {TICK: (frame[AT].to_numpy(), None)}
        for k, c in enumerate(self.read):
            ok = frame[f"tw_ok{k}"].to_numpy(dtype=bool)
            data[c] = frame[f"tw_x{k}"].to_numpy(dtype=np.float64), None if ok.all() else ok
        out = chain.feed(data)
        if IS_ROW in data:
            frame = frame[data[IS_ROW][0] > 0]
        if len(out[TICK][0]):
            yield self._table(key, out, frame)

    def _table(self, key: tuple, data: Columns, frame: pd.DataFrame | None = None) -> pd.DataFrame:
        columns: dict[str, Any] = {}
        if self.carried:
            columns = {c: frame[c].to_numpy() for c in self.carried}
        else:
            columns = {f"tw_g{k}": pd.Series([v] * len(data[TICK][0]), dtype=object if v is None else None) for k, v in enumerate(key)} | {AT: data[TICK][0]}
            if self.window:
                columns["tw_window"] = data["__window"][0]
        for k, n in enumerate(self.outs):
            x, ok = data[n]
            flag = np.where(np.isnan(x), 2, 0) if ok is None else np.where(~ok, 1, np.where(np.isnan(x), 2, 0))
            columns |= {f"tw_y{k}": np.where(flag == 0, x, 0.0), f"tw_f{k}": flag.astype(np.int32)}
        return pd.DataFrame(columns)


def _outputs(names: list[str]) -> list[Column]:
    return [F.when(F.col(f"tw_f{k}") == 0, F.col(f"tw_y{k}")).when(F.col(f"tw_f{k}") == 2, F.lit(float("nan"))).alias(n) for k, n in enumerate(names)]


def _ready(df: DataFrame, order: Order, read: list[str], late: str | None) -> tuple[DataFrame, list[str], str]:
    """The stream with the time as a number, the columns to read as values and flags, and columns to sort by."""
    spark = df.sparkSession
    if spark.conf.get(PROVIDER) != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)
    if late is not None:
        df = df.withWatermark(order.time, late)
    timed = df.schema[order.time].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")
    if late is not None and not timed:
        raise ValueError("only a stream whose time is a timestamp has rows that are late")
    tick = "long" if timed else "double"
    new = {AT: order.tick(df).cast(tick)}
    for k, c in enumerate(read):
        if c != TICK:
            new |= {f"tw_x{k}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)), f"tw_ok{k}": F.col(c).isNotNull()}
    keys = [AT]
    for k, c in enumerate(order.ties):
        kind = df.schema[c].dataType
        new |= {f"tw_has{k}": F.col(c).isNotNull(), f"tw_tie{k}": F.coalesce(F.col(c), F.lit(0).cast(kind)) if kind.typeName() in GUARDED else F.col(c)}
        keys += [f"tw_has{k}", f"tw_tie{k}"]
    new |= {f"tw_k{k}": F.col(g) for k, g in enumerate(order.groups)}
    return df.withColumns(new), keys, tick


def _run(df: DataFrame, order: Order, processor: _Run, schema: StructType, late: str | None) -> DataFrame:
    """The processor over the columns it needs, and the time for the watermark."""
    keys = [f"tw_k{k}" for k in range(len(order.groups))]
    df = df.select(*keys, *dict.fromkeys([*(c for c in df.columns if c.startswith("tw_") and c not in keys), *([] if late is None or processor.carried else [order.time])]))
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "None" if late is None else "EventTime")


def stream_scan(df: DataFrame, order: Order, nodes: list[Node], late: str | None = None, given: dict[str, str] | None = None) -> DataFrame:
    """Adds the outputs of kernels to a stream; each group's kernels live in its state between micro-batches.

    Without `late` a group's rows of a micro-batch are taken in the order's sequence, and those of a later micro-batch come
    after those of an earlier one: the source must deliver groups in order. With `late`, how far behind the newest time a row
    may come (a watermark; later rows are dropped by Spark), a group's rows wait in its state until the watermark has passed
    them, and are taken in order whatever the order they came in. A group's rows of one micro-batch are sorted by runs in files
    where they are many (see sorting), so they may be more than memory holds; those that are not yet due are held at once: bound
    them by `late`.

    All columns come out as they were, whole numbers exactly; times must lie between 1678 and 2261. Nulls and NaN are as in
    scan(). Where the query stops and starts again, kernels go on from the state in its checkpoint. The session's state
    store is set to RocksDB, which stateful processors need.

    With `given` there are versions of parameters among the rows (see scan.among): columns of theirs, by the names that nodes read
    their values under.
    """
    made, schema = outputs_of(nodes, df)
    read = [c for c in read_columns(nodes) if c != TICK and c not in (given or {}).values()]
    if given:
        read += [IS_ROW, *given]
        order = Order(order.groups, order.time, (IS_ROW, *order.ties))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    held = [c for c in df.columns if c != TICK and c not in (given or ())]
    guard = {c: f"tw_v{k}" for k, c in enumerate(held)}
    ready, keys, _ = _ready(df, order, read, late)
    out, flags = StructType(), {}
    for k, c in enumerate(held):
        out = out.add(guard[c], kinds[c])
        if kinds[c].typeName() in GUARDED:
            flags[c] = f"tw_n{k}"
            out = out.add(flags[c], "boolean")
    ready = ready.withColumns({guard[c]: F.coalesce(F.col(c), F.lit(0).cast(kinds[c])) if c in flags else F.col(c) for c in held} | {n: F.col(c).isNull() for c, n in flags.items()})
    carried = [f.name for f in out.fields]
    for k in range(len(made)):
        out = out.add(f"tw_y{k}", "double").add(f"tw_f{k}", "integer")
    rows = _run(ready, order, _Run(Chain([*([Given(given)] if given else []), Rows(nodes)]), read, keys, carried, made, False, list(order.groups), late is not None), out, late)

    def whole(c: str) -> Column:
        v = F.col(guard[c])
        if c in flags:
            v = F.coalesce(v, F.lit(float("nan")).cast(kinds[c])) if kinds[c].typeName() in ("float", "double") else v
            v = F.when(~F.col(flags[c]), v)
        return v.alias(c)

    out = rows.select(*(whole(c) for c in held), *_outputs(made))
    return out.withColumn(TICK, order.tick(out).cast("double")) if TICK in df.columns else out


def _windows(df: DataFrame, order: Order, chain: Chain, read: list[str], outs: list[str], names: list[str], late: str | None, time_name: str | None) -> DataFrame:
    """A chain whose rows are no longer the stream's: groups, the time, the window's time (time_name) and the outputs."""
    ready, keys, tick = _ready(df, order, read, late)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = StructType()
    for k, g in enumerate(order.groups):
        out = out.add(f"tw_g{k}", kinds[g])
    out = out.add(AT, tick)
    out = out.add("tw_window", tick) if time_name else out
    for k in range(len(outs)):
        out = out.add(f"tw_y{k}", "double").add(f"tw_f{k}", "integer")
    processor = _Run(chain, read, keys, [], outs, time_name is not None, list(order.groups), late is not None)
    rows = _run(ready, order, processor, out, late)
    kind = kinds[order.time]
    stamp = lambda c: F.timestamp_micros(F.col(c)).cast(kind) if tick == "long" else F.col(c).cast(kind)
    return rows.select(*(F.col(f"tw_g{k}").alias(g) for k, g in enumerate(order.groups)), stamp(AT).alias(order.time), *([stamp("tw_window").alias(time_name)] if time_name else []), *_outputs(names))


def _trigger(window: Callable) -> Trigger:
    if not hasattr(window, "on_stream"):
        raise ValueError("windows of a stream are tumbling, of a number of rows, sessions or cusum bars")
    return Trigger(*window.on_stream)


def stream_body(df: DataFrame, order: Order, window: Callable | tuple[str, Any], spec: list[tuple[list[str], aggs.Mergeable, list[str]]], late: str | None, time_name: str) -> DataFrame:
    """Ended windows with aggregators by parts: (output names, aggregator, columns)."""
    trigger = Trigger(*window) if isinstance(window, tuple) else _trigger(window)
    names = [n for into, _, _ in spec for n in into]
    read = list(dict.fromkeys([*(c for _, _, cols in spec for c in cols), *([trigger.column] if trigger.column else [])]))
    chain = Chain([Windows(trigger, Aggregates(spec), names)])
    return _windows(df, order, chain, read, names, names, late, time_name).drop(*([order.time] if order.time != time_name else []))


def stream_windows(df: DataFrame, order: Order, window: tuple[str, Any], spec: dict[str, tuple[str, list[str]]], late: str | None = None) -> DataFrame:
    """Ended windows of a stream, whatever ends them: ("counter", rows), ("session", gap), ("cusum", (threshold, column)) or
    ("tumbling", size). `spec` is {output prefix: (aggregator, columns)}.

    Windows and aggregates are those of the assigners and aggregators of the same name, nulls included. An open window is kept
    by parts, a few numbers whatever its rows. Rows are taken as stream_scan() says; with `late`, a window whose end the
    watermark has passed comes out though no later row has come.
    """
    parts = []
    for prefix, (name, cols) in spec.items():
        names = aggs.outputs(name, cols)
        into = [prefix if len(names) == 1 else f"{prefix}_{n}" for n in names]
        alone = aggs.AGGREGATORS[name][0] is None
        parts += [([n], aggs.by_parts(name), [c]) for n, c in zip(into, cols, strict=True)] if alone else [(into, aggs.by_parts(name), cols)]
    return stream_body(df, order, window, parts, late, "window_ts")


def stream_stages(df: DataFrame, order: Order, stages: list[Graph | TumbleGraph], late: str | None, time_name: str) -> DataFrame:
    """A pipeline's stages on a stream: each has kernels of its own, and a tumbling one hands a row on only where a window ends."""
    chain: list[Rows | Windows] = []
    read: list[str] = []
    names: list[str] | None = None
    for k, stage in enumerate(stages):
        g = stage if isinstance(stage, Graph) else stage.graph
        ports = g._ports[g._root]
        columns = {p: p for p in ports} if names is None else dict(zip(ports, names, strict=True))
        nodes, at = g.nodes(columns, f"__s{k}_")
        names = [f"__o{k}_{i}" for i in range(len(g._outputs))]
        pick = dict(zip(names, (at[e] for e in g._outputs), strict=True))
        if not k:
            read = list(dict.fromkeys(ports))
        if isinstance(stage, Graph):
            chain.append(Rows(nodes, pick))
        else:
            trigger = _trigger(g._trigger)
            trigger.column = columns.get(trigger.column)
            chain.append(Windows(trigger, Functors(nodes, pick), names))
    last = stages[-1]
    if all(isinstance(s, Graph) for s in stages):  # every row goes through, with the columns that order it
        nodes = [n for stage in chain for n in stage.nodes]
        found: dict[str, str] = {}
        for stage in chain:
            for n in stage.nodes:
                n.args = [found.get(a, a) for a in n.args]
            found = {new: found.get(old, old) for new, old in stage.pick.items()}
        rows = df.select(*dict.fromkeys(order.columns), *(F.col(c).cast("double").alias(c) for c in read if c not in order.columns), order.tick(df).cast("double").alias(TICK))
        out = stream_scan(rows, order, nodes, late)
        return out.select(*dict.fromkeys(order.columns), *(F.col(found[n]).alias(name) for n, name in zip(names, last.names(), strict=True)))
    return _windows(df, order, Chain(chain), read, names, last.names(), late, time_name if isinstance(last, TumbleGraph) else None)


def stream_bars(df: DataFrame, order: Order, size: str, late: str, spec: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Tumbling bars of a stream: {output prefix: (aggregator, columns)}; a bar is final once the watermark passes it.

    Rows later than `late` behind the newest time are dropped by Spark. window_ts is the bar's end.
    """
    out: list[Column] = []
    for prefix, (name, cols) in spec.items():
        names = aggs.outputs(name, cols)
        out += [c.alias(prefix if len(names) == 1 else f"{prefix}_{n}") for n, c in zip(names, aggs.columns(name, order.seq(), cols), strict=True)]
    grouped = df.withWatermark(order.time, late).groupBy(*order.groups, F.window(order.time, size).alias("_w")).agg(*out)
    return grouped.withColumn("window_ts", F.col("_w.end")).drop("_w")

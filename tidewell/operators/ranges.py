"""Kernels over groups of any size: rows are cut into ranges of equal size, and a range starts from the state the ranges before it leave.

A blocked prefix scan. Rows are dealt once by range of (group, order), sorted, and kept in the shared folder. A first
pass runs every range without what lies before it and returns what it did to each piece of the kernels' state, a few numbers;
the driver puts these together in order, one entry a range whatever the groups; a last pass runs every range from its true
start. Pieces that depend on others take a pass for each level (a variance needs the mean's start). So one group keeps all
cores busy, and no group is ever one task's work.

Row spans and row lags see rows, not state: rows are numbered by such a scan and dealt in blocks of row numbers, each with the last
rows of the block before it. Time spans of large groups are cut at quantiles of the rows' times.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import count
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder
from .carry import Guessed, Part
from .frames import Order
from .scan import Columns, Kernel, Node, RowNumber, advance, group_key, outputs_of, part_of, read_columns, replay, runs, scan, start, values

#: Estimated bytes of a table, and rows of its largest group, from which groups are cut.
LARGE_BYTES, LARGE_ROWS = 64 << 20, 1 << 22
#: Rows of a range, beyond which there are more ranges, so that a task's memory does not grow with the table.
RANGE_ROWS = 1 << 20
RANGE, BLOCK, OWN = "__range", "__block", "__own"
_fresh = count()
_asked: ContextVar[int | None] = ContextVar("ranges", default=None)

Starts = dict[int, dict[tuple[int, int], Any]]  #: by range: value of each (node, part)


def kept(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def width_of(spark: SparkSession) -> int:
    """Ranges that serve a cluster: two a core, or the shuffle partitions where these are more."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def cut_into(number: int | None) -> Iterator[None]:
    """Within it, groups are cut into `number` ranges where nothing else is said; 0: never, None: where they are large."""
    token = _asked.set(number)
    try:
        yield
    finally:
        _asked.reset(token)


def wanted(df: DataFrame, order: Order) -> int:
    """Number of ranges where a group is too large for one task, else 0: where the table is estimated at LARGE_BYTES, rows are
    counted by group, and some group has LARGE_ROWS and twice a core's share, or twice LARGE_ROWS; or what cut_into() says."""
    if (asked := _asked.get()) is not None:
        return asked
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < LARGE_BYTES:
        return 0
    most, rows = df.groupBy(*order.groups).count().agg(F.max("count"), F.sum("count")).first()
    number = max(width_of(df.sparkSession), -(-(rows or 0) // RANGE_ROWS))
    uneven = most and most * df.sparkSession.sparkContext.defaultParallelism > 2 * rows
    return number if most and (most >= 2 * LARGE_ROWS or most >= LARGE_ROWS and uneven) else 0


def can_carry(node: Node) -> bool:
    """Whether the node's kernel can go on from a cut: it names the pieces of its state, and no option is read from rows."""
    return not node.asked and getattr(made := node.start(lambda c: 0.0), "parts", lambda: None)() is not None and isinstance(made, Kernel)


def levels(nodes: list[Node]) -> tuple[list[list[int]], int]:
    """Absolute level of each node's parts, and the highest one: a node's first level lies above those of the nodes it reads."""
    made, out, depth = {}, [], []
    for k, node in enumerate(nodes):
        base = max((depth[made[a]] for a in node.args if a in made), default=0)
        own = [base + level for level, _ in node.start(lambda c: 0.0).parts()]
        out.append(own)
        depth.append(max(own, default=base))
        made |= dict.fromkeys(node.names, k)
    return out, max(depth, default=0)


def _parts(kernels: list[Kernel]) -> dict[tuple[int, int], Part]:
    return {(k, i): part for k, kernel in enumerate(kernels) for i, (_, part) in enumerate(kernel.parts())}


def _started(nodes: list[Node], data: Columns, given: dict[tuple[int, int], Any]) -> list[Kernel]:
    kernels = start(nodes, data)
    parts = _parts(kernels)
    for at, value in given.items():
        if value is not None:
            parts[at].set(value)
    return kernels


def _summary(batches: Iterator[pa.RecordBatch], nodes: list[Node], groups: list[str], level: list[list[int]], now: int, starts: Starts) -> Iterator[pa.RecordBatch]:
    """Of a range: its first and last group, what it did to the first group's parts of level `now`, the last group's state, and its
    number of rows."""
    read = read_columns(nodes)
    here = lambda parts: {at: p for at, p in parts.items() if level[at[0]][at[1]] == now}
    first = last = own = None
    rows = 0
    kernels: list[Kernel] = []
    changes: dict = {}
    for batch in batches:
        whole = values(batch, read)
        rows += batch.num_rows
        for a, b in runs(batch, groups) if batch.num_rows else ():
            data, key = part_of(whole, a, b), group_key(batch, groups, a)
            if key != last:
                if last is not None and not changes:
                    changes = {"done": {at: p.change() for at, p in here(_parts(kernels)).items()}}
                if last is None:
                    own, first = batch.column(RANGE)[0].as_py(), key
                # a part of this level starts cold; those below it from what is known
                given = {at: v for at, v in starts.get(own, {}).items() if level[at[0]][at[1]] < now} if last is None else {}
                kernels, last = _started(nodes, data, given), key
            advance(nodes, kernels, data, b - a)
    if last is not None:
        parts = here(_parts(kernels))
        alone = not changes
        got = {at: p.change() for at, p in parts.items()} if alone else changes["done"]
        state = None if alone else {at: p.get() for at, p in parts.items()}
        yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([cloudpickle.dumps((first, last, got, state, rows))], pa.binary())], ["at", "did"])


def _retry(batches: Iterator[pa.RecordBatch], nodes: list[Node], groups: list[str], guessed: list[tuple[int, int]], starts: Starts, level: list[list[int]], now: int) -> Iterator[pa.RecordBatch]:
    """Runs a range's only group from the start that was found, beside the run from the guess, until both meet; and what that did."""
    read = read_columns(nodes)
    pair: list[list[Kernel]] = []
    own, rows, met = None, 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        data = values(batch, read)
        if own is None:
            own = batch.column(RANGE)[0].as_py()
            given = starts[own]
            below = {at: v for at, v in given.items() if level[at[0]][at[1]] < now}
            pair = [_started(nodes, data, below), _started(nodes, data, below | {at: (given[at][0], 0) for at in guessed if given.get(at) is not None})]
        for kernels in pair:
            advance(nodes, kernels, dict(data), batch.num_rows)
        rows += batch.num_rows
        cold, true = (_parts(k) for k in pair)
        if met := all(cold[at].get()[0] == true[at].get()[0] for at in guessed):
            break
    if own is not None:
        found = {at: (starts[own][at][0], true[at].get()[0], true[at].get()[1], cold[at].get()[1]) for at in guessed if starts[own].get(at) is not None}
        yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([cloudpickle.dumps((met, rows, found))], pa.binary())], ["at", "did"])


def _prefix(summaries: dict[int, list], starts: Starts, kinds: dict[tuple[int, int], type[Part]]) -> set[int]:
    """Sets the starts of the parts at hand; returns the ranges whose end depends on a start that was not tried."""
    key, state, untried = object(), {}, set()
    for r in sorted(summaries):
        first, last, changes, ends, _ = summaries[r]
        begin = state if first == key else {}
        starts.setdefault(r, {}).update({at: begin.get(at) for at in changes})
        if ends is None:
            state = {}
            for at, change in changes.items():
                state[at] = kinds[at].after(begin.get(at), change)
                if state[at] is None and issubclass(kinds[at], Guessed):
                    untried.add(r)  # the guess's end stands in for it, to be tried in the next range
                    end, more = next(iter(change.values()))
                    state[at] = end, begin[at][1] + more
        else:
            state = ends
        key = last
    return untried


def scan_ranges(df: DataFrame, order: Order, nodes: list[Node], number: int, report: dict | None = None) -> DataFrame:
    """scan() with groups cut into `number` ranges in all. Every node must be able to carry (can_carry).

    Results are those of scan() but for the rounding of sums that are put together. Runs jobs at once, since
    starts must be known before a plan can use them; they are at most `number` entries of a few numbers each (scan.CARRIED rows at most
    for a kernel that keeps rows), which go to all tasks. Where a start has to be guessed (cusum), ranges that began elsewhere are run again from there, just
    until both runs meet. `report` gets rows, ranges, passes, and the ranges and rows that were run again.
    """
    _, schema = outputs_of(nodes, df)
    groups, held = list(order.groups), list(df.columns)
    keys = [*groups, *order.keys]
    cut = kept(df.repartitionByRange(number, *keys).sortWithinPartitions(*keys).withColumn(RANGE, F.spark_partition_id()))
    level, top = levels(nodes)
    kinds = {(k, i): type(p) for k, node in enumerate(nodes) for i, (_, p) in enumerate(node.start(lambda c: 0.0).parts())}
    need = cut.select(*dict.fromkeys([*groups, *read_columns(nodes), RANGE]))
    starts: Starts = {}
    again = rerun = summed = unmet = rows_read = 0
    for now in range(1, top + 1):
        if not any(now in own for own in level):
            continue
        given = {r: dict(s) for r, s in starts.items()}
        got = need.mapInArrow(lambda b, now=now, given=given: _summary(b, nodes, groups, level, now, given), "at int, did binary").collect()
        summaries = {r.at: list(pickle.loads(r.did)) for r in got}
        summed, rows_read = summed + 1, sum(s[4] for s in summaries.values())
        guessed = [at for at, kind in kinds.items() if level[at[0]][at[1]] == now and issubclass(kind, Guessed)]
        while untried := _prefix(summaries, starts, kinds):
            given = {r: dict(starts[r]) for r in untried}
            some = need.filter(F.col(RANGE).isin(sorted(untried)))
            for r in some.mapInArrow(lambda b, now=now, given=given: _retry(b, nodes, groups, guessed, given, level, now), "at int, did binary").collect():
                met, rows, found = pickle.loads(r.did)
                for at, (state, end, true, cold) in found.items():
                    change = summaries[r.at][2][at]
                    first_end, first_count = next(iter(change.values()))
                    change[state] = (first_end, first_count + true - cold) if met else (end, true)
                again, rerun, unmet = again + 1, rerun + rows, unmet + (not met)
    if report is not None:
        report |= {"rows": rows_read, "ranges": number, "passes": summed + 1, "ranges_again": again, "rows_again": rerun, "never_met": unmet}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def begin(batch: pa.RecordBatch, data: Columns, first: bool) -> list[Kernel]:
            return _started(nodes, data, starts.get(batch.column(RANGE)[0].as_py(), {}) if first else {})

        return replay(batches, nodes, groups, held, begin)

    return cut.mapInArrow(run, schema)


def numbered(df: DataFrame, order: Order, number: int, name: str, report: dict | None = None) -> DataFrame:
    """Adds each row's number in its group, from 0, without a window over the group."""
    return scan_ranges(df, order, [Node(RowNumber, [], [name])], number, report).withColumn(name, F.col(name).cast("long"))


def scan_blocks(df: DataFrame, order: Order, nodes: list[Node], own: Column, last: Column, number: int) -> DataFrame:
    """scan() in blocks of each group: a row belongs to block `own`, and the blocks up to `last` read it too."""
    df = df.withColumn(OWN, own).withColumn(BLOCK, F.explode(F.sequence(F.col(OWN), last)))
    out = scan(df, Order((*order.groups, BLOCK), order.time, order.ties), nodes, number=4 * number)  # few tasks get several blocks
    return out.filter(F.col(BLOCK) == F.col(OWN)).drop(BLOCK, OWN)


def reach(nodes: list[Node], width: dict[str, float]) -> float:
    """How far nodes look back when they read one another: the largest sum of widths, by first output name, along a path."""
    far: dict[str, float] = {}
    for node in nodes:
        back = width[node.names[0]] + max((far.get(a, 0.0) for a in node.args), default=0.0)
        far |= dict.fromkeys(node.names, back)
    return max(far.values(), default=0.0)


def scan_rows(df: DataFrame, order: Order, nodes: list[Node], back: int, number: int) -> DataFrame:
    """scan() of nodes that look `back` rows back at most: in blocks of row numbers, of four times `back` rows or more."""
    row, report = f"__row{next(_fresh)}", {}
    df = numbered(df, order, number, row, report)
    size = max(4 * back, -(-report["rows"] // number), 1)
    n = F.col(row)
    return scan_blocks(df, order, nodes, F.floor(n / size), F.floor((n + back) / size), number).drop(row)


def scan_times(df: DataFrame, order: Order, nodes: list[Node], tick: str, back: float, number: int) -> DataFrame:
    """scan() of nodes that look less than `back` back in `tick`: groups with more than one in `number` of all rows are cut at
    quantiles of their rows' times, four times `back` apart or more; there are at most 2 `number` such cuts in all."""
    sizes = df.groupBy(*order.groups).agg(F.count("*").alias("__n"))
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    spark = df.sparkSession
    same = lambda a, b: [F.col(f"{a}.{g}").eqNullSafe(F.col(f"{b}.{g}")) for g in order.groups]
    heavy = spark.createDataFrame(sizes.filter(F.col("__n") * number > total).collect(), sizes.schema)  # `number` rows at most
    fine = min(1024, number)
    marks = [k / fine for k in range(1, fine)]
    found = df.alias("d").join(F.broadcast(heavy).alias("h"), same("d", "h")).groupBy(*(f"d.{g}" for g in order.groups)).agg(F.first("__n").alias("__n"), F.percentile_approx(tick, marks, 10_000).alias("__at"))
    rows = []
    for r in found.collect():
        pieces = min(fine, -(-r["__n"] * number // max(total, 1)))
        chosen: list[float] = []
        for k in range(1, pieces):
            at = float(r["__at"][round(fine * k / pieces) - 1])
            if not chosen or at >= chosen[-1] + 4 * back:
                chosen.append(at)
        rows.append((*(r[g] for g in order.groups), chosen))
    schema = ", ".join([*(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in order.groups), "__cuts array<double>"])
    cuts = spark.createDataFrame(rows, schema)
    df = df.alias("d").join(F.broadcast(cuts).alias("c"), same("d", "c"), "left").select("d.*", F.coalesce("__cuts", F.array().cast("array<double>")).alias("__cuts"))
    own = F.size(F.filter("__cuts", lambda c: c <= F.col(tick)))
    last = F.size(F.filter("__cuts", lambda c: c < F.col(tick) + back))
    return scan_blocks(df, order, nodes, own, F.greatest(last, F.col(OWN)), number).drop("__cuts")

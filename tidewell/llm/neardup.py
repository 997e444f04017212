"""Near-duplicate embeddings by an epsilon grid order join."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_group, components, cut, forest

#: Rows of a leaf of the recursion, compared by one matrix product.
LEAF = 256
#: Most rows from which the principal directions are fitted; they only steer the order, never the result.
FIT_ROWS = 4096
#: Most parts of the sequence, the upper level of intervals, and most lengths of vectors with fitted directions.
MOST_PARTS, MOST_FITTED = 2048, 256
#: Bytes of an interval's vectors.
INTERVAL_BYTES = 4 << 20
#: Partners of an interval that one task compares with a copy of it.
PARTNERS = 8


def scaled(x: np.ndarray) -> np.ndarray:
    """Each vector by the power of two that brings its largest component to between 1/2 and 1: no square is lost or infinite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _vectors(batch_vectors: pa.Array, dim: int) -> np.ndarray:
    return scaled(np.asarray(batch_vectors.flatten(), dtype=np.float64).reshape(-1, dim))


def _directions(basis: dict[int, np.ndarray], dim: int, most: int) -> np.ndarray:
    """Columns to project on: the fitted ones, or the first axes."""
    return basis[dim] if dim in basis else np.eye(dim, min(dim, most))


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def _place(batches: Iterator[pa.RecordBatch], basis: dict[int, np.ndarray], most: int, eps: float) -> Iterator[pa.RecordBatch]:
    """Adds the grid cell on the principal directions, as an array that sorts in epsilon grid order."""
    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        cells: list = [None] * batch.num_rows
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            x = _vectors(batch.column("v").take(pa.array(rows)), int(d))
            at = np.floor((x / _norms(x)[:, None]) @ _directions(basis, int(d), most) / eps).astype(np.int32)
            for r, c in zip(rows, at, strict=True):
                cells[r] = c
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cell"])


def _intervals(batches: Iterator[pa.RecordBatch], most_rows: int, basis: dict[int, np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of one dimension as one packed row: the interval's box, ids, copies and vectors."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    made, held, count, dim = 0, [], 0, None

    def pack() -> pa.RecordBatch:
        ids = np.concatenate([h[0] for h in held])
        copies = np.concatenate([h[1] for h in held])
        x = np.concatenate([h[2] for h in held])
        at = (x / _norms(x)[:, None]) @ _directions(basis, dim, most)
        row = {"i": [(part << 24) + made], "dim": [dim], "lo": [at.min(axis=0)], "hi": [at.max(axis=0)], "ids": [ids.tobytes()], "copies": [copies.tobytes()], "x": [x.tobytes()]}
        return pa.RecordBatch.from_arrays([pa.array(row["i"], pa.int64()), pa.array([dim], pa.int32()), pa.array(row["lo"], pa.list_(pa.float64())), pa.array(row["hi"], pa.list_(pa.float64())), pa.array(row["ids"], pa.binary()), pa.array(row["copies"], pa.binary()), pa.array(row["x"], pa.binary())], list(row))

    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1), len(dims)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            while a < b:
                rows = min(most_rows, max(1, INTERVAL_BYTES // (8 * int(dims[a]))))
                if held and (count >= rows or dim != int(dims[a])):
                    yield pack()
                    made, held, count = made + 1, [], 0
                dim = int(dims[a])
                n = min(b - a, rows - count)
                piece = batch.slice(a, n)
                held.append((np.asarray(piece.column("id"), dtype=np.int64), np.asarray(piece.column("copies"), dtype=np.int64), _vectors(piece.column("v"), dim)))
                count, a = count + n, a + n
    if held:
        yield pack()


def _gap(lo1: np.ndarray, hi1: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
    """Least squared distance of boxes."""
    away = np.maximum(0, np.maximum(lo1 - hi2, lo2 - hi1))
    return (away**2).sum(axis=-1)


def _apart(lo1: str, hi1: str, lo2: str, hi2: str) -> Column:
    """_gap() of boxes in columns."""
    return F.expr(f"aggregate(transform(sequence(0, size({lo1}) - 1), k -> pow(greatest(0D, {lo1}[k] - {hi2}[k], {lo2}[k] - {hi1}[k]), 2)), 0D, (a, x) -> a + x)")


def pairs_of_intervals(boxes: DataFrame, eps: float, directions: int) -> DataFrame:
    """Pairs (i <= j) of intervals (i, dim, lo, hi) that may hold linked vectors: of the parts of the sequence that may, first.

    The parts are MOST_PARTS at most, so their pairs are bounded; everything is a join on the part.
    """
    boxes = boxes.withColumn("part", F.shiftright("i", 24))
    some = lambda f, c: F.filter(F.array(*(f(F.get(c, F.lit(k))) for k in range(directions))), lambda x: x.isNotNull())
    parts = boxes.groupBy("part", "dim").agg(some(F.min, "lo").alias("lo"), some(F.max, "hi").alias("hi"))
    far = parts.toDF("part2", "dim", "lo2", "hi2")
    near = parts.join(far, "dim").filter((F.col("part") <= F.col("part2")) & (_apart("lo", "hi", "lo2", "hi2") <= eps**2)).select("dim", "part", "part2")
    second = boxes.select(F.col("part").alias("part2"), "dim", F.col("i").alias("j"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    both = near.join(boxes, ["dim", "part"]).join(second, ["dim", "part2"])
    return both.filter((F.col("i") <= F.col("j")) & (_apart("lo", "hi", "lo2", "hi2") <= eps**2)).select("i", "j")


def _leaves(at1: np.ndarray, at2: np.ndarray, same: bool, eps: float) -> Iterator[tuple[int, int, int, int]]:
    """Leaf ranges that may hold links, by recursion over halves of two intervals."""
    stack = [(0, len(at1), 0, len(at2))]
    while stack:
        a, b, c, d = stack.pop()
        if same and c < a or _gap(at1[a:b].min(axis=0), at1[a:b].max(axis=0), at2[c:d].min(axis=0), at2[c:d].max(axis=0)) > eps**2:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            yield a, b, c, d
            continue
        p = [(a, b)] if b - a <= LEAF else [(a, (a + b) // 2), ((a + b) // 2, b)]
        q = [(c, d)] if d - c <= LEAF else [(c, (c + d) // 2), ((c + d) // 2, d)]
        stack += [(*x, *y) for x in p for y in q]


def _linked(r: dict, own: dict, basis: dict[int, np.ndarray], most: int, eps: float, least: float) -> pa.RecordBatch | None:
    """Links between two intervals: (id, copies linked) with b null, and a spanning forest as edges (a, b)."""
    same, dim = r["i"] == own["i"], r["dim"]
    ids, copies = ([np.frombuffer(x[k], dtype=np.int64) for x in (own, r)] for k in ("ids", "copies"))
    raw = [np.frombuffer(x["x"], dtype=np.float64).reshape(-1, dim) for x in (own, r)]
    unit = [x / _norms(x)[:, None] for x in raw]
    at = [u @ _directions(basis, dim, most) for u in unit]
    n = [np.zeros(len(i), dtype=np.int64) for i in ids]
    ea: list[np.ndarray] = []
    eb: list[np.ndarray] = []
    for a, b, c, d in _leaves(at[0], at[1], same, eps):
        cos = unit[0][a:b] @ unit[1][c:d].T
        hit = cos >= least
        for p, q in zip(*np.nonzero(np.abs(cos - least) < 1e-12), strict=True):  # too near for a sum in any order
            u, v = raw[0][a + p], raw[1][c + q]
            hit[p, q] = math.fsum(u * v) >= least * math.sqrt(math.fsum(u * u) * math.fsum(v * v))
        if same and a == c:
            hit &= np.triu(np.ones(hit.shape, dtype=bool), 1)
        if not hit.any():
            continue
        n[0][a:b] += hit @ copies[1][c:d]
        (n[0] if same else n[1])[c:d] += hit.T @ copies[0][a:b]
        p, q = np.nonzero(hit)
        nodes, low = forest(ids[0][a + p], ids[1][c + q])
        ea.append(nodes[nodes != low])
        eb.append(low[nodes != low])
    if not ea:
        return None
    nodes, low = forest(np.concatenate(ea), np.concatenate(eb))
    edge = nodes != low
    counted = [(i[k > 0], k[k > 0]) for i, k in zip(ids[: 2 - same], n[: 2 - same], strict=True)]
    a = np.concatenate([*(i for i, _ in counted), nodes[edge]])
    m = sum(len(i) for i, _ in counted)
    return pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(np.concatenate([*(k for _, k in counted), np.zeros(edge.sum(), dtype=np.int64)])), pa.array(np.concatenate([np.zeros(m, dtype=np.int64), low[edge]]), mask=np.arange(len(a)) < m)], ["a", "n", "b"]
    )


def _join(intervals: pa.Table, basis: dict[int, np.ndarray], most: int, eps: float, least: float) -> pa.Table:
    """From an interval (role 0) and its partners: its links with each of them."""
    roles = intervals.column("role").to_pylist()
    row = lambda k: {c: intervals.column(c)[k].as_py() for c in ("i", "dim", "ids", "copies", "x")}
    own = row(roles.index(0))
    got = (_linked(row(k), own, basis, most, eps, least) for k, r in enumerate(roles) if r)
    return pa.Table.from_batches([g for g in got if g is not None], pa.schema([("a", pa.int64()), ("n", pa.int64()), ("b", pa.int64())]))


def link_embeddings(vectors: DataFrame, *, least: float = 0.95, directions: int = 8, interval_rows: int = 8192) -> DataFrame:
    """Links `vectors` (vec_id, embedding) whose cosine is `least` or more; returns vec_id, n_links, component_id, kept.

    Equal vectors are one representative with a count. Representatives are sorted by grid cells of side epsilon
    on the leading principal directions (epsilon: the distance of unit vectors at that cosine), cut into
    intervals, and intervals are joined by recursion that skips those whose boxes lie more than epsilon apart:
    an orthonormal projection never lengthens a distance, so no link is lost. Parts of the sequence are joined before
    their intervals, and these before their leaves. Each joint gives link counts and a spanning forest, never all pairs.
    A vector is scaled by a power of two before anything is squared, so no finite one is too small or too large. Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing, nor do vectors of different lengths; a null vec_id links with nothing and has a null
    component. Repeated rows count as further vectors. Other columns are ignored.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.col("vec_id").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    v = v.withColumn("fine", fine)
    good = v.filter("fine").withColumns({"k1": F.xxhash64("v"), "k2": F.xxhash64(F.lit(17), "v")})
    classes = cut(good.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.min(F.struct("vec_id", "v")).getField("v").alias("v")).withColumn("dim", F.size("v")))
    total, values = classes.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    eps = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    sample = classes.select("dim", "v").orderBy(F.xxhash64("id")).limit(FIT_ROWS).collect()
    basis = {}
    for d in [d for d, _ in Counter(r["dim"] for r in sample).most_common(MOST_FITTED)]:
        x = scaled(np.array([r["v"] for r in sample if r["dim"] == d], dtype=np.float64).reshape(-1, d))
        x = x / _norms(x)[:, None]
        basis[d] = np.linalg.eigh(np.cov(x, rowvar=False, bias=True).reshape(d, d) if len(x) > 1 else np.eye(d))[1][:, ::-1][:, :directions]
    how = {"basis": basis, "most": directions}
    placed = classes.select("id", "copies", "v", "dim").mapInArrow(partial(_place, eps=eps, **how), "id long, copies long, v array<double>, dim int, cell array<int>")
    parts = min(max(1, -(-total // interval_rows), -(-8 * values // INTERVAL_BYTES)), MOST_PARTS)
    ordered = placed.repartitionByRange(parts, "dim", "cell", "id").sortWithinPartitions("dim", "cell", "id")
    blocks = cut(ordered.select("id", "copies", "v", "dim").mapInArrow(partial(_intervals, most_rows=interval_rows, **how), "i long, dim int, lo array<double>, hi array<double>, ids binary, copies binary, x binary"), whole=True)
    pairs = pairs_of_intervals(blocks.select("i", "dim", "lo", "hi"), eps, directions)
    turned = (F.col("i") + F.col("j")) % 2 == 0  # so that no interval has all the work
    pairs = cut(pairs.select(F.when(turned, F.col("i")).otherwise(F.col("j")).alias("owner"), F.when(turned, F.col("j")).otherwise(F.col("i")).alias("i")))
    salts = pairs.groupBy("owner").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts"))
    held = blocks.select("i", "dim", "ids", "copies", "x")
    partners = pairs.join(salts, "owner").select("owner", F.pmod(F.xxhash64("i"), F.col("salts")).cast("int").alias("salt"), "i", F.lit(1).alias("role")).join(held, "i")
    owners = salts.select(F.col("owner").alias("i"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(held, "i")
    columns = ["owner", "salt", "role", "i", "dim", "ids", "copies", "x"]
    both = partners.select(columns).unionAll(owners.withColumns({"owner": F.col("i"), "role": F.lit(0)}).select(columns))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts)
    found = cut(by_group(both.repartition(tasks, "owner", "salt"), ["owner", "salt"], _join, "a long, n long, b long", eps=eps, least=least, **how))
    n = found.filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    comp = components(found.filter("b is not null").select("a", "b"))
    known = classes.select("k1", "k2", "id", "copies").join(n, "id", "left").join(comp.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    ours = good.select("vec_id", "k1", "k2").join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    rest = v.filter(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return ours.unionAll(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

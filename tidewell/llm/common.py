"""Helpers shared by the training-data operators: shared storage, Arrow mapping, connected components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bits of a map that is sent to every executor (8 MB).
BITS_AT_MOST = 1 << 26
#: Word separators of the shared contract: space and the ASCII controls 9 to 13.
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir of the session. Where it is unset, a local session gets a folder
    of its own; on a cluster that is an error, since executors elsewhere could not read it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewell-"))
    return named or sc.getCheckpointDir()


def modest(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lets the session send rows to Python workers in batches of at most `most` bytes, where it allows more: a batch is held several
    times over, by the executor and by the worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(name, None) or "").rstrip("b")
    if not now.isdigit() or int(now) > most:
        spark.conf.set(name, str(most))


def give_back() -> None:
    """Hands memory that a task has freed back to the machine: a worker serves many tasks, and would hold the most any of them took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A function of a task's batches that gives its memory back when it ends."""

    @wraps(f)
    def run(*args: object, **given: object) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(*args, **given)
        finally:
            give_back()

    return run


def few(df: DataFrame) -> DataFrame:
    """The table in at most two partitions a core, or a sixteenth of the shuffle partitions where that is more, so that no more
    files are written than serve the work, and a task's share stays bounded by the partitions' size; nothing is moved."""
    spark = df.sparkSession
    return df.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))


def cut(df: DataFrame, whole: bool = False) -> DataFrame:
    """Reliable checkpoint: computed once, kept in the shared folder, survives lost executors. With `whole` partitions stay as
    they are."""
    shared_dir(df.sparkSession)
    return (df if whole else few(df)).checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """The table in as many partitions as there are cores at least; where it has them, as on large inputs, nothing is moved,
    nor behind a shuffle, whose partitions are chosen when it runs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, schema: str, make: Callable[[pa.RecordBatch], dict[str, object] | None]) -> DataFrame:
    """One Arrow record batch in, columns by name out; make() must be a picklable callable."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := make(batch)) is not None:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in (out[n] for n in names)], names)

    return df.mapInArrow(run, schema)


def by_group(df: DataFrame, keys: list[str], f: Callable[..., pa.Table], schema: str, **given: object) -> DataFrame:
    """f(rows of a group as a table, **given) for each group, in Arrow."""

    def run(rows: pa.Table) -> pa.Table:
        return f(rows, **given)

    return df.groupBy(*keys).applyInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges whose texts hold about `most` bytes; a single longer text stays whole."""
    sizes = np.cumsum([0, *(len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column))])
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of each one's component, by hooking and pointer jumping over arrays."""
    nodes, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ids[: len(a)], ids[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while (root != root[root]).any():
            root = root[root]
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
        if (before == root).all():
            break
    return nodes, nodes[root]


@lean
def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition, a bounded block at a time, as stars around the smallest node of each piece."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def stars() -> pa.RecordBatch:
        both = pa.Table.from_batches(held)
        nodes, low = forest(both.column(0).to_numpy(), both.column(1).to_numpy())
        out = nodes != low
        return pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(low[out])], ["a", "b"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 1 << 20:
            one = stars()
            if one.num_rows > 1 << 19:  # little is gained by holding it
                yield one
                held, rows = [], 0
            else:
                held, rows = [one], one.num_rows
    if held:
        yield stars()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) as (node, component): the smallest node reachable.

    Alternating large and small stars: each round is two grouped minima, each joined back on its node, with
    the edges kept in the shared folder between rounds. Hubs are safe: a minimum is combined before the
    shuffle, and the join back has one row a node on the other side, so a skewed node can be split. Null ends
    and self-loops are ignored; no edges give no rows. Nodes without edges are the caller's.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    e = cut(e.mapInArrow(_local_stars, "a long, b long").distinct())

    def digest(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    was = digest(e)
    while was[0]:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every larger neighbour is tied to the smallest of the neighbourhood
        e = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: the node and its smaller neighbours are tied to the smallest of these
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        tied = e.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        e = cut(tied.select("e.a", "e.b").filter("a <> b").distinct())
        if (now := digest(e)) == was:
            break
        was = now
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def keep(df: DataFrame) -> DataFrame:
    """A table written to the shared folder and read back; discard() deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}"
    few(df).write.option("parquet.block.size", 8 << 20).parquet(path)  # little is held before it is written
    return spark.read.parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(*kept: DataFrame) -> None:
    """Deletes the files of tables made by keep() once nothing reads them any more."""
    for df in kept:
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            if "/kept-" in f:
                delete(df.sparkSession, f)


def bit_table(wanted: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bytes of a map of `bits` or more in which bit (value mod its size) is set for every value of a long column; nulls set none.

    Bits are combined by a grouped aggregate before the driver gets them; the caller sees to it that `bits` is at most
    BITS_AT_MOST.
    """
    words = -(-max(bits, 1 << 16) // 64)
    at = wanted.filter(F.col(column).isNotNull()).select(F.pmod(F.col(column), F.lit(words * 64)).alias("p"))
    at = at.select(F.expr("p div 64").cast("int").alias("w"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("b"))
    rows = at.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    table = np.zeros(words, dtype="<i8")
    table[rows["w"].to_numpy(dtype=np.int64)] = rows["b"].to_numpy(dtype=np.int64)
    return table.view(np.uint8)


def in_table(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may be in the map: all that are, and some others."""
    p = values % (len(table) * 8)
    return (table[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1


def release(spark: SparkSession) -> None:
    """Asks the driver to collect garbage, so that shuffle files that nothing refers to are deleted; checkpoints are too where
    spark.cleaner.referenceTracking.cleanCheckpoints is set, and stay until the session's folder goes where it is not."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()

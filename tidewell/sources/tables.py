"""Reading and writing of ordered series as plain Spark tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_streaming: ContextVar[bool] = ContextVar("streaming", default=False)


@contextmanager
def as_streams() -> Iterator[None]:
    """Within it, read() gives streams of the tables' files, one file a micro-batch."""
    token = _streaming.set(True)
    try:
        yield
    finally:
        _streaming.reset(token)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; columns and filters reach the Parquet scan."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if not _streaming.get():
        return table
    # a pattern, as a stream reads folders and patterns, and the table may be one file
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/{name}.parque[t]")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets a folder of its own, on a cluster it must be named."""
    sc, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewell-"))
    return named or sc.getCheckpointDir()


def drained(stream: DataFrame) -> DataFrame:
    """What a stream gives of all that its sources hold by now, written to the shared folder and read back."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def from_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def write(df: DataFrame, path: str, *, groups: list[str] | None = None, files: int | None = None) -> None:
    """Parquet; with `groups`, dealt and sorted by them, so that later scans of a group skip the other row groups."""
    if groups:
        df = (df.repartition(files, *groups) if files else df.repartition(*groups)).sortWithinPartitions(*groups)
    df.write.mode("overwrite").parquet(path)


def hourly_bars(events: DataFrame) -> DataFrame:
    """Hourly price bars of events by event_type: open, high, low, close, volume (rows)."""
    seq = F.struct("ts", "event_id")
    return events.groupBy("event_type", F.date_trunc("hour", "ts").alias("bar_ts")).agg(
        F.min_by("value", seq).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", seq).alias("close"), F.count("*").cast("double").alias("volume")
    )

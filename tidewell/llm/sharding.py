"""Placement of keys on shards by a lookup table that the shards fill in turns."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, delete, shared_dir

#: A prime well above a hundred times the number of shards.
SLOTS = 65537


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(shard: str, slots: int) -> np.ndarray:
    """A shard's own order of all slots: from an offset in steps, both hashed from its name."""
    offset = xxhash.xxh3_64_intdigest(shard.encode(), seed=1) % slots
    step = xxhash.xxh3_64_intdigest(shard.encode(), seed=2) % (slots - 1) + 1
    return (offset + step * np.arange(slots, dtype=np.int64)) % slots


def fill(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """Table of shard numbers: shards take turns, each claiming the first slot in its preference that is still free.

    The turn order is the order of names, so the table depends on the set of shards only. Slots per shard differ by
    one at most, and taking a shard away leaves most other slots as they were.
    """
    names = sorted(set(shards))
    if not names or len(names) > slots or not _prime(slots) or len(names) > 65535:
        raise ValueError("needs a prime number of slots, no less than the number of shards, and 1 to 65535 shards")
    orders = [preference(s, slots).tolist() for s in names]
    at = [0] * len(names)
    table = [-1] * slots
    left = slots
    while True:
        for k, order in enumerate(orders):
            i = at[k]
            while table[order[i]] >= 0:
                i += 1
            table[order[i]] = k
            at[k] = i + 1
            left -= 1
            if not left:
                return np.array(table, dtype=np.uint16)


def slot(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key; a null key has the slot of an empty string."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: list[str], *, slots: int = SLOTS) -> DataFrame:
    """Adds slot and shard (place among the sorted names) to each row by `key`; no row of `df` is moved.

    The table has one row a slot, a prime number that is given, so it is broadcast whatever the size of `df`, and a row's
    shard is one look into its hash map. Equal keys share a shard; a null key has the shard of an empty string. Columns of
    `df` named slot or shard are replaced; an empty table stays empty; repeated rows stay.
    """
    table = df.sparkSession.createDataFrame(pd.DataFrame({"slot": np.arange(slots, dtype=np.int32), "shard": fill(shards, slots).astype(np.int32)}), "slot int, shard int")
    return df.drop("shard").withColumn("slot", slot(F.col(key), slots)).join(F.broadcast(table), "slot").select(*(c for c in df.columns if c not in ("slot", "shard")), "slot", "shard")


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, *, files: int = 1, slots: int = SLOTS) -> None:
    """Writes each shard of `df` to a folder of its own under `path` (shard=k), in `files` files, with all columns and slot.

    Rows are dealt by shard and by a hash of the whole row, so with more files a shard that holds a third of all rows is not
    one task's work, and a task that runs again deals its rows as before. Keys and clashing columns are as in place(); an
    empty table writes no shard; `df` must not have columns that can't be hashed, such as maps.
    """
    placed = place(df, key, shards, slots=slots)
    salt = F.pmod(F.xxhash64(*(c for c in placed.columns)), F.lit(files)).cast("int")
    dealt = placed.withColumn("__salt", salt).repartition(len(set(shards)) * files, "shard", "__salt").drop("__salt")
    dealt.write.option("parquet.block.size", 8 << 20).partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, shard: int | None = None) -> DataFrame:
    """Rows of all shards, or of one, whose other files are not touched."""
    df = spark.read.parquet(path)
    return df if shard is None else df.filter(F.col("shard") == shard)


def shard_documents(docs: DataFrame, shards: list[str], *, files: int = 1) -> DataFrame:
    """Writes `docs` (doc_id, text) as shards in the shared folder, reads them back and tells where each row is.

    Returns doc_id, slot, shard, and n_bytes and text_sha256 of the text as it was read (null: null). The shards are deleted
    once this is known.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    write_shards(rows, "doc_id", shards, path, files=files)
    schema = "doc_id long, text string, slot int, shard int"
    back = spark.read.schema(schema).parquet(path)
    out = cut(back.select("doc_id", "slot", "shard", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256")))
    delete(spark, path)
    return out

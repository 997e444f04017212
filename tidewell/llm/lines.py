"""Lines that many documents share: hashed, counted by document, dropped, and the rest put together by position."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keep

#: White space stripped from both ends of a line: space and the ASCII controls 9 to 13.
STRIPPED = " \t\n\x0b\x0c\r"
#: A line with more than one occurrence in HEAVY of all that are to be looked up is heavy; so at most HEAVY lines are.
HEAVY = 1000


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(STRIPPED)), string.ascii_uppercase, string.ascii_lowercase)


def long_lines(docs: DataFrame, least: int) -> DataFrame:
    """doc, tag (a hash of the whole text), pos, h1 and h2 (128 bits of the key) of lines whose key has `least` code points."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("t")).filter("doc is not null and t is not null")
    df = df.select("doc", F.xxhash64("t").alias("tag"), F.posexplode(F.split("t", "\n")).alias("pos", "line")).filter(F.length("line") >= least)
    df = df.withColumn("k", line_key(F.col("line"))).filter(F.length("k") >= least)
    return df.select("doc", "tag", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(least), "k").alias("h2"))


def shared_lines(lines: DataFrame, documents: int) -> DataFrame:
    """h1, h2, n (occurrences) and last (largest doc) of lines that `documents` distinct documents or more hold."""
    counted = lines.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("d"), F.count("*").alias("n"), F.max("doc").alias("last"))
    return counted.filter(F.col("d") >= documents).select("h1", "h2", "n", "last")


def dropped_positions(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """doc, tag and the positions (drop) of shared lines outside the last document that holds each.

    Lines are joined by hash. At most HEAVY lines have more than that share of all occurrences; these are broadcast, so no
    task of the other join gets more occurrences of one line than one in HEAVY.
    """
    total = shared.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") * HEAVY > total
    hit = lines.join(F.broadcast(shared.filter(heavy)), ["h1", "h2"]).unionAll(lines.join(shared.filter(~heavy), ["h1", "h2"]))
    return hit.filter("doc <> last").groupBy("doc", "tag").agg(F.collect_set("pos").alias("drop"))


def drop_shared_lines(docs: DataFrame, *, least: int = 40, documents: int = 5) -> DataFrame:
    """The rows of `docs` (doc_id, text, ...) with `text` less its shared lines, and n_lines, n_dropped (longs) behind.

    A text's lines are what \\n parts. A line whose key (line_key) has `least` code points or more and is found in `documents`
    distinct doc_ids or more is dropped, however often it occurs, but in the largest doc_id that holds it; the other
    lines are joined by \\n as they are. Null and empty texts count as one empty line and come out empty. Rows that share
    a doc_id count as one document; rows with the same doc_id and text are treated alike, and all of them come out. A
    row without a doc_id is no document: its lines neither count nor go. Other columns are carried, whatever their
    names, but for n_lines and n_dropped, which are replaced. No rows give no rows. Keys are compared as 128-bit hashes.

    Of the texts only hashes are shuffled to be counted; whole texts are dealt once, by doc_id and hash of the text, to meet the
    positions to drop. A document's list of positions is no longer than its lines.
    """
    lines = keep(long_lines(docs, least))
    drops = dropped_positions(lines, cut(shared_lines(lines, documents)))
    drops = drops.select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag"), "drop")
    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"), whole.alias("_text"), F.xxhash64(whole).alias("_hash"))
    df = df.join(drops, (F.col("_id") == F.col("_doc")) & (F.col("_hash") == F.col("_tag")), "left")
    parts = F.split("_text", "\n")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("drop")), lambda p: F.get(F.col("_parts"), p))
    df = df.withColumn("_parts", F.when(F.col("drop").isNotNull(), parts))
    text = F.when(F.col("drop").isNull(), F.col("_text")).otherwise(F.array_join(left, "\n"))
    n_lines = F.length("_text") - F.length(F.translate("_text", "\n", "")) + 1
    carried = [(text if c == "text" else F.col("_row")[c]).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return df.select(*carried, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every document."""
    out = drop_shared_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
    FROM lines
), shared AS (
    SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT doc_id, pos, line, s.k IS NOT NULL AND doc_id <> s.last AS gone FROM keyed LEFT JOIN shared s USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

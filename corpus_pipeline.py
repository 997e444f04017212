"""From raw documents to packed sequences: quality classifier, quality rules, near copies, repeated passages, packing."""

from __future__ import annotations

from functools import reduce
from operator import and_

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import classifier, jaccard, packing, quality_rules, repeats
from tidewell.llm.common import discard, keep, modest, table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule ensemble, fitted on the labels at hand, takes for good ones."""
    return classifier.keep_good(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def check_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of the newest policy."""
    return quality_rules.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, directly or through others, one.

    A row is known by its doc_id and text, so a doc_id that occurs again with another text is another document. The one
    with the smallest doc_id stays, a null doc_id being the largest; of those with the same doc_id the one whose text has
    the smallest hash. Texts without a shingle are linked to none. Rows that share doc_id and text are copies; one stays.
    """
    modest(spark)
    links = keep(jaccard.link_documents(docs, rows=True))
    row = ["doc_id", "h1", "h2"]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), *row)).alias("row")
    first = links.filter("n_shingles > 0").groupBy("component").agg(least).select(*(f"row.{c}" for c in row))
    first = first.unionAll(links.filter("n_shingles = 0").select(row).distinct()).toDF(*(f"_{c}" for c in row))
    own = {"doc_id": F.col("doc_id").cast("long"), **jaccard.text_hashes(F.col("text"))}
    out = docs.join(first, reduce(and_, (own[c].eqNullSafe(F.col(f"_{c}")) for c in row)), "left_semi")
    if links.groupBy(row).count().filter("count > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", "text"])
    return out


#: Bytes of a passage of fifty words: words of a passage take five bytes or more each, with what parts them.
PASSAGE = 240


def remove_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of PASSAGE bytes that occur twice or more; those of which nothing is left are gone."""
    modest(spark)
    r = repeats.remove_repeats(docs, length=PASSAGE, texts=True, carry=True)
    cut = F.col("n_removed") > 0
    r = r.filter(~cut | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n = F.when(cut, F.length("text").cast("long"))
    columns = {"text": F.col("text"), "n_chars": F.coalesce(n, F.col("_row")["n_chars"].cast("long")) if "n_chars" in docs.columns else None}
    return r.select(*((columns[c] if c in columns else F.col("_row")[c]).alias(c) for c in docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with their places in sequences of 2048; words are let go of, as workers serve all stages."""
    modest(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cache=64 << 20, forget=True)


STAGES = [
    ("quality classifier", classify_quality),
    ("quality rules", check_rules),
    ("near copies", drop_near_copies),
    ("repeated passages", remove_passages),
    ("packing", pack_sequences),
]

#: SQL can't express the fitted rules, the similarity join or the packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    kept: list[DataFrame] = []
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
        if kept:
            discard(kept.pop())
        kept.append(docs)
    out = keep(STAGES[-1][1](spark, docs, sf_dir))
    discard(*kept)
    return out

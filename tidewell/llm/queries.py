"""Queries opN_<name> of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, classifier, clustering, jaccard, language, lexical, lines, neardup, oracles, packing, quality_rules, repeats, sharding, warc
from .common import spread, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link_embeddings(table(spark, sf_dir, "embeddings"), least=0.95)


def op3_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs, model = language.train(documents(spark, sf_dir))
    return language.identify(table(spark, sf_dir, "pages"), langs, model)


def op4_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.check(documents(spark, sf_dir))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part of operator 5: what each rule of the newest policy drops, and what it alone drops."""
    return quality_rules.ablations(quality_rules.ledger(documents(spark, sf_dir)))


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(documents(spark, sf_dir), width=4, percent=85)


def op8_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), [f"shard-{k:03d}" for k in range(64)])


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir), length=400, texts=True)


def op11_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_best_fit_packing,
        op2_embedding_neardup,
        op3_language_evidence,
        op4_warc_reassembly,
        op5_quality_rules,
        op6_bpe_automaton,
        op7_ngram_jaccard,
        op8_shard_table,
        op9_quality_classifier,
        op10_suffix_repeats,
        op11_annulus_clusters,
        op12_lexical_search,
        op13_line_dedup,
        quality_ablations,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_neardup": oracles.EMBEDDING_LINKS,
        "op4_warc_reassembly": warc.ORACLE_SQL,
        "op5_quality_rules": quality_rules.ORACLE_SQL,
        "quality_ablations": quality_rules.ABLATIONS_SQL,
        "op7_ngram_jaccard": oracles.SHINGLE_LINKS,
        "op10_suffix_repeats": oracles.REPEATED_BYTES,
        "op11_annulus_clusters": clustering.oracle_sql(),
        "op12_lexical_search": lexical.ORACLE_SQL,
        "op13_line_dedup": lines.ORACLE_SQL,
    }

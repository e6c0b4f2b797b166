"""The queries of the corpus operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import jaccard, line_dedup, quality_rules, sharding
from quernstone.llm.common import load


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quernstone.llm.line_dedup import dedup_lines

    out = dedup_lines(load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.col("removed_lines").cast("long").alias("removed_lines"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.langid import predict_documents

    return predict_documents(load(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.packing import pack_documents

    return pack_documents(load(spark, sf_dir, "documents"), vocabulary())


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.quality_rules import rate_documents

    return rate_documents(load(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.quality import rate_documents

    return rate_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.ann import search

    vectors = load(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter("vec_id % 50 = 0"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.bpe import digest_documents

    return digest_documents(load(spark, sf_dir, "documents"), vocabulary())


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.jaccard import link_documents

    return link_documents(load(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.sharding import shard_documents

    return shard_documents(load(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quernstone.llm.toxicity import rate_documents

    return rate_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_language_id": op2_language_id,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_bpe": op7_bpe,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
}

#: The others train a model, hash vectors by random numbers, or need a vocabulary's merges: their tests use brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op4_quality_rules": quality_rules.ORACLE_SQL,
    "op8_jaccard_join": jaccard.ORACLE_SQL,
    "op9_sharding": sharding.ORACLE_SQL,
}

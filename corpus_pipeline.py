"""The corpus pipeline: quality rules, quality classifier, line dedup, n-gram Jaccard join, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs, with the columns of documents; the last
one returns the packed pieces. Stages are written as Parquet in between.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm.common import checkpointed, shared_folder
from quernstone.llm.jaccard import keep_one
from quernstone.llm.line_dedup import dedup_documents
from quernstone.llm.packing import pack_documents
from quernstone.llm.quality import fit, score_documents
from quernstone.llm.quality_rules import keep_documents
from quernstone.llm.queries import vocabulary

#: Rows of whole texts that a Python worker gets at a time.
BATCH_ROWS = 500


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that operator 4 keeps. Null and empty texts fail; repeated rows are each judged; no rows give none."""
    return keep_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that operator 5 predicts to be good. Null and empty texts are scored as texts without words; without
    labels all stay; repeated rows each keep their row; no rows give none."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_documents(docs, fit(docs, labels))
    return checkpointed(scored.filter("gam_predicted = 1").select(*[f"`{c}`" for c in docs.columns]), BATCH_ROWS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of chunks that came before. A null text stays null, a text that loses all its
    lines becomes empty; rows with the same id and text are one document; no rows give none."""
    return dedup_documents(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id. Texts without words all stay; of rows that
    repeat an id one stays; no rows give none."""
    return keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents. A null or empty text is one token; repeated rows are each packed; no rows
    give none."""
    return pack_documents(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier is trained, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; in between they are Parquet in the folder of spark.checkpoint.dir."""
    base = shared_folder(spark).rstrip("/")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{base}/pipeline-{uuid.uuid4().hex}/{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

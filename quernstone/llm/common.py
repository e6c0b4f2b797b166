"""What the corpus operators share: reliable checkpoints, scale-proof ranking, broadcast behind a size check."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that one window group of gapless_rank() holds on average.
RANK_BUCKET_ROWS = 20_000
#: Parts that ids are dealt into to choose samples: many, so that a small share of many rows is no share of 0.
SAMPLE_PARTS = 1 << 50
#: Most rows of narrow ids that are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return named or tempfile.mkdtemp(prefix="checkpoint")


def checkpointed(df: DataFrame, arrow_rows: int | None = None) -> DataFrame:
    """Write df to the reliable folder of spark.checkpoint.dir and cut its lineage; executors may be lost afterwards.

    arrow_rows bounds the rows that Python workers get at a time meanwhile, for rows that hold long texts or sets.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(key)
    if arrow_rows:
        spark.conf.set(key, str(arrow_rows))
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(key, before)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the counted rows are within the limit; else the join shuffles."""
    return F.broadcast(df) if rows <= limit else df


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text, unsigned; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def md5_int(text: Column, digits: int = 12) -> Column:
    """The first hexadecimal digits of md5 as a number below 16^digits (digits <= 15)."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def gapless_rank(df: DataFrame, group: list[str], order: list[str], bucket: Column, buckets: int, name: str) -> DataFrame:
    """Add name: a number from 0 without gaps within each group.

    A group may hold any share of the rows: it is dealt into buckets by a hash of its rows, each bucket
    is numbered alone, and the buckets' counts give the offsets. df is read twice, so it has to be
    deterministic or checkpointed. Rows that tie on every order column are interchangeable.
    """
    dealt = df.withColumn("_bucket", F.pmod(bucket, F.lit(buckets)))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_bucket").alias("_b"), "_base")
    )
    within = Window.partitionBy(*group, "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1)
    same = F.col("_bucket") == F.col("_b")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return (
        ranked.join(offsets, same)
        .withColumn(name, (F.col("_base") + F.col("_rank")).cast("long"))
        .drop("_bucket", "_rank", "_base", "_b", *[f"_g{i}" for i in range(len(group))])
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, holdout: int, rows: int) -> DataFrame:
    """About `rows` documents (doc_id, text, label) for fitting: a bounded sample by a hash of the id.

    Only labels of ids whose crc32 is not divisible by `holdout` are looked at. Null ids and labels are left
    out; of several labels of an id the largest counts, and of several texts the longest.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (id_crc() % holdout != 0))
        .groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    )
    number = known.count()
    if number > rows:
        known = known.filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(SAMPLE_PARTS)) < SAMPLE_PARTS * rows // number)
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    best = F.max(F.struct(F.length("text").alias("n"), "text")).alias("best")
    return found.groupBy("doc_id").agg(best, F.max("label").alias("label")).select("doc_id", "best.text", "label")

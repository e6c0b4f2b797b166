"""Ordered key-value operators on DataFrames with a unique key column.

Point and range reads are filters, which reach the Parquet scan. Set-wise forms are joins. Writes return a new
DataFrame; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# -- reads -------------------------------------------------------------------------------------------------

def get(df: DataFrame, key: str, value: Any) -> DataFrame:
    """The row of one key, or none."""
    return df.filter(F.col(key) == F.lit(value)).limit(1)


def contains_key(df: DataFrame, key: str, value: Any) -> bool:
    return not get(df, key, value).select(key).isEmpty()


def multi_get(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of many keys at once; repeated keys count once."""
    return df.join(keys.select(key).distinct(), key, "left_semi")


def contained(keys: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """The rows of keys whose key is in df."""
    return keys.join(df.select(key), key, "left_semi")


def missing(keys: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """The rows of keys whose key is not in df; null keys are missing."""
    return keys.join(df.select(key), key, "left_anti")


def floor(df: DataFrame, key: str, value: Any) -> DataFrame:
    """The greatest entry up to a key: one row or none."""
    return df.filter(F.col(key) <= F.lit(value)).orderBy(F.desc(key)).limit(1)


def ceiling(df: DataFrame, key: str, value: Any) -> DataFrame:
    """The least entry from a key on: one row or none."""
    return df.filter(F.col(key) >= F.lit(value)).orderBy(key).limit(1)


def between(key: str, low: Any = None, high: Any = None, low_open: bool = False, high_open: bool = False) -> Column:
    """The condition of a key range; None is unbounded, an open bound is excluded."""
    out = F.lit(True)
    if low is not None:
        out = out & (F.col(key) > F.lit(low) if low_open else F.col(key) >= F.lit(low))
    if high is not None:
        out = out & (F.col(key) < F.lit(high) if high_open else F.col(key) <= F.lit(high))
    return out


def key_range(df: DataFrame, key: str, low: Any = None, high: Any = None, low_open: bool = False, high_open: bool = False, reverse: bool = False, ordered: bool = True) -> DataFrame:
    """The entries of a key range, in key order unless ordered is False (a set-wise use needs no sort)."""
    out = df.filter(between(key, low, high, low_open, high_open))
    return out.orderBy(F.desc(key) if reverse else F.asc(key)) if ordered else out


def prefix_scan(df: DataFrame, key: str, prefix: bytes | str) -> DataFrame:
    """The entries whose binary or text key begins with a prefix, as a range that reaches the scan."""
    end = prefix if isinstance(prefix, bytes) else prefix.encode()
    while end and end[-1] == 0xFF:
        end = end[:-1]
    if not prefix:
        return df
    if isinstance(prefix, str):
        return df.filter(F.col(key).startswith(prefix))
    if not end:
        return df.filter(F.col(key) >= F.lit(prefix))
    return df.filter((F.col(key) >= F.lit(prefix)) & (F.col(key) < F.lit(end[:-1] + bytes([end[-1] + 1]))))


def scan(df: DataFrame, key: str, reverse: bool = False) -> DataFrame:
    return df.orderBy(F.desc(key) if reverse else F.asc(key))


def first(df: DataFrame, key: str) -> DataFrame:
    """The least entry. Each task keeps one row, as TakeOrderedAndProject."""
    return df.orderBy(key).limit(1)


def last(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.desc(key)).limit(1)


def keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(key)


def values(df: DataFrame, key: str) -> DataFrame:
    return df.drop(key)


def same_entries(a: DataFrame, b: DataFrame) -> bool:
    """Whether two maps hold the same entries."""
    if set(a.columns) != set(b.columns):
        return False
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# -- writes ------------------------------------------------------------------------------------------------

def last_per_key(ops: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key by seq. Aggregated before the shuffle, so a hot key is no hot task."""
    rest = [c for c in ops.columns if c != key]
    best = F.max_by(F.struct(*rest), F.col(seq)).alias("_row")
    return ops.groupBy(key).agg(best).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*ops.columns)


def upsert(base: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Entries of delta replace those of base; delta has unique keys."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta.select(*base.columns))


def remove(base: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """base without the keys of gone; absent keys are ignored."""
    return base.join(gone.select(key), key, "left_anti")


def or_insert(base: DataFrame, defaults: DataFrame, key: str) -> DataFrame:
    """Insert the entries whose key is absent; of repeated defaults one is inserted."""
    new = missing(defaults.dropDuplicates([key]), base, key)
    return base.unionByName(new.select(*base.columns))


def apply_batch(base: DataFrame, ops: DataFrame, key: str, seq: str = "seq", op: str = "op", wiped: bool = False) -> DataFrame:
    """Apply puts (op `P`) and deletes (op `D`) at once; the last operation of a key wins.

    With wiped everything that was there is deleted first.
    """
    final = last_per_key(ops, key, seq)
    puts = final.filter(F.col(op) == "P").select(*base.columns)
    return puts if wiped else base.join(final.select(key), key, "left_anti").unionByName(puts)


def update(df: DataFrame, where: Column, column: str, value: Column) -> DataFrame:
    """Rewrite a value column of the entries that meet a condition."""
    return df.withColumn(column, F.when(where, value).otherwise(F.col(column)))


def update_with(df: DataFrame, where: Column, changes: dict[str, Callable[[Column], Column]]) -> DataFrame:
    return df.withColumns({c: F.when(where, f(F.col(c))).otherwise(F.col(c)) for c, f in changes.items()})


# -- bulk searches -----------------------------------------------------------------------------------------

#: Rows of one stretch of the key in an as-of join, on average.
STRETCH_ROWS = 100_000


def asof_join(left: DataFrame, right: DataFrame, key: str, right_key: str, values: list[str], by: list[str] | None = None, forward: bool = False, buckets: int | None = None, prefix: str = "") -> DataFrame:
    """For each row of left the entry of right with the greatest key up to its own (forward: the least from it on).

    Adds right's key and values with a prefix, null where there is no entry. Keys are numbers or times. The keys
    are cut into stretches at quantiles, each its own window, and the last entry of earlier stretches is carried
    over from a table of one row a stretch: neither a single stream of keys nor a hot group ends in one task.
    Of equal keys in right one is taken. Null keys on the left find nothing.
    """
    by = by or []
    number = lambda c: F.col(c).cast("timestamp").cast("double") if dict(left.dtypes).get(c, dict(right.dtypes).get(c, "")).startswith("timestamp") else F.col(c).cast("double")
    if buckets is None:
        buckets = max(1, -(-right.count() // STRETCH_ROWS))
    cuts = right.select(number(right_key).alias("_x")).filter("_x is not null").approxQuantile("_x", [i / buckets for i in range(1, buckets)], 0.001) if buckets > 1 else []
    stretch = lambda c: sum((F.when(number(c) >= cut, 1).otherwise(0) for cut in sorted(set(cuts))), F.lit(0)) if cuts else F.lit(0)
    entry = F.struct(F.col(right_key).alias("_k"), *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)])
    r = right.filter(F.col(right_key).isNotNull()).select(*[F.col(c) for c in by], F.col(right_key).alias("_key"), F.lit(0 if not forward else 1).alias("_side"), stretch(right_key).alias("_stretch"), entry.alias("_entry"), F.lit(None).cast(left.select(F.struct(*[f"`{c}`" for c in left.columns])).schema[0].dataType).alias("_row"))
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    q = left.select(*[F.col(c) for c in by], F.col(key).alias("_key"), F.lit(1 if not forward else 0).alias("_side"), stretch(key).alias("_stretch"), F.lit(None).cast(r.schema["_entry"].dataType).alias("_entry"), row.alias("_row"))
    direction = (F.desc("_key"), F.desc("_side")) if forward else (F.asc("_key"), F.asc("_side"))
    near = Window.partitionBy(*by, "_stretch").orderBy(*direction).rowsBetween(Window.unboundedPreceding, 0)
    seen = r.unionByName(q).withColumn("_near", F.last("_entry", ignorenulls=True).over(near)).filter("_row is not null")
    if cuts:
        ends = r.groupBy(*by, "_stretch").agg((F.min_by if forward else F.max_by)("_entry", "_key").alias("_end"))
        steps = ends.select(*by, "_stretch", "_end").unionByName(seen.select(*by, "_stretch").distinct().withColumn("_end", F.lit(None).cast(r.schema["_entry"].dataType)))
        steps = steps.groupBy(*by, "_stretch").agg(F.first("_end", ignorenulls=True).alias("_end"))
        carry = Window.partitionBy(*by).orderBy(F.desc("_stretch") if forward else F.asc("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
        steps = steps.withColumn("_carried", F.last("_end", ignorenulls=True).over(carry)).select(*by, "_stretch", "_carried")
        same = [*by, "_stretch"]
        seen = seen.join(steps, same, "left").withColumn("_near", F.coalesce("_near", "_carried"))
    near = F.when(F.col(f"_row.{key}").isNotNull(), F.col("_near"))
    return seen.select("_row.*", near["_k"].alias(f"{prefix}{right_key}"), *[near[f"_v{i}"].alias(f"{prefix}{v}") for i, v in enumerate(values)])


def range_join(points: DataFrame, ranges: DataFrame, key: str, low: str, high: str, width: int) -> DataFrame:
    """Each point with every range [low, high] that holds it, as an equi-join on stretches of `width`.

    Integer keys. A range longer than a stretch stands in each one that it meets. Inverted ranges hold nothing.
    """
    base = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    p = points.withColumn("_stretch", base(key))
    r = ranges.filter(F.col(low) <= F.col(high)).withColumn("_stretch", F.explode(F.sequence(base(low), base(high))))
    return p.join(r, "_stretch").filter(F.col(key).between(F.col(low), F.col(high))).drop("_stretch")

"""Diff and three-way merge of snapshots with unique keys.

Absent is not null: every side carries a presence flag, so null values survive. A snapshot's columns are the
key and any number of value columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _side(df: DataFrame, key: str, name: str) -> DataFrame:
    """key and one struct of the values, which is null only where the key is absent."""
    return df.select(F.col(key).alias("_k"), F.struct(*[F.col(c) for c in df.columns if c != key]).alias(name))


def _joined(sides: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, "_k", "full_outer"), sides)


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """change (Added, Removed, Modified), the key, old_value and new_value (structs) of every difference."""
    j = _joined([_side(old, key, "old_value"), _side(new.select(*old.columns), key, "new_value")])
    o, n = F.col("old_value"), F.col("new_value")
    change = F.when(o.isNull(), "Added").when(n.isNull(), "Removed").otherwise("Modified")
    return j.filter(~o.eqNullSafe(n)).select(change.alias("change"), F.col("_k").alias(key), o, n)


def _result(j: DataFrame, value: Column, key: str, columns: list[str]) -> DataFrame:
    rest = [c for c in columns if c != key]
    return j.withColumn("_r", value).filter("_r is not null").select(F.col("_k").alias(key), *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*columns)


def merge(ancestor: DataFrame, source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Three-way merge in which the source wins: what the source changed since the ancestor, else the target."""
    return merge_many([ancestor], source, target, key)


def merge_many(ancestors: list[DataFrame], source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """merge() with several bases: a key on which the bases disagree is taken from the source, deletion included.

    Without a base the ancestor is the empty map.
    """
    columns = source.columns
    bases = [_side(a.select(*columns), key, f"a{i}") for i, a in enumerate(ancestors)]
    j = _joined([*bases, _side(source, key, "s"), _side(target.select(*columns), key, "t")])
    s, t = F.col("s"), F.col("t")
    if not bases:
        return _result(j, F.coalesce(s, t), key, columns)
    agree = reduce(lambda x, y: x & y, [F.col("a0").eqNullSafe(F.col(f"a{i}")) for i in range(1, len(bases))], F.lit(True))
    return _result(j, F.when(agree & s.eqNullSafe(F.col("a0")), t).otherwise(s), key, columns)


def snapshot(deltas: DataFrame, key: str, columns: list[str], order: str = "seq", op: str = "op") -> DataFrame:
    """The state after a chain of deltas (op `P` or `D`): the last operation of each key, deletions dropped."""
    rest = [c for c in columns if c != key]
    last = deltas.groupBy(key).agg(F.max_by(F.struct(F.col(op).alias("_op"), *rest), F.col(order)).alias("_r"))
    return last.filter("_r._op = 'P'").select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*columns)

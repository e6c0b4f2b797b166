"""Slot index: a set of (slot, key) entries with paging, range counts and tiers.

Slots ascend or descend; within a slot keys always ascend. Bounds are inclusive and None is unbounded.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.kv import between


def insert(index: DataFrame, entries: DataFrame) -> DataFrame:
    """index with new entries; those that are there already change nothing."""
    names = index.columns
    new = entries.select(*names).distinct().join(index, names, "left_anti")
    return index.unionByName(new)


def remove(index: DataFrame, entries: DataFrame) -> DataFrame:
    return index.join(entries.select(*index.columns), index.columns, "left_anti")


def page(index: DataFrame, slot: str, key: str, size: int, number: int, reverse: bool = False, left: Any = None, right: Any = None) -> DataFrame:
    """Page `number` (from 0) of `size` entries within [left, right]; nothing for size 0 or inverted bounds.

    A top-k of (number + 1) * size rows, so for pages far behind use page_by_tiers().
    """
    if size <= 0 or number < 0 or (left is not None and right is not None and left > right):
        return index.limit(0)
    order = [F.desc(slot) if reverse else F.asc(slot), F.asc(key)]
    return index.filter(between(slot, left, right)).orderBy(*order).offset(size * number).limit(size)


def count(index: DataFrame, slot: str, left: Any = None, right: Any = None) -> int:
    """Entries within [left, right]; 0 for inverted bounds."""
    return index.filter(between(slot, left, right)).count()


def rank_of(index: DataFrame, slot: str, value: Any, from_right: bool = False) -> int:
    """Entries strictly left of a slot (from_right: strictly right)."""
    return index.filter(F.col(slot) > F.lit(value) if from_right else F.col(slot) < F.lit(value)).count()


def floor_align(slot: Column, base: int) -> Column:
    """The largest multiple of base up to a slot, as slots are not negative."""
    return slot - F.pmod(slot, F.lit(base))


def tier(index: DataFrame, slot: str, base: int) -> DataFrame:
    """Counts of aligned stretches of `base` slots."""
    return index.groupBy(floor_align(F.col(slot), base).alias("slot_floor")).agg(F.count("*").alias("n"))


def tiers(index: DataFrame, slot: str, capacity: int = 16, levels: int | None = None) -> DataFrame:
    """level, slot_floor, n: level l counts stretches of capacity^l slots, up to the first level of at most capacity stretches.

    The finest level is counted from the entries, each coarser one from the level below.
    """
    if capacity < 2:
        raise ValueError("a tier holds at least two stretches")
    level, base = 1, capacity
    fine = tier(index, slot, base)
    out = fine.withColumn("level", F.lit(level))
    while (levels is None and fine.count() > capacity) or (levels is not None and level < levels):
        level, base = level + 1, base * capacity
        fine = fine.groupBy(floor_align(F.col("slot_floor"), base).alias("slot_floor")).agg(F.sum("n").alias("n"))
        out = out.unionByName(fine.withColumn("level", F.lit(level)))
    return out.select("level", "slot_floor", "n")


def page_by_tiers(index: DataFrame, rollup: DataFrame, slot: str, key: str, size: int, number: int, capacity: int, reverse: bool = False, left: Any = None, right: Any = None) -> DataFrame:
    """page() with the rollup of tiers(): only the stretches that hold the page are read and sorted.

    With bounds, the entries before the nearer bound are counted and skipped, and what lies beyond the other one is left out.

    Each level's stretches within the one chosen above (at most capacity of them) reach the driver.
    """
    if size <= 0 or number < 0 or (left is not None and right is not None and left > right):
        return index.limit(0)
    near, far = (right, left) if reverse else (left, right)
    skip = size * number + (rank_of(index, slot, near, reverse) if near is not None else 0)
    top = rollup.agg(F.max("level")).first()[0]
    if top is None:
        return index.limit(0)

    def locate(skip: int) -> tuple[int, int] | None:
        """The finest stretch that holds the entry at an offset, and the entries before it."""
        before, low, high = 0, None, None
        for level in range(top, 0, -1):
            base = capacity**level
            rows = rollup.filter((F.col("level") == level) & between("slot_floor", low, high)).orderBy(F.desc("slot_floor") if reverse else F.asc("slot_floor")).collect()
            for r in rows:
                if before + r["n"] > skip:
                    low, high = r["slot_floor"], r["slot_floor"] + base - 1
                    break
                before += r["n"]
            else:
                return None
        return low, before

    start = locate(skip)
    if start is None:
        return index.limit(0)
    total = rollup.filter(F.col("level") == top).agg(F.sum("n")).first()[0]
    end = locate(min(skip + size, total) - 1)
    a, b = (end[0], start[0]) if reverse else (start[0], end[0])
    held = index.filter(F.col(slot).between(F.lit(a), F.lit(b + capacity - 1)))
    out = held.orderBy(F.desc(slot) if reverse else F.asc(slot), F.asc(key)).offset(skip - start[1]).limit(size)
    return out if far is None else out.filter(F.col(slot) >= F.lit(far) if reverse else F.col(slot) <= F.lit(far))


def page_by_group(index: DataFrame, group: list[str], slot: str, key: str, size: int, number: int, reverse: bool = False, left: Any = None, right: Any = None) -> DataFrame:
    """The same page of every group at once."""
    if size <= 0 or number < 0:
        return index.limit(0)
    order = Window.partitionBy(*group).orderBy(F.desc(slot) if reverse else F.asc(slot), F.asc(key))
    ranked = index.filter(between(slot, left, right)).withColumn("_nth", F.row_number().over(order))
    return ranked.filter((F.col("_nth") > size * number) & (F.col("_nth") <= size * (number + 1))).drop("_nth")

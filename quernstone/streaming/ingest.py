"""Structured Streaming into stored collections.

Every micro-batch is one atomic write of the collection, so a batch that is run again changes nothing: slot
entries are a set, and upserts of the same rows give the same table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernstone.operators import kv
from quernstone.sources.collections import OrderedMap, SlotIndex


def into_slots(stream: DataFrame, index: SlotIndex, slot: str, key: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Add (slot, key) of every row to a slot index."""
    def write(df: DataFrame, _: int) -> None:
        index.insert_batch(df.select(F.col(slot).alias("slot"), F.col(key).alias("k")))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def into_map(stream: DataFrame, target: OrderedMap, seq: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Upsert every row; of a key's rows the last by seq stays.

    That holds within a batch, and from batch to batch too if the map has the column seq: then a late older row
    changes nothing.
    """
    def write(df: DataFrame, _: int) -> None:
        new = kv.last_per_key(df, target.key, seq)
        if seq in target.df.columns:
            new = kv.last_per_key(new.select(*target.df.columns).unionByName(kv.contained(target.df, new, target.key)), target.key, seq)
        target.insert_all(new.select(*target.df.columns))

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def slot_counts(stream: DataFrame, ts: str, slot_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """Entries of each closed time slot; rows later than the delay are left out."""
    w = F.window(ts, f"{slot_seconds} seconds")
    return stream.withWatermark(ts, delay).groupBy(w).agg(F.count("*").alias("n")).select(F.unix_seconds(F.col("window.start")).alias("slot"), "n")

"""Sharding by a hierarchical weighted hash tree (operator 9).

A topology is a tree of regions, racks and shards. A key descends it: on each level every child draws
-ln(u) / weight, where u comes from a hash of the key and the child's name, and the smallest draw wins,
so a child wins with probability proportional to its weight. A changed weight changes the draws of its
own path only: keys move solely into (or out of) the subtrees whose weights change.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import RANK_BUCKET_ROWS, gapless_rank, md5_int

#: Digits of md5 that make a draw.
DIGITS = 12


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, racks_per_region: int = 2, shards_per_rack: int = 4, weights: dict[int, float] | None = None) -> list[Leaf]:
    """Shards 0 to shards - 1 in racks and regions that fill up in order; racks are numbered through.

    The shard after a full region opens a region of its own, so that it takes rows only into itself.
    """
    return [Leaf(s // (racks_per_region * shards_per_rack), s // shards_per_rack, s, (weights or {}).get(s, 1.0)) for s in range(shards)]


def grown(leaves: list[Leaf]) -> list[Leaf]:
    """One shard more, in a region of its own, so that it takes rows only into itself."""
    return [*leaves, Leaf(max(x.region for x in leaves) + 1, max(x.rack for x in leaves) + 1, max(x.shard for x in leaves) + 1)]


def _draw(key: Column, level: str, node: int, weight: float) -> Column:
    u = (md5_int(F.concat(F.lit(f"{level}{node}/"), key), DIGITS).cast("double") + 0.5) / float(16**DIGITS)
    return F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(node).alias("node"))


def _winner(key: Column, level: str, nodes: dict[int, float]) -> Column:
    live = {n: w for n, w in sorted(nodes.items()) if w > 0}
    if len(live) == 1:
        return F.lit(next(iter(live)))
    return F.array_min(F.array(*[_draw(key, level, n, w) for n, w in live.items()]))["node"]


def _pick(parent: Column, choices: dict[int, Column]) -> Column:
    out = F.lit(None).cast("int")
    for node, choice in choices.items():
        out = F.when(parent == node, choice).otherwise(out)
    return out


def assign(df: DataFrame, key: Column, leaves: list[Leaf], prefix: str = "") -> DataFrame:
    """Add the columns region, rack and shard (with a prefix) that the key descends to.

    Null keys count as the empty text. Leaves of weight 0 get nothing; with no positive weight ValueError is raised.
    Repeated keys get the same shard.
    """
    regions: dict[int, float] = defaultdict(float)
    racks: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    shards: dict[int, dict[int, float]] = defaultdict(dict)
    for x in leaves:
        if x.weight < 0:
            raise ValueError("a weight is negative")
        if x.weight:
            regions[x.region] += x.weight
            racks[x.region][x.rack] += x.weight
            shards[x.rack][x.shard] = x.weight
    if not regions:
        raise ValueError("no leaf has a positive weight")
    key = F.coalesce(key.cast("string"), F.lit(""))
    region, rack, shard = (f"{prefix}{x}" for x in ("region", "rack", "shard"))
    return (
        df.withColumn(region, _winner(key, "region", regions))
        .withColumn(rack, _pick(F.col(region), {r: _winner(key, "rack", x) for r, x in racks.items()}))
        .withColumn(shard, _pick(F.col(rack), {r: _winner(key, "shard", x) for r, x in shards.items()}))
    )


def shard_documents(docs: DataFrame, shards: int = 16, rows: int | None = None) -> DataFrame:
    """Deal documents into shards under the law `key`: doc_id and the shard count decide.

    Returns doc_id, size (UTF-8 bytes and 1), text_crc32, law, region, rack, shard, slot (from 0 without gaps
    in its shard) and grown_shard, the shard with one more shard. A null text has no bytes and crc32 0; a null
    doc_id is placed as the empty text; repeated rows land in one shard in slots of their own; an empty table
    gives no rows. Other columns of docs are ignored.
    """
    rows = docs.count() if rows is None else rows
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = assign(assign(slim, F.col("doc_id"), topology(shards)), F.col("doc_id"), grown(topology(shards)), "grown_")
    placed = placed.withColumn("law", F.lit("key")).drop("grown_region", "grown_rack")
    bucket = md5_int(F.concat(F.lit("slot/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 10)
    buckets = max(1, ceil(rows / shards / RANK_BUCKET_ROWS) * 4)
    out = gapless_rank(placed, ["shard"], ["doc_id", "text_crc32", "size"], bucket, buckets, "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "region", "rack", "shard", "slot", "grown_shard")


def _sql(leaves: list[Leaf]) -> str:
    """The shard of a key `k` in SQL."""
    def winner(level: str, nodes: dict[int, float]) -> str:
        draws = ", ".join(f"{{'d': -ln((CAST('0x' || substr(md5('{level}{n}/' || k), 1, {DIGITS}) AS BIGINT) + 0.5) / {16**DIGITS}) / {w}, 'n': {n}}}" for n, w in sorted(nodes.items()))
        return f"(list_sort([{draws}])[1]).n"

    regions, racks, shards = {}, {}, {}
    for x in leaves:
        regions[x.region] = regions.get(x.region, 0.0) + x.weight
        racks.setdefault(x.region, {})[x.rack] = racks.get(x.region, {}).get(x.rack, 0.0) + x.weight
        shards.setdefault(x.rack, {})[x.shard] = x.weight
    pick = lambda parent, level, of: f"CASE {parent} " + " ".join(f"WHEN {p} THEN {winner(level, x)}" for p, x in of.items()) + " END"
    return f"SELECT *, {pick('rack', 'shard', shards)} AS shard FROM (SELECT *, {pick('region', 'rack', racks)} AS rack FROM (SELECT *, {winner('region', regions)} AS region FROM d))"


#: The same in SQL for 16 shards; crc32 is a fold over the bytes with its table of 256 values.
ORACLE_SQL = f"""
WITH RECURSIVE g(n, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM g WHERE k < 8),
t AS MATERIALIZED (SELECT list(c ORDER BY n) AS tab FROM g WHERE k = 8),
x AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda v: CAST('0x' || v AS BIGINT)) AS bytes FROM documents),
d AS MATERIALIZED (SELECT doc_id, k, CAST(len(bytes) + 1 AS BIGINT) AS size,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda a, v: xor(a >> 8, tab[(xor(a, v) & 255) + 1])), 4294967295) AS text_crc32 FROM x, t),
a AS ({_sql(topology(16))}), b AS (SELECT DISTINCT k, shard AS grown_shard FROM ({_sql(grown(topology(16)))})),
n AS (SELECT greatest(1, CAST(ceil(count(*) / 16 / {RANK_BUCKET_ROWS}) * 4 AS BIGINT)) AS buckets FROM documents)
SELECT doc_id, size, text_crc32, 'key' AS law, region, rack, shard,
    row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5('slot/' || k), 1, 10) AS BIGINT) % buckets, doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM a JOIN b USING (k), n
"""

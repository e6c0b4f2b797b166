"""Overlay maps: nodes with a parent each, a node seeing what its ancestors hold unless it holds the key itself.

nodes has node_id and parent_id, data has node_id, the key k and the value v; an empty or null v is a tombstone.
The nodes are metadata and answered on the driver; data never leaves the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.errors import OtherError

#: Most node ids that are broadcast; beyond it the join shuffles.
BROADCAST_NODES = 1_000_000


def _parents(nodes: DataFrame) -> dict[int, int | None]:
    return {r["node_id"]: r["parent_id"] for r in nodes.select("node_id", "parent_id").collect()}


def chain(nodes: DataFrame, head: int) -> list[int] | None:
    """head and its ancestors, nearest first; None if they form a cycle or head is unknown."""
    return _line(_parents(nodes), head)


def _line(parents: dict[int, int | None], head: int) -> list[int] | None:
    out: dict[int, None] = {}
    node: int | None = head
    while node is not None and node in parents:
        if node in out:
            return None
        out[node] = None
        node = parents[node]
    return list(out) or None


def dead_value(v: str = "v") -> Column:
    """Whether a value is a tombstone."""
    return F.col(v).isNull() | (F.octet_length(v) == 0)


def _depths(data: DataFrame, line: list[int]) -> DataFrame:
    depths = data.sparkSession.createDataFrame(list(enumerate(line)), T.StructType([T.StructField("depth", T.LongType()), T.StructField("node_id", T.LongType())]))
    return data.join(F.broadcast(depths) if len(line) <= BROADCAST_NODES else depths, "node_id")


def view(nodes: DataFrame, data: DataFrame, head: int) -> DataFrame:
    """k and v as head sees them: the nearest holder of a key wins, tombstones hide it. A cycle shows nothing."""
    return _seen(data, chain(nodes, head))


def _seen(data: DataFrame, line: list[int] | None) -> DataFrame:
    if line is None:
        return data.select("k", "v").limit(0)
    near = _depths(data, line).groupBy("k").agg(F.min_by(F.struct("v"), "depth").alias("_r"))
    return near.select("k", F.col("_r.v").alias("v")).filter(~dead_value())


def get(nodes: DataFrame, data: DataFrame, head: int, key) -> DataFrame:
    return view(nodes, data.filter(F.col("k") == F.lit(key)), head)


def get_local(data: DataFrame, node: int, key) -> DataFrame:
    """The node's own live entry, without its ancestors."""
    return data.filter((F.col("node_id") == node) & (F.col("k") == F.lit(key)) & ~dead_value()).select("k", "v")


def put(data: DataFrame, node: int, entries: DataFrame) -> DataFrame:
    """Set a node's own entries (k, v); empty values are refused when read, as they would be tombstones."""
    ok = entries.withColumn("v", F.when(dead_value(), F.raise_error(F.lit("a value is empty")).cast(entries.schema["v"].dataType)).otherwise(F.col("v")))
    own = ok.select(F.lit(node).cast("long").alias("node_id"), "k", "v")
    return data.join(own.select("node_id", "k"), ["node_id", "k"], "left_anti").unionByName(own.select(*data.columns))


def remove(data: DataFrame, node: int, keys: DataFrame) -> DataFrame:
    """Hide keys in a node by tombstones."""
    own = keys.select("k").distinct().select(F.lit(node).cast("long").alias("node_id"), "k", F.lit("").cast(data.schema["v"].dataType).alias("v"))
    return data.join(own.select("node_id", "k"), ["node_id", "k"], "left_anti").unionByName(own.select(*data.columns))


def child_ids(nodes: DataFrame, node: int) -> list[int]:
    return sorted(r["node_id"] for r in nodes.filter(F.col("parent_id") == node).select("node_id").collect())


def no_children(nodes: DataFrame, node: int) -> bool:
    return nodes.filter(F.col("parent_id") == node).isEmpty()


def is_dead(nodes: DataFrame, data: DataFrame, node: int) -> bool:
    """No live entry, no parent and no children."""
    orphan = nodes.filter((F.col("node_id") == node) & F.col("parent_id").isNotNull()).isEmpty()
    return orphan and no_children(nodes, node) and data.filter((F.col("node_id") == node) & ~dead_value()).isEmpty()


def _below(parents: dict[int, int | None], tops: set[int]) -> set[int]:
    children: dict[int, list[int]] = {}
    for n, p in parents.items():
        if p is not None:
            children.setdefault(p, []).append(n)
    out, todo = set(), list(tops)
    while todo:
        n = todo.pop()
        if n not in out:
            out.add(n)
            todo += children.get(n, [])
    return out


def _without(nodes: DataFrame, data: DataFrame, gone: set[int]) -> tuple[DataFrame, DataFrame]:
    if not gone:
        return nodes, data
    ids = nodes.sparkSession.createDataFrame([(g,) for g in sorted(gone)], "node_id long")
    ids = F.broadcast(ids) if len(gone) <= BROADCAST_NODES else ids
    return nodes.join(ids, "node_id", "left_anti"), data.join(ids, "node_id", "left_anti")


def destroy(nodes: DataFrame, data: DataFrame, node: int) -> tuple[DataFrame, DataFrame]:
    """Drop a node with all its descendants and their data."""
    return _without(nodes, data, _below(_parents(nodes), {node}))


def prune_children(nodes: DataFrame, data: DataFrame, node: int, ids: list[int], exclude: bool = False) -> tuple[DataFrame, DataFrame]:
    """Destroy the node's children in ids (exclude: those not in ids)."""
    own = set(child_ids(nodes, node))
    return _without(nodes, data, _below(_parents(nodes), own - set(ids) if exclude else own & set(ids)))


def prune(nodes: DataFrame, data: DataFrame, head: int) -> tuple[DataFrame, DataFrame, int]:
    """Fold the line from the root to head into the root: new nodes, new data and the root's id.

    Side branches of the line die; head's children become the root's. A head without a parent is itself the root
    and nothing changes. A cycle is an error.
    """
    parents = _parents(nodes)
    line = _line(parents, head)
    if line is None:
        raise OtherError("the chain of parents is a cycle or the node is unknown")
    root, on_line = line[-1], set(line)
    if len(line) == 1:
        return nodes, data, root
    side = {n for n, p in parents.items() if p in on_line and p != head and n not in on_line}
    folded = _seen(data, line).select(F.lit(root).cast("long").alias("node_id"), "k", "v").select(*data.columns)
    kept_nodes, kept_data = _without(nodes, data, _below(parents, side) | on_line - {root})
    moved = F.when(F.col("parent_id") == head, F.lit(root)).otherwise(F.col("parent_id"))
    return kept_nodes.withColumn("parent_id", moved.cast("long")), kept_data.filter(F.col("node_id") != root).unionByName(folded), root

"""Handles of stored collections: ordered and unordered maps, a single value, a slot index.

A handle is an instance of a catalog and its operators. Reads are DataFrames over the current snapshot; writes
make the next snapshot.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.errors import DecodeError, EncodingError, OtherError
from quernstone.operators import kv, overlay, slots
from quernstone.operators.vectors import VectorConfig, VectorIndex
from quernstone.sources.catalog import Catalog, InstanceId, Namespace


class Stored:
    kind = "stored"

    def __init__(self, catalog: Catalog, iid: InstanceId):
        self.catalog, self.iid = catalog, iid
        catalog.handles[iid.ns] = catalog.handles.get(iid.ns, 0) + 1

    def release(self) -> None:
        self.catalog.handles[self.iid.ns] -= 1

    @property
    def instance_id(self) -> InstanceId:
        return self.iid

    @property
    def namespace(self) -> Namespace:
        return Namespace(self.catalog, self.iid.ns)

    def is_the_same_instance(self, other: Stored) -> bool:
        return self.iid == other.iid

    @property
    def df(self) -> DataFrame:
        return self.catalog.read(self.iid)

    def save_meta(self) -> InstanceId:
        self.catalog.commit()
        return self.iid

    def clear(self) -> None:
        self.catalog.clear(self.iid)

    def vacuum(self) -> int:
        return self.catalog.vacuum(self.iid)


class OrderedMap(Stored):
    """Unique keys in order. Any orderable key type but floats; binary keys are ordered as unsigned bytes."""

    kind = "ordered_map"

    def __init__(self, catalog: Catalog, iid: InstanceId, key: str):
        super().__init__(catalog, iid)
        self.key = key

    @classmethod
    def new(cls, catalog: Catalog, schema: T.StructType, key: str, ns: Namespace | None = None) -> OrderedMap:
        if isinstance(schema[key].dataType, (T.FloatType, T.DoubleType)):
            raise EncodingError("floats are no keys")
        return cls(catalog, catalog.new_instance(cls.kind, schema, ns, {"key": key}), key)

    @classmethod
    def from_meta(cls, catalog: Catalog, iid: InstanceId, schema: T.StructType | None = None) -> OrderedMap:
        """Restore a handle; another type than the stored one is refused."""
        return cls(catalog, iid, catalog.instance(iid, cls.kind, schema)["extra"]["key"])

    def clone_in(self, ns: Namespace) -> OrderedMap:
        out = type(self).new(self.catalog, self.df.schema, self.key, ns)
        out._write(self.df)
        return out

    def _write(self, df: DataFrame) -> None:
        self.catalog.write(self.iid, df, self.key)

    def _rows(self, rows: list[tuple]) -> DataFrame:
        return self.catalog.spark.createDataFrame(rows, self.df.schema)

    def get(self, key: Any):
        return kv.get(self.df, self.key, key).first()

    def contains_key(self, key: Any) -> bool:
        return kv.contains_key(self.df, self.key, key)

    def get_le(self, key: Any):
        return kv.floor(self.df, self.key, key).first()

    def get_ge(self, key: Any):
        return kv.ceiling(self.df, self.key, key).first()

    def first(self):
        return kv.first(self.df, self.key).first()

    def last(self):
        return kv.last(self.df, self.key).first()

    def iter(self, reverse: bool = False) -> DataFrame:
        return kv.scan(self.df, self.key, reverse)

    def range(self, low=None, high=None, low_open=False, high_open=False, reverse=False) -> DataFrame:
        return kv.key_range(self.df, self.key, low, high, low_open, high_open, reverse)

    def keys(self) -> DataFrame:
        return kv.keys(self.df, self.key)

    def values(self) -> DataFrame:
        return kv.values(self.df, self.key)

    def insert(self, *row: Any) -> None:
        self._write(kv.upsert(self.df, self._rows([row]), self.key))

    def insert_all(self, rows: DataFrame) -> None:
        self._write(kv.upsert(self.df, rows, self.key))

    def remove(self, key: Any) -> None:
        self._write(self.df.filter(F.col(self.key) != F.lit(key)))

    def or_insert(self, *row: Any) -> None:
        self._write(kv.or_insert(self.df, self._rows([row]), self.key))

    def update(self, where: Column, column: str, value: Column) -> None:
        self._write(kv.update(self.df, where, column, value))

    def batch(self, ops: DataFrame, wiped: bool = False, seq: str = "seq", op: str = "op") -> None:
        """All operations at once: the pointer moves only when everything is written."""
        self._write(kv.apply_batch(self.df, ops, self.key, seq, op, wiped))

    def same_entries(self, other: OrderedMap) -> bool:
        return kv.same_entries(self.df, other.df)

    def __len__(self) -> int:
        return self.df.count()


class Map(OrderedMap):
    """As OrderedMap, but no order is promised."""

    kind = "map"

    def iter(self, reverse: bool = False) -> DataFrame:
        return self.df


class RawMap(OrderedMap):
    """Binary keys and values."""

    kind = "raw_map"
    SCHEMA = T.StructType([T.StructField("k", T.BinaryType(), False), T.StructField("v", T.BinaryType())])

    @classmethod
    def create(cls, catalog: Catalog, ns: Namespace | None = None) -> RawMap:
        return cls.new(catalog, cls.SCHEMA, "k", ns)


class RawKeyMap(OrderedMap):
    """Binary keys `k` and typed values."""

    kind = "raw_key_map"

    @classmethod
    def create(cls, catalog: Catalog, value: T.DataType, ns: Namespace | None = None) -> RawKeyMap:
        return cls.new(catalog, T.StructType([T.StructField("k", T.BinaryType(), False), T.StructField("v", value)]), "k", ns)


class Single(Stored):
    """One stored value with the comparisons and arithmetic of its type; whole-number division truncates."""

    kind = "single"

    @classmethod
    def new(cls, catalog: Catalog, value: Any, kind: T.DataType, ns: Namespace | None = None) -> Single:
        out = cls(catalog, catalog.new_instance(cls.kind, T.StructType([T.StructField("v", kind)]), ns))
        out.set(value)
        return out

    @classmethod
    def from_meta(cls, catalog: Catalog, iid: InstanceId) -> Single:
        catalog.instance(iid, cls.kind)
        return cls(catalog, iid)

    def get(self) -> Any:
        row = self.df.first()
        return row["v"] if row else None

    def set(self, value: Any) -> None:
        self.catalog.write(self.iid, self.catalog.spark.createDataFrame([(value,)], self.df.schema))

    def clone_in(self, ns: Namespace) -> Single:
        return Single.new(self.catalog, self.get(), self.df.schema["v"].dataType, ns)

    def is_uninitialized(self) -> bool:
        return self.get() is None

    def initialize_if_empty(self, value: Any) -> None:
        if self.is_uninitialized():
            self.set(value)

    def update(self, change) -> bool:
        """Read, change and write; nothing is written where the value stays. Whether it changed."""
        old = self.get()
        new = change(old)
        if new != old:
            self.set(new)
        return new != old

    @staticmethod
    def _value(other: Any) -> Any:
        return other.get() if isinstance(other, Single) else other

    def __eq__(self, other: Any) -> bool:
        return self.get() == self._value(other)

    __hash__ = None

    def __lt__(self, other: Any) -> bool:
        return self.get() < self._value(other)

    def __le__(self, other: Any) -> bool:
        return self.get() <= self._value(other)

    def __gt__(self, other: Any) -> bool:
        return self.get() > self._value(other)

    def __ge__(self, other: Any) -> bool:
        return self.get() >= self._value(other)

    def __add__(self, other: Any) -> Any:
        return self.get() + self._value(other)

    def __sub__(self, other: Any) -> Any:
        return self.get() - self._value(other)

    def __mul__(self, other: Any) -> Any:
        return self.get() * self._value(other)

    def __truediv__(self, other: Any) -> Any:
        a, b = self.get(), self._value(other)
        return _truncated(a, b) if isinstance(a, int) and isinstance(b, int) else a / b

    def __mod__(self, other: Any) -> Any:
        a, b = self.get(), self._value(other)
        return a - b * _truncated(a, b) if isinstance(a, int) and isinstance(b, int) else a % b

    def __and__(self, other: Any) -> Any:
        return self.get() & self._value(other)

    def __or__(self, other: Any) -> Any:
        return self.get() | self._value(other)

    def __xor__(self, other: Any) -> Any:
        return self.get() ^ self._value(other)

    def __lshift__(self, other: Any) -> Any:
        return self.get() << self._value(other)

    def __rshift__(self, other: Any) -> Any:
        return self.get() >> self._value(other)

    def __neg__(self) -> Any:
        return -self.get()

    def __invert__(self) -> Any:
        return ~self.get()


def _truncated(a: int, b: int) -> int:
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


class SlotIndex(Stored):
    """Stored (slot, k) entries with tiers kept beside them; the order in storage never changes a result."""

    kind = "slot_index"

    @classmethod
    def new(cls, catalog: Catalog, slot: T.DataType, key: T.DataType, tier_capacity: int = 16, ns: Namespace | None = None, swap_order: bool = False) -> SlotIndex:
        """swap_order keeps the entries in descending order of slots; pages and counts are the same."""
        if tier_capacity < 2:
            raise ValueError("a tier holds at least two stretches")
        schema = T.StructType([T.StructField("slot", slot), T.StructField("k", key)])
        return cls(catalog, catalog.new_instance(cls.kind, schema, ns, {"capacity": tier_capacity, "swap_order": swap_order}))

    @classmethod
    def from_meta(cls, catalog: Catalog, iid: InstanceId, schema: T.StructType | None = None) -> SlotIndex:
        catalog.instance(iid, cls.kind, schema)
        return cls(catalog, iid)

    @property
    def capacity(self) -> int:
        return self.catalog.instance(self.iid)["extra"]["capacity"]

    def insert_batch(self, entries: DataFrame) -> None:
        self._write(slots.insert(self.df, entries))

    def _write(self, df: DataFrame) -> None:
        if self.catalog.instance(self.iid)["extra"].get("swap_order"):
            self.catalog.write(self.iid, df.sortWithinPartitions(F.desc("slot")))
        else:
            self.catalog.write(self.iid, df, "slot")

    def insert(self, slot: Any, key: Any) -> None:
        self.insert_batch(self.catalog.spark.createDataFrame([(slot, key)], self.df.schema))

    def remove(self, slot: Any, key: Any) -> None:
        self._write(self.df.filter(~((F.col("slot") == F.lit(slot)) & (F.col("k") == F.lit(key)))))

    def get_entries_by_page(self, size: int, number: int, reverse: bool = False) -> list:
        return self.get_entries_by_page_slot(None, None, size, number, reverse)

    def get_entries_by_page_slot(self, left: Any, right: Any, size: int, number: int, reverse: bool = False) -> list:
        return [r["k"] for r in slots.page(self.df, "slot", "k", size, number, reverse, left, right).collect()]

    def entry_cnt_within_two_slots(self, left: Any, right: Any) -> int:
        return slots.count(self.df, "slot", left, right)

    def total_by_slot(self, left: Any = None, right: Any = None) -> int:
        return slots.count(self.df, "slot", left, right)

    def total(self) -> int:
        return self.df.count()

    def distance_to_the_leftmost_slot(self, slot: Any) -> int:
        return slots.rank_of(self.df, "slot", slot)

    def distance_to_the_rightmost_slot(self, slot: Any) -> int:
        return slots.rank_of(self.df, "slot", slot, from_right=True)

    def tiers(self) -> DataFrame:
        return slots.tiers(self.df, "slot", self.capacity)


class StoredVectors(Stored):
    """A vector index in the catalog. A restore with another metric or dimension is refused."""

    kind = "vectors"

    @classmethod
    def new(cls, catalog: Catalog, key: T.DataType, config: VectorConfig, ns: Namespace | None = None) -> StoredVectors:
        schema = T.StructType([T.StructField("k", key), T.StructField("vec", T.ArrayType(T.DoubleType()))])
        return cls(catalog, catalog.new_instance(cls.kind, schema, ns, {"config": dict(config.__dict__)}))

    @classmethod
    def from_meta(cls, catalog: Catalog, iid: InstanceId, metric: str | None = None, dim: int | None = None) -> StoredVectors:
        config = catalog.instance(iid, cls.kind)["extra"]["config"]
        if (metric or config["metric"]) != config["metric"] or (dim or config["dim"]) != config["dim"]:
            raise DecodeError(f"instance {iid} is of another metric or dimension")
        return cls(catalog, iid)

    @property
    def index(self) -> VectorIndex:
        """The current snapshot as an index; its changes are kept by store()."""
        return VectorIndex(self.df, VectorConfig(**self.catalog.instance(self.iid)["extra"]["config"]))

    def store(self, index: VectorIndex) -> None:
        self.catalog.write(self.iid, index.df, "k")
        self.catalog.instance(self.iid)["extra"]["config"] = dict(index.config.__dict__)
        self.catalog.commit()


class OverlayMap(Stored):
    """Stored overlay nodes: their parents are metadata of the catalog, their entries one table (node_id, k, v)."""

    kind = "overlay"

    @classmethod
    def new(cls, catalog: Catalog, key: T.DataType, value: T.DataType | None = None, ns: Namespace | None = None) -> OverlayMap:
        schema = T.StructType([T.StructField("node_id", T.LongType()), T.StructField("k", key), T.StructField("v", value or T.StringType())])
        return cls(catalog, catalog.new_instance(cls.kind, schema, ns, {"next_node": 1, "parents": {}}))

    @classmethod
    def from_meta(cls, catalog: Catalog, iid: InstanceId, schema: T.StructType | None = None) -> OverlayMap:
        catalog.instance(iid, cls.kind, schema)
        return cls(catalog, iid)

    @property
    def _meta(self) -> dict:
        return self.catalog.instance(self.iid)["extra"]

    @property
    def nodes(self) -> DataFrame:
        rows = [(int(n), p) for n, p in self._meta["parents"].items()]
        return self.catalog.spark.createDataFrame(rows, "node_id long, parent_id long")

    def _check(self, node: int) -> int:
        if str(node) not in self._meta["parents"]:
            raise OtherError(f"no node {node}")
        return node

    def new_node(self, parent: int | None = None) -> int:
        """A node below a parent, or a root; numbers are never used again."""
        n = self._meta["next_node"]
        self._meta["parents"][str(n)] = None if parent is None else self._check(parent)
        self._meta["next_node"] = n + 1
        self.catalog.commit()
        return n

    def view(self, node: int) -> DataFrame:
        return overlay.view(self.nodes, self.df, self._check(node))

    def get(self, node: int, key: Any):
        return overlay.get(self.nodes, self.df, self._check(node), key).first()

    def insert_all(self, node: int, entries: DataFrame) -> None:
        self.catalog.write(self.iid, overlay.put(self.df, self._check(node), entries), "k")

    def insert(self, node: int, key: Any, value: Any) -> None:
        self.insert_all(node, self.catalog.spark.createDataFrame([(key, value)], T.StructType(self.df.schema.fields[1:])))

    def remove_all(self, node: int, keys: DataFrame) -> None:
        self.catalog.write(self.iid, overlay.remove(self.df, self._check(node), keys), "k")

    def remove(self, node: int, key: Any) -> None:
        self.remove_all(node, self.catalog.spark.createDataFrame([(key,)], T.StructType([self.df.schema["k"]])))

    def child_ids(self, node: int) -> list[int]:
        return sorted(int(n) for n, p in self._meta["parents"].items() if p == node)

    def no_children(self, node: int) -> bool:
        return not self.child_ids(node)

    def is_dead(self, node: int) -> bool:
        return overlay.is_dead(self.nodes, self.df, self._check(node))

    def _keep(self, nodes: DataFrame, data: DataFrame) -> None:
        parents = {str(r["node_id"]): r["parent_id"] for r in nodes.collect()}
        self.catalog.write(self.iid, data, "k")
        self._meta["parents"] = parents
        self.catalog.commit()

    def destroy(self, node: int) -> None:
        self._keep(*overlay.destroy(self.nodes, self.df, self._check(node)))

    def prune(self, head: int) -> int:
        """Fold the line down to head into its root; the root's number."""
        nodes, data, root = overlay.prune(self.nodes, self.df, self._check(head))
        self._keep(nodes, data)
        return root

    def prune_children(self, node: int, ids: list[int], exclude: bool = False) -> None:
        self._keep(*overlay.prune_children(self.nodes, self.df, self._check(node), ids, exclude))

"""Copy-on-write snapshots of a keyed table: every change gives a new root, old roots stay readable.

A root is a chain of delta folders; 0 is the empty table. Roots are counted by who holds them, and folders that
no held root names are deleted by gc().
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.errors import OtherError
from quernstone.operators import kv, versioned
from quernstone.sources import files
from quernstone.sources.catalog import Catalog, InstanceId, Namespace
from quernstone.sources.collections import Stored

EMPTY_ROOT = 0
#: A longer chain of deltas is written anew as one folder.
CHAIN = 16


class SnapshotTree(Stored):
    kind = "snapshot_tree"

    @classmethod
    def new(cls, catalog: Catalog, schema: T.StructType, key: str, ns: Namespace | None = None) -> SnapshotTree:
        return cls(catalog, catalog.new_instance(cls.kind, schema, ns, {"key": key, "next_root": 1, "roots": {}}))

    @classmethod
    def from_meta(cls, catalog: Catalog, iid: InstanceId, schema: T.StructType | None = None) -> SnapshotTree:
        catalog.instance(iid, cls.kind, schema)
        return cls(catalog, iid)

    @property
    def _meta(self) -> dict:
        return self.catalog.instance(self.iid)["extra"]

    @property
    def key(self) -> str:
        return self._meta["key"]

    @property
    def schema(self) -> T.StructType:
        import json

        return T.StructType.fromJson(json.loads(self.catalog.instance(self.iid)["schema"]))

    @property
    def _dir(self) -> str:
        return f"{self.namespace.path}/{self.iid.map_id}"

    def _chain(self, root: int) -> list[str]:
        if root == EMPTY_ROOT:
            return []
        if str(root) not in self._meta["roots"]:
            raise OtherError(f"no root {root}")
        return self._meta["roots"][str(root)]["chain"]

    def at(self, root: int) -> DataFrame:
        """The table at a root."""
        spark, out = self.catalog.spark, None
        schema = T.StructType([*self.schema.fields, T.StructField("op", T.StringType())])
        for i, path in enumerate(self._chain(root)):
            d = spark.read.schema(schema).parquet(path).withColumn("seq", F.lit(i))
            out = d if out is None else out.unionByName(d)
        return spark.createDataFrame([], self.schema) if out is None else versioned.snapshot(out, self.key, self.schema.fieldNames())

    def _write(self, base: list[str], delta: DataFrame) -> int:
        root = self._meta["next_root"]
        self._meta["next_root"] = root + 1
        path = f"{self._dir}/root-{root:08d}"
        files.delete(self.catalog.spark, path)
        delta.select(*self.schema.fieldNames(), "op").sortWithinPartitions(self.key).write.parquet(path)
        chain = [*base, path]
        self._meta["roots"][str(root)] = {"chain": chain, "refs": 1}
        if len(chain) > CHAIN:
            full = f"{self._dir}/full-{root:08d}"
            files.delete(self.catalog.spark, full)
            self.at(root).withColumn("op", F.lit("P")).sortWithinPartitions(self.key).write.parquet(full)
            self._meta["roots"][str(root)]["chain"] = [full]
        self.catalog.commit()
        return root

    def get(self, root: int, key: Any):
        return kv.get(self.at(root), self.key, key).first()

    def contains_key(self, root: int, key: Any) -> bool:
        return self.get(root, key) is not None

    def iter(self, root: int) -> DataFrame:
        return kv.scan(self.at(root), self.key)

    def range(self, root: int, low=None, high=None, low_open=False, high_open=False) -> DataFrame:
        return kv.key_range(self.at(root), self.key, low, high, low_open, high_open)

    def insert(self, root: int, *row: Any) -> int:
        """A new root always, even for an entry that is there already."""
        return self.insert_all(root, self.catalog.spark.createDataFrame([row], self.schema))

    def insert_all(self, root: int, rows: DataFrame) -> int:
        return self._write(self._chain(root), rows.withColumn("op", F.lit("P")))

    def remove(self, root: int, key: Any) -> int:
        """A new root, the same one if the key is absent, or EMPTY_ROOT if nothing is left."""
        state = self.at(root)
        if not kv.contains_key(state, self.key, key):
            return root
        if state.filter(F.col(self.key) != F.lit(key)).isEmpty():
            return EMPTY_ROOT
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name != self.key]
        gone = self.catalog.spark.createDataFrame([(key,)], T.StructType([self.schema[self.key]]))
        return self._write(self._chain(root), gone.select(self.key, *rest, F.lit("D").alias("op")))

    def bulk_load(self, rows: DataFrame, order: str | None = None) -> int:
        """A root of many entries. With order (a column that numbers the rows) keys must not descend, and of equal
        keys the last stays; else keys are unique and in any order."""
        if rows.isEmpty():
            return EMPTY_ROOT
        if order:
            stretch = F.floor(F.col(order) / 100_000)
            near = rows.withColumn("_s", stretch)
            before = F.lag(self.key).over(Window.partitionBy("_s").orderBy(order))
            ends = near.groupBy("_s").agg(F.min_by(self.key, order).alias("first"), F.max_by(self.key, order).alias("last"))
            seam = ends.withColumn("before", F.lag("last").over(Window.orderBy("_s"))).filter(F.col("before") > F.col("first"))
            if not near.withColumn("_b", before).filter(F.col("_b") > F.col(self.key)).isEmpty() or not seam.isEmpty():
                raise OtherError("the entries are not in key order")
            rows = kv.last_per_key(rows, self.key, order)
        return self._write([], rows.select(*self.schema.fieldNames()).withColumn("op", F.lit("P")))

    def acquire(self, root: int) -> None:
        if root != EMPTY_ROOT:
            self._chain(root)
            self._meta["roots"][str(root)]["refs"] += 1
            self.catalog.commit()

    def release(self, root: int | None = None) -> None:
        """Give up a root (without one: the handle); a root that nobody holds is forgotten."""
        if root is None:
            super().release()
        elif root != EMPTY_ROOT:
            self._chain(root)
            row = self._meta["roots"][str(root)]
            row["refs"] -= 1
            if row["refs"] <= 0:
                del self._meta["roots"][str(root)]
            self.catalog.commit()

    def rebuild_ref_counts(self, live: list[int]) -> None:
        """Hold exactly the live roots, once for each time they are named."""
        roots = {str(r): self._meta["roots"][str(r)] for r in live if r != EMPTY_ROOT and str(r) in self._meta["roots"]}
        for r, row in roots.items():
            row["refs"] = sum(str(x) == r for x in live)
        self._meta["roots"] = roots
        self.catalog.commit()

    def gc(self) -> int:
        """Delete the folders that no root names; their number."""
        live = {p for row in self._meta["roots"].values() for p in row["chain"]}
        gone = [f"{self._dir}/{c}" for c in files.children(self.catalog.spark, self._dir) if f"{self._dir}/{c}" not in live]
        for p in gone:
            files.delete(self.catalog.spark, p)
        return len(gone)

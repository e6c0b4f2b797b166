"""Namespaces, instances and their snapshots.

A catalog is one JSON file that is replaced as a whole. An instance's data are Parquet snapshot folders; a
write makes a new folder and then moves the instance's pointer, so readers of the old snapshot go on.
"""

from __future__ import annotations

import contextlib
import contextvars
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quernstone.errors import BaseDirFrozen, DecodeError, NamespaceError
from quernstone.sources import files

_ambient: contextvars.ContextVar[int] = contextvars.ContextVar("namespace", default=0)


@dataclass(frozen=True)
class InstanceId:
    """A map's number and its namespace; written `42` or `42@1`, the default namespace being 0."""

    map_id: int
    ns: int = 0

    def __str__(self) -> str:
        return f"{self.map_id}@{self.ns}" if self.ns else str(self.map_id)

    @classmethod
    def parse(cls, text: str) -> InstanceId:
        head, _, tail = text.partition("@")
        try:
            return cls(int(head), int(tail) if tail else 0)
        except ValueError:
            raise DecodeError(f"not an instance id: {text}") from None


def fingerprint(kind: str, schema: T.StructType) -> str:
    """Names a kind and its exact column types; a restore with another one is refused."""
    return hashlib.sha256(f"{kind} {schema.simpleString()}".encode()).hexdigest()[:16]


class Namespace:
    """A group of instances in a folder of its own."""

    def __init__(self, catalog: Catalog, ns: int):
        self.catalog, self.id = catalog, ns

    @property
    def path(self) -> str:
        return self.catalog.state["namespaces"][str(self.id)]["path"]

    @property
    def options(self) -> dict:
        return self.catalog.state["namespaces"][str(self.id)]["options"]

    @property
    def system_dir(self) -> str:
        return f"{self.path}/system"

    @property
    def meta_dir(self) -> str:
        return f"{self.path}/meta"

    def meta_path(self, instance: InstanceId) -> str:
        return f"{self.meta_dir}/{instance.map_id}.json"

    @contextlib.contextmanager
    def scope(self) -> Iterator[Namespace]:
        """New instances go here within the block; scopes nest."""
        token = _ambient.set(self.id)
        try:
            yield self
        finally:
            _ambient.reset(token)

    def close(self) -> None:
        """Forget the open namespace; refused for the default one and while instances are in use."""
        if self.id == 0 or self.catalog.handles.get(self.id, 0) > 0:
            raise NamespaceError("the namespace is in use")
        self.catalog.open_ids.discard(self.id)

    def properties(self) -> dict:
        """How many instances and snapshot folders it has."""
        own = [x for x in self.catalog.state["instances"].values() if x["ns"] == self.id]
        return {"instances": len(own), "snapshots": sum(len(files.children(self.catalog.spark, f"{self.path}/{x['map_id']}")) for x in own)}

    def flush(self) -> None:
        """Writes are durable when they return; there is nothing to wait for."""


class Catalog:
    def __init__(self, spark: SparkSession, base_dir: str):
        self.spark, self._base, self._used = spark, base_dir.rstrip("/"), False
        self.open_ids: set[int] = {0}
        self.handles: dict[int, int] = {}
        self._state: dict | None = None

    # -- base folder and state ---------------------------------------------------------------------------

    @property
    def base_dir(self) -> str:
        return self._base

    def set_base_dir(self, path: str) -> None:
        """Only before first use."""
        if self._used:
            raise BaseDirFrozen("the base folder is in use")
        self._base = path.rstrip("/")

    @property
    def _file(self) -> str:
        return f"{self._base}/catalog.json"

    @property
    def state(self) -> dict:
        self._used = True
        if self._state is None:
            if files.exists(self.spark, self._file):
                self._state = json.loads(files.read_text(self.spark, self._file))
            else:
                self._state = {"next_map": 1, "next_ns": 1, "namespaces": {"0": {"path": f"{self._base}/default", "options": {}}}, "instances": {}}
        return self._state

    def commit(self) -> None:
        files.write_text(self.spark, self._file, json.dumps(self.state, indent=1, sort_keys=True))

    # -- namespaces --------------------------------------------------------------------------------------

    def default_ns(self) -> Namespace:
        return Namespace(self, 0)

    def current(self) -> Namespace:
        return Namespace(self, _ambient.get())

    def create_ns(self, path: str | None = None, **options) -> Namespace:
        ns = self.state["next_ns"]
        path = (path or f"{self._base}/ns{ns}").rstrip("/")
        if any(x["path"] == path for x in self.state["namespaces"].values()):
            raise NamespaceError(f"another namespace is at {path}")
        self.state["next_ns"] = ns + 1
        self.state["namespaces"][str(ns)] = {"path": path, "options": options}
        self.commit()
        self.open_ids.add(ns)
        return Namespace(self, ns)

    def open_ns(self, ns: int) -> Namespace:
        if str(ns) not in self.state["namespaces"]:
            raise NamespaceError(f"no namespace {ns}")
        self.open_ids.add(ns)
        return Namespace(self, ns)

    def list_ns(self) -> list[dict]:
        """All but the default one."""
        return [{"id": int(k), "path": v["path"], "open": int(k) in self.open_ids} for k, v in sorted(self.state["namespaces"].items(), key=lambda x: int(x[0])) if k != "0"]

    def destroy_ns(self, ns: int) -> None:
        """Drop a closed namespace with all its data."""
        if ns == 0 or ns in self.open_ids:
            raise NamespaceError("the namespace is open")
        if str(ns) not in self.state["namespaces"]:
            raise NamespaceError(f"no namespace {ns}")
        path = self.state["namespaces"].pop(str(ns))["path"]
        self.state["instances"] = {k: v for k, v in self.state["instances"].items() if v["ns"] != ns}
        self.commit()
        files.delete(self.spark, path)

    def relocate_ns(self, ns: int, path: str) -> None:
        """Point a closed namespace to data that were moved already."""
        if ns == 0 or ns in self.open_ids or str(ns) not in self.state["namespaces"]:
            raise NamespaceError("the namespace is open or unknown")
        old = self.state["namespaces"][str(ns)]["path"]
        used = any(v["ns"] == ns and v["snapshot"] for v in self.state["instances"].values())
        if used and not files.exists(self.spark, path):
            raise NamespaceError(f"no data at {path}")
        self.state["namespaces"][str(ns)]["path"] = path.rstrip("/")
        for v in self.state["instances"].values():
            if v["ns"] == ns and v["snapshot"]:
                v["snapshot"] = v["snapshot"].replace(old, path.rstrip("/"), 1)
        self.commit()

    # -- instances ---------------------------------------------------------------------------------------

    def new_instance(self, kind: str, schema: T.StructType, ns: Namespace | None = None, extra: dict | None = None) -> InstanceId:
        """Numbers are never used again."""
        ns = ns or self.current()
        n = self.state["next_map"]
        self.state["next_map"] = n + 1
        out = InstanceId(n, ns.id)
        self.state["instances"][str(out)] = {"map_id": n, "ns": ns.id, "kind": kind, "schema": schema.json(), "fingerprint": fingerprint(kind, schema), "snapshot": None, "version": 0, "extra": extra or {}}
        self.commit()
        return out

    def instance(self, iid: InstanceId, kind: str | None = None, schema: T.StructType | None = None) -> dict:
        row = self.state["instances"].get(str(iid))
        if row is None:
            raise DecodeError(f"no instance {iid}")
        if kind is not None and row["fingerprint"] != fingerprint(kind, schema or T.StructType.fromJson(json.loads(row["schema"]))):
            raise DecodeError(f"instance {iid} is of another type")
        return row

    def read(self, iid: InstanceId) -> DataFrame:
        row = self.instance(iid)
        schema = T.StructType.fromJson(json.loads(row["schema"]))
        return self.spark.read.schema(schema).parquet(row["snapshot"]) if row["snapshot"] else self.spark.createDataFrame([], schema)

    def write(self, iid: InstanceId, df: DataFrame, key: str | None = None) -> None:
        """Write the next snapshot, clustered by key so that range reads skip row groups, and move the pointer to it."""
        row = self.instance(iid)
        path = f"{Namespace(self, iid.ns).path}/{iid.map_id}/v{row['version'] + 1:08d}"
        files.delete(self.spark, path)
        (df.sortWithinPartitions(key) if key else df).write.parquet(path)
        row["version"], row["snapshot"] = row["version"] + 1, path
        self.commit()

    def clear(self, iid: InstanceId) -> None:
        self.instance(iid)["snapshot"] = None
        self.commit()

    def vacuum(self, iid: InstanceId) -> int:
        """Delete the snapshot folders that no pointer names; their number."""
        row = self.instance(iid)
        base = f"{Namespace(self, iid.ns).path}/{iid.map_id}"
        gone = [c for c in files.children(self.spark, base) if f"{base}/{c}" != row["snapshot"]]
        for c in gone:
            files.delete(self.spark, f"{base}/{c}")
        return len(gone)

"""Git-like versioning of a keyed table: branches, commits, time travel, diff, three-way merge, rollback and GC.

Metadata (commits, branches, version tokens) are a small JSON document in the catalog. Data are one delta
folder for each commit against its first parent, with a full snapshot every so many commits, so a state is the last
operation of each key over a bounded chain. A branch's uncommitted work is a chain of deltas of its own.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.errors import BranchAlreadyExists, BranchNotFound, CannotDeleteMainBranch, CommitNotFound, OtherError, UncommittedChanges
from quernstone.operators import kv, versioned
from quernstone.plans import history
from quernstone.sources import files
from quernstone.sources.catalog import Catalog, InstanceId, Namespace

#: A commit with so long a chain of deltas below it is written as a full snapshot.
CHAIN = 16


@dataclass(frozen=True)
class Commit:
    id: int
    parents: tuple[int, ...]
    timestamp_us: int
    version: int
    ref_count: int = 0


class Repository:
    kind = "repository"

    def __init__(self, catalog: Catalog, iid: InstanceId):
        self.catalog, self.iid, self.spark = catalog, iid, catalog.spark

    @classmethod
    def new(cls, catalog: Catalog, schema: T.StructType, key: str, main: str = "main", ns: Namespace | None = None) -> Repository:
        """An empty repository with one protected branch, number 1."""
        extra = {"key": key, "main": 1, "next_branch": 2, "next_commit": 1, "next_version": 1, "commits": {}, "branches": {"1": {"name": main, "head": 0, "token": 0, "dirty": []}}}
        return cls(catalog, catalog.new_instance(cls.kind, schema, ns, extra))

    @classmethod
    def from_meta(cls, catalog: Catalog, iid: InstanceId, schema: T.StructType | None = None) -> Repository:
        catalog.instance(iid, cls.kind, schema)
        return cls(catalog, iid)

    # -- metadata ----------------------------------------------------------------------------------------

    @property
    def instance_id(self) -> InstanceId:
        return self.iid

    @property
    def namespace(self) -> Namespace:
        return Namespace(self.catalog, self.iid.ns)

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

    def _graph(self) -> history.Graph:
        return {int(k): v["parents"] for k, v in self._meta["commits"].items()}

    def _branch(self, branch: int) -> dict:
        row = self._meta["branches"].get(str(branch))
        if row is None:
            raise BranchNotFound(f"no branch {branch}")
        return row

    def _commit_row(self, commit: int) -> dict:
        row = self._meta["commits"].get(str(commit))
        if row is None:
            raise CommitNotFound(f"no commit {commit}")
        return row

    def _new_version(self) -> int:
        n = self._meta["next_version"]
        self._meta["next_version"] = n + 1
        return n

    def _token(self, commit: int) -> int:
        """The version of a commit's state; 0 is the empty map."""
        return self._meta["commits"][str(commit)]["version"] if commit else 0

    # -- branches ----------------------------------------------------------------------------------------

    def main_branch(self) -> int:
        return self._meta["main"]

    def set_main_branch(self, branch: int) -> None:
        self._branch(branch)
        self._meta["main"] = branch
        self.catalog.commit()

    def list_branches(self) -> list[tuple[int, str]]:
        return sorted((int(k), v["name"]) for k, v in self._meta["branches"].items())

    def branch_id(self, name: str) -> int | None:
        return next((i for i, n in self.list_branches() if n == name), None)

    def branch_name(self, branch: int) -> str | None:
        row = self._meta["branches"].get(str(branch))
        return row["name"] if row else None

    def create_branch(self, name: str, source: int) -> int:
        """Fork head and uncommitted work; no data are copied."""
        row = self._branch(source)
        if self.branch_id(name) is not None:
            raise BranchAlreadyExists(name)
        n = self._meta["next_branch"]
        self._meta["next_branch"] = n + 1
        self._meta["branches"][str(n)] = {"name": name, "head": row["head"], "token": row["token"], "dirty": list(row["dirty"])}
        self.catalog.commit()
        return n

    def delete_branch(self, branch: int) -> None:
        self._branch(branch)
        if branch == self.main_branch():
            raise CannotDeleteMainBranch(self.branch_name(branch))
        del self._meta["branches"][str(branch)]
        self._drop_unreachable()
        self.catalog.commit()

    def branch(self, branch: int) -> Branch:
        self._branch(branch)
        return Branch(self, branch)

    def main(self) -> Branch:
        return self.branch(self.main_branch())

    # -- states ------------------------------------------------------------------------------------------

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], self.schema)

    def _delta(self, path: str, seq: int) -> DataFrame:
        """A delta folder with its place in the chain; a snapshot folder is all puts."""
        schema = T.StructType([*self.schema.fields, T.StructField("op", T.StringType())])
        return self.spark.read.schema(schema).parquet(path).withColumn("seq", F.lit(seq))

    def _chain(self, commit: int) -> list[str]:
        """Folders from the nearest full snapshot up to a commit."""
        out: list[str] = []
        while commit:
            row = self._commit_row(commit)
            out[:0] = row["deltas"]
            if row["full"]:
                break
            commit = row["parents"][0] if row["parents"] else 0
        return out

    def _state(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self._empty()
        out = None
        for i, p in enumerate(paths):
            d = self._delta(p, i)
            out = d if out is None else out.unionByName(d)
        return versioned.snapshot(out, self.key, self.schema.fieldNames())

    def at(self, commit: int) -> DataFrame:
        """The table at a commit."""
        self._commit_row(commit)
        return self._state(self._chain(commit))

    def working(self, branch: int) -> DataFrame:
        """The table of a branch with its uncommitted work."""
        row = self._branch(branch)
        return self._state(self._chain(row["head"]) + row["dirty"])

    def get(self, branch: int, key: Any):
        return kv.get(self.working(branch), self.key, key).first()

    def contains_key(self, branch: int, key: Any) -> bool:
        return self.get(branch, key) is not None

    def iter(self, branch: int) -> DataFrame:
        return kv.scan(self.working(branch), self.key)

    def range(self, branch: int, low=None, high=None, low_open=False, high_open=False) -> DataFrame:
        return kv.key_range(self.working(branch), self.key, low, high, low_open, high_open)

    def get_at_commit(self, commit: int, key: Any):
        return kv.get(self.at(commit), self.key, key).first()

    def contains_key_at_commit(self, commit: int, key: Any) -> bool:
        return self.get_at_commit(commit, key) is not None

    def iter_at_commit(self, commit: int) -> DataFrame:
        return kv.scan(self.at(commit), self.key)

    def range_at_commit(self, commit: int, low=None, high=None, low_open=False, high_open=False) -> DataFrame:
        return kv.key_range(self.at(commit), self.key, low, high, low_open, high_open)

    # -- uncommitted work --------------------------------------------------------------------------------

    def has_uncommitted(self, branch: int) -> bool:
        """Whether the version differs from the head's; equal contents under another version count as work."""
        row = self._branch(branch)
        return row["token"] != self._token(row["head"])

    def _stage(self, branch: int, delta: DataFrame) -> None:
        row = self._branch(branch)
        version = self._new_version()
        path = f"{self._dir}/delta-{version:08d}"
        files.delete(self.spark, path)
        delta.select(*self.schema.fieldNames(), "op").sortWithinPartitions(self.key).write.parquet(path)
        row["dirty"].append(path)
        row["token"] = version
        self.catalog.commit()

    def insert(self, branch: int, *values: Any) -> None:
        self.insert_all(branch, self.spark.createDataFrame([values], self.schema))

    def insert_all(self, branch: int, rows: DataFrame) -> None:
        """Stage upserts with unique keys."""
        self._branch(branch)
        self._stage(branch, rows.withColumn("op", F.lit("P")))

    def remove(self, branch: int, key: Any) -> None:
        self.remove_all(branch, self.spark.createDataFrame([(key,)], T.StructType([self.schema[self.key]])))

    def remove_all(self, branch: int, keys: DataFrame) -> None:
        """Stage deletions; if no key is there the version stays. An emptied table is version 0 again."""
        state = self.working(branch)
        gone = kv.contained(keys.select(self.key).distinct(), state, self.key)
        if gone.isEmpty():
            return
        rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema if f.name != self.key]
        self._stage(branch, gone.select(self.key, *rest, F.lit("D").alias("op")))
        if self.working(branch).isEmpty():
            self._branch(branch)["token"] = 0
            self.catalog.commit()

    def discard(self, branch: int) -> None:
        row = self._branch(branch)
        row["dirty"], row["token"] = [], self._token(row["head"])
        self.catalog.commit()

    def _add_commit(self, parents: list[int], deltas: list[str], version: int, full: bool) -> int:
        n = self._meta["next_commit"]
        self._meta["next_commit"] = n + 1
        self._meta["commits"][str(n)] = {"parents": parents, "timestamp_us": time.time_ns() // 1000, "version": version, "deltas": deltas, "full": full}
        return n

    def _full(self, state: DataFrame) -> list[str]:
        path = f"{self._dir}/full-{self._new_version():08d}"
        files.delete(self.spark, path)
        state.withColumn("op", F.lit("P")).sortWithinPartitions(self.key).write.parquet(path)
        return [path]

    def commit(self, branch: int) -> int:
        """Commit the work of a branch, be it empty; the new commit's number."""
        row = self._branch(branch)
        deltas, full = list(row["dirty"]), False
        if len(self._chain(row["head"])) + len(deltas) > CHAIN:
            deltas, full = self._full(self.working(branch)), True
        n = self._add_commit([row["head"]] if row["head"] else [], deltas, row["token"], full)
        row["head"], row["dirty"] = n, []
        self.catalog.commit()
        return n

    # -- history -----------------------------------------------------------------------------------------

    def get_commit(self, commit: int) -> Commit | None:
        row = self._meta["commits"].get(str(commit))
        if row is None:
            return None
        heads = [b["head"] for b in self._meta["branches"].values()]
        return Commit(commit, tuple(row["parents"]), row["timestamp_us"], row["version"], history.references(self._graph(), heads)[commit])

    def head_commit(self, branch: int) -> Commit | None:
        return self.get_commit(self._branch(branch)["head"])

    def log(self, branch: int) -> list[Commit]:
        return [self.get_commit(c) for c in history.log(self._graph(), self._branch(branch)["head"])]

    def find_merge_bases(self, a: int, b: int) -> list[int]:
        return history.merge_bases(self._graph(), a, b)

    def fork_point(self, a: int, b: int) -> int | None:
        return history.fork_point(self._graph(), a, b)

    find_common_ancestor = fork_point

    def commit_distance(self, start: int, ancestor: int) -> int | None:
        return history.distance(self._graph(), start, ancestor)

    def diff_commits(self, old: int, new: int) -> DataFrame:
        """Differences in key order; nothing is read where the versions are the same."""
        if self._commit_row(old)["version"] == self._commit_row(new)["version"]:
            return versioned.diff(self._empty(), self._empty(), self.key)
        return versioned.diff(self.at(old), self.at(new), self.key).orderBy(self.key)

    def diff_uncommitted(self, branch: int) -> DataFrame:
        row = self._branch(branch)
        if not self.has_uncommitted(branch):
            return versioned.diff(self._empty(), self._empty(), self.key)
        return versioned.diff(self._state(self._chain(row["head"])), self.working(branch), self.key).orderBy(self.key)

    # -- merge, rollback, GC -----------------------------------------------------------------------------

    def merge(self, source: int, target: int) -> int:
        """Merge source into target, the source winning; the target's head afterwards."""
        if source == target:
            raise OtherError("a branch is not merged with itself")
        s, t = self._branch(source), self._branch(target)
        for b in (source, target):
            if self.has_uncommitted(b):
                raise UncommittedChanges(self.branch_name(b))
        if not s["head"]:
            raise OtherError("the source has no commits")
        if s["head"] == t["head"]:
            return t["head"]
        if not t["head"]:
            t["head"], t["token"], t["dirty"] = s["head"], s["token"], []
            self.catalog.commit()
            return t["head"]
        bases = self.find_merge_bases(s["head"], t["head"])
        tokens = [self._token(b) for b in bases] or [0]
        parents = [t["head"], s["head"]]
        if s["token"] == t["token"] or (len(tokens) == 1 and tokens[0] == s["token"]):
            n = self._add_commit(parents, [], t["token"], False)  # the source brings nothing new
        elif len(tokens) == 1 and tokens[0] == t["token"]:
            n = self._add_commit(parents, self._full(self.at(s["head"])), s["token"], True)
        else:
            merged = versioned.merge_many([self.at(b) for b in bases], self.at(s["head"]), self.at(t["head"]), self.key)
            change = versioned.diff(self.at(t["head"]), merged, self.key)
            rest = [c for c in self.schema.fieldNames() if c != self.key]
            op = F.when(F.col("change") == "Removed", "D").otherwise("P").alias("op")
            version = self._new_version()
            path = f"{self._dir}/delta-{version:08d}"
            change.select(self.key, *[F.col(f"new_value.{c}").alias(c) for c in rest], op).write.parquet(path)
            if len(self._chain(t["head"])) + 1 > CHAIN:
                n = self._add_commit(parents, self._full(merged), version, True)
            else:
                n = self._add_commit(parents, [path], version, False)
        t["head"], t["token"] = n, self._token(n)
        self.catalog.commit()
        return n

    def rollback_to(self, branch: int, commit: int) -> None:
        """Move a branch back to an ancestor by any parent; commits that nothing refers to any more are dropped."""
        row = self._branch(branch)
        self._commit_row(commit)
        if not row["head"]:
            raise OtherError("the branch has no commits")
        if self.has_uncommitted(branch):
            raise UncommittedChanges(row["name"])
        if commit == row["head"]:
            return
        if commit not in history.ancestors(self._graph(), row["head"]):
            raise OtherError(f"{commit} is no ancestor")
        row["head"], row["token"], row["dirty"] = commit, self._token(commit), []
        self._drop_unreachable()
        self.catalog.commit()

    def _drop_unreachable(self) -> None:
        """Forget commits that no head reaches, as a chain of reference counts would."""
        live = history.reachable(self._graph(), [b["head"] for b in self._meta["branches"].values()])
        self._meta["commits"] = {k: v for k, v in self._meta["commits"].items() if int(k) in live}

    def gc(self) -> int:
        """Delete the folders that no commit and no branch names; their number."""
        self._drop_unreachable()
        self.catalog.commit()
        live = {p for v in self._meta["commits"].values() for p in v["deltas"]} | {p for b in self._meta["branches"].values() for p in b["dirty"]}
        gone = [f"{self._dir}/{c}" for c in files.children(self.spark, self._dir) if f"{self._dir}/{c}" not in live]
        for p in gone:
            files.delete(self.spark, p)
        return len(gone)


class Branch:
    """The repository's methods bound to one branch."""

    def __init__(self, repository: Repository, branch: int):
        self.repository, self.id = repository, branch

    @property
    def name(self) -> str:
        return self.repository.branch_name(self.id)

    def __getattr__(self, name: str):
        allowed = {"get", "contains_key", "iter", "range", "has_uncommitted", "head_commit", "log", "diff_uncommitted", "working", "insert", "insert_all", "remove", "remove_all", "commit", "discard", "rollback_to"}
        if name not in allowed:
            raise AttributeError(name)
        method = getattr(self.repository, name)
        return lambda *a, **k: method(self.id, *a, **k)

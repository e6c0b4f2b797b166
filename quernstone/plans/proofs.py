"""Merkle roots and proofs of a repository's branches and commits.

Parts' hashes of the last state are kept; the next state's root hashes only the parts that the difference touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.errors import TrieError
from quernstone.functions import codec
from quernstone.operators import trie, versioned
from quernstone.plans.repository import Repository


def entries(df: DataFrame, key: str) -> DataFrame:
    """k and v as bytes: ordered key bytes; binary and text values as they are, others as their JSON."""
    def code(field: T.StructField):
        c, kind = F.col(field.name), field.dataType.simpleString()
        if kind == "binary":
            return c
        return codec.encode_int(c, kind) if kind in codec.WIDTHS else codec.encode_string(c.cast("string"))

    rest = [f for f in df.schema if f.name != key]
    value = code(rest[0]) if len(rest) == 1 else codec.encode_string(F.to_json(F.struct(*[f.name for f in rest])))
    return df.select(code(df.schema[key]).alias("k"), F.coalesce(value, F.lit(b"")).alias("v"))


class ProvenRepository:
    def __init__(self, repository: Repository, kind: str = "smt", part_rows: int = trie.PART_ROWS):
        self.map, self.kind, self.part_rows = repository, kind, part_rows
        self._tree: trie.TrieCalculator | None = None
        self._state: DataFrame | None = None
        self._at: tuple | None = None

    def _sync(self, state: DataFrame, at: tuple) -> None:
        """Bring the tree to a state: by the difference from the last one, or anew."""
        if self._at == at:
            return
        new = entries(state, self.map.key)
        if self._tree is None:
            self._tree = trie.TrieCalculator(new, self.kind, self.part_rows)
        else:
            change = versioned.diff(entries(self._state, self.map.key), new, "k")
            self._tree.batch_update(change.select("k", F.col("new_value.v").alias("v")))
        self._state, self._at = state, at

    def merkle_root(self, branch: int) -> bytes:
        """Root of a branch with its uncommitted work."""
        self._sync(self.map.working(branch), ("token", self.map._branch(branch)["token"]))
        return self._tree.root_hash()

    def merkle_root_at_commit(self, commit: int) -> bytes:
        self._sync(self.map.at(commit), ("token", self.map._commit_row(commit)["version"]))
        return self._tree.root_hash()

    def prove(self, key: bytes):
        """Proof for the state that was last asked for its root."""
        if self._tree is None:
            raise TrieError("ask for a root first")
        return self._tree.prove(key)

    def verify_proof(self, root: bytes, key: bytes, proof) -> bool:
        return trie.TrieCalculator.verify(self._tree, root, key, proof)

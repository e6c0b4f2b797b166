"""Approximate nearest neighbours by a hash-prefix forest (operator 6).

Each tree hashes vectors to long bit strings by the signs of random projections and keeps them in a sorted
array. A query descends to its longest matching prefix in every tree; then all trees ascend together, one
bit at a time, until the prefix ranges hold enough candidates. Ranges only grow on the way up, so the depth
at which the ascent ends is found by bisection. Candidates are scored by their exact cosine.

Rows are dealt into blocks by a hash of their id, each with a forest of its own; a block of queries visits all
of them. No range is cut off: a range that holds many copies is scored whole, and bounded by its block.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Trees, and bits of their strings (at most 32). More trees let the ascent end at longer prefixes.
TREES, BITS = 192, 24
#: The trees ascend until their ranges hold so many times the block's rows (a row counts once for each tree).
REACH = 0.4
#: Rows of a block, and queries of a block of queries.
BLOCK_ROWS, QUERY_ROWS = 8192, 4096
SEED = 20240607


class Forest:
    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.trees, self.bits, self.n = trees, bits, len(x)
        self.planes = np.random.default_rng(seed).standard_normal((trees, x.shape[1], bits))
        codes = self.codes(x)
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(codes, self.order, axis=1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """One bit string for each tree and row, the first projection being the highest bit."""
        weight = 2.0 ** np.arange(self.bits - 1, -1, -1)
        return np.stack([((x @ p > 0) @ weight).astype(np.uint32) for p in self.planes])

    def ranges(self, codes: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last places, [tree, query], of the rows that share a prefix of each query's depth."""
        rest = ((np.uint64(1) << (self.bits - depth).astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        low = [np.searchsorted(s, c & ~rest, side="left") for s, c in zip(self.sorted, codes, strict=True)]
        high = [np.searchsorted(s, c | rest, side="right") for s, c in zip(self.sorted, codes, strict=True)]
        return np.stack(low), np.stack(high)

    def ascend(self, codes: np.ndarray, want: float) -> np.ndarray:
        """Each query's deepest common depth at which the trees' ranges together hold what is wanted, else 0."""
        least, most = np.zeros(codes.shape[1], dtype=np.int64), np.full(codes.shape[1], self.bits)
        while (least < most).any():
            middle = (least + most + 1) // 2
            low, high = self.ranges(codes, middle)
            enough = (high - low).sum(axis=0) >= want
            least, most = np.where(enough, middle, least), np.where(enough, most, middle - 1)
        return least

    def candidates(self, x: np.ndarray, reach: float, least: int) -> Iterator[np.ndarray]:
        """For each query row the rows that share a prefix of the common depth with it in some tree."""
        codes = self.codes(x)
        low, high = self.ranges(codes, self.ascend(codes, max(reach * self.n, self.trees * least)))
        rows, first = self.order.ravel(), np.arange(self.trees) * self.n
        for q in range(len(x)):
            held = high[:, q] - low[:, q]
            places = np.repeat(low[:, q] + first - (np.cumsum(held) - held), held) + np.arange(held.sum())
            mine = np.zeros(self.n, dtype=bool)
            mine[rows[places]] = True
            yield np.flatnonzero(mine)


def nearest(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, reach: float = REACH):
    """For each query its k nearest candidates of a block: places of queries, ids and exact cosines."""
    norm, query_norm = np.sqrt((x * x).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    at, found, scores = [], [], []
    for q, rows in enumerate(Forest(x / norm[:, None]).candidates(queries / query_norm[:, None], reach, k + 1)):
        rows = rows[ids[rows] != query_ids[q]]
        s = (x[rows] * queries[q]).sum(axis=1) / (norm[rows] * query_norm[q])
        if len(s) > k:
            near = s >= np.partition(s, len(s) - k)[len(s) - k]
            rows, s = rows[near], s[near]
        best = np.lexsort((ids[rows], -s))[:k]
        at += [q] * len(best)
        found.append(ids[rows[best]]), scores.append(s[best])
    none = np.zeros(0)
    return at, np.concatenate([none.astype(np.int64), *found]), np.concatenate([none, *scores])


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double) of the vectors that take part.

    Left out: null ids, null and zero vectors, those holding null or non-finite components, and those whose
    length is not the most common one (the smaller length of a tie).
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    v = v.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(fine)
    common = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.filter(F.size("embedding") == (common["n"] if common else -1))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, reach: float = REACH, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k nearest found, ties to the smaller vec_id.

    Both frames have vec_id and embedding; rows with the query's own id are no candidates. Vectors that usable() leaves
    out take no part on either side. Repeated candidates each take a rank; repeated queries are answered once for
    each different vector. An empty side gives no rows; other columns are ignored.
    """
    data = usable(vectors)
    first = data.first()
    asked = usable(queries).filter(F.size("embedding") == (len(first["embedding"]) if first else -1)).dropDuplicates(["vec_id", "embedding"])
    blocks, parts = max(1, ceil(data.count() / block_rows)), max(1, ceil(asked.count() / QUERY_ROWS))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = F.xxhash64("vec_id")
    left = data.withColumn("block", F.pmod(key, F.lit(blocks)).cast("int")).withColumn("part", spread(parts))
    right = asked.withColumn("part", F.pmod(key, F.lit(parts)).cast("int")).withColumn("block", spread(blocks)).withColumn("hash", F.xxhash64("embedding"))

    def matrix(t: pa.Table) -> np.ndarray:
        c = t.column("embedding").combine_chunks()
        return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "hash", "vec_id", "score"]
        if not rows.num_rows or not asked.num_rows:
            return pa.table({n: pa.array([], pa.float64() if n == "score" else pa.int64()) for n in names})
        query_ids = asked.column("vec_id").to_numpy()
        at, ids, scores = nearest(rows.column("vec_id").to_numpy(), matrix(rows), query_ids, matrix(asked), k, reach)
        return pa.table({"query_id": query_ids[at], "hash": asked.column("hash").to_numpy()[at], "vec_id": ids, "score": scores})

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, "query_id long, hash long, vec_id long, score double")
    best = Window.partitionBy("query_id", "hash").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

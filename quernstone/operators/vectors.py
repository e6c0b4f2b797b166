"""Nearest neighbours among keyed vectors: exact search, filtered, in batches, and an index table with upserts.

Exact search is the default. search_graph() is the approximate one: a navigable graph in each partition.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.errors import OtherError
from quernstone.functions.distance import METRICS, distance
from quernstone.operators import kv
from quernstone.sources.files import cut


@dataclass(frozen=True)
class VectorConfig:
    dim: int
    metric: str = "l2"
    m: int = 16
    m_max0: int = 32
    ef_construction: int = 100
    ef_search: int = 50

    def __post_init__(self):
        if self.dim <= 0 or self.m < 2 or self.m_max0 < self.m or self.ef_construction <= 0 or self.metric not in METRICS:
            raise OtherError("the vector configuration is not valid")


def knn(vectors: DataFrame, query: list[float], k: int, key: str = "k", vec: str = "vec", metric: str = "l2", where: Column | None = None) -> DataFrame:
    """key and distance of the k nearest, nearest first, ties to the smaller key; a filter goes before the ranking."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors if where is None else vectors.filter(where)
    return rows.select(key, distance(F.col(vec), q, metric).alias("distance")).orderBy("distance", key).limit(max(0, k))


def _nearest(keys: np.ndarray, x: np.ndarray, q: np.ndarray, k: int, metric: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Keys and distances of the k nearest rows of x for each row of q."""
    out = []
    norm = np.sqrt((x * x).sum(axis=1))
    for row in q:
        if metric == "l2":
            d = ((x - row) ** 2).sum(axis=1)
        else:
            d = -(x * row).sum(axis=1)
            if metric == "cosine":
                both = norm * np.sqrt((row * row).sum())
                d = 1 + np.divide(d, both, out=np.zeros_like(d), where=both > 0)
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
        best = near[np.lexsort((keys[near], d[near]))[:k]]
        out.append((keys[best], d[best]))
    return out


def knn_join(vectors: DataFrame, queries: DataFrame, k: int, key: str = "k", vec: str = "vec", query_key: str = "q", query_vec: str = "qvec", metric: str = "l2", part_rows: int = 8192, block: int = 4096) -> DataFrame:
    """query_key, rank, key and distance of each query's k nearest, ties to the smaller key.

    Vectors are dealt into parts and queries into blocks of bounded size, and every part meets every block; only k
    rows for each query and part are shuffled. Keys of both sides are unique.
    """
    kind, qkind = dict(vectors.dtypes)[key], dict(queries.dtypes)[query_key]
    if k <= 0:
        return vectors.limit(0).select(F.lit(None).cast(qkind).alias(query_key), F.lit(0).alias("rank"), F.col(key), F.lit(0.0).alias("distance"))
    parts, blocks = max(1, -(-vectors.count() // part_rows)), max(1, -(-queries.count() // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    rows = vectors.select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v"), deal(key, parts).alias("part")).withColumn("block", every(blocks))
    asked = queries.select(F.col(query_key).alias("q"), F.col(query_vec).cast("array<double>").alias("v"), deal(query_key, blocks).alias("block")).withColumn("part", every(parts))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "k": [], "distance": []})
        found = _nearest(left["k"].to_numpy(), np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy()), k, metric)
        return pd.DataFrame({"q": np.repeat(right["q"].to_numpy(), [len(x) for x, _ in found]), "k": np.concatenate([x for x, _ in found]), "distance": np.concatenate([d for _, d in found])})

    found = rows.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInPandas(run, f"q {qkind}, k {kind}, distance double")
    w = Window.partitionBy("q").orderBy("distance", "k")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(F.col("q").alias(query_key), "rank", F.col("k").alias(key), "distance")


class Graph:
    """A layered navigable small-world graph over the rows of a matrix."""

    def __init__(self, x: np.ndarray, config: VectorConfig, seed: int = 1):
        self.x, self.c = x, config
        self.norm = np.sqrt((x * x).sum(axis=1))
        rng = np.random.default_rng(seed)
        self.layer = np.minimum(np.floor(-np.log(1 - rng.random(len(x))) / np.log(config.m)).astype(int), 32)
        self.links: list[dict[int, list[int]]] = [{} for _ in range(int(self.layer.max(initial=0)) + 1)]
        self.entry: int | None = None
        for i in range(len(x)):
            self._link(i)

    def far(self, q: np.ndarray, rows: list[int]) -> np.ndarray:
        x = self.x[rows]
        if self.c.metric == "l2":
            return ((x - q) ** 2).sum(axis=1)
        d = x @ q
        if self.c.metric == "inner_product":
            return -d
        norm = self.norm[rows] * np.sqrt(q @ q)
        return 1 - np.divide(d, norm, out=np.zeros_like(d), where=norm > 0)

    def beam(self, q: np.ndarray, start: list[int], ef: int, layer: int, allowed=None) -> list[tuple[float, int]]:
        """The ef nearest found from start; rows not allowed are walked through but not returned."""
        d = self.far(q, start)
        seen, todo = set(start), [(v, i) for v, i in zip(d.tolist(), start, strict=True)]
        heapq.heapify(todo)
        best = [(-v, i) for v, i in todo if allowed is None or allowed[i]]
        heapq.heapify(best)
        while todo:
            v, i = heapq.heappop(todo)
            if len(best) >= ef and v > -best[0][0]:
                break
            new = [j for j in self.links[layer].get(i, []) if j not in seen]
            seen.update(new)
            for w, j in zip(self.far(q, new).tolist() if new else [], new, strict=True):
                if len(best) < ef or w < -best[0][0]:
                    heapq.heappush(todo, (w, j))
                    if allowed is None or allowed[j]:
                        heapq.heappush(best, (-w, j))
                        if len(best) > ef:
                            heapq.heappop(best)
        return sorted((-v, i) for v, i in best)

    def _choose(self, found: list[tuple[float, int]], m: int) -> list[int]:
        """Near ones that are nearer to the row than to one another, filled up with the nearest."""
        out: list[int] = []
        for v, i in found:
            if len(out) >= m:
                break
            if not out or (self.far(self.x[i], out) > v).all():
                out.append(i)
        return out + [i for _, i in found if i not in out][: m - len(out)]

    def _link(self, i: int) -> None:
        q, top = self.x[i], int(self.layer[i])
        if self.entry is None:
            self.entry = i
            for layer in range(top + 1):
                self.links[layer][i] = []
            return
        start, high = [self.entry], int(self.layer[self.entry])
        for layer in range(high, top, -1):
            start = [self.beam(q, start, 1, layer)[0][1]]
        for layer in range(min(top, high), -1, -1):
            found = self.beam(q, start, self.c.ef_construction, layer)
            most = self.c.m_max0 if layer == 0 else self.c.m
            self.links[layer][i] = self._choose(found, self.c.m)
            for j in self.links[layer][i]:
                own = self.links[layer].setdefault(j, [])
                own.append(i)
                if len(own) > most:
                    self.links[layer][j] = self._choose(sorted(zip(self.far(self.x[j], own).tolist(), own, strict=True)), most)
            start = [n for _, n in found]
        for layer in range(high + 1, top + 1):
            self.links[layer][i] = []
        if top > high:
            self.entry = i

    def search(self, q: np.ndarray, k: int, ef: int, allowed=None) -> list[tuple[float, int]]:
        if self.entry is None or k <= 0:
            return []
        start = [self.entry]
        for layer in range(int(self.layer[self.entry]), 0, -1):
            start = [self.beam(q, start, 1, layer)[0][1]]
        return self.beam(q, start, max(ef, k) if allowed is None else max(4 * ef, 2 * k), 0, allowed)[:k]


def search_graph(vectors: DataFrame, queries: DataFrame | list[list[float]], k: int, config: VectorConfig, key: str = "k", vec: str = "vec", where: Column | None = None, part_rows: int = 20_000, ef: int | None = None, query_key: str = "query", query_vec: str = "qvec", block: int = 16_384) -> DataFrame:
    """Approximate search: query_key, key and distance. Each part of bounded size builds and searches a graph.

    Queries are a DataFrame with unique keys, dealt into blocks of bounded size, and every part meets every block; a
    part builds its graph anew for each block. A few queries can be a list; then their places are their keys.
    """
    if isinstance(queries, list):
        queries = vectors.sparkSession.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(queries)], f"{query_key} int, {query_vec} array<double>")
    kind, qkind = dict(vectors.dtypes)[key], dict(queries.dtypes)[query_key]
    parts, blocks = max(1, -(-vectors.count() // part_rows)), max(1, -(-queries.count() // block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    rows = vectors.select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v"), (F.lit(True) if where is None else where).alias("ok"), deal(key, parts).alias("part")).withColumn("block", every(blocks))
    asked = queries.select(F.col(query_key).alias("q"), F.col(query_vec).cast("array<double>").alias("v"), deal(query_key, blocks).alias("block")).withColumn("part", every(parts))
    filtered = where is not None

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "k": [], "distance": []})
        left = left.sort_values("k", ignore_index=True)
        graph = Graph(np.stack(left["v"].to_numpy()), config)
        allowed = left["ok"].to_numpy() if filtered else None
        out = [(i, left["k"][row], d) for i, q in zip(right["q"], right["v"], strict=True) for d, row in graph.search(q, k, ef or config.ef_search, allowed)]
        return pd.DataFrame(out, columns=["q", "k", "distance"])

    found = rows.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInPandas(run, f"q {qkind}, k {kind}, distance double")
    w = Window.partitionBy("q").orderBy("distance", "k")
    return found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).select(F.col("q").alias(query_key), F.col("k").alias(key), "distance")


class VectorIndex:
    """A keyed set of vectors with upserts, removal and search; every change makes a new DataFrame."""

    def __init__(self, df: DataFrame, config: VectorConfig, key: str = "k", vec: str = "vec"):
        self.df, self.config, self.key, self.vec = df, config, key, vec

    def _checked(self, df: DataFrame) -> DataFrame:
        if not df.filter(F.size(self.vec) != self.config.dim).isEmpty():
            raise OtherError(f"a vector has not {self.config.dim} dimensions")
        return df

    def insert_batch(self, items: DataFrame, seq: str | None = None) -> None:
        """Upsert; all dimensions are checked first, and of a repeated key the last by seq (without it: by place) stays."""
        items = self._checked(items)
        place = seq or "_place"
        numbered = items if seq else items.withColumn(place, F.monotonically_increasing_id())
        items = kv.last_per_key(numbered, self.key, place).drop(place)
        self.df = kv.upsert(self.df, items, self.key)

    def insert(self, key, vector: list[float]) -> None:
        self.insert_batch(self.df.sparkSession.createDataFrame([(key, vector)], self.df.select(self.key, self.vec).schema))

    def remove(self, key) -> bool:
        there = self.contains_key(key)
        self.df = self.df.filter(F.col(self.key) != F.lit(key))
        return there

    def get(self, key) -> list[float] | None:
        row = kv.get(self.df, self.key, key).first()
        return list(row[self.vec]) if row else None

    def contains_key(self, key) -> bool:
        return kv.contains_key(self.df, self.key, key)

    def keys(self) -> DataFrame:
        return self.df.select(self.key)

    def iter(self) -> DataFrame:
        """Keys and vectors in key order."""
        return self.df.select(self.key, self.vec).orderBy(self.key)

    def compact(self) -> None:
        """Write the live vectors anew and cut the lineage of all former changes."""
        self.df = cut(self.df)

    def __len__(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return self.df.isEmpty()

    def clear(self) -> None:
        self.df = self.df.limit(0)

    def set_ef_search(self, ef: int) -> None:
        self.config = VectorConfig(**{**self.config.__dict__, "ef_search": ef})

    def _ready(self, query: list[float], k: int) -> bool:
        if len(query) != self.config.dim:
            raise OtherError(f"the query has not {self.config.dim} dimensions")
        return k > 0 and not self.is_empty()

    def search(self, query: list[float], k: int, where: Column | None = None) -> list[tuple]:
        if not self._ready(query, k):
            return []
        return [tuple(r) for r in knn(self.df, query, k, self.key, self.vec, self.config.metric, where).collect()]

    def search_approximate(self, query: list[float], k: int, where: Column | None = None, ef: int | None = None) -> list[tuple]:
        if not self._ready(query, k):
            return []
        found = search_graph(self.df, [query], k, self.config, self.key, self.vec, where, ef=ef)
        return [(r[self.key], r["distance"]) for r in found.orderBy("distance", self.key).collect()]

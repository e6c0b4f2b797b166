import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone import queries
from quernstone.errors import OtherError
from quernstone.functions import codec
from quernstone.operators import kv, overlay, slots, vectors, versioned

SLOW = {"max_examples": 8, "deadline": None, "suppress_health_check": list(HealthCheck)}


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def kvdf(spark, d):
    return spark.createDataFrame(list(d.items()), "k long, v string")


# -- key-value

def test_point_and_range_reads(spark):
    df = kvdf(spark, {i: str(i) for i in range(0, 100, 10)})
    assert kv.get(df, "k", 30).first().v == "30" and kv.get(df, "k", 31).first() is None
    assert kv.contains_key(df, "k", 0) and not kv.contains_key(df, "k", 5)
    assert kv.floor(df, "k", 35).first().k == 30 and kv.floor(df, "k", -1).first() is None
    assert kv.ceiling(df, "k", 35).first().k == 40 and kv.ceiling(df, "k", 91).first() is None
    assert [r.k for r in kv.key_range(df, "k", 20, 50, low_open=True).collect()] == [30, 40, 50]
    assert [r.k for r in kv.key_range(df, "k", None, 20, high_open=True, reverse=True).collect()] == [10, 0]
    assert kv.first(df, "k").first().k == 0 and kv.last(df, "k").first().k == 90


def test_range_reaches_the_scan(spark, tmp_path):
    kvdf(spark, {i: "x" for i in range(50)}).write.parquet(str(tmp_path / "t"))
    plan = kv.key_range(spark.read.parquet(str(tmp_path / "t")), "k", 3, 9, ordered=False)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,3)" in plan and "LessThanOrEqual(k,9)" in plan


def test_binary_keys_sort_unsigned(spark):
    df = spark.createDataFrame([(bytearray(b"\xff"),), (bytearray(b"\x01"),), (bytearray(b""),), (bytearray(b"\x01\x00"),)], "k binary")
    assert [bytes(r.k) for r in kv.scan(df, "k").collect()] == [b"", b"\x01", b"\x01\x00", b"\xff"]


@settings(**SLOW)
@given(base=st.dictionaries(st.integers(0, 9), st.sampled_from("ab")), ops=st.lists(st.tuples(st.integers(0, 9), st.sampled_from("PD"), st.sampled_from("xy")), max_size=12), wiped=st.booleans())
def test_batch_against_dict(spark, base, ops, wiped):
    want = {} if wiped else dict(base)
    for k, op, v in ops:
        want.pop(k, None) if op == "D" else want.__setitem__(k, v)
    staged = spark.createDataFrame([(k, op, v, i) for i, (k, op, v) in enumerate(ops)], "k long, op string, v string, seq long")
    assert dict(rows(kv.apply_batch(kvdf_or_empty(spark, base), staged, "k", wiped=wiped))) == want


def kvdf_or_empty(spark, d):
    return spark.createDataFrame(list(d.items()), "k long, v string")


@settings(**SLOW)
@given(left=st.lists(st.tuples(st.integers(0, 2), st.integers(0, 30)), max_size=10), right=st.dictionaries(st.tuples(st.integers(0, 2), st.integers(0, 30)), st.integers(), max_size=10), forward=st.booleans(), buckets=st.sampled_from([1, 3]))
def test_asof_against_scan(spark, left, right, forward, buckets):
    l = spark.createDataFrame([(i, g, k) for i, (g, k) in enumerate(left)], "id long, g long, k long")
    r = spark.createDataFrame([(g, k, str(v)) for (g, k), v in right.items()], "g long, rk long, v string")
    got = {x.id: (x.rk, x.v) for x in kv.asof_join(l, r, "k", "rk", ["v"], ["g"], forward, buckets).collect()}
    for i, (g, k) in enumerate(left):
        near = [rk for gg, rk in right if gg == g and (rk >= k if forward else rk <= k)]
        best = (min if forward else max)(near, default=None)
        assert got[i] == ((best, str(right[g, best])) if near else (None, None))


def test_range_join(spark):
    p = spark.createDataFrame([(i,) for i in range(40)], "x long")
    r = spark.createDataFrame([("a", 3, 17), ("b", 9, 9), ("c", 9, 2), ("d", -5, 0)], "n string, low long, high long")
    got = rows(kv.range_join(p, r, "x", "low", "high", 4), "x", "n")
    assert got == sorted((x, n) for n, a, b in [("a", 3, 17), ("b", 9, 9), ("d", -5, 0)] for x in range(40) if a <= x <= b)


def test_codes_keep_order(spark):
    values = [-(2**63), -300, -1, 0, 1, 255, 256, 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "x long").withColumn("c", codec.encode_int(F.col("x"))).withColumn("back", codec.decode_int(F.col("c")))
    got = df.orderBy("c").collect()
    assert [r.x for r in got] == values and all(r.x == r.back for r in got)
    assert [bytes(r.c) for r in got] == [(v + 2**63).to_bytes(8, "big") for v in values]
    small = spark.createDataFrame([(-128,), (127,)], "x tinyint").select(codec.encode_int(F.col("x"), "tinyint").alias("c"), codec.encode_ints(F.array(F.col("x"), F.col("x")), "tinyint").alias("cc")).collect()
    assert [bytes(r.c) for r in small] == [b"\x00", b"\xff"] and bytes(small[1].cc) == b"\xff\xff"


# -- versioning

def test_merge_cases(spark):
    a = kvdf(spark, {1: "10", 2: "20", 3: "30", 4: "40", 5: "50"})
    s = kvdf(spark, {2: "99", 3: "30", 4: "40", 5: "50", 6: "60"})
    t = kvdf(spark, {1: "10", 2: "20", 4: "88", 5: "50", 7: "70"})
    assert dict(rows(versioned.merge(a, s, t, "k"))) == {2: "99", 4: "88", 5: "50", 6: "60", 7: "70"}
    assert rows(versioned.diff(kvdf(spark, {1: "a", 2: "b"}), kvdf(spark, {2: "B", 3: "c"}), "k"), "change", "k") == [("Added", 3), ("Modified", 2), ("Removed", 1)]


value = st.one_of(st.none(), st.sampled_from(["x", "y", None]).map(lambda v: (v,)))


@settings(**SLOW)
@given(st.lists(st.tuples(value, value, value, value), min_size=1, max_size=9))
def test_merge_matrix_with_nulls(spark, cells):
    """None is absent, (None,) a null value."""
    side = lambda i: spark.createDataFrame([(k, c[i][0]) for k, c in enumerate(cells) if c[i] is not None], "k long, v string")
    want = {k: (t if s == a else s) for k, (a, s, t, _) in enumerate(cells)}
    assert dict(rows2(versioned.merge(side(0), side(1), side(2), "k"))) == {k: v[0] for k, v in want.items() if v is not None}
    many = {k: (t if a == b and s == a else s) for k, (a, s, t, b) in enumerate(cells)}
    assert dict(rows2(versioned.merge_many([side(0), side(3)], side(1), side(2), "k"))) == {k: v[0] for k, v in many.items() if v is not None}


def rows2(df):
    return [tuple(r) for r in df.collect()]


# -- slots

@settings(**SLOW)
@given(entries=st.lists(st.tuples(st.integers(0, 20), st.integers(0, 5)), max_size=30), size=st.integers(0, 7), number=st.integers(0, 4), reverse=st.booleans(), bounds=st.one_of(st.none(), st.tuples(st.integers(0, 20), st.integers(0, 20))))
def test_pages_against_model(spark, entries, size, number, reverse, bounds):
    index = slots.insert(spark.createDataFrame([], "slot long, k long"), spark.createDataFrame(entries, "slot long, k long"))
    left, right = bounds or (None, None)
    order = sorted(set(entries), key=lambda e: (-e[0] if reverse else e[0], e[1]))
    inside = [e for e in order if bounds is None or left <= e[0] <= right]
    got = [tuple(r) for r in slots.page(index, "slot", "k", size, number, reverse, left, right).collect()]
    assert got == (inside[size * number : size * (number + 1)] if size else [])
    assert slots.count(index, "slot", left, right) == len(inside)
    if bounds is None:
        rollup = slots.tiers(index, "slot", 3)
        assert [tuple(r) for r in slots.page_by_tiers(index, rollup, "slot", "k", size, number, 3, reverse).collect()] == got


def test_slot_fixtures(spark):
    df = spark.createDataFrame([(5, 10), (5, 20), (5, 30), (9, 40), (9, 50)], "slot long, k long")
    ks = lambda *a: [r.k for r in slots.page(df, "slot", "k", *a).collect()]
    assert ks(10, 0, False) == [10, 20, 30, 40, 50] and ks(10, 0, True) == [40, 50, 10, 20, 30]
    assert [ks(2, i, True) for i in range(3)] == [[40, 50], [10, 20], [30]]
    assert ks(10, 0, True, 5, 5) == [10, 20, 30] and ks(10, 0, False, 9, 5) == []
    assert slots.rank_of(df, "slot", 9) == 3 and slots.rank_of(df, "slot", 5, True) == 2
    with pytest.raises(ValueError):
        slots.tiers(df, "slot", 1)


# -- overlays

def test_overlay(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2), (5, 3)], "node_id long, parent_id long")
    data = spark.createDataFrame([(1, "k0", "v0"), (1, "kg", "doomed"), (2, "k1", "v1"), (2, "kg", ""), (3, "k2", "v2"), (3, "k1", "v1x"), (4, "s", "s"), (5, "c", "c")], "node_id long, k string, v string")
    want = [("k0", "v0"), ("k1", "v1x"), ("k2", "v2")]
    assert rows(overlay.view(nodes, data, 3)) == want
    assert overlay.get(nodes, data, 3, "kg").first() is None and overlay.get(nodes, data, 1, "kg").first().v == "doomed"
    n, d, root = overlay.prune(nodes, data, 3)
    assert root == 1 and rows(d.filter("node_id = 1"), "k", "v") == want
    assert rows2(n.orderBy("node_id")) == [(1, None), (5, 1)] and rows(d.filter("node_id = 5"), "k") == [("c",)]
    assert overlay.prune(nodes, data, 1)[2] == 1
    n, d = overlay.destroy(nodes, data, 2)
    assert rows2(n) == [(1, None)] and set(r.node_id for r in d.collect()) == {1}
    n, _ = overlay.prune_children(nodes, data, 2, [4])
    assert sorted(r.node_id for r in n.collect()) == [1, 2, 3, 5]
    assert overlay.child_ids(nodes, 2) == [3, 4] and overlay.no_children(nodes, 5) and not overlay.is_dead(nodes, data, 5)
    data2 = overlay.remove(overlay.put(data, 5, spark.createDataFrame([("n", "1")], "k string, v string")), 5, spark.createDataFrame([("k0",)], "k string"))
    assert rows(overlay.view(nodes, data2, 5)) == [("c", "c"), ("k1", "v1x"), ("k2", "v2"), ("n", "1")]
    assert overlay.get_local(data2, 5, "k0").first() is None
    with pytest.raises(Exception, match="a value is empty"):
        overlay.put(data, 5, spark.createDataFrame([("n", "")], "k string, v string")).collect()
    loop = spark.createDataFrame([(1, 2), (2, 1)], "node_id long, parent_id long")
    assert overlay.view(loop, data, 1).isEmpty()
    with pytest.raises(OtherError):
        overlay.prune(loop, data, 1)


# -- vectors

def test_knn_fixtures(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [1.0, 0.1, 0.0])], "k string, vec array<double>")
    assert [r.k for r in vectors.knn(df, [1.0, 0.0, 0.0], 2).collect()] == ["a", "c"]
    assert vectors.knn(df, [1.0, 0.0, 0.0], 1, metric="cosine").first().k == "a"
    assert vectors.knn(df, [1.0, 0.0, 0.0], 1, metric="inner_product").first().distance == -1.0
    assert vectors.knn(df, [0.0, 0.0, 0.0], 2, metric="cosine").count() == 2
    assert vectors.knn(df, [0.0, 0.0, 1.0], 0).count() == 0
    index = vectors.VectorIndex(df, vectors.VectorConfig(3))
    index.insert("a", [9.0, 9.0, 9.0])
    assert index.get("a") == [9.0, 9.0, 9.0] and len(index) == 3 and index.remove("b") and not index.remove("zz")
    assert [k for k, _ in index.search([1.0, 0.0, 0.0], 5, F.col("k") != "c")] == ["a"]
    for bad in (lambda: index.insert("x", [1.0]), lambda: index.search([1.0], 1), lambda: vectors.VectorConfig(0)):
        with pytest.raises(OtherError):
            bad()
    index.clear()
    assert index.search([0.0, 0.0, 0.0], 3) == [] and index.is_empty()


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_batch_and_graph_against_brute_force(spark, metric):
    rng = np.random.default_rng(5)
    x = rng.random((500, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, vec array<double>").cache()
    q = rng.random((20, 32))
    d = {"l2": ((q[:, None] - x[None]) ** 2).sum(2), "inner_product": -(q @ x.T), "cosine": 1 - q @ x.T / np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1))}[metric]
    want = [set(np.argsort(row)[:10].tolist()) for row in d]
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "q long, qvec array<double>")
    got = vectors.knn_join(df, asked, 10, metric=metric, part_rows=120, block=7).collect()
    assert [set(r.k for r in got if r.q == i) for i in range(20)] == want
    near = vectors.search_graph(df, q.tolist(), 10, vectors.VectorConfig(32, metric), part_rows=300).collect()
    recall = np.mean([len(want[i] & {r.k for r in near if r["query"] == i}) / 10 for i in range(20)])
    assert recall >= 0.8
    only = vectors.search_graph(df, q[:2].tolist(), 5, vectors.VectorConfig(32, metric), where=F.col("k") % 10 == 0).collect()
    assert only and all(r.k % 10 == 0 for r in only)


def test_graph_takes_queries_in_blocks(spark):
    rng = np.random.default_rng(6)
    x, q = rng.random((200, 8)), rng.random((20, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, vec array<double>")
    asked = spark.createDataFrame([(100 * i, v.tolist()) for i, v in enumerate(q)], "q long, qvec array<double>")
    config = vectors.VectorConfig(8)
    whole = rows(vectors.search_graph(df, q.tolist(), 3, config, part_rows=80))
    got = rows(vectors.search_graph(df, asked, 3, config, part_rows=80, query_key="q", block=6))
    assert len(got) == 60 and got == [(100 * i, k, d) for i, k, d in whole]
    assert vectors.search_graph(df, asked.limit(0), 3, config, query_key="q").isEmpty()


def test_graph_query_asks_for_every_fiftieth_vector(spark):
    d = "/root/testdata/sf0.001"
    want = {r.vec_id for r in queries.load(spark, d, "embeddings").filter("vec_id % 50 = 0").collect()}
    got = queries.vec_search_graph(spark, d).collect()
    assert {r["query"] for r in got} == want and len(got) == 10 * len(want)


def test_random_edit_history(spark):
    """Deltas put together give what a dict holds."""
    rnd = random.Random(4)
    want, deltas = {}, []
    for seq in range(60):
        k, op = rnd.randrange(12), rnd.choice("PPD")
        deltas.append((k, str(seq), op, seq))
        want.pop(k, None) if op == "D" else want.__setitem__(k, str(seq))
    df = spark.createDataFrame(deltas, "k long, v string, op string, seq long")
    assert dict(rows(versioned.snapshot(df, "k", ["k", "v"]))) == want

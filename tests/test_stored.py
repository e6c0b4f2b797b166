import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.errors import BaseDirFrozen, BranchAlreadyExists, BranchNotFound, CannotDeleteMainBranch, CommitNotFound, DecodeError, EncodingError, NamespaceError, OtherError, TrieError, UncommittedChanges
from quernstone.operators import trie
from quernstone.plans import history
from quernstone.plans.proofs import ProvenRepository, entries
from quernstone.plans.repository import Repository
from quernstone.sources.catalog import Catalog, InstanceId
from quernstone.operators import kv
from quernstone.operators.vectors import VectorConfig
from quernstone.sources.collections import Map, OrderedMap, OverlayMap, RawKeyMap, RawMap, Single, SlotIndex, StoredVectors
from quernstone.sources.snapshots import EMPTY_ROOT, SnapshotTree
from quernstone.streaming.ingest import into_map, into_slots, slot_counts

KV = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


@pytest.fixture
def catalog(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "base"))


def test_namespaces(catalog, tmp_path):
    catalog.set_base_dir(str(tmp_path / "other"))
    ns = catalog.create_ns()
    with pytest.raises(BaseDirFrozen):
        catalog.set_base_dir("x")
    with ns.scope():
        m = OrderedMap.new(catalog, KV, "k")
        assert catalog.current().id == ns.id
    assert catalog.current().id == 0 and str(m.instance_id) == f"{m.iid.map_id}@{ns.id}" and InstanceId.parse(str(m.iid)) == m.iid and InstanceId.parse("42@0") == InstanceId(42)
    m.insert(1, "a")
    copy = m.clone_in(catalog.default_ns())
    assert copy.same_entries(m) and not copy.is_the_same_instance(m)
    with pytest.raises(NamespaceError):
        ns.close()
    with pytest.raises(NamespaceError):
        catalog.destroy_ns(ns.id)
    m.release()
    ns.close()
    assert [x["id"] for x in catalog.list_ns()] == [ns.id]
    with pytest.raises(NamespaceError):
        catalog.relocate_ns(ns.id, str(tmp_path / "nowhere"))
    (tmp_path / "other" / f"ns{ns.id}").rename(tmp_path / "moved")
    catalog.relocate_ns(ns.id, str(tmp_path / "moved"))
    assert OrderedMap.from_meta(Catalog(catalog.spark, catalog.base_dir), m.iid, KV).get(1).v == "a"
    catalog.destroy_ns(ns.id)
    assert not (tmp_path / "moved").exists() and copy.get(1).v == "a"
    with pytest.raises(NamespaceError):
        catalog.open_ns(ns.id)


def test_ordered_map(spark, catalog):
    m = OrderedMap.new(catalog, KV, "k")
    for k in (5, 1, 9):
        m.insert(k, str(k))
    m.insert(5, "five")
    m.or_insert(5, "no")
    m.or_insert(7, "seven")
    assert [tuple(r) for r in m.iter().collect()] == [(1, "1"), (5, "five"), (7, "seven"), (9, "9")]
    assert m.get_le(6).k == 5 and m.get_ge(6).k == 7 and m.first().k == 1 and m.last().k == 9 and len(m) == 4
    assert [r.k for r in m.range(1, 9, True, True).collect()] == [5, 7] and m.contains_key(7) and m.get(8) is None
    before = m.df
    m.remove(7)
    m.update(F.col("k") > 4, "v", F.upper("v"))
    assert before.count() == 4 and m.get(5).v == "FIVE"
    m.batch(spark.createDataFrame([(1, None, "D", 1), (2, "two", "P", 2)], "k long, v string, op string, seq long"))
    assert sorted(r.k for r in m.keys().collect()) == [2, 5, 9] and m.vacuum() > 0 and m.values().columns == ["v"]
    m.batch(spark.createDataFrame([(3, "x", "P", 1)], "k long, v string, op string, seq long"), wiped=True)
    assert [tuple(r) for r in m.iter().collect()] == [(3, "x")]
    again = OrderedMap.from_meta(Catalog(spark, catalog.base_dir), m.save_meta(), KV)
    assert again.get(3).v == "x"
    with pytest.raises(DecodeError):
        OrderedMap.from_meta(catalog, m.iid, T.StructType([KV["k"]]))
    with pytest.raises(DecodeError):
        Map.from_meta(catalog, m.iid)
    with pytest.raises(EncodingError):
        OrderedMap.new(catalog, T.StructType([T.StructField("k", T.DoubleType())]), "k")
    m.clear()
    assert len(m) == 0
    raw = RawMap.create(catalog)
    raw.insert(bytearray(b"\xff"), bytearray(b"1"))
    raw.insert(bytearray(b""), bytearray(b"2"))
    assert bytes(raw.first().k) == b"" and bytes(raw.get_le(b"\xfe").k) == b""
    typed = RawKeyMap.create(catalog, T.IntegerType())
    typed.insert(bytearray(b"a"), 3)
    assert typed.get(b"a").v == 3


def test_single(catalog):
    x = Single.new(catalog, 7, T.LongType())
    assert x == 7 and x + 1 == 8 and x / 2 == 3 and x > 6 and x << 1 == 14 and -x == -7 and x % 4 == 3
    x.set(-7)
    assert x / 2 == -3 and x % 2 == -1 and x.update(lambda v: v + 1) and not x.update(lambda v: v)
    y = Single.from_meta(catalog, x.iid)
    assert y == x and y.is_the_same_instance(x) and x.clone_in(catalog.default_ns()) == -6
    z = Single.new(catalog, None, T.LongType())
    assert z.is_uninitialized()
    z.initialize_if_empty(4)
    z.initialize_if_empty(5)
    assert z == 4


def test_slot_index_and_streams(spark, catalog, tmp_path):
    s = SlotIndex.new(catalog, T.LongType(), T.LongType(), 4)
    s.insert_batch(spark.createDataFrame([(i, i) for i in range(100)], "slot long, k long"))
    s.insert(3, 3)
    s.remove(99, 99)
    s.remove(99, 98)
    assert s.total() == 99 and s.entry_cnt_within_two_slots(10, 19) == 10 and s.total_by_slot(200, 300) == 0 and s.entry_cnt_within_two_slots(5, 1) == 0
    assert s.get_entries_by_page_slot(10, 19, 3, 0, True) == [19, 18, 17] and s.get_entries_by_page(4, 1) == [4, 5, 6, 7]
    assert s.distance_to_the_leftmost_slot(5) == 5 and s.distance_to_the_rightmost_slot(97) == 1
    assert s.tiers().filter("level = 1 and slot_floor = 96").first().n == 3
    src = tmp_path / "in"
    spark.createDataFrame([(1, 500), (2, 501), (1, 502)], "k long, slot long").write.parquet(str(src))
    stream = lambda: spark.readStream.schema("k long, slot long").parquet(str(src))
    for _ in range(2):  # the second run finds nothing new
        into_slots(stream(), s, "slot", "k", str(tmp_path / "c1"), once=True).awaitTermination()
    assert s.total_by_slot(500, None) == 3
    m = OrderedMap.new(catalog, T.StructType([T.StructField("k", T.LongType()), T.StructField("slot", T.LongType())]), "k")
    into_map(stream(), m, "slot", str(tmp_path / "c2"), once=True).awaitTermination()
    assert [tuple(r) for r in m.iter().collect()] == [(1, 502), (2, 501)]
    timed = stream().withColumn("ts", F.timestamp_seconds("slot"))
    assert slot_counts(timed, "ts", 60).isStreaming


def test_history():
    g = {1: [], 2: [1], 3: [2], 4: [2], 5: [3, 4], 6: [4, 3], 7: []}
    assert history.merge_bases(g, 5, 6) == [4, 3] and history.fork_point(g, 5, 6) == 4 and history.merge_bases(g, 5, 7) == []
    assert history.log(g, 5) == [5, 3, 2, 1] and history.distance(g, 5, 4) is None and history.distance(g, 5, 5) == 0 and history.distance(g, 9, 1) is None
    assert history.references(g, [5, 6])[3] == 2


def repo(catalog):
    return Repository.new(catalog, KV, "k")


def state(df):
    return {r.k: r.v for r in df.collect()}


def test_repository(spark, catalog):
    r = repo(catalog)
    main = r.main()
    r.insert_all(1, spark.createDataFrame([(i, f"{i}0") for i in range(1, 6)], KV))
    assert main.has_uncommitted() and r.head_commit(1) is None
    c1 = main.commit()
    dev = r.create_branch("dev", 1)
    with pytest.raises(BranchAlreadyExists):
        r.create_branch("dev", 1)
    r.remove(dev, 1)
    r.insert(dev, 2, "99")
    r.insert(dev, 6, "60")
    r.remove(1, 3)
    r.insert(1, 4, "88")
    with pytest.raises(UncommittedChanges):
        r.merge(dev, 1)
    c2, c3 = r.commit(dev), r.commit(1)
    n = r.merge(dev, 1)
    assert r.get_commit(n).parents == (c3, c2) and state(main.working()) == {2: "99", 4: "88", 5: "50", 6: "60"}
    assert state(r.at(c1)) == {i: f"{i}0" for i in range(1, 6)} and r.get_at_commit(c1, 1).v == "10" and not r.contains_key_at_commit(n, 1)
    assert [(d.change, d.k) for d in r.diff_commits(c1, c2).collect()] == [("Removed", 1), ("Modified", 2), ("Added", 6)]
    assert [c.id for c in main.log()] == [n, c3, c1] and r.fork_point(c2, c3) == c1 and r.commit_distance(n, c1) == 2 and r.commit_distance(n, c2) is None
    assert r.merge(1, dev) == r.head_commit(dev).id and state(r.working(dev)) == state(r.working(1))
    r.insert(1, 5, "50")
    assert main.has_uncommitted() and r.diff_uncommitted(1).count() == 0
    r.discard(1)
    r.remove(1, 12345)
    assert not main.has_uncommitted()
    r.rollback_to(1, c2)
    assert state(r.working(1)) == state(r.at(c2)) and r.branch_name(1) == "main"
    with pytest.raises(CannotDeleteMainBranch):
        r.delete_branch(1)
    r.delete_branch(dev)
    assert r.get_commit(n) is None and r.gc() > 0 and state(r.working(1)) == state(r.at(c2))
    with pytest.raises(CommitNotFound):
        r.at(n)
    with pytest.raises(BranchNotFound):
        r.working(dev)
    with pytest.raises(OtherError):
        r.merge(1, 1)
    again = Repository.from_meta(Catalog(spark, catalog.base_dir), r.iid, KV)
    assert state(again.working(1)) == state(r.working(1)) and [x.k for x in again.range(1, 3, 5).collect()] == [3, 4, 5]


def test_criss_cross_takes_the_source(catalog):
    r = repo(catalog)
    r.insert(1, 1, "0")
    r.commit(1)
    a, b = r.create_branch("a", 1), r.create_branch("b", 1)
    for branch, v in ((a, "1"), (b, "2")):
        r.insert(branch, 1, v)
        r.commit(branch)
    a0, b0 = r.create_branch("a0", a), r.create_branch("b0", b)
    r.merge(b0, a)
    assert r.get(a, 1).v == "2"
    r.merge(a0, b)
    assert r.get(b, 1).v == "1"
    r.merge(a, b)
    assert r.get(b, 1).v == "2"


def test_long_chains_and_empty_branches(catalog):
    r = repo(catalog)
    r.insert(1, 1, "x")
    r.remove(1, 1)
    assert not r.has_uncommitted(1)
    other = r.create_branch("other", 1)
    with pytest.raises(OtherError):
        r.merge(other, 1)
    for i in range(20):
        r.insert(1, i % 3, str(i))
        r.commit(1)
    assert state(r.working(1)) == {0: "18", 1: "19", 2: "17"} and len(r._chain(r.head_commit(1).id)) <= 17
    assert r.merge(1, other) == r.head_commit(1).id


def test_proven_repository(spark, catalog):
    r = repo(catalog)
    p = ProvenRepository(r, part_rows=10)
    with pytest.raises(TrieError):
        p.prove(b"x")
    r.insert_all(1, spark.createDataFrame([(i, str(i)) for i in range(40)], KV))
    c = r.commit(1)
    first = p.merkle_root(1)
    r.insert(1, 7, "seven")
    r.remove(1, 8)
    root = p.merkle_root(1)
    assert root == trie.smt_root(entries(r.working(1), "k")) != first == p.merkle_root_at_commit(c)
    p.merkle_root(1)
    key = (7 + 2**63).to_bytes(8, "big")
    proof = p.prove(key)
    assert proof.value == b"seven" and p.verify_proof(root, key, proof)


def test_snapshot_tree(spark, catalog):
    t = SnapshotTree.new(catalog, KV, "k")
    a = t.insert(EMPTY_ROOT, 1, "a")
    b = t.insert(a, 2, "b")
    c = t.insert(b, 2, "b")
    assert c != b and state(t.at(a)) == {1: "a"} and state(t.at(c)) == {1: "a", 2: "b"} and t.at(EMPTY_ROOT).isEmpty()
    assert t.remove(b, 77) == b and t.remove(a, 1) == EMPTY_ROOT
    d = t.remove(b, 1)
    assert state(t.at(d)) == {2: "b"} and t.contains_key(b, 1) and not t.contains_key(d, 1) and [r.k for r in t.range(b, 1, 2, True).collect()] == [2]
    rows = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (5, "z", 2)], "k long, v string, n long")
    e = t.bulk_load(rows, "n")
    assert state(t.at(e)) == {1: "y", 5: "z"} and t.bulk_load(rows.limit(0)) == EMPTY_ROOT
    with pytest.raises(OtherError):
        t.bulk_load(rows.withColumn("n", -F.col("n")), "n")
    for i in range(20):
        e = t.insert(e, 100 + i, str(i))
    assert t.at(e).count() == 22
    t.acquire(a)
    t.release(a)
    assert state(t.at(a)) == {1: "a"}
    t.release(a)
    with pytest.raises(OtherError):
        t.at(a)
    t.rebuild_ref_counts([d, e])
    assert t.gc() > 0 and state(t.at(d)) == {2: "b"} and t.at(e).count() == 22
    assert state(SnapshotTree.from_meta(Catalog(spark, catalog.base_dir), t.iid, KV).at(d)) == {2: "b"}


def test_stored_vectors(spark, catalog):
    v = StoredVectors.new(catalog, T.StringType(), VectorConfig(2, "cosine"))
    index = v.index
    index.insert("a", [1.0, 0.0])
    index.insert("b", [0.0, 1.0])
    index.set_ef_search(99)
    v.store(index)
    again = StoredVectors.from_meta(Catalog(spark, catalog.base_dir), v.iid, "cosine")
    assert [k for k, _ in again.index.search([1.0, 0.1], 1)] == ["a"] and again.index.config.ef_search == 99
    with pytest.raises(DecodeError):
        StoredVectors.from_meta(catalog, v.iid, "l2")


def test_prefix_scan(spark):
    df = spark.createDataFrame([(bytearray(x),) for x in (b"a", b"a\xff", b"ab", b"b", b"\xff\xff", b"")], "k binary")
    of = lambda p: sorted(bytes(r.k) for r in kv.prefix_scan(df, "k", p).collect())
    assert of(b"a") == [b"a", b"ab", b"a\xff"] and of(b"a\xff") == [b"a\xff"] and of(b"\xff") == [b"\xff\xff"] and len(of(b"")) == 6


def test_merge_bases_of_a_criss_cross():
    g = {1: [], 2: [1], 3: [1], 4: [2, 3], 5: [3, 2], 6: [4], 7: [5], 8: []}
    assert history.merge_bases(g, 6, 7) == [3, 2] and history.merge_bases(g, 4, 2) == [2] and history.merge_bases(g, 6, 8) == [] and history.merge_bases(g, 1, 99) == []


def test_merges_keep_the_chain_bounded(spark, catalog, monkeypatch):
    from quernstone.plans import repository

    monkeypatch.setattr(repository, "CHAIN", 3)
    r = Repository.new(catalog, KV, "k")
    r.insert(1, 0, "a")
    r.commit(1)
    dev = r.create_branch("dev", 1)
    for i in range(1, 6):
        r.insert(dev, i, "d")
        r.commit(dev)
        r.insert(1, 100 + i, "m")
        r.commit(1)
        head = r.merge(dev, 1)
        assert len(r._chain(head)) <= 5
    assert r.at(head).count() == 11
    with pytest.raises(OtherError):
        r.merge(77, 77)


def test_overlay_nodes(spark, catalog):
    o = OverlayMap.new(catalog, T.LongType())
    root = o.new_node()
    a, b = o.new_node(root), o.new_node(root)
    o.insert(root, 1, "r")
    o.insert(a, 2, "a")
    o.remove(a, 1)
    assert o.get(a, 1) is None and o.get(b, 1).v == "r" and o.child_ids(root) == [a, b] and not o.is_dead(root)
    again = OverlayMap.from_meta(Catalog(spark, catalog.base_dir), o.save_meta())
    assert again.prune(a) == root and again.no_children(root) and [tuple(r) for r in again.view(root).collect()] == [(2, "a")]
    assert again.new_node(root) == b + 1
    with pytest.raises(OtherError):
        again.new_node(b)
    again.destroy(root)
    assert again.df.count() == 0 and again.nodes.count() == 0


def test_late_rows_change_nothing_where_the_map_keeps_seq(spark, catalog, tmp_path):
    schema = T.StructType([*KV.fields, T.StructField("seq", T.LongType())])
    m = OrderedMap.new(catalog, schema, "k")
    for n, rows in enumerate(([(1, "new", 5)], [(1, "old", 2), (2, "x", 1)])):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        into_map(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), m, "seq", str(tmp_path / "c"), once=True).awaitTermination()
    assert sorted(tuple(r) for r in m.df.collect()) == [(1, "new", 5), (2, "x", 1)]


def test_ints_round_trip(spark):
    df = spark.createDataFrame([([3, -1, 7],), ([],)], "x array<int>")
    from quernstone.functions import codec

    assert [r[0] for r in df.select(codec.decode_ints(codec.encode_ints(F.col("x"), "int"), "int")).collect()] == [[3, -1, 7], []]

"""Queries over stored collections: each writes whole tables into a catalog, works on it and reads it back.

The catalogs stand in scratch folders below spark.checkpoint.dir.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.functions import codec
from quernstone.operators import trie
from quernstone.operators.vectors import VectorConfig
from quernstone.plans.proofs import ProvenRepository, entries
from quernstone.plans.repository import Repository
from quernstone.queries import load, query
from quernstone.sources import files
from quernstone.sources.catalog import Catalog
from quernstone.sources.collections import Map, OrderedMap, OverlayMap, RawKeyMap, RawMap, Single, SlotIndex, StoredVectors
from quernstone.sources.snapshots import SnapshotTree

KV = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType())])
_KV = "SELECT o_orderkey AS k, o_custkey AS v FROM orders"


def _catalog(spark) -> Catalog:
    return Catalog(spark, files.scratch(spark))


def _kv(spark, d):
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"))


def _map(spark, d, kind=OrderedMap):
    m = kind.new(_catalog(spark), KV, "k")
    m.insert_all(_kv(spark, d))
    return m


# -- maps and single values ----------------------------------------------------------------------------------

@query(f"SELECT k, CASE WHEN k % 3 = 0 THEN v + 1 ELSE v END AS v FROM ({_KV}) WHERE k <> 77 UNION ALL SELECT -5, 1")
def map_insert_remove(spark, d):
    m = _map(spark, d)
    m.insert_all(_kv(spark, d).filter("k % 3 = 0").withColumn("v", F.col("v") + 1))
    m.insert(-5, 1)
    m.remove(77)
    return m.iter()


@query(f"SELECT k, v FROM ({_KV}) WHERE k > 100 AND k <= 9000")
def map_range(spark, d):
    return _map(spark, d).range(100, 9000, low_open=True, reverse=True)


@query(f"SELECT k, v * 2 AS v FROM ({_KV}) WHERE k % 2 = 0 UNION ALL SELECT k, -1 FROM ({_KV}) WHERE k % 2 <> 0")
def map_clear_entry_update(spark, d):
    """Cleared, then filled by half of the entries; the others are inserted where absent; the first half is rewritten."""
    m = _map(spark, d)
    m.clear()
    half = F.col("k") % 2 == 0
    m.insert_all(_kv(spark, d).filter(half))
    missing = _kv(spark, d).filter(~half).withColumn("v", F.lit(-1).cast("long"))
    m.insert_all(missing)
    m.or_insert(int(missing.agg(F.min("k")).first()[0]), 5)
    m.update(half, "v", F.col("v") * 2)
    return m.iter()


@query(f"SELECT k, v FROM ({_KV}) WHERE k % 4 NOT IN (1, 2) UNION ALL SELECT k, v + 7 FROM ({_KV}) WHERE k % 4 = 2")
def map_batch(spark, d):
    m = _map(spark, d)
    x = _kv(spark, d)
    put = x.filter("k % 4 = 2").select("k", (F.col("v") + 7).alias("v"), F.lit("P").alias("op"), F.lit(2).alias("seq"))
    before = put.withColumn("op", F.lit("D")).withColumn("seq", F.lit(1))
    gone = x.filter("k % 4 = 1").select("k", "v", F.lit("D").alias("op"), F.lit(1).alias("seq"))
    m.batch(put.union(before).union(gone))
    return m.iter()


@query(f"SELECT k, v FROM ({_KV}) WHERE k % 10 = 3")
def map_batch_wiped(spark, d):
    m = _map(spark, d)
    m.batch(_kv(spark, d).filter("k % 10 = 3").withColumns({"op": F.lit("P"), "seq": F.lit(1)}), wiped=True)
    return m.iter()


@query(f"SELECT k, v, (SELECT count(*) FROM ({_KV})) AS source_rows, true AS same_entries, false AS same_instance FROM ({_KV}) UNION ALL SELECT -1, -1, count(*), true, false FROM ({_KV})")
def map_clone_restore(spark, d):
    """A clone in another namespace, restored from its saved id, changes apart from its source."""
    m = _map(spark, d)
    copy = m.clone_in(m.catalog.create_ns())
    same = copy.same_entries(m)
    again = OrderedMap.from_meta(Catalog(spark, m.catalog.base_dir), copy.save_meta(), KV)
    again.insert(-1, -1)
    return again.iter().select("k", "v", F.lit(len(m)).cast("long").alias("source_rows"), F.lit(same).alias("same_entries"), F.lit(copy.is_the_same_instance(m)).alias("same_instance"))


@query(f"SELECT (SELECT min(k) FROM ({_KV})) AS first_key, (SELECT max(k) FROM ({_KV})) AS last_key, (SELECT max(k) FROM ({_KV}) WHERE k <= 500) AS floor_key, (SELECT min(k) FROM ({_KV}) WHERE k >= 500) AS ceiling_key, (SELECT v FROM ({_KV}) WHERE k = 7) AS value, EXISTS (SELECT 1 FROM ({_KV}) WHERE k = -9) AS there")
def map_points(spark, d):
    m = _map(spark, d)
    got = m.get(7)
    row = (m.first().k, m.last().k, m.get_le(500).k, m.get_ge(500).k, got.v if got else None, m.contains_key(-9))
    return spark.createDataFrame([row], "first_key long, last_key long, floor_key long, ceiling_key long, value long, there boolean")


@query(f"SELECT k AS x, 'key' AS kind FROM ({_KV}) UNION ALL SELECT v, 'value' FROM ({_KV})")
def map_keys_values(spark, d):
    m = _map(spark, d, Map)
    return m.keys().select(F.col("k").alias("x"), F.lit("key").alias("kind")).union(m.values().select("v", F.lit("value")))


@query("SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey BETWEEN 50 AND 900")
def raw_map_range(spark, d):
    """Keys and values as bytes whose order is that of the numbers."""
    m = RawMap.create(_catalog(spark))
    m.insert_all(load(spark, d, "customer").select(codec.encode_int(F.col("c_custkey")).alias("k"), codec.encode_string(F.col("c_name")).alias("v")))
    at = lambda n: bytearray((n + (1 << 63)).to_bytes(8, "big"))
    return m.range(at(50), at(900)).select(codec.decode_int(F.col("k")).alias("k"), codec.decode_string(F.col("v")).alias("v"))


@query("SELECT min(c_custkey) AS first_key, max(c_custkey) AS last_key, max(c_custkey) FILTER (WHERE c_custkey <= 333) AS floor_key, min(c_custkey) FILTER (WHERE c_custkey >= 333) AS ceiling_key, count(*) AS n, max(c_acctbal) FILTER (WHERE c_custkey = 12) AS balance FROM customer WHERE c_custkey <> 333")
def raw_key_map_points(spark, d):
    m = RawKeyMap.create(_catalog(spark), T.DoubleType())
    m.insert_all(load(spark, d, "customer").select(codec.encode_int(F.col("c_custkey")).alias("k"), F.col("c_acctbal").alias("v")))
    at = lambda n: bytearray((n + (1 << 63)).to_bytes(8, "big"))
    of = lambda r: int.from_bytes(r.k, "big") - (1 << 63)
    m.remove(at(333))
    got = m.get(at(12))
    row = (of(m.first()), of(m.last()), of(m.get_le(at(333))), of(m.get_ge(at(333))), len(m), got.v if got else None)
    return spark.createDataFrame([row], "first_key long, last_key long, floor_key long, ceiling_key long, n long, balance double")


_N = "(SELECT count(*) AS n FROM orders), (SELECT count(*) + 3 AS c FROM customer)"


@query(f"SELECT n + c AS added, n - c AS subtracted, n * c AS multiplied, CAST(trunc(-n / c) AS BIGINT) AS divided, -n % c AS remainder, n & c AS both, n | c AS any_bit, xor(n, c) AS either, n << 3 AS shifted, n >> 2 AS halved, -n AS negated, -n - 1 AS inverted, n < c AS below, n = c AS equal, n + 1 AS updated, c AS initialised FROM {_N}")
def single_values(spark, d):
    cat, n, c = _catalog(spark), load(spark, d, "orders").count(), load(spark, d, "customer").count() + 3
    a, b = Single.new(cat, n, T.LongType()), Single.new(cat, c, T.LongType())
    minus = Single.new(cat, -n, T.LongType())
    empty = Single.new(cat, None, T.LongType())
    empty.initialize_if_empty(c)
    empty.initialize_if_empty(0)
    row = [a + b, a - b, a * b, minus / b, minus % b, a & b, a | b, a ^ b, a << 3, a >> 2, -a, ~a, a < b, a == b]
    a.update(lambda x: x + 1)
    restored = Single.from_meta(Catalog(spark, cat.base_dir), a.save_meta()).get()
    kinds = ["added", "subtracted", "multiplied", "divided", "remainder", "both", "any_bit", "either", "shifted", "halved", "negated", "inverted"]
    return spark.createDataFrame([(*row, restored, empty.get())], ", ".join(f"{k} long" for k in kinds) + ", below boolean, equal boolean, updated long, initialised long")


# -- snapshots -------------------------------------------------------------------------------------------------

def _tree(spark, d):
    """Roots: all orders in bulk; every third changed; one entry removed from that."""
    t = SnapshotTree.new(_catalog(spark), KV, "k")
    x = _kv(spark, d)
    first = t.bulk_load(x)
    second = t.insert_all(first, x.filter("k % 3 = 0").withColumn("v", -F.col("v")))
    return t, first, second, t.remove(second, 6)


@query(f"SELECT 1 AS root, k, v FROM ({_KV}) UNION ALL SELECT 2, k, CASE WHEN k % 3 = 0 THEN -v ELSE v END FROM ({_KV}) UNION ALL SELECT 3, k, CASE WHEN k % 3 = 0 THEN -v ELSE v END FROM ({_KV}) WHERE k <> 6")
def tree_roots(spark, d):
    """Old roots stay as they were."""
    t, *roots = _tree(spark, d)
    a, b, c = (t.iter(r).select(F.lit(i + 1).alias("root"), "k", "v") for i, r in enumerate(roots))
    return a.union(b).union(c)


@query(f"SELECT k, CASE WHEN k % 3 = 0 THEN -v ELSE v END AS v FROM ({_KV}) WHERE k BETWEEN 10 AND 800")
def tree_range(spark, d):
    t, _, second, _ = _tree(spark, d)
    return t.range(second, 10, 800)


@query(f"SELECT count(*) AS kept, 1 AS deleted, 0 AS deleted_again FROM ({_KV}) WHERE k <> 6")
def tree_release_gc(spark, d):
    """What only released roots hold is deleted; a held root reads on."""
    t, first, second, third = _tree(spark, d)
    t.acquire(third)
    extra = t.insert(first, -1, -1)
    t.release(extra)
    t.release(third)
    t.rebuild_ref_counts([third])
    gone, again = t.gc(), t.gc()
    return spark.createDataFrame([(t.at(third).count(), gone, again)], "kept long, deleted int, deleted_again int")


# -- versioned repository ----------------------------------------------------------------------------------------

def _repository(spark, d):
    """main: all orders, then every fifth changed. dev, forked before that: every third removed, every seventh changed."""
    r = Repository.new(_catalog(spark), KV, "k")
    x = _kv(spark, d)
    r.insert_all(1, x)
    base = r.commit(1)
    dev = r.create_branch("dev", 1)
    r.insert_all(1, x.filter("k % 5 = 0").withColumn("v", F.col("v") + 1000000))
    r.commit(1)
    r.remove_all(dev, x.filter("k % 3 = 0"))
    r.insert_all(dev, x.filter("k % 7 = 0").withColumn("v", F.col("v") + 2000000))
    r.commit(dev)
    return r, base, dev


_MAIN = f"SELECT k, CASE WHEN k % 5 = 0 THEN v + 1000000 ELSE v END AS v FROM ({_KV})"
_DEV = f"SELECT k, CASE WHEN k % 7 = 0 THEN v + 2000000 ELSE v END AS v FROM ({_KV}) WHERE k % 3 <> 0 OR k % 7 = 0"
_MERGED = f"SELECT k, CASE WHEN k % 7 = 0 THEN v + 2000000 WHEN k % 5 = 0 THEN v + 1000000 ELSE v END AS v FROM ({_KV}) WHERE k % 3 <> 0 OR k % 7 = 0"


@query(_MERGED)
def repo_merge(spark, d):
    """The source wins where both sides changed a key, by its deletions too."""
    r, _, dev = _repository(spark, d)
    return r.at(r.merge(dev, 1))


@query(f"SELECT 'main' AS branch, * FROM ({_MAIN}) UNION ALL SELECT 'dev', * FROM ({_DEV}) UNION ALL SELECT 'base', * FROM ({_KV})")
def repo_branches(spark, d):
    r, base, dev = _repository(spark, d)
    named = lambda name, df: df.select(F.lit(name).alias("branch"), "k", "v")
    return named("main", r.iter(1)).union(named("dev", r.iter(dev))).union(named("base", r.iter_at_commit(base)))


@query(f"SELECT CASE WHEN n.k IS NULL THEN 'Removed' WHEN o.k IS NULL THEN 'Added' ELSE 'Modified' END AS change, coalesce(o.k, n.k) AS k, o.v AS old, n.v AS new FROM ({_KV}) o FULL JOIN ({_DEV}) n ON o.k = n.k WHERE o.v IS DISTINCT FROM n.v")
def repo_diff(spark, d):
    r, base, dev = _repository(spark, d)
    return r.diff_commits(base, r.head_commit(dev).id).select("change", "k", F.col("old_value.v").alias("old"), F.col("new_value.v").alias("new"))


@query(f"SELECT 'Modified' AS change, k, v AS old, -v AS new FROM ({_MAIN}) WHERE k % 11 = 0 AND v <> 0")
def repo_diff_uncommitted(spark, d):
    r, _, _ = _repository(spark, d)
    r.insert_all(1, r.iter(1).filter("k % 11 = 0").withColumn("v", -F.col("v")))
    out = r.diff_uncommitted(1).select("change", "k", F.col("old_value.v").alias("old"), F.col("new_value.v").alias("new"))
    return out


@query(f"SELECT k, v FROM ({_KV}) WHERE k BETWEEN 20 AND 700")
def repo_rollback_discard(spark, d):
    r, base, _ = _repository(spark, d)
    r.insert_all(1, _kv(spark, d).withColumn("v", F.lit(0).cast("long")))
    r.discard(1)
    r.rollback_to(1, base)
    return r.range(1, 20, 700)


@query("SELECT * FROM (VALUES (1, '', 2, 2), (2, '1', 1, 1), (3, '1', 1, -1), (4, '2,3', 1, 0)) t(commit_id, parents, refs, step)")
def repo_log(spark, d):
    """Commits with their parents, references and places in the first-parent log, after dev was merged and deleted."""
    r, base, dev = _repository(spark, d)
    head = r.merge(dev, 1)
    r.delete_branch(dev)
    line = [c.id for c in r.log(1)]
    rows = [r.get_commit(c) for c in range(base, head + 1)]
    return spark.createDataFrame([(c.id, ",".join(map(str, c.parents)), c.ref_count, line.index(c.id) if c.id in line else -1) for c in rows], "commit_id int, parents string, refs int, step int")


@query("SELECT 1 AS fork, '1' AS bases, 2 AS branches, 'dev' AS name, 0 AS dirty, 2 AS folders_deleted")
def repo_metadata(spark, d):
    """Fork point, merge bases, names; what an abandoned branch wrote is deleted by gc()."""
    r, base, dev = _repository(spark, d)
    heads = r.head_commit(1).id, r.head_commit(dev).id
    row = [r.fork_point(*heads), ",".join(map(str, r.find_merge_bases(*heads))), len(r.list_branches()), r.branch_name(r.branch_id("dev")), int(r.has_uncommitted(dev))]
    r.delete_branch(dev)
    return spark.createDataFrame([(*row, r.gc())], "fork int, bases string, branches int, name string, dirty int, folders_deleted int")


# -- slots, overlays, vectors, namespaces ---------------------------------------------------------------------------

_SLOTS = "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, event_id AS k FROM events"
_LIVE = f"SELECT * FROM ({_SLOTS}) WHERE k <> 5 UNION ALL SELECT 0, -1"


def _slot_index(spark, d, swap_order=False):
    i = SlotIndex.new(_catalog(spark), T.LongType(), T.LongType(), swap_order=swap_order)
    hour = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) div 3600")
    rows = load(spark, d, "events").select(hour.alias("slot"), F.col("event_id").alias("k"))
    i.insert_batch(rows)
    i.insert_batch(rows.filter("k % 2 = 0"))
    i.insert(0, -1)
    if row := rows.filter("k = 5").first():
        i.remove(row["slot"], 5)
    return i


@query(f"SELECT * FROM ({_LIVE})")
def slot_stored(spark, d):
    return _slot_index(spark, d).df


@query(f"SELECT row_number() OVER (ORDER BY slot DESC, k) AS place, k FROM (SELECT * FROM ({_LIVE}) ORDER BY slot DESC, k LIMIT 30 OFFSET 60)")
def slot_stored_page(spark, d):
    """The order of storage changes no page."""
    pages = [_slot_index(spark, d, s).get_entries_by_page(30, 2, reverse=True) for s in (False, True)]
    return spark.createDataFrame([(i + 1, k) for i, k in enumerate(pages[1]) if pages[0] == pages[1]], "place long, k long")


@query(f"WITH l AS ({_LIVE}), m AS (SELECT max(slot) - 5 AS s FROM l) SELECT (SELECT count(*) FROM l) AS total, (SELECT count(*) FROM l, m WHERE slot BETWEEN s AND s + 2) AS inside, (SELECT count(*) FROM l, m WHERE slot < s) AS leftward, (SELECT count(*) FROM l, m WHERE slot > s) AS rightward")
def slot_stored_counts(spark, d):
    i = _slot_index(spark, d)
    s = i.df.agg(F.max("slot")).first()[0] - 5
    row = (i.total(), i.entry_cnt_within_two_slots(s, s + 2), i.distance_to_the_leftmost_slot(s), i.distance_to_the_rightmost_slot(s))
    return spark.createDataFrame([row], "total long, inside long, leftward long, rightward long")


_NEAR = f"(SELECT slot, k FROM ({_SLOTS}) WHERE slot BETWEEN (SELECT min(slot) + 30 FROM ({_SLOTS})) AND (SELECT min(slot) + 200 FROM ({_SLOTS})))"


@query(f"SELECT * FROM {_NEAR} ORDER BY slot DESC, k LIMIT 25 OFFSET 50")
def slot_page_by_tiers_within(spark, d):
    from quernstone.operators import slots

    hour = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) div 3600")
    index = load(spark, d, "events").select(hour.alias("slot"), F.col("event_id").alias("k"))
    first = index.agg(F.min("slot")).first()[0] or 0
    return slots.page_by_tiers(index, slots.tiers(index, "slot", 16, levels=4), "slot", "k", 25, 2, 16, True, first + 30, first + 200)


_CUSTOMERS = "SELECT c_custkey AS k, c_name AS v FROM customer"
_SEEN = f"SELECT k, CASE WHEN k % 4 = 0 THEN 'child' || k ELSE v END AS v FROM ({_CUSTOMERS}) WHERE k % 6 <> 0"


def _overlays(spark, d):
    """A root with all customers; below it a node that changes every fourth and hides every sixth; a side branch."""
    o = OverlayMap.new(_catalog(spark), T.LongType())
    x = load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    root = o.new_node()
    o.insert_all(root, x)
    child, side = o.new_node(root), o.new_node(root)
    o.insert_all(child, x.filter("k % 4 = 0").withColumn("v", F.concat(F.lit("child"), "k")))
    o.remove_all(child, x.filter("k % 6 = 0"))
    o.insert_all(side, x.withColumn("v", F.lit("side")))
    return o, root, child, side


@query(_SEEN)
def overlay_stored_view(spark, d):
    o, _, child, _ = _overlays(spark, d)
    return OverlayMap.from_meta(Catalog(spark, o.catalog.base_dir), o.save_meta()).view(child)


@query(f"SELECT k, v, 1 AS nodes, false AS dead FROM ({_SEEN})")
def overlay_stored_prune(spark, d):
    o, _, child, _ = _overlays(spark, d)
    root = o.prune(child)
    return o.view(root).withColumns({"nodes": F.lit(o.nodes.count()).cast("int"), "dead": F.lit(o.is_dead(root))})


@query(f"SELECT node_id, count(*) AS n FROM (SELECT 1 AS node_id FROM ({_CUSTOMERS}) UNION ALL SELECT 2 FROM ({_CUSTOMERS}) WHERE k % 4 = 0 OR k % 6 = 0) GROUP BY node_id")
def overlay_stored_destroy(spark, d):
    o, root, _, side = _overlays(spark, d)
    o.prune_children(root, [o.new_node(side)])
    o.destroy(side)
    return o.df.groupBy(F.col("node_id").cast("int").alias("node_id")).agg(F.count("*").alias("n"))


_DIST = "power(list_distance(CAST(e.embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)), 2)"


@query(f"SELECT vec_id AS k, round(dist, 6) AS distance FROM (SELECT vec_id, {_DIST} AS dist FROM embeddings e WHERE vec_id <> 3 AND vec_id % 2 = 1) ORDER BY dist, k LIMIT 12")
def vec_stored_search(spark, d):
    """Stored, changed, compacted, restored, then searched with a filter."""
    v = load(spark, d, "embeddings").select(F.col("vec_id").alias("k"), F.col("embedding").cast("array<double>").alias("vec"))
    first = v.first()
    s = StoredVectors.new(_catalog(spark), T.LongType(), VectorConfig(len(first["vec"]) if first else 64))
    index = s.index
    index.insert_batch(v.withColumn("vec", F.transform("vec", lambda x: x + 1)))
    index.insert_batch(v)
    asked = index.get(3)
    index.remove(3)
    index.compact()
    s.store(index)
    again = StoredVectors.from_meta(Catalog(spark, s.catalog.base_dir), s.save_meta(), "l2").index
    return spark.createDataFrame(again.search(asked, 12, F.col("k") % 2 == 1), "k long, distance double").withColumn("distance", F.round("distance", 6))


@query(f"SELECT 2 AS id, count(*) AS n, true AS reopened FROM ({_KV})")
def namespaces(spark, d):
    """Of two namespaces one is destroyed; the other is closed, found by a new catalog and opened again."""
    c = _catalog(spark)
    one, two = c.create_ns(), c.create_ns()
    for ns in (one, two):
        with ns.scope():
            m = OrderedMap.new(c, KV, "k")
            m.insert_all(_kv(spark, d))
            m.release()
    iid = m.instance_id
    one.close(), two.close()
    c.destroy_ns(one.id)
    fresh = Catalog(spark, c.base_dir)
    rows = [(x["id"], fresh.open_ns(x["id"]).id == iid.ns) for x in fresh.list_ns()]
    n = len(OrderedMap.from_meta(fresh, iid, KV))
    return spark.createDataFrame([(i, n, ok) for i, ok in rows], "id int, n long, reopened boolean")


# -- commitments ------------------------------------------------------------------------------------------------------

@query(f"SELECT kind, (SELECT count(*) FROM ({_CUSTOMERS})) AS entries, true AS same, true AS moved FROM (VALUES ('smt'), ('mpt')) t(kind)")
def trie_incremental_root(spark, d):
    """Roots over all customers: changed part by part and built anew they agree, and they differ from the first one."""
    x, rows = load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), []
    changed = entries(x.filter("k % 3 = 0").withColumn("v", F.upper("v")), "k")
    whole = entries(x.withColumn("v", F.when(F.col("k") % 3 == 0, F.upper("v")).otherwise(F.col("v"))), "k")
    for kind in ("smt", "mpt"):
        calc = trie.TrieCalculator(entries(x.filter("k % 3 <> 0"), "k"), kind, 500)
        first = calc.root_hash()
        calc.batch_update(changed)
        anew = trie.TrieCalculator(whole, kind)
        rows.append((kind, calc.df.count(), calc.root_hash() == anew.root_hash(), first != calc.root_hash()))
    return spark.createDataFrame(rows, "kind string, entries long, same boolean, moved boolean")


@query(f"SELECT CAST(k AS BIGINT) AS k, CAST(v AS VARCHAR) AS v, true AS holds, false AS forged FROM (SELECT t.k, CAST(o.v AS VARCHAR) AS v FROM (VALUES (1), (6), (77), (-4)) t(k) LEFT JOIN ({_MERGED}) o ON o.k = t.k)")
def repo_proofs(spark, d):
    """Proofs of presence and absence under the root of a merged branch."""
    r, _, dev = _repository(spark, d)
    r.merge(dev, 1)
    proven = ProvenRepository(r, "smt")
    root = proven.merkle_root(1)
    rows = []
    for k in (1, 6, 77, -4):
        key = (k + (1 << 63)).to_bytes(8, "big")
        p = proven.prove(key)
        value = None if p.value is None else str(int.from_bytes(p.value, "big") - (1 << 63))
        rows.append((k, value, proven.verify_proof(root, key, p), proven.verify_proof(root, key + b"x", p)))
    return spark.createDataFrame(rows, "k long, v string, holds boolean, forged boolean")

"""The library's queries over the driver's tables, each with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import codec, keccak
from quernstone.operators import kv, overlay, slots, trie, vectors, versioned
from quernstone.plans import history

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# -- key-value ---------------------------------------------------------------------------------------------

def _orders(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


_ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders"


@query(f"{_ORDERS} WHERE o_orderkey = 77")
def kv_get(spark, d):
    return kv.get(_orders(spark, d), "o_orderkey", 77)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def kv_multi_get(spark, d):
    keys = _orders(spark, d).filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return kv.multi_get(load(spark, d, "customer").select("c_custkey", "c_name"), keys, "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def kv_contains(spark, d):
    keys = load(spark, d, "customer").select("c_custkey")
    return kv.contained(keys, _orders(spark, d).withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def kv_missing(spark, d):
    return kv.missing(load(spark, d, "documents").select("doc_id", "lang"), load(spark, d, "labels"), "doc_id")


@query(f"{_ORDERS} WHERE o_orderkey BETWEEN 100 AND 5000")
def kv_range_incl(spark, d):
    return kv.key_range(_orders(spark, d), "o_orderkey", 100, 5000, ordered=False)


@query(f"{_ORDERS} WHERE o_orderkey > 100 AND o_orderkey < 5000")
def kv_range_excl(spark, d):
    return kv.key_range(_orders(spark, d), "o_orderkey", 100, 5000, low_open=True, high_open=True)


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red')")
def kv_prefix_scan(spark, d):
    return kv.prefix_scan(load(spark, d, "part").select("p_partkey", "p_name"), "p_name", "red")


@query(f"{_ORDERS} ORDER BY o_orderkey LIMIT 1")
def kv_first(spark, d):
    return kv.first(_orders(spark, d), "o_orderkey")


@query(f"{_ORDERS} ORDER BY o_orderkey DESC LIMIT 1")
def kv_last(spark, d):
    return kv.last(_orders(spark, d), "o_orderkey")


@query("SELECT n_name, n_regionkey FROM nation WHERE n_name <= 'NATION_17x' ORDER BY n_name DESC LIMIT 1")
def kv_floor(spark, d):
    return kv.floor(load(spark, d, "nation").select("n_name", "n_regionkey"), "n_name", "NATION_17x")


@query("SELECT n_name, n_regionkey FROM nation WHERE n_name >= 'NATION_17x' ORDER BY n_name LIMIT 1")
def kv_ceiling(spark, d):
    return kv.ceiling(load(spark, d, "nation").select("n_name", "n_regionkey"), "n_name", "NATION_17x")


def _asof(spark, d, forward=False, by=True, buckets=7):
    e = load(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'click'").groupBy("user_id", F.col("ts").alias("click_ts")).agg(F.max("event_id").alias("click_id"))
    if not by:
        right = right.groupBy("click_ts").agg(F.max("click_id").alias("click_id"))
    return kv.asof_join(left, right, "ts", "click_ts", ["click_id"], ["user_id"] if by else None, forward, buckets).select("event_id", F.coalesce("click_id", F.lit(-1).cast("long")).alias("click_id"))


def _asof_sql(op: str, by: bool) -> str:
    r = "SELECT user_id, ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY user_id, ts" if by else "SELECT ts, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY ts"
    on = "e.user_id = r.user_id AND " if by else ""
    return f"SELECT e.event_id, coalesce(r.click_id, -1) AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN ({r}) r ON {on}e.ts {op} r.ts"


@query(_asof_sql(">=", True))
def kv_floor_asof(spark, d):
    return _asof(spark, d)


@query(_asof_sql("<=", True))
def kv_ceiling_asof(spark, d):
    return _asof(spark, d, forward=True)


@query(_asof_sql(">=", False))
def kv_floor_asof_all(spark, d):
    return _asof(spark, d, by=False)


@query(_asof_sql("<=", False))
def kv_ceiling_asof_all(spark, d):
    return _asof(spark, d, forward=True, by=False)


@query("SELECT e.event_id, o.o_orderkey FROM orders o JOIN events e ON e.event_id BETWEEN o.o_orderkey AND o.o_orderkey + 3")
def kv_range_join(spark, d):
    ranges = _orders(spark, d).select("o_orderkey", F.col("o_orderkey").alias("low"), (F.col("o_orderkey") + 3).alias("high"))
    return kv.range_join(load(spark, d, "events").select("event_id"), ranges, "event_id", "low", "high", 64).select("event_id", "o_orderkey")


_DELTA = "SELECT o_orderkey + CASE WHEN o_orderkey % 3 = 0 THEN 10000000 ELSE 0 END AS o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice, 'X' AS o_orderstatus FROM orders WHERE o_orderkey % 5 = 0"


def _delta(spark, d):
    o = _orders(spark, d).filter("o_orderkey % 5 = 0")
    return o.select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 3 == 0, 10000000).otherwise(0)).alias("o_orderkey"), "o_custkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("X").alias("o_orderstatus"))


@query(f"WITH x AS ({_DELTA}) {_ORDERS} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM x) UNION ALL SELECT * FROM x")
def kv_upsert(spark, d):
    return kv.upsert(_orders(spark, d), _delta(spark, d), "o_orderkey")


@query(f"WITH x AS ({_DELTA}) {_ORDERS} WHERE o_orderkey NOT IN (SELECT o_orderkey FROM x)")
def kv_remove(spark, d):
    return kv.remove(_orders(spark, d), _delta(spark, d), "o_orderkey")


@query(f"WITH x AS ({_DELTA}) {_ORDERS} UNION ALL SELECT * FROM x WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def kv_or_insert(spark, d):
    return kv.or_insert(_orders(spark, d), _delta(spark, d), "o_orderkey")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey BETWEEN 10 AND 900 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders")
def kv_update(spark, d):
    return kv.update(_orders(spark, d), kv.between("o_orderkey", 10, 900), "o_totalprice", F.col("o_totalprice") * 2)


_OPS = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, CASE WHEN l_linenumber % 4 = 3 THEN 'D' ELSE 'P' END AS op FROM lineitem"
_LAST = f"SELECT l_orderkey, l_quantity, op FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS r FROM ({_OPS})) WHERE r = 1"


def _ops(spark, d):
    seq = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return load(spark, d, "lineitem").select("l_orderkey", "l_quantity", F.when(F.col("l_linenumber") % 4 == 3, "D").otherwise("P").alias("op"), seq.alias("seq"))


def _base(spark, d):
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") * 0 - 1).alias("l_quantity"))


@query(f"WITH x AS ({_LAST}) SELECT o_orderkey AS l_orderkey, o_totalprice * 0 - 1 AS l_quantity FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM x) UNION ALL SELECT l_orderkey, l_quantity FROM x WHERE op = 'P'")
def kv_batch_lastwins(spark, d):
    return kv.apply_batch(_base(spark, d), _ops(spark, d), "l_orderkey")


@query(f"SELECT l_orderkey, l_quantity FROM ({_LAST}) WHERE op = 'P'")
def kv_batch_wiped(spark, d):
    return kv.apply_batch(_base(spark, d), _ops(spark, d), "l_orderkey", wiped=True)


@query("SELECT x, row_number() OVER (ORDER BY x) AS place, x AS back FROM (SELECT DISTINCT CAST(o_custkey - 700 AS BIGINT) AS x FROM orders)")
def codec_int_order(spark, d):
    """Codes sort as the numbers do, and give them back."""
    from pyspark.sql import Window

    x = load(spark, d, "orders").select((F.col("o_custkey") - 700).alias("x")).distinct().withColumn("code", codec.encode_int(F.col("x")))
    # places are the feature here; a table of distinct customer numbers is small
    return x.withColumn("place", F.row_number().over(Window.orderBy("code")).cast("long")).select("x", "place", codec.decode_int(F.col("code")).alias("back"))


# -- versioning --------------------------------------------------------------------------------------------

_A = "SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 11 <> 0"
_S = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 5 <> 0"
_T = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 2 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 7 <> 0"
_B = "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN o_totalprice + 3 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 13 <> 0"


def _sides(spark, d):
    o = load(spark, d, "orders")
    edit = lambda gone, m, plus: o.filter(F.col("o_orderkey") % gone != 0).select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % m == 0, F.col("o_totalprice") + plus).otherwise(F.col("o_totalprice")).alias("v"))
    return edit(11, 1_000_000_007, 0), edit(5, 3, 1), edit(7, 4, 2), edit(13, 6, 3)


def _flat(diff: DataFrame) -> DataFrame:
    return diff.select("change", "k", F.col("old_value.v").alias("old_v"), F.col("new_value.v").alias("new_v"))


@query(f"SELECT CASE WHEN a.k IS NULL THEN 'Added' WHEN s.k IS NULL THEN 'Removed' ELSE 'Modified' END AS change, coalesce(a.k, s.k) AS k, a.v AS old_v, s.v AS new_v FROM ({_A}) a FULL JOIN ({_S}) s ON a.k = s.k WHERE a.k IS NULL OR s.k IS NULL OR a.v IS DISTINCT FROM s.v")
def ver_diff(spark, d):
    a, s, _, _ = _sides(spark, d)
    return _flat(versioned.diff(a, s, "k"))


_MERGE = "SELECT k, CASE WHEN {same} THEN tv ELSE sv END AS v FROM (SELECT coalesce(a.k, s.k, t.k) AS k, a.k IS NOT NULL AS ia, s.k IS NOT NULL AS ins, t.k IS NOT NULL AS it, a.v AS av, s.v AS sv, t.v AS tv, b.k IS NOT NULL AS ib, b.v AS bv FROM (" + _A + ") a FULL JOIN (" + _S + ") s ON a.k = s.k FULL JOIN (" + _T + ") t ON coalesce(a.k, s.k) = t.k FULL JOIN (" + _B + ") b ON coalesce(a.k, s.k, t.k) = b.k) WHERE k IS NOT NULL AND CASE WHEN {same} THEN it ELSE ins END"
_SAME = "(ia = ins AND av IS NOT DISTINCT FROM sv)"


@query(_MERGE.format(same=_SAME))
def ver_merge(spark, d):
    a, s, t, _ = _sides(spark, d)
    return versioned.merge(a, s, t, "k")


@query(_MERGE.format(same=f"({_SAME} AND ia = ib AND av IS NOT DISTINCT FROM bv)"))
def ver_merge_multibase(spark, d):
    a, s, t, b = _sides(spark, d)
    return versioned.merge_many([a, b], s, t, "k")


@query(f"SELECT coalesce(s.k, t.k) AS k, CASE WHEN s.k IS NOT NULL THEN s.v ELSE t.v END AS v FROM ({_S}) s FULL JOIN ({_T}) t ON s.k = t.k")
def ver_merge_unrelated(spark, d):
    _, s, t, _ = _sides(spark, d)
    return versioned.merge_many([], s, t, "k")


@query("SELECT l_orderkey AS k, l_quantity AS v FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS r FROM lineitem WHERE l_linenumber <= 4) WHERE r = 1 AND l_returnflag <> 'R'")
def ver_time_travel(spark, d):
    """The state after the deltas of lines 1 to 4, a returned line being a deletion."""
    x = load(spark, d, "lineitem").filter("l_linenumber <= 4")
    seq = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    deltas = x.select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("v"), F.when(F.col("l_returnflag") == "R", "D").otherwise("P").alias("op"), seq.alias("seq"))
    return versioned.snapshot(deltas, "k", ["k", "v"])


#: A commit graph of every supplier: a first parent, for every fourth a second one. Neighbours in number are compared.
_PARENTS = "SELECT s_suppkey AS c, s_suppkey - 1 - s_suppkey % 3 AS p, 0 AS i FROM supplier UNION ALL SELECT s_suppkey, s_suppkey - 2 - s_suppkey % 5, 1 FROM supplier WHERE s_suppkey % 4 = 0"
_EDGES = f"e AS (SELECT c, p, i FROM ({_PARENTS}) WHERE p IN (SELECT s_suppkey FROM supplier))"
_FIRST = f"WITH RECURSIVE {_EDGES}, l(c, step) AS (SELECT max(s_suppkey), 0 FROM supplier UNION ALL SELECT e.p, l.step + 1 FROM l JOIN e ON e.c = l.c AND e.i = 0)"


def _graph(spark, d) -> history.Graph:
    """Commits are metadata: a row each, and known to the driver."""
    k = F.col("s_suppkey")
    first, second = (k - 1 - k % 3).cast("long"), F.when(k % 4 == 0, (k - 2 - k % 5).cast("long"))
    rows = load(spark, d, "supplier").select(k.cast("long").alias("c"), first.alias("p"), second.alias("q")).collect()
    known = {r["c"] for r in rows}
    return {r["c"]: [p for p in (r["p"], r["q"]) if p in known] for r in rows}


@query(f"{_FIRST} SELECT CAST(step AS BIGINT) AS step, CAST(c AS BIGINT) AS commit_id FROM l")
def ver_log(spark, d):
    g = _graph(spark, d)
    return spark.createDataFrame(list(enumerate(history.log(g, max(g, default=None)))), "step long, commit_id long")


@query(f"{_FIRST} SELECT CAST(c AS BIGINT) AS ancestor, CAST(step AS BIGINT) AS distance FROM l")
def ver_distance(spark, d):
    g = _graph(spark, d)
    rows = [(c, history.distance(g, max(g, default=None), c)) for c in g]
    return spark.createDataFrame([r for r in rows if r[1] is not None], "ancestor long, distance long")


_REACH = f"WITH RECURSIVE {_EDGES}, r(top, c) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT r.top, e.p FROM r JOIN e ON e.c = r.c), common AS MATERIALIZED (SELECT x.top AS a, y.top AS b, x.c FROM r x JOIN r y ON x.c = y.c AND y.top = x.top + 1)"
_BASES = _REACH + " SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS base FROM common m WHERE NOT EXISTS (SELECT 1 FROM common o JOIN r ON r.top = o.c AND r.c = m.c WHERE o.a = m.a AND o.b = m.b AND o.c <> m.c)"


@query(_BASES)
def ver_merge_bases(spark, d):
    g = _graph(spark, d)
    rows = [(a, a + 1, c) for a in g if a + 1 in g for c in history.merge_bases(g, a, a + 1)]
    return spark.createDataFrame(rows, "a long, b long, base long")


@query(f"SELECT a, b, max(base) AS fork FROM ({_BASES}) GROUP BY a, b")
def ver_fork_point(spark, d):
    g = _graph(spark, d)
    rows = [(a, a + 1, history.fork_point(g, a, a + 1)) for a in g if a + 1 in g]
    return spark.createDataFrame([r for r in rows if r[2] is not None], "a long, b long, fork long")


# -- slot index --------------------------------------------------------------------------------------------

_SLOTS = "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, event_id FROM events"


def _hour():
    """Hours since 1970 of a time without zone, whatever the session's zone is."""
    return F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) div 3600")


def _slots(spark, d):
    return load(spark, d, "events").select(_hour().alias("slot"), "event_id")



@query(f"SELECT * FROM ({_SLOTS}) ORDER BY slot, event_id LIMIT 40 OFFSET 400")
def slot_page_fwd(spark, d):
    return slots.page(_slots(spark, d), "slot", "event_id", 40, 10)


@query(f"SELECT * FROM ({_SLOTS}) ORDER BY slot DESC, event_id LIMIT 40 OFFSET 120")
def slot_page_rev(spark, d):
    return slots.page(_slots(spark, d), "slot", "event_id", 40, 3, reverse=True)


_DAY = f"(SELECT * FROM ({_SLOTS}) WHERE slot BETWEEN (SELECT min(slot) + 24 FROM ({_SLOTS})) AND (SELECT min(slot) + 47 FROM ({_SLOTS})))"


def _day(spark, d) -> tuple[int, int]:
    first = _slots(spark, d).agg(F.min("slot")).first()[0] or 0
    return first + 24, first + 47


@query(f"SELECT * FROM {_DAY} ORDER BY slot DESC, event_id LIMIT 20 OFFSET 60")
def slot_page_slot_rev(spark, d):
    left, right = _day(spark, d)
    return slots.page(_slots(spark, d), "slot", "event_id", 20, 3, True, left, right)


@query(f"SELECT * FROM ({_SLOTS}) ORDER BY slot DESC, event_id LIMIT 80 OFFSET 7200")
def slot_page_by_tiers(spark, d):
    index = _slots(spark, d)
    return slots.page_by_tiers(index, slots.tiers(index, "slot", 16, levels=4).cache(), "slot", "event_id", 80, 90, 16, reverse=True)


@query("SELECT user_id, slot, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY slot DESC, event_id) AS r FROM (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, event_id FROM events)) WHERE r > 2 AND r <= 4")
def slot_page_by_group(spark, d):
    index = load(spark, d, "events").select("user_id", _hour().alias("slot"), "event_id")
    return slots.page_by_group(index, ["user_id"], "slot", "event_id", 2, 1, reverse=True)


@query(f"SELECT count(*) AS n FROM {_DAY}")
def slot_count_range(spark, d):
    return _slots(spark, d).filter(kv.between("slot", *_day(spark, d))).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS n FROM ({_SLOTS})")
def slot_total(spark, d):
    return _slots(spark, d).agg(F.count("*").alias("n"))


@query(f"SELECT CAST(count(*) FILTER (WHERE slot < (SELECT min(slot) FROM {_DAY})) AS BIGINT) AS leftward, CAST(count(*) FILTER (WHERE slot > (SELECT min(slot) FROM {_DAY})) AS BIGINT) AS rightward FROM ({_SLOTS})")
def slot_rank(spark, d):
    index, (left, _) = _slots(spark, d), _day(spark, d)
    return spark.createDataFrame([(slots.rank_of(index, "slot", left), slots.rank_of(index, "slot", left, True))], "leftward long, rightward long")


@query(" UNION ALL ".join(f"SELECT {lv} AS level, CAST(slot - slot % {16**lv} AS BIGINT) AS slot_floor, CAST(count(*) AS BIGINT) AS n FROM ({_SLOTS}) GROUP BY ALL" for lv in (1, 2, 3)))
def slot_tiers(spark, d):
    return slots.tiers(_slots(spark, d), "slot", 16, levels=3)


@query(f"SELECT slot, event_id FROM ({_SLOTS}) UNION SELECT slot + event_id % 2, event_id FROM ({_SLOTS}) WHERE event_id % 3 = 0")
def slot_insert(spark, d):
    index = _slots(spark, d)
    return slots.insert(index, index.filter("event_id % 3 = 0").select((F.col("slot") + F.col("event_id") % 2).alias("slot"), "event_id"))


@query(f"SELECT slot, event_id FROM ({_SLOTS}) WHERE NOT (event_id % 4 = 0)")
def slot_remove(spark, d):
    index = _slots(spark, d)
    return slots.remove(index, index.filter("event_id % 4 = 0").union(index.filter("event_id % 5 = 0").select(F.col("slot") + 9_000_000, "event_id")))


# -- overlays ----------------------------------------------------------------------------------------------

_DATA = "SELECT 1 AS node_id, c_custkey AS k, c_name AS v FROM customer UNION ALL SELECT 2, c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'two' || c_custkey END FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 3, c_custkey + c_custkey % 2 * 1000000, 'three' || c_custkey FROM customer WHERE c_custkey % 4 = 1 UNION ALL SELECT 4, c_custkey, 'side' FROM customer UNION ALL SELECT 5, c_custkey, 'child' FROM customer WHERE c_custkey < 50"
_NODES = [(1, None), (2, 1), (3, 2), (4, 2), (5, 3)]
_VIEW = f"SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY node_id DESC) AS r FROM ({_DATA}) WHERE node_id <= 3) WHERE r = 1 AND v <> ''"


def _overlay(spark, d):
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    node = lambda n, df: df.select(F.lit(n).cast("long").alias("node_id"), "k", "v")
    k = F.col("k")
    data = node(1, c).union(node(2, c.filter(k % 3 == 0).withColumn("v", F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("two"), k)))))
    data = data.union(node(3, c.filter(k % 4 == 1).select((k + k % 2 * 1000000).alias("k"), F.concat(F.lit("three"), k).alias("v"))))
    data = data.union(node(4, c.withColumn("v", F.lit("side")))).union(node(5, c.filter("k < 50").withColumn("v", F.lit("child"))))
    return spark.createDataFrame(_NODES, "node_id long, parent_id long"), data


@query(_VIEW)
def dag_view(spark, d):
    return overlay.view(*_overlay(spark, d), 3)


@query(f"SELECT * FROM ({_VIEW}) WHERE k = 33")
def dag_get(spark, d):
    return overlay.get(*_overlay(spark, d), 3, 33)


@query(f"SELECT CAST(1 AS BIGINT) AS node_id, k, v FROM ({_VIEW}) UNION ALL SELECT 5, c_custkey, 'child' FROM customer WHERE c_custkey < 50")
def dag_prune(spark, d):
    return overlay.prune(*_overlay(spark, d), 3)[1]


@query("SELECT CAST(1 AS BIGINT) AS node_id, CAST(0 AS BIGINT) AS parent_id UNION ALL SELECT 5, 1")
def dag_prune_nodes(spark, d):
    return overlay.prune(*_overlay(spark, d), 3)[0].fillna(0, "parent_id")


@query(f"SELECT CAST(node_id AS BIGINT) AS node_id, k, v FROM ({_DATA}) WHERE node_id IN (1, 2, 4)")
def dag_destroy(spark, d):
    return overlay.destroy(*_overlay(spark, d), 3)[1]


@query(f"SELECT CAST(node_id AS BIGINT) AS node_id, k, v FROM ({_DATA}) WHERE node_id <> 4")
def dag_prune_children(spark, d):
    return overlay.prune_children(*_overlay(spark, d), 2, [3], exclude=True)[1]


# -- vectors -----------------------------------------------------------------------------------------------

_V = "CAST(e.embedding AS DOUBLE[])"
_Q = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7)"
_DIST = {"l2": "power(list_distance({a}, {b}), 2)", "cosine": "list_cosine_distance({a}, {b})", "inner_product": "-list_inner_product({a}, {b})"}


def _knn_sql(metric: str, where: str = "") -> str:
    return f"SELECT vec_id, round(dist, 6) AS distance FROM (SELECT e.vec_id, {_DIST[metric].format(a=_V, b=_Q)} AS dist FROM embeddings e {where}) ORDER BY dist, vec_id LIMIT 10"


def _knn(spark, d, metric, where=None):
    v = load(spark, d, "embeddings")
    q = v.filter("vec_id = 7").first()["embedding"]
    return vectors.knn(v, q, 10, "vec_id", "embedding", metric, where).select("vec_id", F.round("distance", 6).alias("distance"))


@query(_knn_sql("l2"))
def vec_knn_l2(spark, d):
    return _knn(spark, d, "l2")


@query(_knn_sql("cosine"))
def vec_knn_cosine(spark, d):
    return _knn(spark, d, "cosine")


@query(_knn_sql("inner_product"))
def vec_knn_ip(spark, d):
    return _knn(spark, d, "inner_product")


@query(_knn_sql("l2", "WHERE label = 3"))
def vec_knn_filtered(spark, d):
    return _knn(spark, d, "l2", F.col("label") == 3)


def _batch_sql(metric: str) -> str:
    dist = _DIST[metric].format(a="CAST(e.embedding AS DOUBLE[])", b="CAST(q.embedding AS DOUBLE[])")
    return f"SELECT q AS query_id, CAST(r AS INT) AS rank, vec_id, round(dist, 6) AS distance FROM (SELECT q.vec_id AS q, e.vec_id, {dist} AS dist, row_number() OVER (PARTITION BY q.vec_id ORDER BY {dist}, e.vec_id) AS r FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE r <= 5"


def _batch(spark, d, metric):
    v = load(spark, d, "embeddings")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return vectors.knn_join(v, q, 5, "vec_id", "embedding", "query_id", "qvec", metric).withColumn("distance", F.round("distance", 6))


@query(_batch_sql("l2"))
def vec_knn_batch_l2(spark, d):
    return _batch(spark, d, "l2")


@query(_batch_sql("cosine"))
def vec_knn_batch_cosine(spark, d):
    return _batch(spark, d, "cosine")


@query(_batch_sql("inner_product"))
def vec_knn_batch_ip(spark, d):
    return _batch(spark, d, "inner_product")


@query()
def vec_search_graph(spark, d):
    """Approximate; its recall is tested against exact search."""
    v = load(spark, d, "embeddings")
    asked = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qvec"))
    return vectors.search_graph(v, asked, 10, vectors.VectorConfig(64), "vec_id", "embedding")


# -- commitments -------------------------------------------------------------------------------------------

def _entries(spark, d, table="customer", key="c_custkey", value="c_name"):
    return load(spark, d, table).select(codec.encode_int(F.col(key)).alias("k"), codec.encode_string(F.col(value)).alias("v"))


@query()
def trie_keccak(spark, d):
    return load(spark, d, "nation").select("n_name", F.hex(keccak.keccak256_column(codec.encode_string(F.col("n_name")))).alias("digest"))


@query()
def trie_smt_root(spark, d):
    return spark.createDataFrame([(trie.smt_root(_entries(spark, d)).hex(),)], "root string")


@query()
def trie_mpt_root(spark, d):
    return spark.createDataFrame([(trie.mpt_root(_entries(spark, d)).hex(),)], "root string")


def _proofs(spark, d, kind):
    calc = trie.TrieCalculator(_entries(spark, d, "nation", "n_nationkey", "n_name"), kind, 8)
    root = calc.root_hash()
    rows = []
    for n in (0, 7, 24, 99):
        key = (n + (1 << 63)).to_bytes(8, "big")
        p = calc.prove(key)
        rows.append((n, "" if p.value is None else p.value.decode(), calc.verify(root, key, p)))
    return spark.createDataFrame(rows, "n_nationkey int, n_name string, proven boolean")


_PROVEN = "SELECT CAST(k AS INT) AS n_nationkey, coalesce(n_name, '') AS n_name, true AS proven FROM (VALUES (0), (7), (24), (99)) t(k) LEFT JOIN nation ON n_nationkey = k"


@query(_PROVEN)
def trie_smt_proofs(spark, d):
    return _proofs(spark, d, "smt")


@query(_PROVEN)
def trie_mpt_proofs(spark, d):
    return _proofs(spark, d, "mpt")


# the queries over stored collections register themselves
from quernstone import stored_queries  # noqa: E402, F401

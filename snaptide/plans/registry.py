"""Registry of queries over the given tables, each with an equivalent SQL
statement (the oracle, DuckDB dialect).

Every query reads whole tables; arithmetic on keys only decides which rows
change between two derived captures (see ``table_snapshots``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptide.operators import flatten as fl
from snaptide.operators.merge import merge_snapshot, survivors
from snaptide.plans.table_snapshots import (
    CLUSTER, REPLICAS_SQL, REPORT_SQL, T0, T1, TOPICS_SQL, events_snapshot_rows, region_snapshot_rows,
    replica_snapshot_rows, to_ntz,
    topic_snapshot_rows, ts,
    two_snapshot_merge_sql, cluster_of, cluster_sql, sql_ts,
)
from snaptide.schemas import TABLES
from snaptide.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AUDIT_NTZ = ("discovered_at", "modified_at", "refreshed_at")


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


# ------------------------------------------------------------ topics (M4/X1) --

def topics_merge(spark: SparkSession, sf_dir: str, delete: bool, incremental: bool = False) -> DataFrame:
    """Minimum slice: flatten the topics of two captures (F3), merge the second
    into the state built from the first (M4), remove stale topics (X1)."""
    orders = Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    snap_a = topic_snapshot_rows(orders, "A")
    snap_b = topic_snapshot_rows(orders, "B")
    spec = TABLES["topics"]
    if not delete:
        spec = spec.__class__(**{**spec.__dict__, "delete_stale": False})
    state = survivors(merge_snapshot(None, fl.topics(snap_a), spec))
    merged = merge_snapshot(state, fl.topics(snap_b), spec, scope=fl.section_scope(snap_b, "topics"),
                            incremental=incremental)
    return to_ntz(merged, *AUDIT_NTZ)


_TOPIC_CMP = (("name", "="), ("internal", "="))


@register("merge_delete_stale",
          two_snapshot_merge_sql(TOPICS_SQL["A"], TOPICS_SQL["B"], ["k_cluster_id", "k_topic_id"],
                                 _TOPIC_CMP, delete="scope"))
def merge_delete_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics_merge(spark, sf_dir, delete=True)


@register("merge_keep_missing",
          two_snapshot_merge_sql(TOPICS_SQL["A"], TOPICS_SQL["B"], ["k_cluster_id", "k_topic_id"],
                                 _TOPIC_CMP, delete=None))
def merge_keep_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics_merge(spark, sf_dir, delete=False)


@register("merge_delete_stale_full",
          two_snapshot_merge_sql(TOPICS_SQL["A"], TOPICS_SQL["B"], ["k_cluster_id", "k_topic_id"],
                                 _TOPIC_CMP, delete="scope"))
def merge_delete_stale_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows by the plan for captures far smaller than the state (left join, anti join, union)."""
    return topics_merge(spark, sf_dir, delete=True, incremental=True)


# ------------------------------------------------- generic two-capture merges --

def two_capture_merge(a: DataFrame, b: DataFrame, spec, delete: bool,
                      scope: DataFrame | None = None, dedupe_order=()) -> DataFrame:
    """State from capture A, then capture B merged into it. Both are full
    captures (about as large as the state)."""
    spec = spec.__class__(**{**spec.__dict__, "delete_stale": delete})
    state = survivors(merge_snapshot(None, a, spec, dedupe_order=dedupe_order))
    if delete and scope is None:
        scope = b.select("k_cluster_id", "refreshed_at").distinct()
    merged = merge_snapshot(state, b, spec, scope=scope, dedupe_order=dedupe_order)
    return to_ntz(merged, *AUDIT_NTZ)


def _spec(name, keys, compare=()):
    return TABLES["topics"].__class__(name=name, keys=tuple(keys), compare=tuple(compare))


_ORDERS_KEYS = ["k_cluster_id", "o_orderkey"]


def _orders(spark, sf_dir, *cols):
    return Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey", *cols)


def _capture(df: DataFrame, which: str, **cols) -> DataFrame:
    k = F.col("o_orderkey")
    rows = df.filter(k % 10 != 0) if which == "A" else df.filter(k % 10 != 1)
    at = ts(T0) if which == "A" else ts(T1)
    return rows.select(cluster_of("o_custkey").alias("k_cluster_id"), "o_orderkey",
                       *[c.alias(n) for n, c in cols.items()], at.alias("refreshed_at"))


_KEY_SQL = {"A": "o_orderkey % 10 <> 0", "B": "o_orderkey % 10 <> 1"}
_OC = cluster_sql("o_custkey")
_LC = cluster_sql("l_orderkey")


@register("merge_touch", two_snapshot_merge_sql(
    f"SELECT {_OC} AS k_cluster_id, o_orderkey FROM orders WHERE {_KEY_SQL['A']}",
    f"SELECT {_OC} AS k_cluster_id, o_orderkey FROM orders WHERE {_KEY_SQL['B']}",
    _ORDERS_KEYS, (), delete=None))
def merge_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6 class: a match only moves refreshed_at."""
    o = _orders(spark, sf_dir)
    return two_capture_merge(_capture(o, "A"), _capture(o, "B"), _spec("touch", _ORDERS_KEYS), delete=False)


def _prio_a():
    return F.when(F.col("o_orderkey") % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority"))


def _prio_b():
    return (F.when(F.col("o_orderkey") % 14 == 0, F.lit(None).cast("string"))
            .when(F.col("o_orderkey") % 7 == 0, F.col("o_orderpriority"))
            .when(F.col("o_orderkey") % 11 == 0, F.lit(None).cast("string"))
            .otherwise(F.col("o_orderpriority")))


def _status_b():
    return F.when(F.col("o_orderkey") % 5 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))
_CMP_A_SQL = (f"SELECT {_OC} AS k_cluster_id, o_orderkey, o_orderstatus AS status, "
              f"CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS priority "
              f"FROM orders WHERE {_KEY_SQL['A']}")
_CMP_B_SQL = (f"SELECT {_OC} AS k_cluster_id, o_orderkey, "
              f"CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status, "
              f"CASE WHEN o_orderkey % 14 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN o_orderpriority "
              f"WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority "
              f"FROM orders WHERE {_KEY_SQL['B']}")
_CMP_NS = (("status", "="), ("priority", "<=>"))
_CMP_PLAIN = (("status", "="), ("priority", "="))


def _compare_merge(spark, sf_dir, compare, delete):
    o = _orders(spark, sf_dir, "o_orderstatus", "o_orderpriority")
    a = _capture(o, "A", status=F.col("o_orderstatus"), priority=_prio_a())
    b = _capture(o, "B", status=_status_b(), priority=_prio_b())
    return two_capture_merge(a, b, _spec("cmp", _ORDERS_KEYS, compare), delete=delete)


@register("merge_compare_nullsafe", two_snapshot_merge_sql(_CMP_A_SQL, _CMP_B_SQL, _ORDERS_KEYS, _CMP_NS,
                                                           delete=None))
def merge_compare_nullsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2 class: NULL <=> NULL is no change."""
    return _compare_merge(spark, sf_dir, _CMP_NS, delete=False)


@register("merge_compare_plain", two_snapshot_merge_sql(_CMP_A_SQL, _CMP_B_SQL, _ORDERS_KEYS, _CMP_PLAIN,
                                                        delete="scope"))
def merge_compare_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8 class with the plain ``=`` of Q3: a NULL on either side counts as a change."""
    return _compare_merge(spark, sf_dir, _CMP_PLAIN, delete=True)


_MC_A_SQL = ("SELECT 'c' || CAST(o_custkey % 3 AS VARCHAR) AS k_cluster_id, o_orderkey, o_orderstatus AS status "
             f"FROM orders WHERE {_KEY_SQL['A']}")
_MC_B_SQL = ("SELECT 'c' || CAST(o_custkey % 3 AS VARCHAR) AS k_cluster_id, o_orderkey, "
             "CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS status "
             f"FROM orders WHERE {_KEY_SQL['B']} AND o_custkey % 3 <> 2")


@register("merge_other_cluster_untouched", two_snapshot_merge_sql(
    _MC_A_SQL, _MC_B_SQL, _ORDERS_KEYS, (("status", "="),), delete="scope"))
def merge_other_cluster_untouched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture B holds two of three clusters; the third keeps all its rows."""
    o = _orders(spark, sf_dir, "o_custkey", "o_orderstatus")
    cluster = F.concat(F.lit("c"), (F.col("o_custkey") % 3).cast("string"))
    k = F.col("o_orderkey")
    a = o.filter(k % 10 != 0).select(cluster.alias("k_cluster_id"), "o_orderkey",
                                      F.col("o_orderstatus").alias("status"), ts(T0).alias("refreshed_at"))
    b = (o.filter((k % 10 != 1) & (F.col("o_custkey") % 3 != 2))
         .select(cluster.alias("k_cluster_id"), "o_orderkey", _status_b().alias("status"),
                 ts(T1).alias("refreshed_at")))
    return two_capture_merge(a, b, _spec("mc", _ORDERS_KEYS, (("status", "="),)), delete=True)


# lineitem is not unique by (l_orderkey, l_linenumber): same-key rows are
# reduced to the greatest by (l_partkey, l_suppkey, l_quantity).
_LI_KEYS = ["k_cluster_id", "l_orderkey", "l_linenumber"]
_LI_CMP = (("l_partkey", "="), ("l_suppkey", "="), ("l_quantity", "="))


def _li_sql(where: str, qty: str) -> str:
    return f"""SELECT k_cluster_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
        SELECT {_LC} AS k_cluster_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, {qty} AS l_quantity,
               row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                  ORDER BY l_partkey DESC, l_suppkey DESC, {qty} DESC) AS rn
        FROM lineitem WHERE {where}) WHERE rn = 1"""


_LI_QTY_B = "CASE WHEN l_orderkey % 7 = 0 THEN l_quantity + 1 ELSE l_quantity END"


def _li_captures(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    k = F.col("l_orderkey")
    qty_b = F.when(k % 7 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    a = li.filter(k % 10 != 0).select(cluster_of("l_orderkey").alias("k_cluster_id"), "l_orderkey", "l_linenumber",
                                       "l_partkey", "l_suppkey", "l_quantity", ts(T0).alias("refreshed_at"))
    b = li.filter(k % 10 != 1).select(cluster_of("l_orderkey").alias("k_cluster_id"), "l_orderkey", "l_linenumber",
                                       "l_partkey", "l_suppkey", qty_b.alias("l_quantity"),
                                       ts(T1).alias("refreshed_at"))
    return a, b


@register("merge_duplicates", two_snapshot_merge_sql(
    _li_sql("l_orderkey % 10 <> 0", "l_quantity"), _li_sql("l_orderkey % 10 <> 1", _LI_QTY_B),
    _LI_KEYS, _LI_CMP, delete="scope"))
def merge_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: same-key duplicates within a capture are reduced before the merge."""
    a, b = _li_captures(spark, sf_dir)
    return two_capture_merge(a, b, _spec("li", _LI_KEYS, _LI_CMP), delete=True)


_ACC_KNOWN = "l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 9 <> 0)"
_ACC_SQL = f"""
WITH src AS (SELECT l_orderkey, l_linenumber, {_ACC_KNOWN} AS known FROM lineitem WHERE l_orderkey % 10 <> 1),
g AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM src WHERE known GROUP BY ALL),
m AS ({two_snapshot_merge_sql(_li_sql("l_orderkey % 10 <> 0", "l_quantity"),
                              _li_sql(f"l_orderkey % 10 <> 1 AND {_ACC_KNOWN}", _LI_QTY_B), _LI_KEYS, _LI_CMP,
                              delete="scope")}),
acts AS (SELECT * FROM (VALUES ('insert'), ('update'), ('touch'), ('keep'), ('delete')) v(action))
SELECT 'lineitem' AS table_name, 'submitted' AS metric, count(*) AS value FROM src
UNION ALL SELECT 'lineitem', 'unresolved', count(*) FILTER (WHERE NOT known) FROM src
UNION ALL SELECT 'lineitem', 'keys', count(*) FROM g
UNION ALL SELECT 'lineitem', 'duplicate_keys', count(*) FILTER (WHERE n > 1) FROM g
UNION ALL SELECT 'lineitem', acts.action, (SELECT count(*) FROM m WHERE m.action = acts.action) FROM acts
"""


@register("refresh_accounting", _ACC_SQL)
def refresh_accounting_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows submitted, rows whose part is unknown, keys, duplicate keys and rows per action."""
    from snaptide.operators.accounting import refresh_accounting
    from snaptide.operators.joins import existing
    a, b = _li_captures(spark, sf_dir)
    parts = Tables(spark, sf_dir).part.filter(F.col("p_partkey") % 9 != 0).withColumnRenamed("p_partkey", "l_partkey")
    spec = _spec("li", _LI_KEYS, _LI_CMP)
    spec = spec.__class__(**{**spec.__dict__, "delete_stale": True})
    state = survivors(merge_snapshot(None, a, spec))
    merged = merge_snapshot(state, existing(b, parts, ["l_partkey"]), spec, dup_counts=True,
                            scope=b.select("k_cluster_id", "refreshed_at").distinct())
    return refresh_accounting("lineitem", b, merged, _LI_KEYS)


# Small capture into a large state: the state is never shuffled.
_LS_KEYS = ["k_cluster_id", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_LS_CMP = (("l_quantity", "="), ("l_discount", "="))
# Fixed value: the recent-shipments capture holds lines shipped from this date on.
_RECENT = "2001-10-01 00:00:00"


def _ls_sql(where: str, qty: str) -> str:
    return f"""SELECT k_cluster_id, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount FROM (
        SELECT {_LC} AS k_cluster_id, l_orderkey, l_partkey, l_suppkey, l_linenumber,
               {qty} AS l_quantity, l_discount,
               row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber
                                  ORDER BY {qty} DESC, l_discount DESC) AS rn
        FROM lineitem WHERE {where}) WHERE rn = 1"""


@register("merge_small_source", two_snapshot_merge_sql(
    _ls_sql("true", "l_quantity"), _ls_sql(f"l_shipdate >= TIMESTAMP '{_RECENT}'", _LI_QTY_B),
    _LS_KEYS, _LS_CMP, delete=None))
def merge_small_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§4.3 broadcast plan: recent shipments merged into the state of all lines."""
    li = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                "l_quantity", "l_discount", "l_shipdate")
    k = F.col("l_orderkey")
    cols = [cluster_of("l_orderkey").alias("k_cluster_id"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    a = li.select(*cols, "l_quantity", "l_discount", ts(T0).alias("refreshed_at"))
    b = (li.filter(F.col("l_shipdate") >= F.lit(_RECENT).cast("timestamp_ntz"))
         .select(*cols, F.when(k % 7 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("l_quantity"),
                 "l_discount", ts(T1).alias("refreshed_at")))
    spec = _spec("ls", _LS_KEYS, _LS_CMP)
    state = survivors(merge_snapshot(None, a, spec))
    return to_ntz(merge_snapshot(state, b, spec, incremental=True), *AUDIT_NTZ)


# ------------------------------------------------------------ cascade (K3) --

_CASCADE_SQL = f"""
WITH a AS (SELECT c_custkey FROM customer),
b AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 1),
rc AS (SELECT a.c_custkey FROM a LEFT JOIN b ON a.c_custkey = b.c_custkey WHERE b.c_custkey IS NULL),
ro AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM rc)),
rl AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem
       WHERE l_orderkey IN (SELECT o_orderkey FROM ro))
SELECT 'customer' AS table_name, c_custkey AS k1, CAST(NULL AS BIGINT) AS k2, CAST(NULL AS BIGINT) AS k3,
       CAST(NULL AS INTEGER) AS k4 FROM rc
UNION ALL SELECT 'orders', o_orderkey, NULL, NULL, NULL FROM ro
UNION ALL SELECT 'lineitem', l_orderkey, l_partkey, l_suppkey, l_linenumber FROM rl
"""


@register("cascade_delete", _CASCADE_SQL)
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 / Q4 / Q13: customers stale-deleted by a capture remove their orders,
    which remove their lines (three levels, removed keys only)."""
    from snaptide.operators.cascade import cascade_chain
    from snaptide.operators.merge import deleted
    t = Tables(spark, sf_dir)
    cust = t.customer.select("c_custkey")
    keys = ["k_cluster_id", "c_custkey"]
    a = cust.select(cluster_of("c_custkey").alias("k_cluster_id"), "c_custkey", ts(T0).alias("refreshed_at"))
    b = (cust.filter(F.col("c_custkey") % 10 != 1)
         .select(cluster_of("c_custkey").alias("k_cluster_id"), "c_custkey", ts(T1).alias("refreshed_at")))
    spec = _spec("customers", keys).__class__(name="customers", keys=tuple(keys), delete_stale=True)
    state = survivors(merge_snapshot(None, a, spec))
    gone_c = deleted(merge_snapshot(state, b, spec, scope=b.select("k_cluster_id", "refreshed_at").distinct()))
    orders = t.orders.select(cluster_of("o_custkey").alias("k_cluster_id"), "o_custkey", "o_orderkey")
    # a line carries its order's cluster (children carry their parents' keys)
    lines = (t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
             .join(orders.select("k_cluster_id", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey"))
    res = cascade_chain([
        ("orders", orders, {"k_cluster_id": "k_cluster_id", "c_custkey": "o_custkey"}),
        ("lineitem", lines, {"k_cluster_id": "k_cluster_id", "o_orderkey": "l_orderkey"}),
    ], gone_c)
    nl = F.lit(None)
    return (gone_c.select(F.lit("customer").alias("table_name"), F.col("c_custkey").alias("k1"),
                          nl.cast("bigint").alias("k2"), nl.cast("bigint").alias("k3"), nl.cast("int").alias("k4"))
            .unionByName(res["orders"][1].select(F.lit("orders").alias("table_name"), F.col("o_orderkey").alias("k1"),
                                                 nl.cast("bigint").alias("k2"), nl.cast("bigint").alias("k3"),
                                                 nl.cast("int").alias("k4")))
            .unionByName(res["lineitem"][1].select(F.lit("lineitem").alias("table_name"),
                                                   F.col("l_orderkey").alias("k1"), F.col("l_partkey").alias("k2"),
                                                   F.col("l_suppkey").alias("k3"), F.col("l_linenumber").alias("k4"))))


# ------------------------------------------------------------ lookups (J*) ---
# Parent states with some parents absent, chosen by their data: orders without
# low-priority ones, customers outside one market segment, nations outside one
# region.

def _lookup_states(spark, sf_dir):
    from snaptide.operators.joins import lookup  # noqa: F401
    t = Tables(spark, sf_dir)
    orders = t.orders.filter(F.col("o_orderpriority") != "5-LOW").select("o_orderkey", "o_custkey")
    cust = t.customer.filter(F.col("c_mktsegment") != "MACHINERY").select("c_custkey", "c_nationkey", "c_name")
    nation = t.nation.filter(F.col("n_regionkey") != 4).select("n_nationkey", "n_regionkey")
    return t, orders, cust, nation


_LK_ORDERS = "(SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority <> '5-LOW')"
_LK_CUST = "(SELECT c_custkey, c_nationkey, c_name FROM customer WHERE c_mktsegment <> 'MACHINERY')"
_LK_NATION = "(SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey <> 4)"


@register("lookup_one", f"""
SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, o.o_custkey
FROM lineitem l JOIN {_LK_ORDERS} o ON l.l_orderkey = o.o_orderkey""")
def lookup_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child rows resolved against their parent; unknown parent drops the row."""
    from snaptide.operators.joins import lookup
    t, orders, _, _ = _lookup_states(spark, sf_dir)
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return lookup(lines, orders.withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"]).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "o_custkey")


@register("lookup_chain", f"""
SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, o.o_custkey, c.c_nationkey, n.n_regionkey
FROM lineitem l JOIN {_LK_ORDERS} o ON l.l_orderkey = o.o_orderkey
JOIN {_LK_CUST} c ON o.o_custkey = c.c_custkey
JOIN {_LK_NATION} n ON c.c_nationkey = n.n_nationkey""")
def lookup_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of inner lookups; the small nation level is broadcast
    behind a size check, the rest are shuffle joins on the parent key."""
    from snaptide.operators.joins import lookup
    t, orders, cust, nation = _lookup_states(spark, sf_dir)
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    x = lookup(lines, orders.withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"])
    x = lookup(x, cust.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), ["o_custkey"])
    x = lookup(x, nation.withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"])
    return x.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "o_custkey", "c_nationkey",
                    "n_regionkey")


@register("lookup_drop_unknown", f"""
SELECT o.o_orderkey, o.o_custkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM {_LK_CUST} c WHERE c.c_custkey = o.o_custkey)""")
def lookup_drop_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows an inner lookup drops (a group whose coordinator is unknown)."""
    from snaptide.operators.joins import lookup
    t, _, cust, _ = _lookup_states(spark, sf_dir)
    orders = t.orders.select("o_orderkey", "o_custkey")
    return lookup(orders, cust.select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"], how="left_anti")


@register("lookup_binding", f"""
WITH pairs AS (
  SELECT DISTINCT s.s_name AS resource_name, c.c_name AS principal
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN customer c ON c.c_custkey = o.o_custkey)
SELECT p.resource_name, p.principal, r.s_suppkey, e.c_custkey
FROM pairs p JOIN (SELECT s_name, s_suppkey FROM supplier WHERE s_nationkey <> 3) r ON r.s_name = p.resource_name
JOIN {_LK_CUST} e ON e.c_name = p.principal""")
def lookup_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binding resolves its resource and its entry by two equi-joins
    from the binding row (never resource x entry)."""
    from snaptide.operators.joins import lookup
    t, _, cust, _ = _lookup_states(spark, sf_dir)
    sup = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    # names are joined to orders, not to their many lines; dealt out by principal once, for the distinct and its lookup
    owners = (t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
              .join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("principal")),
                    "o_custkey").select("l_orderkey", "principal"))
    pairs = (t.lineitem.select("l_orderkey", "l_suppkey").join(owners, "l_orderkey")
             .join(sup.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("resource_name")),
                   "l_suppkey")
             .select("resource_name", "principal").repartition("principal").distinct())
    resources = sup.filter(F.col("s_nationkey") != 3).select(F.col("s_name").alias("resource_name"), "s_suppkey")
    entries = cust.select(F.col("c_name").alias("principal"), "c_custkey")
    x = lookup(pairs, entries, ["principal"])
    return lookup(x, resources, ["resource_name"]).select("resource_name", "principal", "s_suppkey", "c_custkey")


# ----------------------------------------------------- assignments (J7/M10) --

_ASSIGN_SQL = f"""
WITH a AS (SELECT DISTINCT 'g' || CAST(user_id % 10 AS VARCHAR) AS group_id, 'u' || CAST(user_id AS VARCHAR) AS member_id,
                  event_type AS topic, CAST(hour(ts) % 4 AS INTEGER) AS k_partition_id FROM events),
members AS (SELECT DISTINCT 'g' || CAST(user_id % 10 AS VARCHAR) AS group_id, 'u' || CAST(user_id AS VARCHAR) AS member_id
            FROM events WHERE event_type = 'signup'),
topics AS (SELECT DISTINCT event_type AS name, 'topic-' || event_type AS k_topic_id FROM events WHERE event_type <> 'error'),
parts AS (SELECT DISTINCT 'topic-' || event_type AS k_topic_id, CAST(hour(ts) % 4 AS INTEGER) AS k_partition_id
          FROM events WHERE value > 5)
SELECT '{CLUSTER}' AS k_cluster_id, a.group_id, a.member_id, t.k_topic_id, a.k_partition_id
FROM a JOIN members m ON m.group_id = a.group_id AND m.member_id = a.member_id
JOIN topics t ON t.name = a.topic
JOIN parts p ON p.k_topic_id = t.k_topic_id AND p.k_partition_id = a.k_partition_id"""


@register("assignments_per_member", _ASSIGN_SQL)
def assignments_per_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An assignment resolves its own member (not every member of
    the group), the topic by name, then the partition."""
    from snaptide.operators.lookup_plans import resolve_assignments
    ev = Tables(spark, sf_dir).events.select("user_id", "event_type", "ts", "value")
    cl = F.lit(CLUSTER).alias("k_cluster_id")
    group = F.concat(F.lit("g"), (F.col("user_id") % 10).cast("string")).alias("group_id")
    member = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("member_id")
    part = (F.hour("ts") % 4).cast("int").alias("k_partition_id")
    assignments = ev.select(cl, group, member, F.col("event_type").alias("topic"), part).distinct()
    members = ev.filter(F.col("event_type") == "signup").select(cl, group, member).distinct()
    topics = (ev.filter(F.col("event_type") != "error")
              .select(cl, F.col("event_type").alias("name"),
                      F.concat(F.lit("topic-"), F.col("event_type")).alias("k_topic_id")).distinct())
    parts = (ev.filter(F.col("value") > 5)
             .select(cl, F.concat(F.lit("topic-"), F.col("event_type")).alias("k_topic_id"), part).distinct())
    return resolve_assignments(assignments, members, topics, parts)


# ------------------------------------------------------ node completion (J11-J12, U1) --

def _node_frames(spark, sf_dir):
    """Nodes are suppliers; a node's cluster is its id mod 3. Voters and
    observers come from the lines, in the cluster of their node id."""
    t = Tables(spark, sf_dir)
    node_cluster = F.concat(F.lit("c"), (F.col("k_node_id") % 3).cast("string")).alias("k_cluster_id")
    live = (t.supplier.filter(F.col("s_acctbal") >= 0)
            .select(F.col("s_suppkey").cast("int").alias("k_node_id"), F.col("s_name").alias("host"),
                    (F.lit(9000) + F.col("s_nationkey")).alias("port"),
                    F.concat(F.lit("rack-"), F.col("s_nationkey").cast("string")).alias("rack"))
            .select(node_cluster, "*"))
    li = t.lineitem
    voters = (li.filter(F.col("l_returnflag") == "R")
              .select(F.col("l_suppkey").cast("int").alias("k_node_id")).distinct().select(node_cluster, "k_node_id"))
    observers = (li.filter(F.col("l_linestatus") == "O")
                 .select((F.col("l_partkey") % 150).cast("int").alias("k_node_id")).distinct()
                 .select(node_cluster, "k_node_id"))
    return t, live, voters, observers


_NC = cluster_sql("k_node_id")
_NODES_SQL = f"""
live0 AS (SELECT CAST(s_suppkey AS INTEGER) AS k_node_id, s_name AS host,
                 9000 + s_nationkey AS port, 'rack-' || CAST(s_nationkey AS VARCHAR) AS rack
          FROM supplier WHERE s_acctbal >= 0),
live AS (SELECT {_NC} AS k_cluster_id, * FROM live0),
voters AS (SELECT {_NC} AS k_cluster_id, k_node_id FROM (
             SELECT DISTINCT CAST(l_suppkey AS INTEGER) AS k_node_id FROM lineitem WHERE l_returnflag = 'R')),
observers AS (SELECT {_NC} AS k_cluster_id, k_node_id FROM (
             SELECT DISTINCT CAST(l_partkey % 150 AS INTEGER) AS k_node_id FROM lineitem WHERE l_linestatus = 'O')),
ids AS (SELECT k_cluster_id, k_node_id FROM voters UNION SELECT k_cluster_id, k_node_id FROM observers),
missing AS (SELECT k_cluster_id, k_node_id, CAST(NULL AS VARCHAR) AS host, -1 AS port, CAST(NULL AS VARCHAR) AS rack
            FROM ids WHERE k_node_id NOT IN (SELECT k_node_id FROM live))"""


@register("missing_ids", f"WITH {_NODES_SQL} SELECT * FROM missing")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12 + P12: quorum members without a live node, as placeholder rows."""
    from snaptide.operators.nodes import missing_nodes
    _, live, voters, observers = _node_frames(spark, sf_dir)
    return missing_nodes(voters.unionByName(observers), live, ["k_cluster_id"])


@register("all_nodes", f"""WITH {_NODES_SQL},
nodes AS (SELECT * FROM live UNION ALL SELECT * FROM missing),
meta AS (SELECT c.k_cluster_id, c.controller_id, v.leader_id
         FROM (SELECT k_cluster_id, min(k_node_id) AS controller_id FROM live GROUP BY 1) c
         JOIN (SELECT k_cluster_id, max(k_node_id) AS leader_id FROM voters GROUP BY 1) v
           ON v.k_cluster_id = c.k_cluster_id)
SELECT n.k_cluster_id, n.k_node_id, n.host, n.port, n.rack,
       n.k_node_id = m.controller_id AS controller, n.k_node_id = m.leader_id AS leader,
       n.k_node_id IN (SELECT k_node_id FROM voters) AS voter,
       n.k_node_id IN (SELECT k_node_id FROM observers) AS observer
FROM nodes n JOIN meta m ON m.k_cluster_id = n.k_cluster_id""")
def all_nodes_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1 + P1 + P2: live and missing nodes with controller / quorum flags."""
    from snaptide.operators.nodes import all_nodes
    _, live, voters, observers = _node_frames(spark, sf_dir)
    meta = (live.groupBy("k_cluster_id").agg(F.min("k_node_id").alias("controller_id"))
            .join(voters.groupBy("k_cluster_id").agg(F.max("k_node_id").alias("leader_id")), "k_cluster_id"))
    return all_nodes(live, meta, voters, observers, ["k_cluster_id"])


@register("live_only", """
SELECT DISTINCT CAST(l_suppkey AS INTEGER) AS k_node_id, 'flag-' || l_returnflag AS name, l_linestatus AS value
FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)""")
def live_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configs are kept for live nodes only (left semi join)."""
    from snaptide.operators.joins import lookup
    t, live, _, _ = _node_frames(spark, sf_dir)
    configs = t.lineitem.select(F.col("l_suppkey").cast("int").alias("k_node_id"),
                                F.concat(F.lit("flag-"), F.col("l_returnflag")).alias("name"),
                                F.col("l_linestatus").alias("value")).distinct()
    return lookup(configs, live.select("k_node_id"), ["k_node_id"], how="left_semi")


# ------------------------------------------ nested flatten, flags, log dirs --

@register("flatten_replicas", REPLICAS_SQL)
def flatten_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5 + F6 + P3 + P4 + P5 (J13, L1, Q6): replicas flattened from nested
    topic descriptions, leader / in-sync flags, size / lag / future from the
    first log dir holding the replica."""
    t = Tables(spark, sf_dir)
    snap = replica_snapshot_rows(
        t.orders.select("o_orderkey"),
        t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus"))
    return fl.replicas(snap).drop("refreshed_at")


@register("flatten_partitions", f"""
SELECT '{CLUSTER}' AS k_cluster_id, 't' || CAST(l.l_orderkey AS VARCHAR) AS k_topic_id,
       'topic-' || CAST(l.l_orderkey AS VARCHAR) AS topic, l.l_linenumber AS k_partition_id,
       CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_suppkey AS INTEGER) END AS leader_id
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey""")
def flatten_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, partition) rows from nested topic descriptions."""
    t = Tables(spark, sf_dir)
    snap = replica_snapshot_rows(
        t.orders.select("o_orderkey"),
        t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus"))
    return fl.partitions(snap).select("k_cluster_id", "k_topic_id", "topic", "k_partition_id", "leader_id")


_ATTACH_SQL = """
WITH dirs AS (SELECT l_orderkey AS o_orderkey, 'dir-' || CAST(l_linenumber AS VARCHAR) AS path,
                     l_returnflag = 'R' AS future, l_partkey AS size, l_suppkey AS offset_lag FROM lineitem),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey
                                                      ORDER BY future, path, size, offset_lag) AS rn FROM dirs)
          WHERE rn = 1)
SELECT o.o_orderkey, f.size, f.offset_lag, f.future FROM orders o LEFT JOIN first f ON f.o_orderkey = o.o_orderkey"""


@register("attach_first_match", _ATTACH_SQL)
def attach_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order gets the first of its lines by (current copy
    first, smallest path) or NULLs when it has none (left outer join)."""
    t = Tables(spark, sf_dir)
    dirs = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"),
                             F.concat(F.lit("dir-"), F.col("l_linenumber").cast("string")).alias("path"),
                             (F.col("l_returnflag") == "R").alias("future"), F.col("l_partkey").alias("size"),
                             F.col("l_suppkey").alias("offset_lag"))
    first = fl.first_log_dir(dirs, ["o_orderkey"])
    return t.orders.select("o_orderkey").join(first, "o_orderkey", "left")


# ------------------------------------------------------------ scalars (P6, P7) --

@register("negative_to_null", """
SELECT c_custkey, CASE WHEN floor(c_acctbal) >= 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS "offset"
FROM customer""")
def negative_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A negative offset is stored as NULL."""
    from snaptide.functions.scalars import offset_or_null
    c = Tables(spark, sf_dir).customer
    return c.select("c_custkey", offset_or_null(F.floor("c_acctbal").cast("bigint")).alias("offset"))


@register("millis_to_timestamp", """
WITH m AS (SELECT event_id, CASE WHEN event_id % 13 = 0 THEN -1 ELSE epoch_us(ts) // 1000 END AS timestamp_ms FROM events)
SELECT event_id, timestamp_ms, CASE WHEN timestamp_ms >= 0 THEN epoch_ms(timestamp_ms) END AS "timestamp" FROM m""")
def millis_to_timestamp_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch milliseconds to a timestamp; negative means unknown (NULL)."""
    from snaptide.functions.scalars import millis_to_timestamp
    ev = Tables(spark, sf_dir).events
    ms = F.when(F.col("event_id") % 13 == 0, F.lit(-1).cast("bigint")).otherwise(
        F.unix_millis(F.col("ts").cast("timestamp")))
    m = ev.select("event_id", ms.alias("timestamp_ms"))
    return to_ntz(m.withColumn("timestamp", millis_to_timestamp(F.col("timestamp_ms"))), "timestamp")


# ------------------------------------------------------------------ offsets --
# Record log from events: topic = event type, partition = user_id % 4,
# offset = event_id (sparse within a partition, like a compacted log).

def _log(spark, sf_dir):
    ev = Tables(spark, sf_dir).events
    return ev.select(F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"),
                     F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"))


_LOG_SQL = """log AS (SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS "partition",
                       event_id AS "offset", ts AS "timestamp" FROM events)"""


@register("offset_types", f"""WITH {_LOG_SQL},
agg AS (SELECT topic, "partition", min("offset") AS e, max("offset") + 1 AS l FROM log GROUP BY ALL),
mx AS (SELECT topic, "partition", "offset", "timestamp" FROM (
         SELECT *, row_number() OVER (PARTITION BY topic, "partition" ORDER BY "timestamp" DESC, "offset") AS rn
         FROM log) WHERE rn = 1)
SELECT topic, "partition", 'EARLIEST' AS offset_type, e AS "offset", CAST(NULL AS TIMESTAMP) AS "timestamp" FROM agg
UNION ALL SELECT topic, "partition", 'LATEST', l, NULL FROM agg
UNION ALL SELECT topic, "partition", 'MAX_TIMESTAMP', "offset", "timestamp" FROM mx""")
def offset_types_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13 + U3: EARLIEST, LATEST and MAX_TIMESTAMP offsets per partition, long form."""
    from snaptide.operators.offsets import offset_types
    return offset_types(_log(spark, sf_dir))


def _commits(spark, sf_dir, exact: bool):
    ev = Tables(spark, sf_dir).events
    g = (ev.groupBy("user_id", "event_type").agg(F.max("event_id").alias("_m")))
    u = F.col("user_id")
    if exact:
        off = F.col("_m")
    else:
        off = F.when(u % 5 == 0, F.lit(-5).cast("bigint")).when(u % 5 == 1, F.lit(1_000_000_000).cast("bigint")) \
            .otherwise(F.col("_m") + 1)
    return g.select(F.concat(F.lit("g"), u.cast("string")).alias("group_id"), F.col("event_type").alias("topic"),
                    (u % 4).cast("int").alias("partition"), off.alias("offset"))


def _commits_sql(exact: bool) -> str:
    off = "m" if exact else "CASE WHEN user_id % 5 = 0 THEN -5 WHEN user_id % 5 = 1 THEN 1000000000 ELSE m + 1 END"
    return f"""commits AS (SELECT 'g' || CAST(user_id AS VARCHAR) AS group_id, event_type AS topic,
                           CAST(user_id % 4 AS INTEGER) AS "partition", CAST({off} AS BIGINT) AS "offset"
                    FROM (SELECT user_id, event_type, max(event_id) AS m FROM events GROUP BY ALL))"""


_BOUNDS_SQL = """bounds AS (SELECT topic, "partition", min("offset") AS beginning_offset,
                                   max("offset") + 1 AS end_offset FROM log GROUP BY ALL)"""


@register("offset_bounds_filter", f"""WITH {_LOG_SQL}, {_commits_sql(False)}, {_BOUNDS_SQL}
SELECT c.topic, c."partition", c.group_id, c."offset", b.beginning_offset, b.end_offset
FROM commits c JOIN bounds b ON b.topic = c.topic AND b."partition" = c."partition"
WHERE c."offset" >= b.beginning_offset AND c."offset" < b.end_offset""")
def offset_bounds_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11 + W1 + W2 + J18: committed offsets within [beginning, end)."""
    from snaptide.operators.offsets import partition_bounds, within_bounds
    log = _log(spark, sf_dir)
    return within_bounds(_commits(spark, sf_dir, exact=False), partition_bounds(log))


def _asof_sql(exact: bool) -> str:
    return f"""WITH {_LOG_SQL}, {_commits_sql(exact)}, {_BOUNDS_SQL},
t AS (SELECT DISTINCT c.topic, c."partition", c."offset" FROM commits c
      JOIN bounds b ON b.topic = c.topic AND b."partition" = c."partition"
      WHERE c."offset" >= b.beginning_offset AND c."offset" < b.end_offset),
f AS (SELECT t.topic, t."partition", t."offset", min_by(l."timestamp", l."offset") AS offset_timestamp
      FROM t JOIN log l ON l.topic = t.topic AND l."partition" = t."partition" AND l."offset" >= t."offset"
      GROUP BY ALL)
SELECT c.topic, c."partition", c."offset", c.group_id, f.offset_timestamp
FROM commits c LEFT JOIN f ON f.topic = c.topic AND f."partition" = c."partition" AND f."offset" = c."offset" """


# Fixed value: offset range per bucket of the as-of lookup in these queries.
_ASOF_BUCKET = 256


@register("offset_timestamp_exact", _asof_sql(True))
def offset_timestamp_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15 + J16: every commit points at an existing record."""
    from snaptide.operators.asof import attach_offset_timestamps
    return attach_offset_timestamps(_commits(spark, sf_dir, exact=True), _log(spark, sf_dir), ["topic", "partition"],
                                    bucket=_ASOF_BUCKET)


@register("offset_timestamp_gaps", _asof_sql(False))
def offset_timestamp_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15 + J16 + W1/W2: commits between records, below the beginning and at
    or past the end (the last two get NULL)."""
    from snaptide.operators.asof import attach_offset_timestamps
    return attach_offset_timestamps(_commits(spark, sf_dir, exact=False), _log(spark, sf_dir),
                                    ["topic", "partition"], bucket=_ASOF_BUCKET)


# --------------------------------------------------------------- velocity --
# The two capture times of the velocity queries. The first capture
# holds the events before its time, the second all events.
_D1 = "2024-01-16 00:00:00"
_D2 = "2024-02-01 00:00:00"


def _until(day: str) -> str:
    return f"WHERE ts < TIMESTAMP '{day}'" if day == _D1 else ""


def _types_capture_sql(day: str) -> str:
    return f"""WITH log AS (SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS "partition",
                                event_id AS "offset", ts AS "timestamp" FROM events {_until(day)}),
agg AS (SELECT topic, "partition", min("offset") AS e, max("offset") + 1 AS l FROM log GROUP BY ALL),
mx AS (SELECT topic, "partition", "offset", "timestamp" FROM (
         SELECT *, row_number() OVER (PARTITION BY topic, "partition" ORDER BY "timestamp" DESC, "offset") AS rn
         FROM log) WHERE rn = 1)
SELECT '{CLUSTER}' AS k_cluster_id, topic, "partition", 'EARLIEST' AS offset_type, e AS "offset",
       CAST(NULL AS TIMESTAMP) AS "timestamp" FROM agg
UNION ALL SELECT '{CLUSTER}', topic, "partition", 'LATEST', l, NULL FROM agg
UNION ALL SELECT '{CLUSTER}', topic, "partition", 'MAX_TIMESTAMP', "offset", "timestamp" FROM mx"""


_PO_KEYS = ["k_cluster_id", "topic", "partition", "offset_type"]
_PO_CMP = (("offset", "<=>"), ("timestamp", "<=>"))


@register("velocity_latest", two_snapshot_merge_sql(
    _types_capture_sql(_D1), _types_capture_sql(_D2), _PO_KEYS, _PO_CMP, delete=None, t0=_D1, t1=_D2,
    velocity="LATEST"))
def velocity_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12 + V2: partition offsets of two day-end captures; only LATEST gets a velocity."""
    from snaptide.operators.offsets import offset_types
    log = _log(spark, sf_dir)

    def cap(day):
        t = offset_types(log.filter(F.col("timestamp") < F.lit(day).cast("timestamp_ntz")) if day == _D1 else log)
        return t.select(F.lit(CLUSTER).alias("k_cluster_id"), "*", ts(day).alias("refreshed_at"))

    spec = TABLES["partition_offsets"].__class__(name="po", keys=tuple(_PO_KEYS), compare=_PO_CMP,
                                                 extra=("velocity",), velocity="LATEST")
    state = survivors(merge_snapshot(None, cap(_D1), spec))
    return to_ntz(merge_snapshot(state, cap(_D2), spec), *AUDIT_NTZ)


_GO_KEYS = ["k_cluster_id", "group_id", "topic", "partition"]
_GO_CMP = (("offset", "<=>"),)


def _group_capture_sql(day: str) -> str:
    return f"""SELECT {cluster_sql("user_id")} AS k_cluster_id, 'g' || CAST(user_id AS VARCHAR) AS group_id,
                      event_type AS topic, CAST(user_id % 4 AS INTEGER) AS "partition", max(event_id) + 1 AS "offset"
               FROM events {_until(day)} GROUP BY ALL"""


def _group_capture(ev: DataFrame, day: str) -> DataFrame:
    u = F.col("user_id")
    return ((ev.filter(F.col("ts") < F.lit(day).cast("timestamp_ntz")) if day == _D1 else ev)
            .groupBy("user_id", "event_type").agg((F.max("event_id") + 1).alias("offset"))
            .select(cluster_of("user_id").alias("k_cluster_id"),
                    F.concat(F.lit("g"), u.cast("string")).alias("group_id"),
                    F.col("event_type").alias("topic"), (u % 4).cast("int").alias("partition"), "offset",
                    ts(day).alias("refreshed_at")))


@register("velocity_group", two_snapshot_merge_sql(
    _group_capture_sql(_D1), _group_capture_sql(_D2), _GO_KEYS, _GO_CMP, delete="scope", t0=_D1, t1=_D2,
    velocity="all"))
def velocity_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 + V1 + X5: committed offsets of two day-end captures; velocity on every row."""
    ev = Tables(spark, sf_dir).events.select("user_id", "event_type", "event_id", "ts")
    spec = TABLES["consumer_group_offsets"].__class__(name="go", keys=tuple(_GO_KEYS), compare=_GO_CMP,
                                                      extra=("velocity",), velocity="all", delete_stale=True)
    b = _group_capture(ev, _D2)
    state = survivors(merge_snapshot(None, _group_capture(ev, _D1), spec))
    return to_ntz(merge_snapshot(state, b, spec, scope=b.select("k_cluster_id", "refreshed_at").distinct()), *AUDIT_NTZ)


# History replay: one capture per day, at the day's end. A partition's LATEST
# offset is captured on the days it received records; a group's commit on the
# days the user produced that event type (absent otherwise: a gap).

def _daily(ev: DataFrame, group: bool) -> DataFrame:
    day_end = F.date_trunc("day", F.col("ts")) + F.expr("INTERVAL 1 DAY")
    u = F.col("user_id")
    if group:
        g = ev.groupBy("user_id", "event_type", day_end.alias("_d")).agg((F.max("event_id") + 1).alias("offset"))
        return g.select(F.lit(CLUSTER).alias("k_cluster_id"), F.concat(F.lit("g"), u.cast("string")).alias("group_id"),
                        F.col("event_type").alias("topic"), (u % 4).cast("int").alias("partition"), "offset",
                        F.col("_d").cast("timestamp").alias("refreshed_at"))
    g = (ev.groupBy("event_type", (u % 4).cast("int").alias("partition"), day_end.alias("_d"))
         .agg((F.max("event_id") + 1).alias("offset")))
    return g.select(F.lit(CLUSTER).alias("k_cluster_id"), F.col("event_type").alias("topic"), "partition",
                    F.lit("LATEST").alias("offset_type"), "offset",
                    F.col("_d").cast("timestamp").alias("refreshed_at"))


def _replay_sql(group: bool) -> str:
    if group:
        keys = ["k_cluster_id", "group_id", "topic", '"partition"']
        caps = f"""SELECT '{CLUSTER}' AS k_cluster_id, 'g' || CAST(user_id AS VARCHAR) AS group_id, event_type AS topic,
                          CAST(user_id % 4 AS INTEGER) AS "partition", max(event_id) + 1 AS "offset",
                          date_trunc('day', ts) + INTERVAL 1 DAY AS captured_at
                   FROM events GROUP BY user_id, event_type, date_trunc('day', ts)"""
        start = "(pr IS NULL OR r - pr > 1)"
        applies = "true"
    else:
        keys = ["k_cluster_id", "topic", '"partition"', "offset_type"]
        caps = f"""SELECT '{CLUSTER}' AS k_cluster_id, event_type AS topic, CAST(user_id % 4 AS INTEGER) AS "partition",
                          'LATEST' AS offset_type, max(event_id) + 1 AS "offset",
                          date_trunc('day', ts) + INTERVAL 1 DAY AS captured_at
                   FROM events GROUP BY event_type, user_id % 4, date_trunc('day', ts)"""
        start = "(pc IS NULL)"
        applies = "offset_type = 'LATEST'"
    k = ", ".join(keys)
    return f"""
WITH caps AS ({caps}),
ranks AS (SELECT k_cluster_id, captured_at, dense_rank() OVER (PARTITION BY k_cluster_id ORDER BY captured_at) AS r
          FROM (SELECT DISTINCT k_cluster_id, captured_at FROM caps)),
x AS (SELECT c.*, r.r FROM caps c JOIN ranks r ON r.k_cluster_id = c.k_cluster_id AND r.captured_at = c.captured_at),
y AS (SELECT *, lag(r) OVER (PARTITION BY {k} ORDER BY captured_at) AS pr,
                lag("offset") OVER (PARTITION BY {k} ORDER BY captured_at) AS po,
                lag(captured_at) OVER (PARTITION BY {k} ORDER BY captured_at) AS pc FROM x),
z AS (SELECT *, {start} AS st, {start} OR "offset" IS DISTINCT FROM po AS changed FROM y),
z2 AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY captured_at
                                                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
       FROM z),
z3 AS (SELECT *, max(CASE WHEN changed THEN captured_at END) OVER (PARTITION BY {k} ORDER BY captured_at
                                                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                 AS modified_at,
                 min(captured_at) OVER (PARTITION BY {k}, island) AS discovered_at FROM z2),
z4 AS (SELECT *, lag(modified_at) OVER (PARTITION BY {k} ORDER BY captured_at) AS pm FROM z3)
SELECT {k}, "offset",
       CASE WHEN st THEN CAST(NULL AS DOUBLE)
            WHEN NOT changed THEN CASE WHEN {applies} THEN 0.0 END
            ELSE CASE WHEN {applies} THEN CAST("offset" - po AS DOUBLE)
                      / nullif(CAST(date_diff('microsecond', pm, captured_at) AS DOUBLE) / 1e6, 0) END END AS velocity,
       discovered_at, modified_at, captured_at AS refreshed_at,
       CASE WHEN st THEN 'insert' WHEN changed THEN 'update' ELSE 'touch' END AS action
FROM z4"""


# Fixed value: captures per replay segment in these queries (30 daily
# captures span five segments, so the carry across segments is exercised).
_REPLAY_SEGMENT = 7


@register("velocity_replay", _replay_sql(group=False))
def velocity_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 over 30 daily partition-offset captures (no stale delete: a missing row is no gap)."""
    from snaptide.operators.replay import replay
    ev = Tables(spark, sf_dir).events.select("user_id", "event_type", "event_id", "ts")
    spec = TABLES["partition_offsets"].__class__(name="po", keys=("k_cluster_id", "topic", "partition", "offset_type"),
                                                 compare=(("offset", "<=>"),), extra=("velocity",), velocity="LATEST")
    return to_ntz(replay(_daily(ev, group=False), spec, gaps=False, segment=_REPLAY_SEGMENT), *AUDIT_NTZ)


@register("velocity_replay_gaps", _replay_sql(group=True))
def velocity_replay_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 over daily group-offset captures with stale delete: a day without
    the key deletes it, its return starts a new island (insert, NULL velocity)."""
    from snaptide.operators.replay import replay
    ev = Tables(spark, sf_dir).events.select("user_id", "event_type", "event_id", "ts")
    spec = TABLES["consumer_group_offsets"].__class__(name="go", keys=tuple(_GO_KEYS), compare=(("offset", "<=>"),),
                                                      extra=("velocity",), velocity="all", delete_stale=True)
    return to_ntz(replay(_daily(ev, group=True), spec, segment=_REPLAY_SEGMENT), *AUDIT_NTZ)


# ------------------------------------------------------------------- report --

@register("snapshot_report", REPORT_SQL)
def snapshot_report_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 + A3: twelve counts per region capture (chunked snapshot rows)."""
    from snaptide.operators.report import snapshot_report
    snap = region_snapshot_rows(Tables(spark, sf_dir))
    return to_ntz(snapshot_report(snap), "refreshed_at")


# ------------------------------------------------------- end-to-end refresh --

@register("refresh_region_replicas", f"""
WITH reg AS (SELECT n.n_nationkey, r.r_name AS k_cluster_id FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey),
sup AS (SELECT CAST(s.s_suppkey AS INTEGER) AS node, reg.k_cluster_id FROM supplier s
        JOIN reg ON reg.n_nationkey = s.s_nationkey),
nodes AS (SELECT k_cluster_id, node FROM sup UNION SELECT k_cluster_id, CAST(n_nationkey AS INTEGER) FROM reg),
lin AS (SELECT l.l_orderkey, l.l_linenumber, CAST(l.l_suppkey AS INTEGER) AS s, CAST(l.l_partkey AS INTEGER) AS p,
               reg.k_cluster_id
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
        JOIN reg ON reg.n_nationkey = c.c_nationkey),
reps AS (SELECT k_cluster_id, l_orderkey, l_linenumber, s AS node, s AS leader_id FROM lin
         UNION ALL SELECT k_cluster_id, l_orderkey, l_linenumber, p, s FROM lin)
SELECT r.k_cluster_id, 't' || CAST(r.l_orderkey AS VARCHAR) AS k_topic_id, r.l_linenumber AS k_partition_id,
       r.node AS k_node_id, bool_or(r.node = r.leader_id) AS leader, bool_or(r.node = r.leader_id) AS in_sync,
       CAST(NULL AS BIGINT) AS size, CAST(NULL AS BIGINT) AS offset_lag, CAST(NULL AS BOOLEAN) AS future,
       {sql_ts(T0)} AS discovered_at, {sql_ts(T0)} AS modified_at, {sql_ts(T0)} AS refreshed_at
FROM reps r JOIN nodes n ON n.k_cluster_id = r.k_cluster_id AND n.node = r.node
GROUP BY r.k_cluster_id, r.l_orderkey, r.l_linenumber, r.node""")
def refresh_region_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End to end (S1-S9, F*, J1-J10, M1-M15, K4): one capture per region,
    split into chunk rows, refreshed into a new state store; the committed
    ``partition_replicas`` table. Replicas on nodes that are neither live nor
    quorum members are dropped by the lookup (J4); duplicate lines reduce
    to one row per key (Q9)."""
    import uuid

    from snaptide.plans.refresh import refresh_metadata
    from snaptide.plans.state import StateStore
    from snaptide.session import checkpoint_dir
    store = StateStore(spark, f"{checkpoint_dir(spark)}/registry-state-{uuid.uuid4().hex}")
    refresh_metadata(store, region_snapshot_rows(Tables(spark, sf_dir)))
    return to_ntz(store.read("partition_replicas"), *AUDIT_NTZ)


@register("refresh_group_offsets", f"""
WITH log AS (SELECT {cluster_sql("user_id")} AS k_cluster_id, event_type AS topic,
                    CAST(user_id % 4 AS INTEGER) AS "partition", event_id AS "offset", ts AS "timestamp"
             FROM events),
commits AS (SELECT {cluster_sql("user_id")} AS k_cluster_id, 'g' || CAST(user_id AS VARCHAR) AS group_id,
                   event_type AS topic, CAST(user_id % 4 AS INTEGER) AS "partition", max(event_id) + 1 AS "offset"
            FROM events GROUP BY user_id, event_type),
bounds AS (SELECT k_cluster_id, topic, "partition", min("offset") AS b, max("offset") + 1 AS e FROM log GROUP BY ALL),
t AS (SELECT DISTINCT c.k_cluster_id, c.topic, c."partition", c."offset" FROM commits c
      JOIN bounds x ON x.k_cluster_id = c.k_cluster_id AND x.topic = c.topic AND x."partition" = c."partition"
      WHERE c."offset" >= x.b AND c."offset" < x.e),
f AS (SELECT t.k_cluster_id, t.topic, t."partition", t."offset", min_by(l."timestamp", l."offset") AS offset_timestamp
      FROM t JOIN log l ON l.k_cluster_id = t.k_cluster_id AND l.topic = t.topic AND l."partition" = t."partition"
                        AND l."offset" >= t."offset"
      GROUP BY ALL)
SELECT c.k_cluster_id, c.group_id, 'T-' || c.topic AS k_topic_id, c."partition" AS k_partition_id, c."offset",
       f.offset_timestamp, CAST(NULL AS VARCHAR) AS metadata, CAST(NULL AS BIGINT) AS leader_epoch,
       CAST(NULL AS DOUBLE) AS velocity,
       {sql_ts(T1)} AS discovered_at, {sql_ts(T1)} AS modified_at, {sql_ts(T1)} AS refreshed_at
FROM commits c LEFT JOIN f ON f.k_cluster_id = c.k_cluster_id AND f.topic = c.topic
                          AND f."partition" = c."partition" AND f."offset" = c."offset"
""")
def refresh_group_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End to end offset refresh (S10, S11, J8, J14, W1/W2, J15/J16, M11,
    X5, K4): metadata derived from events is refreshed into a new store,
    then every user's committed offset (last event + 1) is resolved by
    group, topic name and partition, gets the time of the first record at
    or after it in the events log (only within the partition's bounds), and
    is merged into ``consumer_group_offsets``."""
    import uuid

    from snaptide.plans.refresh import refresh_metadata, refresh_offsets
    from snaptide.plans.state import StateStore
    from snaptide.session import checkpoint_dir
    ev = Tables(spark, sf_dir).events.select("event_id", "ts", "user_id", "event_type")
    store = StateStore(spark, f"{checkpoint_dir(spark)}/registry-state-{uuid.uuid4().hex}")
    refresh_metadata(store, events_snapshot_rows(ev))
    u = F.col("user_id")
    commits = (ev.groupBy("user_id", "event_type").agg((F.max("event_id") + 1).alias("offset"))
               .select(cluster_of("user_id").alias("k_cluster_id"), ts(T1).alias("captured_at"),
                       F.concat(F.lit("g"), u.cast("string")).alias("group_id"), F.col("event_type").alias("topic"),
                       (u % 4).cast("int").alias("partition"), "offset",
                       F.lit(None).cast("string").alias("metadata"), F.lit(None).cast("bigint").alias("leader_epoch")))
    log = ev.select(cluster_of("user_id").alias("k_cluster_id"), F.col("event_type").alias("topic"),
                    (u % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"),
                    F.col("ts").cast("timestamp").alias("timestamp"))
    refresh_offsets(store, commits, None, log, bucket=_ASOF_BUCKET)
    return to_ntz(store.read("consumer_group_offsets"), "offset_timestamp", *AUDIT_NTZ)


# The queries over several refreshes register themselves.
from snaptide.plans import refresh_queries  # noqa: E402,F401

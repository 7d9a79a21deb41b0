"""Queries that refresh a store several times and return what is committed, each with its SQL.

Captures are derived from the given tables, identically in Spark and SQL; every
query computes its own stores. Arithmetic on keys decides what a capture holds
and what changes between captures; all rows take part.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptide.plans.refresh import refresh_metadata, refresh_offsets
from snaptide.plans.registry import AUDIT_NTZ, ORACLES, register
from snaptide.plans.state import StateStore
from snaptide.plans.table_snapshots import (
    T0, T1, TOPICS_SQL, chunk, cluster_of, cluster_sql, events_snapshot_rows, sql_ts, to_ntz, topic_snapshot_rows, ts,
    two_snapshot_merge_sql,
)
from snaptide.operators.integrity import integrity_report
from snaptide.schemas import GROUP_EVENTS, PARTITION_OFFSETS, TABLES
from snaptide.session import checkpoint_dir
from snaptide.sources.snapshots import read_checked_snapshots
from snaptide.sources.tables import Tables
from snaptide.streaming.refresh_stream import offset_batch, start_capture_history, start_resolved_offsets

T2 = "2024-02-03 00:00:00"


def new_store(spark: SparkSession) -> StateStore:
    return StateStore(spark, f"{checkpoint_dir(spark)}/registry-state-{uuid.uuid4().hex}")


def fold_sql(caps: str, keys, attrs, scope, velocity: str | None, stale: bool, keep: str = "") -> str:
    """State after all captures of ``caps`` (keys, attrs, captured_at) as window SQL. ``scope``: the columns whose
    reads a missing key is judged by; ``velocity``: condition under which a row has one."""
    k, s = ", ".join(f'"{x}"' for x in keys), ", ".join(f'"{x}"' for x in scope)
    lags = "".join(f', lag("{a}") OVER w AS p_{a}' for a in attrs)
    same = " AND ".join(f'"{a}" IS NOT DISTINCT FROM p_{a}' for a in attrs) or "true"
    start = "(pr IS NULL OR r - pr > 1)" if stale else "(pr IS NULL)"
    speed = (f""", CASE WHEN st OR NOT ({velocity}) THEN CAST(NULL AS DOUBLE) WHEN NOT changed THEN 0.0
              ELSE CAST("offset" - p_offset AS DOUBLE)
                   / nullif(CAST(date_diff('microsecond', pm, captured_at) AS DOUBLE) / 1e6, 0) END AS velocity"""
             if velocity else "")
    end = "r = last_r" if stale else "next_at IS NULL"
    cols = "".join(f', "{a}"' for a in attrs)
    return f"""
WITH caps AS ({caps}),
ranks AS (SELECT {s}, captured_at, dense_rank() OVER (PARTITION BY {s} ORDER BY captured_at) AS r
          FROM (SELECT DISTINCT {s}, captured_at FROM caps)),
x AS (SELECT caps.*, ranks.r, max(ranks.r) OVER (PARTITION BY {s}) AS last_r
      FROM caps JOIN ranks USING ({s}, captured_at)),
y AS (SELECT *, lag(r) OVER w AS pr, lead(captured_at) OVER w AS next_at{lags} FROM x
      WINDOW w AS (PARTITION BY {k} ORDER BY captured_at)),
z AS (SELECT *, {start} AS st, {start} OR NOT ({same}) AS changed FROM y),
z2 AS (SELECT *, max(CASE WHEN changed THEN captured_at END) OVER u AS modified_at,
              max(CASE WHEN st THEN captured_at END) OVER u AS discovered_at FROM z
       WINDOW u AS (PARTITION BY {k} ORDER BY captured_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
z3 AS (SELECT *, lag(modified_at) OVER (PARTITION BY {k} ORDER BY captured_at) AS pm FROM z2)
SELECT {k}{cols}{keep}{speed}, discovered_at, modified_at, captured_at AS refreshed_at
FROM z3 WHERE {end}"""


# ------------------------------------------------- several captures a batch --

_DAYS = """SELECT 'c' || CAST(user_id % 3 AS VARCHAR) AS k_cluster_id, 'g' || CAST(user_id AS VARCHAR) AS group_id,
                  'T-' || event_type AS k_topic_id, CAST(user_id % 4 AS INTEGER) AS k_partition_id,
                  max(event_id) + 1 AS "offset", date_trunc('day', ts) + INTERVAL 1 DAY AS captured_at
           FROM events GROUP BY user_id, event_type, date_trunc('day', ts)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).events.select("event_id", "ts", "user_id", "event_type")


def _commit_rows(ev: DataFrame, at: Column, *more) -> DataFrame:
    """GROUP_OFFSETS rows: one commit per user, event type and capture time (and ``more`` conditions)."""
    g = ev.groupBy("user_id", "event_type", at.alias("captured_at")).agg((F.max("event_id") + 1).alias("offset"))
    for m in more:
        g = g.filter(m)
    return g.select(cluster_of("user_id").alias("k_cluster_id"), F.col("captured_at").cast("timestamp"),
                    F.concat(F.lit("g"), F.col("user_id").cast("string")).alias("group_id"),
                    F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), "offset",
                    F.lit(None).cast("string").alias("metadata"), F.lit(None).cast("bigint").alias("leader_epoch"))


_NO_EXTRAS = """, CAST(NULL AS TIMESTAMP) AS offset_timestamp, CAST(NULL AS VARCHAR) AS metadata,
       CAST(NULL AS BIGINT) AS leader_epoch"""


@register("refresh_fold_offsets", fold_sql(
    _DAYS, ["k_cluster_id", "group_id", "k_topic_id", "k_partition_id"], ["offset"], ["k_cluster_id", "group_id"],
    "true", True, keep=_NO_EXTRAS))
def refresh_fold_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11 + V1 + X5: daily commits in two batches of about fifteen captures each, folded in order. A group's
    capture of a day has read that group; a topic it no longer commits goes and starts anew later."""
    ev = _events(spark, sf_dir)
    store = new_store(spark)
    refresh_metadata(store, events_snapshot_rows(ev), tables=("nodes", "topics", "topic_partitions", "consumer_groups"))
    days = _commit_rows(ev, F.date_trunc("day", F.col("ts")) + F.expr("INTERVAL 1 DAY"))
    half = F.dayofmonth("captured_at") <= 16
    refresh_offsets(store, days.filter(half & (F.month("captured_at") == 1)))
    refresh_offsets(store, days.filter(~(half & (F.month("captured_at") == 1))))
    return to_ntz(store.read("consumer_group_offsets"), "offset_timestamp", *AUDIT_NTZ)


_TOPIC_CAPS = " UNION ALL ".join(f"""
SELECT {cluster_sql("o_custkey")} AS k_cluster_id, 't' || CAST(o_orderkey AS VARCHAR) AS k_topic_id,
       'topic-' || CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 7 < {d} THEN '-r' ELSE '' END AS name,
       o_orderpriority = '1-URGENT' AS internal, {sql_ts(T0)} + INTERVAL {d} MINUTE AS captured_at
FROM orders WHERE (o_orderkey + {d}) % 5 <> 0""" for d in (1, 2, 3, 4))


def _topic_captures(spark: SparkSession, sf_dir: str) -> dict[int, DataFrame]:
    orders = Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    out = {}
    for d in (1, 2, 3, 4):
        k = F.col("o_orderkey")
        topic = F.struct(F.concat(F.lit("t"), k.cast("string")).alias("k_topic_id"),
                         F.concat(F.lit("topic-"), k.cast("string"), F.when(k % 7 < d, "-r").otherwise("")).alias("name"),
                         (F.col("o_orderpriority") == "1-URGENT").alias("internal"))
        out[d] = chunk(orders.filter((k + d) % 5 != 0), k_cluster_id=cluster_of("o_custkey"),
                       cluster_name=cluster_of("o_custkey"), captured_at=ts(T0) + F.expr(f"INTERVAL {d} MINUTE"),
                       controller_id=F.lit(0), nodes=F.array(), topics=F.array(topic))
    return out


@register("refresh_fold_topics", fold_sql(
    _TOPIC_CAPS, ["k_cluster_id", "k_topic_id"], ["name", "internal"], ["k_cluster_id"], None, True))
def refresh_fold_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4 + X1: four topic captures of every cluster in two batches of two, applied in order."""
    caps, store = _topic_captures(spark, sf_dir), new_store(spark)
    refresh_metadata(store, caps[1].unionByName(caps[2]), tables=("topics",))
    refresh_metadata(store, caps[4].unionByName(caps[3]), tables=("topics",))
    return to_ntz(store.read("topics"), *AUDIT_NTZ)


@register("refresh_split_capture", "SELECT * EXCLUDE (action) FROM (" + two_snapshot_merge_sql(
    TOPICS_SQL["A"], TOPICS_SQL["B"], ["k_cluster_id", "k_topic_id"], (("name", "="), ("internal", "=")),
    delete="scope") + ") WHERE action <> 'delete'")
def refresh_split_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second capture's chunks come in two batches: nothing is removed or applied before all are there."""
    orders = Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    store = new_store(spark)
    refresh_metadata(store, _whole(topic_snapshot_rows(orders, "A")), tables=("topics",))
    part = F.pmod(F.xxhash64(F.col("topics")[0]["k_topic_id"]), F.lit(2)).cast("int")
    chunks = _whole(topic_snapshot_rows(orders, "B")).withColumns({"chunk_index": part, "chunk_count": F.lit(2)})
    refresh_metadata(store, chunks.filter("chunk_index = 1"), tables=("topics",))
    refresh_metadata(store, chunks.filter("chunk_index = 0"), tables=("topics",))
    return to_ntz(store.read("topics"), *AUDIT_NTZ)


def _whole(rows: DataFrame) -> DataFrame:
    """Rows with some sections as rows of the snapshot schema."""
    return chunk(rows, **{c: F.col(c) for c in rows.columns})


# ------------------------------------------------------ what a capture read --

_COMMITS = f"""SELECT {cluster_sql("user_id")} AS k_cluster_id, user_id, event_type, max(event_id) + 1 AS "offset"
               FROM events GROUP BY user_id, event_type"""


@register("refresh_group_offsets_partial", f"""
WITH c AS ({_COMMITS})
SELECT k_cluster_id, 'g' || CAST(user_id AS VARCHAR) AS group_id, 'T-' || event_type AS k_topic_id,
       CAST(user_id % 4 AS INTEGER) AS k_partition_id,
       CASE WHEN user_id % 5 IN (1, 2, 3) THEN "offset" + user_id % 5 - 1 ELSE "offset" END AS "offset"{_NO_EXTRAS},
       CASE WHEN user_id % 5 = 1 THEN 0.0 WHEN user_id % 5 IN (2, 3) THEN CAST(user_id % 5 - 1 AS DOUBLE) / 86400
            ELSE CAST(NULL AS DOUBLE) END AS velocity,
       {sql_ts(T1)} AS discovered_at,
       CASE WHEN user_id % 5 IN (2, 3) THEN {sql_ts(T2)} ELSE {sql_ts(T1)} END AS modified_at,
       CASE WHEN user_id % 5 IN (1, 2, 3) THEN {sql_ts(T2)} ELSE {sql_ts(T1)} END AS refreshed_at
FROM c WHERE user_id % 5 IN (1, 2, 4) OR (user_id % 5 = 3 AND event_type = 'click')""")
def refresh_group_offsets_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second capture reads the groups of users 0-3 modulo 5. Users 0 have no commits left, users 3
    only their clicks; the groups of users 4 were not read and keep theirs."""
    ev = _events(spark, sf_dir)
    store = new_store(spark)
    refresh_metadata(store, events_snapshot_rows(ev), tables=("nodes", "topics", "topic_partitions", "consumer_groups"))
    refresh_offsets(store, _commit_rows(ev, ts(T1)))
    u = F.col("user_id")
    second = _commit_rows(ev.filter((u % 5).isin(1, 2) | ((u % 5 == 3) & (F.col("event_type") == "click"))), ts(T2))
    user = F.substring("group_id", 2, 20).cast("bigint")
    second = second.withColumn("offset", F.col("offset") + user % 5 - 1)
    reads = ev.select(cluster_of("user_id").alias("k_cluster_id"), ts(T2).alias("captured_at"),
                      F.concat(F.lit("g"), u.cast("string")).alias("group_id"), (u % 5 != 4).alias("read")).distinct()
    refresh_offsets(store, second, group_reads=reads)
    return to_ntz(store.read("consumer_group_offsets"), "offset_timestamp", *AUDIT_NTZ)


@register("refresh_offsets_after_topic_removed", f"""
WITH c AS ({_COMMITS})
SELECT k_cluster_id, 'g' || CAST(user_id AS VARCHAR) AS group_id, 'T-' || event_type AS k_topic_id,
       CAST(user_id % 4 AS INTEGER) AS k_partition_id, "offset"{_NO_EXTRAS},
       CASE WHEN user_id % 2 = 0 THEN 0.0 END AS velocity,
       {sql_ts(T1)} AS discovered_at, {sql_ts(T1)} AS modified_at,
       CASE WHEN user_id % 2 = 0 THEN {sql_ts(T2)} ELSE {sql_ts(T1)} END AS refreshed_at
FROM c WHERE event_type <> 'error'""")
def refresh_offsets_after_topic_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3 over two stores: the topic of errors leaves the metadata; its commits go from the offset store, those of
    groups that were not read again included."""
    ev = _events(spark, sf_dir)
    meta, offs = new_store(spark), new_store(spark)
    names = ("nodes", "topics", "topic_partitions", "consumer_groups")
    refresh_metadata(meta, events_snapshot_rows(ev), tables=names)
    refresh_offsets(offs, _commit_rows(ev, ts(T1)), metadata=meta)
    fewer = events_snapshot_rows(ev)
    section = F.coalesce(F.col("topics")[0]["name"], F.col("topic_descriptions")[0]["name"], F.lit(""))
    refresh_metadata(meta, fewer.filter(section != "error").withColumn("captured_at", ts(T1)), tables=names)
    refresh_offsets(offs, _commit_rows(ev.filter(F.col("user_id") % 2 == 0), ts(T2)), metadata=meta)
    return to_ntz(offs.read("consumer_group_offsets"), "offset_timestamp", *AUDIT_NTZ)


# ----------------------------------------------- second refresh, every table --

def _state_rows(store: StateStore, names) -> DataFrame:
    """Committed rows of several tables in one shape: key and attributes as text."""
    def text(cols):
        return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols])

    parts = [store.read(n).select(F.lit(n).alias("table_name"), text(TABLES[n].keys).alias("row_key"),
                                  text(TABLES[n].attrs).alias("row_attrs"), *AUDIT_NTZ) for n in names]
    return to_ntz(reduce(DataFrame.unionByName, parts), *AUDIT_NTZ)


def _rows_sql(captures: dict[str, tuple[str, str, str | None]]) -> str:
    """SQL of ``_state_rows``: table -> (first capture, second capture, delete)."""
    def text(cols):
        return "concat_ws('|', " + ", ".join(f"""coalesce(CAST("{c}" AS VARCHAR), '~')""" for c in cols) + ")" if cols else "''"

    return " UNION ALL ".join(f"""
SELECT '{n}' AS table_name, {text(TABLES[n].keys)} AS row_key, {text(TABLES[n].attrs)} AS row_attrs,
       discovered_at, modified_at, refreshed_at
FROM ({two_snapshot_merge_sql(a, b, list(TABLES[n].keys), TABLES[n].compare, delete)}) WHERE action <> 'delete'"""
                                for n, (a, b, delete) in captures.items())


def _two(make) -> tuple[str, str]:
    return make(False), make(True)


def _ab(key: str, second: bool) -> str:
    return f"{key} % 10 <> {1 if second else 0}"


def _has(key: str, second: bool) -> Column:
    return F.col(key) % 10 != (1 if second else 0)


_NODES_OF = "array<struct<id:int,host:string,port:int,rack:string>>"


def _base(key: str, second: bool, controller: int = 1) -> dict[str, Column]:
    return dict(k_cluster_id=cluster_of(key), cluster_name=F.concat(F.lit("name-"), cluster_of(key),
                F.when(F.lit(second) & (F.col(key) % 3 == 1), "-new").otherwise("")),
                captured_at=ts(T1 if second else T0), controller_id=F.lit(controller),
                nodes=F.array().cast(_NODES_OF))


def _node_rows(sup: DataFrame, second: bool) -> DataFrame:
    s = F.col("s_suppkey")
    node = F.struct(s.cast("int").alias("id"), F.col("s_name").alias("host"),
                    (F.lit(9092) + F.when(F.lit(second) & (s % 7 == 0), 1).otherwise(0)).alias("port"),
                    F.when(s % 5 != 0, F.concat(F.lit("r"), F.col("s_nationkey").cast("string"))).alias("rack"))
    value = F.when(~(F.lit(second) & (s % 7 == 1)), F.col("s_nationkey").cast("string"))
    entry = F.struct(F.lit("nation").alias("name"), value.alias("value"), F.lit("DEFAULT").alias("source"),
                     F.lit(False).alias("sensitive"), (s % 2 == 0).alias("read_only"), F.lit("INT").alias("type"),
                     F.lit(None).cast("string").alias("documentation"))
    base = _base("s_suppkey", second, 4 if second else 1) | dict(nodes=F.array(node))
    # the second capture's quorum: leader 1, voters 1 and 1000000 (neither live), observer 4, reported by cluster c1 only
    ids = "array<int>"
    quorum = F.when(F.lit(second) & (s % 3 == 1), F.struct(
        F.lit(1).alias("leader_id"), F.array(F.lit(1), F.lit(1000000)).cast(ids).alias("voters"),
        F.array(F.lit(4)).cast(ids).alias("observers")))
    configs = F.array(F.struct(s.cast("int").alias("node_id"), F.array(entry).alias("entries")),
                      F.struct((s + 5000000).cast("int").alias("node_id"), F.array(entry).alias("entries")))
    return chunk(sup.filter(_has("s_suppkey", second)), **base, quorum=quorum, node_configs=configs)


def _nodes_sql(second: bool) -> str:
    s = f"SELECT * FROM supplier WHERE {_ab('s_suppkey', second)}"
    port = "9092 + CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END" if second else "9092"
    flag = (lambda test: f"CASE WHEN s_suppkey % 3 = 1 THEN {test} END") if second else (lambda test: "CAST(NULL AS BOOLEAN)")
    # supplier 1 is not in the second capture, so its id too is a voter that is not live
    missing = """ UNION ALL SELECT 'c1', id, NULL, -1, NULL, false, id = 1, true, false FROM (VALUES (1), (1000000)) v(id)
                  WHERE EXISTS (SELECT 1 FROM s WHERE s_suppkey % 3 = 1)""" if second else ""
    return f"""WITH s AS ({s}) SELECT {cluster_sql('s_suppkey')} AS k_cluster_id, CAST(s_suppkey AS INTEGER) AS k_node_id,
       s_name AS host, CAST({port} AS INTEGER) AS port,
       CASE WHEN s_suppkey % 5 <> 0 THEN 'r' || CAST(s_nationkey AS VARCHAR) END AS rack,
       s_suppkey = {4 if second else 1} AS controller, {flag('s_suppkey = 1')} AS leader,
       {flag('s_suppkey IN (1, 1000000)')} AS voter, {flag('s_suppkey = 4')} AS observer FROM s{missing}"""


def _node_configs_sql(second: bool) -> str:
    value = "CAST(s_nationkey AS VARCHAR)"
    value = f"CASE WHEN s_suppkey % 7 <> 1 THEN {value} END" if second else value
    return f"""SELECT {cluster_sql('s_suppkey')} AS k_cluster_id, CAST(s_suppkey AS INTEGER) AS k_node_id, 'nation' AS name,
       {value} AS value, 'DEFAULT' AS source, false AS sensitive, s_suppkey % 2 = 0 AS read_only, 'INT' AS type,
       CAST(NULL AS VARCHAR) AS documentation FROM supplier WHERE {_ab('s_suppkey', second)}"""


def _clusters_sql(second: bool) -> str:
    new = "|| CASE WHEN s_suppkey % 3 = 1 THEN '-new' ELSE '' END" if second else ""
    return f"""SELECT DISTINCT {cluster_sql('s_suppkey')} AS k_cluster_id, 'name-' || {cluster_sql('s_suppkey')} {new} AS name
               FROM supplier WHERE {_ab('s_suppkey', second)}"""


@register("refresh_second_nodes", _rows_sql({
    "clusters": (*_two(_clusters_sql), None), "nodes": (*_two(_nodes_sql), None),
    "node_configs": (*_two(_node_configs_sql), None)}))
def refresh_second_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1-M3 over two captures: placeholders for quorum members, flags, configs of live nodes only; rows that the
    second capture lacks stay."""
    sup = Tables(spark, sf_dir).supplier.select("s_suppkey", "s_name", "s_nationkey")
    names, store = ("clusters", "nodes", "node_configs"), new_store(spark)
    for second in (False, True):
        refresh_metadata(store, _node_rows(sup, second), tables=names)
    return _state_rows(store, names)


def _topic_rows(orders: DataFrame, lines: DataFrame, second: bool) -> DataFrame:
    k = F.col("o_orderkey")
    at = dict(captured_at=ts(T1 if second else T0), controller_id=F.lit(0), cluster_name=F.col("k_cluster_id"),
              k_cluster_id=F.col("k_cluster_id"))
    none = F.array().cast(_NODES_OF)
    kept = orders.filter(_has("o_orderkey", second)).select("o_orderkey", "o_orderpriority",
                                                            cluster_of("o_custkey").alias("k_cluster_id"))
    tid, name = F.concat(F.lit("t"), k.cast("string")), F.concat(F.lit("topic-"), k.cast("string"))
    prio = F.when(F.lit(second) & (k % 7 == 0), F.lit("changed")).otherwise(F.col("o_orderpriority"))
    entry = F.struct(F.lit("priority").alias("name"), prio.alias("value"), F.lit("TOPIC").alias("source"),
                     F.lit(False).alias("sensitive"), F.lit(False).alias("read_only"), F.lit("STRING").alias("type"),
                     F.when(k % 5 == 0, "doc").alias("documentation"))
    topics = chunk(kept, **at, nodes=none,
                   topics=F.array(F.struct(tid.alias("k_topic_id"), name.alias("name"), F.lit(False).alias("internal"))),
                   topic_configs=F.array(F.struct(tid.alias("k_topic_id"), F.array(entry).alias("entries"))))
    li = kept.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    supp = F.col("l_suppkey").cast("int")
    synced = F.when(F.lit(second) & (k % 5 == 0), F.array().cast("array<int>")).otherwise(F.array(supp))
    part = F.struct(F.col("l_linenumber").cast("int").alias("partition"), supp.alias("leader"),
                    F.array(supp).alias("replicas"), synced.alias("isr"))
    size = F.col("l_quantity").cast("long") + F.when(F.lit(second) & (k % 7 == 0), 1).otherwise(0)
    held = F.struct(name.alias("topic"), F.col("l_linenumber").cast("int").alias("partition"), size.alias("size"),
                    F.lit(0).cast("long").alias("offset_lag"), F.lit(False).alias("future"))
    rows = chunk(li, **at, nodes=none,
                 topic_descriptions=F.array(F.struct(tid.alias("k_topic_id"), name.alias("name"),
                                                     F.array(part).alias("partitions"))),
                 log_dirs=F.when(F.col("l_linenumber") % 3 != 0, F.array(F.struct(
                     supp.alias("node_id"), F.lit("/d").alias("path"), F.array(held).alias("replicas")))))
    return topics.unionByName(rows)


def _supplier_nodes(sup: DataFrame, second: bool) -> DataFrame:
    """All suppliers as nodes of each of the three clusters, but those divisible by 11."""
    own = sup.filter(F.col("s_suppkey") % 11 != 0).select("s_suppkey", F.explode(F.array(*[F.lit(f"c{i}") for i in range(3)])).alias("k_cluster_id"))
    node = F.struct(F.col("s_suppkey").cast("int").alias("id"), F.lit("h").alias("host"), F.lit(1).alias("port"),
                    F.lit(None).cast("string").alias("rack"))
    return chunk(own, k_cluster_id=F.col("k_cluster_id"), cluster_name=F.col("k_cluster_id"),
                 captured_at=ts(T1 if second else T0), controller_id=F.lit(0), nodes=F.array(node))


def _topics_sql(second: bool) -> str:
    return f"""SELECT {cluster_sql('o_custkey')} AS k_cluster_id, 't' || CAST(o_orderkey AS VARCHAR) AS k_topic_id,
       'topic-' || CAST(o_orderkey AS VARCHAR) AS name, false AS internal FROM orders WHERE {_ab('o_orderkey', second)}"""


def _topic_configs_sql(second: bool) -> str:
    value = "CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE o_orderpriority END" if second else "o_orderpriority"
    return f"""SELECT {cluster_sql('o_custkey')} AS k_cluster_id, 't' || CAST(o_orderkey AS VARCHAR) AS k_topic_id,
       'priority' AS name, {value} AS value, 'TOPIC' AS source, false AS sensitive, false AS read_only, 'STRING' AS type,
       CASE WHEN o_orderkey % 5 = 0 THEN 'doc' END AS documentation FROM orders WHERE {_ab('o_orderkey', second)}"""


def _partitions_sql(second: bool) -> str:
    return f"""SELECT DISTINCT {cluster_sql('o_custkey')} AS k_cluster_id, 't' || CAST(o_orderkey AS VARCHAR) AS k_topic_id,
       CAST(l_linenumber AS INTEGER) AS k_partition_id
       FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE {_ab('o_orderkey', second)}"""


def _replicas_sql(second: bool) -> str:
    more = "+ CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END" if second else ""
    synced = "o_orderkey % 5 <> 0" if second else "true"
    return f"""SELECT {cluster_sql('o_custkey')} AS k_cluster_id, 't' || CAST(o_orderkey AS VARCHAR) AS k_topic_id,
       CAST(l_linenumber AS INTEGER) AS k_partition_id, CAST(l_suppkey AS INTEGER) AS k_node_id, true AS leader,
       bool_or({synced}) AS in_sync,
       CASE WHEN l_linenumber % 3 <> 0 THEN min(CAST(trunc(l_quantity) AS BIGINT) {more}) END AS size,
       CASE WHEN l_linenumber % 3 <> 0 THEN CAST(0 AS BIGINT) END AS offset_lag,
       CASE WHEN l_linenumber % 3 <> 0 THEN false END AS future
       FROM orders JOIN lineitem ON l_orderkey = o_orderkey
       WHERE {_ab('o_orderkey', second)} AND l_suppkey % 11 <> 0 AND l_suppkey IN (SELECT s_suppkey FROM supplier)
       GROUP BY o_custkey, o_orderkey, l_linenumber, l_suppkey"""


@register("refresh_second_topics", _rows_sql({
    "topics": (*_two(_topics_sql), "scope"), "topic_configs": (*_two(_topic_configs_sql), "scope"),
    "topic_partitions": (*_two(_partitions_sql), "scope"), "partition_replicas": (*_two(_replicas_sql), "scope")}))
def refresh_second_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4-M7 + X1 + K3 over two captures: topics that the second lacks go, with their configs, partitions and
    replicas; replicas on unknown nodes are left out; sizes from log dirs."""
    t = Tables(spark, sf_dir)
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    sup = t.supplier.select("s_suppkey")
    names, store = ("topics", "topic_configs", "topic_partitions", "partition_replicas"), new_store(spark)
    for second in (False, True):
        refresh_metadata(store, _topic_rows(orders, lines, second).unionByName(_supplier_nodes(sup, second)),
                         tables=("nodes", *names))
    return _state_rows(store, names)


def _group_rows(customers: DataFrame, orders: DataFrame, second: bool) -> DataFrame:
    c = F.col("c_custkey")
    none = F.array().cast(_NODES_OF)
    member_type = ("array<struct<member_id:string,group_instance_id:string,client_id:string,host:string,"
                   "assignments:array<struct<topic:string,partition:int>>>>")
    at = dict(k_cluster_id=cluster_of("c_custkey"), cluster_name=cluster_of("c_custkey"),
              captured_at=ts(T1 if second else T0), controller_id=F.lit(0))
    gid = F.concat(F.lit("g"), c.cast("string"))
    state = F.concat(F.lit("S"), (F.col("c_nationkey") + F.when(F.lit(second) & (c % 7 == 0), 1).otherwise(0)).cast("string"))
    common = dict(group_id=gid, simple=(c % 2 == 0), state=state,
                  partition_assignor=F.when(c % 5 != 0, F.lit("range")),
                  coordinator_id=F.when(c % 11 == 0, 999999).otherwise(0))
    fields = ("group_id", "simple", "state", "partition_assignor", "coordinator_id")

    def group(members: Column) -> Column:
        return F.array(F.struct(*[common[f].alias(f) for f in fields], members.cast(member_type).alias("members")))

    kept = customers.filter(_has("c_custkey", second))
    alone = chunk(kept, **at, nodes=none, consumer_groups=group(F.array().cast(member_type)))
    o = F.col("o_orderkey")
    slot = (o + F.when(F.lit(second) & (o % 7 == 0), 1).otherwise(0)) % 9
    member = F.struct(F.concat(F.lit("m"), o.cast("string")).alias("member_id"), F.lit(None).cast("string").alias("group_instance_id"),
                      F.when(F.lit(second) & (o % 7 == 0), "moved").otherwise(F.col("o_orderpriority")).alias("client_id"),
                      F.col("o_orderstatus").alias("host"),
                      F.array(F.struct(F.lit("alpha").alias("topic"), slot.cast("int").alias("partition")),
                              F.struct(F.lit("unknown").alias("topic"), F.lit(0).alias("partition"))).alias("assignments"))
    having = kept.join(orders.filter(_has("o_orderkey", second)), c == F.col("o_custkey"))
    members = chunk(having, **at, nodes=none, consumer_groups=group(F.array(member)))
    part = [F.struct(F.lit(p).alias("partition"), F.lit(0).alias("leader"), F.array(F.lit(0)).alias("replicas"),
                     F.array(F.lit(0)).alias("isr")) for p in range(7)]
    one = customers.select((c % 3).alias("c_custkey")).distinct()
    rest = chunk(one, **(at | dict(
        nodes=F.array(F.struct(F.lit(0).alias("id"), F.lit("h").alias("host"), F.lit(1).alias("port"), F.lit(None).cast("string").alias("rack"))),
        topics=F.array(F.struct(F.lit("T").alias("k_topic_id"), F.lit("alpha").alias("name"), F.lit(False).alias("internal"))),
        topic_descriptions=F.array(F.struct(F.lit("T").alias("k_topic_id"), F.lit("alpha").alias("name"), F.array(*part).alias("partitions"))))))
    return alone.unionByName(members).unionByName(rest)


def _groups_sql(second: bool) -> str:
    state = "c_nationkey + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END" if second else "c_nationkey"
    return f"""SELECT {cluster_sql('c_custkey')} AS k_cluster_id, 'g' || CAST(c_custkey AS VARCHAR) AS group_id,
       0 AS coordinator_id, c_custkey % 2 = 0 AS simple, 'S' || CAST({state} AS VARCHAR) AS state,
       CASE WHEN c_custkey % 5 <> 0 THEN 'range' END AS partition_assignor
       FROM customer WHERE {_ab('c_custkey', second)} AND c_custkey % 11 <> 0"""


def _members_sql(second: bool, extra: str = "") -> str:
    client = "CASE WHEN o_orderkey % 7 = 0 THEN 'moved' ELSE o_orderpriority END" if second else "o_orderpriority"
    slot = "(o_orderkey + CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END) % 9" if second else "o_orderkey % 9"
    cols = (f"'T' AS k_topic_id, CAST({slot} AS INTEGER) AS k_partition_id" if extra else
            f"CAST(NULL AS VARCHAR) AS group_instance_id, {client} AS client_id, o_orderstatus AS host")
    return f"""SELECT {cluster_sql('c_custkey')} AS k_cluster_id, 'g' || CAST(c_custkey AS VARCHAR) AS group_id,
       'm' || CAST(o_orderkey AS VARCHAR) AS member_id, {cols}
       FROM customer JOIN orders ON o_custkey = c_custkey
       WHERE {_ab('c_custkey', second)} AND {_ab('o_orderkey', second)} AND c_custkey % 11 <> 0
       {f'AND {slot} < 7' if extra else ''}"""


@register("refresh_second_groups", _rows_sql({
    "consumer_groups": (*_two(_groups_sql), "scope"), "consumer_group_members": (*_two(_members_sql), "scope"),
    "consumer_group_member_assignments": (*_two(lambda s: _members_sql(s, "assignments")), "scope")}))
def refresh_second_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8-M10 + X2-X4 over two captures: groups with an unknown coordinator, unknown topic names and partitions are
    left out; groups, members and assignments that the second capture lacks go."""
    t = Tables(spark, sf_dir)
    customers = t.customer.select("c_custkey", "c_nationkey")
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    names = ("consumer_groups", "consumer_group_members", "consumer_group_member_assignments")
    store = new_store(spark)
    for second in (False, True):
        refresh_metadata(store, _group_rows(customers, orders, second), tables=("nodes", "topics", "topic_partitions", *names))
    return _state_rows(store, names)


def _binding_rows(lines: DataFrame, second: bool) -> DataFrame:
    binding = F.struct(F.lit("TOPIC").alias("resource_type"), F.concat(F.lit("r"), (F.col("l_partkey") % 200).cast("string")).alias("name"),
                       F.lit("LITERAL").alias("pattern_type"), F.concat(F.lit("u"), (F.col("l_suppkey") % 50).cast("string")).alias("principal"),
                       F.lit("*").alias("host"), F.concat(F.lit("op"), (F.col("l_linenumber") % 3).cast("string")).alias("operation"),
                       F.lit("ALLOW").alias("permission_type"))
    return chunk(lines.filter(F.col("l_partkey") % 10 != (1 if second else 0)), **_base("l_orderkey", second), acl_bindings=F.array(binding))


def _acl_sql(cols: str):
    def make(second: bool) -> str:
        return f"""SELECT DISTINCT {cols} FROM (SELECT {cluster_sql('l_orderkey')} AS k_cluster_id, 'TOPIC' AS resource_type,
            'r' || CAST(l_partkey % 200 AS VARCHAR) AS resource_name, 'LITERAL' AS pattern_type,
            'u' || CAST(l_suppkey % 50 AS VARCHAR) AS principal, '*' AS host, 'op' || CAST(l_linenumber % 3 AS VARCHAR) AS operation,
            'ALLOW' AS permission_type FROM lineitem WHERE {_ab('l_partkey', second)})"""
    return make


@register("refresh_second_acls", _rows_sql({
    "acl_resources": (*_two(_acl_sql("k_cluster_id, resource_type, resource_name AS name, pattern_type")), "scope"),
    "acl_entries": (*_two(_acl_sql("k_cluster_id, principal, host, operation, permission_type")), "scope"),
    "acl_bindings": (*_two(_acl_sql("k_cluster_id, resource_type, resource_name, pattern_type, principal, host, "
                                    "operation, permission_type")), "scope")}))
def refresh_second_acls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13-M15 + X6-X8 over two captures of access rules derived from the order lines."""
    lines = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    names, store = ("acl_resources", "acl_entries", "acl_bindings"), new_store(spark)
    for second in (False, True):
        refresh_metadata(store, _binding_rows(lines, second), tables=names)
    return _state_rows(store, names)


@register("refresh_second_partition_offsets", fold_sql(
    f"""SELECT k_cluster_id, 'T-' || event_type AS k_topic_id, p AS k_partition_id, 'LATEST' AS offset_type, captured_at,
               CASE WHEN o % 11 = 0 THEN NULL ELSE o END AS "offset", CAST(NULL AS TIMESTAMP) AS "timestamp",
               CASE WHEN p = 0 THEN NULL ELSE p END AS leader_epoch
        FROM (SELECT {cluster_sql('user_id')} AS k_cluster_id, event_type, CAST(user_id % 4 AS BIGINT) AS p,
                     max(event_id) + 1 AS o, date_trunc('day', ts) + INTERVAL 1 DAY AS captured_at
              FROM events GROUP BY ALL)""",
    ["k_cluster_id", "k_topic_id", "k_partition_id", "offset_type"], ["offset", "timestamp", "leader_epoch"],
    ["k_cluster_id"], "offset_type = 'LATEST'", False).replace('"k_partition_id", "offset_type", "offset"',
                                                             'CAST("k_partition_id" AS INTEGER) AS "k_partition_id", "offset_type", "offset"'))
def refresh_second_partition_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12 + V2: daily partition offsets, unknown ones (-1) among them, in two batches of captures."""
    ev = _events(spark, sf_dir)
    store = new_store(spark)
    refresh_metadata(store, events_snapshot_rows(ev), tables=("topics", "topic_partitions"))
    rows = _partition_rows(ev)
    early = F.col("captured_at") < F.to_timestamp(F.lit("2024-01-17 00:00:00"))
    refresh_offsets(store, None, rows.filter(early))
    refresh_offsets(store, None, rows.filter(~early))
    return to_ntz(store.read("partition_offsets"), "timestamp", *AUDIT_NTZ)


def _partition_rows(ev: DataFrame) -> DataFrame:
    p = F.col("user_id") % 4
    day = F.date_trunc("day", F.col("ts")) + F.expr("INTERVAL 1 DAY")
    g = ev.groupBy(cluster_of("user_id").alias("k_cluster_id"), "event_type", p.cast("int").alias("partition"),
                   day.alias("captured_at")).agg((F.max("event_id") + 1).alias("o"))
    return g.select("k_cluster_id", F.col("captured_at").cast("timestamp"),
                    F.concat(F.lit("T-"), F.col("event_type")).alias("k_topic_id"), "partition",
                    F.lit("LATEST").alias("offset_type"), F.when(F.col("o") % 11 == 0, -1).otherwise(F.col("o")).alias("offset"),
                    F.lit(-1).cast("bigint").alias("timestamp_ms"),
                    F.when(F.col("partition") != 0, F.col("partition")).alias("leader_epoch"))


@register("stream_merge_equals_batch", fold_sql(
    f"""SELECT {cluster_sql('user_id')} AS k_cluster_id, 'T-' || event_type AS k_topic_id,
               CAST(user_id % 4 AS INTEGER) AS k_partition_id, 'LATEST' AS offset_type,
               max(event_id) + 1 AS "offset", date_trunc('day', ts) + INTERVAL 1 DAY AS captured_at
        FROM events GROUP BY ALL""",
    ["k_cluster_id", "k_topic_id", "k_partition_id", "offset_type"], ["offset"], ["k_cluster_id"],
    "offset_type = 'LATEST'", False))
def stream_merge_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures arrive as files, a stream appends them to a history (file sink, exactly once), and the
    history is folded onto an empty state; the SQL computes the same in one batch."""
    from snaptide.operators.merge import empty_state
    from snaptide.operators.replay import fold
    from snaptide.streaming.refresh_stream import start_capture_history
    root = new_store(spark).root
    ev = _events(spark, sf_dir)
    day = F.date_trunc("day", F.col("ts")) + F.expr("INTERVAL 1 DAY")
    rows = (ev.groupBy(cluster_of("user_id").alias("k_cluster_id"), "event_type",
                       (F.col("user_id") % 4).cast("int").alias("partition"), day.alias("captured_at"))
            .agg((F.max("event_id") + 1).alias("offset"))
            .select("k_cluster_id", F.col("captured_at").cast("timestamp"),
                    F.concat(F.lit("T-"), F.col("event_type")).alias("k_topic_id"), "partition",
                    F.lit("LATEST").alias("offset_type"), "offset", F.lit(-1).cast("bigint").alias("timestamp_ms"),
                    F.lit(None).cast("int").alias("leader_epoch")))
    rows.write.parquet(f"{root}/incoming")
    stream = start_capture_history(spark, f"{root}/incoming", f"{root}/history", f"{root}/checkpoint", available_now=True)
    stream.awaitTermination()
    if stream.exception() is not None:
        raise stream.exception()
    history = (spark.read.schema(PARTITION_OFFSETS).parquet(f"{root}/history")
               .withColumnsRenamed({"captured_at": "refreshed_at", "partition": "k_partition_id"}))
    spec = TABLES["partition_offsets"].__class__(
        name="po", keys=TABLES["partition_offsets"].keys, compare=(("offset", "<=>"),), extra=("velocity",), velocity="LATEST")
    history = history.select(*spec.keys, *spec.attrs, "refreshed_at")
    state = fold(empty_state(spark, spec, like=history), history, spec)
    return to_ntz(state.select(*spec.columns), *AUDIT_NTZ)


# --------------------------------------------------- a backlog of captures --

BACKLOG = 30
_BACKLOG_CAPS = f"""
SELECT {cluster_sql("c_custkey")} AS k_cluster_id, 't' || CAST(c_custkey AS VARCHAR) AS k_topic_id, 0 AS k_partition_id,
       'topic-' || CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 7 < d % 7 THEN '-r' ELSE '' END AS name,
       c_mktsegment = 'BUILDING' AS internal, {sql_ts(T0)} + d * INTERVAL 1 MINUTE AS captured_at
FROM customer, range(1, {BACKLOG + 1}) AS t(d) WHERE (c_custkey + d) % 5 <> 0"""


def _backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty captures of every cluster: a topic is not listed in every fifth one, but always described."""
    cust = Tables(spark, sf_dir).customer.select("c_custkey", "c_mktsegment")
    rows = cust.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(BACKLOG))))
    k, d = F.col("c_custkey"), F.col("d")
    tid, name = F.concat(F.lit("t"), k.cast("string")), F.concat(
        F.lit("topic-"), k.cast("string"), F.when(k % 7 < d % 7, "-r").otherwise(""))
    listed = F.when((k + d) % 5 != 0, 1).otherwise(0)
    topic = F.struct(tid.alias("k_topic_id"), name.alias("name"), (F.col("c_mktsegment") == "BUILDING").alias("internal"))
    part = F.struct(F.lit(0).alias("partition"), F.lit(None).cast("int").alias("leader"),
                    F.array().cast("array<int>").alias("replicas"), F.array().cast("array<int>").alias("isr"))
    described = F.struct(tid.alias("k_topic_id"), name.alias("name"), F.array(part).alias("partitions"))
    return chunk(rows, k_cluster_id=cluster_of("c_custkey"), cluster_name=cluster_of("c_custkey"),
                 captured_at=ts(T0) + F.make_dt_interval(mins=d), controller_id=F.lit(0), nodes=F.array(),
                 topics=F.slice(F.array(topic), F.lit(1), listed), topic_descriptions=F.array(described))


def _backlog_sql() -> str:
    def rows(name: str, keys, attrs) -> str:
        def text(cols):
            return "concat_ws('|', " + ", ".join(f'CAST("{c}" AS VARCHAR)' for c in cols) + ")" if cols else "''"
        return f"""SELECT '{name}' AS table_name, {text(keys)} AS row_key, {text(attrs)} AS row_attrs,
                          discovered_at, modified_at, refreshed_at
                   FROM ({fold_sql(_BACKLOG_CAPS, keys, attrs, ["k_cluster_id"], None, True)})"""

    return " UNION ALL ".join([rows("topics", ["k_cluster_id", "k_topic_id"], ["name", "internal"]),
                               rows("topic_partitions", ["k_cluster_id", "k_topic_id", "k_partition_id"], [])])


@register("refresh_backlog_topics", _backlog_sql())
def refresh_backlog_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4, M6, X1, K3 over a backlog: thirty captures in one call and one version. A partition is described in every
    capture but lives with its topic only: it starts anew whenever the topic comes back."""
    store = new_store(spark)
    refresh_metadata(store, _backlog(spark, sf_dir), tables=("topics", "topic_partitions"))
    return _state_rows(store, ("topics", "topic_partitions"))


@register("refresh_backlog_accounting", f"""
WITH caps AS ({_BACKLOG_CAPS}),
kept AS (SELECT k_cluster_id, k_topic_id FROM caps WHERE captured_at = {sql_ts(T0)} + {BACKLOG} * INTERVAL 1 MINUTE),
n AS (SELECT count(*) AS given, (SELECT count(*) FROM kept) AS kept,
             (SELECT count(*) FROM customer) * {BACKLOG} AS described FROM caps)
SELECT '_captures' AS table_name, 'applied' AS metric, (SELECT count(*) FROM (SELECT DISTINCT k_cluster_id, captured_at FROM caps)) AS value
UNION ALL SELECT 'topics', 'keys', given FROM n UNION ALL SELECT 'topics', 'insert', kept FROM n
UNION ALL SELECT 'topic_partitions', 'submitted', described FROM n UNION ALL SELECT 'topic_partitions', 'keys', given FROM n
UNION ALL SELECT 'topic_partitions', 'unresolved', described - given FROM n
UNION ALL SELECT 'topic_partitions', 'insert', kept FROM n""")
def refresh_backlog_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 / A6 of the same backlog: captures applied, rows given, resolved or not, and the net effect on the state."""
    result = refresh_metadata(new_store(spark), _backlog(spark, sf_dir), tables=("topics", "topic_partitions"))
    return result.accounting.filter("table_name IN ('_captures', 'topics', 'topic_partitions')")


@register("refresh_one_bad_cluster", f"""
WITH a AS (SELECT {cluster_sql("s_suppkey")} AS k_cluster_id, 't' || CAST(s_suppkey AS VARCHAR) AS k_topic_id,
                  s_name AS name, s_suppkey FROM supplier)
SELECT k_cluster_id, k_topic_id, CASE WHEN k_cluster_id = 'c1' THEN name ELSE name || '-2' END AS name, false AS internal,
       {sql_ts(T0)} AS discovered_at, CASE WHEN k_cluster_id = 'c1' THEN {sql_ts(T0)} ELSE {sql_ts(T1)} END AS modified_at,
       CASE WHEN k_cluster_id = 'c1' THEN {sql_ts(T0)} ELSE {sql_ts(T1)} END AS refreshed_at
FROM a WHERE k_cluster_id = 'c1' OR s_suppkey % 4 <> 0""")
def refresh_one_bad_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, Q11: in the second capture all topics of cluster c1 hold one name. It keeps what it had; the two others are
    refreshed, their missing topics removed."""
    sup, store = Tables(spark, sf_dir).supplier.select("s_suppkey", "s_name"), new_store(spark)

    def capture(rows: DataFrame, at: str, name: Column) -> DataFrame:
        topic = F.struct(F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("k_topic_id"), name.alias("name"),
                         F.lit(False).alias("internal"))
        return chunk(rows, k_cluster_id=cluster_of("s_suppkey"), cluster_name=cluster_of("s_suppkey"), captured_at=ts(at),
                     controller_id=F.lit(0), nodes=F.array(), topics=F.array(topic))

    refresh_metadata(store, capture(sup, T0, F.col("s_name")), tables=("topics",))
    second = F.when(F.col("s_suppkey") % 3 == 1, "the same").otherwise(F.concat("s_name", F.lit("-2")))
    refresh_metadata(store, capture(sup.filter("s_suppkey % 4 <> 0"), T1, second), tables=("topics",))
    return to_ntz(store.read("topics"), *AUDIT_NTZ)


@register("refresh_late_chunk", fold_sql(
    _TOPIC_CAPS, ["k_cluster_id", "k_topic_id"], ["name", "internal"], ["k_cluster_id"], None, True))
def refresh_late_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 out of order: the second capture's first chunk comes with the first, third and fourth capture, its second
    chunk afterwards; the result is that of the four captures in order."""
    caps, store = _topic_captures(spark, sf_dir), new_store(spark)
    part = F.pmod(F.xxhash64(F.col("topics")[0]["k_topic_id"]), F.lit(2)).cast("int")
    second = caps[2].withColumns({"chunk_index": part, "chunk_count": F.lit(2)})
    refresh_metadata(store, caps[1].unionByName(second.filter("chunk_index = 0")).unionByName(caps[3]).unionByName(caps[4]),
                     tables=("topics",))
    refresh_metadata(store, second.filter("chunk_index = 1"), tables=("topics",))
    return to_ntz(store.read("topics"), *AUDIT_NTZ)


# ------------------------------------------------------------------- streams --

def _stream_dirs(spark: SparkSession, label: str) -> tuple[str, str, str]:
    root = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    return f"{root}/in", f"{root}/out", f"{root}/checkpoint"


def _finished(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@register("stream_group_events", ORACLES["refresh_group_offsets_partial"])
def stream_group_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits and read marks arrive as one stream, go through its file sink, and a micro-batch of them
    removes the offsets of groups that were read and have none left."""
    ev = _events(spark, sf_dir)
    meta, offs = new_store(spark), new_store(spark)
    refresh_metadata(meta, events_snapshot_rows(ev), tables=("nodes", "topics", "topic_partitions", "consumer_groups"))
    u = F.col("user_id")
    kept = ev.filter((u % 5).isin(1, 2) | ((u % 5 == 3) & (F.col("event_type") == "click")))
    user = F.substring("group_id", 2, 20).cast("bigint")
    commits = _commit_rows(ev, ts(T1)).unionByName(
        _commit_rows(kept, ts(T2)).withColumn("offset", F.col("offset") + user % 5 - 1))
    reads = ev.select(cluster_of("user_id").alias("k_cluster_id"), ts(T2).alias("captured_at"),
                      F.concat(F.lit("g"), u.cast("string")).alias("group_id"), (u % 5 != 4).alias("read")).distinct()
    events = (commits.withColumn("kind", F.lit("commit")).unionByName(reads.withColumn("kind", F.lit("read")),
                                                                      allowMissingColumns=True)
              .select(*GROUP_EVENTS.fieldNames()))
    source, history, checkpoint = _stream_dirs(spark, "group-events")
    events.write.parquet(source)
    _finished(start_capture_history(spark, source, history, checkpoint, schema=GROUP_EVENTS, available_now=True))
    offset_batch(offs.root, kind="group_events", metadata_root=meta.root)(
        spark.read.schema(GROUP_EVENTS).parquet(history), 0)
    return to_ntz(offs.read("consumer_group_offsets"), "offset_timestamp", *AUDIT_NTZ)


@register("stream_offsets_resolved", f"""
SELECT {cluster_sql("user_id")} AS k_cluster_id, 'T-' || event_type AS k_topic_id, CAST(user_id % 4 AS INTEGER) AS k_partition_id,
       'LATEST' AS offset_type, max(event_id) + 1 AS "offset", date_trunc('day', ts) + INTERVAL 1 DAY AS refreshed_at
FROM events WHERE user_id % 4 <> 3 OR event_type = 'click'
GROUP BY user_id % 3, user_id % 4, event_type, date_trunc('day', ts)""")
def stream_offsets_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures of partition offsets joined with the known partitions inside the streaming plan. The
    metadata does not know partition 3 but of one topic."""
    ev, meta = _events(spark, sf_dir), new_store(spark)
    at = F.lit(T0).cast("timestamp")
    known = ev.filter("user_id % 4 <> 3 OR event_type = 'click'").select(
        cluster_of("user_id").alias("k_cluster_id"), F.concat(F.lit("T-"), "event_type").alias("k_topic_id"),
        (F.col("user_id") % 4).cast("int").alias("k_partition_id")).distinct()
    meta.publish({"topic_partitions": known.withColumns({a: at for a in AUDIT_NTZ})})
    day = (F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY")).cast("timestamp")
    caps = (ev.groupBy((F.col("user_id") % 3).alias("c"), (F.col("user_id") % 4).cast("int").alias("partition"), "event_type",
                       day.alias("captured_at")).agg((F.max("event_id") + 1).alias("offset"))
            .select(cluster_of("c").alias("k_cluster_id"), "captured_at", F.concat(F.lit("T-"), "event_type").alias("k_topic_id"),
                    "partition", F.lit("LATEST").alias("offset_type"), "offset", F.lit(-1).cast("bigint").alias("timestamp_ms"),
                    F.lit(None).cast("int").alias("leader_epoch")))
    source, output, checkpoint = _stream_dirs(spark, "resolved")
    caps.write.parquet(source)
    _finished(start_resolved_offsets(spark, source, meta.root, output, checkpoint, available_now=True))
    rows = spark.read.parquet(output).select("k_cluster_id", "k_topic_id", "k_partition_id", "offset_type", "offset", "refreshed_at")
    return to_ntz(rows, "refreshed_at")


# ------------------------------------------------- bad documents, integrity --

@register("quarantine_bad_documents", f"""
SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'malformed' WHEN o_orderkey % 13 = 0 THEN 'incomplete' ELSE 'topic' END AS found,
       CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 THEN {cluster_sql("o_custkey")} END AS k_cluster_id,
       count(*) AS n
FROM orders GROUP BY ALL""")
def quarantine_bad_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document for each order, some cut off in the middle, some without a capture time. The refresh gets
    the others only; the bad ones are kept apart with their reason."""
    orders = Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey", "o_orderpriority")
    k = F.col("o_orderkey")
    name = F.concat(F.lit("t"), k.cast("string"))
    topic = F.struct(name.alias("k_topic_id"), name.alias("name"), F.lit(False).alias("internal"))
    doc = orders.select(k.alias("key"), cluster_of("o_custkey").alias("k_cluster_id"), cluster_of("o_custkey").alias("cluster_name"),
                        F.when(k % 13 != 0, ts(T0)).alias("captured_at"), F.lit(0).alias("controller_id"),
                        F.array().cast(_NODES_OF).alias("nodes"), F.array(topic).alias("topics"))
    text = F.to_json(F.struct(*[c for c in doc.columns if c != "key"]))
    path = _stream_dirs(spark, "documents")[0]
    cut_off = F.when(F.col("key") % 11 == 0, F.expr("substring(t, 1, length(t) div 2)")).otherwise(F.col("t"))
    doc.select("key", text.alias("t")).select(cut_off.alias("value")).write.text(path)
    good, bad = read_checked_snapshots(spark, path)
    store = new_store(spark)
    refresh_metadata(store, good, tables=("topics",))
    topics = store.read("topics").groupBy("k_cluster_id").agg(F.count(F.lit(1)).alias("n"))
    kept = bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return (topics.select(F.lit("topic").alias("found"), "k_cluster_id", "n")
            .unionByName(kept.select(F.col("reason").alias("found"), F.lit(None).cast("string").alias("k_cluster_id"), "n")))


@register("integrity_report", f"""
WITH t AS (SELECT {cluster_sql("o_custkey")} AS k_cluster_id, o_orderkey FROM orders),
l AS (SELECT {cluster_sql("o_custkey")} AS k_cluster_id, l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
twice AS (SELECT k_cluster_id, l_orderkey, l_linenumber FROM l GROUP BY ALL HAVING count(*) > 1)
SELECT k_cluster_id, 'duplicate_key' AS "check", 'topic_partitions' AS table_name, CAST(NULL AS VARCHAR) AS parent, count(*) AS n_keys
FROM twice GROUP BY ALL
UNION ALL SELECT k_cluster_id, 'orphan', 'topic_partitions', 'topics', count(*) FROM l WHERE l_orderkey % 9 = 0 GROUP BY ALL
UNION ALL SELECT k_cluster_id, 'orphan', 'topics', 'clusters', count(*) FROM t WHERE k_cluster_id = 'c2' AND o_orderkey % 9 <> 0 GROUP BY ALL
UNION ALL SELECT k_cluster_id, 'orphan', 'topic_partitions', 'clusters', count(*) FROM l WHERE k_cluster_id = 'c2' GROUP BY ALL""")
def integrity_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13, 1.4: a store with planted faults. Lines as partitions of their orders' topics: repeated line numbers are
    keys held twice; some topics and one cluster are missing."""
    t = Tables(spark, sf_dir)
    at = {a: F.lit(T0).cast("timestamp") for a in AUDIT_NTZ}
    orders = t.orders.select("o_orderkey", cluster_of("o_custkey").alias("k_cluster_id"))
    tid = F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("k_topic_id")
    lines = t.lineitem.select("l_orderkey", "l_linenumber").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    store = new_store(spark)
    store.publish({
        "clusters": orders.select("k_cluster_id").distinct().filter("k_cluster_id <> 'c2'").withColumn("name", F.col("k_cluster_id")).withColumns(at),
        "topics": orders.filter("o_orderkey % 9 <> 0").select("k_cluster_id", tid, tid.alias("name"), F.lit(False).alias("internal")).withColumns(at),
        "topic_partitions": lines.select("k_cluster_id", tid, F.col("l_linenumber").cast("int").alias("k_partition_id")).withColumns(at)})
    return integrity_report(store.read_all())

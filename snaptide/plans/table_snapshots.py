"""Snapshots derived from the given tables, identically in Spark and in SQL.

Two captures of a table are made by arithmetic on its key: A holds the rows
with ``key % 10 <> 0`` at T0, B the rows with ``key % 10 <> 1`` at T1, with some
attributes altered (``key % 7``, ``key % 5``). Every row of the table takes part;
the arithmetic only decides which rows are inserted, updated, touched or
deleted between the two captures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Capture times of the two derived snapshots and the cluster id.
T0 = "2024-02-01 00:00:00"
T1 = "2024-02-02 00:00:00"
CLUSTER = "cluster-0"


def cluster_of(col: str) -> Column:
    """Cluster id derived from a key column, so captures span three clusters
    and every per-cluster join has a real key."""
    return F.concat(F.lit("c"), (F.col(col) % 3).cast("string"))


def cluster_sql(col: str) -> str:
    return f"'c' || CAST({col} % 3 AS VARCHAR)"


def ts(text: str) -> Column:
    """A capture time in the session zone (UTC)."""
    return F.to_timestamp(F.lit(text))


def sql_ts(text: str) -> str:
    return f"TIMESTAMP '{text}'"


def to_ntz(df: DataFrame, *cols: str) -> DataFrame:
    """Timestamps as wall-clock (session zone UTC) values for comparison with SQL."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def in_a(key: Column) -> Column:
    return key % 10 != 0


def in_b(key: Column) -> Column:
    return key % 10 != 1


def topic_snapshot_rows(orders: DataFrame, which: str) -> DataFrame:
    """Snapshot chunk rows (one per order) whose ``topics`` section lists that
    order as a topic. ``which`` is ``"A"`` or ``"B"``."""
    k = F.col("o_orderkey")
    keyname = k.cast("string")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    if which == "A":
        rows = orders.filter(in_a(k))
        name = F.concat(F.lit("topic-"), keyname)
        internal = urgent
        at = ts(T0)
    else:
        rows = orders.filter(in_b(k))
        name = F.concat(F.when(k % 7 == 0, F.lit("renamed-")).otherwise(F.lit("topic-")), keyname)
        internal = urgent != (k % 5 == 0)
        at = ts(T1)
    topic = F.struct(F.concat(F.lit("t"), keyname).alias("k_topic_id"), name.alias("name"),
                     internal.alias("internal"))
    return rows.select(cluster_of("o_custkey").alias("k_cluster_id"), cluster_of("o_custkey").alias("cluster_name"),
                       at.alias("captured_at"), F.lit(0).alias("controller_id"),
                       F.array().cast("array<struct<id:int,host:string,port:int,rack:string>>").alias("nodes"),
                       F.array(topic).alias("topics"))


TOPICS_SQL = {
    "A": f"""SELECT {cluster_sql("o_custkey")} AS k_cluster_id, 't' || CAST(o_orderkey AS VARCHAR) AS k_topic_id,
                    'topic-' || CAST(o_orderkey AS VARCHAR) AS name,
                    o_orderpriority = '1-URGENT' AS internal
             FROM orders WHERE o_orderkey % 10 <> 0""",
    "B": f"""SELECT {cluster_sql("o_custkey")} AS k_cluster_id, 't' || CAST(o_orderkey AS VARCHAR) AS k_topic_id,
                    CASE WHEN o_orderkey % 7 = 0 THEN 'renamed-' ELSE 'topic-' END
                      || CAST(o_orderkey AS VARCHAR) AS name,
                    (o_orderpriority = '1-URGENT') <> (o_orderkey % 5 = 0) AS internal
             FROM orders WHERE o_orderkey % 10 <> 1""",
}


def two_snapshot_merge_sql(a_sql: str, b_sql: str, keys, compare, delete: str | None,
                           t0: str = T0, t1: str = T1, scope_sql: str | None = None,
                           velocity: str | None = None) -> str:
    """SQL restatement of merging capture B (at t1) into the state built from
    capture A (at t0): full outer join on the key and CASE per clause.

    ``compare``: (column, op) with op ``=`` or ``<=>``. ``delete``: None (keep
    rows missing from B) or ``"scope"`` (delete them when their cluster appears
    in ``scope_sql``, default: the clusters of B)."""
    on = " AND ".join(f'a."{k}" = b."{k}"' for k in keys)
    key_sel = ", ".join(f'coalesce(a."{k}", b."{k}") AS "{k}"' for k in keys)
    attrs = [c for c, _ in compare]
    attr_sel = "".join(f', a."{c}" AS a_{c}, b."{c}" AS b_{c}' for c in attrs)
    same = " AND ".join(
        (f"a_{c} IS NOT DISTINCT FROM b_{c}" if op == "<=>" else f"coalesce(a_{c} = b_{c}, false)")
        for c, op in compare) or "true"
    scope_sql = scope_sql or "SELECT DISTINCT k_cluster_id FROM b"
    if delete:
        stale = "k_cluster_id IN (SELECT k_cluster_id FROM scope)"
    else:
        stale = "false"
    out_attrs = "".join(
        f""", CASE WHEN action IN ('insert','update') THEN b_{c} ELSE a_{c} END AS "{c}\"""" for c in attrs)
    T0s, T1s = sql_ts(t0), sql_ts(t1)
    if velocity:
        applies = "true" if velocity == "all" else f"offset_type = '{velocity}'"
        secs = f"nullif(CAST(date_diff('microsecond', {T0s}, {T1s}) AS DOUBLE) / 1e6, 0)"
        out_attrs += (f""",
       CASE WHEN action = 'touch' THEN CASE WHEN {applies} THEN 0.0 END
            WHEN action = 'update' THEN CASE WHEN {applies} THEN CAST(b_offset - a_offset AS DOUBLE) / {secs} END
            ELSE CAST(NULL AS DOUBLE) END AS velocity""")
    return f"""
WITH a AS ({a_sql}),
b AS ({b_sql}),
scope AS ({scope_sql}),
j AS (SELECT {key_sel}{attr_sel},
             a."{keys[-1]}" IS NOT NULL AS in_a, b."{keys[-1]}" IS NOT NULL AS in_b
      FROM a FULL OUTER JOIN b ON {on}),
k AS (SELECT *, CASE WHEN in_a AND in_b AND {same} THEN 'touch'
                     WHEN in_a AND in_b THEN 'update'
                     WHEN in_b THEN 'insert'
                     WHEN {stale} THEN 'delete'
                     ELSE 'keep' END AS action
      FROM j)
SELECT {", ".join(f'"{k}"' for k in keys)}{out_attrs},
       CASE WHEN action = 'insert' THEN {T1s} ELSE {T0s} END AS discovered_at,
       CASE WHEN action IN ('insert', 'update') THEN {T1s} ELSE {T0s} END AS modified_at,
       CASE WHEN action IN ('insert', 'update', 'touch') THEN {T1s} ELSE {T0s} END AS refreshed_at,
       action
FROM k"""


def replica_snapshot_rows(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Snapshot chunk rows, one per order line: the order is a topic, the line
    a partition with two replicas (supplier and part as node ids), and the
    supplier's log dir holds a copy. Chunks of one capture share
    (k_cluster_id, captured_at); no row holds more than one line."""
    li = lineitem.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    sup = F.col("l_suppkey").cast("int")
    prt = F.col("l_partkey").cast("int")
    name = F.concat(F.lit("topic-"), F.col("l_orderkey").cast("string"))
    part = F.struct(F.col("l_linenumber").alias("partition"),
                    F.when(F.col("l_returnflag") == "N", F.lit(None).cast("int")).otherwise(sup).alias("leader"),
                    F.array(sup, prt).alias("replicas"),
                    F.when(F.col("l_linestatus") == "O", F.array(sup)).otherwise(F.array(prt)).alias("isr"))
    topic = F.struct(F.concat(F.lit("t"), F.col("l_orderkey").cast("string")).alias("k_topic_id"),
                     name.alias("name"), F.array(part).alias("partitions"))
    rep = F.struct(name.alias("topic"), F.col("l_linenumber").alias("partition"), F.col("l_partkey").alias("size"),
                   (F.col("l_linenumber").cast("bigint") * 10).alias("offset_lag"),
                   (F.col("l_returnflag") == "A").alias("future"))
    ldir = F.struct(sup.alias("node_id"), F.concat(F.lit("dir-"), F.col("l_linestatus")).alias("path"),
                    F.array(rep).alias("replicas"))
    return li.select(F.lit(CLUSTER).alias("k_cluster_id"), F.lit(CLUSTER).alias("cluster_name"),
                     ts(T0).alias("captured_at"), F.lit(0).alias("controller_id"),
                     F.array(topic).alias("topic_descriptions"), F.array(ldir).alias("log_dirs"))


REPLICAS_SQL = f"""
WITH li AS (SELECT l.* FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey),
p AS (SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS INTEGER) AS s, CAST(l_partkey AS INTEGER) AS pk,
             CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_suppkey AS INTEGER) END AS leader_id,
             CASE WHEN l_linestatus = 'O' THEN [CAST(l_suppkey AS INTEGER)] ELSE [CAST(l_partkey AS INTEGER)] END AS isr
      FROM li),
reps AS (SELECT l_orderkey, l_linenumber, s AS node, leader_id, isr FROM p
         UNION ALL SELECT l_orderkey, l_linenumber, pk AS node, leader_id, isr FROM p),
dirs AS (SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS INTEGER) AS node, 'dir-' || l_linestatus AS path,
                l_partkey AS size, CAST(l_linenumber AS BIGINT) * 10 AS offset_lag, l_returnflag = 'A' AS future
         FROM li),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, node
                                                      ORDER BY future, path, size, offset_lag) AS rn FROM dirs)
          WHERE rn = 1)
SELECT '{CLUSTER}' AS k_cluster_id, 't' || CAST(r.l_orderkey AS VARCHAR) AS k_topic_id,
       r.l_linenumber AS k_partition_id, r.node AS k_node_id,
       coalesce(r.node = r.leader_id, false) AS leader, list_contains(r.isr, r.node) AS in_sync,
       f.size, f.offset_lag, f.future
FROM reps r LEFT JOIN first f ON f.l_orderkey = r.l_orderkey AND f.l_linenumber = r.l_linenumber AND f.node = r.node
"""


def chunk(df: DataFrame, **sections: Column) -> DataFrame:
    """Rows of the SNAPSHOT schema: the given columns, every other section NULL."""
    from snaptide.schemas import SNAPSHOT, relaxed
    made = df.select(*[c.alias(n) for n, c in sections.items() if c is not None]).schema
    cols = []
    for f in SNAPSHOT.fields:
        c, to = sections.get(f.name), relaxed(f.dataType)
        if c is None:
            c = F.lit(None).cast(to)
        elif relaxed(made[f.name].dataType) != to:  # a cast takes nested values apart, even where nothing changes
            c = c.cast(to)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def region_snapshot_rows(t) -> DataFrame:
    """One capture per region (the cluster), split into chunk rows: one per
    supplier (node + its config), per order (topic, its config, the
    customer's group with the order as member) and per line (partition with
    two replicas, the member's assignment, an ACL binding). The quorum of a
    region lists its nations' keys as voters."""
    nation = t.nation.select("n_nationkey", "n_regionkey", "n_name")
    region = t.region.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("k_cluster_id"))
    quorum = (nation.groupBy("n_regionkey")
              .agg(F.min("n_nationkey").alias("leader_id"), F.sort_array(F.collect_list("n_nationkey")).alias("voters")))
    meta = region.join(quorum, "n_regionkey").select(
        "n_regionkey", "k_cluster_id",
        F.struct("leader_id", "voters", F.array().cast("array<int>").alias("observers")).alias("quorum"),
        F.col("leader_id").alias("controller_id"))
    base = dict(cluster_name=F.col("k_cluster_id"), captured_at=ts(T0), controller_id=F.col("controller_id"),
                quorum=F.col("quorum"), k_cluster_id=F.col("k_cluster_id"))
    nodes_of = F.array().cast("array<struct<id:int,host:string,port:int,rack:string>>")

    sup = (t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
           .join(nation.withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey").join(meta, "n_regionkey"))
    sid = F.col("s_suppkey").cast("int")
    entry = F.struct(F.lit("acctbal").alias("name"), F.col("s_acctbal").cast("string").alias("value"),
                     F.lit("DYNAMIC_BROKER_CONFIG").alias("source"), F.lit(False).alias("sensitive"),
                     F.lit(False).alias("read_only"), F.lit("DOUBLE").alias("type"),
                     F.lit(None).cast("string").alias("documentation"))
    sup_rows = chunk(sup, **base,
                     nodes=F.array(F.struct(sid.alias("id"), F.col("s_name").alias("host"), F.lit(9092).alias("port"),
                                            F.col("n_name").alias("rack"))),
                     node_configs=F.array(F.struct(sid.alias("node_id"), F.array(entry).alias("entries"))))

    cust = (t.customer.select("c_custkey", "c_nationkey")
            .join(nation.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey"))
    orders = (t.orders.select("o_orderkey", "o_custkey", "o_orderpriority")
              .join(cust.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").join(meta, "n_regionkey"))
    tid = F.concat(F.lit("t"), F.col("o_orderkey").cast("string"))
    tname = F.concat(F.lit("topic-"), F.col("o_orderkey").cast("string"))
    tentry = F.struct(F.lit("priority").alias("name"), F.col("o_orderpriority").alias("value"),
                      F.lit("DYNAMIC_TOPIC_CONFIG").alias("source"), F.lit(False).alias("sensitive"),
                      F.lit(False).alias("read_only"), F.lit("STRING").alias("type"),
                      F.lit(None).cast("string").alias("documentation"))

    def group(assignments):
        member = F.struct(F.concat(F.lit("m"), F.col("o_orderkey").cast("string")).alias("member_id"),
                          F.lit(None).cast("string").alias("group_instance_id"),
                          F.lit("client").alias("client_id"), F.lit("host").alias("host"),
                          assignments.alias("assignments"))
        return F.array(F.struct(F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("group_id"),
                                F.lit(False).alias("simple"), F.lit("STABLE").alias("state"),
                                F.lit("range").alias("partition_assignor"),
                                F.col("controller_id").alias("coordinator_id"), F.array(member).alias("members")))

    order_rows = chunk(orders, **base, nodes=nodes_of,
                       topics=F.array(F.struct(tid.alias("k_topic_id"), tname.alias("name"),
                                               F.lit(False).alias("internal"))),
                       topic_configs=F.array(F.struct(tid.alias("k_topic_id"), F.array(tentry).alias("entries"))),
                       consumer_groups=group(F.array().cast("array<struct<topic:string,partition:int>>")))

    lines = (t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus")
             .join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderkey", "o_custkey",
                                 "k_cluster_id", "quorum", "controller_id"), "l_orderkey"))
    part = F.struct(F.col("l_linenumber").alias("partition"), F.col("l_suppkey").cast("int").alias("leader"),
                    F.array(F.col("l_suppkey").cast("int"), F.col("l_partkey").cast("int")).alias("replicas"),
                    F.array(F.col("l_suppkey").cast("int")).alias("isr"))
    binding = F.struct(F.lit("TOPIC").alias("resource_type"),
                       F.concat(F.lit("topic-"), F.col("l_returnflag")).alias("name"),
                       F.lit("LITERAL").alias("pattern_type"),
                       F.concat(F.lit("User:"), F.col("l_linestatus")).alias("principal"), F.lit("*").alias("host"),
                       F.lit("READ").alias("operation"), F.lit("ALLOW").alias("permission_type"))
    line_rows = chunk(lines, **base, nodes=nodes_of,
                      topic_descriptions=F.array(F.struct(tid.alias("k_topic_id"), tname.alias("name"),
                                                          F.array(part).alias("partitions"))),
                      consumer_groups=group(F.array(F.struct(tname.alias("topic"),
                                                             F.col("l_linenumber").alias("partition")))),
                      acl_bindings=F.array(binding))
    return sup_rows.unionByName(order_rows).unionByName(line_rows)


REPORT_SQL = f"""
WITH reg AS (SELECT n.n_nationkey, r.r_name AS k_cluster_id FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey),
sup AS (SELECT s.s_suppkey, reg.* FROM supplier s JOIN reg ON reg.n_nationkey = s.s_nationkey),
ord AS (SELECT o.o_orderkey, o.o_custkey, reg.k_cluster_id FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
        JOIN reg ON reg.n_nationkey = c.c_nationkey),
lin AS (SELECT l.*, ord.k_cluster_id FROM lineitem l JOIN ord ON ord.o_orderkey = l.l_orderkey),
miss AS (SELECT reg.k_cluster_id, reg.n_nationkey FROM reg
         WHERE NOT EXISTS (SELECT 1 FROM sup WHERE sup.k_cluster_id = reg.k_cluster_id
                                                AND sup.s_suppkey = reg.n_nationkey)),
counts AS (
  SELECT k_cluster_id, 'Nodes' AS metric, count(DISTINCT s_suppkey) AS value FROM sup GROUP BY 1
  UNION ALL SELECT k_cluster_id, 'Nodes (missing)', count(DISTINCT n_nationkey) FROM miss GROUP BY 1
  UNION ALL SELECT k_cluster_id, 'Node Configs', count(DISTINCT s_suppkey) FROM sup GROUP BY 1
  UNION ALL SELECT k_cluster_id, 'Topics', count(DISTINCT o_orderkey) FROM ord GROUP BY 1
  UNION ALL SELECT k_cluster_id, 'Topic Configs', count(DISTINCT o_orderkey) FROM ord GROUP BY 1
  UNION ALL SELECT k_cluster_id, 'Partitions', count(DISTINCT (l_orderkey, l_linenumber)) FROM lin GROUP BY 1
  UNION ALL SELECT k_cluster_id, 'Replicas', count(*) FROM (
      SELECT DISTINCT k_cluster_id, l_orderkey, l_linenumber, l_suppkey AS node FROM lin
      UNION SELECT DISTINCT k_cluster_id, l_orderkey, l_linenumber, l_partkey FROM lin) GROUP BY 1
  UNION ALL SELECT k_cluster_id, 'Consumer Groups', count(DISTINCT o_custkey) FROM ord GROUP BY 1
  UNION ALL SELECT k_cluster_id, 'Consumer Group Members', count(DISTINCT o_orderkey) FROM ord GROUP BY 1
  UNION ALL SELECT k_cluster_id, 'Consumer Group Assignments', count(DISTINCT (l_orderkey, l_linenumber)) FROM lin GROUP BY 1
  UNION ALL SELECT k_cluster_id, 'ACL Resources', count(DISTINCT l_returnflag) FROM lin GROUP BY 1
  UNION ALL SELECT k_cluster_id, 'ACL Entries', count(DISTINCT l_linestatus) FROM lin GROUP BY 1),
grid AS (SELECT r_name AS k_cluster_id, m.metric FROM region, (VALUES ('Nodes'), ('Nodes (missing)'), ('Node Configs'),
           ('Topics'), ('Topic Configs'), ('Partitions'), ('Replicas'), ('Consumer Groups'),
           ('Consumer Group Members'), ('Consumer Group Assignments'), ('ACL Resources'), ('ACL Entries')) m(metric))
SELECT g.k_cluster_id, {sql_ts(T0)} AS refreshed_at, g.metric, CAST(coalesce(c.value, 0) AS BIGINT) AS value
FROM grid g LEFT JOIN counts c ON c.k_cluster_id = g.k_cluster_id AND c.metric = g.metric
"""


def events_snapshot_rows(events: DataFrame) -> DataFrame:
    """Metadata captures derived from events, as chunk rows: cluster
    ``'c' || user_id % 3`` with one broker (node 0); a topic per event type
    with the partitions (``user_id % 4``) that hold its events; a consumer
    group per user, coordinated by node 0."""
    ev = events.select(cluster_of("user_id").alias("k_cluster_id"), "event_type",
                       (F.col("user_id") % 4).cast("int").alias("p"), "user_id")
    base = dict(cluster_name=F.col("k_cluster_id"), captured_at=ts(T0), controller_id=F.lit(0),
                k_cluster_id=F.col("k_cluster_id"))
    nodes_of = F.array().cast("array<struct<id:int,host:string,port:int,rack:string>>")
    node_rows = chunk(ev.select("k_cluster_id").distinct(), **base,
                      nodes=F.array(F.struct(F.lit(0).alias("id"), F.lit("broker-0").alias("host"),
                                             F.lit(9092).alias("port"), F.lit(None).cast("string").alias("rack"))))
    tid = F.concat(F.lit("T-"), F.col("event_type"))
    topic_rows = chunk(ev.select("k_cluster_id", "event_type").distinct(), **base, nodes=nodes_of,
                       topics=F.array(F.struct(tid.alias("k_topic_id"), F.col("event_type").alias("name"),
                                               F.lit(False).alias("internal"))))
    part = F.struct(F.col("p").alias("partition"), F.lit(0).alias("leader"), F.array(F.lit(0)).alias("replicas"),
                    F.array(F.lit(0)).alias("isr"))
    part_rows = chunk(ev.select("k_cluster_id", "event_type", "p").distinct(), **base, nodes=nodes_of,
                      topic_descriptions=F.array(F.struct(tid.alias("k_topic_id"), F.col("event_type").alias("name"),
                                                          F.array(part).alias("partitions"))))
    group = F.struct(F.concat(F.lit("g"), F.col("user_id").cast("string")).alias("group_id"),
                     F.lit(False).alias("simple"), F.lit("STABLE").alias("state"),
                     F.lit("range").alias("partition_assignor"), F.lit(0).alias("coordinator_id"),
                     F.array().cast("array<struct<member_id:string,group_instance_id:string,client_id:string,"
                                    "host:string,assignments:array<struct<topic:string,partition:int>>>>")
                     .alias("members"))
    group_rows = chunk(ev.select("k_cluster_id", "user_id").distinct(), **base, nodes=nodes_of,
                       consumer_groups=F.array(group))
    return node_rows.unionByName(topic_rows).unionByName(part_rows).unionByName(group_rows)

"""Flatten nested snapshots into merge sources.

A snapshot is one row per cluster per refresh, or, for large clusters, several
chunk rows sharing ``(k_cluster_id, captured_at)`` that each carry part of the
arrays (cluster-level scalars such as ``controller_id`` and ``quorum`` repeated).
Every function here explodes row by row and resolves cross-section references
with set-wise joins, so both layouts give the same rows and no task ever needs
a whole cluster.

Outputs use the state-table column names and carry ``refreshed_at`` (the
capture time), ready for ``merge_snapshot``. ``explode`` (not ``explode_outer``)
is used throughout: an empty or unread collection emits no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaptide.functions.scalars import in_list
from snaptide.operators import nodes as nodes_op
from snaptide.operators.joins import existing, lookup, sorting
from snaptide.operators.merge import reduce_duplicates

SNAP_KEY = ["k_cluster_id", "refreshed_at"]


def _base(snap: DataFrame, *cols) -> DataFrame:
    return snap.select("k_cluster_id", F.col("captured_at").alias("refreshed_at"), *cols)


def _with(snap: DataFrame, section: str) -> DataFrame:
    """Rows whose ``section`` has elements. Changes no result (``explode``
    drops empty and NULL arrays) but lets Catalyst prune inputs: pushed
    through a union of chunk kinds, it folds to false where a section is a
    literal empty or NULL array, and that branch is never computed."""
    return snap.filter(F.size(F.col(section)) > 0)


def section_scope(snap: DataFrame, section: str | None) -> DataFrame:
    """(k_cluster_id, refreshed_at) of snapshots that read ``section``.

    A NULL section means "not read": stale delete is skipped for it, so a
    failed partial read never looks like an empty one."""
    rows = snap if section is None else snap.filter(F.col(section).isNotNull())
    return rows.select("k_cluster_id", F.col("captured_at").alias("refreshed_at")).distinct()


def clusters(snap: DataFrame) -> DataFrame:
    return _base(snap, F.col("cluster_name").alias("name")).distinct()


def live_nodes(snap: DataFrame) -> DataFrame:
    """one row per live node."""
    return (_base(_with(snap, "nodes"), F.explode("nodes").alias("n"))
            .select(*SNAP_KEY, F.col("n.id").alias("k_node_id"), F.col("n.host").alias("host"),
                    F.col("n.port").alias("port"), F.col("n.rack").alias("rack")))


def _quorum_members(snap: DataFrame, field: str) -> DataFrame:
    return (_base(snap, F.col("quorum").getField(field).alias("ids")).filter(F.col("ids").isNotNull())
            .select(*SNAP_KEY, F.explode("ids").alias("k_node_id")).distinct())


def quorum_ids(snap: DataFrame) -> DataFrame:
    """Distinct replica ids among quorum voters and observers."""
    return _quorum_members(snap, "voters").unionByName(_quorum_members(snap, "observers")).distinct()


def missing_nodes(snap: DataFrame) -> DataFrame:
    """J12 + P12: quorum members that are not live nodes, as placeholder rows."""
    return nodes_op.missing_nodes(quorum_ids(snap), live_nodes(snap), SNAP_KEY)


def all_nodes(snap: DataFrame) -> DataFrame:
    """U1 + P1 + P2: live nodes and missing quorum members with controller and
    quorum flags (flags NULL when the cluster reports no quorum)."""
    # the chunks of a capture repeat it: told apart by hash first (the count keeps Spark from merging both steps into one
    # that sorts all rows)
    meta = _base(snap, "controller_id", F.col("quorum.leader_id").alias("leader_id"))
    meta = meta.groupBy(*meta.columns).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 0").drop("_rows")
    meta = reduce_duplicates(meta, SNAP_KEY)
    return nodes_op.all_nodes(live_nodes(snap), meta, _quorum_members(snap, "voters"),
                              _quorum_members(snap, "observers"), SNAP_KEY)


def _config_cols(prefix: str = "e"):
    return [F.col(f"{prefix}.{c}").alias(c) for c in
            ("name", "value", "source", "sensitive", "read_only", "type", "documentation")]


def node_configs(snap: DataFrame) -> DataFrame:
    """F2 + J11: config entries of live nodes only (semi join on capture and
    node id)."""
    rows = (_base(_with(snap, "node_configs"), F.explode("node_configs").alias("nc"))
            .select(*SNAP_KEY, F.col("nc.node_id").alias("k_node_id"), F.explode("nc.entries").alias("e"))
            .select(*SNAP_KEY, "k_node_id", *_config_cols()))
    return existing(rows, live_nodes(snap), SNAP_KEY + ["k_node_id"])


def topics(snap: DataFrame) -> DataFrame:
    """topic listings."""
    return (_base(_with(snap, "topics"), F.explode("topics").alias("t"))
            .select(*SNAP_KEY, F.col("t.k_topic_id").alias("k_topic_id"), F.col("t.name").alias("name"),
                    F.col("t.internal").alias("internal")))


def topic_configs(snap: DataFrame) -> DataFrame:
    """config entries per topic."""
    return (_base(_with(snap, "topic_configs"), F.explode("topic_configs").alias("tc"))
            .select(*SNAP_KEY, F.col("tc.k_topic_id").alias("k_topic_id"), F.explode("tc.entries").alias("e"))
            .select(*SNAP_KEY, "k_topic_id", *_config_cols()))


def partitions(snap: DataFrame) -> DataFrame:
    """One row per (topic, partition) with its leader, replica and ISR lists."""
    return (_base(_with(snap, "topic_descriptions"), F.explode("topic_descriptions").alias("td"))
            .select(*SNAP_KEY, F.col("td.k_topic_id").alias("k_topic_id"), F.col("td.name").alias("topic"),
                    F.explode("td.partitions").alias("p"))
            .select(*SNAP_KEY, "k_topic_id", "topic", F.col("p.partition").alias("k_partition_id"),
                    F.col("p.leader").alias("leader_id"), F.col("p.replicas").alias("replica_ids"),
                    F.col("p.isr").alias("isr")))


def log_dir_replicas(snap: DataFrame) -> DataFrame:
    """Replica entries of every log dir: (node, path, topic name, partition, size, lag, future)."""
    return (_base(_with(snap, "log_dirs"), F.explode("log_dirs").alias("d"))
            .select(*SNAP_KEY, F.col("d.node_id").alias("k_node_id"), F.col("d.path").alias("path"),
                    F.explode("d.replicas").alias("r"))
            .select(*SNAP_KEY, "k_node_id", "path", F.col("r.topic").alias("topic"),
                    F.col("r.partition").alias("k_partition_id"), F.col("r.size").alias("size"),
                    F.col("r.offset_lag").alias("offset_lag"), F.col("r.future").alias("future")))


def first_log_dir(dirs: DataFrame, keys) -> DataFrame:
    """L1 / Q6: one log-dir entry per key, deterministic: a current (non-future)
    copy first, then the smallest dir path. A grouped ``min`` of a struct, of
    entries dealt out by the key first: few are of one replica, so nothing is
    combined before, and one sort serves this and the join by the same key."""
    keys = sorting(keys)
    dirs = dirs.repartition(*keys)
    packed = F.struct(F.coalesce(F.col("future"), F.lit(False)).alias("_f"), F.col("path").alias("_p"),
                      "size", "offset_lag", "future")
    return (dirs.groupBy(*keys).agg(F.min(packed).alias("_d"))
            .select(*keys, *[F.col("_d").getField(c).alias(c) for c in ("size", "offset_lag", "future")]))


def replicas(snap: DataFrame) -> DataFrame:
    """F6 + P3 + P4 + P5 (J13): one row per replica with leader / in-sync flags
    and size, lag and future from the log dir that holds it (NULL if none)."""
    parts = partitions(snap)
    reps = parts.select(*SNAP_KEY, "k_topic_id", "topic", "k_partition_id", "leader_id", "isr",
                        F.explode("replica_ids").alias("k_node_id"))
    reps = reps.select(*SNAP_KEY, "k_topic_id", "topic", "k_partition_id", "k_node_id",
                       F.coalesce(F.col("k_node_id") == F.col("leader_id"), F.lit(False)).alias("leader"),
                       in_list(F.col("isr"), F.col("k_node_id")).alias("in_sync"))
    dkeys = SNAP_KEY + ["k_node_id", "topic", "k_partition_id"]
    dirs = first_log_dir(log_dir_replicas(snap), dkeys)
    return (lookup(reps, dirs, dkeys, "left")
            .select(*SNAP_KEY, "k_topic_id", "k_partition_id", "k_node_id", "leader", "in_sync",
                    "size", "offset_lag", "future"))


def consumer_groups(snap: DataFrame) -> DataFrame:
    """F7."""
    return (_base(_with(snap, "consumer_groups"), F.explode("consumer_groups").alias("g"))
            .select(*SNAP_KEY, F.col("g.group_id").alias("group_id"),
                    F.col("g.coordinator_id").alias("coordinator_id"), F.col("g.simple").alias("simple"),
                    F.col("g.state").alias("state"), F.col("g.partition_assignor").alias("partition_assignor")))


def group_members(snap: DataFrame) -> DataFrame:
    """F8."""
    return (_base(_with(snap, "consumer_groups"), F.explode("consumer_groups").alias("g"))
            .select(*SNAP_KEY, F.col("g.group_id").alias("group_id"), F.explode("g.members").alias("m"))
            .select(*SNAP_KEY, "group_id", F.col("m.member_id").alias("member_id"),
                    F.col("m.group_instance_id").alias("group_instance_id"),
                    F.col("m.client_id").alias("client_id"), F.col("m.host").alias("host")))


def member_assignments(snap: DataFrame) -> DataFrame:
    """(group, member, topic name, partition)."""
    return (_base(_with(snap, "consumer_groups"), F.explode("consumer_groups").alias("g"))
            .select(*SNAP_KEY, F.col("g.group_id").alias("group_id"), F.explode("g.members").alias("m"))
            .select(*SNAP_KEY, "group_id", F.col("m.member_id").alias("member_id"),
                    F.explode("m.assignments").alias("a"))
            .select(*SNAP_KEY, "group_id", "member_id", F.col("a.topic").alias("topic"),
                    F.col("a.partition").alias("k_partition_id")))


def acl_bindings(snap: DataFrame) -> DataFrame:
    """one row per binding (resource pattern + entry)."""
    return (_base(_with(snap, "acl_bindings"), F.explode("acl_bindings").alias("b"))
            .select(*SNAP_KEY, F.col("b.resource_type").alias("resource_type"),
                    F.col("b.name").alias("resource_name"), F.col("b.pattern_type").alias("pattern_type"),
                    F.col("b.principal").alias("principal"), F.col("b.host").alias("host"),
                    F.col("b.operation").alias("operation"), F.col("b.permission_type").alias("permission_type")))


def acl_resources(snap: DataFrame) -> DataFrame:
    """Distinct resource patterns."""
    return (acl_bindings(snap)
            .select(*SNAP_KEY, "resource_type", F.col("resource_name").alias("name"), "pattern_type")
            .distinct())


def acl_entries(snap: DataFrame) -> DataFrame:
    """Distinct access-control entries."""
    return acl_bindings(snap).select(*SNAP_KEY, "principal", "host", "operation", "permission_type").distinct()

"""Declared schemas: the nested snapshot, the flat offset captures, the record
log and the fifteen current-state tables.

Nothing is inferred. Natural keys replace the surrogate ids of a relational
store: every child table carries its parents' natural key columns, and every key
starts with ``k_cluster_id`` so one job handles all clusters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---------------------------------------------------------------- snapshot ---

CONFIG_ENTRY = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("value", T.StringType(), True),
    T.StructField("source", T.StringType(), False),
    T.StructField("sensitive", T.BooleanType(), False),
    T.StructField("read_only", T.BooleanType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("documentation", T.StringType(), True),
])

NODE = T.StructType([
    T.StructField("id", T.IntegerType(), False),
    T.StructField("host", T.StringType(), True),
    T.StructField("port", T.IntegerType(), True),
    T.StructField("rack", T.StringType(), True),
])

QUORUM = T.StructType([
    T.StructField("leader_id", T.IntegerType(), False),
    T.StructField("voters", T.ArrayType(T.IntegerType(), False), True),
    T.StructField("observers", T.ArrayType(T.IntegerType(), False), True),
])

NODE_CONFIGS = T.StructType([
    T.StructField("node_id", T.IntegerType(), False),
    T.StructField("entries", T.ArrayType(CONFIG_ENTRY, False), True),
])

LOG_DIR_REPLICA = T.StructType([
    T.StructField("topic", T.StringType(), False),
    T.StructField("partition", T.IntegerType(), False),
    T.StructField("size", T.LongType(), True),
    T.StructField("offset_lag", T.LongType(), True),
    T.StructField("future", T.BooleanType(), True),
])

LOG_DIR = T.StructType([
    T.StructField("node_id", T.IntegerType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("replicas", T.ArrayType(LOG_DIR_REPLICA, False), True),
])

TOPIC = T.StructType([
    T.StructField("k_topic_id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("internal", T.BooleanType(), False),
])

TOPIC_CONFIGS = T.StructType([
    T.StructField("k_topic_id", T.StringType(), False),
    T.StructField("entries", T.ArrayType(CONFIG_ENTRY, False), True),
])

PARTITION = T.StructType([
    T.StructField("partition", T.IntegerType(), False),
    T.StructField("leader", T.IntegerType(), True),
    T.StructField("replicas", T.ArrayType(T.IntegerType(), False), True),
    T.StructField("isr", T.ArrayType(T.IntegerType(), False), True),
])

TOPIC_DESCRIPTION = T.StructType([
    T.StructField("k_topic_id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("partitions", T.ArrayType(PARTITION, False), True),
])

ASSIGNMENT = T.StructType([
    T.StructField("topic", T.StringType(), False),
    T.StructField("partition", T.IntegerType(), False),
])

MEMBER = T.StructType([
    T.StructField("member_id", T.StringType(), False),
    T.StructField("group_instance_id", T.StringType(), True),
    T.StructField("client_id", T.StringType(), True),
    T.StructField("host", T.StringType(), True),
    T.StructField("assignments", T.ArrayType(ASSIGNMENT, False), True),
])

CONSUMER_GROUP = T.StructType([
    T.StructField("group_id", T.StringType(), False),
    T.StructField("simple", T.BooleanType(), False),
    T.StructField("state", T.StringType(), False),
    T.StructField("partition_assignor", T.StringType(), True),
    T.StructField("coordinator_id", T.IntegerType(), False),
    T.StructField("members", T.ArrayType(MEMBER, False), True),
])

ACL_BINDING = T.StructType([
    T.StructField("resource_type", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("pattern_type", T.StringType(), False),
    T.StructField("principal", T.StringType(), False),
    T.StructField("host", T.StringType(), False),
    T.StructField("operation", T.StringType(), False),
    T.StructField("permission_type", T.StringType(), False),
])

# One row per cluster per refresh. A NULL section means "not read" (the stale
# delete of the tables fed by it is skipped); an empty array means "read, empty".
SNAPSHOT = T.StructType([
    T.StructField("k_cluster_id", T.StringType(), False),
    T.StructField("cluster_name", T.StringType(), False),
    T.StructField("captured_at", T.TimestampType(), False),
    T.StructField("controller_id", T.IntegerType(), False),
    T.StructField("nodes", T.ArrayType(NODE, False), False),
    T.StructField("quorum", QUORUM, True),
    T.StructField("node_configs", T.ArrayType(NODE_CONFIGS, False), True),
    T.StructField("log_dirs", T.ArrayType(LOG_DIR, False), True),
    T.StructField("topics", T.ArrayType(TOPIC, False), True),
    T.StructField("topic_configs", T.ArrayType(TOPIC_CONFIGS, False), True),
    T.StructField("topic_descriptions", T.ArrayType(TOPIC_DESCRIPTION, False), True),
    T.StructField("consumer_groups", T.ArrayType(CONSUMER_GROUP, False), True),
    T.StructField("acl_bindings", T.ArrayType(ACL_BINDING, False), True),
    # A capture of a large cluster may come as several chunk rows, in one input or in several: chunk_index runs
    # from 0 to chunk_count - 1, and nothing of it is applied before all are there. NULL: the rows of the
    # capture in this input are all of it.
    T.StructField("chunk_index", T.IntegerType(), True),
    T.StructField("chunk_count", T.IntegerType(), True),
])

# ------------------------------------------------------------ flat captures ---

GROUP_OFFSETS = T.StructType([
    T.StructField("k_cluster_id", T.StringType(), False),
    T.StructField("captured_at", T.TimestampType(), False),
    T.StructField("group_id", T.StringType(), False),
    T.StructField("topic", T.StringType(), False),
    T.StructField("partition", T.IntegerType(), False),
    T.StructField("offset", T.LongType(), False),
    T.StructField("metadata", T.StringType(), True),
    T.StructField("leader_epoch", T.LongType(), True),
])

PARTITION_OFFSETS = T.StructType([
    T.StructField("k_cluster_id", T.StringType(), False),
    T.StructField("captured_at", T.TimestampType(), False),
    T.StructField("k_topic_id", T.StringType(), False),
    T.StructField("partition", T.IntegerType(), False),
    T.StructField("offset_type", T.StringType(), False),
    T.StructField("offset", T.LongType(), False),
    T.StructField("timestamp_ms", T.LongType(), False),
    T.StructField("leader_epoch", T.IntegerType(), True),
])

# What an offset capture read: one row per group and capture. Offsets of a group that was read and has no
# row any more are removed, those of a group that was not read stay.
GROUP_READS = T.StructType([
    T.StructField("k_cluster_id", T.StringType(), False),
    T.StructField("captured_at", T.TimestampType(), False),
    T.StructField("group_id", T.StringType(), False),
    T.StructField("read", T.BooleanType(), False),
])

# Commits and read marks of offset captures in one input, so that a micro-batch says all it has to: rows of
# ``kind`` "commit" are GROUP_OFFSETS rows, those of ``kind`` "read" say that a group was read (or not).
GROUP_EVENTS = T.StructType([
    T.StructField("kind", T.StringType(), False),
    *[T.StructField(f.name, f.dataType, f.name not in ("k_cluster_id", "captured_at", "group_id"))
      for f in GROUP_OFFSETS.fields],
    T.StructField("read", T.BooleanType(), True),
])

# The columns of the Kafka source of Structured Streaming, and the cluster: topics of the same name in two
# clusters are two logs. Only these five columns are ever read.
RECORD_LOG = T.StructType([
    T.StructField("k_cluster_id", T.StringType(), False),
    T.StructField("topic", T.StringType(), False),
    T.StructField("partition", T.IntegerType(), False),
    T.StructField("offset", T.LongType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
])

# Offset type names of the partition-offset capture.
OFFSET_TYPES = ("EARLIEST", "LATEST", "MAX_TIMESTAMP")

# ------------------------------------------------------------- state tables ---

AUDIT = ("discovered_at", "modified_at", "refreshed_at")

NULL_SAFE = "<=>"
PLAIN = "="


@dataclass(frozen=True)
class TableSpec:
    """How one current-state table is merged.

    ``keys``: natural key, cluster first. ``compare``: (column, operator) pairs
    whose change moves ``modified_at``; an empty list makes a "touch" table,
    whose matches only move ``refreshed_at``. ``extra``: stored columns that are
    not compared (velocity). ``delete_stale``: rows of a refreshed cluster that
    the snapshot no longer holds are removed. ``velocity``: None, "all"
    (every row) or an offset type that alone gets a velocity.
    """

    name: str
    keys: tuple[str, ...]
    compare: tuple[tuple[str, str], ...] = ()
    extra: tuple[str, ...] = ()
    delete_stale: bool = False
    velocity: str | None = None
    parent: str | None = None
    parent_keys: tuple[str, ...] = ()

    @property
    def attrs(self) -> tuple[str, ...]:
        return tuple(c for c, _ in self.compare)

    @property
    def columns(self) -> tuple[str, ...]:
        return self.keys + self.attrs + self.extra + AUDIT

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, COLUMN_TYPES[c], c not in self.keys and c not in AUDIT)
                             for c in self.columns])


_CONFIG_COMPARE = (
    ("value", NULL_SAFE), ("source", PLAIN), ("sensitive", PLAIN),
    ("read_only", PLAIN), ("type", PLAIN), ("documentation", NULL_SAFE),
)

_S, _I, _L, _B, _D, _TS = (T.StringType(), T.IntegerType(), T.LongType(),
                          T.BooleanType(), T.DoubleType(), T.TimestampType())

# Column types of the state tables; a column name means the same everywhere.
# Velocity is stored as double (the relational original used REAL).
COLUMN_TYPES: dict[str, T.DataType] = {
    **{c: _S for c in ("k_cluster_id", "name", "host", "rack", "value", "source", "type",
                       "documentation", "k_topic_id", "offset_type", "group_id", "state",
                       "partition_assignor", "member_id", "group_instance_id", "client_id",
                       "metadata", "resource_type", "resource_name", "pattern_type", "principal",
                       "operation", "permission_type")},
    **{c: _I for c in ("k_node_id", "port", "k_partition_id", "coordinator_id")},
    **{c: _L for c in ("offset", "leader_epoch", "size", "offset_lag")},
    **{c: _B for c in ("controller", "leader", "voter", "observer", "sensitive", "read_only",
                       "internal", "in_sync", "future", "simple")},
    **{c: _TS for c in ("timestamp", "offset_timestamp") + AUDIT},
    "velocity": _D,
}

TABLES: dict[str, TableSpec] = {s.name: s for s in [
    TableSpec("clusters", ("k_cluster_id",), (("name", PLAIN),)),
    TableSpec("nodes", ("k_cluster_id", "k_node_id"),
              (("host", NULL_SAFE), ("port", NULL_SAFE), ("rack", NULL_SAFE), ("controller", PLAIN),
               ("leader", NULL_SAFE), ("voter", NULL_SAFE), ("observer", NULL_SAFE)),
              parent="clusters", parent_keys=("k_cluster_id",)),
    TableSpec("node_configs", ("k_cluster_id", "k_node_id", "name"), _CONFIG_COMPARE,
              parent="nodes", parent_keys=("k_cluster_id", "k_node_id")),
    TableSpec("topics", ("k_cluster_id", "k_topic_id"), (("name", PLAIN), ("internal", PLAIN)),
              delete_stale=True, parent="clusters", parent_keys=("k_cluster_id",)),
    TableSpec("topic_configs", ("k_cluster_id", "k_topic_id", "name"), _CONFIG_COMPARE,
              parent="topics", parent_keys=("k_cluster_id", "k_topic_id")),
    TableSpec("topic_partitions", ("k_cluster_id", "k_topic_id", "k_partition_id"),
              parent="topics", parent_keys=("k_cluster_id", "k_topic_id")),
    TableSpec("partition_offsets", ("k_cluster_id", "k_topic_id", "k_partition_id", "offset_type"),
              (("offset", NULL_SAFE), ("timestamp", NULL_SAFE), ("leader_epoch", NULL_SAFE)),
              extra=("velocity",), velocity="LATEST",
              parent="topic_partitions", parent_keys=("k_cluster_id", "k_topic_id", "k_partition_id")),
    TableSpec("partition_replicas", ("k_cluster_id", "k_topic_id", "k_partition_id", "k_node_id"),
              (("leader", PLAIN), ("in_sync", PLAIN), ("size", NULL_SAFE), ("offset_lag", NULL_SAFE),
               ("future", NULL_SAFE)),
              parent="topic_partitions", parent_keys=("k_cluster_id", "k_topic_id", "k_partition_id")),
    TableSpec("consumer_groups", ("k_cluster_id", "group_id"),
              (("coordinator_id", PLAIN), ("simple", PLAIN), ("state", PLAIN),
               ("partition_assignor", NULL_SAFE)),
              delete_stale=True, parent="clusters", parent_keys=("k_cluster_id",)),
    TableSpec("consumer_group_members", ("k_cluster_id", "group_id", "member_id"),
              (("group_instance_id", NULL_SAFE), ("client_id", NULL_SAFE), ("host", NULL_SAFE)),
              delete_stale=True, parent="consumer_groups", parent_keys=("k_cluster_id", "group_id")),
    TableSpec("consumer_group_member_assignments",
              ("k_cluster_id", "group_id", "member_id", "k_topic_id", "k_partition_id"),
              delete_stale=True, parent="consumer_group_members",
              parent_keys=("k_cluster_id", "group_id", "member_id")),
    TableSpec("consumer_group_offsets", ("k_cluster_id", "group_id", "k_topic_id", "k_partition_id"),
              (("offset", NULL_SAFE), ("offset_timestamp", NULL_SAFE), ("metadata", NULL_SAFE),
               ("leader_epoch", NULL_SAFE)),
              extra=("velocity",), delete_stale=True, velocity="all",
              parent="consumer_groups", parent_keys=("k_cluster_id", "group_id")),
    TableSpec("acl_resources", ("k_cluster_id", "resource_type", "name", "pattern_type"),
              delete_stale=True, parent="clusters", parent_keys=("k_cluster_id",)),
    TableSpec("acl_entries", ("k_cluster_id", "principal", "host", "operation", "permission_type"),
              delete_stale=True, parent="clusters", parent_keys=("k_cluster_id",)),
    TableSpec("acl_bindings", ("k_cluster_id", "resource_type", "resource_name", "pattern_type",
                               "principal", "host", "operation", "permission_type"),
              delete_stale=True, parent="acl_resources",
              parent_keys=("k_cluster_id", "resource_type", "resource_name", "pattern_type")),
]}

# Parents without cascade in the relational original still remove their
# children here (orphans are never kept): consumer_group_members under
# consumer_groups, assignments and offsets under topic_partitions, bindings
# under acl_entries as well as acl_resources.
EXTRA_PARENTS: dict[str, list[tuple[str, tuple[str, ...]]]] = {
    "consumer_group_member_assignments": [("topic_partitions", ("k_cluster_id", "k_topic_id", "k_partition_id"))],
    "consumer_group_offsets": [("topic_partitions", ("k_cluster_id", "k_topic_id", "k_partition_id"))],
    "acl_bindings": [("acl_entries", ("k_cluster_id", "principal", "host", "operation", "permission_type"))],
}

OFFSET_TABLES = ("consumer_group_offsets", "partition_offsets")

# Bookkeeping of a store, kept like its tables: the time of the last applied capture of each cluster and
# kind, and chunk rows of captures that are not complete yet.
SEEN = T.StructType([
    T.StructField("k_cluster_id", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("seen_at", T.TimestampType(), False),
])

# Captures that were left out for good: two topics of one name, or given up incomplete.
FAILED = T.StructType([
    T.StructField("k_cluster_id", T.StringType(), False),
    T.StructField("captured_at", T.TimestampType(), False),
    T.StructField("reason", T.StringType(), False),
    T.StructField("n_rows", T.LongType(), False),
])


def relaxed(dt: T.DataType) -> T.DataType:
    """The same type with every nested field and element nullable (what Spark
    file sources produce; casts into it always resolve)."""
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(f.name, relaxed(f.dataType), True) for f in dt.fields])
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(relaxed(dt.elementType), True)
    if isinstance(dt, T.MapType):
        return T.MapType(relaxed(dt.keyType), relaxed(dt.valueType), True)
    return dt

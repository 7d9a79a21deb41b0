"""Key resolution of child rows against current parent states.

With natural keys carried down, a lookup is an existence check (inner or
semi join on the parent's natural key); only topic *names* need translating to
topic ids (J14). Names are resolved against the current topics only, and a
name held by two live topics fails the check (Q11).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaptide.operators.joins import existing, lookup

CK = "k_cluster_id"


def topic_ids_by_name(topics: DataFrame) -> DataFrame:
    """(k_cluster_id, name) -> k_topic_id for the current topics."""
    return topics.select(CK, F.col("name").alias("topic"), "k_topic_id")


def duplicate_topic_names(topics: DataFrame) -> DataFrame:
    """Names held by more than one current topic of a cluster (must be empty)."""
    return (topics.groupBy(CK, "name").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def resolve_topic(rows: DataFrame, topics: DataFrame) -> DataFrame:
    """Replace the ``topic`` name column by ``k_topic_id``; unknown names
    drop. The join key is (cluster, name)."""
    return lookup(rows, topic_ids_by_name(topics), [CK, "topic"]).drop("topic")


def resolve_assignments(assignments: DataFrame, members: DataFrame, topics: DataFrame,
                        partitions: DataFrame) -> DataFrame:
    """Assignment (group, member, topic name, partition) -> member exists ->
    topic id by name -> partition exists. Each assignment stays with its own
    member."""
    x = resolve_topic(existing(assignments, members, [CK, "group_id", "member_id"]), topics)
    x = existing(x, partitions, [CK, "k_topic_id", "k_partition_id"])
    kept = [c for c in ("refreshed_at",) if c in x.columns]
    return x.select(CK, *kept, "group_id", "member_id", "k_topic_id", "k_partition_id")


def resolve_group_offsets(offsets: DataFrame, groups: DataFrame, topics: DataFrame,
                          partitions: DataFrame) -> DataFrame:
    """Committed offset -> group exists -> topic id by name -> partition exists."""
    x = resolve_topic(existing(offsets, groups, [CK, "group_id"]), topics)
    return existing(x, partitions, [CK, "k_topic_id", "k_partition_id"])


def resolve_partition_offsets(offsets: DataFrame, partitions: DataFrame) -> DataFrame:
    """Partition offset -> (topic id, partition) exists."""
    return existing(offsets, partitions, [CK, "k_topic_id", "k_partition_id"])

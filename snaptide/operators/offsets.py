"""Offsets of partitions and of consumer groups.

S11 (beginning / end offsets), S13 + U3 (EARLIEST / LATEST / MAX_TIMESTAMP in
long form), W1 + W2 + J18 (committed offsets within the log's bounds) and the
P6 / P7 clean-up of a captured partition-offset listing. All aggregations are
grouped by (topic, partition) with map-side partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaptide.functions.scalars import millis_to_timestamp, offset_or_null
from snaptide.operators.joins import lookup
from snaptide.schemas import OFFSET_TYPES

TP = ["topic", "partition"]


def partition_bounds(log: DataFrame, keys=TP) -> DataFrame:
    """Beginning offset (smallest) and end offset (largest + 1) per partition."""
    return log.groupBy(*keys).agg(F.min("offset").alias("beginning_offset"),
                                  (F.max("offset") + 1).alias("end_offset"))


def offset_types(log: DataFrame, keys=TP) -> DataFrame:
    """Long form (keys, offset_type, offset, timestamp): EARLIEST and LATEST
    carry no timestamp; MAX_TIMESTAMP is the record with the greatest
    timestamp, the smallest offset among equal timestamps."""
    earliest, latest, max_ts = OFFSET_TYPES
    agg = log.groupBy(*keys).agg(
        F.min("offset").alias("_e"), (F.max("offset") + 1).alias("_l"),
        F.max(F.struct(F.col("timestamp").alias("ts"), (-F.col("offset")).alias("neg"))).alias("_m"))
    none = F.lit(None).cast(log.schema["timestamp"].dataType)
    rows = F.array(
        F.struct(F.lit(earliest).alias("offset_type"), F.col("_e").alias("offset"), none.alias("timestamp")),
        F.struct(F.lit(latest).alias("offset_type"), F.col("_l").alias("offset"), none.alias("timestamp")),
        F.struct(F.lit(max_ts).alias("offset_type"), (-F.col("_m.neg")).alias("offset"),
                 F.col("_m.ts").alias("timestamp")))
    return agg.select(*keys, F.inline(rows))


def within_bounds(commits: DataFrame, bounds: DataFrame, keys=TP) -> DataFrame:
    """W1 + W2 + J18: committed offsets with beginning <= offset < end."""
    return (lookup(commits, bounds.select(*keys, "beginning_offset", "end_offset"), list(keys))
            .filter((F.col("offset") >= F.col("beginning_offset")) & (F.col("offset") < F.col("end_offset"))))


def clean_partition_offsets(captured: DataFrame) -> DataFrame:
    """P6 + P7 on a captured listing: unknown (negative) offsets and
    timestamps become NULL; ready for the partition_offsets merge."""
    return captured.select(
        "k_cluster_id", F.col("captured_at").alias("refreshed_at"), "k_topic_id",
        F.col("partition").alias("k_partition_id"), "offset_type",
        offset_or_null(F.col("offset")).alias("offset"),
        millis_to_timestamp(F.col("timestamp_ms")).alias("timestamp"),
        F.col("leader_epoch").cast("bigint").alias("leader_epoch"))

"""Readers for captured snapshots, offset captures and record logs.

Schemas are always declared (never inferred). ``fmt`` is any file source Spark
reads with a schema: ``json`` (one snapshot or snapshot chunk per line) or
``parquet``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptide.schemas import GROUP_OFFSETS, GROUP_READS, PARTITION_OFFSETS, RECORD_LOG, SNAPSHOT, relaxed

_RAW = "_raw_document"

def read_snapshots(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(SNAPSHOT).format(fmt).load(path)


def read_checked_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON snapshots, and apart from them the lines that are none: (raw_document, source_file, reason).

    Reasons: ``malformed`` (no JSON, or a value that its column cannot hold), ``incomplete`` (no cluster, capture
    time or node list, without which nothing can be refreshed). Bad lines never become rows of a refresh; the
    second frame is there to be counted and kept. Empty lines are no documents."""
    fields = relaxed(SNAPSHOT).add(_RAW, "string")
    lines = (spark.read.schema(fields).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _RAW).json(path))
    whole = F.col("k_cluster_id").isNotNull() & F.col("captured_at").isNotNull() & F.col("nodes").isNotNull()
    good = lines.filter(F.col(_RAW).isNull() & whole).select(*SNAPSHOT.fieldNames())
    kept = F.coalesce(F.col(_RAW), F.to_json(F.struct(*SNAPSHOT.fieldNames())))
    bad = (lines.withColumn("source_file", F.col("_metadata.file_path")).filter(F.col(_RAW).isNotNull() | ~whole)
           .select(kept.alias("raw_document"), "source_file",
                   F.when(F.col(_RAW).isNotNull(), "malformed").otherwise("incomplete").alias("reason")))
    return good, bad


def split_group_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commit rows (GROUP_OFFSETS) and read marks (GROUP_READS) of GROUP_EVENTS rows. A group with a commit was read."""
    commits = events.filter("kind = 'commit'").select(*GROUP_OFFSETS.fieldNames())
    reads = events.filter("kind IN ('commit', 'read')").groupBy("k_cluster_id", "captured_at", "group_id").agg(
        F.max((F.col("kind") == "commit") | F.coalesce("read", F.lit(True))).alias("read"))
    return commits, reads


def read_group_offsets(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(GROUP_OFFSETS).format(fmt).load(path)


def read_group_reads(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(GROUP_READS).format(fmt).load(path)


def read_partition_offsets(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(PARTITION_OFFSETS).format(fmt).load(path)


def read_record_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Record log restricted to the columns ever used; Parquet prunes the rest."""
    return spark.read.format(fmt).load(path).select(*[F.col(f.name).cast(f.dataType) for f in RECORD_LOG])


def stream_snapshots(spark: SparkSession, path: str, fmt: str = "json", max_files: int | None = None) -> DataFrame:
    """Snapshots arriving as files, as a streaming DataFrame."""
    reader = spark.readStream.schema(SNAPSHOT).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)

"""Forward as-of join: the timestamp of the first record at or after an offset.

For each target (partition keys, offset) the answer is the record of the same
partition with the smallest offset >= target. Written without a range join:

1. offsets are cut into fixed ranges (buckets). One scan of the log gives, per
   (partition, bucket), its first record and its largest offset (map-side
   partial aggregation); partition bounds come from the same rows;
2. records in buckets that hold a target are read (semi join with the distinct
   target buckets); per (partition, bucket), targets and records are ordered by
   offset descending (a record before a target at an equal offset) and each
   target takes ``last(record, ignorenulls)`` over the rows seen so far;
3. buckets with targets left over need the first record of the nearest later
   bucket. That is the same question one level up, asked once per bucket (not
   per target) over the per-bucket firsts, with buckets of buckets; the top
   level is one short window per partition.

No window partition holds more than one bucket of one partition's records, so
a partition holding most of the log is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snaptide.operators.joins import existing, lookup

DEFAULT_BUCKET = 1 << 18
# buckets per bucket of the level above
_FAN = 1 << 12


def _fill(records: DataFrame, targets: DataFrame, part_keys, order_col: str) -> DataFrame:
    """``targets`` with ``_found``: ``_v`` of the first record at or after ``order_col`` within ``part_keys``."""
    none = F.lit(None).cast(records.schema["_v"].dataType)
    cols = [*part_keys, order_col]
    rows = (records.select(*cols, "_v", F.lit(0).alias("_rec"))
            .unionByName(targets.select(*cols, none.alias("_v"), F.lit(1).alias("_rec"))))
    w = (Window.partitionBy(*part_keys).orderBy(F.col(order_col).desc(), F.col("_rec").asc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.withColumn("_found", F.last("_v", ignorenulls=True).over(w)).filter(F.col("_rec") == 1)
            .select(*cols, "_found"))


def bucket_firsts(log: DataFrame, keys, *, offset: str = "offset", value: str = "timestamp",
                  bucket: int = DEFAULT_BUCKET) -> DataFrame:
    """(keys, _b, _o, _v, _max): first record (offset and value) and largest offset of every bucket."""
    rec = log.select(*keys, F.col(offset).alias("_o"), F.col(value).alias("_v"),
                     F.floor(F.col(offset) / F.lit(bucket)).alias("_b"))
    return (rec.groupBy(*keys, "_b").agg(F.min(F.struct("_o", "_v")).alias("_f"), F.max("_o").alias("_max"))
            .select(*keys, "_b", F.col("_f._o").alias("_o"), F.col("_f._v").alias("_v"), "_max"))


def first_at_or_after(targets: DataFrame, log: DataFrame, keys, *, offset: str = "offset",
                      value: str = "timestamp", out: str = "offset_timestamp",
                      bucket: int = DEFAULT_BUCKET, firsts: DataFrame | None = None) -> DataFrame:
    """Distinct targets (keys, offset) with ``out`` = ``value`` of the first
    record at or after the offset (NULL when none). ``firsts``: ``bucket_firsts``
    of the log, if the caller has it."""
    keys = list(keys)
    if firsts is None:
        firsts = bucket_firsts(log, keys, offset=offset, value=value, bucket=bucket)
    t = (targets.select(*keys, F.col(offset).alias("_o")).distinct()
         .withColumn("_b", F.floor(F.col("_o") / F.lit(bucket))))
    rec = log.select(*keys, F.col(offset).alias("_o"), F.col(value).alias("_v"),
                     F.floor(F.col(offset) / F.lit(bucket)).alias("_b"))
    near = existing(rec, t.select(*keys, "_b").distinct(), keys + ["_b"])
    inside = _fill(near, t, keys + ["_b"], "_o")

    # one question per bucket with targets left over: the first record of the buckets after it
    asked = (inside.filter(F.col("_found").isNull()).select(*keys, (F.col("_b") + 1).alias("_b")).distinct()
             .withColumn("_bb", F.floor(F.col("_b") / F.lit(_FAN))))
    level = firsts.select(*keys, "_b", "_v", F.floor(F.col("_b") / F.lit(_FAN)).alias("_bb"))
    within = _fill(level, asked, keys + ["_bb"], "_b")
    top = (level.groupBy(*keys, "_bb").agg(F.min(F.struct("_b", "_v")).alias("_f"))
           .select(*keys, "_bb", F.col("_f._v").alias("_v")))
    above = (within.filter(F.col("_found").isNull()).select(*keys, (F.col("_bb") + 1).alias("_bb")).distinct())
    beyond = (_fill(top, above, keys, "_bb").select(*keys, (F.col("_bb") - 1).alias("_bb"),
                                                    F.col("_found").alias("_beyond")))
    later = (within.join(beyond, keys + ["_bb"], "left")
             .select(*keys, (F.col("_b") - 1).alias("_b"), F.coalesce("_found", "_beyond").alias("_later")))
    return (inside.join(later, keys + ["_b"], "left")
            .select(*keys, F.col("_o").alias(offset), F.coalesce("_found", "_later").alias(out)))


def attach_offset_timestamps(commits: DataFrame, log: DataFrame, keys, *,
                             bucket: int = DEFAULT_BUCKET) -> DataFrame:
    """J15 + J16 (+ W1/W2): every committed offset with the timestamp of the
    first record at or after it, looked up only for offsets within the
    partition's bounds; others get NULL. Distinct (partition, offset) pairs
    are looked up once (L3)."""
    keys = list(keys)
    firsts = bucket_firsts(log, keys, bucket=bucket)
    bounds = firsts.groupBy(*keys).agg(F.min("_o").alias("beginning_offset"),
                                       (F.max("_max") + 1).alias("end_offset"))
    from snaptide.operators.offsets import within_bounds
    targets = within_bounds(commits.select(*keys, "offset").distinct(), bounds, keys).select(*keys, "offset")
    found = first_at_or_after(targets, log, keys, bucket=bucket, firsts=firsts)
    return lookup(commits, found, keys + ["offset"], "left")

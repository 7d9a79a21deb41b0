"""Refresh accounting: what a merge did with the rows it was given.

``submitted`` rows, distinct ``keys``, ``duplicate_keys`` (keys given more than
once, resolved to one row), and one count per merge action. Counts come from
single aggregations (map-side partial counts), never from collected rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaptide.operators.merge import ACTIONS


def accounting_metrics():
    """Aggregate expressions over a merge output made with ``dup_counts=True``:
    rows and keys that reached the merge, and one count per action."""
    dups = F.col("_dups")
    return ([F.coalesce(F.sum(dups), F.lit(0)).alias("submitted"), F.count(dups).alias("keys"),
             F.count_if(dups > 1).alias("duplicate_keys")]
            + [F.count_if(F.col("action") == a).alias(a) for a in ACTIONS])


def refresh_accounting(table: str, source: DataFrame, merged: DataFrame, keys) -> DataFrame:
    """Long-form counts: ``table_name, metric, value``. ``source``: the rows
    submitted, before any lookup; ``merged``: a merge output with ``_dups``.
    ``unresolved`` = submitted rows that did not reach the merge."""
    given = source.agg(F.count(F.lit(1)).alias("given"))
    counts = merged.agg(*accounting_metrics())
    names = ["submitted", "unresolved", "keys", "duplicate_keys", *ACTIONS]
    both = (given.unpivot([], ["given"], "metric", "value")
            .unionByName(counts.unpivot([], ["submitted", "keys", "duplicate_keys", *ACTIONS], "metric", "value")))
    one = both.groupBy().pivot("metric", ["given", "submitted", "keys", "duplicate_keys", *ACTIONS]).agg(F.sum("value"))
    one = one.withColumn("unresolved", F.col("given") - F.col("submitted")).withColumn("submitted", F.col("given"))
    long = one.unpivot([], names, "metric", "value")
    return long.select(F.lit(table).alias("table_name"), "metric",
                       F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))

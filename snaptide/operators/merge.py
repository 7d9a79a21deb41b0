"""Change-detecting merge of one snapshot into a current-state table.

Per key, in clause order:

1. key matched, no compared attribute differs -> ``touch``: only
   ``refreshed_at`` moves (velocity becomes 0);
2. key matched otherwise -> ``update``: attributes overwritten,
   ``modified_at = refreshed_at = now`` (velocity from the last change);
3. key only in the snapshot -> ``insert`` with all three audit times = now;
4. key only in the state -> ``delete`` when the table removes stale rows and
   the row's scope (its cluster, or a narrower scope) was refreshed by this
   snapshot, else ``keep``.

A matched row whose state is not older than the snapshot is kept unchanged, so
replaying a snapshot (a retried micro-batch) is a no-op.

The result has the table's columns plus ``action``; survivors are the rows
whose action is not ``delete``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptide.functions.scalars import unchanged, velocity
from snaptide.operators.joins import lookup, sorting
from snaptide.schemas import AUDIT, TableSpec

NOW = "refreshed_at"
ACTIONS = ("insert", "update", "touch", "keep", "delete")

_T = "t__"
_S = "s__"


def no_rows(spark: SparkSession, schema) -> DataFrame:
    """A frame without rows that Catalyst knows to be empty: joins and unions with it vanish from a plan. Rows from the
    driver alone have no known size, so that a join with them shuffles the other side, on however few keys."""
    return spark.createDataFrame([], schema).filter(F.lit(False))


def empty_state(spark: SparkSession, spec: TableSpec, like: DataFrame | None = None) -> DataFrame:
    """An empty state table. With ``like`` (a merge source) column types follow
    the source, so the merge works for any table, not only the declared ones."""
    if like is None:
        return no_rows(spark, spec.schema)
    types = dict(like.dtypes)
    cols = [F.lit(None).cast(types[c]).alias(c) for c in spec.keys + spec.attrs]
    cols += [F.lit(None).cast("double").alias(c) for c in spec.extra]
    cols += [F.lit(None).cast(types[NOW]).alias(c) for c in AUDIT]
    return like.limit(0).select(*cols)


def reduce_duplicates(source: DataFrame, keys, order=(), count_col: str | None = None, dealt: bool = False) -> DataFrame:
    """One row per key.

    Same-key rows that differ are resolved to the greatest row by ``order``,
    then by the remaining columns in their order, NULL lowest. Written as a
    grouped ``max`` of a struct, so rows are combined map-side before the
    shuffle and a hot key never reaches one task whole. ``dealt``: rows are dealt
    out by the key first, for sources that hold few rows of a key: one sort
    serves the reduction and a join by the same key.
    """
    keys = list(keys)
    if dealt:
        source = source.repartition(*sorting(keys))
    others = [c for c in source.columns if c not in keys]
    grouped = source.groupBy(*sorting(keys))
    if not others:
        out = grouped.agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_n")
    elif len(others) == 1:  # a struct of one, held by hash: structs are sorted by key first, all rows of a task in memory
        out = grouped.agg(F.max(others[0]).alias(others[0]), F.count(F.lit(1)).alias("_n")).select(*keys, *others, "_n")
    else:
        order = [c for c in order if c in others]
        packed = F.struct(*[F.col(c) for c in order + [c for c in others if c not in order]])
        out = grouped.agg(F.max(packed).alias("_r"), F.count(F.lit(1)).alias("_n"))
        out = out.select(*keys, *[F.col("_r").getField(c).alias(c) for c in others], "_n")
    if count_col:
        return out.withColumnRenamed("_n", count_col)
    return out.drop("_n")


def merge_snapshot(target: DataFrame | None, source: DataFrame, spec: TableSpec, *,
                   scope: DataFrame | None = None, incremental: bool = False, dedupe: bool = True,
                   dedupe_order=(), dup_counts: bool = False, dealt: bool = False) -> DataFrame:
    """Merge ``source`` (keys, compared attributes, ``refreshed_at``) into ``target``.

    ``scope``: rows of scope columns (a prefix of the key, normally
    ``k_cluster_id``) plus ``refreshed_at``; state rows in scope that the
    snapshot no longer holds and that are older than the scope's time are
    deleted when ``spec.delete_stale``. Without a scope nothing is deleted.

    A full capture (about as large as the state) is one full outer join on the
    whole natural key. ``incremental`` says that the capture is far smaller
    than the state: the state left-joins it and inserts are the capture's rows
    without a state row, so Spark can broadcast the capture by its size and
    leave the state unshuffled. Both give the same rows at any size. ``dealt``:
    see ``reduce_duplicates``.
    """
    spark = source.sparkSession
    keys = list(spec.keys)
    attrs = list(spec.attrs)
    src = source.select(*keys, *attrs, NOW)
    if target is None:
        target = empty_state(spark, spec, like=src)
    if dedupe:
        src = reduce_duplicates(src, keys, order=(NOW,) + tuple(dedupe_order), count_col="_dups", dealt=dealt)
    else:
        src = src.withColumn("_dups", F.lit(1).cast("bigint"))

    t_cols = [c for c in spec.columns if c not in keys]
    t = target.select(*keys, *[F.col(c).alias(_T + c) for c in t_cols], F.lit(True).alias(_T + "present"))
    s = src.select(*keys, *[F.col(c).alias(_S + c) for c in attrs + [NOW, "_dups"]],
                   F.lit(True).alias(_S + "present"))

    if incremental:
        inserts = lookup(s, t.select(*keys), keys, "left_anti")
        joined = lookup(t, s, keys, "left").unionByName(inserts, allowMissingColumns=True)
    else:
        joined = t.join(s, sorting(keys), "full_outer")

    if spec.delete_stale and scope is not None:
        scope_cols = [c for c in scope.columns if c != NOW]
        sc = scope.select(*scope_cols, F.col(NOW).alias("_scope_at"))
        # one row per scope unit; a unit holding many rows is split by AQE
        joined = lookup(joined, reduce_duplicates(sc, scope_cols), scope_cols, "left")
        stale = F.col(_T + NOW) < F.col("_scope_at")
    else:
        stale = F.lit(False)
    return _project(joined, spec, stale, dup_counts)


def _project(joined: DataFrame, spec: TableSpec, stale, dup_counts: bool = False) -> DataFrame:
    keys = list(spec.keys)
    t_present = F.coalesce(F.col(_T + "present"), F.lit(False))
    s_present = F.coalesce(F.col(_S + "present"), F.lit(False))
    now = F.col(_S + NOW)
    old = {c: F.col(_T + c) for c in spec.attrs}
    new = {c: F.col(_S + c) for c in spec.attrs}
    same = unchanged(old, new, spec.compare)
    newer = now > F.col(_T + NOW)

    action = (F.when(t_present & s_present & ~newer, F.lit("keep"))
              .when(t_present & s_present & same, F.lit("touch"))
              .when(t_present & s_present, F.lit("update"))
              .when(s_present, F.lit("insert"))
              .when(stale, F.lit("delete"))
              .otherwise(F.lit("keep")))
    a = F.col("action")
    writes = a.isin("insert", "update")
    out = [F.col(k) for k in keys]
    for c in spec.attrs:
        out.append(F.when(writes, F.col(_S + c)).otherwise(F.col(_T + c)).alias(c))
    if spec.velocity:
        if spec.velocity == "all":
            applies = F.lit(True)
        else:
            applies = F.col("offset_type") == F.lit(spec.velocity)
        v_update = velocity(F.col(_S + "offset"), F.col(_T + "offset"), now, F.col(_T + "modified_at"))
        out.append(F.when(a == "touch", F.when(applies, F.lit(0.0)))
                   .when(a == "update", F.when(applies, v_update))
                   .when(a == "insert", F.lit(None).cast("double"))
                   .otherwise(F.col(_T + "velocity")).alias("velocity"))
    out.append(F.when(a == "insert", now).otherwise(F.col(_T + "discovered_at")).alias("discovered_at"))
    out.append(F.when(writes, now).otherwise(F.col(_T + "modified_at")).alias("modified_at"))
    out.append(F.when(a.isin("insert", "update", "touch"), now).otherwise(F.col(_T + NOW)).alias(NOW))
    out.append(a)
    if dup_counts:
        # rows given for the key in the snapshot (NULL for state-only keys)
        out.append(F.col(_S + "_dups").alias("_dups"))
    return joined.withColumn("action", action).select(*out)


def survivors(merged: DataFrame) -> DataFrame:
    """The new state: every merged row except deletes, without ``action``."""
    return merged.filter(F.col("action") != "delete").drop("action")


def deleted(merged: DataFrame) -> DataFrame:
    """Side output: the rows removed as stale."""
    return merged.filter(F.col("action") == "delete").drop("action")


__all__ = ["merge_snapshot", "reduce_duplicates", "survivors", "deleted",
           "empty_state", "no_rows", "ACTIONS", "AUDIT", "NOW"]

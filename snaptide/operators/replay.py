"""Replay a history of captures set-wise (V3), alone or onto a stored state.

Equivalent to merging the captures one after another with ``merge_snapshot``,
but computed for all captures at once:

* ``changed``: first row of an island, or any compared attribute differs from
  the previous capture of the key (``<=>`` / ``=`` per column);
* ``modified_at``: time of the last change so far; ``discovered_at``: start of
  the island;
* ``velocity``: NULL at an island start, 0 when unchanged, else
  (offset - previous offset) / seconds since the previous ``modified_at``.

For tables with stale delete a key missing from a read of its scope (its
cluster, or a narrower prefix of the key such as cluster and group) starts a
new island. Reads are ranked per scope in two levels (within a day, then days),
so no task holds all reads of a cluster.

Two-level scan of the rows, so that no task holds a key's whole history:
captures are cut into segments of ``segment`` consecutive ranks; windows run
per (key, segment), and one small summary row per (key, segment) carries the
previous row, the last change time and the last island start across segments
(a window per key over the summaries only).

``fold`` puts the stored row of each key before its history: it is the
previous row of the first capture and brings its own ``modified_at`` and
``discovered_at``. The result is the state after the last capture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from snaptide.functions.scalars import unchanged, velocity
from snaptide.operators.joins import lookup
from snaptide.operators.merge import reduce_duplicates
from snaptide.schemas import TableSpec

NOW = "refreshed_at"
DEFAULT_SEGMENT = 1 << 16


def capture_ranks(reads: DataFrame, scope) -> DataFrame:
    """(scope, refreshed_at, _rank): rank of every read time within its scope unit, from 1."""
    scope = list(scope)
    times = reads.select(*scope, NOW).distinct().withColumn("_day", F.date_trunc("day", NOW))
    inner = times.withColumn("_in_day", F.row_number().over(Window.partitionBy(*scope, "_day").orderBy(NOW)))
    before = Window.partitionBy(*scope).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = (times.groupBy(*scope, "_day").agg(F.count(F.lit(1)).alias("_n"))
            .select(*scope, "_day", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return (lookup(inner, days, [*scope, "_day"])
            .select(*scope, NOW, (F.col("_before") + F.col("_in_day")).alias("_rank")))


def _ranked(history: DataFrame, spec: TableSpec, reads: DataFrame | None, scope) -> DataFrame:
    scope = list(scope or spec.keys[:1])
    known = history.select(*scope, NOW) if reads is None else reads.select(*scope, NOW).unionByName(history.select(*scope, NOW))
    return lookup(history.select(*spec.keys, *spec.attrs, NOW), capture_ranks(known, scope), [*scope, NOW])


def replayed_steps(rows: DataFrame, spec: TableSpec, gaps: bool, segment: int) -> DataFrame:
    """``rows``: keys, attrs, refreshed_at, _rank, _mod0, _disc0. Stored rows have rank 0 and both of their
    times; captured rows have neither. Returns the captured rows with their state columns and ``action``."""
    keys, attrs = list(spec.keys), list(spec.attrs)
    rows = rows.withColumn("_seg", F.floor((F.col("_rank") - 1) / F.lit(segment)))

    # pass 1: flags that need only the previous row inside the segment
    ws = Window.partitionBy(*keys, "_seg").orderBy(NOW)
    run = ws.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = rows.select("*", *[F.lag(c).over(ws).alias("_p_" + c) for c in attrs],
                    F.lag("_rank").over(ws).alias("_p_rank"), F.lag(NOW).over(ws).alias("_p_now"))
    first = F.col("_p_now").isNull()
    gap = (F.col("_rank") - F.col("_p_rank") > 1) if gaps else F.lit(False)
    same_inner = unchanged({c: F.col("_p_" + c) for c in attrs}, {c: F.col(c) for c in attrs}, spec.compare)
    x = x.withColumns({"_first": first,
                       "_start_in": ~first & gap,
                       "_chg_in": ~first & (gap | ~same_inner)})

    # per-segment summary and the carry across segments (one row per key and segment; a stored row, of
    # rank 0, is the only one of its segment)
    row_struct = F.struct(F.col(NOW).alias("t"), F.col("_rank").alias("r"), *[F.col(c).alias("a_" + c) for c in attrs])
    seg = x.groupBy(*keys, "_seg").agg(
        F.min(row_struct).alias("_f"), F.max(row_struct).alias("_l"),
        F.max("_mod0").alias("_mod0"), F.max("_disc0").alias("_disc0"),
        F.max(F.when(F.col("_chg_in"), F.col(NOW))).alias("_in_chg"),
        F.max(F.when(F.col("_start_in"), F.col(NOW))).alias("_in_start"))
    wk = Window.partitionBy(*keys).orderBy("_seg")
    before = wk.rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("_pl", F.lag("_l").over(wk))
    f_start = F.col("_pl").isNull() | ((F.col("_f.r") - F.col("_pl.r") > 1) if gaps else F.lit(False))
    f_same = unchanged({c: F.col("_pl").getField("a_" + c) for c in attrs},
                       {c: F.col("_f").getField("a_" + c) for c in attrs}, spec.compare)
    seg = seg.withColumns({"_f_start": f_start, "_f_chg": f_start | ~f_same})
    seg = seg.withColumns({
        "_seg_chg": F.coalesce("_mod0", F.greatest(F.col("_in_chg"), F.when(F.col("_f_chg"), F.col("_f.t")))),
        "_seg_start": F.coalesce("_disc0", F.greatest(F.col("_in_start"), F.when(F.col("_f_start"), F.col("_f.t"))))})
    seg = seg.select(*keys, "_seg", "_f_start", "_f_chg",
                     *[F.col("_pl").getField("a_" + c).alias("_pl_" + c) for c in attrs],
                     F.max("_seg_chg").over(before).alias("_carry_mod"),
                     F.max("_seg_start").over(before).alias("_carry_disc"))

    # pass 2: final columns inside each segment
    y = lookup(x.filter(F.col("_rank") > 0), seg, [*keys, "_seg"])
    is_first = F.col("_first")
    y = y.withColumns({
        "_start": F.when(is_first, F.col("_f_start")).otherwise(F.col("_start_in")),
        "_changed": F.when(is_first, F.col("_f_chg")).otherwise(F.col("_chg_in")),
        **{"_prev_" + c: F.when(is_first, F.col("_pl_" + c)).otherwise(F.col("_p_" + c)) for c in attrs}})
    y = y.withColumns({
        "modified_at": F.coalesce(F.max(F.when(F.col("_changed"), F.col(NOW))).over(run), F.col("_carry_mod")),
        "discovered_at": F.coalesce(F.max(F.when(F.col("_start"), F.col(NOW))).over(run), F.col("_carry_disc"))})
    y = y.withColumn("_pm", F.when(is_first, F.col("_carry_mod")).otherwise(F.lag("modified_at").over(ws)))
    cols = {}
    if spec.velocity:
        applies = F.lit(True) if spec.velocity == "all" else (F.col("offset_type") == F.lit(spec.velocity))
        v = velocity(F.col("offset"), F.col("_prev_offset"), F.col(NOW), F.col("_pm"))
        cols["velocity"] = (F.when(F.col("_start"), F.lit(None).cast("double"))
                            .when(~F.col("_changed"), F.when(applies, F.lit(0.0)))
                            .otherwise(F.when(applies, v)))
    cols["action"] = (F.when(F.col("_start"), F.lit("insert")).when(F.col("_changed"), F.lit("update"))
                      .otherwise(F.lit("touch")))
    return y.withColumns(cols).select(*spec.columns, "_rank", "action")


def replay(history: DataFrame, spec: TableSpec, *, gaps: bool | None = None, segment: int = DEFAULT_SEGMENT,
           reads: DataFrame | None = None, scope=None) -> DataFrame:
    """State rows after every capture: keys, attributes, velocity (if the
    table has one), audit triple and ``action`` (insert / update / touch).

    ``reads`` (scope columns, refreshed_at): all reads of each scope unit,
    also those that found nothing; without it, the captures that have rows.
    """
    gaps = spec.delete_stale if gaps is None else gaps
    none = F.lit(None).cast(history.schema[NOW].dataType)
    rows = _ranked(history, spec, reads, scope).withColumns({"_mod0": none, "_disc0": none})
    return replayed_steps(rows, spec, gaps, segment).drop("_rank")


def fold(state: DataFrame, history: DataFrame, spec: TableSpec, *, reads: DataFrame | None = None, scope=None,
         segment: int = DEFAULT_SEGMENT) -> DataFrame:
    """The state after applying every capture of ``history`` in order: the
    table's columns, ``action`` (insert / update / touch / keep / delete,
    against ``state``) and ``_dups`` (rows given for the key). Every capture
    must be after the stored rows it meets."""
    keys, scope = list(spec.keys), list(scope or spec.keys[:1])
    per_capture = reduce_duplicates(history.select(*keys, *spec.attrs, NOW), [*keys, NOW], count_col="_n")
    none = F.lit(None).cast(history.schema[NOW].dataType)
    ranked = (_ranked(per_capture.drop("_n"), spec, reads, scope)
              .withColumns({"_mod0": none, "_disc0": none}))
    stored = state.select(*keys, *spec.attrs, NOW, F.lit(0).cast("bigint").alias("_rank"),
                          F.col("modified_at").alias("_mod0"), F.col("discovered_at").alias("_disc0"))
    steps = replayed_steps(ranked.unionByName(stored), spec, spec.delete_stale, segment)
    kept = state.select(*spec.columns, F.lit(0).cast("bigint").alias("_rank"), F.lit("keep").alias("action"))
    rest = [c for c in spec.columns if c not in keys]
    last = (steps.unionByName(kept).groupBy(*keys)
            .agg(F.max(F.struct("_rank", "action", *rest)).alias("_r"), (F.min("_rank") == 0).alias("_had"))
            .select(*keys, *[F.col("_r").getField(c).alias(c) for c in rest], F.col("_r._rank").alias("_rank"),
                    F.col("_r.action").alias("action"), "_had"))
    given = per_capture.groupBy(*keys).agg(F.sum("_n").alias("_dups"))
    last = lookup(last, given, keys, "left")
    if spec.delete_stale:
        known = (reads if reads is not None else history).select(*scope, NOW).unionByName(history.select(*scope, NOW))
        ends = capture_ranks(known, scope).groupBy(*scope).agg(F.max("_rank").alias("_end"))
        last = lookup(last, ends, scope, "left")
        gone = F.coalesce(F.col("_rank") < F.col("_end"), F.lit(False))
    else:
        gone = F.lit(False)
    action = (F.when(gone, F.when(F.col("_had"), F.lit("delete")))     # came and went within the captures: NULL
              .when(~F.col("_had"), F.lit("insert")).when(F.col("action") == "insert", F.lit("update"))
              .otherwise(F.col("action")))
    return last.withColumn("action", action).filter("action is not null").select(*spec.columns, "action", "_dups")


def latest_state(replayed: DataFrame, spec: TableSpec, last_reads: DataFrame | None = None, scope=None) -> DataFrame:
    """The state after the last capture: per key its last row (grouped
    ``max`` of a struct, combined map-side). Tables that remove stale rows need
    ``last_reads`` (scope columns, refreshed_at of each unit's last read): keys
    that it did not find are dropped."""
    keys = list(spec.keys)
    cols = [c for c in replayed.columns if c not in keys]
    last = (replayed.groupBy(*keys).agg(F.max(F.struct(F.col(NOW).alias("_t"), *cols)).alias("_r"))
            .select(*keys, *[F.col("_r").getField(c).alias(c) for c in cols]))
    if spec.delete_stale:
        if last_reads is None:
            raise ValueError("a table with stale delete needs the last read of each cluster")
        scope = list(scope or keys[:1])
        last = lookup(last, last_reads.select(*scope, NOW), [*scope, NOW], "left_semi")
    return last.drop("action")

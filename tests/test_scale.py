"""What bounds a task: no shuffle on the cluster alone, files of bounded rows, no aggregation of whole files in memory."""

import glob

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from fixtures import T0, snapshot
from snaptide.plans import refresh, state
from snaptide.plans.refresh import refresh_metadata
from snaptide.plans.state import StateStore
from snaptide.schemas import SNAPSHOT, relaxed


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def many_topics(spark, n, parts):
    """One capture of one cluster, a topic a chunk row, in ``parts`` partitions."""
    row = spark.createDataFrame([snapshot(T0)], relaxed(SNAPSHOT))
    name = F.col("id").cast("string")
    topic = F.array(F.struct(F.concat(F.lit("T"), name).alias("k_topic_id"), F.concat(F.lit("n"), name).alias("name"),
                             F.lit(False).alias("internal")))
    return spark.range(0, n, 1, parts).crossJoin(F.broadcast(row.drop("topics"))).withColumn("topics", topic).drop("id")


def test_first_refresh_does_not_gather_a_cluster(spark, tmp_root):
    store = StateStore(spark, tmp_root)
    p = plan(refresh._after(many_topics(spark, 40, 4), store.read("_seen"), "metadata"))
    assert "Exchange hashpartitioning" not in p and "Join LeftOuter" not in p


def test_captured_rows_stay_in_the_tasks_of_the_input(spark, tmp_root, monkeypatch):
    store, files = StateStore(spark, tmp_root), []
    drop = StateStore.drop_side
    monkeypatch.setattr(StateStore, "drop_side", lambda self, v, n: (
        files.extend(glob.glob(f"{tmp_root}/_side/v={v}/{n}/*.parquet")), drop(self, v, n)))
    refresh_metadata(store, many_topics(spark, 40, 4), tables=("topics",))
    assert len(files) == 4
    assert store.read("topics").count() == 40
    assert not glob.glob(f"{tmp_root}/_side/v=0/rows*")


def test_files_hold_a_bounded_number_of_rows(spark, tmp_root, monkeypatch):
    monkeypatch.setattr(state, "FILE_ROWS", 10)
    store = StateStore(spark, tmp_root)
    refresh_metadata(store, many_topics(spark, 40, 1), tables=("topics",))
    found = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{tmp_root}/topics/v=0/*/*.parquet")]
    assert sum(found) == 40 and max(found) <= 10


def test_absent_tables_cost_no_shuffle(spark, tmp_root):
    store = StateStore(spark, tmp_root)
    rows = spark.range(100).select(F.lit("k1").alias("k_cluster_id"), F.col("id").cast("string").alias("k_topic_id"))
    p = plan(rows.join(store.read("topics").select("k_cluster_id", "k_topic_id"), ["k_cluster_id", "k_topic_id"], "left_anti"))
    assert "Exchange" not in p and "Join" not in p


def test_integrity_collects_no_keys_of_files(spark, tmp_root):
    """Keys are dealt out before they are counted; a parent's keys are not made distinct for an anti join."""
    from snaptide.operators.integrity import integrity_report
    store = StateStore(spark, tmp_root)
    refresh_metadata(store, many_topics(spark, 40, 2), tables=("topics",))
    before = [node for node in plan(integrity_report({"topics": store.read("topics")})).split("\n")]
    scan = next(i for i, line in enumerate(before) if "FileScan" in line)
    above = [line for line in before[:scan] if "Exchange" in line or "HashAggregate" in line]
    assert "Exchange hashpartitioning(k_cluster_id" in above[-1] and "HashAggregate" in above[-2]


def test_binding_lookup_deals_pairs_out_once(spark):
    """With no broadcast: lines twice (order, supplier), pairs by principal, pairs by resource."""
    from snaptide.plans import registry
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(registry.QUERIES["lookup_binding"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert p.count("hashpartitioning(principal") == 2 and p.count("hashpartitioning(resource_name") == 2


def test_report_items_are_made_by_compiled_code(spark):
    """No lambda over arrays: those are interpreted element by element, outside of compiled stages."""
    from snaptide.operators.report import snapshot_report
    p = plan(snapshot_report(many_topics(spark, 40, 4)))
    assert "lambda" not in p and "transform(" not in p


def test_report_tells_null_from_empty_and_counts_items_once(spark):
    from snaptide.operators.report import METRICS, snapshot_report
    row = snapshot(T0)
    found = {(r.metric, r.value) for r in snapshot_report(spark.createDataFrame([row, row], relaxed(SNAPSHOT))).collect()}
    once = {(r.metric, r.value) for r in snapshot_report(spark.createDataFrame([row], relaxed(SNAPSHOT))).collect()}
    assert found == once and len(found) == len(METRICS)
    empty = spark.createDataFrame([("k1", "k1", T0, 0, [])], "k_cluster_id string, cluster_name string, captured_at timestamp, "
                                  "controller_id int, nodes array<struct<id:int,host:string,port:int,rack:string>>")
    none = {f.name: F.lit(None).cast(f.dataType) for f in relaxed(SNAPSHOT).fields if f.name not in empty.columns}
    assert [r.value for r in snapshot_report(empty.withColumns(none)).collect()] == [0] * len(METRICS)


def test_children_of_removed_parents_are_joined_once(spark, tmp_root):
    """What stays and what goes of a table come from one join with the removed parents."""
    store = StateStore(spark, tmp_root)
    run = refresh._Run(store, spark.createDataFrame([("k1",)], "k_cluster_id string"))
    keys = spark.createDataFrame([("k1", "a"), ("k1", "b"), ("k1", None)], "k_cluster_id string, k_topic_id string")
    run.removed["topics"] = keys.filter("k_topic_id = 'a'").unionByName(keys.filter("k_topic_id = 'a'"))
    marked = run._marked("topic_partitions", keys)
    assert marked.columns == ["k_cluster_id", "k_topic_id", "_lost"]
    assert sorted((r.k_topic_id or "", r._lost) for r in marked.collect()) == [("", False), ("a", True), ("b", False)]
    assert plan(marked).split("== Initial Plan ==")[-1].count("Join") == 1


def test_rows_of_keys_alone_are_not_sorted_to_be_reduced(spark):
    """Tables without attributes: one time a key, combined by hash before the shuffle."""
    from snaptide.operators.merge import reduce_duplicates
    rows = spark.createDataFrame([("k1", "a", 2), ("k1", "a", None), ("k1", "a", 5), ("k1", "b", None), (None, "b", 1)],
                                 "k string, r string, t int")
    found = reduce_duplicates(rows, ["k", "r"], order=("t",), count_col="_dups")
    assert "SortAggregate" not in plan(found) and found.columns == ["k", "r", "t", "_dups"]
    assert sorted(map(tuple, found.collect()), key=repr) == [("k1", "a", 5, 3), ("k1", "b", None, 1), (None, "b", 1, 1)]


def test_captured_rows_of_a_backlog_are_not_broadcast(spark, tmp_root):
    """Many rows of few values make small files; they are dealt out by the parent's key all the same."""
    from snaptide.plans import backlog
    key = [F.lit("k1").alias("k_cluster_id"), (F.col("id") % 3).cast("string").alias("k_topic_id")]
    at = F.timestamp_seconds(F.lit(60)).alias("refreshed_at")
    store = StateStore(spark, tmp_root)
    rows = store.stage_side(0, "r", backlog._free(spark.range(1000).select(*key, at)))
    lives = store.stage_side(0, "l", spark.range(2).select(*key, F.timestamp_seconds(F.lit(30)).alias("_from"),
                                                           F.timestamp_seconds(30 + F.col("id") * 60).alias("_until")))
    found = backlog._under(rows, lives, ["k_cluster_id", "k_topic_id"])
    assert "Broadcast" not in plan(found)
    assert found.count() == 333 and {r.k_topic_id for r in found.select("k_topic_id").distinct().collect()} == {"1"}


def test_rows_are_sorted_by_columns_of_many_values_first(spark):
    """The cluster is the same in nearly all rows: sorted by it first, every two rows have to be looked at whole."""
    from snaptide.operators.joins import lookup
    from snaptide.operators.merge import merge_snapshot, reduce_duplicates
    from snaptide.schemas import TABLES
    spec = TABLES["topics"]
    rows = spark.createDataFrame([("k1", "a", "n", False, T0), ("k1", "a", "o", False, T0)], "k_cluster_id string, "
                                 "k_topic_id string, name string, internal boolean, refreshed_at timestamp")
    state = rows.limit(1).select("*", *[F.col("refreshed_at").alias(c) for c in ("discovered_at", "modified_at")])
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = lookup(rows, state.select("k_cluster_id", "k_topic_id", "modified_at"), ["k_cluster_id", "k_topic_id"])
        plans = [plan(found), plan(merge_snapshot(state, rows, spec)), plan(reduce_duplicates(rows, spec.keys))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert found.columns == [*rows.columns, "modified_at"]
    for p in plans:
        sorts = [line for line in p.split("\n") if "Sort [" in line]
        assert sorts and all("Sort [k_topic_id" in line for line in sorts)
    assert [(r.name, r.n) for r in reduce_duplicates(rows, spec.keys, count_col="n").collect()] == [("o", 2)]


def test_topic_names_are_compared_without_sorting_topics(spark):
    rows = spark.createDataFrame([snapshot(T0)], relaxed(SNAPSHOT))
    grouped = [line for line in plan(refresh.capture_order(rows)).split("\n") if "Aggregate(keys=[name#" in line]
    assert grouped and not any("SortAggregate" in line for line in grouped)
    twice = rows.withColumn("topics", F.array_append("topics", F.struct(F.lit("T-new").alias("k_topic_id"),
                                                     F.col("topics")[0]["name"].alias("name"), F.lit(False).alias("internal"))))
    assert [r.status for r in refresh.capture_order(rows).collect()] == ["applied"]
    assert [r.status for r in refresh.capture_order(twice).collect()] == ["failed"]
    same = rows.withColumn("topics", F.concat("topics", "topics"))
    assert [r.status for r in refresh.capture_order(same).collect()] == ["applied"]


def test_given_rows_are_counted_as_they_are_written(spark):
    """By compiled code, from columns of their own; lists that are NULL count for nothing, the others of their row do."""
    entry = "named_struct('name', 'a', 'value', 'b', 'source', 's', 'sensitive', false, 'read_only', false, 'type', 't', 'documentation', '')"
    of = lambda n: f"named_struct('k_topic_id', 'T', 'entries', array({', '.join([entry] * n)}))"
    parts = ("array(named_struct('k_topic_id', 'T', 'name', 'n', 'partitions', array(named_struct('partition', 0, 'leader', 1, "
             "'replicas', array(1, 2), 'isr', array(1)), named_struct('partition', 1, 'leader', 1, 'replicas', {}, 'isr', array(1)))))")
    rows = spark.createDataFrame([snapshot(T0)], relaxed(SNAPSHOT)).withColumns(
        {"topics": F.lit(None).cast(relaxed(SNAPSHOT)["topics"].dataType), "acl_bindings": F.array().cast(relaxed(SNAPSHOT)["acl_bindings"].dataType)})
    whole = rows.withColumns({"topic_configs": F.expr(f"array({of(2)}, {of(3)})"), "topic_descriptions": F.expr(parts.format("array(3)"))})
    torn = rows.withColumns({"topic_configs": F.expr(f"array({of(2)}, named_struct('k_topic_id', 'U', 'entries', null))"),
                             "topic_descriptions": F.expr(parts.format("null"))})
    assert "lambda" not in plan(refresh._counted(whole))
    for df, configs, replicas in ((whole, 5, 3), (torn, 2, 2), (whole.unionByName(torn, allowMissingColumns=True), 7, 5)):
        given, read = refresh._given(refresh._counted(df))
        assert (given["topic_configs"], given["partition_replicas"]) == (configs, replicas)
        assert given["topics"] == 0 and read == {"topics": False, "consumer_groups": True, "acl_bindings": True}


def test_merged_rows_are_written_once_and_never_cached(spark, tmp_root, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic
    monkeypatch.setattr(Classic, "persist", lambda self, *a: (_ for _ in ()).throw(AssertionError("cached")))
    from fixtures import later
    store = StateStore(spark, tmp_root)
    first = spark.createDataFrame([snapshot(T0)], relaxed(SNAPSHOT))
    refresh_metadata(store, first)
    before = {n: store.read(n).count() for n in ("topics", "topic_configs", "topic_partitions", "partition_replicas")}
    # leftovers of a failed attempt at the next version are replaced
    store.stage(1, "topics", store.read("topics").withColumn("k_topic_id", F.lit("left over")))
    second = spark.createDataFrame([snapshot(later(1), drop_topic=True)], relaxed(SNAPSHOT))
    result = refresh_metadata(store, second)
    after = {n: store.read(n) for n in before}
    gone = {r.k_topic_id for r in result.removed["topics"].collect()}
    assert len(gone) == 1 and all(after[n].count() + result.removed[n].count() == before[n] for n in before if n in result.removed)
    assert all(not {r.k_topic_id for r in after[n].collect()} & (gone | {"left over"}) for n in before)
    acct = {(r.table_name, r.metric): r.value for r in result.accounting.collect()}
    assert acct["topics", "delete"] == 1 and acct["topics", "touch"] + acct["topics", "update"] == before["topics"] - 1
    assert not glob.glob(f"{tmp_root}/_side/v=*/parts-*")


def test_derived_captures_are_made_without_casts(spark):
    from snaptide.plans.refresh_queries import _topic_rows
    from snaptide.sources.tables import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    rows = _topic_rows(t.orders, t.lineitem, True)
    assert "cast(array" not in plan(rows) and relaxed(rows.schema) == relaxed(SNAPSHOT)

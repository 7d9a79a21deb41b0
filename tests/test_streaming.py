from pyspark.sql import functions as F

from snaptide.operators.offsets import clean_partition_offsets
from snaptide.operators.replay import latest_state, replay
from snaptide.schemas import PARTITION_OFFSETS, TABLES
from snaptide.streaming.refresh_stream import start_capture_history

SF = "/root/testdata/sf0.001"


def daily_latest_captures(spark):
    """LATEST offset per (event type, user % 4) at the end of each day with records."""
    ev = spark.read.parquet(f"{SF}/events.parquet")
    day_end = (F.date_trunc("day", "ts") + F.expr("INTERVAL 1 DAY")).cast("timestamp")
    g = ev.groupBy("event_type", (F.col("user_id") % 4).cast("int").alias("partition"), day_end.alias("captured_at")) \
        .agg((F.max("event_id") + 1).alias("offset"))
    return g.select(F.lit("k1").alias("k_cluster_id"), "captured_at", F.col("event_type").alias("k_topic_id"),
                    "partition", F.lit("LATEST").alias("offset_type"), "offset",
                    F.lit(-1).cast("bigint").alias("timestamp_ms"), F.lit(None).cast("int").alias("leader_epoch"))


def test_stream_history_replay_equals_batch(spark, tmp_root):
    caps = daily_latest_captures(spark)
    days = sorted(r.captured_at for r in caps.select("captured_at").distinct().collect())
    src = f"{tmp_root}/incoming"
    # captures arrive as one folder of files per day
    for i, d in enumerate(days):
        caps.filter(F.col("captured_at") == F.lit(d)).write.mode("append").parquet(f"{src}/day={i:02d}")
    q = start_capture_history(spark, f"{src}/*", f"{tmp_root}/history", f"{tmp_root}/ckpt", schema=PARTITION_OFFSETS,
                              available_now=True)
    q.awaitTermination(300)
    assert q.exception() is None
    hist = spark.read.schema(PARTITION_OFFSETS).parquet(f"{tmp_root}/history")
    spec = TABLES["partition_offsets"]

    def state_of(frame):
        rows = clean_partition_offsets(frame).withColumnRenamed("partition", "k_partition_id")
        return latest_state(replay(rows, spec, gaps=False), spec)

    got = sorted(map(tuple, state_of(hist).collect()))
    want = sorted(map(tuple, state_of(caps).collect()))
    assert got == want and len(got) == caps.select("k_topic_id", "partition").distinct().count()
    # a second run of the same query finds nothing new (exactly once through the sink log)
    q2 = start_capture_history(spark, f"{src}/*", f"{tmp_root}/history", f"{tmp_root}/ckpt",
                               schema=PARTITION_OFFSETS, available_now=True)
    q2.awaitTermination(300)
    assert spark.read.schema(PARTITION_OFFSETS).parquet(f"{tmp_root}/history").count() == caps.count()


def test_micro_batch_bodies_and_retries(spark, tmp_root):
    """The foreachBatch bodies, driven with static frames (the streaming
    engine itself needs a Python callback port, not opened in tests)."""
    import sys
    sys.path.insert(0, "tests")
    from fixtures import later, snapshot
    from snaptide.plans.state import StateStore
    from snaptide.schemas import GROUP_OFFSETS, SNAPSHOT, relaxed
    from snaptide.streaming.refresh_stream import metadata_batch, offset_batch

    meta_root, off_root = f"{tmp_root}/meta", f"{tmp_root}/off"
    meta = metadata_batch(meta_root)
    meta(spark.createDataFrame([snapshot(later(0))], relaxed(SNAPSHOT)), 0)
    meta(spark.createDataFrame([snapshot(later(1), drop_topic=True)], relaxed(SNAPSHOT)), 1)
    # epoch 1 retried (e.g. after a lost executor): nothing new is committed
    meta(spark.createDataFrame([snapshot(later(1), drop_topic=True)], relaxed(SNAPSHOT)), 1)
    store = StateStore(spark, meta_root)
    assert store.latest()["version"] == 1 and store.read("topics").count() == 1
    offs = offset_batch(off_root, metadata_root=meta_root)
    go = spark.createDataFrame([("k1", later(2), "g1", "alpha", 0, 7, None, None)], relaxed(GROUP_OFFSETS))
    offs(go, 0)
    offs(go, 0)
    o = StateStore(spark, off_root)
    assert o.latest()["version"] == 0 and o.read("consumer_group_offsets").count() == 1


def known_state(spark, root):
    """A store whose metadata tables are published directly."""
    from fixtures import later
    from snaptide.plans.state import StateStore

    store = StateStore(spark, root)
    audit = {a: F.lit(later(0)) for a in ("discovered_at", "modified_at", "refreshed_at")}

    def table(rows, kind):
        return spark.createDataFrame(rows, kind).withColumns(audit)

    store.publish({
        "topics": table([("k1", "T-a", "alpha", False)], "k_cluster_id string, k_topic_id string, name string, internal boolean"),
        "topic_partitions": table([("k1", "T-a", 0)], "k_cluster_id string, k_topic_id string, k_partition_id int"),
        "consumer_groups": table([("k1", g, 1, False, "STABLE", None) for g in ("g1", "g2", "g3")],
                                 "k_cluster_id string, group_id string, coordinator_id int, simple boolean, state string, "
                                 "partition_assignor string")})
    return store


def test_read_marks_empty_a_group_in_a_micro_batch(spark, tmp_root):
    """g1 was read and has no commits left, g2 was not read, g3 has one still."""
    from fixtures import later
    from snaptide.plans.state import StateStore
    from snaptide.schemas import GROUP_EVENTS
    from snaptide.streaming.refresh_stream import offset_batch

    meta, root = known_state(spark, f"{tmp_root}/meta"), f"{tmp_root}/off"
    body = offset_batch(root, kind="group_events", metadata_root=meta.root)

    def events(*rows):
        return spark.createDataFrame(rows, GROUP_EVENTS)

    def commit(g, at, offset):
        return ("commit", "k1", later(at), g, "alpha", 0, offset, None, None, None)

    def mark(g, at, read):
        return ("read", "k1", later(at), g, None, None, None, None, None, read)

    body(events(*[commit(g, 1, 5) for g in ("g1", "g2", "g3")]), 0)
    batch = events(mark("g1", 2, True), mark("g2", 2, False), commit("g3", 2, 9))
    body(batch, 1)
    store = StateStore(spark, root)
    got = {r.group_id: (r.offset, r.refreshed_at) for r in store.read("consumer_group_offsets").collect()}
    assert set(got) == {"g2", "g3"} and got["g2"][0] == 5 and got["g3"][0] == 9 and got["g2"][1] < got["g3"][1]
    version = store.latest()["version"]
    body(batch, 1)                                         # retried
    assert store.latest()["version"] == version


def test_offsets_resolved_in_the_streaming_plan(spark, tmp_root):
    from fixtures import later
    from snaptide.streaming.refresh_stream import resolved_offsets, start_resolved_offsets

    meta = known_state(spark, f"{tmp_root}/meta")
    caps = spark.createDataFrame([("k1", later(1), t, p, "LATEST", o, -1, None) for t, p, o in
                                  (("T-a", 0, 4), ("T-a", 1, 5), ("T-x", 0, 6), ("T-a", 0, -1))], PARTITION_OFFSETS)
    caps.write.parquet(f"{tmp_root}/in")
    q = start_resolved_offsets(spark, f"{tmp_root}/in", meta.root, f"{tmp_root}/out", f"{tmp_root}/ckpt", available_now=True)
    q.awaitTermination(300)
    assert q.exception() is None
    cols = ("k_cluster_id", "k_topic_id", "k_partition_id", "offset")
    got = sorted((tuple(r[c] for c in cols) for r in spark.read.parquet(f"{tmp_root}/out").collect()), key=repr)
    assert got == [("k1", "T-a", 0, 4), ("k1", "T-a", 0, None)]
    assert sorted((tuple(r[c] for c in cols) for r in resolved_offsets(caps, meta).collect()), key=repr) == got


def test_bad_documents_are_kept_apart(spark, tmp_root):
    import json
    import pathlib

    from snaptide.sources.snapshots import read_checked_snapshots

    good = dict(k_cluster_id="k1", cluster_name="m", captured_at="2024-05-01T12:00:00Z", controller_id=1, nodes=[],
                topics=[dict(k_topic_id="T", name="n", internal=False)], extra="ignored")
    lines = [json.dumps(good), json.dumps(good)[:-9], "", "not json", json.dumps(dict(good, controller_id="one")),
             json.dumps({k: v for k, v in good.items() if k != "captured_at"}), json.dumps(dict(good, nodes=None)), "[]"]
    path = pathlib.Path(tmp_root, "docs.json")
    path.write_text("\n".join(lines))
    rows, bad = read_checked_snapshots(spark, str(path))
    assert [(r.k_cluster_id, len(r.topics)) for r in rows.collect()] == [("k1", 1)]
    found = [(r.reason, r.raw_document) for r in bad.collect()]
    assert sorted(reason for reason, _ in found).count("malformed") >= 3 and ("malformed", "not json") in found
    assert sum(reason == "incomplete" for reason, _ in found) >= 2 and all("docs.json" in r.source_file for r in bad.collect())


def test_integrity_links(spark, tmp_root):
    from snaptide.operators.integrity import integrity_report, links

    assert len(links()) == len({(c, p) for c, p, _ in links()}) >= 24
    store = known_state(spark, tmp_root)
    found = {(r.check, r.table_name, r.parent): r.n_keys for r in integrity_report(store.read_all()).collect()}
    # no clusters and no nodes are published: everything lacks its cluster, groups their coordinator
    assert found == {("orphan", "topics", "clusters"): 1, ("orphan", "topic_partitions", "clusters"): 1,
                     ("orphan", "consumer_groups", "clusters"): 3, ("orphan", "consumer_groups", "nodes"): 3}

import pathlib
from datetime import datetime, timedelta, timezone

import pytest

from fixtures import later, snapshot
from snaptide.plans.refresh import refresh_metadata, refresh_offsets
from snaptide.plans.state import StateStore
from snaptide.schemas import GROUP_OFFSETS, PARTITION_OFFSETS, RECORD_LOG, SNAPSHOT, TABLES, relaxed
from snaptide.sources.snapshots import read_group_offsets, read_group_reads, read_record_log, read_snapshots


def snaps(spark, *items):
    return spark.createDataFrame([{"chunk_index": None, "chunk_count": None, **i} for i in items], relaxed(SNAPSHOT))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_first_refresh_builds_all_tables(spark, tmp_root):
    res = refresh_metadata(StateStore(spark, tmp_root), snaps(spark, snapshot(later(0))))
    t = res.tables
    # Node 3 is a quorum voter without a live node -> placeholder; flags from the quorum
    assert rows(t["nodes"], "k_node_id", "host", "port", "controller", "leader", "voter", "observer") == [
        (1, "h1", 9092, True, True, True, False), (2, "h2", 9092, False, False, False, True),
        (3, None, -1, False, False, True, False)]
    # Configs of live nodes only
    assert rows(t["node_configs"], "k_node_id", "name", "value") == [(1, "log.dirs", "/d1"), (1, "secret", None)]
    assert rows(t["topics"], "k_topic_id", "name", "internal") == [("T-a", "alpha", False), ("T-b", "beta", True)]
    assert rows(t["topic_partitions"], "k_topic_id", "k_partition_id") == [("T-a", 0), ("T-a", 1), ("T-b", 0)]
    # P3 (no leader -> false), P4, P5 / Q6 (current copy before the future one)
    assert rows(t["partition_replicas"], "k_topic_id", "k_partition_id", "k_node_id", "leader", "in_sync", "size",
                "future") == [("T-a", 0, 1, True, True, 20, False), ("T-a", 0, 2, False, False, None, None),
                              ("T-a", 1, 2, False, False, None, None), ("T-b", 0, 1, False, True, None, None),
                              ("T-b", 0, 2, True, True, None, None)]
    # Group with unknown coordinator dropped
    assert rows(t["consumer_groups"], "group_id") == [("g1",)]
    assert rows(t["consumer_group_members"], "member_id") == [("m1",), ("m2",)]
    # Unknown topic name drops the assignment; each stays with its own member (Q2 default)
    assert rows(t["consumer_group_member_assignments"], "member_id", "k_topic_id", "k_partition_id") == [
        ("m1", "T-a", 0), ("m2", "T-b", 0)]
    assert t["acl_resources"].count() == 1 and t["acl_entries"].count() == 2 and t["acl_bindings"].count() == 2
    acct = {(r.table_name, r.metric): r.value for r in res.accounting.collect()}
    # A5: two groups submitted, one with an unknown coordinator
    assert acct[("consumer_groups", "submitted")] == 2 and acct[("consumer_groups", "unresolved")] == 1
    assert acct[("consumer_group_member_assignments", "unresolved")] == 1
    assert acct[("nodes", "insert")] == 3 and acct[("nodes", "unresolved")] == 0


def test_second_refresh_deletes_and_cascades(spark, tmp_root):
    store = StateStore(spark, tmp_root)
    refresh_metadata(store, snaps(spark, snapshot(later(0))))
    # topic beta gone, groups section empty, ACL section not read (NULL)
    second = refresh_metadata(store, snaps(spark, snapshot(later(1), drop_topic=True, groups="empty", acls=False)))
    t = store.read_all()
    assert rows(t["topics"], "k_topic_id") == [("T-a",)]
    assert rows(t["topic_partitions"], "k_topic_id", "k_partition_id") == [("T-a", 0), ("T-a", 1)]
    assert rows(t["topic_configs"], "k_topic_id") == [("T-a",)]
    assert {r.k_topic_id for r in t["partition_replicas"].collect()} == {"T-a"}
    assert t["consumer_groups"].count() == 0
    assert t["consumer_group_members"].count() == 0       # Q4: members go with their group
    assert t["consumer_group_member_assignments"].count() == 0
    assert t["acl_bindings"].count() == 2                  # Q5: NULL section deletes nothing
    removed = {k: v.count() for k, v in second.removed.items()}
    assert removed["topics"] == 1 and removed["topic_partitions"] == 1 and removed["consumer_groups"] == 1
    # audit triple: touched topic keeps discovered/modified, refreshed moves
    a = t["topics"].collect()[0]
    assert a.discovered_at == a.modified_at < a.refreshed_at


def test_old_or_repeated_capture_is_skipped(spark, tmp_root):
    store = StateStore(spark, tmp_root)
    refresh_metadata(store, snaps(spark, snapshot(later(2))))
    before = {n: sorted(map(tuple, store.read(n).collect())) for n in TABLES}
    for at in (later(2), later(1)):
        res = refresh_metadata(store, snaps(spark, snapshot(at, drop_topic=True, groups="empty")))
        for n in TABLES:
            assert sorted(map(tuple, res.tables[n].collect())) == before[n], n


def test_quorum_absent_gives_null_flags(spark, tmp_root):
    t = refresh_metadata(StateStore(spark, tmp_root), snaps(spark, snapshot(later(0), quorum=False))).tables
    assert rows(t["nodes"], "k_node_id", "leader", "voter", "observer") == [(1, None, None, None),
                                                                            (2, None, None, None)]


def test_offsets_refresh_with_record_log(spark, tmp_root):
    store = StateStore(spark, tmp_root)
    refresh_metadata(store, snaps(spark, snapshot(later(0))))
    at1, at2 = later(1), later(1) + timedelta(seconds=4)
    log = spark.createDataFrame(
        [("k1", "alpha", 0, o, datetime(2024, 5, 1, 11, 0, o, tzinfo=timezone.utc)) for o in (5, 6, 8, 9)],
        "k_cluster_id string, topic string, partition int, offset long, timestamp timestamp")
    go = spark.createDataFrame([
        ("k1", at1, "g1", "alpha", 0, 7, "meta", 3),   # gap: next record is offset 8
        ("k1", at1, "g1", "beta", 0, 2, None, None),   # no log for beta: NULL timestamp
        ("k1", at1, "g9", "alpha", 0, 6, None, None),  # unknown group: dropped
    ], relaxed(GROUP_OFFSETS))
    po = spark.createDataFrame([
        ("k1", at1, "T-a", 0, "LATEST", 10, -1, 0), ("k1", at1, "T-a", 0, "EARLIEST", -1, -1, None),
        ("k1", at1, "T-zz", 0, "LATEST", 1, -1, None),   # unknown partition: dropped
    ], relaxed(PARTITION_OFFSETS))
    r1 = refresh_offsets(store, go, po, log)
    cgo = {r.k_topic_id: r for r in r1.tables["consumer_group_offsets"].collect()}
    assert set(cgo) == {"T-a", "T-b"}
    assert cgo["T-a"].offset_timestamp == datetime(2024, 5, 1, 11, 0, 8)
    assert cgo["T-b"].offset_timestamp is None
    pos = {r.offset_type: r for r in r1.tables["partition_offsets"].collect()}
    assert pos["EARLIEST"].offset is None and pos["LATEST"].offset == 10   # P6
    # second round: commit moves 7 -> 9 in 4 s; LATEST 10 -> 18; beta commit vanishes
    go2 = spark.createDataFrame([("k1", at2, "g1", "alpha", 0, 9, "meta", 3)], relaxed(GROUP_OFFSETS))
    po2 = spark.createDataFrame([("k1", at2, "T-a", 0, "LATEST", 18, -1, 0),
                                 ("k1", at2, "T-a", 0, "EARLIEST", 3, -1, 0)], relaxed(PARTITION_OFFSETS))
    r2 = refresh_offsets(store, go2, po2, log)
    cgo2 = {r.k_topic_id: r for r in r2.tables["consumer_group_offsets"].collect()}
    assert set(cgo2) == {"T-a"} and cgo2["T-a"].velocity == 0.5
    pos2 = {r.offset_type: r for r in r2.tables["partition_offsets"].collect()}
    assert pos2["LATEST"].velocity == 2.0 and pos2["EARLIEST"].velocity is None
    # re-running the older capture changes nothing (no re-insert of the vanished commit)
    before = sorted(map(tuple, store.read("consumer_group_offsets").collect()))
    refresh_offsets(store, go, po, log)
    assert sorted(map(tuple, store.read("consumer_group_offsets").collect())) == before


def test_state_store_carries_unchanged_tables(spark, tmp_root):
    store = StateStore(spark, tmp_root)
    v0 = refresh_metadata(store, snaps(spark, snapshot(later(0))), epoch=0).version
    v1 = store.publish({"topics": store.read("topics")}, epoch=1)
    head = store.latest()
    assert (v0, v1) == (0, 1) and head["tables"]["topics"] == [1] and head["tables"]["nodes"] == [0]
    assert store.read("nodes").count() == 3
    assert store.committed_epoch(1) and not store.committed_epoch(2)


def test_offsets_into_their_own_store(spark, tmp_root):
    """An offset stream writes its own store and resolves keys against the
    metadata store (one writer per store)."""
    meta = StateStore(spark, f"{tmp_root}/meta")
    offs = StateStore(spark, f"{tmp_root}/offsets")
    refresh_metadata(meta, snaps(spark, snapshot(later(0))), epoch=0, stream="metadata")
    go = spark.createDataFrame([("k1", later(1), "g1", "alpha", 0, 7, None, None),
                                ("k1", later(1), "g1", "gone", 0, 1, None, None)], relaxed(GROUP_OFFSETS))
    res = refresh_offsets(offs, go, metadata=meta, epoch=0, stream="group_offsets")
    assert rows(res.tables["consumer_group_offsets"], "group_id", "k_topic_id", "offset") == [("g1", "T-a", 7)]
    assert offs.committed_epoch(0, "group_offsets") and not offs.committed_epoch(0, "metadata")
    assert meta.committed_epoch(0, "metadata")
    assert offs.read("topics").count() == 0 and meta.read("consumer_group_offsets").count() == 0


def test_retry_after_failed_refresh(spark, tmp_root):
    """A refresh that died after staging some tables (no commit record) is
    invisible; the retry reuses the version number and overwrites the leftovers."""
    store = StateStore(spark, tmp_root)
    refresh_metadata(store, snaps(spark, snapshot(later(0))))
    version = store.begin()
    store.stage(version, "topics", store.read("topics").limit(0))          # leftover of a failed attempt
    assert store.latest()["version"] == version - 1 and store.read("topics").count() == 2
    res = refresh_metadata(store, snaps(spark, snapshot(later(1), drop_topic=True)))
    assert res.version == version and rows(store.read("topics"), "k_topic_id") == [("T-a",)]


def test_empty_snapshot_removes_only_what_delete_tables_hold(spark, tmp_root):
    store = StateStore(spark, tmp_root)
    refresh_metadata(store, snaps(spark, snapshot(later(0))))
    empty = dict(snapshot(later(1)), nodes=[], quorum=None, node_configs=[], log_dirs=[], topics=[],
                 topic_configs=[], topic_descriptions=[], consumer_groups=[], acl_bindings=[])
    refresh_metadata(store, snaps(spark, empty))
    t = store.read_all()
    for name in ("topics", "topic_configs", "topic_partitions", "partition_replicas", "consumer_groups",
                 "consumer_group_members", "consumer_group_member_assignments", "acl_resources", "acl_entries",
                 "acl_bindings"):
        assert t[name].count() == 0, name
    # nodes are never stale-deleted: they keep their old refreshed_at
    assert t["nodes"].count() == 3 and {r.refreshed_at for r in t["nodes"].collect()} == {
        t["nodes"].collect()[0].discovered_at}


def test_topic_recreated_under_the_same_name(spark, tmp_root):
    store = StateStore(spark, tmp_root)
    refresh_metadata(store, snaps(spark, snapshot(later(0))))
    go = spark.createDataFrame([("k1", later(1), "g1", "alpha", 0, 5, None, None)], relaxed(GROUP_OFFSETS))
    refresh_offsets(store, go)
    assert rows(store.read("consumer_group_offsets"), "k_topic_id", "offset") == [("T-a", 5)]
    s2 = snapshot(later(2))
    for section in ("topics", "topic_configs", "topic_descriptions"):
        for item in s2[section]:
            if item["k_topic_id"] == "T-a":
                item["k_topic_id"] = "T-a2"          # same name "alpha", new id
    res = refresh_metadata(store, snaps(spark, s2))
    assert rows(store.read("topics"), "k_topic_id", "name") == [("T-a2", "alpha"), ("T-b", "beta")]
    # the old id's partitions and the commits resolved through them went with it
    assert {r.k_topic_id for r in store.read("topic_partitions").collect()} == {"T-a2", "T-b"}
    assert store.read("consumer_group_offsets").count() == 0
    assert res.removed["consumer_group_offsets"].count() == 1
    go2 = spark.createDataFrame([("k1", later(3), "g1", "alpha", 0, 9, None, None)], relaxed(GROUP_OFFSETS))
    refresh_offsets(store, go2)
    r = store.read("consumer_group_offsets").collect()
    assert [(x.k_topic_id, x.offset, x.velocity) for x in r] == [("T-a2", 9, None)]   # a new row, no velocity


GO = relaxed(GROUP_OFFSETS)
READS = "k_cluster_id string, captured_at timestamp, group_id string, read boolean"


def commits(spark, *items):
    return spark.createDataFrame([(*i, None, None) for i in items], GO)


def state_of(store, name):
    return sorted(map(repr, store.read(name).collect()))


def test_captures_of_one_batch_are_folded_in_order(spark, tmp_root):
    """offsets 10 -> 30 -> 30 in one batch, as one by one; topics likewise."""
    times = [later(1) + timedelta(seconds=10 * k) for k in range(3)]
    found = {}
    for how in ("batch", "single"):
        store = StateStore(spark, f"{tmp_root}/{how}")
        first, second, third = snapshot(later(0)), snapshot(later(1), drop_topic=True), snapshot(later(2))
        parts = [(first, second, third)] if how == "batch" else [(first,), (second,), (third,)]
        for p in parts:
            refresh_metadata(store, snaps(spark, *p))
        rows_ = [("k1", t, "g1", "alpha", 0, o) for t, o in zip(times, (10, 30, 30))]
        rows_ += [("k1", times[0], "g1", "beta", 0, 1), ("k1", times[2], "g1", "beta", 0, 2)]   # absent in between
        batches = [rows_] if how == "batch" else [[r for r in rows_ if r[1] == t] for t in times]
        for b in batches:
            refresh_offsets(store, commits(spark, *b))
        found[how] = {n: state_of(store, n) for n in TABLES}
    assert found["batch"] == found["single"]
    cgo = {r.k_topic_id: r for r in StateStore(spark, f"{tmp_root}/batch").read("consumer_group_offsets").collect()}
    assert cgo["T-a"].velocity == 0.0 and (cgo["T-a"].refreshed_at - cgo["T-a"].modified_at).total_seconds() == 10
    assert cgo["T-b"].velocity is None and cgo["T-b"].discovered_at == cgo["T-b"].refreshed_at
    topics = {r.k_topic_id: r for r in StateStore(spark, f"{tmp_root}/batch").read("topics").collect()}
    assert topics["T-a"].discovered_at < topics["T-b"].discovered_at == topics["T-b"].refreshed_at


def chunks(snap):
    """The capture in two chunk rows: the first topic's part, and all the rest."""
    one = dict(snap, topics=snap["topics"][:1], topic_configs=snap["topic_configs"][:1],
               topic_descriptions=snap["topic_descriptions"][:1], consumer_groups=None, acl_bindings=None,
               node_configs=[], log_dirs=[], chunk_index=0, chunk_count=2)
    two = dict(snap, topics=snap["topics"][1:], topic_configs=snap["topic_configs"][1:],
               topic_descriptions=snap["topic_descriptions"][1:], chunk_index=1, chunk_count=2)
    return one, two


def test_split_capture_waits_for_its_chunks(spark, tmp_root):
    whole, split = StateStore(spark, f"{tmp_root}/w"), StateStore(spark, f"{tmp_root}/s")
    for store in (whole, split):
        refresh_metadata(store, snaps(spark, snapshot(later(0))))
    before = {n: state_of(split, n) for n in TABLES}
    refresh_metadata(whole, snaps(spark, snapshot(later(1), controller=2)))
    one, two = chunks(snapshot(later(1), controller=2))
    refresh_metadata(split, snaps(spark, one), epoch=7, stream="m")
    assert {n: state_of(split, n) for n in TABLES} == before            # nothing lost, nothing applied
    assert split.read("_pending").count() == 1 and split.committed_epoch(7, "m")
    refresh_metadata(split, snaps(spark, one, two))                     # a chunk may come twice
    assert {n: state_of(split, n) for n in TABLES} == {n: state_of(whole, n) for n in TABLES}
    assert split.read("_pending").count() == 0


def two_groups(snap):
    g = snap["consumer_groups"][0]
    snap["consumer_groups"].append(dict(g, group_id="g2", members=[]))
    return snap


def test_only_groups_that_were_read_lose_offsets(spark, tmp_root):
    store = StateStore(spark, tmp_root)
    refresh_metadata(store, snaps(spark, two_groups(snapshot(later(0))), two_groups(snapshot(later(0), cluster="k2"))))
    t1, t2, t3 = later(1), later(2), later(3)
    refresh_offsets(store, commits(spark, ("k1", t1, "g1", "alpha", 0, 1), ("k1", t1, "g1", "beta", 0, 1),
                                   ("k1", t1, "g2", "alpha", 0, 1), ("k2", t1, "g1", "alpha", 0, 1),
                                   ("k2", t1, "g2", "alpha", 0, 1)))
    # k1: g1 read (beta gone), g2 not read; k2: both read, no commits at all
    reads = spark.createDataFrame([("k1", t2, "g1", True), ("k1", t2, "g2", False), ("k2", t2, "g1", True),
                                   ("k2", t2, "g2", True)], READS)
    refresh_offsets(store, commits(spark, ("k1", t2, "g1", "alpha", 0, 2)), group_reads=reads)
    key = ("k_cluster_id", "group_id", "k_topic_id", "offset")
    assert rows(store.read("consumer_group_offsets"), *key) == [("k1", "g1", "T-a", 2), ("k1", "g2", "T-a", 1)]
    # an older capture cannot bring the emptied cluster back: seen times are kept apart from the rows
    refresh_offsets(store, commits(spark, ("k2", t1, "g1", "alpha", 0, 1)))
    assert rows(store.read("consumer_group_offsets"), *key) == [("k1", "g1", "T-a", 2), ("k1", "g2", "T-a", 1)]
    # reads alone, without any commit rows
    refresh_offsets(store, None, group_reads=spark.createDataFrame([("k1", t3, "g1", True), ("k1", t3, "g2", True)], READS))
    assert store.read("consumer_group_offsets").count() == 0


def test_removed_topics_leave_the_offset_store(spark, tmp_root):
    meta, offs = StateStore(spark, f"{tmp_root}/m"), StateStore(spark, f"{tmp_root}/o")
    refresh_metadata(meta, snaps(spark, snapshot(later(0))))
    po = [("k1", later(1), t, 0, "LATEST", 5, -1, None) for t in ("T-a", "T-b")]
    refresh_offsets(offs, commits(spark, ("k1", later(1), "g1", "beta", 0, 1), ("k1", later(1), "g1", "alpha", 0, 1)),
                    spark.createDataFrame(po, relaxed(PARTITION_OFFSETS)), metadata=meta)
    assert offs.read("partition_offsets").count() == 2
    refresh_metadata(meta, snaps(spark, snapshot(later(2), drop_topic=True)))
    po = [("k1", later(3), "T-a", 0, "LATEST", 6, -1, None)]
    refresh_offsets(offs, None, spark.createDataFrame(po, relaxed(PARTITION_OFFSETS)), metadata=meta,
                    group_reads=spark.createDataFrame([("k1", later(3), "g1", False)], READS))
    assert rows(offs.read("partition_offsets"), "k_topic_id", "offset") == [("T-a", 6)]
    assert rows(offs.read("consumer_group_offsets"), "k_topic_id") == [("T-a",)]


def test_record_log_of_two_clusters(spark, tmp_root):
    store = StateStore(spark, tmp_root)
    refresh_metadata(store, snaps(spark, snapshot(later(0)), snapshot(later(0), cluster="k2")))
    at = [datetime(2024, 5, 1, h, tzinfo=timezone.utc) for h in (1, 2)]
    log = spark.createDataFrame([(c, "alpha", 0, o, t) for c, t in zip(("k1", "k2"), at) for o in (1, 2, 3)],
                                relaxed(RECORD_LOG))
    go = commits(spark, ("k1", later(1), "g1", "alpha", 0, 2), ("k2", later(1), "g1", "alpha", 0, 2))
    refresh_offsets(store, go, record_log=log)
    got = {r.k_cluster_id: r.offset_timestamp for r in store.read("consumer_group_offsets").collect()}
    assert got == {"k1": datetime(2024, 5, 1, 1), "k2": datetime(2024, 5, 1, 2)}
    with pytest.raises(ValueError):
        refresh_offsets(store, commits(spark, ("k1", later(2), "g1", "alpha", 0, 2)), record_log=log.drop("k_cluster_id"))


def test_doubled_topic_name_changes_nothing(spark, tmp_root):
    store = StateStore(spark, tmp_root)
    refresh_metadata(store, snaps(spark, snapshot(later(0))))
    double = snapshot(later(1))
    double["topics"][1]["name"] = "alpha"
    res = refresh_metadata(store, snaps(spark, double))
    assert rows(res.failed, "k_cluster_id", "reason") == [("k1", "failed")]
    assert rows(store.read("topics"), "name") == [("alpha",), ("beta",)]


def test_a_refresh_writes_the_clusters_it_holds(spark, tmp_root):
    store = StateStore(spark, tmp_root)
    refresh_metadata(store, snaps(spark, *[snapshot(later(0), cluster=f"k{c}") for c in (1, 2, 3)]))
    refresh_metadata(store, snaps(spark, snapshot(later(1), cluster="k2", drop_topic=True)))
    written = {f.parent.name for f in pathlib.Path(tmp_root).glob("*/v=1/k_cluster_id=*/*.parquet")}
    assert written == {"k_cluster_id=k2"}
    assert rows(store.read("topics"), "k_cluster_id", "k_topic_id") == [
        ("k1", "T-a"), ("k1", "T-b"), ("k2", "T-a"), ("k3", "T-a"), ("k3", "T-b")]
    assert store.read("topics", version=0).count() == 6
    refresh_metadata(store, snaps(spark, *[snapshot(later(2), cluster=f"k{c}") for c in (1, 2, 3)]))
    assert store.remove_old(keep=1) == [1, 0] and store.versions() == [2]
    assert store.read("topics").count() == 6 and not list(pathlib.Path(tmp_root).glob("topics/v=0"))


def test_readers(spark, tmp_root):
    """JSON and Parquet captures, read with the declared schemas, refresh to the same state."""
    whole = snaps(spark, snapshot(later(0)), snapshot(later(1), drop_topic=True))
    found = []
    for fmt in ("json", "parquet"):
        whole.write.format(fmt).save(f"{tmp_root}/{fmt}")
        store = StateStore(spark, f"{tmp_root}/state-{fmt}")
        refresh_metadata(store, read_snapshots(spark, f"{tmp_root}/{fmt}", fmt))
        found.append({n: state_of(store, n) for n in TABLES})
    assert found[0] == found[1] and found[0]["topics"]
    go = commits(spark, ("k1", later(2), "g1", "alpha", 0, 2))
    go.write.parquet(f"{tmp_root}/go")
    spark.createDataFrame([("k1", "alpha", 0, 2, later(0), "extra")],
                          "k_cluster_id string, topic string, partition int, offset long, timestamp timestamp, key string"
                          ).write.parquet(f"{tmp_root}/log")
    spark.createDataFrame([("k1", later(2), "g1", True)], READS).write.parquet(f"{tmp_root}/reads")
    refresh_offsets(store, read_group_offsets(spark, f"{tmp_root}/go"), record_log=read_record_log(spark, f"{tmp_root}/log"),
                    group_reads=read_group_reads(spark, f"{tmp_root}/reads"))
    assert rows(store.read("consumer_group_offsets"), "k_topic_id", "offset") == [("T-a", 2)]

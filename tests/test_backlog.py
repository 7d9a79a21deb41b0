"""Several captures in one batch against the same captures one by one; hold-back; failing captures."""

import random

import pytest

from fixtures import cfg, later, snapshot
from snaptide.plans.refresh import DuplicateTopicName, refresh_metadata, refresh_offsets
from snaptide.plans.state import StateStore
from snaptide.schemas import TABLES
from test_refresh import chunks, commits, rows, snaps, state_of


def random_snapshot(rng, k, cluster):
    """A capture whose sections change, lose and regain items, or are not read at all."""
    def some(items, p=0.7):
        return [i for i in items if rng.random() < p]

    nodes = [dict(id=i, host=f"h{i}{rng.randrange(2)}", port=9092, rack=None) for i in some([1, 2, 3], 0.8)]
    # t3 and t4 may swap their names; a capture's names are distinct
    swap = rng.random() < 0.4
    names = {"T1": "a", "T2": "b", "T3": "d" if swap else "c", "T4": "c" if swap else "d"}
    held = some(names)
    topics = [dict(k_topic_id=t, name=names[t], internal=rng.random() < 0.3) for t in held]
    described = some([*held, *some(names, 0.2)], 0.9)
    descs = [dict(k_topic_id=t, name=names[t], partitions=[
        dict(partition=p, leader=rng.choice([1, None]), replicas=some([1, 2, 3, 9]), isr=[1]) for p in some(range(2), 0.8)])
        for t in dict.fromkeys(described)]
    configs = [dict(k_topic_id=t, entries=some([cfg("r", str(rng.randrange(2))), cfg("s", None)])) for t in some(names)]
    groups = [dict(group_id=f"g{g}", simple=False, state=rng.choice(["STABLE", "EMPTY"]), partition_assignor=None,
                   coordinator_id=rng.choice([1, 2, 42]),
                   members=[dict(member_id=f"m{m}", group_instance_id=None, client_id="c", host=f"x{rng.randrange(2)}",
                                 assignments=[dict(topic=t, partition=p) for t in some("abcdz", 0.5) for p in some(range(2), 0.6)])
                            for m in some(range(2), 0.8)]) for g in some(range(3))]
    acls = [dict(resource_type="TOPIC", name=n, pattern_type="LITERAL", principal=f"User:{u}", host="*", operation="READ",
                 permission_type="ALLOW") for n in some("ab") for u in some("xy")]
    return dict(k_cluster_id=cluster, cluster_name=rng.choice(["main", "other"]), captured_at=later(k), controller_id=1,
                nodes=nodes, quorum=rng.choice([None, dict(leader_id=1, voters=[1, 5], observers=[2])]),
                node_configs=[dict(node_id=n, entries=[cfg("d", str(rng.randrange(2)))]) for n in some([1, 2, 3])],
                log_dirs=[], topics=None if rng.random() < 0.25 else topics, topic_configs=configs,
                topic_descriptions=descs, consumer_groups=None if rng.random() < 0.2 else groups,
                acl_bindings=None if rng.random() < 0.3 else acls)


def test_backlog_equals_one_by_one(spark, tmp_root):
    rng = random.Random(1)
    caps = [[random_snapshot(rng, k, c) for c in ("k1", "k2")] for k in range(5)]
    caps[3] = caps[3][:1]                                    # a cluster without a capture at that time
    single, batch = StateStore(spark, f"{tmp_root}/s"), StateStore(spark, f"{tmp_root}/b")
    offs = commits(spark, *[(c, later(1), f"g{g}", t, p, 1) for c in ("k1", "k2") for g in range(3) for t in "abcd" for p in (0, 1)])
    for group in caps[:2]:
        refresh_metadata(single, snaps(spark, *group))
    refresh_offsets(single, offs)
    for group in caps[2:]:
        refresh_metadata(single, snaps(spark, *group))
    for part in (caps[:2], caps[2:]):
        res = refresh_metadata(batch, snaps(spark, *[s for group in part for s in group]))
        if part[0] is caps[0]:
            refresh_offsets(batch, offs)
    assert batch.latest()["version"] == 2
    for name in (*TABLES, "_seen"):
        assert state_of(batch, name) == state_of(single, name), name
    acct = {(r.table_name, r.metric): r.value for r in res.accounting.collect()}
    assert acct[("_captures", "applied")] == sum(map(len, caps[2:]))
    before = {n: {tuple(r[k] for k in TABLES[n].keys) for r in batch.read(n, version=1).collect()} for n in TABLES}
    for name in ("topics", "topic_partitions", "consumer_groups", "acl_bindings"):
        now = {tuple(r[k] for k in TABLES[name].keys) for r in batch.read(name).collect()}
        if (name, "insert") in acct or (name, "delete") in acct:
            assert len(now) == len(before[name]) + acct.get((name, "insert"), 0) - acct.get((name, "delete"), 0)
    # nothing without its parent
    for name in ("topic_partitions", "partition_replicas", "topic_configs"):
        assert {(r.k_cluster_id, r.k_topic_id) for r in batch.read(name).collect()} <= {
            (r.k_cluster_id, r.k_topic_id) for r in batch.read("topics").collect()}


def test_number_of_jobs_does_not_grow(spark, tmp_root):
    def jobs(n):
        spark.sparkContext.setJobGroup(f"backlog-{tmp_root}-{n}", "backlog")
        store = StateStore(spark, f"{tmp_root}/{n}")
        refresh_metadata(store, snaps(spark, *[snapshot(later(k), drop_topic=k % 3 == 1) for k in range(n)]),
                         tables=("topics", "topic_configs", "topic_partitions"), parallel=False)
        assert store.versions() == [0]
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"backlog-{tmp_root}-{n}"))

    few, many = jobs(3), jobs(12)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert abs(many - few) <= 3


def test_late_chunk_holds_back_later_captures(spark, tmp_root):
    """T1's first chunk and T2, then T1's second chunk, give what T1 and then T2 give."""
    late, order = StateStore(spark, f"{tmp_root}/l"), StateStore(spark, f"{tmp_root}/o")
    for store in (late, order):
        refresh_metadata(store, snaps(spark, snapshot(later(0), drop_topic=True)))
    one, two = chunks(snapshot(later(1), controller=2))
    t2, other = snapshot(later(2)), snapshot(later(2), cluster="k2")
    before = {n: state_of(late, n) for n in TABLES}
    res = refresh_metadata(late, snaps(spark, one, t2, other))
    acct = {(r.table_name, r.metric): r.value for r in res.accounting.collect()}
    assert [acct[("_captures", s)] for s in ("open", "held", "applied")] == [1, 1, 1]
    assert {n: [r for r in state_of(late, n) if "k_cluster_id='k2'" not in r] for n in TABLES} == before
    assert late.read("_pending").count() == 2
    refresh_metadata(late, snaps(spark, two))
    for part in ((one, two), (t2,), (other,)):
        refresh_metadata(order, snaps(spark, *part))
    assert {n: state_of(late, n) for n in TABLES} == {n: state_of(order, n) for n in TABLES}
    topics = {r.k_topic_id: r for r in late.read("topics").filter("k_cluster_id = 'k1'").collect()}
    assert topics["T-b"].discovered_at < topics["T-b"].refreshed_at          # T1 was applied, not only T2
    assert late.read("_pending").count() == 0 and late.read("_failed").count() == 0


@pytest.mark.parametrize("how", ["late", "asked"])
def test_incomplete_captures_are_given_up_and_counted(spark, tmp_root, how):
    store = StateStore(spark, tmp_root)
    one, two = chunks(snapshot(later(0)))
    refresh_metadata(store, snaps(spark, one, snapshot(later(1))))
    assert store.read("topics").count() == 0 and store.read("_pending").count() == 2
    if how == "late":
        res = refresh_metadata(store, snaps(spark, snapshot(later(30))))     # 15 minutes later
    else:
        res = refresh_metadata(store, snaps(spark), give_up=True)
    acct = {(r.table_name, r.metric): r.value for r in res.accounting.collect()}
    assert acct[("_captures", "given_up")] == 1 and acct[("_captures", "given_up_rows")] == 1
    assert acct[("_captures", "applied")] == (2 if how == "late" else 1)
    assert rows(res.failed, "k_cluster_id", "reason", "n_rows") == [("k1", "given_up", 1)]
    assert rows(store.read("_failed"), "reason") == [("given_up",)] and store.read("_pending").count() == 0
    assert store.read("topics").count() == 2
    after = state_of(store, "topics")
    refresh_metadata(store, snaps(spark, two))                               # its time is over
    assert state_of(store, "topics") == after and store.read("_pending").count() == 0


def doubled(at, cluster="k1"):
    snap = snapshot(at, cluster=cluster)
    snap["topics"][1]["name"] = "alpha"
    return snap


@pytest.mark.parametrize("backlog", [False, True])
def test_one_bad_cluster_does_not_stop_the_others(spark, tmp_root, backlog):
    store = StateStore(spark, tmp_root)
    refresh_metadata(store, snaps(spark, *[snapshot(later(0), cluster=c, drop_topic=True) for c in ("k1", "k2", "k3")]))
    more = [snapshot(later(2), cluster="k3", drop_topic=True), doubled(later(2), "k1")] if backlog else []
    res = refresh_metadata(store, snaps(spark, doubled(later(1)), snapshot(later(1), cluster="k2"),
                                        snapshot(later(1), cluster="k3"), *more))
    assert store.latest()["version"] == 1
    assert {(r.k_cluster_id, r.reason) for r in res.failed.collect()} == {("k1", "failed")}
    by = {}
    for r in store.read("topics").collect():
        by.setdefault(r.k_cluster_id, set()).add(r.k_topic_id)
    assert by == {"k1": {"T-a"}, "k2": {"T-a", "T-b"}, "k3": {"T-a"} if backlog else {"T-a", "T-b"}}
    assert store.read("_failed").count() == (2 if backlog else 1)
    # the cluster's next good capture is applied
    refresh_metadata(store, snaps(spark, snapshot(later(3))))
    assert rows(store.read("topics").filter("k_cluster_id = 'k1'"), "k_topic_id") == [("T-a",), ("T-b",)]
    assert store.read("_failed").count() == (2 if backlog else 1)


def test_strict_refresh_raises(spark, tmp_root):
    store = StateStore(spark, tmp_root)
    refresh_metadata(store, snaps(spark, snapshot(later(0))))
    with pytest.raises(DuplicateTopicName):
        refresh_metadata(store, snaps(spark, doubled(later(1))), strict=True)
    assert store.latest()["version"] == 0 and rows(store.read("topics"), "name") == [("alpha",), ("beta",)]


def test_old_work_tables_go(spark, tmp_root):
    import pathlib

    store = StateStore(spark, tmp_root)
    for k in range(3):
        refresh_metadata(store, snaps(spark, snapshot(later(k))))
    store.remove_old(keep=1)
    assert [p.name for p in pathlib.Path(tmp_root).glob("_side/*")] == ["v=2"] and store.read("topics").count() == 2

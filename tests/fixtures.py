"""Hand-made nested snapshots for the refresh tests."""

from datetime import datetime, timedelta, timezone

T0 = datetime(2024, 5, 1, 12, 0, 0, tzinfo=timezone.utc)


def cfg(name, value, doc=None):
    return dict(name=name, value=value, source="DYNAMIC", sensitive=False, read_only=False, type="STRING",
                documentation=doc)


def snapshot(at, *, cluster="k1", topics=True, groups=True, acls=True, quorum=True, drop_topic=False,
             controller=1):
    nodes = [dict(id=1, host="h1", port=9092, rack="r1"), dict(id=2, host="h2", port=9092, rack=None)]
    t_list = [dict(k_topic_id="T-a", name="alpha", internal=False), dict(k_topic_id="T-b", name="beta", internal=True)]
    descs = [
        dict(k_topic_id="T-a", name="alpha", partitions=[
            dict(partition=0, leader=1, replicas=[1, 2], isr=[1]),
            dict(partition=1, leader=None, replicas=[2], isr=[]),          # no leader
        ]),
        dict(k_topic_id="T-b", name="beta", partitions=[dict(partition=0, leader=2, replicas=[2, 1], isr=[2, 1])]),
    ]
    t_cfgs = [dict(k_topic_id="T-a", entries=[cfg("retention.ms", "100")]),
              dict(k_topic_id="T-b", entries=[cfg("cleanup.policy", "compact")])]
    if drop_topic:
        t_list, descs, t_cfgs = t_list[:1], descs[:1], t_cfgs[:1]
    snap = dict(
        k_cluster_id=cluster, cluster_name="main", captured_at=at, controller_id=controller,
        nodes=nodes,
        quorum=dict(leader_id=1, voters=[1, 3], observers=[2]) if quorum else None,   # 3 is not live
        node_configs=[dict(node_id=1, entries=[cfg("log.dirs", "/d1"), cfg("secret", None)]),
                      dict(node_id=9, entries=[cfg("orphan", "x")])],             # node 9 not live
        log_dirs=[dict(node_id=1, path="/d2", replicas=[dict(topic="alpha", partition=0, size=10, offset_lag=0,
                                                             future=True)]),
                  dict(node_id=1, path="/d9", replicas=[dict(topic="alpha", partition=0, size=20, offset_lag=1,
                                                             future=False)])],  # same replica in two dirs
        topics=t_list if topics else None,
        topic_configs=t_cfgs if topics else None,
        topic_descriptions=descs if topics else None,
        consumer_groups=([
            dict(group_id="g1", simple=False, state="STABLE", partition_assignor="range", coordinator_id=1,
                 members=[dict(member_id="m1", group_instance_id=None, client_id="c", host="x",
                               assignments=[dict(topic="alpha", partition=0), dict(topic="nope", partition=0)]),
                          dict(member_id="m2", group_instance_id="i2", client_id="c", host="y",
                               assignments=[dict(topic="beta", partition=0)])]),
            dict(group_id="g-lost", simple=True, state="EMPTY", partition_assignor=None, coordinator_id=42,
                 members=[]),                                              # coordinator unknown: dropped
        ] if groups is True else ([] if groups == "empty" else None)),
        acl_bindings=([dict(resource_type="TOPIC", name="alpha", pattern_type="LITERAL", principal="User:a",
                            host="*", operation="READ", permission_type="ALLOW"),
                       dict(resource_type="TOPIC", name="alpha", pattern_type="LITERAL", principal="User:b",
                            host="*", operation="READ", permission_type="ALLOW")] if acls else None),
    )
    return snap


def later(n):
    return T0 + timedelta(seconds=30 * n)

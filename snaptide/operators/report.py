"""Snapshot report (A1, A3): twelve counts per capture, in long form.

One pass over the snapshot: each row is dealt out to its sections, a section to its elements, level by level with
plain explodes (compiled code; lambdas over arrays would be interpreted element by element). An element of an upper
level comes once for itself, so that each row that comes out is one item. One distinct aggregation counts each item
of a capture once (also when the capture is split into chunk rows), grouped counts follow. The quorum, which every
chunk row repeats, goes through the distinct aggregation whole; its members are dealt out after it. Missing nodes
are |quorum members and live nodes| - |live nodes|, so no join is needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaptide.operators import flatten as fl
from snaptide.schemas import CONFIG_ENTRY, MEMBER, PARTITION, relaxed

SNAP_KEY = fl.SNAP_KEY

# Metric labels of the report, in report order.
METRICS = ("Nodes", "Nodes (missing)", "Node Configs", "Topics", "Topic Configs", "Partitions", "Replicas",
           "Consumer Groups", "Consumer Group Members", "Consumer Group Assignments", "ACL Resources",
           "ACL Entries")
_CAPTURE, _ALL_NODES = "_capture", "_quorum_or_live"
# What the elements of each section count as, by level (None: as nothing). The access rules come as two.
_LEVELS = {
    _CAPTURE: (_CAPTURE,), "nodes": ("Nodes",), "node_configs": (None, "Node Configs"), "topics": ("Topics",),
    "topic_configs": (None, "Topic Configs"), "topic_descriptions": (None, "Partitions", "Replicas"),
    "consumer_groups": ("Consumer Groups", "Consumer Group Members", "Consumer Group Assignments"),
    "acl_resources": ("ACL Resources",), "acl_entries": ("ACL Entries",),
}
_SECTIONS, _LABELS = list(_LEVELS), [m for levels in _LEVELS.values() for m in levels if m] + [_ALL_NODES]
_TEXT = "array<string>"
# Columns of an element of the first, second and third level: key parts and what the next level is made of.
_FIRST = {"k1": _TEXT, "k2": _TEXT, "k3": _TEXT, "k4": _TEXT} | {
    n: f"array<array<{relaxed(t).simpleString()}>>" for n, t in
    (("entries", CONFIG_ENTRY), ("partitions", PARTITION), ("members", MEMBER))}
_SECOND = {"k": _TEXT, "replicas": "array<array<int>>",
           "assignments": f"array<{relaxed(MEMBER)['assignments'].dataType.simpleString()}>"}
_THIRD = {"k": _TEXT, "l": _TEXT}


def _zipped(kinds: dict[str, str], **given: Column) -> Column:
    """The given arrays side by side as elements of all columns of ``kinds``, numbered; NULL where nothing is given."""
    return F.arrays_zip(*[given[n].cast(k) if n in given else F.array().cast(k) for n, k in kinds.items()])


def _part(element: str, kinds: dict[str, str], name: str) -> Column:
    return F.col(element).getField(str(list(kinds).index(name)))


def _by_section(values: dict[str, Column]) -> Column:
    cases = [(F.col("_s") == _SECTIONS.index(s), v) for s, v in values.items()]
    return reduce(lambda c, x: c.when(*x), cases[1:], F.when(*cases[0]))


def _level(rows: DataFrame, name: str, below: dict[str, Column], own: list[str]) -> DataFrame:
    """``rows`` with each element of the next level as ``name``, and for the sections ``own`` once without."""
    kind = rows.select(next(iter(below.values()))).schema[0].dataType
    found = F.coalesce(_by_section(below), F.array().cast(kind))
    itself = F.array(F.lit(None).cast(kind.elementType))
    return rows.withColumn(name, F.explode(F.when(F.col("_s").isin([_SECTIONS.index(s) for s in own]), F.concat(itself, found))
                                           .otherwise(found)))


def _items(snap: DataFrame) -> DataFrame:
    """SNAP_KEY, metric (its place), k1-k4 (the item's key as text, NULL parts kept apart from empty ones), ids."""
    none = F.array().cast("array<int>")
    ids = F.array_union(F.coalesce(F.col("quorum.voters"), none), F.coalesce(F.col("quorum.observers"), none))
    sections = [s for s in _SECTIONS if s in snap.columns]
    rows = fl._base(snap, *sections, "acl_bindings", ids.alias("_ids"),
                    F.explode(F.array(*map(F.lit, range(len(_SECTIONS))))).alias("_s"))
    one, two, three = (lambda **c: _zipped(_FIRST, **c)), (lambda **c: _zipped(_SECOND, **c)), (lambda **c: _zipped(_THIRD, **c))
    acl = F.col("acl_bindings")
    first = {
        _CAPTURE: one(k1=F.array(F.lit(""))),
        "nodes": one(k1=F.col("nodes.id")),
        "node_configs": one(k1=F.col("node_configs.node_id"), entries=F.col("node_configs.entries")),
        "topics": one(k1=F.col("topics.k_topic_id")),
        "topic_configs": one(k1=F.col("topic_configs.k_topic_id"), entries=F.col("topic_configs.entries")),
        "topic_descriptions": one(k1=F.col("topic_descriptions.k_topic_id"), partitions=F.col("topic_descriptions.partitions")),
        "consumer_groups": one(k1=F.col("consumer_groups.group_id"), members=F.col("consumer_groups.members")),
        "acl_resources": one(k1=acl["resource_type"], k2=acl["name"], k3=acl["pattern_type"]),
        "acl_entries": one(k1=acl["principal"], k2=acl["host"], k3=acl["operation"], k4=acl["permission_type"]),
    }
    rows = rows.select(*SNAP_KEY, "_s", F.when(F.col("_s") == 0, F.col("_ids")).alias("_ids"), F.explode(_by_section(first)).alias("_x"))
    entries, partitions, members = (_part("_x", _FIRST, n) for n in ("entries", "partitions", "members"))
    configs = two(k=entries["name"])
    rows = _level(rows, "_y", {
        "node_configs": configs, "topic_configs": configs,
        "topic_descriptions": two(k=partitions["partition"], replicas=partitions["replicas"]),
        "consumer_groups": two(k=members["member_id"], assignments=members["assignments"]),
    }, [s for s, levels in _LEVELS.items() if levels[0]])
    given = _part("_y", _SECOND, "assignments")
    rows = _level(rows, "_z", {
        "topic_descriptions": three(k=_part("_y", _SECOND, "replicas")),
        "consumer_groups": three(k=given["topic"], l=given["partition"])}, _SECTIONS)
    level = F.when(F.col("_y").isNull(), 0).when(F.col("_z").isNull(), 1).otherwise(2)
    metric = _by_section({s: F.lit(_LABELS.index(levels[0])) if len(levels) == 1 else
                          F.element_at(F.array(*[F.lit(_LABELS.index(m) if m else None).cast("int") for m in levels]), level + 1)
                          for s, levels in _LEVELS.items()})
    x, y, z = ((lambda n, e=e, kinds=kinds: _part(e, kinds, n)) for e, kinds in (("_x", _FIRST), ("_y", _SECOND), ("_z", _THIRD)))
    return rows.select(*SNAP_KEY, metric.alias("metric"), x("k1").alias("k1"),
                       F.when(F.col("_y").isNull(), x("k2")).otherwise(y("k")).alias("k2"),
                       F.when(F.col("_z").isNull(), x("k3")).otherwise(z("k")).alias("k3"),
                       F.when(F.col("_z").isNull(), x("k4")).otherwise(z("l")).alias("k4"), "_ids")


def snapshot_report(snap: DataFrame) -> DataFrame:
    """(k_cluster_id, refreshed_at, metric, value) for every capture; a metric
    with nothing to count is 0."""
    items = _items(snap).groupBy(*SNAP_KEY, "metric", "k1", "k2", "k3", "k4", "_ids").agg(F.count(F.lit(1)).alias("_n"))
    # each item once for its metric; live nodes and quorum members once more, to be counted together
    more = (F.when(F.col("metric") == _LABELS.index(_CAPTURE), F.arrays_zip(F.col("_ids").cast(_TEXT)))
            .when(F.col("metric") == _LABELS.index("Nodes"), F.arrays_zip(F.array("k1").cast(_TEXT))))
    kind = "struct<id:string>"
    node = F.explode(F.concat(F.array(F.lit(None).cast(kind)), F.coalesce(more.cast(f"array<{kind}>"), F.array().cast(f"array<{kind}>"))))
    dealt = items.select(*SNAP_KEY, "metric", node.alias("_node"))
    metric = F.when(F.col("_node").isNull(), F.col("metric")).otherwise(_LABELS.index(_ALL_NODES))
    counts = dealt.groupBy(*SNAP_KEY, metric.alias("metric"), "_node").agg(F.count(F.lit(1)).alias("_n"))

    def of(label: str) -> Column:
        return F.col("metric") == _LABELS.index(label)

    val = {m: F.coalesce(F.sum(F.when(of(m), F.col("_n"))), F.lit(0)) for m in METRICS if m in _LABELS}
    val["Nodes (missing)"] = F.count_if(of(_ALL_NODES)) - val["Nodes"]
    counted = counts.groupBy(*SNAP_KEY).agg(*[val[m].cast("bigint").alias(m) for m in METRICS])
    grid = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("value")) for m in METRICS])
    return counted.select(*SNAP_KEY, F.inline(grid))

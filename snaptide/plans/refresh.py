"""A full refresh: nested snapshots in, fifteen current-state tables out.

``refresh_metadata`` applies metadata captures to the state tables in
dependency order, resolving each child against its parent's new state,
removing stale rows where the table does so and cascading removals to
children. A batch that holds one capture of each cluster is merged
(``operators.merge``); one that holds several is folded in one pass, to the
same state (``plans.backlog``). Either way it is one new version.

Each capture of a cluster is applied or left out on its own (``capture_order``):
a capture whose chunks are not all there holds back the later ones of its
cluster until it is complete or given up, a capture that breaks a rule (two
topics of one name) is left out; both are counted and listed in ``_failed``, and
the other clusters and captures go on.

``refresh_offsets`` does the same for the two offset tables from flat captures,
with offset timestamps looked up in a record log. All captures of a batch are
folded onto the stored rows at once (``operators.replay.fold``).

Each table's new state is written once into the new version of a ``StateStore``,
only for the clusters the batch holds, and read back for the steps after it (a
lineage cut); the commit record is written last, so a failed refresh leaves the
previous version in place.
"""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaptide.operators import flatten as fl
from snaptide.operators.accounting import accounting_metrics
from snaptide.operators.asof import DEFAULT_BUCKET, attach_offset_timestamps
from snaptide.operators.joins import existing, lookup, sorting
from snaptide.operators.lookup_plans import resolve_assignments, resolve_group_offsets, resolve_partition_offsets
from snaptide.operators.merge import merge_snapshot, no_rows
from snaptide.operators.offsets import clean_partition_offsets
from snaptide.operators.replay import capture_ranks, fold
from snaptide.plans.backlog import SECTIONS, Backlog
from snaptide.plans.state import CAPTURED, StateStore
from snaptide.schemas import EXTRA_PARENTS, OFFSET_TABLES, SNAPSHOT, TABLES

CK = "k_cluster_id"
NOW = "refreshed_at"
METADATA_TABLES = tuple(n for n in TABLES if n not in OFFSET_TABLES)
# Seconds by which a complete capture may be later than an incomplete one of its cluster before that is given up:
# twenty refresh periods of 30 s.
HOLD_BACK = 600
LEVELS = [
    ["clusters", "nodes", "topics", "acl_resources", "acl_entries"],
    ["node_configs", "topic_configs", "topic_partitions", "consumer_groups", "acl_bindings"],
    ["partition_replicas", "partition_offsets", "consumer_group_members"],
    ["consumer_group_member_assignments", "consumer_group_offsets"],
]


class DuplicateTopicName(ValueError):
    """Two topics of a capture hold one name (raised by a strict refresh; nothing is committed)."""


@dataclass
class RefreshResult:
    tables: dict[str, DataFrame]
    removed: dict[str, DataFrame] = field(default_factory=dict)
    accounting: DataFrame | None = None
    version: int | None = None
    failed: DataFrame | None = None


def _after(rows: DataFrame, seen: DataFrame, kind: str) -> DataFrame:
    """Rows of captures after the last applied one of their cluster (a
    replayed or older capture changes nothing)."""
    last = seen.filter(F.col("kind") == kind).select(CK, "seen_at")
    return (lookup(rows, last, [CK], "left")
            .filter(F.col("seen_at").isNull() | (F.col("captured_at") > F.col("seen_at"))).drop("seen_at"))


def captures_of(rows: DataFrame) -> DataFrame:
    """(k_cluster_id, captured_at, n_rows, _whole): the captures in ``rows``, and whether all of their chunks are there."""
    caps = rows.groupBy(CK, "captured_at").agg(F.max("chunk_count").alias("_count"), F.count(F.lit(1)).alias("n_rows"),
                                               F.count_distinct("chunk_index").alias("_chunks"))
    return caps.select(CK, "captured_at", "n_rows", F.coalesce(F.col("_chunks") >= F.col("_count"), F.lit(True)).alias("_whole"))


def capture_order(rows: DataFrame, hold_back: float = HOLD_BACK, give_up: bool = False, caps: DataFrame | None = None) -> DataFrame:
    """(k_cluster_id, captured_at, n_rows, status, rank): the captures in ``rows``. A capture is complete when all of
    its chunks are there. Status, each cluster for itself:

    applied   complete, and no earlier capture is open; ``rank`` is its place among these
    open      incomplete
    held      complete, but an earlier capture is open
    given_up  incomplete, and a complete one is more than ``hold_back`` seconds later (or ``give_up``)
    failed    would be applied, but two of its topics hold one name (Q11)

    ``caps``: ``captures_of(rows)``, if it is written already; all rows are read for each of its three uses otherwise.
    """
    caps = captures_of(rows) if caps is None else caps
    whole = F.col("_whole")
    # ids are told apart by 128 bits: numbers are held by hash, for texts all topics of a task would be sorted by name
    ids = [F.when(F.col("k_topic_id").isNotNull(), h) for h in (F.xxhash64("k_topic_id"), F.xxhash64(F.lit(1), "k_topic_id"))]
    ends = [end(h).alias(f"_{end.__name__}{i}") for i, h in enumerate(ids) for end in (F.min, F.max)]
    named = (fl.topics(rows).groupBy(*sorting([CK, NOW, "name"])).agg(*ends).filter("_min0 <> _max0 OR _min1 <> _max1")
             .select(CK, F.col(NOW).alias("captured_at"), F.lit(True).alias("_bad")).distinct())
    newest = caps.filter(whole).groupBy(CK).agg(F.max("captured_at").alias("_newest"))
    late = F.lit(give_up) | F.coalesce(
        F.unix_micros("_newest") - F.unix_micros("captured_at") > int(hold_back * 1_000_000), F.lit(False))
    caps = lookup(lookup(caps, newest, [CK], "left"), named, [CK, "captured_at"], "left")
    caps = caps.withColumn("_open", ~whole & ~late)
    first = caps.filter("_open").groupBy(CK).agg(F.min("captured_at").alias("_first_open"))
    status = (F.when(F.col("_open"), "open").when(~whole, "given_up")
              .when(F.col("captured_at") > F.col("_first_open"), "held").when(F.col("_bad"), "failed").otherwise("applied"))
    caps = lookup(caps, first, [CK], "left").select(CK, "captured_at", "n_rows", status.alias("status"))
    ranks = capture_ranks(caps.filter("status = 'applied'").select(CK, F.col("captured_at").alias(NOW)), [CK])
    return lookup(caps, ranks.select(CK, F.col(NOW).alias("captured_at"), F.col("_rank").alias("rank")),
                  [CK, "captured_at"], "left")


# Where the rows given for a table are found: a section, and the lists within each of its elements. The access rules
# are counted as bindings.
GIVEN = {"topics": ("topics",), "node_configs": ("node_configs", "entries"), "topic_configs": ("topic_configs", "entries"),
         "topic_partitions": ("topic_descriptions", "partitions"),
         "partition_replicas": ("topic_descriptions", "partitions", "replicas"), "consumer_groups": ("consumer_groups",),
         "consumer_group_members": ("consumer_groups", "members"),
         "consumer_group_member_assignments": ("consumer_groups", "members", "assignments"),
         **dict.fromkeys(("acl_resources", "acl_entries", "acl_bindings"), ("acl_bindings",))}


def _counted(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_n_<table>``, the rows they give for each table before any lookup, so that they are counted
    without reading the sections again. Lists in lists are laid end to end for it, by compiled code. NULL: the section
    was not read; -1: one of its lists is NULL (``_given`` counts these one by one)."""
    def n(items: Column) -> Column:
        return F.array_size(items).cast("long")

    def total(section: str, *fields: str) -> Column:
        items = F.col(section)
        for f in fields:
            items = F.flatten(items.getField(f))
        return F.when(F.col(section).isNotNull(), F.coalesce(n(items), F.lit(-1).cast("long")))

    nodes = [F.coalesce(n(F.col(c)), F.lit(0).cast("long")) for c in ("nodes", "quorum.voters", "quorum.observers")]
    return rows.withColumns({"_n_nodes": reduce(lambda a, b: a + b, nodes)} | {f"_n_{t}": total(*at) for t, at in GIVEN.items()})


def _given(snap: DataFrame) -> tuple[dict[str, int], dict[str, bool]]:
    """Rows given for each table before any lookup, and whether any capture read a section (of ``_counted`` rows)."""
    def one_by_one(items: Column, *fields: str) -> Column:
        if not fields:
            return F.coalesce(F.array_size(items).cast("long"), F.lit(0).cast("long"))
        total = F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + one_by_one(x[fields[0]], *fields[1:]))
        return F.coalesce(total, F.lit(0).cast("long"))

    tables = ("nodes", *GIVEN)
    known = {t: F.when(F.col(f"_n_{t}") < 0, 0).otherwise(F.col(f"_n_{t}")) for t in tables}
    row = snap.agg(*[F.sum(c).alias(t) for t, c in known.items()],
                   *[F.count_if(F.col(f"_n_{t}") < 0).alias(f"open_{t}") for t in tables]).first()
    counts, left = {t: int(row[t] or 0) for t in tables}, [t for t in tables if row[f"open_{t}"]]
    if left:
        more = snap.agg(*[F.sum(F.when(F.col(f"_n_{t}") < 0, one_by_one(F.col(GIVEN[t][0]), *GIVEN[t][1:]))).alias(t)
                          for t in left]).first()
        counts |= {t: counts[t] + int(more[t]) for t in left}
    return counts, {s: row[s] is not None for s in dict.fromkeys(SECTIONS.values())}


# Tables for which a given row is one source row (others combine or repeat rows on the way to the merge).
RESOLVING = ("node_configs", "topic_configs", "topic_partitions", "partition_replicas", "consumer_groups",
             "consumer_group_members", "consumer_group_member_assignments", "acl_bindings")

# Tables whose source rows a join with a parent has dealt out before: rows of one key are few, or were in one task there.
DEALT = ("partition_replicas",)


class _Run:
    """One version in progress: merges, cascades and staged writes for the touched clusters."""

    def __init__(self, store: StateStore, touched: DataFrame, incremental: bool = False):
        self.store, self.incremental = store, incremental
        self.head = store.latest()            # one read of the commit log per version
        self.version = store.begin(self.head)
        self.touched = store.stage_side(self.version, "clusters", touched.select(CK).distinct())
        self.new: dict[str, DataFrame] = {}
        self.staged: dict[str, DataFrame] = {}
        self.removed: dict[str, DataFrame] = {}
        self.counts: list[tuple[str, str, int]] = []
        self.given: dict[str, int] = {}
        self.lock = threading.Lock()

    def stored(self, name: str) -> bool:
        """Whether the version before this one holds rows of a table."""
        return bool(((self.head or {}).get("tables") or {}).get(name))

    def state(self, name: str) -> DataFrame:
        """Stored rows of the touched clusters; other clusters' files are not read."""
        return existing(self.store.read(name, head=self.head or {"tables": {}}), self.touched, [CK])

    def table(self, name: str) -> DataFrame:
        return self.new[name] if name in self.new else self.state(name)

    def scopes(self, snap: DataFrame, sections) -> dict[str, DataFrame]:
        """Per section, (k_cluster_id, refreshed_at) of the clusters whose capture read it, from one small table."""
        read = snap.groupBy(CK, F.col("captured_at").alias(NOW)).agg(
            *[F.max(F.col(f"_n_{s}").isNotNull()).alias(s) for s in sections])
        staged = self.store.stage_side(self.version, "scopes", read)
        return {s: staged.filter(F.col(s)).select(CK, NOW) for s in sections}

    def _removed_parents(self, name: str) -> list[tuple[DataFrame, list[str]]]:
        """Rows of a table's parents (declared or extra) that were removed earlier in this run, with the link's keys."""
        spec = TABLES[name]
        links = [(spec.parent, spec.parent_keys)] if spec.parent and spec.parent != "clusters" else []
        return [(self.removed[p].withColumnRenamed("name", "resource_name") if p == "acl_resources" else self.removed[p], list(keys))
                for p, keys in links + EXTRA_PARENTS.get(name, []) if p in self.removed]

    def _marked(self, name: str, table: DataFrame) -> DataFrame:
        """``table`` and ``_lost``: whether a parent of the row was removed. One join for each such parent, from which
        what stays and what goes are both read."""
        lost = F.lit(False)
        for gone, keys in self._removed_parents(name):
            gone = gone.select(*keys).distinct().withColumn("_gone", F.lit(True))
            lost = lost | F.coalesce("_gone", F.lit(False))
            table = lookup(table, gone, keys, "left").withColumn("_lost", lost).drop("_gone")
            lost = F.col("_lost")
        return table.withColumn("_lost", lost)

    def stage(self, name: str, table: DataFrame, touched: DataFrame | None = None) -> None:
        self.new[name] = self.store.stage(self.version, name, table)
        with self.lock:
            self.staged[name] = self.touched if touched is None else touched

    def _stage_removed(self, name: str, removed: list[DataFrame]) -> None:
        cols = list(TABLES[name].columns)
        if removed:
            gone = reduce(DataFrame.unionByName, [r.select(*cols) for r in removed])
            gone = self.store.stage_side(self.version, f"removed-{name}", gone)
            if not gone.isEmpty():
                self.removed[name] = gone

    def write(self, name: str, merged: DataFrame) -> None:
        """Write the rows of a merge (``action``, ``_dups``) once, count them (A5 / A6) and note what was removed. Rows
        that the source holds have their parents; only the others (no ``_dups``) are asked for removed ones."""
        parents = self._removed_parents(name)
        a = F.col("action")
        part = F.when(a.isNull(), "none").when(a == "delete", "stale").when(F.lit(bool(parents)) & F.col("_dups").isNull(), "asked").otherwise("kept")
        rows = self.store.stage_parts(self.version, name, merged.select(*TABLES[name].columns, "action", "_dups"), part)
        counts = {m: int(v or 0) for m, v in rows.agg(*accounting_metrics()).first().asDict().items()}
        found = counts["submitted"]
        counts["submitted"] = self.given.get(name, found)
        counts["unresolved"] = counts["submitted"] - found
        asked = self._marked(name, rows.filter("_part = 'asked'")) if parents else None
        table = self.store.take_kept(self.version, name)
        if asked is not None:
            table = self.store.stage(self.version, name, asked.filter("NOT _lost"), "append")
        self.new[name] = table
        with self.lock:
            self.counts += [(name, m, v) for m, v in counts.items()]
            self.staged[name] = self.touched
        self._stage_removed(name, ([rows.filter("_part = 'stale'")] if counts["delete"] else [])
                            + ([asked.filter("_lost")] if parents else []))
        self.store.drop_side(self.version, f"parts-{name}")

    def merge(self, name: str, source: DataFrame, scope: DataFrame | None = None) -> None:
        spec = TABLES[name]
        self.write(name, merge_snapshot(self.state(name), source, spec, scope=scope if spec.delete_stale else None,
                                        incremental=self.incremental, dup_counts=True, dealt=name in DEALT))

    def carry(self, name: str) -> None:
        """A table this refresh does not merge: only cascades may remove rows."""
        if not self.stored(name):
            return
        if self._removed_parents(name):
            marked = self._marked(name, self.state(name))
            self.stage(name, marked.filter("NOT _lost"))
            self._stage_removed(name, [marked.filter("_lost")])

    def finish(self, epoch: int | None, stream: str | None) -> RefreshResult:
        self.store.commit(self.version, self.staged, epoch, stream, self.head)
        acct = None
        if self.counts:
            acct = self.store.spark.createDataFrame(self.counts, "table_name string, metric string, value long")
        return RefreshResult(self.store.read_all(), dict(self.removed), acct, self.version)


def _run_level(steps) -> None:
    """Run the merges of one dependency level; independent tables are
    submitted as concurrent Spark jobs from a few driver threads."""
    if len(steps) == 1:
        steps[0]()
        return
    with ThreadPoolExecutor(max_workers=len(steps)) as pool:
        for f in [pool.submit(step) for step in steps]:
            f.result()


def _seen_after(run: _Run, times: DataFrame, kind: str) -> DataFrame:
    """The touched clusters' seen times with those of ``times`` (k_cluster_id, captured_at) for ``kind``."""
    mine = times.groupBy(CK).agg(F.max("captured_at").alias("seen_at")).select(CK, F.lit(kind).alias("kind"), "seen_at")
    both = run.state("_seen").unionByName(mine)
    return both.groupBy(CK, "kind").agg(F.max("seen_at").alias("seen_at"))


def _apply(run: _Run, snap: DataFrame, names: set[str], parallel: bool, given: dict[str, int],
           read: dict[str, bool]) -> None:
    """Merge one capture of each touched cluster, parents before children. A table that the captures say nothing
    about (no rows, and no section read that could make its rows stale) is not merged."""
    run.given = {n: c for n, c in given.items() if n in RESOLVING}
    scopes = run.scopes(snap, ("topics", "consumer_groups", "acl_bindings"))
    topic_scope, group_scope, acl_scope = scopes.values()
    t = run.table

    def bindings():
        b = existing(fl.acl_bindings(snap), t("acl_resources").withColumnRenamed("name", "resource_name"),
                     [CK, "resource_type", "resource_name", "pattern_type"])
        return existing(b, t("acl_entries"), [CK, "principal", "host", "operation", "permission_type"])

    def replicas():
        reps = existing(fl.replicas(snap), t("topic_partitions"), [CK, "k_topic_id", "k_partition_id"])
        return existing(reps, t("nodes"), [CK, "k_node_id"])

    def groups():
        return existing(fl.consumer_groups(snap), t("nodes").withColumnRenamed("k_node_id", "coordinator_id"),
                        [CK, "coordinator_id"])

    def partitions():
        return existing(fl.partitions(snap).select(CK, NOW, "k_topic_id", "k_partition_id"), t("topics"),
                        [CK, "k_topic_id"])

    def assignments():
        return resolve_assignments(fl.member_assignments(snap), t("consumer_group_members"), t("topics"),
                                   t("topic_partitions"))

    sources = {
        "clusters": (lambda: fl.clusters(snap), None),
        "nodes": (lambda: fl.all_nodes(snap), None),
        "topics": (lambda: fl.topics(snap), topic_scope),
        "acl_resources": (lambda: fl.acl_resources(snap), acl_scope),
        "acl_entries": (lambda: fl.acl_entries(snap), acl_scope),
        "node_configs": (lambda: existing(fl.node_configs(snap), t("nodes"), [CK, "k_node_id"]), None),
        "topic_configs": (lambda: existing(fl.topic_configs(snap), t("topics"), [CK, "k_topic_id"]), None),
        "topic_partitions": (partitions, None),
        "consumer_groups": (groups, group_scope),
        "acl_bindings": (bindings, acl_scope),
        "partition_replicas": (replicas, None),
        "consumer_group_members": (lambda: existing(fl.group_members(snap), t("consumer_groups"), [CK, "group_id"]),
                                   group_scope),
        "consumer_group_member_assignments": (assignments, group_scope),
    }
    def step(name: str):
        def go() -> None:
            stale = TABLES[name].delete_stale and read.get(SECTIONS.get(name), False) and run.stored(name)
            if name in names and name in sources and (given.get(name, 1) or stale):
                make, scope = sources[name]
                run.merge(name, make(), scope)
            else:
                run.carry(name)
        return go

    _by_level(step, parallel)


def _by_level(step, parallel: bool) -> None:
    for level in LEVELS:
        steps = [step(name) for name in level]
        if parallel:
            _run_level(steps)
        else:
            for go in steps:
                go()


def refresh_metadata(store: StateStore, snapshots: DataFrame, *, epoch: int | None = None,
                     incremental: bool = False, stream: str | None = None, parallel: bool = True,
                     tables=None, hold_back: float = HOLD_BACK, give_up: bool = False,
                     strict: bool = False) -> RefreshResult:
    """Apply the captures of ``snapshots`` (and the rows kept from earlier inputs) that are after their cluster's
    last applied one, in order, as one new version.

    Tables are processed parents first, level by level (tables of one level do
    not depend on each other and run concurrently when ``parallel``).
    ``tables``: merge only these (children of removed rows go all the same).
    ``incremental``: the captures are far smaller than the touched clusters'
    state (one capture of each cluster). ``hold_back``, ``give_up``: see
    ``capture_order``; rows of open and held captures stay in the store.
    ``strict``: raise for a failed capture instead of leaving it out. The
    result's ``failed`` lists captures that were left out for good;
    ``accounting`` counts captures by status under ``_captures``.
    """
    names = set(METADATA_TABLES if tables is None else tables)
    head = store.latest() or {"tables": {}}
    marks = [F.col(c) if c in snapshots.columns else F.lit(None).cast("int").alias(c) for c in ("chunk_index", "chunk_count")]
    given = snapshots.select(*[c for c in SNAPSHOT.fieldNames() if not c.startswith("chunk_")], *marks)
    kept = store.read("_pending", head=head)
    version = store.begin(store.latest())
    # written once: every table reads only its section's columns, in as many tasks as the input has
    rows = store.stage_side(version, "rows", _counted(_after(given.unionByName(kept), store.read("_seen", head=head), "metadata")),
                            CAPTURED)
    try:
        caps = store.stage_side(version, "chunks", captures_of(rows))
        order = store.stage_side(version, "captures", capture_order(rows, hold_back, give_up, caps))
        found = {r.status: r for r in order.groupBy("status").agg(
            F.count(F.lit(1)).alias("n"), F.sum("n_rows").alias("n_rows"), F.max("rank").alias("last")).collect()}
        if strict and "failed" in found:
            raise DuplicateTopicName("a topic name is held by several topics of a capture")
        now = order.filter("status = 'applied'").select(CK, "captured_at")
        run = _Run(store, now if "applied" in found else order, incremental)
        counts = None
        if "applied" in found:
            snap = lookup(rows, now, [CK, "captured_at"], "left_semi")
            submitted, read = _given(snap)
            if found["applied"].last == 1:
                _apply(run, snap, names, parallel, submitted, read)
            else:
                run.given = {n: c for n, c in submitted.items() if n in RESOLVING}
                backlog = Backlog(run, snap, names, submitted, read)
                _by_level(lambda name: lambda: backlog.apply(name), parallel)
                counts = backlog.accounting()
            run.stage("_seen", _seen_after(run, now, "metadata"))
        clusters = order.select(CK).distinct()
        waiting = order.filter("status IN ('open', 'held')").select(CK, "captured_at")
        if {"open", "held"} & set(found) or run.stored("_pending"):
            run.stage("_pending", lookup(rows, waiting, [CK, "captured_at"], "left_semi"), clusters)
        lost = order.filter("status IN ('failed', 'given_up')").select(CK, "captured_at", F.col("status").alias("reason"), "n_rows")
        if {"failed", "given_up"} & set(found):
            before = existing(store.read("_failed", head=head), clusters, [CK])
            run.stage("_failed", before.unionByName(lost).distinct(), clusters)
        run.counts += [("_captures", status, r.n) for status, r in found.items()]
        run.counts += [("_captures", "given_up_rows", found["given_up"].n_rows)] if "given_up" in found else []
        result = run.finish(epoch, stream)
        if counts is not None:
            result.accounting = result.accounting.unionByName(counts)
        result.failed = lost
        return result
    finally:
        store.drop_side(version, "rows")


def refresh_offsets(store: StateStore, group_offsets: DataFrame | None = None,
                    partition_offsets: DataFrame | None = None, record_log: DataFrame | None = None, *,
                    group_reads: DataFrame | None = None, epoch: int | None = None, bucket: int = DEFAULT_BUCKET,
                    metadata: StateStore | None = None, stream: str | None = None) -> RefreshResult:
    """Offset refresh (M11 + V1 + X5, M12 + V2) against the committed
    metadata state; commits a new version holding the two offset tables.

    ``group_offsets``: GROUP_OFFSETS rows of any number of captures.
    ``group_reads``: GROUP_READS rows, the groups each capture read; offsets of
    a group that was read and has no row go (X5), also when its cluster has no
    commits at all. Without it a capture has read the groups it has rows of.
    ``record_log``: RECORD_LOG rows, to find the time of the record at each
    committed offset; without it offset timestamps are NULL.
    ``partition_offsets``: PARTITION_OFFSETS rows. ``metadata``: a separate
    store holding the metadata tables (so a metadata stream and an offset
    stream each write their own store); by default ``store`` itself. Stored
    offsets whose partition or group is no longer in the metadata go first (K3).
    """
    head = store.latest() or {"tables": {}}
    seen = store.read("_seen", head=head)
    go = reads = po = None
    times: dict[str, DataFrame] = {}
    if group_offsets is not None or group_reads is not None:
        if group_offsets is not None:
            go = _after(group_offsets, seen, "group_offsets")
            reads = go.select(CK, "captured_at", "group_id").distinct()
        if group_reads is not None:
            listed = _after(group_reads, seen, "group_offsets").filter("read").select(CK, "captured_at", "group_id")
            reads = listed.distinct() if reads is None else reads.unionByName(listed).distinct()
            times["group_offsets"] = _after(group_reads, seen, "group_offsets").select(CK, "captured_at").distinct()
        else:
            times["group_offsets"] = reads.select(CK, "captured_at").distinct()
    if partition_offsets is not None:
        po = _after(partition_offsets, seen, "partition_offsets")
        times["partition_offsets"] = po.select(CK, "captured_at").distinct()
    if not times:
        raise ValueError("no captures given")
    run = _Run(store, reduce(DataFrame.unionByName, list(times.values())))
    source = metadata or store
    meta_head = source.latest() or {"tables": {}}
    meta = {n: existing(source.read(n, head=meta_head), run.touched, [CK])
            for n in ("topics", "topic_partitions", "consumer_groups")}

    if reads is not None:
        spec = TABLES["consumer_group_offsets"]
        history = _group_history(run, go, record_log, bucket, meta)
        state = existing(run.state("consumer_group_offsets"), meta["consumer_groups"], [CK, "group_id"])
        state = existing(state, meta["topic_partitions"], [CK, "k_topic_id", "k_partition_id"])
        known = run.store.stage_side(run.version, "reads", reads.select(CK, "group_id", F.col("captured_at").alias(NOW)))
        run.write("consumer_group_offsets", fold(state, history, spec, reads=known, scope=(CK, "group_id")))
    if po is not None:
        spec = TABLES["partition_offsets"]
        cleaned = clean_partition_offsets(po)
        history = run.store.stage_side(run.version, "history-partition", resolve_partition_offsets(
            cleaned, meta["topic_partitions"]))
        run.given["partition_offsets"] = po.count()
        state = existing(run.state("partition_offsets"), meta["topic_partitions"], [CK, "k_topic_id", "k_partition_id"])
        run.write("partition_offsets", fold(state, history, spec))
    marks = reduce(DataFrame.unionByName, [t.withColumn("kind", F.lit(kind)) for kind, t in times.items()])
    newest = marks.groupBy(CK, "kind").agg(F.max("captured_at").alias("seen_at"))
    run.stage("_seen", run.state("_seen").unionByName(newest.select(CK, "kind", "seen_at"))
               .groupBy(CK, "kind").agg(F.max("seen_at").alias("seen_at")))
    return run.finish(epoch, stream)


def _group_history(run: _Run, go: DataFrame | None, record_log: DataFrame | None, bucket: int, meta) -> DataFrame:
    """Captured commits with their record times, keys resolved, as a written table."""
    spec = TABLES["consumer_group_offsets"]
    if go is None:
        return no_rows(run.store.spark, run.state("consumer_group_offsets").select(*spec.keys, *spec.attrs, NOW).schema)
    run.given["consumer_group_offsets"] = go.count()
    rows = go.select(CK, F.col("captured_at").alias(NOW), "group_id", "topic",
                     F.col("partition").alias("k_partition_id"), "offset", "metadata",
                     F.col("leader_epoch").cast("bigint").alias("leader_epoch"))
    if record_log is not None:
        if CK not in record_log.columns:
            raise ValueError(f"a record log needs {CK}: topics of one name in two clusters are two logs")
        keys = [CK, "topic", "k_partition_id"]
        log = record_log.select(CK, "topic", F.col("partition").alias("k_partition_id"), "offset", "timestamp")
        rows = attach_offset_timestamps(rows, log, keys, bucket=bucket)
    else:
        rows = rows.withColumn("offset_timestamp", F.lit(None).cast("timestamp"))
    found = resolve_group_offsets(rows, meta["consumer_groups"], meta["topics"], meta["topic_partitions"])
    return run.store.stage_side(run.version, "history-group", found.select(*spec.keys, *spec.attrs, NOW))


__all__ = ["refresh_metadata", "refresh_offsets", "capture_order", "DuplicateTopicName", "RefreshResult", "HOLD_BACK"]

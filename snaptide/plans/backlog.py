"""Several metadata captures of a cluster applied in one pass (M1-M10, M13-M15, K3 over a backlog).

The result is the state that the captures would leave one after another, but the work does not depend on how
many there are: each table's captured rows are replayed onto its stored rows at once (``operators.replay``).

What a sequence adds to a replay are the parents. A row of a parent table lives in *islands*: from the capture
that brought it (or from its stored ``discovered_at``) to the read that no longer found it, or to the end of
its own parent's island. A child row of a capture belongs to the islands of its parents that hold the capture's
time; without one it is not resolved. The start of that island (the latest, with several parents) is part of
the child's key in the replay, so a child that comes back under a returned parent is a new row, and all of a
child's rows end with their parent's island. Topic names are resolved the same way, against the runs in which
a topic held a name.

Tables are done parents first. For each one the captured rows, its islands and its new state are written once;
islands alive at the end are the new state, stored islands that ended are the removed rows.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaptide.operators import flatten as fl
from snaptide.operators.joins import lookup
from snaptide.operators.merge import reduce_duplicates
from snaptide.operators.replay import DEFAULT_SEGMENT, capture_ranks, replayed_steps
from snaptide.schemas import EXTRA_PARENTS, TABLES

CK = "k_cluster_id"
NOW = "refreshed_at"
EPOCH, END, UNTIL = "_epoch", "_end", "_until"
ACL_NAME = {"name": "resource_name"}


def _never() -> Column:
    return F.timestamp_seconds(F.lit(0))


def _forever() -> Column:
    return F.timestamp_seconds(F.lit(253402214400))


def parents_of(name: str) -> list[tuple[str, list[str]]]:
    """(parent table, key columns in the child) of every link whose parent can be removed or must exist."""
    spec = TABLES[name]
    links = [(spec.parent, spec.parent_keys)] if spec.parent and spec.parent != "clusters" else []
    return [(p, list(keys)) for p, keys in links + EXTRA_PARENTS.get(name, [])]


def _free(rows: DataFrame) -> DataFrame:
    return rows.withColumns({EPOCH: _never(), END: _forever()})


def _under(rows: DataFrame, lives: DataFrame, keys: list[str]) -> DataFrame:
    """Captured rows whose parent lives at their time, with the start and end of what they belong to."""
    held = lives.select(*keys, "_from", UNTIL)
    inside = (F.col("_from") <= F.col(NOW)) & (F.col(NOW) < F.col(UNTIL))
    # captured rows repeat themselves and take next to nothing in files: by their bytes millions of them would be broadcast
    return (lookup(rows.hint("merge"), held, keys).filter(inside)
            .withColumns({EPOCH: F.greatest(EPOCH, "_from"), END: F.least(END, UNTIL)}).drop("_from", UNTIL))


def _stored_under(rows: DataFrame, lives: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with the stored island of their parent (rows without one stay as they are)."""
    held = lives.filter("_stored").select(*keys, "_from", UNTIL)
    return (lookup(rows, held, keys, "left")
            .withColumns({EPOCH: F.greatest(EPOCH, "_from"), END: F.least(END, UNTIL)}).drop("_from", UNTIL))


def islands(state: DataFrame, history: DataFrame, name: str, ranks: DataFrame,
            segment: int = DEFAULT_SEGMENT) -> DataFrame:
    """The last row of each run of equal attributes of each island: keys, attributes, audit triple, ``action``
    (of that last row), ``_had`` (the island is a stored one), ``_until`` (end of the island) and ``_next`` (start
    of the island's next run; NULL for its last, which is the island's last row)."""
    spec = TABLES[name]
    wide = replace(spec, keys=(*spec.keys, EPOCH, END))
    keys, attrs = list(wide.keys), list(spec.attrs)
    none = F.lit(None).cast("timestamp")
    captured = lookup(history.select(*keys, *attrs, NOW), ranks, [CK, NOW]).withColumns({"_mod0": none, "_disc0": none})
    zero = F.lit(0).cast("bigint").alias("_rank")
    stored = state.select(*keys, *attrs, NOW, zero, F.col("modified_at").alias("_mod0"),
                          F.col("discovered_at").alias("_disc0"))
    steps = replayed_steps(captured.unionByName(stored), wide, spec.delete_stale, segment)
    kept = state.select(*wide.columns, zero, F.lit("keep").alias("action"))
    rest = [*attrs, NOW]
    runs = (steps.unionByName(kept).groupBy(*keys, "discovered_at", "modified_at")
            .agg(F.max(F.struct("_rank", "action", *rest)).alias("_r"), (F.min("_rank") == 0).alias("_first")))
    own = Window.partitionBy(*keys, "discovered_at")
    runs = runs.select(*keys, "discovered_at", "modified_at", *[F.col("_r").getField(c).alias(c) for c in rest],
                       F.col("_r.action").alias("action"), F.max("_r._rank").over(own).alias("_rank"),
                       F.max("_first").over(own).alias("_had"),
                       F.lead("modified_at").over(own.orderBy("modified_at")).alias("_next"))
    if spec.delete_stale:
        reads = ranks.select(CK, (F.col("_rank") - 1).alias("_rank"), F.col(NOW).alias("_missed"))
        runs = lookup(runs, reads, [CK, "_rank"], "left")
        until = F.least(F.coalesce("_missed", _forever()), F.col(END))
    else:
        until = F.col(END)
    return runs.select(*spec.keys, *attrs, "discovered_at", "modified_at", NOW, "action", "_had", until.alias(UNTIL), "_next")


def _lives(found: DataFrame, keys) -> DataFrame:
    return found.filter("_next IS NULL").select(*keys, F.col("discovered_at").alias("_from"), UNTIL, F.col("_had").alias("_stored"))


class Backlog:
    """One version made of all captures of a batch. ``run``: the version in progress (``refresh._Run``);
    ``snap``: the captures' rows; ``given``, ``read``: rows given for a table and sections read, over all of them."""

    def __init__(self, run, snap: DataFrame, names: set[str], given: dict[str, int], read: dict[str, bool]):
        self.run, self.snap, self.names, self.given, self.read = run, snap, names, given, read
        self.lives: dict[str, DataFrame] = {}
        self.counted: list[DataFrame] = []
        self.named: DataFrame | None = None      # runs of topic names
        whole = snap.groupBy(CK, F.col("captured_at").alias(NOW)).agg(
            *[F.max(F.col(s).isNotNull()).alias(s) for s in dict.fromkeys(SECTIONS.values())])
        self.reads = run.store.stage_side(run.version, "scopes", whole)

    def ranks(self, name: str) -> DataFrame:
        section = SECTIONS.get(name)
        reads = self.reads.filter(F.col(section)) if section else self.reads
        return capture_ranks(reads, [CK])

    def _live(self, name: str, renamed: dict[str, str] | None = None) -> DataFrame:
        found = self.lives[name]
        for old, new in (renamed or {}).items():
            found = found.withColumnRenamed(old, new)
        return found

    def _parents(self, name: str):
        return [(self._live(p, ACL_NAME if p == "acl_resources" else None), keys) for p, keys in parents_of(name)]

    def _captured(self, name: str) -> DataFrame:
        """The table's rows of all captures, resolved against the islands of their parents."""
        rows = _free(SOURCES[name](self.snap))
        if name == "consumer_group_member_assignments":
            at = self.named.select(CK, F.col("name").alias("topic"), "k_topic_id", "modified_at",
                                   F.least(F.coalesce("_next", UNTIL), F.col(UNTIL)).alias("_over"))
            rows = (lookup(rows, at, [CK, "topic"])
                    .filter((F.col("modified_at") <= F.col(NOW)) & (F.col(NOW) < F.col("_over"))))
        if name in NODE_COLUMNS:
            nodes = self._live("nodes").select(CK, F.col("k_node_id").alias(NODE_COLUMNS[name]), F.col("_from").alias("_node_from"))
            rows = lookup(rows, nodes, [CK, NODE_COLUMNS[name]]).filter(F.col("_node_from") <= F.col(NOW))
        for lives, keys in self._parents(name):
            rows = _under(rows, lives, keys)
        spec = TABLES[name]
        return reduce_duplicates(rows.select(*spec.keys, EPOCH, END, *spec.attrs, NOW), [*spec.keys, EPOCH, END, NOW], count_col="_n")

    def _stored(self, name: str) -> DataFrame:
        rows = _free(self.run.state(name))
        for lives, keys in self._parents(name):
            rows = _stored_under(rows, lives, keys)
        return rows

    def apply(self, name: str) -> None:
        run, spec = self.run, TABLES[name]
        section = SECTIONS.get(name)
        stale = spec.delete_stale and self.read.get(section, False) and run.stored(name)
        anything = self.given.get(name, 1) > 0 or stale
        if name not in self.names or not anything or name not in SOURCES:
            self._carry(name)
            return
        history = run.store.stage_side(run.version, f"history-{name}", self._captured(name))
        found = run.store.stage_side(run.version, f"islands-{name}",
                                     islands(self._stored(name), history, name, self.ranks(name)))
        if name == "topics":
            self.named = found
        last = found.filter("_next IS NULL")
        alive = F.col(UNTIL) == _forever()
        self.lives[name] = _lives(found, spec.keys)
        run.stage(name, last.filter(alive))
        net = (F.when(F.col("_had") & ~alive, "delete").when(F.col("_had") & (F.col("action") == "insert"), "update")
               .when(F.col("_had"), F.col("action")).when(alive, "insert"))
        label = F.lit(name).alias("table_name")
        self.counted += [
            last.select(label, net.alias("metric"), F.lit(1).cast("long").alias("value")).filter("metric IS NOT NULL"),
            history.select(label, F.lit("keys").alias("metric"), F.lit(1).cast("long").alias("value")),
            history.select(label, F.lit("resolved").alias("metric"), F.col("_n").alias("value"))]
        if spec.delete_stale or any(p in run.removed for p, _ in parents_of(name)):
            self._note_removed(name, last.filter(F.col("_had") & ~alive))

    def _carry(self, name: str) -> None:
        """A table that no capture fills: stored rows go with their parents only."""
        run, spec = self.run, TABLES[name]
        state = run.state(name)
        self.lives[name] = state.select(*spec.keys, F.col("discovered_at").alias("_from"), _forever().alias(UNTIL),
                                        F.lit(True).alias("_stored"))
        if name == "topics":
            self.named = state.withColumns({UNTIL: _forever(), "_next": F.lit(None).cast("timestamp")})
        if not run.stored(name) or not any(p in run.removed for p, _ in parents_of(name)):
            return
        rows = run.store.stage_side(run.version, f"islands-{name}", self._stored(name))
        self.lives[name] = rows.select(*spec.keys, F.col("discovered_at").alias("_from"), F.col(END).alias(UNTIL),
                                       F.lit(True).alias("_stored"))
        run.stage(name, rows.filter(F.col(END) == _forever()))
        self._note_removed(name, rows.filter(F.col(END) < _forever()))

    def _note_removed(self, name: str, gone: DataFrame) -> None:
        if not gone.isEmpty():
            self.run.removed[name] = gone.select(*TABLES[name].columns)

    def accounting(self) -> DataFrame | None:
        """(table_name, metric, value): the net effect of the batch on the stored rows (a row that came and went
        within it is not counted), rows given and rows that no lookup resolved."""
        if not self.counted:
            return None
        spark = self.run.store.spark
        counted = reduce(DataFrame.unionByName, self.counted).groupBy("table_name", "metric").agg(F.sum("value").alias("value"))
        given = spark.createDataFrame([(n, "submitted", c) for n, c in self.run.given.items()] or [("", "", 0)],
                                      "table_name string, metric string, value long").filter("table_name <> ''")
        both = given.unionByName(counted)
        lost = (both.filter("metric IN ('submitted', 'resolved')").groupBy("table_name")
                .agg(F.sum(F.when(F.col("metric") == "submitted", F.col("value")).otherwise(-F.col("value"))).alias("value"),
                     F.count_if(F.col("metric") == "submitted").alias("_given")).filter("_given > 0")
                .select("table_name", F.lit("unresolved").alias("metric"), "value"))
        return both.filter("metric <> 'resolved'").unionByName(lost)


# The section whose reads decide what is stale, for the tables that remove stale rows.
SECTIONS = {"topics": "topics", "consumer_groups": "consumer_groups", "consumer_group_members": "consumer_groups",
            "consumer_group_member_assignments": "consumer_groups", "acl_resources": "acl_bindings",
            "acl_entries": "acl_bindings", "acl_bindings": "acl_bindings"}
# Tables whose rows need a known node without being its children.
NODE_COLUMNS = {"partition_replicas": "k_node_id", "consumer_groups": "coordinator_id"}
SOURCES = {
    "clusters": fl.clusters, "nodes": fl.all_nodes, "node_configs": fl.node_configs, "topics": fl.topics,
    "topic_configs": fl.topic_configs, "topic_partitions": fl.partitions, "partition_replicas": fl.replicas,
    "consumer_groups": fl.consumer_groups, "consumer_group_members": fl.group_members,
    "consumer_group_member_assignments": fl.member_assignments, "acl_resources": fl.acl_resources,
    "acl_entries": fl.acl_entries, "acl_bindings": fl.acl_bindings,
}

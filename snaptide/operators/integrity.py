"""Integrity of a state: keys held twice, and rows whose parent is not there.

A relational store enforces both by constraints; plain files do not (the checks of SURVEY 1.4 and Q13). One
report covers every table's key and every link of a child to a parent, also those that a cascade follows only
here. Each check is one aggregation or anti join on the whole key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaptide.operators.joins import lookup
from snaptide.schemas import EXTRA_PARENTS, TABLES

CK = "k_cluster_id"
# Links of the relational original that are no cascade here: (child, child's column, parent, parent's column).
NODE_LINKS = (("partition_replicas", "k_node_id"), ("consumer_groups", "coordinator_id"))


def links() -> list[tuple[str, str, list[tuple[str, str]]]]:
    """(child, parent, [(child column, parent column)]): every table under its cluster, its parents, and its nodes."""
    out = []
    for name, spec in TABLES.items():
        if name != "clusters":
            out.append((name, "clusters", [(CK, CK)]))
        parents = [(spec.parent, spec.parent_keys)] if spec.parent not in (None, "clusters") else []
        for parent, keys in parents + EXTRA_PARENTS.get(name, []):
            own = TABLES[parent].keys
            out.append((name, parent, list(zip(keys, own))))
    out += [(child, "nodes", [(CK, CK), (column, "k_node_id")]) for child, column in NODE_LINKS]
    return out


def integrity_report(tables: dict[str, DataFrame], scope: DataFrame | None = None) -> DataFrame:
    """(k_cluster_id, check, table_name, parent, n_keys): ``duplicate_key`` (keys held by several rows) and ``orphan``
    (rows without their parent), only where there are any. ``scope``: clusters to look at, all by default."""
    held = {n: t if scope is None else lookup(t, scope.select(CK).distinct(), [CK], "left_semi") for n, t in tables.items()}
    found = []
    for name, rows in held.items():
        # keys rarely repeat: dealt out first, so that no task collects the keys of whole files in memory
        keys = TABLES[name].keys
        twice = rows.select(*keys).repartition(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        found.append(twice.select(CK, F.lit("duplicate_key").alias("check"), F.lit(name).alias("table_name"),
                                  F.lit(None).cast("string").alias("parent")))
    for child, parent, columns in links():
        if child not in held or parent not in held:
            continue
        known = held[parent].select(*[F.col(p).alias(c) for c, p in columns])
        lost = lookup(held[child], known, [c for c, _ in columns], "left_anti")
        found.append(lost.select(CK, F.lit("orphan").alias("check"), F.lit(child).alias("table_name"),
                                 F.lit(parent).alias("parent")))
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy(CK, "check", "table_name", "parent").agg(F.count(F.lit(1)).alias("n_keys"))

"""Lookups on natural keys.

No size is probed and no side is forced: Spark broadcasts a side whose files or
measured stage size are under its byte threshold, shuffles both on the whole
key otherwise, and AQE splits a key that holds too much of a side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# Key columns of few values: an input holds few clusters and capture times.
FEW = ("k_cluster_id", "refreshed_at", "captured_at")


def sorting(keys) -> list[str]:
    """Key columns as rows are best sorted by them: those of few values last. A sort decides by the first bytes of the
    first column, without a look at the rows, unless these are equal; by the cluster they nearly always are."""
    return sorted(keys, key=lambda k: k in FEW)


def lookup(rows: DataFrame, parent: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Resolve ``rows`` against a parent table on natural-key columns.

    ``inner`` keeps rows whose parent exists and adds the parent's other
    columns; ``left_semi`` is a pure existence check; ``left_anti`` returns the
    rows whose parent is unknown.
    """
    found = rows.join(parent, on=sorting(on), how=how)
    if how in ("left_semi", "left_anti"):
        return found
    return found.select(*on, *found.columns[len(on):])


def existing(rows: DataFrame, parent: DataFrame, keys) -> DataFrame:
    """Rows whose parent key exists (semi join on the whole key)."""
    return lookup(rows, parent.select(*keys), list(keys), "left_semi")

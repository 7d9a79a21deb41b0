"""Cascade delete: children of removed parents go too.

Only the *removed* parent keys are joined against the child. A refresh stages
them as a small Parquet table first, so Spark sees their size and broadcasts
them below its threshold; beyond it both sides are shuffled on the parent key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from snaptide.operators.joins import lookup


def _removed_keys(removed_parents: DataFrame, on: dict[str, str]) -> DataFrame:
    return removed_parents.select(*[removed_parents[p].alias(c) for p, c in on.items()]).distinct()


def cascade(child: DataFrame, removed_parents: DataFrame,
            on: dict[str, str] | list[str]) -> tuple[DataFrame, DataFrame]:
    """Split ``child`` into (kept, removed) by the parent keys that were removed.

    ``on`` maps parent key columns to child columns (a list means same names).
    """
    if not isinstance(on, dict):
        on = {c: c for c in on}
    keys = _removed_keys(removed_parents, on)
    cols = list(on.values())
    return lookup(child, keys, cols, "left_anti"), lookup(child, keys, cols, "left_semi")


def cascade_chain(levels: list[tuple[str, DataFrame, dict[str, str] | list[str]]],
                  removed_root: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Cascade down a chain of tables: each level's removed rows remove the
    next level's children. ``levels``: (name, table, parent->child key map)."""
    out = {}
    removed = removed_root
    for name, table, on in levels:
        kept, gone = cascade(table, removed, on)
        out[name] = (kept, gone)
        removed = gone
    return out

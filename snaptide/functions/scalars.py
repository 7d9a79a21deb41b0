"""Column expressions shared by the operators. All are built-in Spark
expressions, so they stay inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from snaptide.schemas import NULL_SAFE


def unchanged(old: dict[str, Column], new: dict[str, Column], compare) -> Column:
    """True when no compared attribute differs.

    ``<=>`` treats two NULLs as equal; ``=`` follows SQL, so a NULL on either
    side counts as a change.
    """
    terms = []
    for name, op in compare:
        if op == NULL_SAFE:
            terms.append(old[name].eqNullSafe(new[name]))
        else:
            terms.append(F.coalesce(old[name] == new[name], F.lit(False)))
    if not terms:
        return F.lit(True)
    return reduce(lambda a, b: a & b, terms)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Elapsed seconds with microsecond fraction; works for both timestamp types."""
    return F.timestamp_diff("MICROSECOND", earlier, later).cast("double") / F.lit(1e6)


def velocity(new_offset: Column, old_offset: Column, now: Column, since: Column) -> Column:
    """Offsets per second since the last change; NULL when no time passed."""
    return F.try_divide((new_offset - old_offset).cast("double"), seconds_between(now, since))


def offset_or_null(offset: Column) -> Column:
    """A negative offset means "unknown"."""
    return F.when(offset >= 0, offset)


def millis_to_timestamp(ms: Column) -> Column:
    """Epoch milliseconds to a timestamp; a negative value means "unknown"."""
    return F.when(ms >= 0, F.timestamp_millis(ms))


def in_list(values: Column, item: Column) -> Column:
    """Membership that is false, not NULL, for a missing list."""
    return F.coalesce(F.array_contains(values, item), F.lit(False))


def quorum_flag(quorum: Column, test: Column) -> Column:
    """NULL when the cluster reports no quorum, else the membership test."""
    return F.when(quorum.isNotNull(), test)

"""Plain-Python row-by-row model of the merge clauses (the test oracle for
the DataFrame merge and the set-wise replay)."""

from __future__ import annotations


def same(old, new, compare):
    for c, op in compare:
        a, b = old[c], new[c]
        if op == "<=>":
            if a != b:
                return False
        else:
            if a is None or b is None or a != b:
                return False
    return True


def model_merge(state: dict, rows: list[dict], keys, compare, now, *, delete=False, velocity=None,
                scope=None):
    """Apply one capture (rows at time ``now``) to ``state`` (key -> row)."""
    out = {}
    seen = set()
    for r in rows:
        k = tuple(r[c] for c in keys)
        seen.add(k)
        old = state.get(k)
        attrs = {c: r[c] for c, _ in compare}
        if old is None:
            row = dict(zip(keys, k), **attrs, discovered_at=now, modified_at=now, refreshed_at=now,
                       action="insert")
            if velocity:
                row["velocity"] = None
        elif old["refreshed_at"] >= now:
            row = dict(old, action="keep")
        elif same(old, attrs, compare):
            row = dict(old, refreshed_at=now, action="touch")
            if velocity:
                row["velocity"] = 0.0 if (velocity == "all" or r.get("offset_type") == velocity) else None
        else:
            row = dict(old, **attrs, modified_at=now, refreshed_at=now, action="update")
            if velocity:
                applies = velocity == "all" or r.get("offset_type") == velocity
                secs = (now - old["modified_at"]).total_seconds()
                if not applies or r["offset"] is None or old["offset"] is None or secs == 0:
                    row["velocity"] = None
                else:
                    row["velocity"] = (r["offset"] - old["offset"]) / secs
        out[k] = row
    for k, old in state.items():
        if k in seen:
            continue
        in_scope = scope is not None and k[0] in scope and old["refreshed_at"] < now
        out[k] = dict(old, action="delete" if (delete and in_scope) else "keep")
    return out


def survivors(merged: dict) -> dict:
    return {k: {c: v for c, v in r.items() if c != "action"} for k, r in merged.items() if r["action"] != "delete"}

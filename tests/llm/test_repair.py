"""Conversation repair against a shortest-path search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from snaptide.llm import repair as rp

KIND = "conv_id long, turn long, role string, text string"
EMPTY = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        conv_, turn_, role, text = (" " if v is None else str(v) for v in (conv, turn, role, text))
        kind = zlib.crc32(f"{conv_}:{turn_}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(rows, faults):
    """Least cost, its least audit and the repaired lines: a search over (rows done, state)."""
    follow = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit, lines
        name, after = follow[state]
        heapq.heappush(heap, (cost + 5, audit + "I", i, after, lines + (f"{name}:",)))
        if i == len(rows):
            continue
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, lines))
        if faults[i] in ("blank", "duplicate"):
            continue
        more, (_, role, text) = 5 * (faults[i] == "truncated"), rows[i]
        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, after, lines + (f"{name}:{text}",)))
        if role[:1] == name[:1] or (role[:1] == "s" and state == 0):
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, after if role[:1] != "s" else 1, lines + (f"{role}:{text}",)))


def expected(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, role if role is not None else " ", text if text is not None else " "))
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in own:
            core = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not core else "duplicate" if (role, text) in seen
                          else "truncated" if core[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in own]
        turns = [t for t, _, _ in own if t is not None]
        cost, audit, lines = cheapest(own, faults)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(turns):
    found = rp.repair(turns)
    told = rp.transcripts(rp.messages(turns, found.edits)).withColumnRenamed("conv_id", "t_conv")
    both = found.figures.join(told, found.figures.conv_id.eqNullSafe(told.t_conv))
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in both.collect()}


def odd_rows(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(80), None]:
        for k in range(rng.choice([1, 2, 3, 5, 8, 20, 50])):
            rows.append((conv, rng.choice([None, k, k, k, k + rng.randrange(3)]),
                         rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", "User", None]),
                         rng.choice(["a.", "b!", "c", "d e? ", " \t", "", None, f"x{k}.", f"y{k}.", "z", " "])))
    rows += [(777, k, "user" if rng.random() < 0.7 else "assistant", f"t{k}" + rng.choice([".", ".", ""])) for k in range(2000)]
    rows += [(778, 0, "user", "same.")] * 600
    rows += [(779, k, "assistant", f"{k}!") for k in range(900)]      # one long run
    return rows


@pytest.mark.parametrize("bits", [15, 4])
def test_against_search(spark, monkeypatch, bits):
    monkeypatch.setattr(rp, "SEGMENT_BITS", bits)
    rows = odd_rows(bits)
    clash = spark.createDataFrame(rows, KIND).repartition(5).withColumns(
        {c: rp.F.lit("!") for c in ("digest", "pos", "segment", "edits", "symbol", "copies", "first", "kind")})
    assert repaired(clash) == expected(rows)


def test_powers_equal_single_steps():
    rng = random.Random(1)
    for _ in range(300):
        runs = tuple((rng.choice(rp.SYMBOLS), rng.choice([1, 1, 2, 3, 7, 33])) for _ in range(rng.randrange(1, 6)))
        flat = tuple((s, 1) for s, n in runs for _ in range(n))
        assert rp._matrix(list(runs)) == rp._matrix(list(flat))
        w = rp.END
        for s, n in reversed(runs):
            w = rp.before_run(s, n, w)
        assert w == rp._through(rp._matrix(list(runs)), rp.END)
        for state in range(rp.STATES):
            assert rp.unroll(list(runs), state, rp.END) == rp.unroll(list(flat), state, rp.END)


def test_long_run_is_cheap():
    runs = [("u", 1 << 17), ("x", 1 << 17), ("a", 1)]
    audit, state = rp.unroll(runs, 0, rp.END)
    assert len(audit) >= (1 << 18) and state == 3
    # an odd number of user turns: one goes, every second one of the others becomes the assistant's
    assert audit.count("D") == (1 << 17) + 1 and audit.count("R") == (1 << 16) - 1 and "I" not in audit


def test_messages_read_well(spark):
    rows = [(1, 0, "system", "be kind."), (1, 1, "user", "hi."), (1, 2, "user", "hi."), (1, 3, "user", "hello?"),
            (1, 4, "user", "how so"), (1, 5, "assistant", "well.")]
    turns = spark.createDataFrame(rows, KIND)
    found = rp.repair(turns)
    edited = rp.messages(turns, found.edits).orderBy("position", "nth").collect()
    assert [(r.edit, r.role, r.text) for r in edited] == [
        ("K", "system", "be kind."), ("D", None, None), ("D", None, None), ("K", "user", "hello?"),
        ("D", None, None), ("K", "assistant", "well.")]
    cost, audit, lines = cheapest([(k, r, t) for _, k, r, t in rows], ["", "", "duplicate", "", "truncated", ""])
    assert (cost, audit) == (6, "KDDKDK") and lines == tuple(f"{r.role}:{r.text}" for r in edited if r.edit != "D")


def test_no_rows_and_damage(spark):
    none = spark.createDataFrame([], KIND)
    assert repaired(none) == {}
    rows = [(c, t, "assistant" if t in (1, 3) else "user", f"{c} says {t}.") for c in [*range(60), None] for t in [*range(4), None]]
    got = sorted(map(tuple, rp.damaged(spark.createDataFrame(rows, KIND)).collect()), key=str)
    assert got == sorted(damaged(rows), key=str)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {r[0]: EMPTY for r in rows} | expected(damaged(rows))
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rp.query(spark, sf).collect()} == want

"""Repair of conversations' turn structure by a run-length dynamic program.

A conversation is repaired when the initials of its roles read ``(s?(ua)+)?``: an optional system turn, then
pairs of user and assistant, or nothing at all. Each row has at most one fault, the first that fits: blank
(no character besides white space), duplicate (role and text occurred earlier in the conversation),
truncated (the last such character is none of ``.!?``). Edits and their costs: Keep 0, Rerole to user or
assistant 1, Delete 2 (the only edit of blank and duplicate rows), Insert an empty user or assistant turn
anywhere 5; a truncated row that is not deleted costs 5 more. The audit is the initials of the cheapest
edits in order, of equally cheap ones the least in ASCII.

The cost of editing a row is a min-plus matrix over the four states of the pattern, and depends on the row's
symbol only (initial of the role, and fault). Equal symbols in a row are one run, which is advanced through
cached binary powers of its matrix. A conversation is cut into segments of consecutive rows: segments give
their matrices side by side, one pass over a conversation's matrices gives each segment the cost of all that
follows it, then segments unroll their choices side by side, for every state they may be entered in, again
in cached blocks of powers of two; the states are chained afterwards. So a conversation that holds a third
of all rows is spread over many tasks; what meets in one task for a conversation is one matrix for each
``SEGMENT`` of its rows. Texts stay out of it
until the edits are known.

Cases: rows are ordered by turn, null turns first, rows of one turn by role and by the SHA-256 of the
text (its first 128 bits stand for the text). Null roles and texts are one space. Repeated rows are duplicates
of the first. Null ids form one conversation. Roles of any other initial are kept by no pattern. No rows: no
conversations. Very long texts are read once for their faults and travel to their edits and to the digest.
Extra columns of any name are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaptide.llm.common import read_table, written

SEGMENT_BITS = 15
SEGMENT = 1 << SEGMENT_BITS
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
WHITE = " \t\n\x0b\x0c\r"
# States of the pattern: nothing yet, after s, after u, after a. NEXT: where a user or assistant turn leads.
STATES, NEXT = 4, (2, 2, 3, 2)
INF = 1 << 60
END = (0, 2 * INSERT, INSERT, 0)          # cost of inserting what is missing at the end
TAIL = ("", "II", "I", "")
# Symbols: initial of the role, in capitals when the row is truncated; x must be deleted.
SYMBOLS = "suaoSUAOx"
CACHED_BLOCK = 10


# ------------------------------------------------------- the min-plus program --
def _product(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(STATES)) for j in range(STATES)) for i in range(STATES))


def _through(a: tuple, w: tuple) -> tuple:
    return tuple(min(a[i][k] + w[k] for k in range(STATES)) for i in range(STATES))


def _closure() -> tuple:
    """Cheapest insertions from state to state."""
    step = [[0 if i == j else INSERT if NEXT[i] == j else INF for j in range(STATES)] for i in range(STATES)]
    for k in range(STATES):
        step = [[min(step[i][j], step[i][k] + step[k][j]) for j in range(STATES)] for i in range(STATES)]
    return tuple(map(tuple, step))


def _kept(state: int, symbol: str) -> int | None:
    """The state after keeping a row's role, if the pattern allows it."""
    initial = symbol.lower()
    if initial == "s":
        return 1 if state == 0 else None
    if initial in "ua" and NEXT[state] == (2 if initial == "u" else 3):
        return NEXT[state]
    return None


@lru_cache(maxsize=None)
def power(symbol: str, k: int) -> tuple:
    """The matrix of 2**k rows of a symbol: insertions before each row, then the row's own edit."""
    if k:
        half = power(symbol, k - 1)
        return _product(half, half)
    edit = [[INF] * STATES for _ in range(STATES)]
    more = TRUNCATED if symbol.isupper() else 0
    for i in range(STATES):
        edit[i][i] = DELETE
        if symbol != "x":
            edit[i][NEXT[i]] = min(edit[i][NEXT[i]], REROLE + more)
            kept = _kept(i, symbol)
            if kept is not None:
                edit[i][kept] = min(edit[i][kept], KEEP + more)
    return _product(_closure(), tuple(map(tuple, edit)))


def _bits(n: int):
    return [k for k in range(n.bit_length()) if n >> k & 1]


def before_run(symbol: str, n: int, w: tuple) -> tuple:
    """Cost of the rest from before a run of ``n`` rows, given that from behind it."""
    for k in _bits(n):
        w = _through(power(symbol, k), w)
    return w


def _matrix(runs: list) -> tuple:
    out = tuple(tuple(0 if i == j else INF for j in range(STATES)) for i in range(STATES))
    for symbol, n in runs:
        for k in _bits(n):
            out = _product(out, power(symbol, k))
    return tuple(tuple(min(c, INF) for c in row) for row in out)


def _row(symbol: str, state: int, w: tuple) -> tuple[str, int]:
    """Least choice of edits for one row (insertions before it included) and the state behind it."""
    rest, out = _through(power(symbol, 0), w), ""
    more = TRUNCATED if symbol.isupper() else 0
    while True:
        left, after = rest[state], NEXT[state]
        kept = None if symbol == "x" else _kept(state, symbol)
        if DELETE + w[state] == left:
            return out + "D", state
        if INSERT + rest[after] == left:
            out, state = out + "I", after
        elif kept is not None and KEEP + more + w[kept] == left:
            return out + "K", kept
        else:
            return out + "R", after


def _block(symbol: str, k: int, state: int, w: tuple) -> tuple[str, int]:
    if k == 0:
        return _row(symbol, state, w)
    head, state = unrolled_block(symbol, k - 1, state, _through(power(symbol, k - 1), w))
    tail, state = unrolled_block(symbol, k - 1, state, w)
    return head + tail, state


@lru_cache(maxsize=1 << 15)
def _cached_block(symbol: str, k: int, state: int, w: tuple) -> tuple[str, int]:
    return _block(symbol, k, state, w)


def unrolled_block(symbol: str, k: int, state: int, w: tuple) -> tuple[str, int]:
    """Choices over 2**k rows of a symbol. Only differences of costs matter, so equal blocks are found again."""
    least = min(w)
    w = tuple(c - least if c < INF else INF for c in w)
    return (_cached_block if k <= CACHED_BLOCK else _block)(symbol, k, state, w)


def unroll(runs: list, state: int, w: tuple) -> tuple[str, int]:
    """Choices over all runs from ``state``, the cost of the rest behind them being ``w``."""
    blocks = [(symbol, k) for symbol, n in runs for k in _bits(n)]
    behind = [w]
    for symbol, k in reversed(blocks):
        behind.append(_through(power(symbol, k), behind[-1]))
    behind.pop()
    out = []
    for (symbol, k), after in zip(blocks, reversed(behind)):
        part, state = unrolled_block(symbol, k, state, after)
        out.append(part)
    return "".join(out), state


@lru_cache(maxsize=1 << 14)
def _short_matrix(runs: tuple) -> tuple:
    return _matrix(runs)


@lru_cache(maxsize=1 << 14)
def _short_unroll(runs: tuple, state: int, w: tuple) -> tuple[str, int]:
    return unroll(runs, state, w)


def runs_of(symbols: str, copies: list[int]) -> tuple:
    """(symbol, length) of equal consecutive symbols; the further copies of a row are to be deleted."""
    spread = []
    for symbol, n in zip(symbols, copies):
        spread.append((symbol, 1))
        if n > 1:
            spread.append(("x", n - 1))
    return tuple((s, sum(n for _, n in part)) for s, part in groupby(spread, key=lambda x: x[0]))


# ------------------------------------------------------------------- in Spark --
def _white_trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE))


def _same_conversation(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


def turn_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest): nulls of role and text as one space."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    return rows.withColumn("digest", F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16))


def elements(rows: DataFrame) -> DataFrame:
    """One row for equal (conversation, turn, role, text): copies, symbol and faults; no texts."""
    trimmed = _white_trimmed(F.col("text"))
    marked = rows.select("conv_id", "turn", "role", "digest", (trimmed == "").alias("blank"),
                         (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("open"))
    grouped = marked.groupBy("conv_id", "turn", "role", "digest").agg(
        F.count(F.lit(1)).alias("copies"), F.max("blank").alias("blank"), F.max("open").alias("open"))
    # the first turn that says it; a struct, so that a null turn counts as the first
    first = (grouped.groupBy(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"),
                             F.col("digest").alias("f_digest")).agg(F.min(F.struct("turn")).alias("first")))
    joined = grouped.join(first, _same_conversation("conv_id", "f_conv") & (F.col("role") == F.col("f_role"))
                          & (F.col("digest") == F.col("f_digest")))
    again = ~F.col("turn").eqNullSafe(F.col("first.turn"))
    initial = F.substring("role", 1, 1)
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    n = F.col("copies")
    return joined.select(
        "conv_id", "turn", "role", "digest", "copies", known.alias("initial"),
        F.when(F.col("blank") | again, "x").when(F.col("open"), F.upper(known)).otherwise(known).alias("symbol"),
        F.when(F.col("blank"), n).otherwise(0).alias("n_blank"),
        F.when(F.col("blank"), 0).when(again, n).otherwise(n - 1).alias("n_duplicate"),
        F.when(F.col("blank") | again | ~F.col("open"), 0).otherwise(1).alias("n_truncated"))


def _summaries(spans: DataFrame) -> DataFrame:
    """Each segment's matrix, and what its neighbours have to know of it."""
    longs, names = pa.list_(pa.int64()), ("matrix", "illegal", "n_turns", "low", "high", "first", "last", "begin",
                                          "symbols", "copies")
    kinds = (longs, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(),
             pa.string(), longs)

    def one(items: list[dict]) -> tuple:
        items.sort(key=lambda x: x["pos"])
        initials = [x["initial"] for x in items]
        copies = [x["copies"] for x in items]
        turns = [x["turn"] for x in items if x["turn"] is not None]
        legal = sum(a + b in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        symbols = "".join(x["symbol"] for x in items)
        runs = runs_of(symbols, copies)
        matrix = _short_matrix(runs) if len(runs) <= 32 else _matrix(runs)
        return ([c for row in matrix for c in row], sum(copies) - 1 - legal,
                sum(a != b for a, b in zip(turns, turns[1:])) + bool(turns), turns[0] if turns else None,
                turns[-1] if turns else None, initials[0], initials[-1], items[0]["pos"], symbols, copies)

    def run(batches):
        for batch in batches:
            found = list(zip(*[one(x) for x in batch.column("items").to_pylist()])) or [()] * len(names)
            rest = [i for i, f in enumerate(batch.schema.names) if f != "items"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in rest] + [pa.array(c, type=t) for c, t in zip(found, kinds)],
                names=[batch.schema.names[i] for i in rest] + list(names))

    return spans.mapInArrow(run, "conv_id long, segment long, blank long, duplicate long, truncated long, "
                            "matrix array<long>, illegal long, n_turns long, low long, high long, first string, "
                            "last string, begin long, symbols string, copies array<long>")


def _scan(summaries: DataFrame) -> DataFrame:
    """Each conversation's figures, and for each of its segments the cost of the rest behind it."""
    parts = ("segment", "matrix", "blank", "duplicate", "truncated", "illegal", "n_turns", "low", "high", "first", "last")
    lists = summaries.groupBy("conv_id").agg(F.collect_list(F.struct(*parts)).alias("parts"))
    rest = pa.list_(pa.struct([("segment", pa.int64()), ("behind", pa.list_(pa.int64())), ("place", pa.int64())]))
    figures = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "n_segments")

    def one(segments: list[dict]) -> tuple:
        segments.sort(key=lambda x: x["segment"])
        w, out = END, []
        for i in range(len(segments) - 1, -1, -1):
            x = segments[i]
            out.append({"segment": x["segment"], "behind": list(w), "place": i})
            m = x["matrix"]
            w = _through(tuple(tuple(m[STATES * r:STATES * r + STATES]) for r in range(STATES)), w)
        pairs = list(zip(segments, segments[1:]))
        illegal = sum(x["illegal"] for x in segments) + sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in pairs)
        dated = [x for x in segments if x["low"] is not None]
        n_turns = sum(x["n_turns"] for x in dated) - sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:]))
        gaps = dated[-1]["high"] - dated[0]["low"] + 1 - n_turns if dated else 0
        return (gaps, *[sum(x[k] for x in segments) for k in ("blank", "duplicate", "truncated")], illegal, w[0],
                len(segments), out)

    def run(batches):
        for batch in batches:
            found = list(zip(*[one(x) for x in batch.column(1).to_pylist()])) or [()] * (len(figures) + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, type=pa.int64()) for c in found[:-1]], pa.array(found[-1], type=rest)],
                names=["conv_id", *figures, "rest"])

    return lists.mapInArrow(run, "conv_id long, " + ", ".join(f"{f} long" for f in figures)
                            + ", rest array<struct<segment: long, behind: array<long>, place: long>>")


def _choices(ready: DataFrame) -> DataFrame:
    """Edits of each segment from every state that it may be entered in, and the states they lead to."""
    names = ("conv_id", "segment", "begin", "symbols", "copies", "place", "n_segments", "audits", "ends")

    def one(symbols: str, copies: list, behind: list, place: int, n: int) -> tuple:
        runs, w = runs_of(symbols, copies), tuple(behind)
        audits, ends = [], []
        for state in range(STATES if place else 1):
            audit, end = (_short_unroll if len(runs) <= 32 else unroll)(runs, state, w)
            audits.append(audit + (TAIL[end] if place == n - 1 else ""))
            ends.append(end)
        return audits, ends

    def run(batches):
        for batch in batches:
            cols = {f: batch.column(f) for f in names[:-2]}
            found = list(zip(*[one(*x) for x in zip(*[batch.column(f).to_pylist() for f in (
                "symbols", "copies", "behind", "place", "n_segments")])])) or [(), ()]
            yield pa.RecordBatch.from_arrays(
                [*cols.values(), pa.array(found[0], type=pa.list_(pa.string())),
                 pa.array(found[1], type=pa.list_(pa.int64()))], names=list(names))

    return ready.mapInArrow(run, "conv_id long, segment long, begin long, symbols string, copies array<long>, place long, "
                            "n_segments long, audits array<string>, ends array<long>")


def _entered(choices: DataFrame) -> DataFrame:
    """(conv_id, segment, state): the state in which each segment of a conversation of several is entered."""
    lists = choices.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "segment", "ends"))).alias("parts"))
    start = F.struct(F.lit(0).cast("long").alias("state"),
                     F.array().cast("array<struct<segment: long, state: long>>").alias("done"))
    chained = F.aggregate("parts", start, lambda acc, x: F.struct(
        x["ends"][acc["state"].cast("int")].alias("state"),
        F.array_append(acc["done"], F.struct(x["segment"].alias("segment"), acc["state"].alias("state"))).alias("done")))
    return (lists.select(F.col("conv_id").alias("e_conv"), F.explode(chained["done"]).alias("x"))
            .select("e_conv", F.col("x.segment").alias("e_segment"), F.col("x.state").alias("state")))


def _spread(chosen: DataFrame) -> DataFrame:
    """The chosen audit dealt out to its rows: conv_id, position, edits and, for each of them, the role given
    (u or a; ``-`` where the row's own stays or the row goes)."""
    kinds = [("conv_id", pa.int64()), ("position", pa.int64()), ("edits", pa.string()), ("roles", pa.string())]

    def deal(symbols: str, copies: list, audit: str, state: int):
        at = 0
        for i, (symbol, n) in enumerate(zip(symbols, copies)):
            edits, roles = [], []
            while n or (i == len(symbols) - 1 and at < len(audit)):
                letter = audit[at]
                at += 1
                edits.append(letter)
                if letter in "IR":
                    state = NEXT[state]
                    roles.append("u" if state == 2 else "a")
                else:
                    state = _kept(state, symbol) if letter == "K" else state
                    roles.append("-")
                if letter != "I":
                    n -= 1
                    symbol = "x"
            yield "".join(edits), "".join(roles)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dealt = list(deal(row["symbols"], row["copies"], row["audit"], row["state"]))
                columns = ([row["conv_id"]] * len(dealt), range(row["begin"], row["begin"] + len(dealt)),
                           [e for e, _ in dealt], [r for _, r in dealt])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, kinds)],
                                                 names=[f for f, _ in kinds])

    return chosen.mapInArrow(run, "conv_id long, position long, edits string, roles string")


@dataclass(frozen=True)
class Repaired:
    """``figures``: conv_id, gaps, blank, duplicate, truncated, illegal, cost. ``edits``: for each distinct row
    conv_id, position (order in the conversation), turn, role, digest (of its text), edits, roles."""
    figures: DataFrame
    edits: DataFrame


def repair(turns: DataFrame) -> Repaired:
    """Faults and cheapest edits of conversations (conv_id, turn, role, text)."""
    keys = ["conv_id", "turn", "role", "digest"]
    # ranges of the order: a conversation may go over several of them, equal rows are one already
    placed = (elements(turn_rows(turns)).repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("pos", F.monotonically_increasing_id())
              .withColumn("segment", F.shiftright("pos", SEGMENT_BITS)))
    placed = written(placed, "placed")
    items = F.collect_list(F.struct("pos", "turn", "initial", "symbol", "copies"))
    spans = placed.groupBy("conv_id", "segment").agg(
        F.sum("n_blank").alias("blank"), F.sum("n_duplicate").alias("duplicate"), F.sum("n_truncated").alias("truncated"),
        items.alias("items"))
    summaries = written(_summaries(spans), "segments")
    scanned = written(_scan(summaries), "scanned")
    rest = (scanned.select(F.col("conv_id").alias("r_conv"), "n_segments", F.explode("rest").alias("r"))
            .select("r_conv", "n_segments", F.col("r.segment").alias("r_segment"), "r.behind", "r.place"))
    ready = summaries.join(rest, _same_conversation("conv_id", "r_conv") & (F.col("segment") == F.col("r_segment")))
    choices = written(_choices(ready.select("conv_id", "segment", "begin", "symbols", "copies", "behind", "place",
                                            "n_segments")), "choices")
    # nearly all conversations are one segment, entered in the first state
    several = choices.where("n_segments > 1")
    entered = _entered(several)
    states = several.join(entered, _same_conversation("conv_id", "e_conv") & (F.col("segment") == F.col("e_segment")))
    states = states.select(*choices.columns, "state")
    both = choices.where("n_segments = 1").withColumn("state", F.lit(0).cast("long")).unionByName(states)
    chosen = both.select("conv_id", "begin", "symbols", "copies", "state",
                         F.get("audits", F.col("state").cast("int")).alias("audit"))
    dealt = _spread(chosen).select("position", "edits", "roles")
    edits = placed.join(dealt, F.col("pos") == F.col("position")).select(
        "conv_id", "position", "turn", "role", "digest", "edits", "roles")
    return Repaired(scanned.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"), edits)


def messages(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """One row for each edit: conv_id, position, nth, edit, role, text. (position, nth) is the order; role and
    text are null for deleted rows."""
    # one exchange brings equal texts together and to their edits: both group and join by the same plain columns
    def keyed(rows: DataFrame) -> DataFrame:
        nulls = {f"{c}_null": F.col(c).isNull() for c in ("conv_id", "turn")}
        return rows.withColumns(nulls).fillna(0, ["conv_id", "turn"])

    keys = ["conv_id_null", "conv_id", "turn_null", "turn", "role", "digest"]
    said = keyed(turn_rows(turns)).dropDuplicates(keys).select(*keys, "text")
    stays = keyed(edits).withColumn("digest", F.when(F.col("edits").rlike("[KR]"), F.col("digest")))
    joined = stays.join(said, keys, "left").withColumn(
        "conv_id", F.when(~F.col("conv_id_null"), F.col("conv_id")))
    one = joined.select("conv_id", "position", "role", "text", "roles", F.posexplode(F.split("edits", "")).alias("nth", "edit"))
    given = F.substring(F.col("roles"), F.col("nth") + 1, F.lit(1))
    full = F.when(given == "u", "user").when(given == "a", "assistant").otherwise(F.col("role"))
    gone = F.col("edit") == "D"
    return one.select("conv_id", "position", "nth", "edit", F.when(~gone, full).alias("role"),
                      F.when(F.col("edit") == "I", "").when(~gone, F.col("text")).alias("text"))


def transcripts(edited: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256 (of ``role:text`` lines) of ``messages``' rows. The digest of a whole
    conversation is sequential by its nature: its rows stream through one task, in order, held one batch at a time."""
    lines = edited.select("conv_id", "position", "nth", "edit", F.concat("role", F.lit(":"), "text").alias("line"))
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "position", "nth").select("conv_id", "edit", "line")

    def run(batches):
        current, audit, digest, spoken = None, [], None, False

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([current], type=pa.int64()), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])],
                names=["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            ids, edits, said = (c.to_pylist() for c in batch.columns)
            done = []
            for conv, edit, line in zip(ids, edits, said):
                if digest is None or conv != current:
                    if digest is not None:
                        done.append(row())
                    current, audit, digest, spoken = conv, [], hashlib.sha256(), False
                audit.append(edit)
                if line is not None:
                    digest.update(b"\n" + line.encode() if spoken else line.encode())
                    spoken = True
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if digest is not None:
            yield row()

    return ordered.mapInArrow(run, "conv_id long, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the CRC-32 of ``conv_id:turn`` modulo 20: 0 dropped, 1 emptied, 2 without ``.!?``, 3 said
    twice, 4 by the user; nulls are one space."""
    def or_space(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    text = or_space("text")
    rows = conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(or_space("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), kind.alias("kind"))
    return (rows.where("kind <> 0")
            .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn", "role", "text"))


def query(spark, sf_dir: str) -> DataFrame:
    stored = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = damaged(stored)
    repaired = repair(turns)
    told = transcripts(messages(turns, repaired.edits)).withColumnRenamed("conv_id", "t_conv")
    figures = repaired.figures.withColumnRenamed("conv_id", "f_conv")
    every = stored.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    whole = (every.join(figures, _same_conversation("conv_id", "f_conv"), "left")
             .join(told, _same_conversation("conv_id", "t_conv"), "left"))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return whole.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))

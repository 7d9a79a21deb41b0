"""Repeated substrings by bucket-pointer refinement over a sampled suffix array.

A string of ``length`` bytes that starts at two places or more is repeated; every byte that such a string
covers can be removed. Suffixes are compared through bucket identifiers: the identifier of the 2w bytes at i
is made from those of the w bytes at i and at the later offset i + w, reused level by level, and a string of
other lengths from the identifiers at its first, last and middle offsets. Equal strings
have equal identifiers everywhere, so sorting and counting them needs no pointers between documents.

1. Initial buckets. Of every ``CELL`` consecutive q-grams (q = length - CELL + 1: all that begin inside a
   string of ``length`` bytes) the one with the smallest identifier, leftmost of equals, is the anchor of that
   string's start. Equal strings have the same anchor at the same distance, so only anchors are kept (about
   one in ``CELL / 2.4`` bytes), each with the run of starts that it stands for. Buckets are counted first;
   those of one anchor go before anything else is shuffled.
2. Whole runs. Anchors of a bucket are refined by the identifier of the whole text that their run's strings
   cover: where two agree, every start of the run is repeated, and one of them speaks for all in what follows.
3. Refinement. What is left in a bucket with several members is cut into cells of ``STEP`` starts by distance
   from the anchor. A cell whose common part is met once is done (nothing repeated); one whose whole cover is
   met twice is repeated; the rest is cut into single starts, whose identifiers decide.

Shuffled rows hold identifiers and offsets. Texts travel compressed, to the two steps that need them, and the
cover of open runs (under ``2 * CELL + length`` bytes each) is written once for step 3. Buckets are counted
with partial sums; no bucket is gathered in a task. Identifiers are 64 bits each and compared within their
initial bucket, so two independent hashes have to agree.

Intermediate tables are freed as soon as what was made from them is written.

Cases: null and empty texts and those shorter than ``length`` have nothing to remove. Repeated rows repeat
each other's text. A null id is an id of its own; rows are told apart by id and 128 bits of their text.
Texts of any size are worked off in overlapping parts of ``PART`` bytes. No rows: no rows. Other columns, of
any name, never meet the operator's own. ``length`` is 257 to 512 bytes, ``words`` 33 to 64; others raise.

The pipeline stage, and the query's ``text``, go without passages of over 50 words that two documents share as well, of
any length in bytes (``shared_passages``): steps 1 and 2 over words instead of bytes, then single starts. Words are compared by their
bytes, the white space between them is not. A document is an id with a text, so repeated rows share nothing
with each other, and what a document repeats within itself is left to the strings of ``length`` bytes.
"""

from __future__ import annotations

import hashlib

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaptide.llm.common import forget, fresh, map_rows, parts, read_table, scratch, texts, written

LENGTH = 400
CELL = 256
STEP = 16
#: The least passage of over 50 words, the consecutive grams of words that share an anchor, and the longest word hashed by table.
PASSAGE, WORD_CELL, LONG_WORD = 51, 32, 512
PART = 1 << 20
#: Texts are worked off together up to so many bytes (words): arrays long enough for numpy that stay in a core's cache.
BLOCK = 1 << 16
NO_ID = -(2**63)
#: A row: its id and 128 bits of its text.
KEY = ["doc_id", "tag", "mark"]
KEY_KINDS = "doc_id bigint, tag bigint, mark bigint"

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_BYTE = np.random.default_rng(400).integers(1, 2**63, 256).astype(np.uint64)
#: Powers of ``_C`` from the first, and of its inverse from the power 0.
_POWER = np.cumprod(np.full(1 << 16, _C, dtype=np.uint64))
_BACK = np.cumprod(np.r_[np.uint64(1), np.full(len(_POWER) - 1, pow(int(_C), -1, 1 << 64), dtype=np.uint64)])
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _pair(a, b):
    x = a * _A
    y = b * _B
    x += y
    x ^= np.right_shift(x, np.uint64(29), out=y)
    x *= _C
    x ^= np.right_shift(x, np.uint64(32), out=y)
    return x


def _blocks(sizes) -> Iterator[slice]:
    """Consecutive texts that hold ``BLOCK`` together at most, but one at least."""
    held, at = np.cumsum(sizes), 0
    while at < len(held):
        stop = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + BLOCK, side="right")))
        yield slice(at, stop)
        at = stop


def _numbered(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``counts[i]`` items of each i: i, and the item's number from 0."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


class Identifiers:
    """Bucket identifiers of all strings of 1, 2, 4, ... ``top`` bytes of a text, or words of ``word_hashes``."""

    def __init__(self, text: bytes | np.ndarray, top: int = CELL):
        self.levels = {1: text if isinstance(text, np.ndarray) else _BYTE[np.frombuffer(text, dtype=np.uint8)]}
        w = 1
        while 2 * w <= min(top, len(text)):
            f = self.levels[w]
            self.levels[2 * w] = _pair(f[:len(f) - w], f[w:])
            w *= 2
        self.top = w

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Identifiers of the strings start..start+size, sizes from ``top`` to 3 * ``top`` bytes (with the size)."""
        f, w = self.levels[self.top], self.top
        last = start + size - w
        third = (last - start) // 3
        inner = _pair(f[start + third], f[last - third])
        return _pair(_pair(f[start], f[last]), _pair(inner, size.astype(np.uint64)))

    def grams(self, q: int) -> np.ndarray:
        """Identifiers of all q-grams, q at most twice the largest level's width."""
        w = 1 << (q.bit_length() - 1)
        f = self.levels[w]
        n = len(self.levels[1]) - q + 1
        return _pair(f[:n], f[q - w:q - w + n])


def anchors(text: bytes | np.ndarray, length: int, cell: int = CELL) -> list[np.ndarray]:
    """[anchor, first start, last start, bucket, cover] of each run of starts with one anchor, for all starts of
    strings of ``length`` bytes (words)."""
    return anchors_of([text], length, cell)[1:]


def anchors_of(texts: list, length: int, cell: int = CELL) -> list[np.ndarray]:
    """[number of the text, anchor, first start, last start, bucket, cover]: ``anchors`` of several texts. They are
    laid end to end, a block at a time; strings that would cross an end are left out."""
    pieces = [(i, at) for i, text in enumerate(texts) for at in range(0, len(text) - length + 1, PART)]
    parts = [texts[i][at:at + PART + length - 1] for i, at in pieces]
    sizes, out = np.array([len(p) for p in parts], dtype=np.int64), []
    for own in _blocks(sizes):
        joined = b"".join(parts[own]) if isinstance(parts[own][0], bytes) else np.concatenate(parts[own])
        begin = np.cumsum(sizes[own]) - sizes[own]
        piece, anchor, first, last, bucket, cover = _runs(joined, begin, length, cell)
        number, at = np.array(pieces[own], dtype=np.int64).T
        shift = (at - begin)[piece]
        out.append(np.stack([number[piece], anchor + shift, first + shift, last + shift, bucket.view(np.int64), cover.view(np.int64)]))
    return list(np.concatenate(out, axis=1)) if out else [np.zeros(0, dtype=np.int64)] * 6


def _runs(joined: bytes | np.ndarray, begin: np.ndarray, length: int, cell: int) -> tuple[np.ndarray, ...]:
    """(piece, anchor, first start, last start, bucket, cover) for pieces of at least ``length``, laid end to end."""
    ids = Identifiers(joined, cell)
    least = [ids.grams(length - cell + 1)]
    ids.levels = {cell: ids.levels[cell]}
    w = 1
    while w < cell:  # smallest of 2w q-grams from those of w
        least.append(np.minimum(least[-1][:-w], least[-1][w:]))
        w *= 2
    low = least.pop()
    # the next start has another anchor where this one is its own anchor or the smallest q-gram changes
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (least[0][:len(low) - 1] == low[:-1])
    over = np.r_[begin[1:], len(joined)] - length + 1
    new[begin] = True
    new[over[:-1]] = True
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(low)] - 1
    piece = np.searchsorted(begin, first, side="right") - 1
    inside = first < over[piece]
    piece, first, last = piece[inside], first[inside], last[inside]
    anchor = first.copy()
    for part in reversed(least):  # leftmost smallest, halving the window
        w //= 2
        anchor += w * (part[anchor + w] < part[anchor])
    return piece, anchor, first, last, low[first], _pair(ids.of(first, last - first + length), (anchor - first).astype(np.uint64))


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs without ASCII white space."""
    inside = np.zeros(len(text) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(text, dtype=np.uint8)]
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def word_hashes(text: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words from start to end, by differences of running sums in spans of ``_POWER``."""
    size = end - start
    out = np.zeros(len(size), dtype=np.uint64)
    symbols, span = np.frombuffer(text, dtype=np.uint8), min(PART, len(_POWER))
    at = 0
    while at < len(size):
        base = int(start[at])
        stop = max(at + 1, int(np.searchsorted(end, base + span, side="right")))
        if size[at] <= span:
            sums = _BYTE[symbols[base:end[stop - 1]]]
            sums *= _POWER[:len(sums)]
            sums = np.r_[np.uint64(0), np.cumsum(sums)]
            a, b = start[at:stop] - base, end[at:stop] - base
            out[at:stop] = _pair((sums[b] - sums[a]) * _BACK[a], size[at:stop].astype(np.uint64))
        at = stop
    for k in np.flatnonzero(size > LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(text[start[k]:end[k]], digest_size=8).digest(), "little")
    return out


def words_of(texts: list[bytes]) -> list[np.ndarray]:
    """``word_hashes`` of all words of each text; texts are laid end to end, a block at a time."""
    sizes, out = np.array([len(t) + 1 for t in texts], dtype=np.int64), []
    for own in _blocks(sizes):
        joined = b" ".join(texts[own])
        start, end = word_bounds(joined)
        out += np.split(word_hashes(joined, start, end), np.searchsorted(start, np.cumsum(sizes[own])[:-1]))
    return out


#: Frees a query's shuffle files at its end; what is written needs them no more.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Folders:
    """Written tables of a step, freed together; the shuffles of each write are freed when it is done."""

    def __init__(self, spark) -> None:
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch(self.spark, label)
        self.paths.append(path)
        before = self.spark.conf.get(FREE_SHUFFLES, None)
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            return written(df, label, path)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, before) if before else self.spark.conf.unset(FREE_SHUFFLES)

    def free(self) -> None:
        while self.paths:
            forget(self.spark, self.paths.pop())


def _text_marks(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit("mark"), text)


def _tagged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tag, mark, text): rows of one id, null too, are told apart by 128 bits of their text."""
    rows = texts(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary"))
    tag, mark = _text_marks(F.col("text"))
    return rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), tag.alias("tag"), mark.alias("mark"), "text")


def _last_replaced(rows: DataFrame, taken: int, make: Callable[[], Callable[..., object]], name: str, kind: T.DataType) -> DataFrame:
    """``rows`` with their last ``taken`` columns replaced by one made from them row by row; the others pass unread."""
    kept = rows.schema.fields[:len(rows.columns) - taken]
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in kept), T.StructField(name, kind)])
    arrow = pa.binary() if isinstance(kind, T.BinaryType) else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in parts(batch):
                made = [step(*row) for row in zip(*(c.to_pylist() for c in part.columns[len(kept):]))]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(kept)], pa.array(made, type=arrow)],
                                                 names=[f.name for f in schema.fields])

    return rows.mapInArrow(run, schema)


def _compressed(rows: DataFrame, name: str = "packed") -> DataFrame:
    """The last column, a text as bytes, compressed."""
    return _last_replaced(rows, 1, lambda: zstandard.ZstdCompressor(level=1).compress, name, T.BinaryType())


def _place(anchor, first, last):
    """A run in one number: anchors and starts of a run are less than 256 apart."""
    return anchor << 16 | (anchor - first) << 8 | (last - first)


def _run(place):
    """(anchor, first start, last start)."""
    anchor = place >> 16
    first = anchor - (place >> 8 & 255)
    return anchor, first, first + (place & 255)


def _run_columns() -> tuple[Column, Column]:
    """First and last start of ``place``."""
    first = F.shiftright("place", 16) - F.shiftright("place", 8).bitwiseAND(F.lit(255))
    return first.cast("int"), (first + F.col("place").bitwiseAND(F.lit(255))).cast("int")


def _anchor_rows(rows: DataFrame, runs_of: Callable[[list[bytes]], list]) -> DataFrame:
    """KEY, place, bucket, cover of the runs that ``runs_of`` finds in texts."""
    def find():
        def step(columns: list) -> dict:
            number, *run, bucket, cover = runs_of(columns[-1])
            out = {n: np.array(c, dtype=np.int64)[number] for n, c in zip(KEY, columns)}
            return out | {"place": _place(*run), "bucket": bucket, "cover": cover}
        return step

    return map_rows(rows, find, f"{KEY_KINDS}, place bigint, bucket bigint, cover bigint")


def _in_shared_buckets(found: DataFrame, folders: Folders) -> DataFrame:
    """Anchors whose bucket has several: counted from identifiers alone, with partial sums. The counts are written, so
    that the join reads two plain shuffles, of which AQE can split a bucket that holds much."""
    met = folders.written(found.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "shared-buckets")
    return found.join(met.hint("merge"), "bucket", "left_semi").select(*KEY, "place", "bucket", "cover")


def repeated_spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """KEY (doc_id NO_ID for null), spans: [first start, last start] of runs of repeated strings, flat, unordered."""
    if not CELL < length <= 2 * CELL:
        raise ValueError(f"length: {CELL + 1} to {2 * CELL}")
    rows = _tagged(docs, id_col, text_col)
    every, own, refined = (Folders(docs.sparkSession) for _ in range(3))
    found = every.written(_anchor_rows(rows, lambda texts: anchors_of(texts, length)), "anchors")
    shared = own.written(_in_shared_buckets(found, every), "shared-anchors")
    every.free()
    # members of a bucket with equal cover, one of which speaks for all
    kinds = own.written(shared.groupBy("bucket", "cover").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct(*KEY, "place")).alias("one")), "covers")
    repeated = kinds.where(F.col("n") > 1).select("bucket", "cover")
    first, last = _run_columns()
    runs = shared.join(repeated, ["bucket", "cover"]).select(*KEY, first.alias("first"), last.alias("last"))
    # buckets with an unrepeated kind beside others: all their kinds take part in the refinement
    single = kinds.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    several = single.where((F.col("kinds") > 1) & (F.col("least") == 1)).select("bucket")
    parts = kinds.join(several, "bucket").select("one.*", "bucket", (F.col("n") == 1).alias("open"))
    wanted = parts.groupBy(*KEY).agg(F.collect_list(F.struct("place", "bucket", "open")).alias("runs"))
    covers = refined.written(_covers(_compressed(rows).join(wanted, KEY), length), "open-covers")
    more = _refined(covers, length, refined)
    spans = written(runs.unionByName(more).groupBy(*KEY).agg(F.flatten(F.collect_list(F.array("first", "last"))).alias("spans")),
                    "repeated-spans")
    own.free()
    refined.free()
    return spans


def _covers(rows: DataFrame, length: int) -> DataFrame:
    """KEY, bucket, open, place, cover, run: the text of each run that takes part, and a number of its own. Runs of
    repeated rows come more than once, which changes nothing: they are not open."""
    names = (*KEY, "bucket", "open", "place", "cover")

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def step(columns: list) -> dict:
            out = []
            for *key, packed, runs in zip(*columns):
                text = unpack(packed)
                for r in runs:
                    _, first, last = _run(r["place"])
                    out.append((*key, r["bucket"], r["open"], r["place"], text[first:last + length]))
            return dict(zip(names, map(list, zip(*out)))) if out else {n: [] for n in names}
        return step

    return (map_rows(rows.select(*KEY, "packed", "runs"), make,
                     f"{KEY_KINDS}, bucket bigint, open boolean, place bigint, cover binary")
            .withColumn("run", F.monotonically_increasing_id()))


def _columns(names: tuple, parts: list[tuple]) -> dict:
    """Columns from arrays of equal length."""
    return {n: np.concatenate(c) for n, c in zip(names, zip(*parts))} if parts else {n: [] for n in names}


def _refined(covers: DataFrame, length: int, folders: Folders) -> DataFrame:
    """KEY, first, last of the repeated starts among open runs."""
    names = ("run", "bucket", "open", "cell", "first", "last", "common", "whole")

    def cells():
        def step(columns: list) -> dict:
            out, covers = [], columns[4]
            sizes = np.array([len(c) for c in covers])
            run, bucket, is_open, place = (np.array(c) for c in columns[:4])
            for own in _blocks(sizes):
                ids = Identifiers(b"".join(covers[own]))
                anchor, first, last = _run(place[own])
                # distance from the anchor, cut at multiples of STEP
                low = (anchor - last) // STEP
                of, inner = _numbered((anchor - first) // STEP + 1 - low)
                cell, anchor, first, last = low[of] + inner, anchor[of], first[of], last[of]
                near, far = np.maximum(cell * STEP, anchor - last), np.minimum(cell * STEP + STEP - 1, anchor - first)
                begin, end = anchor - far, anchor - near  # starts of this cell
                at = (np.cumsum(sizes[own]) - sizes[own])[of] - first  # from places in the text to those in the block
                # the part that all strings of the cell, owned or not, have in common
                common = ids.of(at + anchor - cell * STEP, np.full(len(cell), length - STEP + 1))
                whole = _pair(ids.of(at + begin, end - begin + length), (begin - anchor + cell * STEP).astype(np.uint64))
                out.append((run[own][of], bucket[own][of], is_open[own][of], cell, begin, end, common.view(np.int64), whole.view(np.int64)))
            return _columns(names, out)
        return step

    cut = folders.written(map_rows(covers.select("run", "bucket", "open", "place", "cover"), cells,
                                   "run bigint, bucket bigint, open boolean, cell int, first int, last int, "
                                   "common bigint, whole bigint"), "cells")
    key = ["bucket", "cell", "common"]
    kinds = folders.written(cut.groupBy(*key, "whole").agg(
        F.count(F.lit(1)).alias("n"), F.max("open").alias("open"),
        F.min(F.struct("run", "first", "last")).alias("one")), "cell-covers")
    done = (cut.where("open").join(kinds.where(F.col("n") > 1).select(*key, "whole"), [*key, "whole"])
            .select("run", "first", "last"))
    left = F.max((F.col("n") == 1) & F.col("open"))
    several = kinds.groupBy(*key).agg(F.count(F.lit(1)).alias("kinds"), left.alias("left")).where("left and kinds > 1")
    parts = kinds.join(several.select(*key), key).select(((F.col("n") == 1) & F.col("open")).alias("open"), "one.*")
    # single starts of what is left, from the covers of their runs
    owner = parts.join(covers.select("run", "bucket", "place", "cover"), "run")
    one = ("run", "bucket", "open", "distance", "start", "string")

    def starts():
        def step(columns: list) -> dict:
            out, covers = [], columns[6]
            run, bucket, is_open, place, first, last = (np.array(c) for c in columns[:6])
            anchor, run_first, _ = _run(place)
            bodies = [c[a:b] for c, a, b in zip(covers, first - run_first, last - run_first + length)]
            sizes = np.array([len(b) for b in bodies])
            for own in _blocks(sizes):
                of, inner = _numbered((last - first + 1)[own])
                start = first[own][of] + inner
                string = Identifiers(b"".join(bodies[own])).of((np.cumsum(sizes[own]) - sizes[own])[of] + inner, np.full(len(of), length))
                out.append((run[own][of], bucket[own][of], is_open[own][of], anchor[own][of] - start, start, string.view(np.int64)))
            return _columns(one, out)
        return step

    single = folders.written(map_rows(owner.select("run", "bucket", "open", "place", "first", "last", "cover"), starts,
                                      "run bigint, bucket bigint, open boolean, distance int, start int, string bigint"), "starts")
    met = single.groupBy("bucket", "distance", "string").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    last = (single.where("open").join(met.select("bucket", "distance", "string"), ["bucket", "distance", "string"])
            .select("run", F.col("start").alias("first"), F.col("start").alias("last")))
    return done.unionByName(last).join(covers.select("run", *KEY), "run").select(*KEY, "first", "last")


def shared_passages(docs: DataFrame, words: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """KEY (doc_id NO_ID for null), passages: [first word, last word] of starts of passages of ``words`` words that
    another document has too, flat, unordered."""
    if not WORD_CELL < words <= 2 * WORD_CELL:
        raise ValueError(f"words: {WORD_CELL + 1} to {2 * WORD_CELL}")
    rows = _tagged(docs, id_col, text_col)
    every, own = Folders(docs.sparkSession), Folders(docs.sparkSession)

    found = every.written(_anchor_rows(rows, lambda texts: anchors_of(words_of(texts), words, WORD_CELL)), "passage-anchors")
    shared = own.written(_in_shared_buckets(found, every), "shared-passage-anchors")
    every.free()
    least, most = F.min(F.struct(*KEY)), F.max(F.struct(*KEY))
    # kinds of runs with equal cover; buckets that only one document has hold nothing shared
    kinds_of = shared.groupBy("bucket", "cover").agg(
        least.alias("least"), most.alias("most"), F.min(F.struct(*KEY, "place")).alias("one"))
    both = shared.groupBy("bucket").agg(least.alias("lo"), most.alias("hi")).where("lo < hi").select("bucket")
    kinds = own.written(kinds_of.join(both, "bucket").select("bucket", "cover", "one", (F.col("least") < F.col("most")).alias("shared")),
                        "passage-covers")
    whole = kinds.where("shared").select("bucket", "cover", F.lit(None).cast("int").alias("offset"))
    # buckets with a kind of one document beside others: single starts, one run for each kind
    several = kinds.groupBy("bucket").agg(F.min("shared").alias("all_shared")).where("not all_shared").select("bucket")
    wanted = own.written(kinds.join(several, "bucket").select("one.*", "bucket", "cover", "shared")
                         .groupBy(*KEY).agg(F.collect_list(F.struct("place", "bucket", "cover", "shared")).alias("runs")),
                         "passage-runs")
    names = (*KEY, "bucket", "cover", "shared", "offset", "string")

    def starts():
        unpack = zstandard.ZstdDecompressor().decompress

        def step(columns: list) -> dict:
            out = []
            hashes = words_of([unpack(packed) for packed in columns[3]])
            keys = [np.array(c, dtype=np.int64) for c in columns[:3]]
            # words of each run of each text, end to end
            number = np.repeat(np.arange(len(hashes)), [len(runs) for runs in columns[4]])
            every_run = [r for runs in columns[4] for r in runs]
            place, bucket, cover, shared = (np.array([r[n] for r in every_run]) for n in ("place", "bucket", "cover", "shared"))
            _, first, last = _run(place)
            bodies = [hashes[i][a:b] for i, a, b in zip(number, first, last + words)]
            sizes = np.array([len(b) for b in bodies])
            for part in _blocks(sizes):
                of, offset = _numbered((last - first + 1)[part])
                ids = Identifiers(np.concatenate(bodies[part]), WORD_CELL)
                string = ids.of((np.cumsum(sizes[part]) - sizes[part])[of] + offset, np.full(len(of), words))
                out.append((*(k[number[part]][of] for k in keys), bucket[part][of], cover[part][of], shared[part][of],
                            offset, string.view(np.int64)))
            return _columns(names, out)
        return step

    single = own.written(map_rows(_compressed(rows).join(wanted, KEY).select(*KEY, "packed", "runs"), starts,
                                  f"{KEY_KINDS}, bucket bigint, cover bigint, shared boolean, offset int, string bigint"),
                         "passage-starts")
    met = (single.groupBy("bucket", "string").agg(least.alias("lo"), most.alias("hi"), F.max("shared").alias("shared"))
           .where("shared or lo < hi").select("bucket", "string"))
    part = single.where("not shared").join(met, ["bucket", "string"]).select("bucket", "cover", "offset").distinct()
    first, last = _run_columns()
    spans = shared.join(whole.unionByName(part), ["bucket", "cover"]).select(
        *KEY, F.coalesce(first + F.col("offset"), first).alias("first"),
        (F.coalesce(first + F.col("offset"), last) + words - 1).alias("last"))
    passages = written(spans.groupBy(*KEY).agg(F.flatten(F.collect_list(F.array("first", "last"))).alias("passages")), "passages")
    own.free()
    return passages


def _remove(text: bytes, spans: list[int], length: int, passages: list[int] = ()) -> tuple[bytes, list[int], list[int]]:
    """(what is left, starts and ends of the maximal removed runs)."""
    first = np.asarray(spans[::2], dtype=np.int64)
    last = np.asarray(spans[1::2], dtype=np.int64) + length
    if len(passages):
        start, end = word_bounds(text)
        first = np.r_[first, start[np.asarray(passages[::2])]]
        last = np.r_[last, end[np.asarray(passages[1::2])]]
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.r_[True, first[1:] > last[:-1]]
    begin, end = first[new], last[np.r_[new[1:], True]]
    kept, at = [], 0
    for a, b in zip(begin.tolist(), end.tolist()):
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]]), begin.tolist(), end.tolist()


def _with_spans(rows: DataFrame, docs: DataFrame, length: int, words: int | None, id_col: str, text_col: str,
                key: list[str] = KEY) -> DataFrame:
    """``rows`` (with ``key``) and their ``spans`` and ``passages``, null where there are none, as the last columns. The
    searches run one after the other, so that only one's tables are there at a time."""
    for name, found in (("spans", repeated_spans(docs, length, id_col, text_col)),
                        ("passages", shared_passages(docs, words, id_col, text_col) if words else None)):
        own = fresh(rows, name)
        if found is None:
            rows = rows.withColumn(own, F.lit(None).cast("array<int>"))
            continue
        other = [fresh(rows, f"of_{k}") for k in KEY]
        found = found.select(*(F.col(k).alias(o) for k, o in zip(KEY, other)), F.col(name).alias(own))
        same = [rows[k] == found[o] for k, o in zip(key, other)]
        rows = rows.join(found, same, "left").drop(*other)
    return rows


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
                   keep_text: bool = True, words: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, span_starts, span_ends and
    (``keep_text``) kept_text: what is left, without characters that a removed run cuts in two. With ``words``, also
    ``text``: what is left when the passages of so many words that documents share go as well; the others are as without."""
    rows = _tagged(docs, id_col, text_col)

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def step(columns: list) -> dict:
            out = []
            for doc_id, packed, own, passages in zip(*columns):
                text = unpack(packed)
                left, begin, end = _remove(text, own, length) if own else (text, [], [])
                fewer = _remove(text, own or [], length, passages)[0] if passages else left
                out.append((None if doc_id == NO_ID else doc_id, len(text), len(text) - len(left), len(begin),
                            hashlib.sha256(left).hexdigest(), begin, end,
                            left.decode("utf-8", "ignore") if keep_text else None, fewer.decode("utf-8", "ignore") if words else None))
            return dict(zip(names, map(list, zip(*out)))) if out else {n: [] for n in names}
        return step

    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "span_starts", "span_ends", "kept_text", "text")
    joined = _with_spans(_compressed(rows), docs, length, words, id_col, text_col)
    found = map_rows(joined.select("doc_id", "packed", "spans", "passages"), make,
                     "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
                     "span_starts array<bigint>, span_ends array<bigint>, kept_text string, text string")
    return found if words else found.drop("text")


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's columns (strings of ``LENGTH`` bytes alone) and ``text``, without shared passages as well."""
    return remove_repeats(read_table(spark, sf_dir, "documents"), keep_text=False, words=PASSAGE).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text")


def drop_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without their repeated strings of ``LENGTH`` bytes and the passages of over 50 words
    that they share. Characters that a removed run cuts in two go with it; ``n_chars``, where there is such a column,
    counts what is left. Documents stay, even empty ones; null texts become empty. Repeated rows repeat each other's
    strings of ``LENGTH`` bytes; null ids, nulls in other columns and clashing names change nothing."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    key = []
    rows = docs
    for name, made in zip(KEY, (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), *_text_marks(text))):
        key.append(fresh(rows, f"own_{name}"))
        rows = rows.withColumn(key[-1], made)
    packed = fresh(rows, "packed")
    others = [c for c in docs.columns if c != "text"]
    rows = _compressed(rows.select(*others, *key, text.alias(packed)), packed)
    rows = _with_spans(rows, docs, LENGTH, PASSAGE, "doc_id", "text", key)

    def make():
        unpack = zstandard.ZstdDecompressor().decompress

        def left(whole: bytes, spans: list | None, passages: list | None) -> str:
            body = unpack(whole)
            return (_remove(body, spans or [], LENGTH, passages or [])[0] if spans or passages else body).decode("utf-8", "ignore")
        return left

    out = _last_replaced(rows.drop(*key), 3, make, "text", T.StringType())
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)

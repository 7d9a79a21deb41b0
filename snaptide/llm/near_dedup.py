"""Near duplicates by b-bit MinHash, confirmed on full shingle sets.

1. Each text gives its set of 5-word shingles (A-Z lower-cased), ``PERMUTATIONS`` minima and, of each
   minimum, the lowest ``BITS`` bits: bit ``p`` of all minima is packed into the longs of plane ``p``. Rows of
   one word sequence are one class from here on. Its node is a number given to it when the classes are written,
   so no two classes share one; the row with the smallest key (64 bits of id and text) lends its text.
2. Bands of ``BAND_ROWS`` minima give candidate keys. A similarity of 0.85 misses all bands once in 10**10
   pairs, one of 0.8 once in 10**7.
3. A key held by many documents is not expanded into pairs. Its pivot is the document that shares its keys
   with most others; every holder is compared with the pivot. Keys whose holders are then in one component
   are settled: further links there change nothing. Of other keys, the holders that meet a plausible partner of
   another component join the pool of the key's pivot: its documents outside the pivot's component are compared with all of the pool, in blocks of ``BLOCK_SHINGLES`` shingles
   on either side (a text counts as ``ROW_SHINGLES`` at least, which bounds the texts of a block), so a pool is spread over many tasks. A block counts the shingles that its whole texts share
   by one matrix product and returns links only as far as they join components: never pairs, and no more
   links than it has documents.
4. The estimate: bits that differ in any plane are counted by ``bit_count``; agreement by chance (2**-BITS)
   is taken off. Pairs below the threshold by ``MARGIN`` (six standard errors) or of too different sizes go.
5. What is left of these is confirmed on the full sets of the two whole texts. Components follow by smallest-label
   steps with pointer jumping, each step written to the shared folder, and are named by their smallest id.

Cases: texts without words are empty, linked with nothing and a component of their own row's id; texts of
fewer than five words are one shingle and linked with equal word sequences only. A null id counts as one
document that comes before all others. Repeated rows are one document: each keeps its row, with the same
verdict (the pipeline stage keeps one of them); an id with several texts has a verdict for each, by that text's links. No rows: no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaptide.llm.common import fresh, map_rows, read_table, texts, written

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SHINGLE = 5
PERMUTATIONS, BAND_ROWS, BITS = 128, 4, 4
WORDS = PERMUTATIONS // 64
MARGIN = 0.2
BLOCK_SHINGLES, ROW_SHINGLES = 50_000, 50
COLUMNS = 2048
LONG_WORD = 512
NO_ID = -(2**63)

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_BAND = _rng.integers(0, 2**63, (PERMUTATIONS // BAND_ROWS, BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


def shingle_set(text: bytes) -> set:
    """The exact set: tuples of five words, or the whole sequence as one."""
    words = words_of(text)
    if not words:
        return set()
    if len(words) < SHINGLE:
        return {tuple(words)}
    return set(zip(*(words[k:] for k in range(SHINGLE))))


class Signer:
    """Signatures of one task; hashes of up to ``limit`` words of at most ``LONG_WORD`` bytes are remembered."""

    def __init__(self, limit: int = 100_000):
        self.known: dict[bytes, int] = {}
        self.limit = limit

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        new = set(words).difference(known)
        for w in new:
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        found = np.fromiter((known[w] for w in words), dtype=np.uint64, count=len(words))
        for w in new:
            if len(w) > LONG_WORD:
                del known[w]
        return found

    def __call__(self, text: bytes) -> tuple[bytes, int, list[int], list[int]]:
        """(digest of the word sequence, set size, planes, band keys); planes and keys empty below five words."""
        words = words_of(text)
        digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
        if len(words) < SHINGLE:
            return digest, int(bool(words)), [], []
        h = self._hashes(words)
        n = len(h) - SHINGLE + 1
        x = h[:n]
        for k in range(1, SHINGLE):
            x = _mix(x * _M1 + h[k:k + n])
        x = np.unique(x)
        low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(x), 1024):
            y = x[at:at + 1024, None] * _MUL[None, :] + _ADD[None, :]
            np.minimum(low, (y ^ (y >> np.uint64(32))).min(axis=0), out=low)
        # the place of a minimum in the 64-bit range is what is small: its low bits are as good as random
        mixed = _mix(low)
        keys = _mix((low.reshape(-1, BAND_ROWS) * _BAND).sum(axis=1, dtype=np.uint64)
                    + np.arange(PERMUTATIONS // BAND_ROWS, dtype=np.uint64))
        planes = [np.packbits(((mixed >> np.uint64(p)) & np.uint64(1)).astype(np.uint8)).view("<i8") for p in range(BITS)]
        return digest, len(x), np.concatenate(planes).tolist(), keys.view(np.int64).tolist()


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """64 bits of id and text."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (NO_ID for null), row (its key), digest, n_shingles, planes, bands."""
    def make():
        signer = Signer()

        def step(columns: list) -> dict:
            found = [signer(t) for t in columns[1]]
            return {"doc_id": columns[0], "row": columns[2]} | {n: [f[k] for f in found]
                                             for k, n in enumerate(("digest", "n_shingles", "planes", "bands"))}
        return step

    rows = texts(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"),
                                                F.col("text").cast("binary").alias("text"), row_key().alias("row"))
    return map_rows(rows, make, "doc_id bigint, row bigint, digest binary, n_shingles bigint, planes array<bigint>, bands array<bigint>")


def _plausible(a: str, b: str, percent: int) -> Column:
    """Sizes and corrected estimate allow the threshold. ``a``, ``b``: prefixes of planes and n_shingles."""
    differ = F.lit(0)
    for k in range(WORDS):
        change = F.lit(0).cast("long")
        for p in range(BITS):
            change = change.bitwiseOR(F.col(f"{a}planes")[p * WORDS + k].bitwiseXOR(F.col(f"{b}planes")[p * WORDS + k]))
        differ = differ + F.bit_count(change)
    chance = 2.0 ** -BITS
    estimate = (1 - differ / PERMUTATIONS - chance) / (1 - chance)
    small, large = (f(F.col(f"{a}n_shingles"), F.col(f"{b}n_shingles")) for f in (F.least, F.greatest))
    return (100 * small >= percent * large) & (estimate >= percent / 100 - MARGIN)


def _bodies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, packed: the whole texts compressed, as they travel to the documents' pairs and pools."""
    rows = texts(docs, id_col, text_col).select(row_key().alias("row"), F.col("text").cast("binary").alias("text"))

    def make():
        pack = zstandard.ZstdCompressor(level=1).compress
        return lambda columns: {"row": columns[0], "packed": [pack(t) for t in columns[1]]}

    return map_rows(rows, make, "row bigint, packed binary")


def _confirmed(pairs: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, with the rows a_row, b_row) whose full sets meet the threshold: 100 * intersection >= percent * union."""
    left = pairs.join(bodies.withColumnsRenamed({"row": "a_row", "packed": "a_packed"}), "a_row")
    both = (left.join(bodies.withColumnsRenamed({"row": "b_row", "packed": "b_packed"}), "b_row")
            .select("a", "b", "a_packed", "b_packed"))

    def make():
        unpack = zstandard.ZstdDecompressor().decompress
        last: list = [None, set()]  # pairs with the same b come one after another

        def linked(x: bytes, y: bytes) -> bool:
            if last[0] != y:
                last[:] = [y, shingle_set(unpack(y))]
            own, other = shingle_set(unpack(x)), last[1]
            common = len(own & other)
            return 100 * common >= percent * (len(own) + len(other) - common)

        def step(columns: list) -> dict:
            hits = [(a, b) for a, b, x, y in zip(*columns) if linked(x, y)]
            return {"a": [h[0] for h in hits], "b": [h[1] for h in hits]}

        return step

    return map_rows(both, make, "a bigint, b bigint")


def _shared_counts(one: list[set], two: list[set]) -> np.ndarray:
    """Sizes of all intersections of a set of ``one`` with a set of ``two``, by products of 0/1 matrices over the
    elements that both sides have, ``COLUMNS`` at a time."""
    both = set().union(*one) & set().union(*two)
    number = {x: k for k, x in enumerate(both)}
    out = np.zeros((len(one), len(two)), dtype=np.float32)
    sides = []
    for side in (one, two):
        row = np.repeat(np.arange(len(side)), [sum(x in number for x in s) for s in side])
        column = np.fromiter((number[x] for s in side for x in s if x in number), dtype=np.int64, count=len(row))
        order = np.argsort(column, kind="stable")
        sides.append((row[order], column[order]))
    for at in range(0, len(number), COLUMNS):
        parts = []
        for (row, column), side in zip(sides, (one, two)):
            lo, hi = np.searchsorted(column, (at, at + COLUMNS))
            m = np.zeros((len(side), min(COLUMNS, len(number) - at)), dtype=np.float32)
            m[row[lo:hi], column[lo:hi] - at] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def joining_links(one: list[tuple], two: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between ``one`` and ``two`` (node, component, text), as many as join components that were apart."""
    sets = [[shingle_set(t) for _, _, t in side] for side in (one, two)]
    sizes = [np.array([len(x) for x in side], dtype=np.float32) for side in sets]
    common = _shared_counts(*sets)
    near = 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)
    parent = {c: c for side in (one, two) for _, c, _ in side}

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    out = []
    for i, j in np.argwhere(near):
        a, b = root(one[i][1]), root(two[j][1])
        if a != b:
            parent[a] = b
            out.append((one[i][0], two[j][0]))
    return out


def _pool_links(pool: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the documents of each pool. pool: pool, node, row, component, main, n_shingles."""
    outside = F.col("component") != F.col("main")
    weight = F.greatest("n_shingles", F.lit(ROW_SHINGLES))
    sizes = (pool.groupBy("pool").agg(F.sum(weight).alias("whole"), F.sum(F.when(outside, weight)).alias("part"))
             .where("part is not null")
             .select("pool", F.ceil(F.col("part") / BLOCK_SHINGLES).cast("int").alias("rows"),
                     F.ceil(F.col("whole") / BLOCK_SHINGLES).cast("int").alias("columns")))
    placed = (pool.withColumn("outside", outside).join(sizes, "pool")
              .join(bodies, "row"))

    def block(count: str, seed: int):
        return F.pmod(F.xxhash64("node", F.lit(seed)), F.col(count)).cast("int")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    columns = ["pool", "i", "j", "side", "node", "component", "packed"]
    ones = (placed.where("outside").withColumn("i", block("rows", 1)).withColumn("j", every("columns"))
            .withColumn("side", F.lit(0)).select(columns))
    twos = (placed.withColumn("j", block("columns", 2)).withColumn("i", every("rows"))
            .withColumn("side", F.lit(1)).select(columns))

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor().decompress
        sides = [list(zip(r["node"].tolist(), r["component"].tolist(), map(unpack, r["packed"].tolist())))
                 for r in (rows[rows["side"] == 0], rows[rows["side"] == 1])]
        found = joining_links(*sides, percent) if all(sides) else []
        return pd.DataFrame({"a": np.array([a for a, _ in found], dtype=np.int64),
                             "b": np.array([b for _, b in found], dtype=np.int64)})

    return ones.unionByName(twos).groupBy("pool", "i", "j").applyInPandas(step, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for all nodes of ``edges`` (a, b)."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                   "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m"))
                     .select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "labels")
    while True:
        nearest = (both.join(labels.withColumnsRenamed({"node": "b", "component": "of_b"}), "b")
                   .groupBy("a").agg(F.min("of_b").alias("near")).withColumnRenamed("a", "node"))
        hooked = labels.join(nearest, "node").select("node", F.col("component").alias("was"),
                                                      F.least("component", "near").alias("to"))
        jump = labels.withColumnsRenamed({"node": "to", "component": "beyond"})
        step = written(hooked.join(jump, "to").select("node", "was", F.least("to", "beyond").alias("component")), "labels")
        changed = not step.where(F.col("was") != F.col("component")).isEmpty()
        labels = step.select("node", "component")
        if not changed:
            return labels


def near_groups(docs: DataFrame, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, n_shingles, node (of the component, null without words), component (its smallest id) — one row for each
    row of ``docs``, NO_ID for null."""
    signed = written(signatures(docs, id_col, text_col), "signatures")
    # one class for each word sequence, empty texts aside
    of_class = (signed.where(F.col("n_shingles") > 0).groupBy("digest")
                .agg(F.min("row").alias("row"), F.min("doc_id").alias("least"), F.max("n_shingles").alias("n_shingles"),
                     F.max("planes").alias("planes"), F.max("bands").alias("bands")))
    classes = written(of_class.withColumn("node", F.monotonically_increasing_id()), "classes")
    held = classes.select("node", F.explode("bands").alias("key")).distinct()
    shared_keys = held.groupBy("key").agg(F.count(F.lit(1)).alias("holders")).where(F.col("holders") > 1)
    shared = written(held.join(shared_keys, "key"), "shared")
    weight = shared.groupBy("node").agg(F.sum("holders").alias("weight"))
    pivots = (shared.join(weight, "node").groupBy("key")
              .agg(F.max_by("node", F.struct("weight", "node")).alias("b")))
    pivots = written(pivots, "pivots")
    stars = (shared.join(pivots, "key").where(F.col("node") != F.col("b"))
             .select(F.col("node").alias("a"), "b").distinct())
    marks = classes.select("node", "row", "n_shingles", "planes")
    a_side, b_side = (marks.withColumnsRenamed({"node": side} | {c: f"{side}_{c}" for c in marks.columns[1:]}) for side in "ab")
    # each pair comes once; without an aggregation above them, AQE can split the joins of a pivot of many
    near = written(stars.join(a_side, "a").join(b_side, "b").where(_plausible("a_", "b_", percent))
                   .select("a", "b", "a_row", "b_row"),
                   "star-pairs")
    # the text of a class's row; other rows of the class have the same words
    bodies = _bodies(docs, id_col, text_col)
    star_links = written(_confirmed(near, bodies, percent).distinct(), "star-links")
    first = components(star_links)
    # keys whose holders are still in different components: the pools of their pivots
    placed = (shared.join(first, "node", "left")
              .select("key", "node", F.coalesce("component", "node").alias("component")))
    mixed = (placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
             .where(F.col("lo") != F.col("hi")))
    main = (pivots.join(first.withColumnRenamed("node", "b"), "b", "left")
            .select("key", F.col("b").alias("pool"), F.coalesce("component", "b").alias("main")))
    open_rows = written(placed.join(mixed.select("key"), "key", "left_semi").join(main, "key").join(marks, "node"), "open-keys")
    # only holders that meet a plausible partner of another component in a key, on either side
    one = open_rows.where(F.col("component") != F.col("main"))
    here = [c for c in open_rows.columns if c not in ("key", "planes")]

    def meeting(rows: DataFrame, others: DataFrame) -> DataFrame:
        near_by = others.select(F.col("key").alias("key_"), F.col("component").alias("component_"),
                                F.col("n_shingles").alias("b_n_shingles"), F.col("planes").alias("b_planes"))
        cond = ((F.col("key") == F.col("key_")) & (F.col("component") != F.col("component_"))
                & _plausible("", "b_", percent))
        return rows.join(near_by, cond, "left_semi").select(here)

    pool = written(meeting(one, open_rows).unionByName(meeting(open_rows, one)).distinct(), "pools")
    links = star_links
    if not pool.isEmpty():
        more = written(_pool_links(pool, bodies, percent), "pool-links")
        links = star_links.unionByName(more)
        first = components(links)
    # the smallest id of each component of several classes
    labels = (first.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("label")))
    reached = first.join(labels, "component").select(F.col("node").alias("of_node"), "component", "label")
    members = (classes.select("digest", "node", "least").join(reached, F.col("node") == F.col("of_node"), "left")
               .select("digest", F.coalesce("component", "node").alias("node"), F.coalesce("label", "least").alias("component")))
    found = signed.select("doc_id", "row", "digest", "n_shingles").join(members, "digest", "left")
    bare = F.col("n_shingles") == 0
    return found.select("doc_id", "row", "n_shingles", F.when(~bare, F.col("node")).alias("node"),
                        F.when(bare, F.col("doc_id")).otherwise(F.col("component")).alias("component"))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept — one row for each row of ``docs``."""
    back = lambda c: F.when(c != NO_ID, c)
    return (near_groups(docs, percent, id_col, text_col).withColumnRenamed("component", "component_id")
            .select(back(F.col("doc_id")).alias("doc_id"), "n_shingles", back(F.col("component_id")).alias("component_id"),
                    (F.col("doc_id") == F.col("component_id")).alias("kept")))


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, of the document with the smallest id (of several rows with it,
    that of the smallest row key); similarity from 0.8. Of rows that repeat id and text one stays, empty texts too."""
    own, key = fresh(docs, "own_id"), fresh(docs, "own_row")
    right, mark, n = (fresh(docs, c) for c in ("kept_doc_id", "kept_row", "copies"))
    alone = F.when(F.col("node").isNull(), F.struct("doc_id", "row"))
    one = (near_groups(docs, percent=80).groupBy("node", "doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
           .groupBy("node", alone.alias("alone")).agg(F.min(F.struct("doc_id", "row", "n")).alias("one")))
    kept = written(one.select(F.col("one.doc_id").alias(right), F.col("one.row").alias(mark), F.col("one.n").alias(n)), "kept-rows")
    rows = docs.withColumns({own: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), key: row_key()})
    joined = rows.join(kept, (F.col(own) == F.col(right)) & (F.col(key) == F.col(mark)))
    if not kept.where(F.col(n) > 1).isEmpty():
        joined = joined.where(F.col(n) == 1).unionByName(joined.where(F.col(n) > 1).dropDuplicates([own, key]))
    return joined.select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)

"""Exact copies, near copies and repeated substrings against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import ascii_fold, documents, empty
from pyspark.sql import functions as F
from snaptide.llm import exact_dedup, near_dedup, substrings
from snaptide.llm.common import read_table

SF = "/root/testdata/sf0.001"


def collected(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module", params=["cases", "table"])
def docs(request, spark):
    return documents(spark) if request.param == "cases" else read_table(spark, SF, "documents")


@pytest.mark.parametrize("bucket_rows", [4096, 2])
def test_exact_copies(spark, docs, bucket_rows):
    groups = defaultdict(list)
    for i, t in collected(docs):
        groups[ascii_fold(t)].append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    got = exact_dedup.exact_duplicates(docs, bucket_rows=bucket_rows)
    rows = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_index_directory(spark):
    docs = read_table(spark, SF, "documents")
    buckets, directory = exact_dedup.build_index(docs, bucket_rows=4)
    slots = directory.collect()
    depth = max(r.local_depth for r in slots)
    assert len({r.slot for r in slots}) == len(slots) and depth > 5
    assert all(0 <= r.slot < 2 ** depth and r.slot >> (depth - r.local_depth) << (depth - r.local_depth) == r.bucket
               for r in slots)
    assert max(r["count"] for r in buckets.groupBy("bucket").count().collect()) <= 4
    # every entry lies in the bucket that its slot points at
    point = {r.slot: r.bucket for r in slots}
    for r in buckets.collect():
        assert point[(r["hash"] % 2**64) >> (64 - depth)] == r.bucket


def jaccard_components(rows, percent):
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    sets = []
    for _, t in rows:
        w = word.findall(t.encode().lower())
        sets.append(set() if not w else {tuple(w)} if len(w) < 5 else set(zip(*(w[k:] for k in range(5)))))
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(-(2**63) if i is None else i)
    back = lambda i: None if i == -(2**63) else i
    return sorted(((rows[k][0], len(sets[k]), back(min(least[find(k)])) if sets[k] else rows[k][0])
                   for k in range(len(rows))), key=repr)


@pytest.mark.parametrize("percent", [85, 80])
def test_near_copies(spark, docs, percent):
    got = near_dedup.near_duplicates(docs, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == \
        jaccard_components(collected(docs), percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_copies_that_share_a_hub_only(spark):
    """Variants of one text, each linked with the base but not with each other; and a chain of small steps."""
    base = [f"b{i}" for i in range(60)]
    rows = [(100, " ".join(base))]
    for k in range(30):
        v = list(base)
        v[5 + k] = f"v{k}"  # changes five shingles of 56
        rows.append((200 + k, " ".join(v)))
    chain = [f"c{i}" for i in range(120)]
    for k in range(12):
        rows.append((300 + k, " ".join(chain)))
        chain = chain[3:] + [f"d{k}{j}" for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, 83).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == jaccard_components(rows, 83)


def test_pools_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 150)
    test_near_copies_that_share_a_hub_only(spark)


def test_blocks_of_short_texts_are_bounded(spark, monkeypatch):
    """Templated short texts: a block's texts are bounded, not only its shingles; links stay whole."""
    rows = [(i, " ".join(["same words in all of them but one at the end of each", f"w{i % 40}", f"v{i // 40}"])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = jaccard_components(rows, 80)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, 80).collect()),
                  key=repr) == want
    pool = spark.range(3000).selectExpr("1L AS pool", "id AS node", "id AS row", "id AS component", "-1L AS main", "7L AS n_shingles")
    bodies = spark.range(3000).selectExpr("id AS row", "encode('', 'utf-8') AS packed")
    placed = []
    kind, group = type(pool), type(pool).groupBy
    monkeypatch.setattr(kind, "groupBy", lambda self, *columns: placed.append(self) or group(self, *columns))
    near_dedup._pool_links(pool, bodies, 85)
    monkeypatch.undo()
    sides = placed[-1].groupBy("pool", "i", "j", "side").count().agg({"count": "max"}).first()[0]
    assert sides < 1.25 * near_dedup.BLOCK_SHINGLES / near_dedup.ROW_SHINGLES


def test_nodes_do_not_depend_on_row_keys(spark, monkeypatch):
    """Rows with equal keys: their classes stay apart, their links are found."""
    key = near_dedup.row_key
    monkeypatch.setattr(near_dedup, "row_key", lambda *columns: F.pmod(key(*columns), F.lit(3)))
    rows = [(i, " ".join([*(f"x{i // 2}y{k}" for k in range(40)), f"z{i}"])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i - i % 2) for i in range(40)]


def test_estimate_is_corrected():
    sign = near_dedup.Signer()
    words = [f"w{i}" for i in range(2000)]
    for cut in (0, 100, 400, 1000):
        a, b = words, words[cut:] + [f"z{i}" for i in range(cut)]
        x, y = (sign(" ".join(t).encode()) for t in (a, b))
        sa, sb = (near_dedup.shingle_set(" ".join(t).encode()) for t in (a, b))
        differ = 0
        for k in range(near_dedup.WORDS):
            change = 0
            for p in range(near_dedup.BITS):
                change |= (x[2][p * near_dedup.WORDS + k] ^ y[2][p * near_dedup.WORDS + k]) % 2**64
            differ += bin(change).count("1")
        chance = 2 ** -near_dedup.BITS
        estimate = (1 - differ / near_dedup.PERMUTATIONS - chance) / (1 - chance)
        assert abs(estimate - len(sa & sb) / len(sa | sb)) < 0.15
        assert x[1] == len(sa)


def brute_removed(rows, length):
    seen = Counter(t[p:p + length] for _, t in rows for p in range(len(t) - length + 1))
    out = []
    for i, t in rows:
        mask = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                mask[p:p + length] = b"\1" * length
        left = bytes(b for b, m in zip(t, mask) if not m)
        out.append((i, len(t), sum(mask), len(re.findall(b"\1+", bytes(mask))), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [400, 300])
def test_repeated_substrings(spark, docs, length):
    got = substrings.remove_repeats(docs, length)
    rows = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()]
    assert sorted(rows, key=repr) == brute_removed([(i, t.encode()) for i, t in collected(docs)], length)


def test_repeated_substrings_in_parts(spark, monkeypatch):
    """Anchors do not depend on how a long text is cut into parts."""
    text = "".join(f"{(i * 2654435761) % 2**32:x} " for i in range(3000)).encode()
    whole = substrings.anchors(text, 400)
    monkeypatch.setattr(substrings, "PART", 1500)
    parts = substrings.anchors(text, 400)

    def owners(runs):
        return [a for a, f, e in zip(*runs[:3]) for _ in range(f, e + 1)]

    assert owners(whole) == owners(parts) and len(owners(whole)) == len(text) - 399


@pytest.mark.parametrize("words", [False, True])
def test_texts_worked_off_together_are_taken_one_by_one(monkeypatch, words):
    """Anchors against the smallest q-gram of each start by itself, with texts laid end to end or not; few calls for many texts."""
    rng = random.Random(5)
    texts = [b"", b"ab" * 700, b"q" * 399, b"q" * 401, "é ".encode() * 500, b" "] + [
        bytes(rng.choice(b"ab c") for _ in range(rng.choice((10, 390, 400, 900)))) for _ in range(60)]
    length, cell = (51, 32) if words else (400, 256)
    own = substrings.words_of(texts) if words else texts
    if words:
        for t, found in zip(texts, own):
            start, end = substrings.word_bounds(t)
            assert found.tolist() == substrings.word_hashes(t, start, end).tolist() and len(found) == len(t.split())
    calls = []
    runs = substrings._runs
    monkeypatch.setattr(substrings, "_runs", lambda *a: calls.append(1) or runs(*a))
    together = np.stack(substrings.anchors_of(own, length, cell)).tolist()
    assert len(calls) == 1
    monkeypatch.setattr(substrings, "BLOCK", 1)
    assert np.stack(substrings.anchors_of(own, length, cell)).tolist() == together
    starts = [(i, f) for i, _, a, b, _, _ in zip(*together) for f in range(a, b + 1)]
    assert starts == [(i, f) for i, t in enumerate(own) for f in range(len(t) - length + 1)]
    for i, anchor, first, last, bucket, _ in zip(*together):
        low = substrings.Identifiers(own[i], cell).grams(length - cell + 1)
        assert all(f + int(np.argmin(low[f:f + cell])) == anchor for f in range(first, last + 1))
        assert low[anchor].view(np.int64) == bucket


def test_passages_shorter_and_longer_than_the_limit(spark):
    a, b, c = ("".join(f"{(i * k) % 2**32:x}" for i in range(1, 200)) for k in (2654435761, 40503, 97531357))
    shared, short = c[:700], b[:399]
    rows = [(1, a[:300] + shared + a[300:600]), (2, b[500:900] + shared[100:] + "q"), (3, a[700:900] + short + "u"),
            (4, short + "v" + a[900:1100]), (5, "é" * 500), (6, shared[:399])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(docs).collect()]
    assert sorted(got) == brute_removed([(i, t.encode()) for i, t in rows], 400)


def test_text_goes_without_shared_passages_and_the_rest_stays(spark):
    """60 short words are under 400 bytes: only ``text`` loses them, in both documents."""
    def own(k, n):
        return " ".join(f"{(i * k) % 9973:x}" for i in range(1, n))

    passage = own(271, 61)
    rows = [(1, f"{own(811, 90)} {passage} end"), (2, f"begin {passage} {own(1733, 90)}"), (3, own(4409, 120)), (4, None)]
    assert len(passage) < 400
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.remove_repeats(docs, words=substrings.PASSAGE).collect()}
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.values()) == brute_removed(
        [(i, (t or "").encode()) for i, t in rows], 400)
    assert {i: r.text.split() for i, r in got.items()} == {
        1: [*own(811, 90).split(), "end"], 2: ["begin", *own(1733, 90).split()], 3: own(4409, 120).split(), 4: []}


@pytest.mark.parametrize("run", [exact_dedup.exact_duplicates, near_dedup.near_duplicates, substrings.remove_repeats])
def test_no_rows(spark, run):
    assert run(empty(spark)).count() == 0

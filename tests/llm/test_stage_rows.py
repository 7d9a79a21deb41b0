"""What a stage does to rows that share an id or a text, and to passages counted in words."""

import re
from collections import defaultdict

import pytest
from cases import documents
from test_dedup import brute_removed, jaccard_components

import corpus_pipeline
from snaptide.llm import near_dedup, quality, substrings
from snaptide.llm.common import read_table

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words_from(seed: int, count: int, size: int = 3) -> list[str]:
    return [f"{(seed * 7919 + k) * 2654435761 % 2**32:08x}"[:size] + chr(97 + seed % 26) for k in range(count)]


def brute_left(rows, length, words):
    """What stays of each text without repeated strings of ``length`` bytes and passages of ``words`` words that two
    documents (id and text) share."""
    holders, places = defaultdict(set), defaultdict(int)
    for i, t in rows:
        w = WORD.findall(t)
        for k in range(len(w) - words + 1):
            holders[tuple(w[k:k + words])].add((i, t))
        for p in range(len(t) - length + 1):
            places[t[p:p + length]] += 1
    out = []
    for i, t in rows:
        mask = bytearray(len(t))
        w = list(WORD.finditer(t))
        for k in range(len(w) - words + 1):
            if len(holders[tuple(x.group() for x in w[k:k + words])]) > 1:
                a, b = w[k].start(), w[k + words - 1].end()
                mask[a:b] = b"\1" * (b - a)
        for p in range(len(t) - length + 1):
            if places[t[p:p + length]] > 1:
                mask[p:p + length] = b"\1" * length
        out.append((i, bytes(b for b, m in zip(t, mask) if not m).decode("utf-8", "ignore")))
    return sorted(out, key=repr)


def passage_rows():
    own = lambda k, n=70: " ".join(words_from(k, n))
    shared, short, tiny = words_from(91, 51), words_from(92, 50), [chr(97 + k % 26) for k in range(51)]
    refrain = " ".join(words_from(93, 51))
    mixed = words_from(94, 51, 5)
    rows = [(1, f"{own(1)} {' '.join(shared)} {own(2)}"), (2, f"{own(3)}\n{'  '.join(shared)} {own(4)}"),
            (3, f"{own(5)} {' '.join(short)} {own(6)}"), (4, f"{own(7)} {' '.join(short)} {own(8)}"),
            (5, f"{' '.join(tiny)} {own(9)}"), (6, f"{own(10)} {' '.join(tiny)}"),
            (7, f"{refrain} {own(11)} {refrain}"), (8, " ".join(words_from(95, 60))), (8, " ".join(words_from(95, 60))),
            (None, f"{own(12)} {' '.join(mixed)}"), (None, f"{' '.join(mixed)} {own(13)}"), (10, "x" * 900 + " " + own(14)),
            (11, "x" * 900 + " " + own(15))]
    rows += [(20 + k, f"{own(20 + k)} {' '.join(mixed[k % 3:])} {own(40 + k)}") for k in range(6)]
    return rows


def test_passages_of_51_words_go(spark):
    rows = passage_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in STAGES["repeated_passages"](spark, docs, SF).collect()), key=repr)
    assert got == brute_left([(i, t.encode()) for i, t in rows], 400, 51)
    left = {i: len(t.split()) for i, t in got if i is not None}
    assert left[1] == left[2] == 140 and left[3] == left[4] == 190 and left[5] == left[6] == 70
    assert left[7] == 172 and left[8] == 60 and left[20] == 140


@pytest.mark.parametrize("table", [False, True])
def test_passages_of_documents(spark, table):
    docs = read_table(spark, SF, "documents") if table else documents(spark)
    given = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    got = STAGES["repeated_passages"](spark, docs, SF).select("doc_id", "text").collect()
    want = brute_left(given, 400, 51)
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == want
    if table:
        assert sum(len(t) for _, t in want) < sum(len(t) - gone for (_, t), (_, _, gone, _, _) in zip(
            sorted(given, key=repr), brute_removed(given, 400)))


def test_words_of_any_length(monkeypatch):
    """Hashes of words do not depend on blocks or places."""
    text = (" ".join(["a", "ab", "é" * 300, "ab", "x" * 513, "a" * 512] * 9) + "\t").encode()
    start, end = substrings.word_bounds(text)
    assert [text[a:b] for a, b in zip(start, end)] == WORD.findall(text)
    whole = substrings.word_hashes(text, start, end).tolist()
    monkeypatch.setattr(substrings, "PART", 700)
    assert substrings.word_hashes(text, start, end).tolist() == whole
    assert len(set(whole)) == len(set(WORD.findall(text)))


# --- rows that share an id ------------------------------------------------------------------------------------

def kept_rows(spark, stage, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(((r.doc_id, r.text) for r in STAGES[stage](spark, docs, SF).collect()), key=repr)


def test_quality_verdict_is_of_the_row(spark):
    """Several null ids, and an id with a good and a poor text: only the poor rows go."""
    rows = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").collect()]
    rows += [(None, t + " so") for _, t in rows[:20]] + [(7000, t + " so") for _, t in rows[20:40]]
    rows += [(None, "poor"), (None, None), (7000, "a a a a a a a a a a a a"), (7001, "")]
    model = quality.fit_quality(spark.createDataFrame(rows, "doc_id long, text string"), read_table(spark, SF, "labels"))
    numbered = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id long, text string")
    good = {r.doc_id for r in quality.judge(numbered, model).collect() if r.kept}
    want = [r for k, r in enumerate(rows) if k in good]
    assert {None, 7000} <= {i for i, _ in want} and not {len(rows) - k for k in range(1, 5)} & good
    assert kept_rows(spark, "quality_rules", rows) == sorted(want, key=repr)


def test_exact_verdict_is_of_the_row(spark):
    rows = [(1, "One text"), (None, "one TEXT"), (None, "only here"), (None, None), (5, "two"), (5, "three"), (9, "Two"),
            (5, "")]
    assert kept_rows(spark, "exact_dedup", rows) == sorted(
        [(1, "One text"), (None, "only here"), (5, "three"), (9, "Two"), (5, "")], key=repr)


def near_rows():
    a, b, c, d = (words_from(k, 80) for k in (61, 62, 63, 64))
    text = lambda w, tail="": " ".join([*w, *tail.split()])
    return [(3, text(a, "x")), (4, text(b, "y")), (5, text(a)), (5, text(b)),
            (None, text(c)), (None, text(d)), (None, "alone with these few words here"), (None, ""), (8, text(c, "z"))]


def test_near_verdict_is_of_the_row(spark):
    """An id with two texts does not join their groups; null ids with different texts stay apart."""
    rows = near_rows()
    want = [rows[k] for k in (0, 1, 4, 5, 6, 7)]
    assert kept_rows(spark, "near_dedup", rows) == sorted(want, key=repr)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, 80).collect()), key=repr)
    assert got == jaccard_components([(i, t or "") for i, t in rows], 80)


def test_repeated_rows_stay_once(spark, tmp_path):
    """One of several rows with id and text stays in the stages before packing: long, empty, null id; so does one of a
    text's null-id copies and of an id's near copies."""
    base = read_table(spark, SF, "documents")
    long_rows = [r for r in base.collect() if len(r.text or "") > 3000][:12]
    schema = base.schema
    twice = [tuple(r) for r in long_rows] * 2
    near = [(6000, long_rows[0].text + tail, "en", "a", 1) for tail in (" k", " l")]
    far = [(None, " ".join(words_from(71, 300)), "en", "a", 1)] * 3 + [(6001, "", "en", "a", 0)] * 2
    docs = spark.createDataFrame(twice + near + far, schema)
    got = STAGES["near_dedup"](spark, STAGES["exact_dedup"](spark, docs, SF), SF)
    assert got.columns == docs.columns
    rows = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    assert len(rows) == len(set(rows)) and {i for i, _ in rows} >= {None, 6001}
    components = {c for _, _, c in jaccard_components([(r[0], r[1] or "") for r in twice + near + far], 80)}
    assert {i for i, _ in rows} == components
    left = {r.doc_id: r.text for r in STAGES["repeated_passages"](spark, got, SF).collect()}
    want = dict(brute_left([(i, t.encode()) for i, t in rows], 400, 51))
    assert left == want and any(len(t) > 2000 for t in left.values())


def test_run_keeps_a_document_ingested_twice(spark, tmp_path):
    table = read_table(spark, SF, "documents")
    alone = corpus_pipeline.run(spark, SF).select("doc_id").distinct().orderBy("doc_id").collect()
    table.unionByName(table).write.parquet(f"{tmp_path}/documents.parquet")
    read_table(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().orderBy("doc_id").collect() == alone


def test_rows_of_one_id_with_equal_checksums(spark):
    """Two texts of no id that share 501 bytes and a CRC-32: what they share goes, the rest stays."""
    import random
    import zlib

    rng = random.Random(1)
    start = "".join(rng.choice("abcdefghij klmnop") for _ in range(500))
    two = [start + " AxlffoDFsdAb", start + " qrdqAyysgezd"]
    assert zlib.crc32(two[0].encode()) == zlib.crc32(two[1].encode())
    docs = spark.createDataFrame([(None, t) for t in two], "doc_id long, text string")
    got = substrings.remove_repeats(docs, keep_text=False).collect()
    assert [(r.n_bytes, r.n_removed) for r in got] == [(513, 501), (513, 501)]

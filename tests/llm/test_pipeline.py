"""Every stage against brute force on what the stage before it kept; registered queries against their SQL."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from cases import NAMES, ascii_fold, documents, empty
from test_dedup import jaccard_components
from test_stage_rows import brute_left
from test_text_ops import LIBRARY

import __spark_entry__ as E
import corpus_pipeline
from snaptide.llm import queries, quality
from snaptide.llm.common import read_table

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module", params=["cases", "table"])
def docs(request, spark):
    return documents(spark) if request.param == "cases" else read_table(spark, SF, "documents")


def test_stages_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "repeated_passages", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and E.queries()["pipeline"]


def test_quality_stage(spark, docs):
    got = STAGES["quality_rules"](spark, docs, SF)
    assert got.columns == docs.columns
    model = quality.fit_quality(docs, read_table(spark, SF, "labels"))
    verdict = defaultdict(set)
    for r in quality.judge(docs, model).collect():
        assert not (r.kept and r.base_failed)
        verdict[r.doc_id].add(r.kept)
    assert Counter(i for i, _ in rows_of(got)) == Counter(i for i, _ in rows_of(docs) if False not in verdict[i])


def test_exact_stage(spark, docs):
    got = STAGES["exact_dedup"](spark, docs, SF)
    assert got.columns == docs.columns
    best = {}
    for i, t in rows_of(docs):
        if i is not None:
            best[ascii_fold(t)] = max(i, best.get(ascii_fold(t), i))
    want = [(i, t) for i, t in rows_of(docs) if best.get(ascii_fold(t)) == i]
    assert Counter(rows_of(got)) == Counter(want)


def test_near_stage(spark, docs):
    got = STAGES["near_dedup"](spark, docs, SF)
    assert got.columns == docs.columns
    verdict = defaultdict(set)
    for i, _, component in jaccard_components(rows_of(docs), 80):
        verdict[i].add(i == component)
    assert Counter(i for i, _ in rows_of(got)) == Counter(i for i, _ in rows_of(docs) if False not in verdict[i])


def test_passage_stage(spark, docs):
    got = STAGES["repeated_passages"](spark, docs, SF)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    want = brute_left([(i, t.encode()) for i, t in rows_of(docs)], 400, 51)
    assert sorted(rows_of(got), key=repr) == want
    assert all(r.n_chars == len(r.text) for r in got.collect())
    if "kept" in docs.columns:
        assert {r["kept"] for r in got.collect()} == {"kept!"}


def test_packing_stage(spark, docs):
    got = STAGES["packing"](spark, docs, SF).collect()
    tokens = sum(len(LIBRARY.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows_of(docs))
    assert sum(r.length for r in got) == tokens
    room = Counter()
    for r in got:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 2048


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_no_rows(spark, name):
    got = STAGES[name](spark, empty(spark), SF)
    assert got.count() == 0 and (name == "packing" or got.columns == empty(spark).columns)


def test_run_keeps_clean_documents_and_drops_copies(spark):
    docs = read_table(spark, SF, "documents")
    labels = {r.doc_id: r.quality for r in read_table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()}
    texts = rows_of(docs)
    assert len(kept) < len(texts)
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t) for i, t in texts}
    # clean, long enough, and without a copy of any kind: stays
    component = Counter(c for _, _, c in jaccard_components(texts, 80))
    alone = {i for i, _, c in jaccard_components(texts, 80) if component[c] == 1}
    folded = Counter(ascii_fold(t) for _, t in texts)
    for i, t in texts:
        if labels.get(i) == 1 and i in alone and folded[ascii_fold(t)] == 1 and len(words[i]) >= 10:
            windows = Counter(tuple(words[i][k:k + 5]) for k in range(len(words[i]) - 4))
            if max(windows.values(), default=0) < 2:
                assert i in kept


# --- registered queries ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    res = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in res.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, res.fetchall()))


CONTRACT = {
    "op1_": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op2_": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op3_": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op4_": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op5_": ["doc_id", "n_shingles", "component_id", "kept"],
    "op6_": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op7_": ["doc_id", "probability", "kept"],
    "op8_": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op9_": ["page_id", "host", "path", "rule", "verdict"],
    "op10_": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
}


@pytest.mark.parametrize("prefix", CONTRACT)
def test_columns_and_rows_of_each_query(spark, prefix):
    [name] = [n for n in queries.QUERIES if n.startswith(prefix)]
    df = E.queries()[name](spark, SF)
    assert set(CONTRACT[prefix]) <= set(df.columns)
    if prefix in ("op1_", "op8_"):
        return
    table, key = ("pages", "page_id") if prefix == "op9_" else ("documents", "doc_id")
    assert sorted(r[key] for r in df.select(key).collect()) == sorted(r[key] for r in read_table(spark, SF, table).select(key).collect())


def test_names_in_documents(spark):
    assert tuple(read_table(spark, SF, "documents").columns) == NAMES
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")

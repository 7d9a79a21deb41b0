"""Piece encoding and decoding against the sentencepiece library."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from cases import documents, empty

from snaptide.llm import sentence_pieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
BITS = [" ", "  ", "▁", "\n", "\r", "\t", "a", "b", "the", "é", "日", "\x00", "<s>", "</s>", "<0x41>", "<unk>", "�",
        "\U0001f600", "́", ";\r", "\r\n", "\xa0", "\x85", "\x7f", "ab" * 40, "    ", " ⁇ "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return sp.PieceModel(sp.read_model(PATH))


def as_ids(found: bytes) -> list[int]:
    return np.frombuffer(found, dtype="<u4").tolist()


def test_odd_texts(library, model):
    rng, table = random.Random(3), sp.DistinctChunks(model, limit=20_000)   # a small table is renewed on the way
    for _ in range(2500):
        text = "".join(rng.choice(BITS) for _ in range(rng.randrange(14)))
        want = library.encode(text)
        assert as_ids(table.encode([text])[0]) == want, text
        assert model.decode([*want, 2]) == library.decode([*want, 2]), text


def test_any_ids_decode(library, model):
    rng = random.Random(4)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 2, 1, 0, 28705, 259]) for _ in range(rng.randrange(8))]
        assert model.decode(ids) == library.decode(ids), ids


def test_long_chunks(library, model):
    rng = random.Random(5)
    table = sp.DistinctChunks(model)
    begun = time.time()
    for text in ("ab" * 60_000, "".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß日本", k=60_000)), " " * 50_000, "\n" * 50_000):
        assert as_ids(table.encode([text])[0]) == library.encode(text)
    assert time.time() - begun < 60
    assert all(len(chunk) <= sp.KEEP_CHARS for chunk in table.table)


def test_scan_and_heap_agree(model):
    rng = random.Random(6)
    for _ in range(500):
        chunk = "▁" + "".join(rng.choices("etaoinsrhl", k=rng.randrange(1, 30)))
        assert model._scanned(chunk) == model._heaped(chunk)


@pytest.mark.parametrize("source", ["cases", "table"])
def test_round_trip(spark, library, source):
    docs = documents(spark) if source == "cases" else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sp.round_trip(docs, PATH).collect() if source == "cases" else sp.query(spark, "/root/testdata/sf0.001").collect()

    def want(i, text):
        ids = library.encode(text or "", add_eos=True)
        return (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(library.decode(ids).encode()).hexdigest())

    def key(r):
        return (r[0] is None, r[0] or 0, *r[1:])

    assert sorted(map(tuple, got), key=key) == sorted((want(r.doc_id, r.text) for r in docs.collect()), key=key)


def test_ids_and_texts(spark, library):
    docs = documents(spark)
    encoded = sp.encode_pieces(docs, PATH, add_end=False)
    assert {(r.doc_id, tuple(as_ids(r.ids)), r.n_tokens) for r in encoded.collect()} == {
        (r.doc_id, tuple(library.encode(r.text or "")), len(library.encode(r.text or ""))) for r in docs.collect()}
    texts = {(r.doc_id, r.text) for r in sp.decode_pieces(encoded, PATH).collect()}
    assert texts == {(r.doc_id, r.text or "") for r in docs.collect()}
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert [r.text for r in sp.decode_pieces(nulls, PATH).collect()] == [""]


def test_no_rows(spark):
    assert sp.round_trip(empty(spark), PATH).count() == 0


def test_groups_are_bounded():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "text": ["x" * n for n in (5, 3_000_000, 2, 2, 1_999_990, 9, 0)]})
    groups = [g.column("doc_id").to_pylist() for g in sp._groups(iter([batch.slice(0, 0), batch, batch.slice(2, 4)]), 1)]
    assert groups == [[0], [1], [2, 3, 4], [5, 6], [2, 3, 4], [5]]


def test_other_models_are_refused(model):
    raw = sp.read_model(PATH)
    assert sp.BPE_MODEL == dict(sp._fields(dict(sp._fields(raw))[2]))[3]
    normalised = raw + bytes([0x1A, 2, 0x20, 1])        # a later normalizer message: white space is changed
    with pytest.raises(ValueError, match="white space"):
        sp.PieceModel(normalised)

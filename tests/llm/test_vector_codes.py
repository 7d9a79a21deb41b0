"""Vector codes against plain Lloyd rounds over all distances, and their SQL."""

import hashlib

import numpy as np
import pytest

from snaptide.llm import vector_codes as vc

KIND = "vec_id long, embedding array<double>, label string, codes string, dists string, error string, vector string"


def plain(vectors: np.ndarray, entries: int, rounds: int, parts: int = 4):
    cut = vectors.reshape(len(vectors), parts, -1)
    books = cut[:entries].transpose(1, 0, 2).copy()

    def distances():
        return [((cut[:, p, None, :] - books[p][None]) ** 2).sum(2) for p in range(parts)]

    for _ in range(rounds):
        for p, d in enumerate(distances()):
            nearest = d.argmin(1)
            for e in range(entries):
                mine = nearest == e
                if mine.any():
                    books[p, e] = cut[mine, p].sum(0) // mine.sum()
    found = distances()
    return np.stack([d.argmin(1) for d in found], 1), sum(d.min(1) for d in found), books


def frame(spark, rows):
    return spark.createDataFrame([r + ("x",) * 4 for r in rows], KIND)


@pytest.mark.parametrize("spread", [2, 6, 1000])
def test_active_rounds_equal_full_rounds(spark, spread):
    ints = np.random.default_rng(spread).integers(-spread, spread + 1, size=(2500, 8))
    rows = [(i, (v / vc.SCALE).tolist(), str(i % 3) if i % 4 else None) for i, v in enumerate(ints)]
    coded, books = vc.compress(frame(spark, rows).repartition(4), entries=20, rounds=6)
    codes, errors, want = plain(ints, 20, 6)
    assert (books == want).all()
    got = {r.vec_id: r for r in vc.with_label_error(coded).collect()}
    assert all(bytes(got[i].codes) == bytes(codes[i].astype(np.uint8)) and got[i].error == errors[i] for i in got)
    for label in ("0", "1", "2", None):
        mine = [r for r in got.values() if r.label == label]
        assert {r.label_error for r in mine} == {sum(r.error for r in mine)}
    assert len(got) == 2500


def test_number_types_agree(spark):
    ints = np.random.default_rng(3).integers(-9, 9, size=(300, 8))
    books = ints[:7].reshape(7, 4, 2).transpose(1, 0, 2)
    by_kind = [vc.Shape(8, 4, kind).assign(ints, books) for kind in ("f8", "i8")]
    assert all((a == b).all() for a, b in zip(*by_kind))


def test_moved_entries_are_enough():
    rng = np.random.default_rng(5)
    shape = vc.Shape(8, 4, "f8")
    ints, books = rng.integers(-3, 4, size=(800, 8)), rng.integers(-3, 4, size=(4, 16, 2))
    codes, dists = shape.assign(ints, books)
    moved = rng.random((4, 16)) < 0.3
    after = books + moved[:, :, None] * rng.integers(-2, 3, size=books.shape)
    got = shape.reassign(ints, codes, dists, after, moved)
    assert all((a == b).all() for a, b in zip(got, shape.assign(ints, after)))


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0, 4.0], "a"), (1, [1.0, 2.0, 3.0, 4.5], None), (None, [0.5, 0.5, 0.1, 0.2], None),
            (3, None, "a"), (4, [1.0, nan, 1.0, 1.0], "b"), (5, [inf, 1.0, 1.0, 1.0], "b"), (6, [None, 1.0, 1.0, 1.0], "b"),
            (7, [], "b"), (8, [1.0, 2.0, 3.0, 4.0, 5.0], "c"), (8, [1.0, 2.0, 3.0, 4.0, 5.0], "c")]
    coded, books = vc.compress(frame(spark, rows))
    got = sorted(((r.vec_id is None, r.vec_id or 0, r.label or "", r.error) for r in coded.collect()))
    assert [g[1] for g in got] == [1, 1, 7, 8, 8, 0]
    assert books.shape == (4, 4, 2)            # ids 1, 7, 8 and, last, null; width 5 filled up to 8
    assert (books[0, 0] == [1024, 2048]).all() and (books[:, 1] == 0).all()
    empty, books = vc.compress(frame(spark, rows).where("vec_id = 3"))
    assert empty.count() == 0 and books.size == 0 and vc.with_label_error(empty).count() == 0
    with pytest.raises(ValueError, match="too large"):
        vc.compress(frame(spark, [(1, [1e12] * 4, "a")]))
    with pytest.raises(ValueError):
        vc.compress(frame(spark, rows), entries=257)


def test_restored_vectors_are_near(spark):
    vectors = np.random.default_rng(9).normal(size=(600, 16))
    coded, books = vc.compress(frame(spark, [(i, v.tolist(), "a") for i, v in enumerate(vectors)]))
    off = {r.vec_id: np.abs(vc.restore(r.codes, books) - vectors[r.vec_id]).mean() for r in coded.collect()}
    assert np.mean(list(off.values())) < 0.6 * np.abs(vectors).mean()


def test_query_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = vc.query(spark, sf)
    want = con.execute(vc.ORACLE)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert hashlib.sha256(b"1,-2").hexdigest() == vc.books_digest(np.array([[[1, -2]]]))

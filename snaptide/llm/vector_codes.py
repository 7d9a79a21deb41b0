"""Vector codes: each vector cut into consecutive parts, each part coded by its nearest codebook entry.

Components become integers (floor of ``SCALE`` times the value), so every distance is exact. The codebooks
start as the parts of the smallest ids and are improved by Lloyd rounds with active entries: a round knows
which entries its update moved. A part whose assigned entry stayed where it was keeps its stored exact
distance, which no other resting entry can beat (it did not before, and nothing of the two has changed), so
it is compared with the moved entries alone; a part whose entry moved is compared with all entries. Of
equal distances the lower index wins in both cases.

Each round reads the vectors with their codes and distances from a written table, writes the next one and
frees the one before. Sums and counts of parts are added up per task, then by entry; the codebooks (entries
times width, whatever the number of vectors) are all that reaches the driver.

Cases: rows whose vector is null or holds a null, NaN or infinite component are left out; no rows left: no
rows. Vectors of several lengths, or of one that the parts do not divide, are filled up with zeros to the
common width; empty vectors have distance 0. Repeated rows are coded each on its own; a repeated id starts
one entry, with its least vector; a null id comes after all others. With fewer ids than entries there are
fewer entries. A component too large for exact distances in 64 bits is an error, named before anything is
written. Extra columns of any name are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaptide.llm.common import forget, read_table, scratch, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK = 4096
STATE = "codes binary, dists binary, error long"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           label_col: str = "label") -> DataFrame:
    """(vec_id, label, vector): rows whose vector is there and finite in every component."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                           vector.alias("vector")).where(F.col("vector").isNotNull() & finite))


@dataclass(frozen=True)
class Shape:
    """Common width, parts and the number type in which distances are exact."""
    width: int
    parts: int
    kind: str

    @classmethod
    def of(cls, rows: DataFrame, parts: int, scale: int) -> Shape | None:
        most = F.coalesce(F.array_max(F.transform("vector", F.abs)), F.lit(0.0))
        found = rows.agg(F.max(F.size("vector")).alias("width"), F.max(most).alias("most")).first()
        if found.width is None:
            return None
        width = -(-found.width // parts) * parts
        bound = 4 * (width // parts) * (int(found.most * scale) + 1) ** 2 * parts
        if bound >= 1 << 62:
            raise ValueError(f"components up to {found.most} are too large for exact distances")
        return cls(width, parts, "f8" if bound < 1 << 53 else "i8")

    def cut(self, flat: np.ndarray) -> np.ndarray:
        """(rows, parts, width of a part)."""
        return flat.reshape(len(flat), self.parts, self.width // self.parts)

    def distances(self, x: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Squared distances of every row to every entry, exact in the chosen number type."""
        x, entries = x.astype(self.kind), entries.astype(self.kind)
        return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)[None, :]

    def scan(self, x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry (lowest index of equals) and its distance for each row."""
        d = self.distances(x, entries)
        best = d.argmin(1)
        return best, d[np.arange(len(x)), best].astype(np.int64)

    def assign(self, ints: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.cut(ints)
        found = [self.scan(cut[:, p], books[p]) for p in range(self.parts)]
        return np.stack([c for c, _ in found], 1).astype(np.uint8), np.stack([d for _, d in found], 1)

    def reassign(self, ints: np.ndarray, codes: np.ndarray, dists: np.ndarray, books: np.ndarray,
                 moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """New codes and distances after an update that moved the entries marked in ``moved`` (parts, entries)."""
        cut, codes, dists = self.cut(ints), codes.copy(), dists.copy()
        for p in range(self.parts):
            lost = moved[p][codes[:, p]]
            rows = np.flatnonzero(lost)
            if len(rows):
                codes[rows, p], dists[rows, p] = self.scan(cut[rows, p], books[p])
            active, rows = np.flatnonzero(moved[p]), np.flatnonzero(~lost)
            if len(active) and len(rows):
                best, d = self.scan(cut[rows, p], books[p][active])
                best = active[best]
                wins = (d < dists[rows, p]) | ((d == dists[rows, p]) & (best < codes[rows, p]))
                codes[rows[wins], p], dists[rows[wins], p] = best[wins], d[wins]
        return codes, dists


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype=kind).reshape(len(column), width)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], type=pa.binary())


def _state(part: pa.RecordBatch, ints: pa.Array, codes: np.ndarray, dists: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [part.column(0), part.column(1), ints, _binary(codes), _binary(dists.astype("<i8")), pa.array(dists.sum(1))],
        names=["vec_id", "label", "ints", "codes", "dists", "error"])


def integer_rows(vectors: list[list[float]], width: int, scale: int = SCALE) -> np.ndarray:
    """Integer components, filled up with zeros to the common width."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = np.floor(np.asarray(v, dtype=np.float64) * scale)
    return out


def first_books(rows: DataFrame, shape: Shape, entries: int, scale: int) -> np.ndarray:
    """(parts, entries, width of a part): the parts of the smallest ids, at most ``entries`` of them."""
    seeds = rows.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries)
    least = (rows.join(F.broadcast(seeds.withColumnRenamed("vec_id", "seed")),
                       F.col("vec_id").eqNullSafe(F.col("seed")), "left_semi")
             .groupBy("vec_id").agg(F.min("vector").alias("vector")))
    found = sorted(least.collect(), key=lambda r: (r.vec_id is None, r.vec_id))
    return shape.cut(integer_rows([r.vector for r in found], shape.width, scale)).transpose(1, 0, 2).copy()


def start(rows: DataFrame, shape: Shape, books: np.ndarray, scale: int) -> DataFrame:
    """The first assignment: vec_id, label, ints and the state of each vector (``STATE``)."""
    def run(batches):
        for part in _blocks(batches):
            ints = integer_rows(part.column(2).to_pylist(), shape.width, scale)
            codes, dists = shape.assign(ints, books)
            yield _state(part, _binary(ints.astype("<i8")), codes, dists)

    kind = dict(rows.dtypes)["label"]
    return rows.mapInArrow(run, f"vec_id long, label {kind}, ints binary, {STATE}")


def advance(table: DataFrame, shape: Shape, books: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The assignment after an update of the codebooks."""
    def run(batches):
        for part in _blocks(batches):
            codes, dists = shape.reassign(_matrix(part.column(2), "<i8", shape.width),
                                          _matrix(part.column(3), "u1", shape.parts),
                                          _matrix(part.column(4), "<i8", shape.parts), books, moved)
            yield _state(part, part.column(2), codes, dists)

    return table.mapInArrow(run, table.schema)


def updated(table: DataFrame, shape: Shape, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floor of the mean of its parts; entries without parts stay."""
    parts, size, width = books.shape

    def run(batches):
        sums = np.zeros((parts, size, width), dtype=np.int64)
        n = np.zeros((parts, size), dtype=np.int64)
        for part in _blocks(batches):
            cut = shape.cut(_matrix(part.column(0), "<i8", shape.width))
            codes = _matrix(part.column(1), "u1", parts)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], cut[:, p])
                n[p] += np.bincount(codes[:, p], minlength=size)
        used = np.flatnonzero(n.ravel())
        flat = sums.reshape(parts * size, width)[used]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, width + 1)), pa.array(np.tile(np.arange(-1, width), len(used))),
             pa.array(np.concatenate([n.ravel()[used, None], flat], 1).ravel())], names=["entry", "place", "total"])

    total = (table.select("ints", "codes").mapInArrow(run, "entry long, place long, total long")
             .groupBy("entry", "place").agg(F.sum("total").alias("total")).collect())
    sums = np.zeros((parts * size, width + 1), dtype=np.int64)
    for r in total:
        sums[r.entry, r.place + 1] = r.total
    n = sums[:, :1]
    new = np.where(n > 0, np.floor_divide(sums[:, 1:], np.maximum(n, 1)), books.reshape(parts * size, width))
    return new.reshape(books.shape)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
             scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, codes binary of one byte for each part, dists, error) as a written table, and the final
    codebooks (parts, entries, width of a part). At most 256 entries, so that a code is a byte."""
    if not 1 <= entries <= 256:
        raise ValueError("a code of one byte names 1 to 256 entries")
    rows = usable(vectors, id_col, vector_col, label_col)
    shape = Shape.of(rows, parts, scale)
    if shape is None:
        spark = vectors.sparkSession
        kind = f"vec_id long, label {dict(rows.dtypes)['label']}, ints binary, {STATE}"
        return spark.createDataFrame([], kind), np.zeros((parts, 0, 0), dtype=np.int64)
    books = first_books(rows, shape, entries, scale)
    path = scratch(vectors.sparkSession, "codes")
    table = written(start(rows, shape, books, scale), "codes", path)
    for _ in range(rounds):
        new = updated(table, shape, books)
        moved = (new != books).any(axis=2)
        books, old, path = new, path, scratch(vectors.sparkSession, "codes")
        table = written(advance(table, shape, books, moved), "codes", path)
        forget(vectors.sparkSession, old)
    return table, books


def restore(codes: bytes, books: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for (entries, scaled back)."""
    return np.concatenate([books[p][c] for p, c in enumerate(codes)]) / scale


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the error summed over equal labels; null labels count as one."""
    total = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(total, F.col("label").eqNullSafe(F.col("of_label")), "left")


def query(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(read_table(spark, sf_dir, "embeddings"))
    return with_label_error(coded).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error",
        F.lit(books_digest(books)).alias("codebooks_sha256"))


def _rounds() -> str:
    """The assignments and updates of the SQL, one after the other."""
    out = []
    for r in range(ROUNDS + 1):
        out.append(f"""a{r} AS MATERIALIZED (SELECT rid, part, min({{'d': d, 'e': e}}) AS m FROM (
            SELECT rid, part, e, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{r} c USING (part, pos)
            GROUP BY rid, part, e) GROUP BY rid, part)""")
        if r < ROUNDS:
            out.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.part, c.e, c.pos,
            CASE WHEN n IS NULL THEN c.v ELSE (s - ((s % n) + n) % n) // n END AS v
            FROM c{r} c LEFT JOIN (SELECT part, m.e AS e, pos, sum(v)::BIGINT AS s, count(*) AS n
                                   FROM a{r} JOIN x USING (rid, part) GROUP BY part, m.e, pos) t
            ON c.part = t.part AND c.e = t.e AND c.pos = t.pos)""")
    return ",\n".join(out)


ORACLE = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS rid, vec_id, label, embedding, len(embedding) // {PARTS} AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda f: f IS NULL OR NOT isfinite(f))) = 0),
u AS (SELECT rid, vec_id, w, unnest(embedding)::DOUBLE AS f, generate_subscripts(embedding, 1) - 1 AS i FROM kept),
x AS MATERIALIZED (SELECT rid, vec_id, i // w AS part, i % w AS pos, floor({SCALE} * f)::BIGINT AS v FROM u),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {ENTRIES}),
c0 AS MATERIALIZED (SELECT part, e, pos, v FROM x JOIN seeds USING (vec_id)),
{_rounds()},
coded AS (SELECT vec_id, label, string_agg(format('{{:02x}}', m.e), '' ORDER BY part) AS code,
                 sum(m.d)::BIGINT AS error FROM a{ROUNDS} JOIN kept USING (rid) GROUP BY rid, vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, e, pos)) FROM c{ROUNDS}) AS codebooks_sha256
FROM coded"""

"""Helpers shared by the text operators: column names, ASCII folding, written tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snaptide.session import checkpoint_dir

BATCH_ROWS = 500
BATCH_BYTES = 16 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` folds every script, so it serves pure-ASCII text (its fast
    case); other text takes the character map."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or scratch(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Free a folder that ``scratch`` named, once nothing reads it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), null text as empty: extra columns of any name never meet the operators' own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` (all columns, unchanged) whose id is in ``kept.doc_id``; null ids match null ids."""
    right = fresh(docs, "kept_id")
    ids = kept.select(F.col("doc_id").alias(right)).distinct()
    return docs.join(ids, docs[id_col].cast("long").eqNullSafe(ids[right]), "left_semi")


def text_digest(text_col: str = "text") -> Column:
    """SHA-256 of the text, null text as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))


def drop_rows(docs: DataFrame, dropped: DataFrame, digest: Column, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id and ``digest`` (of their text) are not together in ``dropped`` (doc_id, digest); null
    ids match null ids. An id, null too, may have several texts with a verdict for each."""
    own, right, mark = (fresh(docs, n) for n in ("own_digest", "dropped_id", "dropped_digest"))
    gone = dropped.select(F.col("doc_id").alias(right), F.col("digest").alias(mark)).distinct()
    rows = docs.withColumn(own, digest)
    same = rows[id_col].cast("long").eqNullSafe(gone[right]) & (rows[own] == gone[mark])
    return rows.join(gone, same, "left_anti").drop(own)


ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(),
         "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()),
         "array<int>": pa.list_(pa.int32()), "int": pa.int32()}


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes of text, but one row at least."""
    size = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    held = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        room = (held[at - 1] if at else 0) + BATCH_BYTES
        stop = min(at + BATCH_ROWS, max(at + 1, int(np.searchsorted(held, room, side="right"))))
        yield batch.slice(at, stop - at)
        at = stop


def map_rows(rows: DataFrame, make: Callable[[], Callable[[list], dict]], schema: str) -> DataFrame:
    """Arrow batches of ``rows`` through ``make()()``: the inner function, built once for each task, gets
    the columns as lists and returns the output columns as lists. They come in the slices of ``parts``."""
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [ARROW[part.split()[1]] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in parts(batch):
                out = step([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[n], type=k) for n, k in zip(names, kinds)], names=names)

    return rows.mapInArrow(run, schema)

"""Exact duplicates through an extendible-hash index kept in shared files. Built-in expressions only.

The index has one entry for each distinct text. Its 64-bit hash decides the bucket: a directory of
``2**depth`` slots points at buckets of at most ``bucket_rows`` entries; a bucket that holds more is split
by doubling the directory (one more hash bit), buckets below the limit stay shared by several slots.
Entries with equal hash cannot be split: they stay chained in their bucket, told apart by their bytes.

Copies are folded before the shuffle: the aggregation keyed by (hash, text) compares the bytes of equal
hashes and keeps one row for each text and task, so a text that a third of all rows share is one entry.
Bucket files are written by owner tasks, each of which holds a range of slots, sorted by hash.

Cases: a null text is an empty one; all empty texts are equal. A null id never wins against a number;
if all ids of a text are null, ``keep_id`` is null and those rows are kept. Rows that repeat the id and
the text are one document: each gets its row in the result, with the same verdict. No rows: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snaptide.llm.common import ascii_lower, drop_rows, read_table, scratch, texts, written

BUCKET_ROWS = 4096


def _slot(depth: int) -> Column:
    return F.shiftrightunsigned("hash", 64 - depth) if depth else F.lit(0).cast("long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = texts(docs, id_col, text_col).select("doc_id", ascii_lower(F.col("text")).alias("norm"))
    return rows.withColumn("hash", F.xxhash64("norm"))


def _entries(keyed: DataFrame) -> DataFrame:
    """One entry for each distinct text; ``chain`` counts the entries of one hash."""
    folded = (keyed.groupBy("hash", "norm")
              .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
              .select("hash", F.unhex(F.sha2("norm", 256)).alias("digest"),
                      F.octet_length("norm").cast("long").alias("n_bytes"), "keep_id", "group_size"))
    link = Window.partitionBy("hash").orderBy("n_bytes", "digest")
    return folded.withColumn("chain", F.row_number().over(link).cast("long"))


def build_index(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id",
                text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write the index to the shared folder; return (buckets, directory) as read back.

    buckets: bucket, local_depth, hash, chain, digest, n_bytes, keep_id, group_size.
    directory: slot, bucket, local_depth (slots whose bucket is empty have no row). Only one number for each doubling (are there overfull
    buckets?) reaches the driver.
    """
    spark, root = docs.sparkSession, scratch(docs.sparkSession, "hash-index")
    entries = written(_entries(_keyed(docs, id_col, text_col)), "", f"{root}/entries")
    total = entries.count()
    depth = first = max(0, math.ceil(math.log2(total / bucket_rows))) if total else 0
    open_rows, levels = entries.select("hash"), []
    while True:
        level = written(open_rows.groupBy(_slot(depth).alias("prefix"))
                        .agg(F.count(F.lit(1)).alias("n"),
                             (F.min("hash") < F.max("hash")).alias("splits")),
                        "", f"{root}/levels/{depth}")
        overfull = level.where((F.col("n") > bucket_rows) & F.col("splits"))
        levels.append(level.where((F.col("n") <= bucket_rows) | ~F.col("splits"))
                      .select("prefix", F.lit(depth).alias("local_depth")))
        if depth == 63 or overfull.isEmpty():
            break
        open_rows = (open_rows.withColumn("prefix", _slot(depth))
                     .join(overfull.select("prefix"), "prefix", "left_semi").select("hash"))
        depth += 1
    leaves = levels[0]
    for level in levels[1:]:
        leaves = leaves.unionByName(level)
    width = F.pow(F.lit(2), F.lit(depth) - F.col("local_depth")).cast("long")
    directory = written(
        leaves.select(F.explode(F.sequence(F.col("prefix") * width, (F.col("prefix") + 1) * width - 1)).alias("slot"),
                      (F.col("prefix") * width).alias("bucket"), "local_depth"),
        "", f"{root}/directory")
    buckets = (entries.withColumn("slot", _slot(depth)).join(directory, "slot")
               .select("bucket", "local_depth", "hash", "chain", "digest", "n_bytes", "keep_id", "group_size")
               .repartitionByRange(max(1, 2 ** (first // 2)), "bucket", "hash")
               .sortWithinPartitions("bucket", "hash", "chain"))
    return written(buckets, "", f"{root}/buckets"), directory


def exact_duplicates(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain."""
    buckets, _ = build_index(docs, bucket_rows, id_col, text_col)
    probes = _keyed(docs, id_col, text_col).select(
        "doc_id", "hash", F.unhex(F.sha2("norm", 256)).alias("digest"))
    return (probes.join(buckets, ["hash", "digest"])
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256"), "bucket", "chain"))


def drop_exact_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts the row with the largest id stays."""
    found = exact_duplicates(docs)
    norm = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return drop_rows(docs, found.where(~F.col("kept")).select("doc_id", F.unhex("text_sha256").alias("digest")),
                     F.unhex(F.sha2(norm, 256)))


def query(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}',
                                    '{"abcdefghijklmnopqrstuvwxyz"}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM n WINDOW g AS (PARTITION BY norm)"""

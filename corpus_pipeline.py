"""The corpus pipeline: quality rules, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared
folder and reads it again as the next stage's documents. All but the last return the columns of documents.
SQL cannot express the stages (boosted trees, MinHash components, byte runs, best fit), so there is no
``ORACLE_SQL``; tests/llm compares every stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snaptide.llm.common import read_table, written
from snaptide.llm.exact_dedup import drop_exact_duplicates
from snaptide.llm.near_dedup import drop_near_duplicates
from snaptide.llm.packing import pack_stage
from snaptide.llm.quality import drop_low_quality
from snaptide.llm.substrings import drop_repeats

STAGES = [
    ("quality_rules", drop_low_quality),
    ("exact_dedup", drop_exact_duplicates),
    ("near_dedup", drop_near_duplicates),
    ("repeated_passages", drop_repeats),
    ("packing", pack_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

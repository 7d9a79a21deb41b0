"""Session helpers.

On a cluster the session is built by the platform; ``get_spark`` only fills in
settings that are unset, so cluster-level configuration always wins.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings this library relies on. They are applied only where the session has
# no value yet (``setdefault`` semantics).
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
}


def get_spark(master: str | None = None, app: str = "snaptide", shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        spark = active
    else:
        builder = SparkSession.builder.appName(app)
        if master:
            builder = builder.master(master)
        builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        if shuffle_partitions is not None:
            builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        spark = builder.getOrCreate()
    conf = spark.conf
    for key, value in _DEFAULTS.items():
        if conf.get(key, None) in (None, ""):
            conf.set(key, value)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    Read from ``spark.checkpoint.dir``; only when it is unset (local tests) a
    fresh local folder is created and registered.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="snaptide-ckpt-", dir=os.environ.get("SNAPTIDE_LOCAL_TMP", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path

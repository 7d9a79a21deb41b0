"""snaptide: keep typed current-state tables in step with repeated snapshots of
streaming-cluster metadata, written as Spark DataFrame jobs.

Every operator takes DataFrames and returns DataFrames; nothing is collected to
the driver except single numbers (ranks, counts) and publish bookkeeping.
"""

from snaptide.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]

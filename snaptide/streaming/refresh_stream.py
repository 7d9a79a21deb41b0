"""Structured Streaming over arriving captures.

* ``start_metadata_refresh`` (Y1): snapshot files -> ``foreachBatch`` ->
  ``refresh_metadata`` into a ``StateStore``; one new version per
  micro-batch, trigger period 30 s by default.
* ``start_offset_refresh`` (Y2, Y4): group / partition offset captures ->
  ``foreachBatch`` -> ``refresh_offsets`` against the latest committed
  metadata (a stream-static lookup), 2 s trigger by default.
* ``start_resolved_offsets`` (Y4): partition-offset captures joined with the
  known partitions inside the streaming plan (stream-static), plain file sink.
* ``start_capture_history`` (Y3 alternative): captures appended to a
  Parquet history with a plain file sink; ``replay`` over that history gives
  the same state set-wise. It needs no Python callback, so it also runs
  where ``foreachBatch`` cannot.

Retries are safe: a micro-batch whose epoch (per stream name) is already
committed is skipped, and a capture not after its cluster's last applied one
changes nothing. A micro-batch may hold any captures: several of a cluster
are applied in order, chunks of one capture wait in the store for the rest. Each stream writes its own store (one writer per store);
the offset streams read the metadata store for key resolution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from snaptide.operators.lookup_plans import resolve_partition_offsets
from snaptide.operators.offsets import clean_partition_offsets
from snaptide.plans.refresh import HOLD_BACK, refresh_metadata, refresh_offsets
from snaptide.plans.state import StateStore
from snaptide.sources.snapshots import read_record_log, split_group_events, stream_snapshots
from snaptide.schemas import GROUP_EVENTS, GROUP_OFFSETS, PARTITION_OFFSETS

# What an offset stream carries: commits alone, commits with read marks, or partition offsets.
KINDS = {"group": GROUP_OFFSETS, "group_events": GROUP_EVENTS, "partition": PARTITION_OFFSETS}


def _trigger(writer, trigger: str | None, available_now: bool):
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=trigger) if trigger else writer


def metadata_batch(store_root: str, name: str = "metadata", hold_back: float = HOLD_BACK):
    """The micro-batch body of the metadata stream: one refresh per epoch,
    skipped when the epoch is already committed (a retried batch)."""
    def batch(df: DataFrame, epoch: int) -> None:
        store = StateStore(df.sparkSession, store_root)
        if not store.committed_epoch(epoch, name):
            refresh_metadata(store, df, epoch=epoch, stream=name, hold_back=hold_back)
    return batch


def offset_batch(store_root: str, *, kind: str = "group", metadata_root: str | None = None,
                 record_log: str | None = None, name: str | None = None):
    """The micro-batch body of an offset stream (see ``start_offset_refresh``)."""
    name = name or f"{kind}_offsets"

    def batch(df: DataFrame, epoch: int) -> None:
        s = df.sparkSession
        store = StateStore(s, store_root)
        if store.committed_epoch(epoch, name):
            return
        meta = StateStore(s, metadata_root) if metadata_root else None
        log = read_record_log(s, record_log) if record_log else None
        if kind == "group":
            refresh_offsets(store, df, None, log, epoch=epoch, metadata=meta, stream=name)
        elif kind == "group_events":
            commits, reads = split_group_events(df)
            refresh_offsets(store, commits, None, log, group_reads=reads, epoch=epoch, metadata=meta, stream=name)
        else:
            refresh_offsets(store, None, df, None, epoch=epoch, metadata=meta, stream=name)
    return batch


def start_metadata_refresh(spark: SparkSession, source: str, store_root: str, checkpoint: str, *,
                           fmt: str = "json", trigger: str = "30 seconds", available_now: bool = False,
                           max_files: int | None = None, name: str = "metadata") -> StreamingQuery:
    stream = stream_snapshots(spark, source, fmt, max_files)
    writer = (stream.writeStream.foreachBatch(metadata_batch(store_root, name))
              .option("checkpointLocation", checkpoint))
    return _trigger(writer, trigger, available_now).start()


def start_offset_refresh(spark: SparkSession, source: str, store_root: str, checkpoint: str, *,
                         kind: str = "group", metadata_root: str | None = None, record_log: str | None = None,
                         fmt: str = "parquet", trigger: str = "2 seconds", available_now: bool = False,
                         name: str | None = None) -> StreamingQuery:
    """``kind``: "group_events" (GROUP_EVENTS: commits and read marks in one
    input; a capture's rows are to arrive in one file, which a file stream
    never splits over micro-batches, so an emptied group loses its offsets),
    "group" (GROUP_OFFSETS: a capture has read the groups it has rows of), both
    with offset timestamps from ``record_log``, or "partition"
    (PARTITION_OFFSETS captures). Each
    offset stream should write its own store; ``metadata_root`` names the
    store the metadata stream writes (the stream-static lookup, Y4)."""
    schema = KINDS[kind]
    body = offset_batch(store_root, kind=kind, metadata_root=metadata_root, record_log=record_log, name=name)
    writer = (spark.readStream.schema(schema).format(fmt).load(source).writeStream.foreachBatch(body)
              .option("checkpointLocation", checkpoint))
    return _trigger(writer, trigger, available_now).start()


def start_capture_history(spark: SparkSession, source: str, history: str, checkpoint: str, *,
                          schema=PARTITION_OFFSETS, fmt: str = "parquet", trigger: str | None = None,
                          available_now: bool = False) -> StreamingQuery:
    """Append arriving captures to a Parquet history (exactly once through the
    file sink's log), partitioned by cluster."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    writer = (stream.writeStream.format("parquet").option("path", history)
              .option("checkpointLocation", checkpoint).partitionBy("k_cluster_id"))
    return _trigger(writer, trigger, available_now).start()


def resolved_offsets(captures: DataFrame, metadata: StateStore) -> DataFrame:
    """Partition-offset captures (batch or stream) whose partition the metadata knows, offsets and times cleaned.
    The state is the static side: a semi join on the whole key without state of its own."""
    return resolve_partition_offsets(clean_partition_offsets(captures), metadata.read("topic_partitions"))


def start_resolved_offsets(spark: SparkSession, source: str, metadata_root: str, output: str, checkpoint: str, *,
                           fmt: str = "parquet", trigger: str | None = None, available_now: bool = False) -> StreamingQuery:
    """Resolve arriving captures in the streaming plan and append them to Parquet by cluster; no Python callback.
    The metadata version is the newest at the start: a run per trigger (``available_now``) follows new versions."""
    stream = spark.readStream.schema(PARTITION_OFFSETS).format(fmt).load(source)
    rows = resolved_offsets(stream, StateStore(spark, metadata_root))
    writer = (rows.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
              .partitionBy("k_cluster_id"))
    return _trigger(writer, trigger, available_now).start()

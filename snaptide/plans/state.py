"""Versioned current state on plain files, published atomically, written by cluster.

Layout under ``root`` (a shared folder every executor can reach):

    root/<table>/v=<n>/k_cluster_id=<c>/   rows of the clusters that version n rewrote
    root/_owners/v=<n>/                    (table_name, k_cluster_id, v): which version holds a cluster's rows
    root/_side/v=<n>/<name>/               work tables of version n (resolved captures, removed rows)
    root/_commits/v=<n>/                   one-row JSON commit record, written last

A version holds only the clusters its refresh touched; all others are carried
by reference through the owner rows. A version is visible only once its commit
record is complete, so a refresh that fails half-way (or an executor lost
mid-write, retried by Spark) never exposes a partial state. A version is never
overwritten once committed, which also makes each publish a lineage cut: the
next refresh reads the written files, not the plan that produced them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snaptide.operators.merge import empty_state, no_rows
from snaptide.schemas import FAILED, SEEN, SNAPSHOT, TABLES, relaxed

CK = "k_cluster_id"
COMMIT = T.StructType([
    T.StructField("version", T.LongType(), False),
    T.StructField("epochs", T.MapType(T.StringType(), T.LongType()), True),
    T.StructField("tables", T.MapType(T.StringType(), T.ArrayType(T.LongType())), False),
    T.StructField("committed_at", T.TimestampType(), False),
])
# Captured rows are read whole and soon deleted: their files have no statistics.
CAPTURED = {"parquet.column.statistics.enabled": "false"}
OWNERS = "table_name string, k_cluster_id string, v long"
# Rows of a written file. State rows take a few bytes each, so a task bounded by bytes alone would read tens of
# millions; every file counts for at least ``spark.sql.files.openCostInBytes``, which bounds a task's rows too.
FILE_ROWS = 250_000
SCHEMAS: dict[str, T.StructType] = ({name: relaxed(spec.schema) for name, spec in TABLES.items()}
                                    | {"_seen": relaxed(SEEN), "_pending": relaxed(SNAPSHOT), "_failed": relaxed(FAILED)})


class StateStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # ------------------------------------------------------------ reading --
    def _folder(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return hadoop.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), hadoop

    def versions(self) -> list[int]:
        """Committed versions, newest first: complete folders of the commit log (names only, nothing is read)."""
        fs, path = self._folder("_commits")
        if not fs.exists(path):
            return []
        names = sorted((int(s.getPath().getName()[2:]) for s in fs.listStatus(path)), reverse=True)
        return [v for v in names if fs.exists(self._folder(f"_commits/v={v}/_SUCCESS")[1])]

    def latest(self) -> dict | None:
        """The newest commit record (one row)."""
        found = self.versions()
        return self._head(found[0]) if found else None

    def _head(self, version: int) -> dict:
        path = f"{self.root}/_commits/v={version}"
        return self.spark.read.schema(COMMIT).json(path).first().asDict()

    def owners(self, head: dict) -> DataFrame:
        return self.spark.read.schema(OWNERS).parquet(f"{self.root}/_owners/v={head['version']}")

    def read(self, table: str, version: int | None = None, head: dict | None = None) -> DataFrame:
        """A table as of a committed version (newest by default). Filters
        on the result reach the Parquet scan, those on the cluster its folders."""
        if head is None:
            head = self.latest() if version is None else self._head(version)
        held = (head["tables"] or {}).get(table) if head else None
        schema = SCHEMAS[table]
        if not held:
            return empty_state(self.spark, TABLES[table]) if table in TABLES else no_rows(self.spark, schema)
        df = self._files(table, held, schema)
        if len(held) > 1:
            own = self.owners(head).filter(F.col("table_name") == table).select(CK, "v")
            df = df.join(own, [CK, "v"], "left_semi")
        return df.select(*schema.fieldNames())

    def _files(self, table: str, versions, schema: T.StructType) -> DataFrame:
        # cluster and version come from the folder names
        folders = T.StructType([*[f for f in schema.fields if f.name != CK], T.StructField("v", T.LongType()),
                                T.StructField(CK, T.StringType())])
        paths = [f"{self.root}/{table}/v={v}" for v in versions]
        return self.spark.read.schema(folders).option("basePath", f"{self.root}/{table}").parquet(*paths)

    def read_all(self, version: int | None = None, head: dict | None = None) -> dict[str, DataFrame]:
        if head is None:
            head = self.latest() if version is None else self._head(version)
        return {name: self.read(name, head=head or {"tables": {}}) for name in TABLES}

    def committed_epoch(self, epoch: int, stream: str | None = None, head: dict | None = None) -> bool:
        """True when a micro-batch epoch of ``stream`` was already published
        (retry guard; epochs of a stream only grow)."""
        head = head or self.latest()
        last = ((head or {}).get("epochs") or {}).get(stream or "")
        return last is not None and epoch <= last

    # ------------------------------------------------------------ writing --
    def begin(self, head: dict | None = None) -> int:
        """Start a version: its number."""
        head = head or self.latest()
        return 0 if head is None else head["version"] + 1

    def stage(self, version: int, name: str, df: DataFrame, mode: str = "overwrite") -> DataFrame:
        """Write one table's rows of the touched clusters in an uncommitted
        version (``mode`` "append": some more of them) and return them read back.
        Rows are dealt out by cluster, large clusters over several files."""
        schema = SCHEMAS[name]
        out = df.select(*schema.fieldNames()).hint("rebalance", CK)
        # an uncommitted version is invisible to readers, so a retried refresh
        # (same version number, leftovers of the failed attempt) overwrites it
        (out.write.mode(mode).option("maxRecordsPerFile", FILE_ROWS).partitionBy(CK)
         .parquet(f"{self.root}/{name}/v={version}"))
        return self.staged(version, name)

    def stage_side(self, version: int, name: str, df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
        """Write a side output of a version (captured rows, small key tables, removed rows) and return it read back."""
        path = f"{self.root}/_side/v={version}/{name}"
        df.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).options(**(options or {})).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def stage_parts(self, version: int, name: str, df: DataFrame, part: Column) -> DataFrame:
        """Write rows of a table in an uncommitted version, apart by ``part``, each once; rows of the part "kept" become
        the table's with ``take_kept``. Columns beyond the table's stay in its files, where no reader asks for them."""
        path = f"{self.root}/_side/v={version}/parts-{name}"
        out = df.withColumn("_part", part).hint("rebalance", "_part", CK)
        out.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).partitionBy("_part", CK).parquet(path)
        fields = [f for f in out.schema.fields if f.name not in ("_part", CK)]
        folders = T.StructType([*fields, T.StructField("_part", T.StringType()), T.StructField(CK, T.StringType())])
        return self.spark.read.schema(folders).parquet(path)

    def take_kept(self, version: int, name: str) -> DataFrame:
        """Make the part "kept" of ``stage_parts`` the table's rows of the version, and return them read back."""
        fs, kept = self._folder(f"_side/v={version}/parts-{name}/_part=kept")
        _, table = self._folder(f"{name}/v={version}")
        fs.delete(table, True)      # leftovers of a failed attempt
        fs.mkdirs(table.getParent() if fs.exists(kept) else table)
        if fs.exists(kept) and not fs.rename(kept, table):
            raise OSError(f"{kept} could not be moved to {table}")
        return self.staged(version, name)

    def staged(self, version: int, name: str) -> DataFrame:
        """A table's rows of a version, committed or not."""
        schema = SCHEMAS[name]
        return self._files(name, [version], schema).select(*schema.fieldNames())

    def drop_side(self, version: int, name: str) -> None:
        """Delete a side output that nothing refers to any more."""
        fs, path = self._folder(f"_side/v={version}/{name}")
        fs.delete(path, True)

    def commit(self, version: int, staged: dict[str, DataFrame], epoch: int | None = None,
               stream: str | None = None, head: dict | None = None) -> int:
        """Write the owner rows and then the commit record; from now on the
        version is the newest. ``staged``: each staged table with the clusters
        (k_cluster_id) it was rewritten for. One writer per store."""
        head = head or self.latest()
        spark = self.spark
        before = self.owners(head) if head else no_rows(spark, OWNERS)
        mine = [touched.select(F.lit(name).alias("table_name"), CK).distinct() for name, touched in sorted(staged.items())]
        if mine:
            now = reduce(DataFrame.unionByName, mine).withColumn("v", F.lit(version).cast("long"))
            before = before.join(now, ["table_name", CK], "left_anti").unionByName(now)
        path = f"{self.root}/_owners/v={version}"
        before.write.mode("overwrite").parquet(path)
        held = spark.read.schema(OWNERS).parquet(path)
        tables = {r.table_name: sorted(r.vs) for r in
                  held.groupBy("table_name").agg(F.collect_set("v").alias("vs")).collect()}
        epochs = dict((head or {}).get("epochs") or {})
        if epoch is not None:
            epochs[stream or ""] = epoch
        record = spark.createDataFrame(
            [(version, epochs, tables)], "version long, epochs map<string,long>, tables map<string,array<long>>"
        ).withColumn("committed_at", F.current_timestamp())
        record.coalesce(1).write.mode("overwrite").json(f"{self.root}/_commits/v={version}")
        return version

    def publish(self, tables: dict[str, DataFrame], epoch: int | None = None, stream: str | None = None) -> int:
        """K4: replace whole tables by new contents; tables not given keep their place."""
        head = self.latest()
        version = self.begin(head)
        staged = {}
        for name, df in tables.items():
            staged[name] = (self.stage(version, name, df).select(CK)
                            .unionByName(self.read(name, head=head or {"tables": {}}).select(CK)))
        return self.commit(version, staged, epoch, stream, head)

    def remove_old(self, keep: int) -> list[int]:
        """Delete commit records beyond the newest ``keep`` and the files that none of those kept refers to.
        Only on request; returns the removed commits."""
        found = self.versions()
        kept, gone = found[:max(keep, 1)], found[max(keep, 1):]
        heads = [self._head(v) for v in kept]
        live = {name: {v for h in heads for v in (h["tables"] or {}).get(name, [])} for name in SCHEMAS}
        for v in gone:
            for part in ("_commits", "_owners"):
                fs, path = self._folder(f"{part}/v={v}")
                fs.delete(path, True)
        for name, used in [*live.items(), ("_side", set(kept))]:
            fs, path = self._folder(name)
            for status in fs.listStatus(path) if fs.exists(path) else []:
                v = int(status.getPath().getName()[2:])
                if v not in used and v <= found[0]:
                    fs.delete(status.getPath(), True)
        return gone

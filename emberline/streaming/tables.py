"""Tables that streaming jobs write so that a repeated batch, or a job begun anew over the same input, changes nothing.

Rows are dealt into buckets of their site and kept as one folder per version and bucket. A log entry per version tells which run and batch
wrote it and which folders hold since then. A batch writes its folders first and its entry last: without the entry nothing of it is
read, and the next attempt overwrites what was left. A batch that the log has is not applied again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from emberline.functions.timeline import instant
from emberline.operators.gauges import GAUGE

BUCKET = "bucket"
LOG = "run string, batch bigint, folders map<int,array<bigint>>"


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("site_id"), F.lit(buckets)).cast("int")


class BucketTable:
    """A table of ``buckets`` buckets below ``path``. ``merge(old, new)`` gives the rows of touched buckets from their rows before and new ones;
    with ``replace`` they take the place of the buckets' old rows, else they are added to them."""

    def __init__(self, path: str, shape: str, merge: Callable[[DataFrame, DataFrame], DataFrame], replace: bool, buckets: int = 64):
        self.path, self.shape, self.merge, self.replace, self.buckets = path.rstrip("/"), shape, merge, replace, buckets

    def log(self, spark: SparkSession) -> DataFrame | None:
        try:
            return spark.read.schema(f"{LOG}, version bigint").parquet(f"{self.path}/log")
        except AnalysisException as missing:  # no batch has been committed yet
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def last(self, spark: SparkSession) -> tuple[int, dict[int, list[int]]]:
        """The newest version, and the versions whose folders hold by bucket."""
        log = self.log(spark)
        row = None if log is None else log.orderBy(F.col("version").desc()).first()
        return (row["version"], dict(row["folders"])) if row else (-1, {})

    def rows(self, spark: SparkSession, folders: dict[int, list[int]], buckets: Sequence[int] | None = None) -> DataFrame:
        found = [f"{self.path}/data/version={v}/{BUCKET}={b}" for b, versions in sorted(folders.items()) for v in versions if buckets is None or b in buckets]
        return spark.read.schema(self.shape).parquet(*found) if found else spark.createDataFrame([], self.shape)

    def read(self, spark: SparkSession) -> DataFrame:
        return self.rows(spark, self.last(spark)[1])

    def apply(self, batch: DataFrame, batch_id: int, run: str) -> list[int]:
        """Merge a batch of a run and commit it, unless the log has it already; returns the buckets written."""
        spark = batch.sparkSession
        log = self.log(spark)
        if log is not None and not log.filter((F.col("run") == run) & (F.col("batch") == batch_id)).isEmpty():
            return []
        before, folders = self.last(spark)
        version = before + 1
        new = batch.select(*StructType.fromDDL(self.shape).names, bucket_of(self.buckets).alias(BUCKET)).persist()
        try:
            touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # at most the fixed number of buckets
            written = self._write(spark, new.drop(BUCKET), folders, touched, version) if touched else []
        finally:
            new.unpersist()
        for b in written:
            folders[b] = [version] if self.replace else [*folders.get(b, []), version]
        entry = spark.createDataFrame([(run, batch_id, folders)], LOG).coalesce(1)
        entry.write.mode("overwrite").parquet(f"{self.path}/log/version={version}")
        return written

    def _write(self, spark: SparkSession, new: DataFrame, folders: dict[int, list[int]], touched: list[int], version: int) -> list[int]:
        path = f"{self.path}/data/version={version}"
        merged = self.merge(self.rows(spark, folders, touched), new).withColumn(BUCKET, bucket_of(self.buckets))
        merged.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
        found = spark.read.schema(f"{self.shape}, {BUCKET} int").parquet(path)
        return sorted(r[0] for r in found.select(BUCKET).distinct().collect())


def event_table(path: str, shape: str, keys: Sequence[str] = ("site_id", "seq", "event_type"), buckets: int = 64) -> BucketTable:
    """Events, each once by its ``keys``: a batch adds only what its buckets do not hold yet."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        there = old.select(*[F.col(k).alias(f"_{k}") for k in keys])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        return new.dropDuplicates(list(keys)).join(there, same, "left_anti")

    return BucketTable(path, shape, merge, False, buckets)


def gauge_table(path: str, buckets: int = 64) -> BucketTable:
    """The latest value of every gauge; a batch rewrites only the buckets of its own sites."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.unionByName(new).withColumn("_at", instant())
        return both.groupBy(*GAUGE).agg(F.max_by("value", "_at").alias("value"), F.max_by("seq", "_at").alias("seq"), F.max("ts").alias("ts"))

    return BucketTable(path, "site_id bigint, metric string, floor string, value double, seq bigint, ts timestamp", merge, True, buckets)


def write_stream(rows: DataFrame, table: BucketTable, checkpoint: str) -> None:
    """Feed everything available into a table, batch by batch, and stop. A run is told by its checkpoint."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        table.apply(batch, batch_id, checkpoint)

    query = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

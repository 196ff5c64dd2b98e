"""Writers: the mixed derived log, the session export and the stored duration baseline."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def derived_union(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Typed event tables as one log, one row per event, absent fields null."""
    out = None
    for name, rows in tables.items():
        part = rows.select(F.lit(name).alias("event_type"), "*")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def write_derived(log: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Append to the derived log, partitioned so that readers prune by event type and day.

    Rows are dealt by event type and day; adaptive execution splits what is large and joins what is small, by measured size.
    """
    dated = log.withColumn("event_date", F.to_date("ts"))
    dated.hint("rebalance", "event_type", "event_date").write.mode(mode).partitionBy("event_type", "event_date").format(fmt).save(path)


def session_export(sessions: DataFrame) -> DataFrame:
    """Sessions in export layout; the start is derived from end and duration."""
    known = sessions.filter(F.col("duration_s").isNotNull())
    start = F.timestamp_micros(F.unix_micros("ended_at") - F.col("duration_s") * 1_000_000)
    return known.select("site_id", start.alias("started_at"), "ended_at", "duration_s", "outdoor_temp_f", "entity_id")


TIMESTAMP_TEXT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").options(header=True, timestampFormat=TIMESTAMP_TEXT).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.options(header=True, timestampFormat=TIMESTAMP_TEXT).schema(schema).csv(path)


def save_baseline(baseline: DataFrame, path: str) -> None:
    baseline.write.mode("overwrite").parquet(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

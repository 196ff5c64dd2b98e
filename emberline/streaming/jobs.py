"""Streaming jobs: ingest, calls, cycles, alarms, day figures and gauges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.scalars import numeric_state
from emberline.schema import CALL, CLIMATE, FLOORS, FURNACE, OUTDOOR
from emberline.sources import logs
from emberline.sources.event_table import EVENTS_SCHEMA, observations
from emberline.streaming.ordered import MINUTE_US, process
from emberline.streaming.processors import AlarmProcessor, CallProcessor, CycleProcessor, DayProcessor, GaugeProcessor, OrderProcessor
from emberline.streaming.tables import gauge_table, write_stream


def tail_log(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Observations appended to a JSON-lines log folder; rows of other producers are ignored."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return logs.parse_log(lines, logs.STATE_CHANGED, logs.STATE_CHANGE_DATA)


def tail_events(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The event table as a stream of files."""
    events = spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return events.withColumnRenamed("user_id", "site_id")


def live_observations(events: DataFrame, *kinds: str) -> DataFrame:
    """Observations of a stream; the previous state is left to the processors, which keep it."""
    return observations(events, *kinds, old_state=False)


def _site_rows(rows: DataFrame) -> DataFrame:
    """Observations with their attributes flat; an outdoor reading travels in the setpoint column."""
    a = F.col("attributes")
    value = F.when(F.col("kind") == OUTDOOR, numeric_state(F.col("new_state"))).otherwise(a["temperature"])
    return rows.select(
        "site_id", "ts", "seq", "kind", "floor", "old_state", "new_state", value.alias("setpoint"),
        a["current_temperature"].alias("current_temp"), a["hvac_action"].alias("hvac_action"),
    )


def stream_in_order(rows: DataFrame, delay: str = "1 hour", grace: str = "0 seconds", chunk_us: int = MINUTE_US) -> DataFrame:
    """Places of the rows of each entity in event order, and the rows that came too late for it."""
    return process(rows, ["site_id", "entity_id"], OrderProcessor(True, chunk_us), delay, grace)


def stream_calls(
    rows: DataFrame, delay: str = "1 hour", buffered: bool = False, initial: DataFrame | None = None, grace: str = "0 seconds", chunk_us: int = MINUTE_US
) -> DataFrame:
    """Ended sessions of call and furnace sensors; ``initial`` as ``replay.seed_calls`` gives it."""
    on_off = rows.filter(F.col("kind").isin(CALL, FURNACE))
    return process(on_off, ["site_id", "entity_id"], CallProcessor(buffered, chunk_us), delay, grace, initial=initial)


def stream_cycles(rows: DataFrame, delay: str = "1 hour", buffered: bool = False, initial: DataFrame | None = None, grace: str = "0 seconds", **thresholds) -> DataFrame:
    """Thermostat changes and heating-cycle outcomes; ``initial`` as ``replay.seed_cycles`` gives it."""
    wanted = rows.filter(F.col("kind").isin(CALL, CLIMATE, OUTDOOR))
    return process(_site_rows(wanted), ["site_id"], CycleProcessor(buffered=buffered, **thresholds), delay, grace, initial=initial)


def stream_alarms(
    rows: DataFrame, delay: str = "1 hour", buffered: bool = False, initial: DataFrame | None = None, live: bool = False, grace: str = "0 seconds", **thresholds
) -> DataFrame:
    """Alarms that fire on event time, also when nothing arrives; ``live`` on the clock, without a watermark."""
    return process(_site_rows(rows), ["site_id"], AlarmProcessor(buffered=buffered, **thresholds), delay, grace, live, initial)


def stream_days(rows: DataFrame, delay: str = "1 hour", grace: str = "0 seconds", chunk_us: int = MINUTE_US) -> DataFrame:
    """Figures of every closed day of a site; ``floor_days`` and ``furnace_days`` give them the layout of the batch summaries."""
    return process(_site_rows(rows), ["site_id"], DayProcessor(True, chunk_us), delay, grace)


def floor_days(days: DataFrame, floors: Sequence[str] = FLOORS) -> DataFrame:
    """Closed days as ``rollups.floor_daily_summary`` has them."""
    entry = lambda f: F.struct(
        F.lit(f).alias("floor"), F.col(f"calls_{f}").alias("total_calls"), F.col(f"runtime_{f}").alias("total_runtime_s"), F.col(f"longest_{f}").alias("max_duration_s")
    )
    rows = days.select("site_id", _date().alias("date"), _mean("outdoor").alias("outdoor_temp_avg_f"), F.inline(F.array(*[entry(f) for f in floors])))
    average = F.when(F.col("total_calls") > 0, F.round(F.col("total_runtime_s") / F.col("total_calls"), 1))
    return rows.select("site_id", "floor", "date", "total_calls", "total_runtime_s", average.alias("avg_duration_s"), "max_duration_s", "outdoor_temp_avg_f")


def furnace_days(days: DataFrame, floors: Sequence[str] = FLOORS) -> DataFrame:
    """Closed days as ``rollups.furnace_daily_summary`` has them."""
    figures = [F.col("furnace_s").alias("total_furnace_runtime_s"), F.col("furnace_n").alias("session_count")]
    figures += [F.round(f"outdoor_{m}", 6).alias(f"outdoor_temp_{m}_f") for m in ("min", "max")] + [_mean("outdoor").alias("outdoor_temp_avg_f")]
    for f in floors:
        figures += [F.col(f"runtime_{f}").alias(f"runtime_{f}_s"), F.col(f"calls_{f}").alias(f"sessions_{f}")]
    return days.select("site_id", _date().alias("date"), *figures, *[_mean("setpoint", f"_{f}").alias(f"setpoint_{f}_f") for f in floors])


def _date() -> Column:
    return F.to_date(F.timestamp_micros("us"))


def _mean(what: str, of: str = "") -> Column:
    total, n = F.col(f"{what}_sum{of}"), F.col(f"{what}_n{of}")
    return F.round(F.when(n > 0, total.cast("double") / n / 1_000_000), 1)


def stream_daily(calls: DataFrame, delay: str = "1 day") -> DataFrame:
    """Day totals per floor, emitted once the watermark has passed the day; repeated and late calls are dropped."""
    return (
        calls.withWatermark("ts", delay)
        .dropDuplicatesWithinWatermark(["site_id", "entity_id", "seq"])
        .groupBy("site_id", "floor", F.window("ts", "1 day").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("total_calls"),
            F.coalesce(F.sum("duration_s"), F.lit(0)).alias("total_runtime_s"),
            F.max("duration_s").alias("max_duration_s"),
        )
        .select("site_id", "floor", F.to_date("day.start").alias("date"), "total_calls", "total_runtime_s", "max_duration_s")
    )


def live_samples(rows: DataFrame) -> DataFrame:
    """Gauge samples of thermostat and outdoor observations."""
    a = F.col("attributes")
    reading = lambda m, v: F.struct(F.lit(m).alias("metric"), v.alias("value"))
    gauges = F.when(
        F.col("kind") == OUTDOOR, F.array(reading("outdoor_temperature_f", numeric_state(F.col("new_state"))))
    ).otherwise(
        F.array(reading("floor_temperature_f", a["current_temperature"]), reading("floor_setpoint_f", a["temperature"]))
    )
    return rows.select("site_id", "floor", "ts", "seq", F.inline(gauges)).filter(F.col("value").isNotNull())


def stream_gauges(rows: DataFrame, delay: str = "1 hour", grace: str = "0 seconds", chunk_us: int = MINUTE_US) -> DataFrame:
    """Changes of all gauges, as ``gauges.gauge_samples`` has them."""
    return process(_site_rows(rows), ["site_id"], GaugeProcessor(True, chunk_us), delay, grace)


def upsert_gauges(samples: DataFrame, table: str, checkpoint: str) -> None:
    """Keep the latest value per gauge; a batch rewrites the buckets of its own sites only."""
    write_stream(samples, gauge_table(table), checkpoint)


def read_gauges(spark: SparkSession, table: str) -> DataFrame:
    return gauge_table(table).read(spark)

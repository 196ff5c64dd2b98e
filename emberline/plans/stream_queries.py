"""Registry entries of the streaming jobs: each streams the event table to its end and reads the result back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import replay
from emberline.plans.fleet import present
from emberline.plans.queries import QUERIES, SCALE, at, log_lines
from emberline.schema import CALL, CLIMATE, OUTDOOR
from emberline.sources.event_table import EVENTS_SCHEMA, observations, read_events
from emberline.sources.scratch import scratch_path
from emberline.streaming import jobs, tables
from emberline.streaming.ordered import late_rows, micros, on_time, run_available, use_state_store

DELAY = "3 days"
HOUR_US = 3_600_000_000
CHUNK = 24 * HOUR_US  # the events of a site lie hours apart
PARTS, FILES = 2, 2  # arrivals of the test stream, and files of each


def stream_query(build):
    """Register a streaming job ``build(spark, events_path, work_dir)``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        use_state_store(spark)
        return present(build(spark, f"{sf_dir}/events.parquet", scratch_path(spark, build.__name__)))

    run.__name__, run.__doc__ = build.__name__, build.__doc__
    QUERIES[build.__name__] = run
    return build


def _arrivals(spark: SparkSession, path: str, work: str, since: str | None = None) -> str:
    """The events as files that arrive up to two days late and out of order, then one of another site long after, which moves the watermark past all."""
    events = spark.read.schema(EVENTS_SCHEMA).parquet(path)
    events = events if since is None else events.filter(F.col("ts") >= at(since))
    late = F.pmod(F.xxhash64("event_id"), F.lit(2 * 86_400_000_000))
    arrived = F.unix_micros("ts") + late
    first, last = events.agg(F.min(arrived), F.max(arrived)).first()
    part = F.floor((arrived - F.lit(first)) * PARTS / F.lit(last - first + 1))
    for n in range(PARTS):
        events.filter(part == n).repartition(FILES).write.mode("append").parquet(f"{work}/in")
    _last_of_all(events, last, work)
    return f"{work}/in"


def _last_of_all(events: DataFrame, last_us: int, work: str) -> None:
    """One event of another site, two months after all others."""
    spark = events.sparkSession
    far = F.timestamp_micros(F.lit(last_us + 60 * 86_400_000_000))
    values = [F.lit(-1).alias("event_id"), far.alias("ts"), F.lit(-1).alias("user_id"), F.lit("view").alias("event_type"), F.lit(0.0).alias("value"), F.lit('{"k": 0}').alias("props")]
    spark.range(1).select(*[v.cast(f.dataType).alias(f.name) for v, f in zip(values, events.schema)]).coalesce(1).write.mode("append").parquet(f"{work}/in")


def _observed(spark: SparkSession, path: str, *kinds: str) -> DataFrame:
    # a pattern, since a file stream accepts a folder or a pattern but not the name of a single file
    return jobs.live_observations(jobs.tail_events(spark, f"{path}*", FILES), *kinds)


def _collect(spark: SparkSession, rows: DataFrame, work: str, *times: str) -> DataFrame:
    run_available(rows, f"{work}/out", f"{work}/checkpoint")
    out = micros(on_time(spark.read.parquet(f"{work}/out")), *times)
    return out.filter(F.col("site_id") >= 0)


@stream_query
def st_ingest(spark: SparkSession, path: str, work: str) -> DataFrame:
    """ST1"""
    log_lines(observations(read_events(spark, path), CLIMATE)).write.text(f"{work}/log")
    run_available(jobs.tail_log(spark, f"{work}/log"), f"{work}/out", f"{work}/checkpoint")
    rows = spark.read.parquet(f"{work}/out")
    return rows.select("site_id", "seq", "ts", "entity_id", "new_state", F.col("attributes.temperature").alias("setpoint"))


@stream_query
def st_calls(spark: SparkSession, path: str, work: str) -> DataFrame:
    """ST2, ST6: files out of order."""
    rows = _collect(spark, jobs.stream_calls(_observed(spark, _arrivals(spark, path, work)), DELAY, buffered=True, chunk_us=CHUNK), work, "us", "started_at")
    return rows.select("site_id", "entity_id", "floor", F.col("ts").alias("ended_at"), "seq", "started_at", "duration_s")


CYCLE_COLUMNS = ("event_type", "site_id", "floor", "ts", "seq", "duration_s", "peak_temp", "likely_cause", "outdoor_temp_f", "other_zones")
ALARM_SCALE = {k: SCALE[k] for k in ("long_call_s", "silence_s", "no_response_s", "no_response_default_s")}


@stream_query
def st_cycles(spark: SparkSession, path: str, work: str) -> DataFrame:
    """ST3, ST6: files out of order."""
    observed = _observed(spark, _arrivals(spark, path, work), CALL, CLIMATE, OUTDOOR)
    rows = jobs.stream_cycles(observed, DELAY, buffered=True, chunk_us=CHUNK, slow_s=SCALE["slow_to_heat_s"])
    return _collect(spark, rows, work, "us").select(*CYCLE_COLUMNS)


@stream_query
def st_alarms(spark: SparkSession, path: str, work: str) -> DataFrame:
    """ST4, ST6: every alarm there is, those without a later row included, from files out of order."""
    observed = _observed(spark, _arrivals(spark, path, work), CALL, CLIMATE)
    rows = jobs.stream_alarms(observed, DELAY, buffered=True, chunk_us=CHUNK, floors=SCALE["floors"], **ALARM_SCALE)
    return _collect(spark, rows, work, "us", "since")


@stream_query
def st_daily(spark: SparkSession, path: str, work: str) -> DataFrame:
    """ST5: day figures of furnace, floors, outdoor readings and setpoints, idle floors included, for every day that is over."""
    rows = _collect(spark, jobs.stream_days(_observed(spark, _arrivals(spark, path, work)), DELAY, chunk_us=CHUNK), work)
    return jobs.furnace_days(rows)


@stream_query
def st_floor_days(spark: SparkSession, path: str, work: str) -> DataFrame:
    """ST5: the day summaries of floors from the same stream."""
    rows = _collect(spark, jobs.stream_days(_observed(spark, _arrivals(spark, path, work), CALL, CLIMATE, OUTDOOR), DELAY, chunk_us=CHUNK), work)
    return jobs.floor_days(rows)


@stream_query
def st_resume(spark: SparkSession, path: str, work: str) -> DataFrame:
    """ST7: the first half of the month is streamed, the job stops, the rest arrives, the job resumes; then all is streamed anew into the same table.

    The job stops with rows in its state that still wait for the watermark.
    """
    events = spark.read.schema(EVENTS_SCHEMA).parquet(path)
    middle = at("2024-01-16 00:00:00")
    shape = "site_id bigint, entity_id string, floor string, us bigint, seq bigint, started_at bigint, duration_s bigint"
    table = tables.event_table(f"{work}/table", shape, ["site_id", "seq"])
    stream = lambda: on_time(jobs.stream_calls(_observed(spark, f"{work}/in", CALL), DELAY, buffered=True, chunk_us=CHUNK))
    events.filter(F.col("ts") < middle).repartition(FILES).write.mode("append").parquet(f"{work}/in")
    tables.write_stream(stream(), table, f"{work}/checkpoint")
    events.filter(F.col("ts") >= middle).repartition(FILES).write.mode("append").parquet(f"{work}/in")
    _last_of_all(events, events.agg(F.max(F.unix_micros("ts"))).first()[0], work)
    tables.write_stream(stream(), table, f"{work}/checkpoint")
    tables.write_stream(stream(), table, f"{work}/anew")
    out = micros(table.read(spark), "us", "started_at").filter(F.col("site_id") >= 0)
    return out.select("site_id", "entity_id", "floor", F.col("ts").alias("ended_at"), "seq", "started_at", "duration_s")


@stream_query
def st_late(spark: SparkSession, path: str, work: str) -> DataFrame:
    """ST6: rows waited for half a day only; what comes later is set aside, and with what was put in order it is every row, once."""
    observed = _observed(spark, _arrivals(spark, path, work), CALL)
    rows = jobs.stream_in_order(observed, "12 hours", grace="60 days", chunk_us=HOUR_US)
    run_available(rows, f"{work}/out", f"{work}/checkpoint")
    out = spark.read.parquet(f"{work}/out").filter("site_id >= 0")
    late = late_rows(out, ["site_id", "entity_id"])
    both = on_time(out).select("site_id", "seq").unionByName(late.select("site_id", "seq")).groupBy("site_id", "seq").agg(F.count(F.lit(1)).alias("n"))
    return both.groupBy("site_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n") > 1).alias("twice"))


@stream_query
def st_backfill(spark: SparkSession, path: str, work: str) -> DataFrame:
    """ST8: cycle events and alarms from a time on, streamed from the state that batch operators give for that time."""
    start = "2024-01-16 00:00:00"
    given = observations(read_events(spark, path))
    observed = _observed(spark, _arrivals(spark, path, work, start), CALL, CLIMATE, OUTDOOR)
    cycles = jobs.stream_cycles(
        observed, DELAY, buffered=True, chunk_us=CHUNK, slow_s=SCALE["slow_to_heat_s"], initial=replay.seed_cycles(given, at(start), SCALE["slow_to_heat_s"])
    )
    seed = replay.seed_alarms(given.filter(F.col("kind").isin(CALL, CLIMATE)), at(start), **ALARM_SCALE)
    alarms = jobs.stream_alarms(observed.filter(F.col("kind") != OUTDOOR), DELAY, buffered=True, chunk_us=CHUNK, floors=SCALE["floors"], initial=seed, **ALARM_SCALE)
    first = _collect(spark, cycles, f"{work}/cycles", "us").select(*CYCLE_COLUMNS)
    second = _collect(spark, alarms, f"{work}/alarms", "us").select(F.col("kind").alias("event_type"), "site_id", "floor", "ts")
    return first.unionByName(second, allowMissingColumns=True)


@stream_query
def st_gauges(spark: SparkSession, path: str, work: str) -> DataFrame:
    """ST10: all six gauges."""
    observed = _observed(spark, _arrivals(spark, path, work))
    samples = on_time(jobs.stream_gauges(observed, DELAY, chunk_us=CHUNK)).withColumn("ts", F.timestamp_micros("us"))
    jobs.upsert_gauges(samples, f"{work}/gauges", f"{work}/checkpoint")
    return jobs.read_gauges(spark, f"{work}/gauges").filter(F.col("site_id") >= 0).drop("seq")

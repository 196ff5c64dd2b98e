"""The query registry over the given event table.

The events of a site lie hours apart, so the queries pass scaled thresholds (``SCALE``); operator defaults stay as they
are. Every query reads its whole table. ``as_of`` is always explicit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.scalars import confidence, severity
from emberline.functions.skew import keyed_join
from emberline.functions.timeline import scan
from emberline.operators import alarms, asof, comparisons, edges, gauges, rollups, rules, thermostat
from emberline.plans import context, derived
from emberline.plans.fleet import Fleet, present
from emberline.schema import (
    CALL,
    CLIMATE,
    ENTITIES,
    FURNACE,
    OUTDOOR,
    OVERSHOOT,
    SETPOINT_MISS,
    TIME_TO_TEMP,
    WARNING_KINDS,
    WARNING_LABELS,
)
from emberline.sources import logs, sinks
from emberline.sources.event_table import read_events
from emberline.sources.scratch import scratch_path

HOUR, DAY = 3600, 86400
SCALE = {
    "long_call_s": DAY,
    "floors": None,
    "silence_s": DAY,
    "short_call_s": 3 * HOUR,
    "no_response_s": {},
    "no_response_default_s": 12 * HOUR,
    "slow_to_heat_s": {"floor_1": 6 * HOUR, "floor_2": 6 * HOUR, "floor_3": 6 * HOUR},
    "snapshot_s": 6 * HOUR,
}
AS_OF = "2024-01-31 00:00:00"
LIVE_AT = "2024-01-20 12:00:00"
STORED_THROUGH = "2024-01-15"
GRID_S = 6 * HOUR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def at(text: str):
    return F.lit(text).cast("timestamp")


def day(text: str):
    return F.lit(text).cast("date")


def query(until: str | None = None):
    """Register a query over the fleet tables of a data directory."""

    def register(build: Callable[[Fleet], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            events = read_events(spark, f"{sf_dir}/events.parquet")
            return present(build(Fleet(events, None if until is None else at(until))))

        run.__name__ = build.__name__
        run.__doc__ = build.__doc__
        QUERIES[build.__name__] = run
        return build

    return register


def cohorts(df: DataFrame) -> DataFrame:
    """Group sites into ten cohorts, so that rules needing several sessions a week have them."""
    return df.withColumn("cohort", F.col("site_id") % 10)


# --- sources and quality ----------------------------------------------------------------------------------------------


def log_lines(rows: DataFrame) -> DataFrame:
    """Observations as log lines."""
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    data = F.struct("entity_id", "old_state", "new_state", "attributes")
    return rows.select(
        F.to_json(
            F.struct(
                "site_id", "seq", F.lit("observer.state_changed.v1").alias("schema"), F.lit(logs.SOURCE).alias("source"),
                ts.alias("ts"), data.alias("data"),
            )
        ).alias("value")
    )


@query()
def read_log(f: Fleet) -> DataFrame:
    """Written as a JSON-lines log, read back with an explicit schema."""
    spark = f.events.sparkSession
    path = scratch_path(spark, "log")
    log_lines(f.observations(CLIMATE, OUTDOOR)).write.text(path)
    rows = edges.entity_lookup(logs.read_log(spark, path))
    return rows.select(
        "site_id", "seq", "ts", "entity_id", "kind", "floor", "new_state", F.col("attributes.temperature").alias("setpoint"),
        F.col("attributes.current_temperature").alias("current_temp"), F.col("attributes.hvac_action").alias("hvac_action"),
    )


@query()
def flatten_state_changes(f: Fleet) -> DataFrame:
    """Raw change messages flattened; messages of other types and without entity are dropped."""
    state = lambda s, a: F.struct(F.col(s).alias("state"), a.alias("attributes"))
    none = F.lit(None).cast("struct<temperature:double,current_temperature:double,hvac_action:string>")
    kind = F.when((F.col("kind") == CLIMATE) & (F.col("new_state") == "off"), "result").otherwise("event")
    entity = F.when(~((F.col("kind") == CALL) & F.col("old_state").isNull()), F.col("entity_id"))
    data = F.struct(
        entity.alias("entity_id"), state("old_state", none).alias("old_state"), state("new_state", F.col("attributes")).alias("new_state")
    )
    lines = f.observations(CALL, CLIMATE).select(
        "site_id", "seq", "ts", F.to_json(F.struct(kind.alias("type"), F.struct(data.alias("data")).alias("event"))).alias("value")
    )
    rows = logs.flatten_state_changes(lines)
    return rows.select("*", F.col("attributes.temperature").alias("setpoint")).drop("attributes")


def _lines_with_defects(f: Fleet) -> DataFrame:
    """Log lines of the thermostat observations as they are; all but four of sixteen get a defect, together every violation there is."""
    rows = f.observations(CLIMATE).withColumn("d", F.floor(F.col("seq") / 4) % 16)
    given = {"entity_id": F.col("entity_id"), "old_state": F.col("old_state"), "new_state": F.col("new_state"), "attributes": F.col("attributes")}
    own = lambda **changed: F.to_json(F.struct(*[c.alias(k) for k, c in {**given, **changed}.items()]), {"ignoreNullFields": "false"})
    other = '{"entity_id":"%s","old_state":"off","new_state":"%s"}'
    bodies = {3: own(new_state=F.lit("")), 5: own(new_state=F.lit("dry")), 7: own(attributes=F.lit(None).cast("string")), 9: own(entity_id=F.lit("climate.attic"))}
    data = {
        10: '"x"',
        11: '{"entity_id":"binary_sensor.furnace_heating","new_state":"on"}',
        12: other % ("binary_sensor.furnace_heating", "open"),
        13: other % ("sensor.outdoor_temperature", "5d"),
        15: other % ("sensor.outdoor_temperature", "unavailable"),
    }
    body = own()
    for d, replaced in {**bodies, **{d: F.lit(text) for d, text in data.items()}}.items():
        body = F.when(F.col("d") == d, replaced).otherwise(body)
    schema = F.when(F.col("d") == 6, "observer.other.v1").otherwise("observer.state_changed.v1")
    source = F.when(F.col("d") == 14, "").otherwise(F.concat(F.lit('"source":"'), F.when(F.col("d") == 1, "other").otherwise(logs.SOURCE), F.lit('",')))
    ts = F.when(F.col("d") == 8, "").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))
    line = F.format_string('{"site_id":%d,"seq":%d,"schema":"%s",%s"ts"%s"%s","data":%s}', "site_id", "seq", schema, source, F.when(F.col("d") == 2, "").otherwise(":"), ts, body)
    return rows.select("site_id", "seq", F.when(F.col("d") == 4, "[1, 2]").otherwise(line).alias("value"))


@query()
def validate_observations(f: Fleet) -> DataFrame:
    """Violations per log line."""
    return logs.validate_observations(_lines_with_defects(f)).drop("value")


@query()
def validation_summary(f: Fleet) -> DataFrame:
    """I4: totals, and lines per violation."""
    return logs.validation_summary(logs.validate_observations(_lines_with_defects(f)))


@query(until=AS_OF)
def derived_union(f: Fleet) -> DataFrame:
    """Every derived event as one log, written and read back."""
    spark = f.events.sparkSession
    path = scratch_path(spark, "derived")
    sinks.write_derived(f.derived_log(at(AS_OF), SCALE), path)
    log = spark.read.parquet(path)
    return log.select("event_type", "site_id", "floor", "ts", "seq", "duration_s", "temperature_f", "current_temp", "setpoint", "outdoor_temp_f")


@query()
def session_export(f: Fleet) -> DataFrame:
    """The CSV export, written and read back."""
    spark = f.events.sparkSession
    path = scratch_path(spark, "sessions")
    sinks.write_csv(sinks.session_export(f.furnace_with_outdoor), path)
    return sinks.read_csv(
        spark, path, "site_id bigint, started_at timestamp, ended_at timestamp, duration_s bigint, outdoor_temp_f double, entity_id string"
    )


# --- projection and predicates ----------------------------------------------------------------------------------------


@query()
def entity_lookup(f: Fleet) -> DataFrame:
    """Kind and floor by entity, from the naming scheme and from a dimension table; unknown entities are dropped."""
    rows = f.observations(CALL, CLIMATE, FURNACE, OUTDOOR)
    attic = (F.col("kind") == CLIMATE) & (F.col("site_id") % 7 == 0)
    rows = rows.withColumn("entity_id", F.when(attic, "climate.attic").otherwise(F.col("entity_id"))).drop("kind", "floor")
    dimension = f.events.sparkSession.createDataFrame([(e, k, floor) for e, (k, floor) in ENTITIES.items()], "entity_id string, kind string, floor string")
    both = edges.entity_lookup(rows).withColumn("source", F.lit("scheme")).unionByName(edges.entity_lookup(rows, dimension).withColumn("source", F.lit("table")), allowMissingColumns=True)
    return both.groupBy("source", "entity_id", "kind", "floor").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("site_id").alias("sites"))


@query()
def outdoor_readings(f: Fleet) -> DataFrame:
    """P2"""
    return f.outdoor


@query()
def anomaly_confidence(f: Fleet) -> DataFrame:
    """Confidence and severity of each event value against its site's mean."""
    stats = f.events.groupBy("site_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    z = F.try_divide(F.abs(F.col("value") - F.col("m")), F.nullif("s", F.lit(0.0)))
    scored = keyed_join(f.events, stats, ["site_id"]).withColumn("z", F.round(z, 6))
    scored = scored.withColumn("confidence", F.round(confidence(F.col("z")), 6))
    return scored.select("site_id", "event_id", "z", "confidence", severity(F.col("confidence")).alias("severity"))


@query(until=AS_OF)
def context_events(f: Fleet) -> DataFrame:
    """The lookback window plus the day summaries before it."""
    rows = derived.row_events(f.lean_timeline, at(AS_OF), SCALE, {}, context.CONTEXT_EVENTS)
    log = rows.unionByName(derived.day_events(derived.furnace_days(f.lean_timeline)))
    rows = context.context_events(log, at(LIVE_AT), hours=72)
    return rows.select("event_type", "site_id", "floor", "ts", "duration_s")


# --- change detection and sessions ------------------------------------------------------------------------------------


@query()
def call_edges(f: Fleet) -> DataFrame:
    """C1"""
    return f.call_edges


@query()
def floor_calls(f: Fleet) -> DataFrame:
    """C2"""
    return f.calls.drop("ts")


@query()
def furnace_sessions(f: Fleet) -> DataFrame:
    """With the last outdoor reading of the day."""
    return f.furnace_with_outdoor.drop("ts", "floor")


def _change(f: Fleet, flag: str) -> DataFrame:
    return thermostat.changes(f.climate).filter(flag).select(
        "site_id", "floor", "ts", "seq", "setpoint", "current_temp", "hvac_mode", "hvac_action"
    )


@query()
def setpoint_changes(f: Fleet) -> DataFrame:
    """C4"""
    return _change(f, "setpoint_changed")


@query()
def temp_updates(f: Fleet) -> DataFrame:
    """C5"""
    return _change(f, "temp_changed")


@query()
def mode_changes(f: Fleet) -> DataFrame:
    """C6"""
    return _change(f, "mode_changed")


@query()
def setpoint_reached(f: Fleet) -> DataFrame:
    """C7"""
    return _change(f, "reached")


@query()
def heating_cycles(f: Fleet) -> DataFrame:
    """C8"""
    return thermostat.heating_cycles(f.climate).select(
        "site_id", "floor", "cycle_ts", "cycle_seq", "start_temp", "readings", "closed", "ended_at", "end_temp", "reached_at",
        "adjusted",
    )


@query(until=LIVE_AT)
def open_sessions(f: Fleet) -> DataFrame:
    """C9"""
    calls = edges.open_sessions(f.observations(CALL), CALL)
    return calls.unionByName(edges.open_sessions(f.observations(FURNACE), FURNACE))


# --- cycle outcomes ---------------------------------------------------------------------------------------------------


@query()
def zone_time_to_temp(f: Fleet) -> DataFrame:
    """H1"""
    return thermostat.time_to_temp(f.climate_in_context)


@query()
def zone_overshoot(f: Fleet) -> DataFrame:
    """H2"""
    return thermostat.overshoot(thermostat.heating_cycles(f.climate_in_context))


@query()
def zone_setpoint_miss(f: Fleet) -> DataFrame:
    """H3, H4"""
    return thermostat.setpoint_miss(thermostat.heating_cycles(f.climate_in_context))


@query()
def zone_slow_to_heat(f: Fleet) -> DataFrame:
    """H5"""
    return thermostat.slow_to_heat(f.climate_in_context, SCALE["slow_to_heat_s"]).drop("threshold_s")


# --- as-of joins ------------------------------------------------------------------------------------------------------


@query()
def asof_outdoor(f: Fleet) -> DataFrame:
    """J1 without a day bound."""
    rows = asof.with_outdoor(f.furnace, f.outdoor, scope="unbounded")
    return rows.select("site_id", "ended_at", "seq", "duration_s", "outdoor_temp_f")


@query()
def asof_outdoor_stale(f: Fleet) -> DataFrame:
    """J2"""
    rows = asof.with_outdoor(f.furnace, f.outdoor, scope="unbounded", max_age_s=DAY)
    return rows.select("site_id", "ended_at", "seq", "duration_s", "outdoor_temp_f")


@query()
def other_zones_calling(f: Fleet) -> DataFrame:
    """The other zones calling when a heating cycle starts."""
    rows = thermostat.heating_rows(f.climate_in_context).filter("starts")
    return rows.select("site_id", "floor", "ts", "seq", asof.zone_names(F.col("zones"), F.col("floor")).alias("other_zones"))


# --- roll-ups ---------------------------------------------------------------------------------------------------------


def _stored_twice(days: DataFrame, total: str) -> DataFrame:
    """Summaries as a store holds them after a correction: an older version with another total, then the right one."""
    spark = days.sparkSession
    path = scratch_path(spark, "summaries")
    days.write.parquet(path)
    days = spark.read.parquet(path)
    older = days.withColumns({total: F.col(total) + 5, "seq": F.lit(0)})
    return older.unionByName(days.withColumn("seq", F.lit(1)))


@query()
def floor_daily_summary(f: Fleet) -> DataFrame:
    """A1"""
    return f.floor_days


def _furnace_days_with_warnings(f: Fleet, setpoints: bool = True) -> DataFrame:
    return derived.furnace_days(f.lean_timeline, f.warnings(at(AS_OF), SCALE), f.setpoints if setpoints else None)


@query(until=AS_OF)
def furnace_daily_summary(f: Fleet) -> DataFrame:
    """A2"""
    return _furnace_days_with_warnings(f)


@query(until=AS_OF)
def day_summary(f: Fleet) -> DataFrame:
    """A3: stored summaries up to a day, later days recomputed from their events (which carry no setpoints)."""
    spark = f.events.sparkSession
    path = scratch_path(spark, "days")
    _furnace_days_with_warnings(f).filter(F.col("date") <= day(STORED_THROUGH)).write.parquet(path)
    return rollups.day_summary(spark.read.parquet(path), _furnace_days_with_warnings(f, setpoints=False))


@query(until=AS_OF)
def monthly_summary(f: Fleet) -> DataFrame:
    """A4"""
    return rollups.monthly_summary(_stored_twice(_furnace_days_with_warnings(f, setpoints=False), "total_furnace_runtime_s"))


@query()
def weekly_comparison(f: Fleet) -> DataFrame:
    """A5, A6, P9, T4"""
    out = comparisons.weekly_comparison(_stored_twice(f.furnace_days, "total_furnace_runtime_s"))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query()
def runtime_trend(f: Fleet) -> DataFrame:
    """A7, J11, T2-style dedupe of repeated summaries."""
    return comparisons.runtime_trend(comparisons.stored(_stored_twice(f.floor_days, "total_runtime_s"), ["site_id", "floor", "date"]), day("2024-01-29"))


@query()
def floor_trend(f: Fleet) -> DataFrame:
    """A7, single floor."""
    return comparisons.floor_trend(f.floor_days, "floor_2", day("2024-01-29"))


@query()
def duty_cycle(f: Fleet) -> DataFrame:
    """A8, J5"""
    out = rollups.duty_cycle(f.furnace, "2024-01-10", "2024-01-16", sites=f.days)
    return out.withColumns({"total_on_s": F.round("total_on_s", 3), "duty_cycle_pct": F.round("duty_cycle_pct", 6)})


@query()
def duty_cycle_windows(f: Fleet) -> DataFrame:
    """Three days from each active day on, over all sites."""
    days = f.days.select("date").distinct()
    windows = days.select(F.date_format("date", "yyyy-MM-dd").alias("window_id"), F.col("date").cast("timestamp").alias("start"), F.date_add("date", 3).cast("timestamp").alias("end"))
    out = rollups.duty_cycle_windows(f.furnace, windows)
    return out.withColumns({"total_on_s": F.round("total_on_s", 3), "duty_cycle_pct": F.round("duty_cycle_pct", 6)})


@query()
def temp_correlation(f: Fleet) -> DataFrame:
    """A9, P10"""
    return comparisons.temp_correlation(_stored_twice(f.floor_days, "total_runtime_s")).withColumn("r", F.round("r", 6))


@query()
def session_temp_correlation(f: Fleet) -> DataFrame:
    """A10, P10"""
    out = comparisons.session_temp_correlation(f.furnace_with_outdoor)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query()
def floor_runtime_summary(f: Fleet) -> DataFrame:
    """A11, P12"""
    return rollups.range_runtime_summary(f.floor_days, day("2024-01-05"), day("2024-01-20"))


@query()
def duration_baseline(f: Fleet) -> DataFrame:
    """A12"""
    return comparisons.duration_baseline(f.calls)


@query()
def duration_baseline_merged(f: Fleet) -> DataFrame:
    """Sketches per floor and day, stored, loaded and merged; every percentile is held against the exact ranks of all calls."""
    spark = f.events.sparkSession
    path = scratch_path(spark, "sketches")
    sinks.save_baseline(comparisons.duration_sketches(f.stored_calls, ["key"]), path)
    merged = comparisons.merged_baseline(sinks.load_baseline(spark, path), ["key"])
    calls = f.stored_calls.filter(F.col("duration_s").isNotNull()).select(F.col("floor").alias("key"), "duration_s")
    held = keyed_join(calls, merged, ["key"]).groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("count", "min", "max")],
        *[F.count_if(F.col("duration_s") < F.col(c)).alias(f"_below_{c}") for c in ("median", "p75", "p95")],
        *[F.count_if(F.col("duration_s") <= F.col(c)).alias(f"_to_{c}") for c in ("median", "p75", "p95")],
    )
    off = comparisons.rank_error()
    near = lambda c, q: (F.col(f"_below_{c}") <= (q + off) * F.col("count") + 1) & (F.col(f"_to_{c}") >= (q - off) * F.col("count") - 1)
    return held.select("key", "count", "min", "max", near("median", 0.5).alias("median_near"), near("p75", 0.75).alias("p75_near"), near("p95", 0.95).alias("p95_near"))


@query(until=AS_OF)
def warnings_daily(f: Fleet) -> DataFrame:
    """A13"""
    return alarms.warnings_daily(f.warnings(at(AS_OF), SCALE), WARNING_KINDS)


def _live(f: Fleet) -> DataFrame:
    calls = edges.open_sessions(f.observations(CALL), CALL)
    open_now = calls.unionByName(edges.open_sessions(f.observations(FURNACE), FURNACE))
    return rollups.live_status(f.calls, f.furnace, open_now, at(LIVE_AT), sites=f.days)


@query(until=LIVE_AT)
def live_status(f: Fleet) -> DataFrame:
    """A14"""
    return _live(f)


def _stored_totals(f: Fleet) -> DataFrame:
    """Day totals as stored: an outdated version of each, and a last one that is a minute off on every seventh of the month."""
    off = F.when(F.dayofmonth("date") % 7 == 0, 60).otherwise(0)
    return _stored_twice(f.floor_days.withColumn("total_runtime_s", F.col("total_runtime_s") + off), "total_runtime_s")


@query()
def reconcile_daily(f: Fleet) -> DataFrame:
    """Stored day totals, of which some are repeated or wrong, against all calls."""
    return comparisons.reconcile_daily(_stored_totals(f), f.calls).filter("mismatch").drop("mismatch")


@query()
def reconcile_totals(f: Fleet) -> DataFrame:
    """Days and pairs checked."""
    return comparisons.reconcile_totals(comparisons.reconcile_daily(_stored_totals(f), f.calls))


@query()
def unreconciled_days(f: Fleet) -> DataFrame:
    """Days with calls that the stored summaries do not cover."""
    stored = f.floor_days.filter(F.col("date") <= day(STORED_THROUGH))
    return comparisons.unreconciled_days(stored, f.calls)


# --- rules ------------------------------------------------------------------------------------------------------------


@query()
def floor_runtime_anomaly(f: Fleet) -> DataFrame:
    """R1"""
    out = rules.floor_runtime_anomaly(f.floor_days)
    return out.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query()
def session_duration_anomaly(f: Fleet) -> DataFrame:
    """The fleet's baseline per floor is stored, loaded and joined."""
    spark = f.events.sparkSession
    path = scratch_path(spark, "baseline")
    sinks.save_baseline(comparisons.duration_baseline(f.calls, keys=["key"]), path)
    out = rules.session_duration_anomaly(f.calls, sinks.load_baseline(spark, path), short_s=SCALE["short_call_s"])
    return out.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query()
def furnace_short_calls(f: Fleet) -> DataFrame:
    """R3"""
    return alarms.short_calls(f.furnace, SCALE["short_call_s"]).drop("floor", "ts")


def _efficiency(f: Fleet) -> DataFrame:
    gains = cohorts(rules.cycle_gains(thermostat.heating_cycles(f.climate)))
    return rules.heating_efficiency(gains, at(AS_OF), groups=["cohort", "floor"])


@query()
def heating_efficiency(f: Fleet) -> DataFrame:
    """R4"""
    return _efficiency(f)


@query()
def efficiency_extremes(f: Fleet) -> DataFrame:
    """R5"""
    return rules.efficiency_extremes(_efficiency(f), "cohort")


def _shift(f: Fleet, ratio: float) -> DataFrame:
    marked = rules.split_by_position(cohorts(f.stored_calls), ["cohort"])
    return rules.time_of_day_shift(marked, ["cohort", "floor"], ratio=ratio)


@query()
def time_of_day_shift(f: Fleet) -> DataFrame:
    """At a lower ratio, so that the even test data has findings."""
    return _shift(f, 1.2)


def _degradation(f: Fleet) -> DataFrame:
    return rules.efficiency_degradation(cohorts(f.calls), ["cohort", "floor"])


@query()
def efficiency_degradation(f: Fleet) -> DataFrame:
    """R7, P6"""
    return _degradation(f)


@query()
def insights(f: Fleet) -> DataFrame:
    """R9"""
    out = rules.insights(_efficiency(f), _degradation(f), _shift(f, 1.2))
    return out.select(
        "insight", "cohort", "floor", "score_f_per_min", "session_count", "slope_s_per_week", "weeks_analysed", "period", "ratio",
        "observed_count", "historical_count",
    )


# --- alarms -----------------------------------------------------------------------------------------------------------


def _long_calls(f: Fleet) -> DataFrame:
    return alarms.long_calls(f.call_edges, f.climate, at(AS_OF), SCALE["long_call_s"], SCALE["floors"])


def _no_response(f: Fleet) -> DataFrame:
    return alarms.floor_no_response(f.call_edges, f.climate, at(AS_OF), SCALE["no_response_s"], SCALE["no_response_default_s"])


@query(until=AS_OF)
def long_call_warnings(f: Fleet) -> DataFrame:
    """L1, J4"""
    return _long_calls(f)


@query(until=AS_OF)
def long_call_escalations(f: Fleet) -> DataFrame:
    """L2"""
    return alarms.long_call_escalations(_long_calls(f))


@query(until=AS_OF)
def silence_gaps(f: Fleet) -> DataFrame:
    """L3"""
    return alarms.silence_gaps(f.climate, at(AS_OF), SCALE["silence_s"])


@query(until=AS_OF)
def floor_no_response(f: Fleet) -> DataFrame:
    """L4, J6"""
    return _no_response(f)


@query(until=AS_OF)
def alert_throttle(f: Fleet) -> DataFrame:
    """All long-call alerts of a site share one limiter of two days."""
    alerts = _long_calls(f).select("site_id", F.lit("floor_2_long_call").alias("kind"), "floor", "ts", "seq")
    return alarms.throttle(alerts, interval_s=2 * DAY)


@query(until=AS_OF)
def late_alerts(f: Fleet) -> DataFrame:
    """An alert is sent when the site's next event arrives."""
    rows = scan(f.climate.drop("floor"), ["site_id"], following={"sent_at": F.col("ts")})
    return alarms.late_alerts(rows, F.col("sent_at")).select("site_id", "ts", "seq", "sent_at", "late")


# --- latest-value and series views ------------------------------------------------------------------------------------


@query()
def recent_sessions(f: Fleet) -> DataFrame:
    """T1"""
    return context.recent_sessions(f.furnace_with_outdoor).drop("floor", "ts")


@query(until=AS_OF)
def recent_warnings(f: Fleet) -> DataFrame:
    """T2"""
    log = derived.row_events(f.lean_timeline, at(AS_OF), SCALE, {}, WARNING_LABELS)
    log = log.unionByName(derived.day_events(derived.furnace_days(f.lean_timeline)))
    rows = context.recent_warnings(log, at("2024-01-28 00:00:00"), hours=72)
    return rows.select("site_id", "label", "floor", "ts", "duration_s").orderBy(F.col("ts").desc(), "site_id", "label")


@query()
def latest_gauges(f: Fleet) -> DataFrame:
    """G1"""
    return gauges.latest_gauges(f.gauge_samples)


@query()
def gauge_series(f: Fleet) -> DataFrame:
    """G2"""
    return gauges.gauge_series(f.gauge_samples, GRID_S)


@query()
def runtime_today(f: Fleet) -> DataFrame:
    """G3"""
    return gauges.runtime_today(f.calls).select("site_id", "floor", "ts", "seq", "date", "duration_s", "runtime_today_s")


@query()
def anomaly_counter(f: Fleet) -> DataFrame:
    """G4"""
    counted = gauges.anomaly_counter(rules.floor_runtime_anomaly(f.floor_days))
    return counted.select("site_id", "floor", "date", "anomalies_total")


@query()
def hourly_increase(f: Fleet) -> DataFrame:
    """G5"""
    return gauges.hourly_increase(gauges.runtime_today(f.calls), "runtime_today_s").drop("entity_id")


@query()
def series_reduce(f: Fleet) -> DataFrame:
    """G6"""
    out = gauges.series_reduce(gauges.gauge_series(f.gauge_samples, GRID_S))
    return out.withColumn("mean", F.round("mean", 6))


@query()
def current_snapshot(f: Fleet) -> DataFrame:
    """G7"""
    return gauges.current_snapshot(f.gauge_samples)


@query()
def zone_snapshots(f: Fleet) -> DataFrame:
    """The map flattened to one row per zone."""
    snaps = gauges.zone_snapshots(f.climate, f.outdoor, GRID_S)
    rows = snaps.select("site_id", "ts", "outdoor_temp_f", F.explode("zones").alias("floor", "s"))
    return rows.select("site_id", "ts", "floor", "s.current_temp", "s.setpoint", "s.hvac_action", "outdoor_temp_f")


@query(until=LIVE_AT)
def context_rollup(f: Fleet) -> DataFrame:
    """G9"""
    return context.context_rollup(gauges.current_snapshot(f.gauge_samples), _live(f), derived.furnace_days(derived.without_context(f.fused())), at(LIVE_AT), hours=48)


# --- replay views -----------------------------------------------------------------------------------------------------


@query()
def restart_tag(f: Fleet) -> DataFrame:
    """ST9: runs restart daily; events up to the first full cycle of the run are tagged."""
    climate = f.climate_in_context
    cycles = thermostat.heating_cycles(climate)
    cols = ("site_id", "floor")
    reach = thermostat.time_to_temp(climate).select(*cols, "ts", "seq", F.lit(TIME_TO_TEMP).alias("event_type"))
    ends = {OVERSHOOT: thermostat.overshoot(cycles), SETPOINT_MISS: thermostat.setpoint_miss(cycles)}
    log = reach
    for name, rows in ends.items():
        log = log.unionByName(rows.select(*cols, F.col("ended_at").alias("ts"), F.lit(-1).cast("long").alias("seq"), F.lit(name).alias("event_type")))
    tagged = context.restart_tag(log, F.to_date("ts"), F.col("event_type").isin(TIME_TO_TEMP, SETPOINT_MISS))
    return tagged.select("site_id", "floor", "event_type", "ts", "run_id", "across_restart")


@query()
def backfill(f: Fleet) -> DataFrame:
    """ST8: floor calls from a time on, open calls at that time taken over as they were."""
    from emberline.operators.replay import backfill_calls

    start = at("2024-01-16 00:00:00")
    return backfill_calls(f.call_edges, start).select("site_id", "entity_id", "floor", "ended_at", "seq", "duration_s")

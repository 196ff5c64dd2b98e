"""Latest-value and series views over the derived events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.timeline import instant, keep_slice, scan
from emberline.schema import FLOORS, SNAPSHOT_INTERVAL_S

FLOOR_ENTITY = ("site_id", "entity_id", "floor")
GAUGE = ("site_id", "metric", "floor")
SNAPSHOT = (
    *[("floor_temperature_f", f, f"{f}_temp_f") for f in FLOORS],
    *[("floor_setpoint_f", f, f"{f}_setpoint_f") for f in FLOORS],
    *[("floor_call_active", f, f"{f}_calling") for f in FLOORS],
    ("outdoor_temperature_f", None, "outdoor_temp_f"),
    ("furnace_active", None, "furnace_active"),
)


def _samples(rows: DataFrame, *gauges: tuple[str, Column]) -> DataFrame:
    """Rows as gauge samples; samples without a value are dropped."""
    floor = F.col("floor") if "floor" in rows.columns else F.lit(None).cast("string")
    parts = F.array(*[F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in gauges])
    return rows.select("site_id", floor.alias("floor"), "ts", "seq", *keep_slice(rows), F.inline(parts)).filter(
        F.col("value").isNotNull()
    )


def gauge_samples(
    calls_edges: DataFrame, furnace_edges: DataFrame, furnace: DataFrame, thermostat: DataFrame, outdoor: DataFrame
) -> DataFrame:
    """Every gauge change: activity flags, session duration, floor temperature and setpoint, outdoor temperature."""
    on = F.when(F.col("edge") == "started", 1.0).otherwise(0.0)
    temp = F.when(F.col("temp_changed"), F.col("current_temp"))
    setpoint = F.when(F.col("temp_changed") | F.col("setpoint_changed"), F.col("setpoint"))
    parts = [
        _samples(calls_edges, ("floor_call_active", on)),
        _samples(furnace_edges, ("furnace_active", on)),
        _samples(furnace, ("heating_session_duration_s", F.col("duration_s"))),
        _samples(thermostat, ("floor_temperature_f", temp), ("floor_setpoint_f", setpoint)),
        _samples(outdoor, ("outdoor_temperature_f", F.col("temperature_f"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def latest_gauges(samples: DataFrame) -> DataFrame:
    return (
        samples.withColumn("_at", instant())
        .groupBy(*GAUGE)
        .agg(F.max_by("value", "_at").alias("value"), F.max("ts").alias("ts"))
    )


def current_snapshot(samples: DataFrame, layout: Sequence[tuple[str, str | None, str]] = SNAPSHOT) -> DataFrame:
    """One wide row of current values per site, null where a gauge never reported."""
    def mine(metric: str, floor: str | None) -> Column:
        return (F.col("metric") == metric) & (F.col("floor").eqNullSafe(F.lit(floor)))

    return (
        samples.withColumn("_at", instant())
        .groupBy("site_id")
        .agg(*[F.max_by("value", F.when(mine(m, f), F.col("_at"))).alias(name) for m, f, name in layout])
    )


def _tick(ts: str, step_s: int) -> Column:
    """Index of the first grid time at or after the timestamp."""
    return F.ceil(F.unix_micros(ts) / (step_s * 1_000_000)).cast("long")


def _tick_time(tick: Column, step_s: int) -> Column:
    return F.timestamp_micros(tick * step_s * 1_000_000)


def gauge_series(samples: DataFrame, step_s: int) -> DataFrame:
    """Samples on a regular grid from the gauge's first to its last tick, each tick showing the last known value.

    Samples are reduced to one per tick before the shuffle; a tick is then repeated up to the next one, so neither a
    grid table nor a join is needed and the ordered window holds ticks.
    """
    ticks = (
        samples.withColumn("_at", instant())
        .groupBy(*GAUGE, _tick("ts", step_s).alias("tick"))
        .agg(F.max_by("value", "_at").alias("value"))
    )
    along = Window.partitionBy(*GAUGE).orderBy("tick")
    until = F.coalesce(F.lead("tick").over(along) - 1, F.col("tick"))
    return ticks.withColumn("until", until).withColumn("tick", F.explode(F.sequence("tick", "until"))).select(
        *GAUGE, _tick_time(F.col("tick"), step_s).alias("ts"), "value"
    )


def runtime_today(calls: DataFrame) -> DataFrame:
    """Running runtime of a floor since UTC midnight, one sample per ended call of known duration.

    Keyed by the floor's entity, as the calls are, so that no further shuffle is needed.
    """
    rows = calls.filter(F.col("duration_s").isNotNull()).withColumn("date", F.to_date("ts"))
    return scan(rows, [*FLOOR_ENTITY, "date"], running={"runtime_today_s": F.col("duration_s")})


def anomaly_counter(anomalies: DataFrame) -> DataFrame:
    """Cumulative anomalies of a floor; the input has at most one row per floor and day."""
    along = Window.partitionBy("site_id", "floor").orderBy("date")
    return anomalies.withColumn("anomalies_total", F.count(F.lit(1)).over(along.rowsBetween(Window.unboundedPreceding, 0)))


def hourly_increase(counter: DataFrame, value: str, keys: Sequence[str] = FLOOR_ENTITY) -> DataFrame:
    """Growth of a resetting counter per hour; a fall is a reset, after which the whole value is growth."""
    rows = scan(counter, keys, previous={"_before": F.col(value)})
    grown = F.when(F.col("_before").isNull() | (F.col(value) < F.col("_before")), F.col(value)).otherwise(
        F.col(value) - F.col("_before")
    )
    return rows.groupBy(*keys, F.date_trunc("hour", "ts").alias("hour")).agg(F.sum(grown).alias("increase"))


def series_reduce(series: DataFrame) -> DataFrame:
    """Reducers of a series: last, last known, minimum, maximum and mean."""
    return series.groupBy(*GAUGE).agg(
        F.max_by("value", F.col("ts")).alias("last"),
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("ts"))).alias("last_not_null"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.count("value").alias("n"),
    )


def zone_snapshots(
    climate: DataFrame, outdoor: DataFrame, step_s: int = SNAPSHOT_INTERVAL_S, floors: Sequence[str] = FLOORS
) -> DataFrame:
    """Every zone's state on a regular grid per site, with the same-day outdoor temperature.

    Zones without a temperature are skipped, ticks without any zone as well. ``zones`` maps floor to its state.
    """
    at = F.struct("ts", "seq")
    rows = climate.select(
        "site_id", "ts", "seq", "floor", F.struct("current_temp", "setpoint", "hvac_action").alias("state")
    ).unionByName(outdoor.select("site_id", "ts", "seq", F.struct("temperature_f", "ts").alias("reading")), allowMissingColumns=True)
    ticks = rows.groupBy("site_id", _tick("ts", step_s).alias("tick")).agg(
        *[F.max_by("state", F.when(F.col("floor") == f, at)).alias(f) for f in floors],
        F.max_by("reading", F.when(F.col("reading").isNotNull(), at)).alias("outdoor"),
    )
    along = Window.partitionBy("site_id").orderBy("tick")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = ticks.select(
        "site_id",
        "tick",
        *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in (*floors, "outdoor")],
        F.coalesce(F.lead("tick").over(along) - 1, F.col("tick")).alias("until"),
    )
    grid = filled.withColumn("tick", F.explode(F.sequence("tick", "until"))).withColumn(
        "ts", _tick_time(F.col("tick"), step_s)
    )
    entries = F.array(*[F.struct(F.lit(f).alias("key"), F.col(f).alias("value")) for f in floors])
    known = F.filter(entries, lambda e: e["value"]["current_temp"].isNotNull())
    same_day = F.to_date("outdoor.ts") == F.to_date("ts")
    return grid.select(
        "site_id",
        "ts",
        F.map_from_entries(known).alias("zones"),
        F.when(same_day, F.col("outdoor.temperature_f")).alias("outdoor_temp_f"),
    ).filter(F.size("zones") > 0)

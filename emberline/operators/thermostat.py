"""Thermostat changes, heating cycles and their outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalars import by_floor, seconds_between
from emberline.functions.timeline import keep_slice, moment, scan
from emberline.operators.asof import zone_names
from emberline.schema import (
    CLIMATE,
    MODE_CHANGED,
    SETPOINT_CHANGED,
    SETPOINT_REACHED,
    SLOW_TO_HEAT_S,
    TEMP_UPDATED,
)

ENTITY = ("site_id", "entity_id")
CONTEXT = ("outdoor_temp_f", "zones")


def climate_rows(observations: DataFrame) -> DataFrame:
    """Thermostat readings with their attributes as columns; rows without attributes are invisible."""
    a = F.col("attributes")
    given = a["temperature"].isNotNull() | a["current_temperature"].isNotNull() | a["hvac_action"].isNotNull()
    rows = observations.filter((F.col("kind") == CLIMATE) & given)
    return rows.select(
        "site_id",
        "entity_id",
        "floor",
        "ts",
        "seq",
        a["temperature"].alias("setpoint"),
        a["current_temperature"].alias("current_temp"),
        F.col("new_state").alias("hvac_mode"),
        a["hvac_action"].alias("hvac_action"),
        *keep_slice(rows),
    )


def changes(climate: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """Each reading with its predecessor and what changed. Null readings overwrite, so nulls are never skipped."""
    fields = ("setpoint", "current_temp", "hvac_mode", "hvac_action")
    rows = scan(climate, keys, previous={f"prev_{f}": F.col(f) for f in fields})

    def differs(field: str):
        return F.col(field).isNotNull() & ~F.col(field).eqNullSafe(F.col(f"prev_{field}"))

    heating = F.col("hvac_action").eqNullSafe(F.lit("heating"))
    was_heating = F.col("prev_hvac_action").eqNullSafe(F.lit("heating"))
    below = F.col("prev_current_temp").isNull() | (F.col("prev_current_temp") < F.col("setpoint"))
    reached = was_heating & F.coalesce((F.col("current_temp") >= F.col("setpoint")) & below, F.lit(False))
    return rows.withColumns(
        {
            "setpoint_changed": differs("setpoint"),
            "temp_changed": differs("current_temp"),
            "mode_changed": differs("hvac_mode") | differs("hvac_action"),
            "heating": heating,
            "was_heating": was_heating,
            "reached": reached,
        }
    )


def change_events(changed: DataFrame) -> DataFrame:
    """Readings as change events, one row per kind of change, all kinds in one pass."""
    flags = {
        SETPOINT_CHANGED: "setpoint_changed",
        TEMP_UPDATED: "temp_changed",
        MODE_CHANGED: "mode_changed",
        SETPOINT_REACHED: "reached",
    }
    events = F.array_compact(F.array(*[F.when(F.col(flag), F.lit(name)) for name, flag in flags.items()]))
    fields = ("site_id", "floor", "ts", "seq", "setpoint", "current_temp", "hvac_mode", "hvac_action")
    return changed.select(*fields, F.explode(events).alias("event_type"))


def with_cycles(changed: DataFrame, keys: Sequence[str] = ENTITY) -> DataFrame:
    """Readings with their changes and the heating cycle they belong to (``in_cycle``), the closing reading included."""
    starts = F.col("heating") & ~F.col("was_heating")
    rows = scan(
        changed,
        keys,
        latest={
            "_start": F.when(starts, F.struct("ts", "seq", F.col("current_temp").alias("temp"))),
            "_reach": F.when(F.col("reached"), F.struct("ts", "seq")),
        },
    )
    in_cycle = (F.col("heating") | F.col("was_heating")) & F.col("_start").isNotNull()
    after_start = moment("_reach.ts", "_reach.seq") > moment("_start.ts", "_start.seq")
    return rows.withColumns(
        {
            "in_cycle": in_cycle,
            "cycle_ts": F.col("_start.ts"),
            "cycle_seq": F.col("_start.seq"),
            "start_temp": F.col("_start.temp"),
            "starts": starts,
            "closes": F.col("was_heating") & ~F.col("heating"),
            "reached_so_far": F.coalesce(after_start, F.lit(False)),
        }
    ).drop("_start", "_reach")


def heating_rows(climate: DataFrame) -> DataFrame:
    """Readings that belong to a heating cycle, tagged with its start. The closing reading belongs to the cycle."""
    return with_cycles(changes(climate)).filter("in_cycle").drop("in_cycle")


def heating_cycles(climate: DataFrame) -> DataFrame:
    return cycle_summary(heating_rows(climate))


def cycle_summary(rows: DataFrame) -> DataFrame:
    """One row per heating cycle: bounds, temperatures, reaches and adjustments; context columns when present."""
    closing = lambda c: F.max(F.when(F.col("closes"), F.col(c)))
    later = F.col("reached_so_far") & F.col("heating") & F.col("temp_changed")
    after_reach = F.col("reached") | later
    adjusted = F.col("was_heating") & F.col("heating") & (F.col("setpoint_changed") | F.col("mode_changed"))
    context = []
    if set(CONTEXT) <= set(rows.columns):
        context = [
            closing("outdoor_temp_f").alias("outdoor_temp_f"),
            F.max(F.when(F.col("starts"), F.col("zones"))).alias("zones"),
        ]
    return rows.groupBy("site_id", "entity_id", "floor", "cycle_ts", "cycle_seq").agg(
        F.max(F.when(F.col("starts"), F.col("start_temp"))).alias("start_temp"),
        F.count(F.lit(1)).alias("readings"),
        F.max(F.when(F.col("closes"), F.lit(True))).isNotNull().alias("closed"),
        closing("ts").alias("ended_at"),
        closing("seq").alias("ended_seq"),
        closing("setpoint").alias("end_setpoint"),
        closing("current_temp").alias("end_temp"),
        F.max(F.when(F.col("reached"), F.col("ts"))).alias("reached_at"),
        F.count_if(after_reach).alias("readings_after_reach"),
        F.max(F.when(after_reach, F.col("current_temp"))).alias("peak_after_reach"),
        F.max(F.when(F.col("heating") & F.col("temp_changed"), F.col("current_temp"))).alias("closest_reading"),
        F.max(F.when(adjusted, F.lit(True))).isNotNull().alias("adjusted"),
        *context,
    )


def time_to_temp(climate: DataFrame) -> DataFrame:
    """Each reach of the setpoint inside a cycle whose start temperature is known. Needs zone context."""
    rows = heating_rows(climate).filter(F.col("reached") & F.col("start_temp").isNotNull())
    duration = seconds_between(F.col("cycle_ts"), F.col("ts"))
    gained = F.col("current_temp") - F.col("start_temp")
    per_min = F.when(duration > 0, F.round(gained / (duration / 60), 3)).otherwise(0.0)
    return rows.select(
        "site_id",
        "entity_id",
        "floor",
        "ts",
        "seq",
        "start_temp",
        "setpoint",
        (F.col("setpoint") - F.col("start_temp")).alias("setpoint_delta"),
        duration.alias("duration_s"),
        F.col("current_temp").alias("end_temp"),
        gained.alias("degrees_gained"),
        per_min.alias("degrees_per_min"),
        "outdoor_temp_f",
        zone_names(F.col("zones"), F.col("floor")).alias("other_zones"),
        *keep_slice(rows),
    )


def reached_and_closed() -> Column:
    return F.col("closed") & F.col("reached_at").isNotNull()


def closed_below() -> Column:
    """A cycle that ended below a setpoint above its start temperature."""
    delta = F.col("end_setpoint") - F.col("start_temp")
    return F.col("closed") & F.col("reached_at").isNull() & (delta > 0) & (F.coalesce("closest_reading", "start_temp") < F.col("end_setpoint"))


def overshoot(cycles: DataFrame) -> DataFrame:
    """Closed cycles that reached their setpoint; the peak needs more than one reading from the reach on."""
    return cycles.filter(reached_and_closed()).select(
        "site_id",
        "entity_id",
        "floor",
        F.col("cycle_ts").alias("started_at"),
        "ended_at",
        F.col("ended_seq").alias("seq"),
        "start_temp",
        F.col("end_setpoint").alias("setpoint"),
        (F.col("end_setpoint") - F.col("start_temp")).alias("setpoint_delta"),
        "end_temp",
        seconds_between(F.col("reached_at"), F.col("ended_at")).alias("overshoot_s"),
        F.when(F.col("readings_after_reach") > 1, F.col("peak_after_reach")).alias("peak_temp"),
        "outdoor_temp_f",
        zone_names(F.col("zones"), F.col("floor")).alias("other_zones"),
    )


def setpoint_miss(cycles: DataFrame) -> DataFrame:
    """Closed cycles that never reached a setpoint above their start temperature, with the likely cause."""
    closest = F.coalesce("closest_reading", "start_temp")
    delta = F.col("end_setpoint") - F.col("start_temp")
    cause = F.when(F.col("adjusted"), "thermostat_adjustment").otherwise("unknown")
    context = [c for c in ("outdoor_temp_f",) if c in cycles.columns]
    if "zones" in cycles.columns:
        context.append(zone_names(F.col("zones"), F.col("floor")).alias("other_zones"))
    return cycles.filter(closed_below()).select(
        "site_id",
        "entity_id",
        "floor",
        F.col("cycle_ts").alias("started_at"),
        "ended_at",
        F.col("ended_seq").alias("seq"),
        "start_temp",
        F.col("end_setpoint").alias("setpoint"),
        delta.alias("setpoint_delta"),
        seconds_between(F.col("cycle_ts"), F.col("ended_at")).alias("duration_s"),
        closest.alias("closest_temp"),
        (F.col("end_setpoint") - closest).alias("delta"),
        cause.alias("likely_cause"),
        *context,
    )


def slow_to_heat(climate: DataFrame, thresholds_s: Mapping[str, float] = SLOW_TO_HEAT_S) -> DataFrame:
    """First heating reading of a cycle past the floor's threshold with the setpoint not reached yet."""
    elapsed = seconds_between(F.col("cycle_ts"), F.col("ts"))
    rows = heating_rows(climate).withColumns({"elapsed_s": elapsed, "threshold_s": by_floor(thresholds_s)})
    slow = rows.filter(F.col("heating") & ~F.col("reached_so_far") & (F.col("elapsed_s") >= F.col("threshold_s")))
    payload = ["ts", "seq", "elapsed_s", "threshold_s", "start_temp", "current_temp", "setpoint"]
    payload += [c for c in ("outdoor_temp_f",) if c in rows.columns]
    first = slow.groupBy("site_id", "entity_id", "floor", "cycle_ts", "cycle_seq").agg(
        F.min(F.struct(*payload)).alias("f")
    )
    return first.select("site_id", "entity_id", "floor", F.col("cycle_ts").alias("started_at"), "f.*").withColumns(
        {
            "setpoint_delta": F.col("setpoint") - F.col("start_temp"),
            "degrees_gained": F.col("current_temp") - F.col("start_temp"),
        }
    )

"""Recomputing from a point in time with the state that was current then.

The state is what the batch operators say about the rows before that time: open sessions (C9), open heating cycles (C8), the last
readings. Every seed is an aggregate with map-side combine; a document of state is a few numbers per zone of a site.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalars import by_floor, plus_seconds
from emberline.functions.timeline import instant
from emberline.operators import alarms, asof, edges, thermostat
from emberline.schema import CALL, FURNACE, LONG_CALL_S, NO_RESPONSE_DEFAULT_S, NO_RESPONSE_S, SILENCE_S, SLOW_TO_HEAT_S


def backfill_calls(on_off: DataFrame, start: Column) -> DataFrame:
    """Sessions that end at or after ``start``, from the edges after it and one seed edge per entity before it.

    The seed is the last edge before ``start`` (an aggregate with map-side combine), so the ordered scan reads the
    replayed span only.
    """
    before = on_off.filter(F.col("ts") < start)
    columns = [c for c in on_off.columns if c not in ("site_id", "entity_id")]
    seed = before.groupBy("site_id", "entity_id").agg(F.max_by(F.struct(*columns), F.struct("ts", "seq")).alias("_s"))
    seeded = on_off.filter(F.col("ts") >= start).unionByName(seed.select("site_id", "entity_id", "_s.*"))
    return edges.sessions(seeded).filter(F.col("ended_at") >= start)


def _last(rows: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    """The values of the last row of each key; each value is its own aggregate, so aggregation stays on hashes."""
    at = rows.withColumn("_at", instant())
    return at.groupBy(*keys).agg(*[F.max_by(c, "_at").alias(name) for name, c in columns.items()])


def _by_floor(rows: DataFrame, name: str, entry: Column) -> DataFrame:
    """One map from floor to entry per site; a site has as many entries as the scheme has floors."""
    return rows.groupBy("site_id").agg(F.map_from_entries(F.collect_list(F.struct("floor", entry.alias("v")))).alias(name))


def _documents(*parts: DataFrame) -> DataFrame:
    """The parts side by side as one JSON document per site."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "site_id", "full_outer")
    fields = [F.col(c) for c in out.columns if c != "site_id"]
    for i, f in enumerate(out.columns[1:]):
        if f in ("zones", "calls"):
            fields[i] = F.coalesce(F.col(f), F.map_from_arrays(F.array(), F.array()).cast(out.schema[f].dataType)).alias(f)
    return out.select("site_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("doc"))


def seed_calls(observations: DataFrame, start: Column) -> DataFrame:
    """``site_id, entity_id, state, since`` of call and furnace sensors at ``start``."""
    rows = observations.filter((F.col("ts") < start) & F.col("kind").isin(CALL, FURNACE))
    keys = ["site_id", "entity_id"]
    states = _last(rows, keys, state=F.col("new_state"))
    on_off = edges.edges(rows, CALL).unionByName(edges.edges(rows, FURNACE))
    since = _last(on_off, keys, since=F.when(F.col("edge") == "started", F.unix_micros("ts")))
    return states.join(since, keys, "left")


def seed_cycles(observations: DataFrame, start: Column, slow_s: Mapping[str, float] = SLOW_TO_HEAT_S) -> DataFrame:
    """``site_id, doc``: the state of ``CycleProcessor`` at ``start``."""
    rows = observations.filter(F.col("ts") < start)
    on_off, outdoor = edges.edges(rows, CALL), edges.outdoor_readings(rows)
    climate = asof.with_zone_context(thermostat.climate_rows(rows), on_off, outdoor)
    cycles = thermostat.heating_cycles(climate).filter(~F.col("closed"))
    slow = thermostat.slow_to_heat(climate, slow_s).select("site_id", "entity_id", F.col("started_at").alias("cycle_ts"), F.lit(True).alias("slow"))
    posted = F.col("readings_after_reach") > 0
    none = F.array().cast("array<double>")
    cycle = F.struct(
        F.unix_micros("cycle_ts").alias("us"),
        F.col("start_temp").alias("temp"),
        asof.zone_names(F.col("zones"), F.col("floor")).alias("zones"),
        F.unix_micros("reached_at").alias("reached"),
        F.when(posted, F.array(F.col("readings_after_reach").cast("double"), F.col("peak_after_reach"))).otherwise(none).alias("post"),
        F.col("closest_reading").alias("best"),
        F.col("adjusted"),
        F.coalesce("slow", F.lit(False)).alias("slow"),
    )
    open_cycles = cycles.join(slow, ["site_id", "entity_id", "cycle_ts"], "left").select("site_id", "entity_id", cycle.alias("cycle"))
    last = _last(climate, ["site_id", "entity_id", "floor"], setpoint=F.col("setpoint"), temp=F.col("current_temp"), mode=F.col("hvac_mode"), action=F.col("hvac_action"))
    zone = F.struct("setpoint", "temp", "mode", "action", "cycle")
    zones = _by_floor(last.join(open_cycles, ["site_id", "entity_id"], "left"), "zones", zone)
    sensors = rows.filter(F.col("kind") == CALL)
    state = _last(sensors, ["site_id", "floor"], state=F.col("new_state"))
    calling = _last(on_off, ["site_id", "floor"], on=F.col("edge") == "started")
    calls = _by_floor(state.join(calling, ["site_id", "floor"], "left"), "calls", F.struct("state", F.coalesce("on", F.lit(False)).alias("on")))
    day = F.floor(F.unix_micros("ts") / 86_400_000_000).cast("double")
    reading = _last(outdoor, ["site_id"], _day=day, _temp=F.col("temperature_f"))
    return _documents(zones, calls, reading.select("site_id", F.array("_day", "_temp").alias("outdoor")))


def seed_alarms(
    observations: DataFrame,
    start: Column,
    long_call_s: float = LONG_CALL_S,
    silence_s: float = SILENCE_S,
    no_response_s: Mapping[str, float] = NO_RESPONSE_S,
    no_response_default_s: float = NO_RESPONSE_DEFAULT_S,
) -> DataFrame:
    """``site_id, doc``: the state of ``AlarmProcessor`` at ``start``; what was due by then counts as settled."""
    rows = observations.filter(F.col("ts") < start)
    on_off, climate = edges.edges(rows, CALL), thermostat.climate_rows(rows)
    zones = _by_floor(_last(climate, ["site_id", "floor"], temp=F.col("current_temp")), "zones", F.col("temp"))
    members = alarms.calls_with_readings(on_off, climate)
    open_calls = (
        members.groupBy(*alarms.CALL_KEY)
        .agg(F.max("until").alias("_until"), F.max(F.when(F.col("is_start"), F.col("seen.current_temp"))).alias("start"), F.max("current_temp").alias("_high"))
        .filter(F.col("_until").isNull())
    )
    state = _last(rows.filter(F.col("kind") == CALL), ["site_id", "floor"], state=F.col("new_state"))
    due = lambda s: plus_seconds(F.col("call_ts"), s) <= start
    call = F.struct(
        "state",
        F.unix_micros("call_ts").alias("since"),
        "start",
        F.greatest("start", "_high").alias("best"),
        F.coalesce(due(long_call_s), F.lit(False)).alias("long"),
        F.coalesce(due(by_floor(no_response_s, no_response_default_s)), F.lit(False)).alias("cold"),
    )
    calls = _by_floor(state.join(open_calls, ["site_id", "floor"], "left"), "calls", call)
    last = rows.groupBy("site_id").agg(F.max("ts").alias("_ts"))
    quiet = plus_seconds(F.col("_ts"), silence_s) <= start
    return _documents(calls, zones, last.select("site_id", F.unix_micros("_ts").alias("last"), quiet.alias("quiet")))

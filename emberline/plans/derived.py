"""The derived log from one fused scan of the observations.

``timeline`` puts what every derived event needs beside each observation: previous states and edges, the heating cycle, the outdoor
reading and the zones calling, the open call of the floor, the neighbours in time. All its scans have the site in their key, so one
exchange by site serves them all; a site cut into slices is scanned slice by slice, as everywhere. The timeline is written once
and then read three times: for the events that one row decides, unfolded from an array per row; for heating cycles; for days.

The naming scheme has one call sensor and one thermostat per floor, on which the timeline relies.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline import schema
from emberline.functions.scalars import by_floor, numeric_state, plus_seconds, seconds_between
from emberline.functions.timeline import SLICE, keep_slice, scan
from emberline.operators import alarms, rollups, rules, thermostat
from emberline.schema import CALL, CLIMATE, FLOORS, FURNACE, OUTDOOR

ENTITY = ("site_id", "entity_id", "visible")

# columns of the log beside event_type and site_id
LOG = {
    "floor": "string",
    "ts": "timestamp",
    "seq": "bigint",
    "date": "date",
    "duration_s": "bigint",
    "temperature_f": "double",
    "start_temp": "double",
    "current_temp": "double",
    "setpoint": "double",
    "hvac_mode": "string",
    "hvac_action": "string",
    "outdoor_temp_f": "double",
}

WARNINGS = {
    schema.LONG_CALL: "floor_2_long_call",
    schema.LONG_CALL_ESCALATION: "floor_2_escalation",
    schema.NO_RESPONSE: "floor_no_response",
    schema.SLOW_TO_HEAT: "zone_slow_to_heat",
    schema.SILENCE: "observer_silence",
    schema.SETPOINT_MISS: "setpoint_miss",
    schema.SHORT_CALL: "furnace_short_call",
}


def timeline(observations: DataFrame, look_up_old: bool = False, parts: int | None = None) -> DataFrame:
    """Every observation with its place in sessions, cycles, calls and the readings around it.

    ``look_up_old`` takes previous states from the entity's row before, for sources that have none. ``parts`` is the number of tasks of the scan;
    each sorts its rows in memory several times over, so it should follow the number of rows.
    """
    rows = observations
    rows = rows.repartition(*[parts] * (parts is not None), *[c for c in ("site_id", SLICE) if c in rows.columns])
    a, kind = F.col("attributes"), F.col("kind")
    given = a["temperature"].isNotNull() | a["current_temperature"].isNotNull() | a["hvac_action"].isNotNull()
    climate = (kind == CLIMATE) & given
    rows = rows.select(
        "site_id",
        "entity_id",
        "kind",
        "floor",
        "ts",
        "seq",
        "old_state",
        "new_state",
        ((kind != CLIMATE) | given).alias("visible"),
        F.when(climate, a["temperature"]).alias("setpoint"),
        F.when(climate, a["current_temperature"]).alias("current_temp"),
        F.when(climate, F.col("new_state")).alias("hvac_mode"),
        F.when(climate, a["hvac_action"]).alias("hvac_action"),
        F.when(kind == OUTDOOR, numeric_state(F.col("new_state"))).alias("temperature_f"),
        *keep_slice(rows),
    )
    # along the entity: previous states, changes, cycles, the edge before this one
    rows = scan(rows, ENTITY, previous={"_old": F.col("new_state"), "prev_ts": F.col("ts")})
    old, new = F.col("_old" if look_up_old else "old_state"), F.col("new_state")
    edge = F.when((old == "off") & (new == "on"), "started").when((old == "on") & (new == "off"), "ended")
    rows = rows.withColumn("edge", F.when(kind.isin(CALL, FURNACE), edge)).drop("_old", "old_state", "new_state")
    rows = thermostat.with_cycles(thermostat.changes(rows, ENTITY), ENTITY)
    rows = scan(rows, ENTITY, latest={"_edge": F.when(F.col("edge").isNotNull(), F.struct("edge", "ts"))})
    rows = scan(rows, ENTITY, previous={"_before": F.col("_edge")})
    began = F.when((F.col("edge") == "ended") & (F.col("_before.edge") == "started"), F.col("_before.ts"))
    rows = rows.withColumn("started_at", began).drop("_edge", "_before")
    # along the site: outdoor temperature, zones calling, the state of each zone
    is_climate = (kind == CLIMATE) & F.col("visible")
    state = F.struct("current_temp", "setpoint", "hvac_action")
    latest = {"_outdoor": F.when(F.col("temperature_f").isNotNull(), F.struct(F.col("temperature_f").alias("temp"), F.col("ts").alias("at")))}
    for i, f in enumerate(FLOORS):
        mine = F.col("floor") == f
        latest[f"_on{i}"] = F.when((kind == CALL) & mine & F.col("edge").isNotNull(), F.col("edge") == "started")
        latest[f"_state{i}"] = F.when(is_climate & mine, state)
    rows = scan(rows, ["site_id"], latest=latest, following={"next_ts": F.col("ts")})
    zones = F.lit(0)
    for i in range(len(FLOORS)):
        zones = zones + F.when(F.col(f"_on{i}"), F.lit(2**i)).otherwise(F.lit(0))
    same_day = F.to_date("_outdoor.at") == F.to_date("ts")
    rows = rows.withColumns({"zones": zones, "outdoor_temp_f": F.when(same_day, F.col("_outdoor.temp"))})
    rows = scan(rows, ["site_id", "kind", "visible"], following={"next_of_kind": F.col("ts")})
    # along the floor: the call in progress and the reading in force
    zone = F.when(is_climate | ((kind == CALL) & F.col("edge").isNotNull()), F.col("floor"))
    keys = ["site_id", "zone"]
    rows = scan(
        rows.withColumn("zone", zone),
        keys,
        latest={"seen": F.when(is_climate, F.struct("current_temp", "setpoint")), "_open": F.when(F.col("edge").isNotNull(), F.col("edge") == "started")},
        following={"next_in_zone": F.struct("ts", "edge")},
    )
    start = F.when(F.col("edge") == "started", F.struct("ts", "seq", F.col("seen.current_temp").alias("temp")))
    rows = scan(rows, keys, latest={"_call": start})
    call = F.when((F.col("zone").isNotNull()) & F.col("_open"), F.col("_call"))
    rows = rows.withColumn("call", call).drop("_call", "_open")
    rise = F.when(F.col("edge").isNull() & (F.col("current_temp") > F.col("call.temp")), F.struct("call.ts", "call.seq"))
    rows = scan(rows, keys, latest={"_rise": rise})
    rose = (F.col("_rise.ts") == F.col("call.ts")) & (F.col("_rise.seq") == F.col("call.seq"))
    return rows.withColumn("rose", F.coalesce(rose, F.lit(False))).drop("_rise", *[f"_on{i}" for i in range(len(FLOORS))], *keep_slice(rows))


def without_context(rows: DataFrame) -> DataFrame:
    """The timeline for warnings and day figures: without outdoor readings at each row, zones and states, the scan along the site falls away."""
    lean = rows.drop("_outdoor", "next_ts", *[f"_state{i}" for i in range(len(FLOORS))])
    return lean.withColumns({"outdoor_temp_f": F.lit(None).cast("double"), "zones": F.lit(0)})


def event(name: str, **fields: Column) -> Column:
    """One event of the log; fields that are not given are null."""
    given = {"floor": F.col("floor"), "ts": F.col("ts"), "seq": F.col("seq"), **fields}
    columns = [given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in LOG.items()]
    return F.struct(F.lit(name).alias("event_type"), *columns)


def _warn_at(seconds: Column | float) -> Column:
    return plus_seconds(F.col("call.ts"), seconds)


def _last_before(at: Column) -> Column:
    """This row is the last one of its call up to ``at``, and the call lasts until then."""
    following = F.col("next_in_zone")
    ended_then = following["edge"].isNotNull() & (following["ts"] == at)
    return F.col("call").isNotNull() & (F.col("ts") <= at) & (following.isNull() | (following["ts"] > at) | ended_then)


def row_events(rows: DataFrame, as_of: Column, scale: Mapping, p95: Mapping[str, float], wanted: Collection[str] | None = None) -> DataFrame:
    """The events that a single row of the timeline decides, unfolded from an array per row.

    ``p95`` is the stored duration baseline by floor; ``wanted`` names the events to build (default: all).
    """
    kind, floor, edge = F.col("kind"), F.col("floor"), F.col("edge")
    ended, none = edge == "ended", F.lit(None)
    is_call, is_furnace, is_climate = kind == CALL, kind == FURNACE, (kind == CLIMATE) & F.col("visible")
    duration = seconds_between(F.col("started_at"), F.col("ts"))
    elapsed = seconds_between(F.col("cycle_ts"), F.col("ts"))
    gap = seconds_between(F.col("ts"), F.coalesce("next_of_kind", as_of))
    reading = {c: F.col(c) for c in ("setpoint", "current_temp", "hvac_mode", "hvac_action")}
    inside = is_climate & F.col("in_cycle")
    warmed = {"start_temp": F.col("start_temp"), "setpoint": F.col("setpoint"), "outdoor_temp_f": F.col("outdoor_temp_f")}
    slow_s = by_floor(scale["slow_to_heat_s"])
    slow = inside & F.col("heating") & ~F.col("reached_so_far") & (elapsed >= slow_s)
    first_slow = slow & (F.col("starts") | (seconds_between(F.col("cycle_ts"), F.col("prev_ts")) < slow_s))
    long_at = _warn_at(scale["long_call_s"])
    long_call = _last_before(long_at) & (as_of >= long_at)
    if scale["floors"] is not None:
        long_call = long_call & floor.isin(*scale["floors"])
    silent_s = by_floor(scale["no_response_s"], scale["no_response_default_s"])
    silent_at = _warn_at(silent_s)
    silent = _last_before(silent_at) & (as_of >= silent_at) & F.col("call.temp").isNotNull() & ~F.col("rose")
    limit = F.greatest(by_floor(p95) * 1.5 if p95 else none.cast("double"), by_floor(schema.LONG_SESSION_S, schema.LONG_SESSION_DEFAULT_S).cast("double"))
    short = duration < scale["short_call_s"]
    call_ended = is_call & ended
    of_site = {"floor": none}
    found = {
        schema.FLOOR_CALL_STARTED: (is_call & (edge == "started"), {}),
        schema.FLOOR_CALL_ENDED: (call_ended, {"duration_s": duration}),
        schema.SESSION_STARTED: (is_furnace & (edge == "started"), of_site),
        schema.SESSION_ENDED: (is_furnace & ended, {**of_site, "duration_s": duration, "outdoor_temp_f": F.col("outdoor_temp_f")}),
        schema.OUTDOOR_UPDATED: (F.col("temperature_f").isNotNull(), {**of_site, "temperature_f": F.col("temperature_f")}),
        schema.SETPOINT_CHANGED: (is_climate & F.col("setpoint_changed"), reading),
        schema.TEMP_UPDATED: (is_climate & F.col("temp_changed"), reading),
        schema.MODE_CHANGED: (is_climate & F.col("mode_changed"), reading),
        schema.SETPOINT_REACHED: (is_climate & F.col("reached"), reading),
        schema.TIME_TO_TEMP: (inside & F.col("reached") & F.col("start_temp").isNotNull(), {**warmed, "duration_s": elapsed}),
        schema.SLOW_TO_HEAT: (first_slow, {**warmed, "duration_s": elapsed}),
        schema.LONG_CALL: (long_call, {"ts": long_at, "seq": F.col("call.seq"), "setpoint": F.col("seen.setpoint")}),
        schema.NO_RESPONSE: (silent, {"ts": silent_at, "seq": F.col("call.seq"), "start_temp": F.col("call.temp")}),
        schema.SILENCE: (is_climate & (gap >= scale["silence_s"]), {**of_site, "ts": plus_seconds(F.col("ts"), scale["silence_s"]), "duration_s": gap}),
        schema.SHORT_CALL: (is_furnace & ended & (duration > 0) & short, {**of_site, "duration_s": duration}),
        schema.SHORT_SESSION: (call_ended & short, {"duration_s": duration}),
        schema.LONG_SESSION: (call_ended & ~short & (duration > limit), {"duration_s": duration}),
    }
    events = F.array_compact(F.array(*[F.when(test, event(name, **fields)) for name, (test, fields) in found.items() if wanted is None or name in wanted]))
    if wanted is None or schema.SNAPSHOT in wanted:
        events = F.concat(events, _snapshots(scale["snapshot_s"]))
    return rows.select("site_id", F.inline(events))


def _snapshots(step_s: int) -> Column:
    """Zones with a temperature on the grid ticks from this row of a site up to the next one."""
    step = int(step_s * 1_000_000)
    tick = lambda c: F.ceil(F.unix_micros(c) / F.lit(step)).cast("long")
    last = F.coalesce(tick("next_ts") - 1, tick("ts"))
    ticks = F.when(last >= tick("ts"), F.sequence(tick("ts"), last)).otherwise(F.array().cast("array<bigint>"))

    def zones(t: Column) -> Column:
        at = F.timestamp_micros(t * F.lit(step))
        outdoor = F.when(F.to_date("_outdoor.at") == F.to_date(at), F.col("_outdoor.temp"))
        entries = []
        for i, f in enumerate(FLOORS):
            s = F.col(f"_state{i}")
            values = {c: s[c] for c in ("current_temp", "setpoint", "hvac_action")}
            one = event(schema.SNAPSHOT, floor=F.lit(f), ts=at, seq=F.lit(None), outdoor_temp_f=outdoor, **values)
            entries.append(F.when(s["current_temp"].isNotNull(), one))
        return F.array_compact(F.array(*entries))

    return F.flatten(F.transform(ticks, zones))


def cycle_events(rows: DataFrame) -> DataFrame:
    """Overshoots and missed setpoints: one aggregation by cycle."""
    cycles = thermostat.cycle_summary(rows.filter((F.col("kind") == CLIMATE) & F.col("visible") & F.col("in_cycle")))
    named = {"ts": F.col("ended_at"), "seq": F.col("ended_seq"), "start_temp": F.col("start_temp"), "setpoint": F.col("end_setpoint"), "outdoor_temp_f": F.col("outdoor_temp_f")}
    lasted = lambda since: {"duration_s": seconds_between(F.col(since), F.col("ended_at"))}
    events = F.array(
        F.when(thermostat.reached_and_closed(), event(schema.OVERSHOOT, **named, **lasted("reached_at"))),
        F.when(thermostat.closed_below(), event(schema.SETPOINT_MISS, **named, **lasted("cycle_ts"))),
    )
    return cycles.select("site_id", F.inline(F.array_compact(events)))


def day_facts(rows: DataFrame) -> DataFrame:
    """The timeline as facts of day figures; whatever is no call, session or outdoor reading tells that the day was active."""
    fact = (
        F.when((F.col("edge") == "ended") & (F.col("kind") == CALL), "call")
        .when((F.col("edge") == "ended") & (F.col("kind") == FURNACE), "furnace")
        .when(F.col("temperature_f").isNotNull(), "outdoor")
        .otherwise("day")
    )
    duration = seconds_between(F.col("started_at"), F.col("ts"))
    return rows.select("site_id", F.to_date("ts").alias("date"), fact.alias("fact"), "floor", duration.alias("duration_s"), "temperature_f")


def furnace_days(rows: DataFrame, warnings: DataFrame | None = None, setpoints: DataFrame | None = None) -> DataFrame:
    """The wide day row from the timeline, with warning counts and setpoints where they are given."""
    facts = day_facts(rows)
    if warnings is not None:
        facts = facts.unionByName(warnings.select("site_id", F.to_date("ts").alias("date"), F.lit("warning").alias("fact"), "kind"), allowMissingColumns=True)
    if setpoints is not None:
        facts = facts.unionByName(setpoints.select("site_id", F.to_date("ts").alias("date"), F.lit("setpoint").alias("fact"), "floor", "setpoint"), allowMissingColumns=True)
    return rollups.daily_figures(facts, setpoints=setpoints is not None, warnings=warnings is not None)


def day_events(days: DataFrame) -> DataFrame:
    """Day summaries of floors and furnace, and runtime anomalies, stamped with the end of their day."""
    floors = [F.struct(F.lit(f).alias("floor"), F.col(f"runtime_{f}_s").alias("total_runtime_s"), F.when(F.lit(i == 0), F.col("total_furnace_runtime_s")).alias("furnace_s")) for i, f in enumerate(FLOORS)]
    rows = rules.with_runtime_baseline(days.select("site_id", "date", F.inline(F.array(*floors))), carry=("furnace_s",))
    stamp = {"ts": F.date_add("date", 1).cast("timestamp"), "seq": F.lit(None), "date": F.col("date")}
    runtime = F.col("runtime_s")
    events = F.array(
        event(schema.FLOOR_DAILY, **stamp, duration_s=runtime),
        F.when(F.col("furnace_s").isNotNull(), event(schema.FURNACE_DAILY, **{**stamp, "floor": F.lit(None)}, duration_s=F.col("furnace_s"))),
        F.when(F.col("fired"), event(schema.RUNTIME_ANOMALY, **stamp, duration_s=runtime)),
    )
    return rows.select("site_id", F.inline(F.array_compact(events)))


def escalations(long_calls: DataFrame) -> DataFrame:
    """The second and later long-call warnings of a site's day, as events of their own."""
    again = alarms.long_call_escalations(long_calls).drop("long_call_count_today")
    return again.withColumn("event_type", F.lit(schema.LONG_CALL_ESCALATION))


def derived_log(rows: DataFrame, as_of: Column, scale: Mapping, p95: Mapping[str, float]) -> DataFrame:
    """Every derived event as one log, absent fields null."""
    out = row_events(rows, as_of, scale, p95)
    for part in (escalations(row_events(rows, as_of, scale, {}, [schema.LONG_CALL])), cycle_events(rows), day_events(furnace_days(rows))):
        out = out.unionByName(part)
    return out.select("event_type", "site_id", *LOG)


def sessions(rows: DataFrame) -> DataFrame:
    """The ended floor calls of the timeline."""
    ended = rows.filter((F.col("kind") == CALL) & (F.col("edge") == "ended"))
    return ended.select("site_id", "entity_id", "floor", "ts", "seq", "started_at", seconds_between(F.col("started_at"), F.col("ts")).alias("duration_s"))


def warnings(rows: DataFrame, as_of: Column, scale: Mapping, wanted: Collection[str] = tuple(WARNINGS)) -> DataFrame:
    """``site_id, kind, ts, seq, floor`` of the warnings of the given event types."""
    out = row_events(rows, as_of, scale, {}, wanted)
    if schema.LONG_CALL_ESCALATION in wanted:
        out = out.unionByName(escalations(row_events(rows, as_of, scale, {}, [schema.LONG_CALL])))
    if schema.SETPOINT_MISS in wanted:
        out = out.unionByName(cycle_events(rows).filter(F.col("event_type") == schema.SETPOINT_MISS))
    names = F.create_map(*[F.lit(x) for pair in WARNINGS.items() for x in pair])
    return out.select("site_id", names[F.col("event_type")].alias("kind"), "ts", "seq", "floor")

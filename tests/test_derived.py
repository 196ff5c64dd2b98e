"""The derived log from the fused scan: its events, its plan, and its store."""

import re
from datetime import datetime, timedelta

import pytest
from conftest import CALLS, FURNACE, OUTDOOR, STATS, at, clock, dicts, golden_day
from pyspark.sql import functions as F

from emberline import schema
from emberline.operators import alarms, edges, rules, thermostat
from emberline.plans import derived
from emberline.plans.fleet import Fleet
from emberline.plans.queries import AS_OF, SCALE
from emberline.sources import event_table, sinks
from emberline.sources.event_table import all_observations, observations, read_events

EVENTS = "/root/testdata/sf0.001/events.parquet"
REAL = {
    "long_call_s": schema.LONG_CALL_S,
    "floors": ("floor_2",),
    "silence_s": schema.SILENCE_S,
    "short_call_s": schema.SHORT_SESSION_S,
    "no_response_s": schema.NO_RESPONSE_S,
    "no_response_default_s": schema.NO_RESPONSE_DEFAULT_S,
    "slow_to_heat_s": schema.SLOW_TO_HEAT_S,
    "snapshot_s": schema.SNAPSHOT_INTERVAL_S,
}


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans_and_exchanges(df):
    plan = executed(df)
    return len(re.findall(r"FileScan", plan)), len(re.findall(r"(?<!Reused)Exchange ", plan))


def log_of(obs, as_of="24:00", scale=REAL, p95=None):
    end = at(as_of) if as_of != "24:00" else F.lit("2024-01-16 00:00:00").cast("timestamp")
    return derived.derived_log(derived.timeline(obs), end, scale, p95 or {})


def events(log, kind, *columns):
    return [tuple(r[c] for c in columns) for r in dicts(log.filter(F.col("event_type") == kind), "ts", "seq", "floor")]


def test_golden_day(observe):
    log = log_of(observe(*golden_day())).cache()
    assert events(log, schema.SESSION_ENDED, "duration_s", "outdoor_temp_f") == [(2400, None), (3600, 48.5), (18000, 38.0)]
    assert events(log, schema.FLOOR_DAILY, "floor", "duration_s") == [("floor_1", 900), ("floor_2", 6000), ("floor_3", 1800)]
    assert events(log, schema.FURNACE_DAILY, "floor", "duration_s") == [(None, 24000)]
    assert events(log, schema.LONG_CALL, "floor", "ts") == [("floor_2", clock("17:50"))]
    assert len(events(log, schema.FLOOR_CALL_STARTED, "ts")) == len(events(log, schema.FLOOR_CALL_ENDED, "ts")) == 7
    assert events(log, schema.LONG_SESSION, "floor", "duration_s") == [("floor_2", 4200)]
    log.unpersist()


def heating(floor, *readings, action="heating"):
    return [(t, STATS[floor], "heat", "heat", (sp, temp, a)) for t, sp, temp, a in readings]


def test_alarms_match_their_operators(observe):
    """Calls with readings at, before and after the moment of a warning; a rise in temperature; an end at that very moment."""
    rows = [("06:00", CALLS[2], "off", "on"), ("06:50", CALLS[2], "on", "off"), ("08:00", CALLS[2], "off", "on"), ("08:45", CALLS[2], "on", "off"), ("10:00", CALLS[2], "off", "on")]
    rows += [("07:00", CALLS[1], "off", "on"), ("07:10", CALLS[1], "on", "off"), ("09:00", CALLS[1], "off", "on"), ("12:00", CALLS[3], "off", "on"), ("12:06", CALLS[3], "on", "off")]
    rows += heating(2, ("05:50", 70.0, 65.0, "idle"), ("06:30", 71.0, 66.0, "heating"), ("06:45", 72.0, 67.0, "heating"), ("06:46", 73.0, 68.0, "heating"), ("08:45", 74.0, 60.0, "idle"))
    rows += heating(1, ("06:55", 70.0, 64.0, "idle"), ("07:05", 70.0, 64.5, "idle"), ("08:59", 70.0, 63.0, "idle"), ("09:05", 70.0, 62.0, "idle"))
    obs = observe(*sorted(rows, key=lambda r: clock(r[0])))
    log = log_of(obs).cache()
    end = F.lit("2024-01-16 00:00:00").cast("timestamp")
    on_off, climate = edges.edges(obs, schema.CALL), thermostat.climate_rows(obs)
    long_calls = alarms.long_calls(on_off, climate, end)
    assert events(log, schema.LONG_CALL, "ts", "seq", "setpoint") == [tuple(r) for r in long_calls.orderBy("ts").select("ts", "seq", "setpoint").collect()]
    assert [x[2] for x in events(log, schema.LONG_CALL, "ts", "seq", "setpoint")] == [72.0, 73.0, 74.0]
    assert events(log, schema.LONG_CALL_ESCALATION, "ts") == [tuple(r) for r in alarms.long_call_escalations(long_calls).orderBy("ts").select("ts").collect()]
    silent = alarms.floor_no_response(on_off, climate, end)
    got = events(log, schema.NO_RESPONSE, "floor", "ts", "seq", "start_temp")
    assert got == [tuple(r) for r in silent.orderBy("ts", "seq").select("floor", "ts", "seq", "start_temp").collect()]
    assert [x[0] for x in got] == ["floor_2", "floor_2", "floor_1", "floor_2"] and len(got) == 4
    gaps = alarms.silence_gaps(climate, end, schema.SILENCE_S)
    assert events(log, schema.SILENCE, "ts", "seq", "duration_s") == [tuple(r) for r in gaps.orderBy("ts", "seq").select("ts", "seq", "gap_s").collect()]
    log.unpersist()


def test_cycles_match_their_operators(observe):
    rows = heating(1, ("06:00", 70.0, 65.0, "heating"), ("06:20", 70.0, 68.0, "heating"), ("06:40", 70.0, 70.5, "heating"), ("06:50", 70.0, 71.0, "heating"), ("07:00", 70.0, 70.8, "idle"))
    rows += heating(3, ("06:05", 72.0, 64.0, "heating"), ("06:30", 72.0, 66.0, "heating"), ("06:35", 71.0, 66.0, "heating"), ("08:00", 71.0, 67.0, "idle"))
    rows += heating(1, ("09:00", None, None, None), ("09:10", 70.0, 69.0, "heating"))
    rows += [("06:10", OUTDOOR, None, "30.5"), ("06:01", CALLS[2], "off", "on"), ("07:30", CALLS[2], "on", "off")]
    obs = observe(*sorted(rows, key=lambda r: clock(r[0])))
    log = log_of(obs).cache()
    climate = thermostat.climate_rows(obs)
    cycles = thermostat.heating_cycles(climate.withColumns({"outdoor_temp_f": F.lit(30.5), "zones": F.lit(0)}))
    over, miss = thermostat.overshoot(cycles), thermostat.setpoint_miss(cycles)
    assert events(log, schema.OVERSHOOT, "floor", "ts", "seq", "duration_s", "outdoor_temp_f") == [tuple(r) for r in over.select("floor", "ended_at", "seq", "overshoot_s", "outdoor_temp_f").collect()]
    assert events(log, schema.SETPOINT_MISS, "floor", "ts", "seq", "duration_s", "outdoor_temp_f") == [tuple(r) for r in miss.select("floor", "ended_at", "seq", "duration_s", "outdoor_temp_f").collect()]
    assert len(events(log, schema.OVERSHOOT, "ts")) == len(events(log, schema.SETPOINT_MISS, "ts")) == 1
    slow = thermostat.slow_to_heat(climate)
    assert events(log, schema.SLOW_TO_HEAT, "floor", "ts", "duration_s") == [tuple(r) for r in slow.orderBy("ts").select("floor", "ts", "elapsed_s").collect()]
    assert events(log, schema.TIME_TO_TEMP, "floor", "duration_s", "outdoor_temp_f") == [("floor_1", 2400, 30.5)]
    log.unpersist()


def test_snapshots_fill_the_grid(observe):
    obs = observe(*heating(1, ("06:02", 70.0, 65.0, "heating"), ("06:14", 70.0, 66.0, "idle")), *heating(2, ("06:16", 68.0, None, "idle")))
    got = events(log_of(obs), schema.SNAPSHOT, "floor", "ts", "current_temp")
    assert got == [("floor_1", clock(t), temp) for t, temp in (("06:05", 65.0), ("06:10", 65.0), ("06:15", 66.0), ("06:20", 66.0))]


def test_session_anomalies_follow_the_stored_baseline(spark):
    calls = [(i, 1000 * i, 1000 * i + d) for i, d in enumerate((60, 900, 2000, 4000))]
    start = datetime(2024, 1, 15)
    rows = []
    for i, on, off in calls:
        rows += [(1, 2 * i, start + timedelta(seconds=10 * on), CALLS[1], "off", "on"), (1, 2 * i + 1, start + timedelta(seconds=10 * on + off - on), CALLS[1], "on", "off")]
    raw = spark.createDataFrame([(*r, None) for r in rows], "site_id long, seq long, ts timestamp, entity_id string, old_state string, new_state string, attributes struct<temperature:double,current_temperature:double,hvac_action:string>")
    rows = derived.timeline(edges.entity_lookup(raw))
    log = derived.row_events(rows, at("23:00"), REAL, {"floor_1": 2000.0})
    assert events(log, schema.SHORT_SESSION, "duration_s") == [(60,)] and events(log, schema.LONG_SESSION, "duration_s") == [(4000,)]
    found = rules.session_duration_anomaly(derived.sessions(rows), spark.createDataFrame([("floor_1", 2000.0)], "key string, p95 double"), short_s=schema.SHORT_SESSION_S)
    assert {(r["finding"], r["duration_s"]) for r in found.collect()} == {("short", 60), ("long", 4000)}


def test_one_scan_of_the_events_and_few_exchanges(spark, tmp_path):
    fleet = Fleet(read_events(spark, EVENTS))
    as_of = F.lit(AS_OF).cast("timestamp")
    build = derived.timeline(all_observations(fleet.events), look_up_old=True)
    assert scans_and_exchanges(build) == (1, 1)
    log = fleet.derived_log(as_of, SCALE)
    scans, exchanges = scans_and_exchanges(log)
    assert scans <= 4 and exchanges <= 4
    days = derived.furnace_days(fleet.timeline, fleet.warnings(as_of, SCALE))
    scans, exchanges = scans_and_exchanges(days)
    assert scans <= 4 and exchanges <= 3
    sinks.write_derived(log, str(tmp_path / "log"))
    back = spark.read.parquet(str(tmp_path / "log"))
    assert back.drop("event_date").select(*sorted(log.columns)).exceptAll(log.select(*sorted(log.columns))).count() == 0 and back.count() == log.count()
    assert {r[0] for r in back.select("event_type").distinct().collect()} >= {schema.SHORT_SESSION, schema.LONG_SESSION, schema.SNAPSHOT, schema.OVERSHOOT}


@pytest.mark.parametrize("kind", [schema.CALL, schema.FURNACE, schema.OUTDOOR, schema.CLIMATE])
def test_all_observations_are_those_of_each_kind(spark, kind):
    events_ = read_events(spark, EVENTS)
    fused = all_observations(events_).filter(F.col("kind") == kind)
    own = observations(events_, kind, old_state=False)
    assert fused.select(*own.columns).exceptAll(own).count() == 0 and fused.count() == own.count()


def test_sliced_timelines_give_the_same_log(spark, monkeypatch):
    plain = Fleet(read_events(spark, EVENTS)).derived_log(F.lit(AS_OF).cast("timestamp"), SCALE)
    monkeypatch.setattr(event_table, "_SLICES", {})
    events_ = read_events(spark, EVENTS).withColumn("site_id", F.col("site_id") % 2)
    from emberline.functions.timeline import measure_slices, with_slices

    cut = with_slices(events_, measure_slices(events_, rows_per_slice=60))
    assert "_slice" in cut.columns and plain.count() > 0
    logs = [Fleet(e).derived_log(F.lit(AS_OF).cast("timestamp"), SCALE) for e in (events_, cut)]
    assert logs[0].exceptAll(logs[1]).count() == 0 and logs[0].count() == logs[1].count()


def test_tasks_of_the_scan_follow_the_rows(spark, monkeypatch):
    from emberline.plans import fleet as fleets

    plain = Fleet(read_events(spark, EVENTS))
    want = plain.fused().select("site_id", "kind", "seq", "edge", "started_at", "zones")
    monkeypatch.setattr(fleets, "ROWS_PER_SCAN_TASK", 200)
    fleet = Fleet(read_events(spark, EVENTS))
    fused = fleet.fused()
    assert scans_and_exchanges(fused) == (1, 1)
    tasks = int(re.search(r"hashpartitioning\(site_id#\d+L?, (\d+)\)", executed(fused)).group(1))
    assert tasks == fleet.scan_tasks == 4 * spark.read.parquet(EVENTS).count() // 200 > plain.scan_tasks
    got = fused.select(*want.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()

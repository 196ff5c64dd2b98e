"""Bounded order, late rows, clock timers, seeded replays, closed days, and tables that a repeated batch leaves as they are."""

import os
import time
from datetime import datetime, timedelta, timezone

import pytest
from conftest import CALLS, FURNACE, OUTDOOR, STATS, dicts
from pyspark.sql import functions as F
from test_streaming import RAW, T0, history, run, stream, write_file

from emberline.operators import alarms, edges, gauges, replay, rollups, thermostat
from emberline.operators.edges import entity_lookup
from emberline.sources.scratch import scratch_path
from emberline.streaming import jobs, tables
from emberline.streaming.ordered import late_rows, on_time, process, use_state_store
from emberline.streaming.processors import OrderProcessor


@pytest.fixture(scope="module")
def far():
    return (99, 10_000, T0 + timedelta(days=30), CALLS[1], "off", "off", None)


def test_one_chunk_of_a_key_in_memory(spark, tmp_path, far):
    class Watched(OrderProcessor):
        """Tells with every row how many rows ``step`` was handed at once; defined here, so that workers get it by value."""

        output = (("us", "bigint"), ("seq", "bigint"), ("together", "bigint"))

        def step(self, key, rows):
            return [(*r, len(rows)) for r in rows]

    folder = str(tmp_path / "obs")
    rows = [(1, i, T0 + timedelta(seconds=i), CALLS[1], "off", "on", None) for i in range(900)]
    write_file(spark, folder, 0, rows[::-1])
    write_file(spark, folder, 1, [far])
    watched = process(stream(spark, folder), ["site_id"], Watched(True, chunk_us=60_000_000), "1 hour")
    got = dicts(on_time(run(spark, watched)).filter("site_id = 1"), "us")
    assert [r["seq"] for r in got] == list(range(900)) and max(r["together"] for r in got) == 60


def test_late_rows_are_set_aside_and_none_is_lost(spark, tmp_path, far):
    folder = str(tmp_path / "obs")
    early = [(1, i, T0 + timedelta(minutes=i), CALLS[1], "off", "on", None) for i in range(120)]
    write_file(spark, folder, 0, [r for r in early if r[1] % 10])
    write_file(spark, folder, 1, [(1, 200, T0 + timedelta(hours=9), CALLS[1], "on", "off", None)])
    write_file(spark, folder, 2, [r for r in early if r[1] % 10 == 0])
    write_file(spark, folder, 3, [far])
    out = run(spark, jobs.stream_in_order(stream(spark, folder), "1 hour", grace="60 days")).cache()
    kept, late = on_time(out).filter("site_id = 1"), late_rows(out, ["site_id", "entity_id"])
    assert sorted(r["seq"] for r in late.collect()) == list(range(0, 120, 10))
    assert late.filter(F.timestamp_micros("us") == F.lit(T0.replace(tzinfo=None)).cast("timestamp")).count() == 1
    assert sorted([r["seq"] for r in kept.collect()] + [r["seq"] for r in late.collect()]) == [*range(120), 200]


def test_alarms_on_the_clock_need_no_row_and_no_watermark(spark, tmp_path):
    folder, work = str(tmp_path / "obs"), scratch_path(spark, "live")
    use_state_store(spark)
    now = datetime.now(timezone.utc)
    write_file(spark, folder, 0, [(1, 1, now, CALLS[2], "off", "on", None)])
    live = jobs.stream_alarms(stream(spark, folder), live=True, long_call_s=2, silence_s=4, no_response_s={}, no_response_default_s=3600)
    query = live.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/checkpoint").trigger(processingTime="1 second").start()
    try:
        until, got = time.time() + 60, []
        while len(got) < 2 and time.time() < until:
            time.sleep(1)
            if os.path.isdir(f"{work}/out/_spark_metadata"):
                got = [(r["kind"], r["us"] - r["since"]) for r in spark.read.schema(live.schema).parquet(f"{work}/out").collect()]
    finally:
        query.stop()
    assert sorted(got) == [("floor_2_long_call", 2_000_000), ("observer_silence", 4_000_000)]


def house(n=400, seed=5):
    """One more site with furnace and outdoor readings beside the sensors of ``history``."""
    rows = history(n, seed)
    state = "off"
    for i in range(0, n, 5):
        ts = T0 + timedelta(minutes=4 * i + 1, microseconds=i)
        new = "on" if state == "off" else "off"
        rows.append((1 + i % 2, 20_000 + i, ts, FURNACE, state, new, None))
        state = new
        rows.append((1 + i % 2, 40_000 + i, ts + timedelta(seconds=9), OUTDOOR, None, "unavailable" if i % 15 == 0 else f"{30 + i % 7}.25", None))
    return rows


@pytest.fixture(scope="module")
def observed(spark):
    rows = house()
    # furnace states alternate per site
    state, fixed = {}, []
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        if r[3] == FURNACE:
            old = state.get(r[0], "off")
            r = (*r[:4], old, "on" if old == "off" else "off", None)
            state[r[0]] = r[5]
        fixed.append(r)
    return fixed


@pytest.fixture(scope="module")
def feed(spark, observed, tmp_path_factory, far):
    folder = str(tmp_path_factory.mktemp("in") / "house")
    for n in range(3):
        write_file(spark, folder, n, observed[n::3])
    write_file(spark, folder, 3, [far])
    return folder


def test_closed_days_equal_the_batch_summaries(spark, observed, feed):
    days = on_time(run(spark, jobs.stream_days(stream(spark, feed), "3 days"))).filter("site_id < 99").cache()
    obs = entity_lookup(spark.createDataFrame(observed, RAW))
    calls, furnace, outdoor = edges.floor_calls(obs), edges.furnace_calls(obs), edges.outdoor_readings(obs)
    active = rollups.active_days(obs)
    setpoints = rollups.setpoint_samples(obs.filter("kind = 'climate'"))
    want = rollups.furnace_daily_summary(furnace, calls, outdoor, active, setpoints)
    got = jobs.furnace_days(days)
    assert sorted(got.columns) == sorted(want.columns)
    assert dicts(got.select(*want.columns), "site_id", "date") == dicts(want, "site_id", "date")
    floors = rollups.floor_daily_summary(calls, outdoor, active)
    assert dicts(jobs.floor_days(days).select(*floors.columns), "site_id", "date", "floor") == dicts(floors, "site_id", "date", "floor")
    assert {r["date"].isoformat() for r in want.collect()} == {"2024-01-01", "2024-01-02"}


def test_all_gauges_equal_the_batch_view(spark, observed, feed):
    samples = on_time(jobs.stream_gauges(stream(spark, feed), "3 days")).withColumn("ts", F.timestamp_micros("us"))
    work = scratch_path(spark, "all-gauges")
    use_state_store(spark)
    jobs.upsert_gauges(samples, f"{work}/table", f"{work}/checkpoint")
    obs = entity_lookup(spark.createDataFrame(observed, RAW))
    furnace_edges, on_off = edges.edges(obs, "furnace"), edges.edges(obs, "call")
    batch = gauges.gauge_samples(on_off, furnace_edges, edges.sessions(furnace_edges), thermostat.changes(thermostat.climate_rows(obs)), edges.outdoor_readings(obs))
    want = gauges.latest_gauges(batch)
    got = jobs.read_gauges(spark, f"{work}/table").filter("site_id < 99")
    order = ("site_id", "metric", "floor")
    assert dicts(got.select(*want.columns), *order) == dicts(want, *order)
    assert {r["metric"] for r in want.collect()} == {"floor_call_active", "furnace_active", "heating_session_duration_s", "floor_temperature_f", "floor_setpoint_f", "outdoor_temperature_f"}


@pytest.mark.parametrize("hours", [5, 13])
def test_replay_from_a_seed_equals_the_whole_run(spark, observed, feed, tmp_path, far, hours):
    start = T0 + timedelta(hours=hours)
    folder = str(tmp_path / "rest")
    rest = [r for r in observed if r[2] >= start]
    for n in range(2):
        write_file(spark, folder, n, rest[n::2])
    write_file(spark, folder, 2, [far])
    obs = entity_lookup(spark.createDataFrame(observed, RAW))
    begin = F.lit(start.replace(tzinfo=None)).cast("timestamp")
    since = int(start.timestamp() * 1_000_000)

    def both(build, seed, order):
        whole = on_time(run(spark, build(stream(spark, feed), None))).filter((F.col("site_id") < 99) & (F.col("us") >= since))
        part = on_time(run(spark, build(stream(spark, folder), seed))).filter("site_id < 99")
        return dicts(part.filter(F.col("us") >= since), *order), dicts(whole, *order)

    got, want = both(lambda rows, seed: jobs.stream_calls(rows, "3 days", True, seed), replay.seed_calls(obs, begin), ("site_id", "entity_id", "us"))
    assert got == want and want
    got, want = both(lambda rows, seed: jobs.stream_cycles(rows, "3 days", True, seed), replay.seed_cycles(obs, begin), ("site_id", "us", "seq", "event_type"))
    assert got == want and {r["event_type"] for r in want} >= {"zone_overshoot", "zone_setpoint_miss", "thermostat_setpoint_changed"}
    got, want = both(lambda rows, seed: jobs.stream_alarms(rows, "3 days", True, seed, floors=None), replay.seed_alarms(obs, begin), ("site_id", "us", "kind", "floor"))
    assert [r for r in got if r["us"] > since] == [r for r in want if r["us"] > since] and want


EVENTS = "site_id long, seq long, event_type string, value double"


def test_a_killed_batch_and_a_run_begun_anew_leave_no_double_row(spark, tmp_path, monkeypatch):
    table = tables.event_table(str(tmp_path / "events"), EVENTS, buckets=4)
    first = spark.createDataFrame([(s, i, "a", 1.0) for s in range(6) for i in range(3)], EVENTS)
    second = spark.createDataFrame([(s, i, "a", 1.0) for s in range(3) for i in range(2, 5)] + [(1, 4, "b", 2.0), (1, 4, "b", 2.0)], EVENTS)
    table.apply(first, 0, "run")
    write = table._write

    def killed(*args):
        write(*args)
        raise RuntimeError("the driver is gone")

    monkeypatch.setattr(table, "_write", killed)
    with pytest.raises(RuntimeError):
        table.apply(second, 1, "run")
    assert table.read(spark).count() == 18  # nothing of it shows
    monkeypatch.setattr(table, "_write", write)
    table.apply(second, 1, "run")
    assert table.apply(second, 1, "run") == []  # committed already
    want = sorted({(s, i, "a") for s in range(6) for i in range(3)} | {(s, i, "a") for s in range(3) for i in range(5)} | {(1, 4, "b")})
    rows = lambda: sorted((r["site_id"], r["seq"], r["event_type"]) for r in table.read(spark).collect())
    assert rows() == want
    for n, batch in enumerate((first, second, spark.createDataFrame([], EVENTS))):
        table.apply(batch, n, "anew")
    assert rows() == want


def test_a_batch_of_one_site_rewrites_one_bucket(spark, tmp_path):
    table = tables.gauge_table(str(tmp_path / "gauges"), buckets=8)
    shape = "site_id bigint, metric string, floor string, value double, seq bigint, ts timestamp"
    at = lambda minute: datetime(2024, 1, 1, 0, minute)
    table.apply(spark.createDataFrame([(s, "m", None, float(s), 1, at(1)) for s in range(40)], shape), 0, "run")
    before = table.last(spark)[1]
    assert len(before) == 8
    touched = table.apply(spark.createDataFrame([(7, "m", None, 70.0, 2, at(2)), (7, "m", None, 71.0, 3, at(2)), (7, "m", "floor_1", 1.0, 1, at(0)), (7, "m", None, 5.0, 0, at(0))], shape), 1, "run")
    after = table.last(spark)[1]
    assert len(touched) == 1 and [b for b in after if after[b] != before[b]] == touched
    values = {(r["site_id"], r["floor"]): r["value"] for r in table.read(spark).collect()}
    assert values == {**{(s, None): float(s) for s in range(40)}, (7, None): 71.0, (7, "floor_1"): 1.0}

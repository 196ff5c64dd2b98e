"""Streams equal the batch operators: files out of order, stop and restart, timers without input, late rows."""

import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from conftest import CALLS, STATS, dicts
from emberline.operators import alarms, edges, thermostat
from emberline.operators.edges import entity_lookup
from emberline.sources.scratch import scratch_path
from emberline.streaming import jobs
from emberline.streaming.ordered import micros, run_available, use_state_store

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
RAW = "site_id bigint, seq bigint, ts timestamp, entity_id string, old_state string, new_state string, attributes struct<temperature:double,current_temperature:double,hvac_action:string>"


def history(n=240, seed=11):
    """Two sites, calls of three floors and readings of one thermostat, a few minutes apart."""
    rng, rows, state = random.Random(seed), [], {}
    for i in range(n):
        site, ts = 1 + i % 2, T0 + timedelta(minutes=4 * i, microseconds=i)
        if rng.random() < 0.5:
            entity = CALLS[rng.randrange(1, 4)]
            old = state.get((site, entity), "off")
            new = rng.choice(["on", "off"])
            state[(site, entity)] = new
            rows.append((site, i, ts, entity, old, new, None))
        else:
            reading = (float(rng.choice([68, 70])), float(rng.randrange(64, 73)), rng.choice(["heating", "heating", "idle"]))
            rows.append((site, i, ts, STATS[1], None, "heat", reading))
    return rows


@pytest.fixture(scope="module")
def rows():
    return history()


def write_file(spark, folder, number, rows):
    """One parquet file per micro-batch, in arrival order."""
    part = f"{folder}-{number}"
    spark.createDataFrame(rows, RAW).coalesce(1).write.parquet(part)
    name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
    os.makedirs(folder, exist_ok=True)
    target = f"{folder}/{number:03d}.parquet"
    with open(f"{part}/{name}", "rb") as src, open(target, "wb") as dst:
        dst.write(src.read())
    os.utime(target, (1_700_000_000 + number * 10,) * 2)


def stream(spark, folder):
    source = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(folder)
    return entity_lookup(source)


def run(spark, df, *times):
    use_state_store(spark)
    work = scratch_path(spark, "stream")
    run_available(df, f"{work}/out", f"{work}/checkpoint")
    return micros(spark.read.parquet(f"{work}/out"), *times)


@pytest.fixture(scope="module")
def shuffled(spark, rows, tmp_path_factory):
    """Five files; rows are displaced by up to half an hour, so neighbouring files overlap. A last row far in the
    future moves the watermark past the history."""
    folder = str(tmp_path_factory.mktemp("in") / "obs")
    rng = random.Random(1)
    order = sorted(rows, key=lambda r: r[2] + timedelta(minutes=rng.uniform(0, 30)))
    size = len(order) // 5
    for n in range(5):
        write_file(spark, folder, n, order[n * size : (n + 1) * size])
    write_file(spark, folder, 5, [(99, 10_000, T0 + timedelta(days=30), CALLS[1], "off", "off", None)])
    return folder


def test_files_out_of_order_give_batch_calls(spark, rows, shuffled):
    got = run(spark, jobs.stream_calls(stream(spark, shuffled), "1 hour", buffered=True), "us", "started_at")
    want = edges.floor_calls(entity_lookup(spark.createDataFrame(rows, RAW)))
    cols = ["site_id", "floor", "ts", "started_at", "duration_s"]
    assert dicts(got.select(*cols), *cols) == dicts(want.select(*cols), *cols)
    assert want.count() > 20


def test_files_out_of_order_give_batch_cycles(spark, rows, shuffled):
    got = run(spark, jobs.stream_cycles(stream(spark, shuffled), "1 hour", buffered=True), "us")
    batch = thermostat.climate_rows(entity_lookup(spark.createDataFrame(rows, RAW)))
    cycles = thermostat.heating_cycles(batch.withColumns({"outdoor_temp_f": F.lit(None).cast("double"), "zones": F.lit(0)}))
    for event, table in (("zone_overshoot", thermostat.overshoot(cycles)), ("zone_setpoint_miss", thermostat.setpoint_miss(cycles))):
        mine = [(r["site_id"], r["ts"]) for r in dicts(got.filter(F.col("event_type") == event), "site_id", "ts")]
        assert mine == [(r["site_id"], r["ended_at"]) for r in dicts(table, "site_id", "ended_at")]
        assert mine
    slow = dicts(thermostat.slow_to_heat(batch), "site_id", "ts")
    mine = dicts(got.filter("event_type = 'zone_slow_to_heat_warning'"), "site_id", "ts")
    assert [(r["site_id"], r["ts"], r["duration_s"]) for r in mine] == [(r["site_id"], r["ts"], r["elapsed_s"]) for r in slow]


def test_alarms_equal_batch_and_fire_without_input(spark, rows, shuffled):
    got = run(spark, jobs.stream_alarms(stream(spark, shuffled), "1 hour", buffered=True, floors=None), "us", "since")
    obs = entity_lookup(spark.createDataFrame(rows, RAW))
    end = F.lit((T0 + timedelta(days=29)).replace(tzinfo=None).isoformat(" ")).cast("timestamp")
    on_off, climate = edges.edges(obs), thermostat.climate_rows(obs)
    want = alarms.warnings_log(
        {
            "floor_2_long_call": alarms.long_calls(on_off, climate, end, floors=None),
            "floor_no_response": alarms.floor_no_response(on_off, climate, end),
            "observer_silence": alarms.silence_gaps(obs, end),
        }
    )
    key = lambda df: sorted((r.site_id, r.kind, r.floor or "", r.ts) for r in df.filter("site_id < 99").collect())
    assert key(got) == key(want)
    tail = {r.site_id for r in got.filter("kind = 'observer_silence'").collect()}
    assert {1, 2} <= tail


def test_restart_equals_single_run(spark, rows, tmp_path):
    folder, work = str(tmp_path / "obs"), scratch_path(spark, "restart")
    use_state_store(spark)
    for n, part in enumerate((rows[:100], rows[100:])):
        write_file(spark, folder, n, part)
        run_available(jobs.stream_calls(stream(spark, folder)), f"{work}/out", f"{work}/checkpoint")
    want = edges.floor_calls(entity_lookup(spark.createDataFrame(rows, RAW))).select("site_id", "seq", "duration_s")
    got = spark.read.parquet(f"{work}/out").select("site_id", "seq", "duration_s")
    assert dicts(got, "seq") == dicts(want, "seq")


def test_daily_drops_late_and_repeated_calls(spark, tmp_path):
    schema = "site_id bigint, entity_id string, floor string, seq bigint, ts timestamp, duration_s bigint"
    day = lambda d, h=12: T0 + timedelta(days=d, hours=h)
    batches = [
        [(1, "e", "floor_1", 1, day(0), 60), (1, "e", "floor_1", 1, day(0), 60), (1, "e", "floor_1", 2, day(0, 13), None)],
        [(1, "e", "floor_1", 3, day(5), 30)],
        # chained stateful operators judge lateness by the watermark of the batch before
        [(1, "e", "floor_2", 6, day(5), 40)],
        [(1, "e", "floor_1", 4, day(0, 14), 999)],
        [(1, "e", "floor_1", 5, day(9), 10)],
    ]
    folder = str(tmp_path / "calls")
    for n, rows in enumerate(batches):
        part = f"{folder}-{n}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        os.makedirs(folder, exist_ok=True)
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        with open(f"{part}/{name}", "rb") as src, open(f"{folder}/{n}.parquet", "wb") as dst:
            dst.write(src.read())
        os.utime(f"{folder}/{n}.parquet", (1_700_000_000 + n * 10,) * 2)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = dicts(run(spark, jobs.stream_daily(source)), "date", "floor")
    assert [(str(r["date"]), r["total_calls"], r["total_runtime_s"], r["max_duration_s"]) for r in got] == [("2024-01-01", 2, 60, 60), ("2024-01-06", 1, 30, 30), ("2024-01-06", 1, 40, 40)]


def test_gauge_table_keeps_the_latest_over_batches(spark, rows, tmp_path):
    folder, work = str(tmp_path / "obs"), scratch_path(spark, "gauges")
    for n in range(3):
        write_file(spark, folder, n, rows[n * 80 : (n + 1) * 80])
    jobs.upsert_gauges(jobs.live_samples(stream(spark, folder).filter("kind = 'climate'")), f"{work}/table", f"{work}/checkpoint")
    got = {(r.site_id, r.metric): r.value for r in jobs.read_gauges(spark, f"{work}/table").collect()}
    for site in (1, 2):
        last = [r for r in rows if r[0] == site and r[6]][-1][6]
        assert (got[(site, "floor_setpoint_f")], got[(site, "floor_temperature_f")]) == last[:2]

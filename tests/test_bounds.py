"""Windows that end at ``as_of``, odd numbers, repeated summaries, idle sites, microseconds and null alert keys."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberline.functions.scalars import mean, numeric_state
from emberline.operators import alarms, comparisons, rollups, rules
from emberline.plans import context
from emberline.schema import SESSION_ENDED, SILENCE, WARNING_LABELS
from emberline.sources import sinks

NOON = datetime(2024, 1, 20, 12)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_numbers(spark):
    texts = ["72.5", " -3 ", "+.5", "1e3", "5.", "nan", "inf", "-Infinity", "1e999", "5d", "2f", "0x1p3", "1_0", "", " ", "unknown", "unavailable", None, "1 2"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(numeric_state(F.col("s"))).collect()]
    assert got == [72.5, -3.0, 0.5, 1000.0, 5.0] + [None] * 14


def test_mean_takes_any_finite_number(spark):
    df = spark.createDataFrame([(1, 1.5), (1, 2.5), (1, None), (2, 1e300), (2, 1e300), (3, None), (4, 8e12), (4, 8e12)], "k int, v double")
    assert rows_of(df.groupBy("k").agg(mean(F.col("v")).alias("m")), "k", "m") == [(1, 2.0), (2, 1e300), (3, None), (4, 8e12)]


def test_windows_end_at_as_of(spark):
    times = [NOON + timedelta(hours=h) for h in (-80, -72, -1, 0, 1)]
    log = spark.createDataFrame([(e, 1, t, None) for e in (SESSION_ENDED, SILENCE, "floor_call_ended") for t in times], "event_type string, site_id long, ts timestamp, date date")
    as_of = F.lit(NOON)
    assert context.context_events(log, as_of, 72).groupBy("event_type").count().orderBy("event_type").collect() == [(SESSION_ENDED, 3), (SILENCE, 3)]
    assert context.recent_warnings(log, as_of, 72).count() == 3 and len(WARNING_LABELS) == 5
    gains = spark.createDataFrame([(1, "floor_1", t, 600.0, 2.0) for t in times], "site_id long, floor string, ts timestamp, duration_s double, temp_delta_f double")
    assert rules.heating_efficiency(gains, as_of, min_sessions=1).first()["session_count"] == 4


@pytest.mark.parametrize("parts", [1, 3])
def test_throttle_with_null_and_large_keys(spark, parts):
    big = 2**53 + 1
    alerts = [(None, "a", 0, 1), (None, "a", 5, 2), (None, "a", 10, 3), (big, "a", 1, 4), (big, None, 2, 5), (big, "a", 9, 6), (big, "a", 11, 7), (big - 1, "a", 3, 8)]
    df = spark.createDataFrame([(s, k, datetime(2024, 1, 1) + timedelta(seconds=t), q) for s, k, t, q in alerts], "site_id long, kind string, ts timestamp, seq long").repartition(parts)
    got = rows_of(alarms.throttle(df, interval_s=10), "seq", "site_id", "kind", "sent", "suppressed_before")
    assert got == [
        (1, None, "a", True, 0), (2, None, "a", False, 0), (3, None, "a", True, 1), (4, big, "a", True, 0), (5, big, None, True, 0),
        (6, big, "a", False, 0), (7, big, "a", True, 1), (8, big - 1, "a", True, 0),
    ]


def test_throttle_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = spark.range(200).select((F.col("id") % 2).alias("site_id"), F.lit("k").alias("kind"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"))
        sent = [r["seq"] for r in alarms.throttle(df, interval_s=31).filter("sent").orderBy("seq").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for site in (0, 1):
        last = None
        for i in range(site, 200, 2):
            if last is None or i - last >= 31:
                want.append(i)
                last = i
    assert sent == sorted(want)


def test_repeated_summaries_count_once(spark):
    days = spark.createDataFrame([(1, "floor_1", "2024-01-02", 500, 0), (1, "floor_1", "2024-01-02", 600, 1), (1, "floor_1", "2024-01-03", 0, 0)], "site_id long, floor string, date string, total_runtime_s long, seq int")
    days = days.withColumn("date", F.to_date("date"))
    calls = spark.createDataFrame([(1, "floor_1", datetime(2024, 1, 2, 3), 600), (1, "floor_1", datetime(2024, 1, 3, 3), 60)], "site_id long, floor string, ended_at timestamp, duration_s long")
    assert rows_of(comparisons.reconcile_daily(days, calls), "summary_s", "raw_s", "mismatch") == [(0, 60, True), (600, 600, False)]


def test_idle_sites_have_zero_rows(spark):
    furnace = spark.createDataFrame([(1, datetime(2024, 1, 2, 3), datetime(2024, 1, 2, 3), 600)], "site_id long, ended_at timestamp, ts timestamp, duration_s long")
    sites = spark.createDataFrame([(1,), (2,), (2,)], "site_id long")
    assert rows_of(rollups.duty_cycle(furnace, "2024-01-02", "2024-01-02", sites), "site_id", "session_count", "total_on_s") == [(1, 1, 600.0), (2, 0, 0.0)]
    none = furnace.limit(0)
    opened = spark.createDataFrame([], "site_id long, floor string, on_since timestamp")
    live = rollups.live_status(none.withColumn("floor", F.lit("floor_1")), furnace, opened, F.lit(NOON), sites=sites)
    assert rows_of(live, "site_id", "session_count", "furnace_today_s", "floor_1_today_s") == [(1, 0, 0, 0), (2, 0, 0, 0)]


def test_csv_keeps_microseconds(spark, tmp_path):
    df = spark.createDataFrame([(1, datetime(2024, 1, 2, 3, 4, 5, 123456))], "site_id long, ts timestamp")
    sinks.write_csv(df, str(tmp_path / "out"))
    assert sinks.read_csv(spark, str(tmp_path / "out"), "site_id long, ts timestamp").collect() == df.collect()


def plain_throttle(alerts, step):
    """The rule as a loop over ``(key, us, seq)``."""
    last, held, out = {}, {}, {}
    for key, us, seq in sorted(alerts, key=lambda a: (str(a[0]), a[1], a[2])):
        go = key not in last or us >= last[key] + step
        out[seq] = (go, held.get(key, 0) if go else 0)
        if go:
            last[key], held[key] = us, 0
        else:
            held[key] = held.get(key, 0) + 1
    return out


@pytest.mark.parametrize("seed,block", [(1, 1), (2, 3), (3, 64), (4, 7)])
def test_throttle_equals_the_loop(spark, seed, block):
    import random

    rng = random.Random(seed)
    alerts, us = [], {1: 0, 2: 0, None: -5_000_000}
    for seq in range(1500):
        key = rng.choice([1, 1, 1, 2, None])
        us[key] += rng.choice([0, 1, 500_000, 3_000_000, 9_999_999, 10_000_000, 47_000_000, 900_000_000 if rng.random() < 0.05 else 2])
        alerts.append((key, us[key], seq))
    df = spark.createDataFrame(alerts, "site_id long, us long, seq long").select("site_id", F.lit("k").alias("kind"), F.timestamp_micros("us").alias("ts"), "seq").repartition(5)
    got = {r["seq"]: (r["sent"], r["suppressed_before"]) for r in alarms.throttle(df, interval_s=10, block=block).collect()}
    assert got == plain_throttle(alerts, 10_000_000)


def test_throttle_spreads_one_key_over_tasks(spark):
    df = spark.range(400_000).select(F.lit(1).cast("long").alias("site_id"), F.lit("k").alias("kind"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"))
    marked = alarms.throttle(df, interval_s=100, block=16).withColumn("task", F.spark_partition_id())
    sizes = [r["n"] for r in marked.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count_if("sent").alias("s")).collect()]
    assert len(sizes) > 1 and max(sizes) < 300_000
    assert marked.filter("sent").count() == 4000 and marked.agg(F.sum("suppressed_before")).first()[0] == 400_000 - 4000 - 99


def test_duty_cycle_over_many_windows(spark):
    start = datetime(2024, 1, 1)
    sessions = [(1, start + timedelta(hours=h), d) for h, d in ((1, 3600), (25, 7200), (72, 200_000), (90, None), (100, 0))] + [(2, start + timedelta(hours=30), 60)]
    furnace = spark.createDataFrame(sessions, "site_id long, ended_at timestamp, duration_s long")
    windows = [(i, start + timedelta(hours=a), start + timedelta(hours=b)) for i, (a, b) in enumerate([(0, 1), (0, 48), (24, 25), (10, 100), (5, 5), (300, 400)])]
    table = spark.createDataFrame(windows, "window_id long, start timestamp, end timestamp")
    want = {}
    for site, end, d in sessions:
        for i, a, b in windows:
            on = (min(end, b) - max(end - timedelta(seconds=d or 0), a)).total_seconds()
            if d and on > 0:
                n, total, clipped = want.get((site, i), (0, 0.0, 0))
                want[site, i] = (n + 1, total + on, clipped + (on < d))
    for bucket in (3600, 86_400, 10_000_000):
        got = rollups.duty_cycle_windows(furnace, table, bucket).collect()
        assert {(r["site_id"], r["window_id"]): (r["session_count"], r["total_on_s"], r["clipped_count"]) for r in got} == want
    mine = table.withColumn("site_id", F.lit(2).cast("long"))
    assert [(r["site_id"], r["window_id"]) for r in rollups.duty_cycle_windows(furnace, mine, on=["site_id"]).orderBy("window_id").collect()] == [(2, 1), (2, 3)]


def test_merged_baselines_keep_their_error_bound(spark, tmp_path):
    import random

    rng = random.Random(9)
    durations = [int(rng.expovariate(1 / 900)) for _ in range(40_000)]
    rows = [(1, "floor_1", NOON + timedelta(days=i % 40), d) for i, d in enumerate(durations)] + [(1, "floor_2", NOON, None), (1, "floor_2", NOON, 7)]
    sessions = spark.createDataFrame(rows, "site_id long, floor string, ts timestamp, duration_s long").withColumn("entity_id", F.lit("e"))
    sketches = comparisons.duration_sketches(sessions)
    sinks.save_baseline(sketches, str(tmp_path / "sketches"))
    stored = sinks.load_baseline(spark, str(tmp_path / "sketches"))
    assert stored.count() == 41
    got = {r["key"]: r for r in comparisons.merged_baseline(stored).collect()}
    assert (got["floor_2"]["count"], got["floor_2"]["median"], got["floor_2"]["p95"]) == (1, 7, 7)
    mine = got["floor_1"]
    assert (mine["count"], mine["min"], mine["max"]) == (40_000, min(durations), max(durations))
    for name, q in (("median", 0.5), ("p75", 0.75), ("p95", 0.95)):
        below, upto = sum(d < mine[name] for d in durations), sum(d <= mine[name] for d in durations)
        assert below / 40_000 <= q + comparisons.rank_error() and upto / 40_000 >= q - comparisons.rank_error()
    part = comparisons.merged_baseline(stored.filter(F.col("date") < "2024-01-30")).filter("key = 'floor_1'").first()
    assert part["count"] == 10_000
    assert comparisons.duration_baseline(sessions).filter("key = 'floor_1'").first()["count"] == 40_000

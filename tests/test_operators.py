"""Boundary cases of the operators on small observations."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import CALLS, FURNACE, OUTDOOR, START, STATS, at, clock, dicts, golden_day
from emberline.operators import alarms, asof, comparisons, edges, gauges, rollups, rules, thermostat
from emberline.schema import CALL
from emberline.functions import scalars


@pytest.fixture(scope="module")
def golden(observe):
    return observe(*golden_day())


# --- the golden day ---------------------------------------------------------------------------------------------------


def test_golden_furnace_sessions(golden):
    rows = dicts(asof.with_outdoor(edges.furnace_calls(golden), edges.outdoor_readings(golden)), "ended_at")
    assert [(r["duration_s"], r["outdoor_temp_f"]) for r in rows] == [(2400, None), (3600, 48.5), (18000, 38.0)]


def test_golden_floor_days(golden):
    days = rollups.floor_daily_summary(edges.floor_calls(golden), edges.outdoor_readings(golden), rollups.active_days(golden))
    rows = dicts(days, "floor")
    assert [(r["total_runtime_s"], r["total_calls"]) for r in rows] == [(900, 3), (6000, 2), (1800, 2)]
    assert [r["max_duration_s"] for r in rows] == [300, 4200, 1200]
    assert {r["outdoor_temp_avg_f"] for r in rows} == {41.8}
    assert rows[1]["avg_duration_s"] == 3000.0


def test_golden_furnace_day(golden):
    out = edges.outdoor_readings(golden)
    day = dicts(rollups.furnace_daily_summary(edges.furnace_calls(golden), edges.floor_calls(golden), out, rollups.active_days(golden)))[0]
    assert (day["total_furnace_runtime_s"], day["session_count"]) == (24000, 3)
    assert (day["outdoor_temp_min_f"], day["outdoor_temp_max_f"], day["outdoor_temp_avg_f"]) == (35.5, 48.5, 41.8)
    assert day["setpoint_floor_1_f"] is None


def test_golden_long_call(golden):
    climate = thermostat.climate_rows(golden)
    rows = dicts(alarms.long_calls(edges.edges(golden), climate, at("23:59")))
    assert [(r["started_at"], r["ts"]) for r in rows] == [(clock("17:05"), clock("17:50"))]


# --- edges and sessions -----------------------------------------------------------------------------------------------


def test_end_without_start_has_no_duration(observe):
    rows = dicts(edges.floor_calls(observe(("01:00", CALLS[1], "on", "off"))))
    assert rows[0]["duration_s"] is None and rows[0]["started_at"] is None


def test_second_start_overwrites_the_first(observe):
    c = CALLS[1]
    rows = observe(("01:00", c, "off", "on"), ("01:10", c, "on", "unavailable"), ("01:20", c, "off", "on"), ("01:30", c, "on", "off"))
    assert [r["duration_s"] for r in dicts(edges.floor_calls(rows))] == [600]


def test_return_from_unavailable_is_no_edge(observe):
    rows = observe(("01:00", CALLS[1], "unavailable", "on"), ("01:10", CALLS[1], "on", "off"))
    assert [r["duration_s"] for r in dicts(edges.floor_calls(rows))] == [None]


def test_fractions_of_a_second_are_dropped(observe):
    rows = observe((START, CALLS[1], "off", "on"), (START + timedelta(seconds=1, microseconds=999_999), CALLS[1], "on", "off"))
    assert dicts(edges.floor_calls(rows))[0]["duration_s"] == 1


def test_open_sessions_and_strict_bootstrap(observe):
    rows = observe(("01:00", FURNACE, "off", "on"), ("02:00", FURNACE, "on", "unavailable"))
    assert [r["on_since"] for r in dicts(edges.open_sessions(rows, "furnace"))] == [clock("01:00")]
    assert dicts(edges.open_sessions(rows, "furnace", strict_bootstrap=True)) == []


def test_unknown_entities_are_dropped_and_dimension_table_is_joined(spark, observe):
    rows = observe(("01:00", "sensor.attic", None, "1"), ("01:00", OUTDOOR, None, "1"))
    assert [r["kind"] for r in dicts(rows)] == ["outdoor"]
    table = spark.sql("SELECT 'sensor.outdoor_temperature' AS entity_id, 'outdoor' AS kind, 'roof' AS floor")
    assert [r["floor"] for r in dicts(edges.entity_lookup(rows, table))] == ["roof"]


def test_outdoor_states_that_are_no_numbers_are_dropped(observe):
    states = ["unavailable", "unknown", "", "n/a", None, "-3.5", "0"]
    rows = observe(*[(f"0{i}:00", OUTDOOR, None, s) for i, s in enumerate(states)])
    assert [r["temperature_f"] for r in dicts(edges.outdoor_readings(rows), "ts")] == [-3.5, 0.0]


# --- as-of ------------------------------------------------------------------------------------------------------------


def test_outdoor_lookup_is_bounded_by_day_or_age(observe):
    rows = observe(
        (START - timedelta(minutes=10), OUTDOOR, None, "30"),
        (START, FURNACE, "off", "on"),
        (START + timedelta(minutes=5), FURNACE, "on", "off"),
    )
    sessions, out = edges.furnace_calls(rows), edges.outdoor_readings(rows)
    value = lambda **k: dicts(asof.with_outdoor(sessions, out, **k))[0]["outdoor_temp_f"]
    assert value() is None
    assert value(scope="unbounded") == 30.0
    assert value(scope="unbounded", max_age_s=900) == 30.0
    assert value(scope="unbounded", max_age_s=899) is None


# --- heating cycles ---------------------------------------------------------------------------------------------------


def heat(*readings, floor=1):
    """Readings ``(time, setpoint, temp, action[, mode])`` of one thermostat."""
    return [(t, STATS[floor], None, mode[0] if mode else "heat", (sp, temp, action)) for t, sp, temp, action, *mode in readings]


def outcomes(observe, *rows):
    obs = observe(*rows)
    climate = asof.with_zone_context(thermostat.climate_rows(obs), edges.edges(obs), edges.outdoor_readings(obs))
    cycles = thermostat.heating_cycles(climate)
    return climate, cycles


def test_time_to_temp(observe):
    climate, _ = outcomes(observe, *heat(("06:00", 70.0, 65.0, "heating"), ("06:10", 70.0, 68.0, "heating"), ("06:20", 70.0, 70.0, "heating")))
    row = dicts(thermostat.time_to_temp(climate))[0]
    assert (row["duration_s"], row["degrees_gained"], row["degrees_per_min"], row["setpoint_delta"]) == (1200, 5.0, 0.25, 5.0)


def test_reach_and_end_on_one_row(observe):
    climate, cycles = outcomes(observe, *heat(("06:00", 70.0, 65.0, "heating"), ("06:20", 70.0, 70.0, "idle")))
    assert dicts(thermostat.time_to_temp(climate))[0]["duration_s"] == 1200
    row = dicts(thermostat.overshoot(cycles))[0]
    assert (row["overshoot_s"], row["peak_temp"]) == (0, None)
    assert dicts(thermostat.setpoint_miss(cycles)) == []


def test_peak_needs_a_reading_after_the_reach(observe):
    _, one = outcomes(observe, *heat(("06:00", 70.0, 65.0, "heating"), ("06:20", 70.0, 70.0, "heating"), ("06:30", 70.0, 70.0, "idle")))
    row = dicts(thermostat.overshoot(one))[0]
    assert (row["overshoot_s"], row["peak_temp"]) == (600, None)
    _, more = outcomes(
        observe,
        *heat(
            ("06:00", 70.0, 65.0, "heating"), ("06:20", 70.0, 70.0, "heating"), ("06:25", 70.0, 72.0, "heating"),
            ("06:30", 70.0, 71.0, "heating"), ("06:40", 70.0, 75.0, "idle"),
        ),
    )
    assert dicts(thermostat.overshoot(more))[0]["peak_temp"] == 72.0


def test_miss_with_cause(observe):
    quiet = heat(("06:00", 70.0, 65.0, "heating"), ("06:10", 70.0, 67.0, "heating"), ("06:30", 70.0, 66.0, "idle"))
    _, cycles = outcomes(observe, *quiet)
    row = dicts(thermostat.setpoint_miss(cycles))[0]
    assert (row["closest_temp"], row["delta"], row["duration_s"], row["likely_cause"]) == (67.0, 3.0, 1800, "unknown")
    adjusted = heat(("06:00", 70.0, 65.0, "heating"), ("06:10", 72.0, 67.0, "heating"), ("06:30", 72.0, 66.0, "idle"))
    assert dicts(thermostat.setpoint_miss(outcomes(observe, *adjusted)[1]))[0]["likely_cause"] == "thermostat_adjustment"


def test_no_miss_when_started_at_setpoint(observe):
    _, cycles = outcomes(observe, *heat(("06:00", 65.0, 65.0, "heating"), ("06:30", 65.0, 64.0, "idle")))
    assert dicts(thermostat.setpoint_miss(cycles)) == []


def test_null_reading_overwrites_state(observe):
    rows = thermostat.changes(thermostat.climate_rows(observe(*heat(("06:00", 70.0, 65.0, "idle"), ("06:10", None, 65.0, "idle"), ("06:20", 70.0, 65.0, "idle")))))
    assert [r["setpoint_changed"] for r in dicts(rows, "ts")] == [True, False, True]


def test_slow_to_heat_fires_once_at_the_threshold(observe):
    climate, _ = outcomes(
        observe,
        *heat(("06:00", 70.0, 65.0, "heating"), ("06:14:59", 70.0, 66.0, "heating"), ("06:15", 70.0, 66.5, "heating"), ("06:30", 70.0, 67.0, "heating")),
    )
    rows = dicts(thermostat.slow_to_heat(climate))
    assert [(r["elapsed_s"], r["degrees_gained"]) for r in rows] == [(900, 1.5)]


def test_other_zones_and_outdoor_in_context(observe):
    rows = [(("05:00"), OUTDOOR, None, "20"), ("05:30", CALLS[2], "off", "on"), ("05:40", CALLS[1], "off", "on"), ("05:50", CALLS[3], "off", "on"), ("05:55", CALLS[3], "on", "off")]
    climate, _ = outcomes(observe, *rows, *heat(("06:00", 70.0, 65.0, "heating"), ("06:20", 70.0, 70.0, "heating")))
    row = dicts(thermostat.time_to_temp(climate))[0]
    assert (row["other_zones"], row["outdoor_temp_f"]) == (["floor_2"], 20.0)


# --- roll-ups and comparisons -----------------------------------------------------------------------------------------


def furnace_days(spark, values, start="2024-01-01"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v bigint").select(
        F.lit(1).cast("long").alias("site_id"),
        F.date_add(F.lit(start).cast("date"), F.col("i")).alias("date"),
        F.col("v").alias("total_furnace_runtime_s"),
        F.lit(1).alias("session_count"),
        F.lit(30.0).alias("outdoor_temp_avg_f"),
        *[F.col("v").alias(f"runtime_{f}_s") for f in ("floor_1", "floor_2", "floor_3")],
        *[F.lit(68.0).alias(f"setpoint_{f}_f") for f in ("floor_1", "floor_2", "floor_3")],
    )


def test_week_needs_seven_days(spark):
    assert dicts(comparisons.weekly_comparison(furnace_days(spark, [1] * 6))) == []
    row = dicts(comparisons.weekly_comparison(furnace_days(spark, [1] * 7)))[0]
    assert (row["this_days"], row["last_days"], row["furnace_pct"], row["partial"]) == (7, 0, None, True)


def test_week_over_week(spark):
    row = dicts(comparisons.weekly_comparison(furnace_days(spark, [100] * 7 + [150] * 7)))[0]
    assert (row["furnace_pct"], row["floor_2_up"], row["partial"], row["this_floor_1_setpoint_f"]) == (50.0, True, False, 68.0)


def test_duty_cycle_window(observe):
    rows = edges.furnace_calls(
        observe((START - timedelta(hours=1), FURNACE, "off", "on"), ("01:00", FURNACE, "on", "off"), ("02:00", FURNACE, "on", "off"))
    )
    row = dicts(rollups.duty_cycle(rows, "2024-01-15", "2024-01-15"))[0]
    assert (row["window_duration_s"], row["total_on_s"], row["session_count"], row["clipped_count"]) == (86399.0, 3600.0, 1, 1)


@pytest.mark.parametrize("text,end,want", [("2026-01-15", True, "2026-01-15 23:59:59"), ("2026-01-15", False, "2026-01-15 00:00:00"), ("2026-01-15T10:30", True, "2026-01-15 10:30:00")])
def test_window_bounds(text, end, want):
    assert str(rollups.parse_bound(text, end)) == want


def durations(spark, values, floor="floor_1"):
    rows = [(1, "e", floor, i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "site_id bigint, entity_id string, floor string, seq bigint, duration_s bigint").withColumn(
        "ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 3600)
    )


def test_baseline_interpolates(spark):
    row = dicts(comparisons.duration_baseline(durations(spark, [600, 1200, None, 1800, 2400])))[0]
    assert (row["key"], row["count"], row["min"], row["max"], row["median"], row["p75"], row["p95"]) == ("floor_1", 4, 600, 2400, 1500.0, 1950.0, 2310.0)
    single = dicts(comparisons.duration_baseline(durations(spark, [700], None)))[0]
    assert (single["key"], single["median"], single["p95"]) == ("e", 700.0, 700.0)


def test_reconcile_compares_summaries_only(spark, golden):
    calls = edges.floor_calls(golden)
    days = rollups.floor_daily_summary(calls, edges.outdoor_readings(golden), rollups.active_days(golden))
    assert {r["mismatch"] for r in dicts(comparisons.reconcile_daily(days, calls))} == {False}
    wrong = days.withColumn("total_runtime_s", F.col("total_runtime_s") + 5)
    assert {r["delta_s"] for r in dicts(comparisons.reconcile_daily(wrong, calls))} == {5}
    assert dicts(comparisons.unreconciled_days(days, calls)) == []
    assert len(dicts(comparisons.unreconciled_days(days.limit(0), calls))) == 1


def test_correlation_without_variance_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(scalars.correlation(F.col("x"), F.col("y"))).first()[0] is None
    assert df.agg(scalars.correlation(F.col("y"), F.col("y"))).first()[0] == pytest.approx(1.0)


def test_live_status_counts_the_open_session(observe):
    rows = observe(("01:00", CALLS[2], "off", "on"), ("01:10", CALLS[2], "on", "off"), ("02:00", CALLS[2], "off", "on"), ("02:00", FURNACE, "off", "on"))
    open_now = edges.open_sessions(rows).unionByName(edges.open_sessions(rows, "furnace"))
    row = dicts(rollups.live_status(edges.floor_calls(rows), edges.furnace_calls(rows), open_now, at("02:30")))[0]
    assert (row["floor_2_today_s"], row["furnace_today_s"], row["session_count"]) == (2400, 1800, 1)


def test_mean_does_not_depend_on_order(spark):
    df = spark.createDataFrame([(95.17,), (135.73,)], "v double")
    assert df.agg(F.round(scalars.mean(F.col("v")), 1)).first()[0] == 115.5


# --- labels -----------------------------------------------------------------------------------------------------------


def test_labels(spark):
    df = spark.sql("SELECT * FROM VALUES (1.9), (2.0), (2.99), (3.5), (5.0), (9.0) AS t(z)").select(scalars.confidence(F.col("z")).alias("c"))
    got = [(round(r.c, 3), r.s) for r in df.select("c", scalars.severity(F.col("c")).alias("s")).collect()]
    assert got == [(0.0, "low"), (0.0, "low"), (0.33, "low"), (0.5, "medium"), (1.0, "high"), (1.0, "high")]
    hours = spark.range(24).select(scalars.day_period(F.timestamp_seconds(F.col("id") * 3600)).alias("p"))
    assert [r.p for r in hours.collect()] == ["night"] * 6 + ["morning"] * 6 + ["afternoon"] * 6 + ["evening"] * 6
    weeks = spark.sql("SELECT timestamp'2026-03-02' AS a, timestamp'2027-01-01' AS b")
    assert list(weeks.select(scalars.iso_week(F.col("a")), scalars.iso_week(F.col("b"))).first()) == ["2026-W10", "2026-W53"]
    r = spark.sql("SELECT * FROM VALUES (0.7D), (-0.4D), (0.2D), (0D) AS t(r)").select(scalars.correlation_label(F.col("r")).alias("l"))
    assert [x.l for x in r.collect()] == ["strong positive", "moderate negative", "weak positive", "negligible negative"]


# --- rules ------------------------------------------------------------------------------------------------------------


def floor_days(spark, values):
    return furnace_days(spark, values).select("site_id", F.lit("floor_1").alias("floor"), "date", F.col("total_furnace_runtime_s").alias("total_runtime_s"))


@pytest.mark.parametrize("values,fires", [([1000, 1000, 5000], 0), ([1000, 1000, 1000, 5000], 1), ([299] * 3 + [5000], 0), ([300] * 3 + [5000], 1), ([1000] * 3 + [1500], 0)])
def test_runtime_anomaly_guards(spark, values, fires):
    rows = dicts(rules.floor_runtime_anomaly(floor_days(spark, values)))
    assert len(rows) == fires
    assert all((r["confidence"], r["severity"]) == (0.5, "medium") for r in rows)


def test_runtime_anomaly_looks_back_fourteen_rows(spark):
    rows = dicts(rules.floor_runtime_anomaly(floor_days(spark, [100_000] * 3 + [1000] * 14 + [1600])))
    assert [(r["baseline_mean_s"], r["history_count"]) for r in rows] == [(1000.0, 14)]


def test_session_duration_anomaly(spark):
    base = spark.createDataFrame([("floor_1", 2000.0)], "key string, p95 double")
    found = {r["duration_s"]: r for r in dicts(rules.session_duration_anomaly(durations(spark, [89, 90, 3000, 3001]), base))}
    assert sorted(found) == [89, 3001]
    assert (found[89]["finding"], found[89]["confidence"], found[89]["severity"]) == ("short", 1.0, "high")
    assert found[3001]["threshold_s"] == 3000.0
    fallback = dicts(rules.session_duration_anomaly(durations(spark, [1801], "floor_1"), base.limit(0)))
    assert [r["threshold_s"] for r in fallback] == [1800.0]


def test_efficiency_score(spark):
    gains = durations(spark, [600] * 5).withColumn("temp_delta_f", F.lit(2.0))
    as_of = F.lit("2023-11-16").cast("timestamp")
    assert [r["score_f_per_min"] for r in dicts(rules.heating_efficiency(gains, as_of))] == [0.2]
    assert dicts(rules.heating_efficiency(gains.limit(4), as_of)) == []


def test_degradation_slope(spark):
    week = 7 * 86400
    rows = [(1, "floor_1", w * 3 + i, 1_700_000_000 + w * week + i, 100 * (w + 1)) for w in range(3) for i in range(3)]
    df = spark.createDataFrame(rows, "site_id bigint, floor string, seq bigint, s bigint, duration_s bigint").withColumn("ts", F.timestamp_seconds("s"))
    found = dicts(rules.efficiency_degradation(df))
    assert [(r["slope_s_per_week"], r["weeks_analysed"], r["weekly_mean_s"]) for r in found] == [(100.0, 3, [100.0, 200.0, 300.0])]
    assert dicts(rules.efficiency_degradation(df.filter("seq < 6"))) == []


def test_split_by_position_matches_ranking(spark):
    import random

    rng = random.Random(3)
    rows = [(s, i, 1_700_000_000 + rng.randrange(7200)) for s, n in ((1, 7), (2, 8), (3, 101)) for i in range(n)]
    df = spark.createDataFrame(rows, "site_id bigint, seq bigint, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.site_id, r.seq): r.part for r in rules.split_by_position(df).collect()}
    want = {}
    for site, n in ((2, 8), (3, 101)):
        mine = sorted((r for r in rows if r[0] == site), key=lambda r: (r[2], r[1]))
        want.update({(site, r[1]): "baseline" if i < n * 3 // 4 else "window" for i, r in enumerate(mine)})
    assert got == want


def test_time_of_day_shift_without_history_has_no_ratio(spark):
    old = spark.range(8).select(F.lit("baseline").alias("part"), F.timestamp_seconds(F.lit(9 * 3600)).alias("ts"))
    new = spark.range(3).select(F.lit("window").alias("part"), F.timestamp_seconds(F.lit(3600)).alias("ts"))
    marked = old.unionByName(new).withColumns({"site_id": F.lit(1), "floor": F.lit("floor_1")})
    rows = dicts(rules.time_of_day_shift(marked))
    assert [(r["period"], r["ratio"], r["observed_share"], r["historical_share"]) for r in rows] == [("night", None, 1.0, 0.0)]


# --- alarms -----------------------------------------------------------------------------------------------------------


def test_long_call_threshold_and_open_call(observe):
    rows = observe(("01:00", CALLS[2], "off", "on"), ("01:44:59", CALLS[2], "on", "off"), ("02:00", CALLS[2], "off", "on"), ("02:45", CALLS[2], "on", "off"), ("03:00", CALLS[2], "off", "on"))
    climate = thermostat.climate_rows(rows)
    found = dicts(alarms.long_calls(edges.edges(rows), climate, at("04:00")), "ts")
    assert [r["started_at"] for r in found] == [clock("02:00"), clock("03:00")]
    assert [r["long_call_count_today"] for r in dicts(alarms.long_call_escalations(alarms.long_calls(edges.edges(rows), climate, at("04:00"))))] == [2]


def test_silence_fires_once_per_gap_and_on_the_open_tail(observe):
    rows = observe(("01:00", FURNACE, "off", "on"), ("02:09:59", FURNACE, "on", "off"), ("03:20", FURNACE, "off", "on"))
    found = dicts(alarms.silence_gaps(rows, at("04:30")), "ts")
    assert [(r["last_event_ts"], r["gap_s"]) for r in found] == [(clock("02:09:59"), 4201), (clock("03:20"), 4200)]


def test_no_response(observe):
    def run(*temps):
        rows = observe(*heat(("00:50", 70.0, 65.0, "idle")), ("01:00", CALLS[1], "off", "on"), *heat(*temps))
        return dicts(alarms.floor_no_response(edges.edges(rows), thermostat.climate_rows(rows), at("02:00")))

    flat = run(("01:05", 70.0, 64.0, "heating"), ("01:20", 70.0, 68.0, "heating"))
    assert [(r["minutes_elapsed"], r["start_temp"], r["current_temp"]) for r in flat] == [(10.0, 65.0, 65.0)]
    assert run(("01:05", 70.0, 65.5, "heating")) == []


def test_no_response_needs_a_start_temperature(observe):
    rows = observe(("01:00", CALLS[1], "off", "on"), *heat(("01:05", 70.0, 64.0, "heating")))
    assert dicts(alarms.floor_no_response(edges.edges(rows), thermostat.climate_rows(rows), at("02:00"))) == []


def test_throttle_matches_a_loop(spark):
    import random

    rng = random.Random(5)
    rows = sorted((rng.randrange(5), i, rng.randrange(200_000)) for i in range(400))
    df = spark.createDataFrame(rows, "site_id bigint, seq bigint, s bigint").withColumns({"ts": F.timestamp_seconds("s"), "kind": F.lit("a")})
    got = {r.seq: (r.sent, r.suppressed_before) for r in alarms.throttle(df).collect()}
    for site in range(5):
        last, held = None, 0
        for _, seq, s in sorted((r for r in rows if r[0] == site), key=lambda r: (r[2], r[1])):
            if last is None or s - last >= 3600:
                assert got[seq] == (True, held)
                last, held = s, 0
            else:
                assert got[seq] == (False, 0)
                held += 1


def test_late_alerts(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS ts, explode(array(300, 301)) AS d").withColumn("sent", F.timestamp_seconds(F.unix_timestamp("ts") + F.col("d")))
    assert [r.late for r in alarms.late_alerts(df, F.col("sent")).orderBy("d").collect()] == [False, True]


# --- gauges -----------------------------------------------------------------------------------------------------------


def test_zone_snapshots_skip_zones_without_temperature(observe):
    rows = observe(*heat(("06:01", 70.0, 65.0, "heating")), *heat(("06:02", 70.0, None, "idle"), floor=2), ("06:16", OUTDOOR, None, "20"), *heat(("06:17", 70.0, 66.0, "heating")))
    snaps = dicts(gauges.zone_snapshots(thermostat.climate_rows(rows), edges.outdoor_readings(rows), step_s=600), "ts")
    assert [(s["ts"], sorted(s["zones"]), s["outdoor_temp_f"]) for s in snaps] == [(clock("06:10"), ["floor_1"], None), (clock("06:20"), ["floor_1"], 20.0)]
    assert snaps[1]["zones"]["floor_1"]["current_temp"] == 66.0


def test_counter_reset(spark):
    df = spark.createDataFrame([(1, 0, 0, 50), (1, 1, 60, 80), (1, 2, 120, 30)], "site_id bigint, seq bigint, s bigint, v bigint").withColumn("ts", F.timestamp_seconds("s"))
    assert [r["increase"] for r in dicts(gauges.hourly_increase(df, "v", ["site_id"]))] == [110]


def test_series_is_filled_forward(observe):
    rows = observe((("01:00")[:5], OUTDOOR, None, "10"), ("03:30", OUTDOOR, None, "20"))
    samples = gauges._samples(edges.outdoor_readings(rows), ("outdoor_temperature_f", F.col("temperature_f")))
    series = dicts(gauges.gauge_series(samples, 3600), "ts")
    assert [(r["ts"], r["value"]) for r in series] == [(clock("01:00"), 10.0), (clock("02:00"), 10.0), (clock("03:00"), 10.0), (clock("04:00"), 20.0)]


def test_call_kind_is_default(observe):
    assert edges.edges(observe(("01:00", FURNACE, "off", "on")), CALL).count() == 0

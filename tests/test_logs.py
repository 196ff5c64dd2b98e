"""Log reading, flattening, validation and sinks."""

import json

import pytest
from pyspark.sql import types as T

from emberline.plans.queries import log_lines
from emberline.sources import logs, sinks
from emberline.sources.scratch import scratch_path
from conftest import OUTDOOR, STATS, dicts, golden_day
from emberline.operators import asof, edges


def line(**changes):
    record = {
        "schema": "x.observer.state_changed.v1",
        "source": "ha.websocket",
        "ts": "2024-01-01T00:00:00+00:00",
        "data": {"entity_id": OUTDOOR, "old_state": None, "new_state": "20.5"},
    }
    record["data"] |= changes.pop("data", {})
    record |= changes
    return json.dumps(record)


def climate(**changes):
    return {"entity_id": STATS[1], "new_state": "heat", "attributes": {"temperature": 70, "current_temperature": 65.5}} | changes


CASES = [
    (line(), []),
    (line(data={"new_state": "unavailable"}), []),
    (line(data={"entity_id": "sensor.attic"}), []),
    (line(data=climate()), []),
    ("{not json", ["invalid_json"]),
    ("[1]", ["not_an_object"]),
    (line(schema="x.other.v1"), ["bad_schema"]),
    (line(source="y"), ["bad_source"]),
    (line(ts=""), ["bad_ts"]),
    (json.dumps({"schema": "x.state_changed.v1", "source": "ha.websocket", "ts": "t"}), ["missing_top_level", "data_not_object"]),
    (line().replace('"old_state": null, ', ""), ["missing_data_fields"]),
    (line(data={"new_state": None}), ["empty_new_state"]),
    (line(data={"entity_id": "binary_sensor.furnace_heating", "new_state": "open"}), ["bad_binary_state"]),
    (line(data={"new_state": "warm"}), ["bad_outdoor_state"]),
    (line(data=climate(new_state="dry")), ["bad_climate_mode"]),
    (line(data=climate(attributes={"temperature": "70", "current_temperature": 1})), ["climate_temperature_not_numeric"]),
    (line(data=climate(attributes={"temperature": 70})), ["climate_current_temperature_not_numeric"]),
]


@pytest.fixture(scope="module")
def checked(spark):
    lines = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CASES)] + [(99, "")], "i int, value string")
    return logs.validate_observations(lines)


def test_violations(checked):
    assert [r["errors"] for r in dicts(checked, "i")] == [errors for _, errors in CASES]
    assert [r["i"] for r in dicts(checked, "i") if r["unknown_entity"]] == [2]


def test_summary_and_quarantine(checked):
    counts = {r.measure: r.n for r in logs.validation_summary(checked).collect()}
    assert (counts["total"], counts["valid"], counts["invalid"], counts["unknown_entity"], counts["invalid_json"]) == (len(CASES), 4, len(CASES) - 4, 1, 1)
    valid, quarantine = logs.split_valid(checked)
    assert (valid.count(), quarantine.count()) == (4, len(CASES) - 4)


def test_read_log_skips_what_it_cannot_use(spark, tmp_path):
    rows = ["", "{bad", line(site_id=1, seq=1), line(site_id=1, seq=2, ts="2024-01-01T00:00:00.5Z"), line(site_id=1, seq=3, ts="2024-01-01T02:00:00+02:00"), line(site_id=1, seq=4, ts="2024-01-01T00:00:00"), line(site_id=1, seq=5, ts="soon"), line(site_id=1, seq=6, schema="x.floor_call_ended.v1")]
    (tmp_path / "log.jsonl").write_text("\n".join(rows))
    got = dicts(logs.read_log(spark, str(tmp_path)), "seq")
    assert [r["seq"] for r in got] == [1, 2, 3, 4, 5]
    assert [None if r["ts"] is None else r["ts"].isoformat() for r in got] == ["2024-01-01T00:00:00", "2024-01-01T00:00:00.500000", "2024-01-01T00:00:00", "2024-01-01T00:00:00", None]
    ended = T.StructType([T.StructField("entity_id", T.StringType())])
    assert logs.read_log(spark, str(tmp_path), "floor_call_ended", ended).count() == 1
    assert logs.malformed_lines(spark.read.text(str(tmp_path))).count() == 1


def test_flatten(spark):
    def message(kind="event", entity=OUTDOOR, new=None, old=None):
        return json.dumps({"type": kind, "event": {"data": {"entity_id": entity, "new_state": new, "old_state": old}}})

    lines = [message("pong"), message(entity=None), message(new={"state": "1", "attributes": {}}), message(entity=STATS[1], new={"state": "heat", "attributes": {"temperature": 70, "unit": "F"}}, old={"state": "off"})]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = dicts(logs.flatten_state_changes(df), "entity_id")
    assert [(r["entity_id"], r["old_state"], r["new_state"], r["attributes"] is None) for r in got] == [(STATS[1], "off", "heat", False), (OUTDOOR, None, "1", True)]
    assert [r["entity_id"] for r in dicts(logs.flatten_state_changes(df, watch=[OUTDOOR]))] == [OUTDOOR]


def test_derived_log_round_trip(spark, observe, tmp_path):
    obs = observe(*golden_day())
    log = sinks.derived_union({"floor_call_ended": edges.floor_calls(obs), "outdoor_temp_updated": edges.outdoor_readings(obs)})
    path = str(tmp_path / "derived")
    sinks.write_derived(log, path)
    sinks.write_derived(log.filter("event_type = 'outdoor_temp_updated'"), path)
    back = spark.read.parquet(path)
    assert {r["event_type"]: r["count"] for r in back.groupBy("event_type").count().collect()} == {"floor_call_ended": 7, "outdoor_temp_updated": 10}
    plan = back.filter("event_type = 'floor_call_ended' AND event_date = '2024-01-15'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_type" in plan


def test_log_written_by_us_reads_back(spark, observe):
    obs = observe(*golden_day())
    path = scratch_path(spark, "t")
    log_lines(obs).write.text(path)
    again = edges.entity_lookup(logs.read_log(spark, path))
    assert dicts(edges.floor_calls(again), "seq") == dicts(edges.floor_calls(obs), "seq")


def test_csv_and_baseline(spark, observe, tmp_path):
    obs = observe(*golden_day())
    rows = sinks.session_export(asof.with_outdoor(edges.furnace_calls(obs), edges.outdoor_readings(obs)))
    sinks.write_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["site_id", "started_at", "ended_at", "duration_s", "outdoor_temp_f", "entity_id"]
    assert sorted(int(r.duration_s) for r in back.collect()) == [2400, 3600, 18000]
    sinks.save_baseline(rows, str(tmp_path / "base"))
    assert sinks.load_baseline(spark, str(tmp_path / "base")).count() == 3


def test_scratch_is_in_the_named_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))

"""Every registered query against its SQL counterpart, with and without forced slicing of the time lines."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__ as entry
from emberline.functions import timeline
from emberline.sources import event_table

DATA = "/root/testdata/sf0.001"
BATCH = [n for n in entry.QUERIES if not n.startswith("st_")]
STREAMS = [n for n in entry.QUERIES if n.startswith("st_")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    return con


def plain(v):
    if isinstance(v, bool):
        return str(v)
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (int, float, decimal.Decimal)):
        return repr(round(float(v), 9) + 0.0)
    return v.isoformat() if isinstance(v, (datetime.datetime, datetime.date)) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(entry.oracle_sql()[name])
    want = table([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", BATCH)
def test_batch_query(spark, duck, name):
    compare(spark, duck, name)


@pytest.mark.parametrize("name", STREAMS)
def test_stream_query(spark, duck, name):
    compare(spark, duck, name)


def test_every_query_has_sql():
    assert set(entry.QUERIES) <= set(entry.oracle_sql())


SLICED = [
    "floor_calls", "furnace_sessions", "mode_changes", "heating_cycles", "zone_time_to_temp", "zone_overshoot", "zone_setpoint_miss",
    "zone_slow_to_heat", "asof_outdoor", "other_zones_calling", "floor_daily_summary", "long_call_warnings", "floor_no_response",
    "silence_gaps", "runtime_today", "hourly_increase", "late_alerts", "backfill",
]


@pytest.fixture
def forced_slices(monkeypatch):
    measured = timeline.measure_slices
    monkeypatch.setattr(event_table, "_SLICES", {})
    monkeypatch.setattr(event_table, "measure_slices", lambda e: measured(e, rows_per_slice=9, max_slices=10**6))


@pytest.mark.parametrize("name", SLICED)
def test_sliced_query(spark, duck, forced_slices, name):
    compare(spark, duck, name)
    assert any(s is not None for s in event_table._SLICES.values())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0

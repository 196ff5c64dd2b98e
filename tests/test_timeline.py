"""Ordered scans and slicing on skewed data, against plain Python."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from emberline.functions.timeline import SLICE, as_of, instant, measure_slices, scan, with_slices

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture(scope="module")
def skewed(spark):
    """One site holds a third of all rows, half of them inside a single hour."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        hot = i % 3 == 0
        offset = rng.random() * (3600 if hot and i % 2 else 30 * 86400)
        value = None if rng.random() < 0.3 else float(rng.randrange(100))
        rows.append((0 if hot else 1 + i % 200, i, T0 + timedelta(microseconds=int(offset * 1e6)), value))
    return rows, spark.createDataFrame(rows, "site_id bigint, seq bigint, ts timestamp, value double")


def test_no_slices_without_a_hot_key(skewed):
    assert measure_slices(skewed[1], rows_per_slice=1000) is None


def test_hot_key_is_cut_into_even_slices(skewed):
    rows, df = skewed
    slices = measure_slices(df, rows_per_slice=100)
    assert [r.site_id for r in slices.collect()] == [0]
    sizes = with_slices(df, slices).groupBy("site_id", SLICE).count().collect()
    hot = {r[SLICE]: r["count"] for r in sizes if r.site_id == 0}
    assert sorted(hot) == list(range(10))
    # the hour that holds half of the site is cut as finely as the rest
    assert max(hot.values()) <= 130
    assert {r[SLICE] for r in sizes if r.site_id != 0} == {-1}


def test_number_of_cuts_is_bounded(skewed):
    slices = measure_slices(skewed[1], rows_per_slice=1, max_slices=50)
    assert sum(len(r._bounds) + 1 for r in slices.collect()) <= 100


@pytest.mark.parametrize("rows_per_slice", [None, 40, 7])
def test_scan_matches_python(skewed, rows_per_slice):
    rows, df = skewed
    if rows_per_slice:
        df = with_slices(df, measure_slices(df, rows_per_slice=rows_per_slice, max_slices=10**6))
        assert SLICE in df.columns
    got = scan(
        df,
        ["site_id"],
        previous={"p": F.col("value")},
        following={"n": F.col("value"), "ns": F.col("seq")},
        latest={"l": F.col("value")},
        running={"r": F.col("value")},
    ).drop(SLICE)
    want = []
    for site in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == site), key=lambda r: (r[2], r[1]))
        last, total = None, None
        for i, (_, seq, _, value) in enumerate(mine):
            last = value if value is not None else last
            total = total if value is None else (total or 0) + value
            nxt = mine[i + 1] if i + 1 < len(mine) else None
            want.append((seq, mine[i - 1][3] if i else None, nxt and nxt[3], nxt and nxt[1], last, total))
    assert sorted((r.seq, r.p, r.n, r.ns, r.l, r.r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("rows_per_slice", [None, 40])
def test_as_of_matches_python(skewed, rows_per_slice):
    rows, df = skewed
    if rows_per_slice:
        df = with_slices(df, measure_slices(df, rows_per_slice=rows_per_slice, max_slices=10**6))
    asked, readings = df.filter("seq % 2 = 0").drop("value"), df.filter("seq % 2 = 1")
    got = as_of(asked, readings, ["site_id"], {"o": {"v": F.col("value")}})
    found = {r.seq: (None if r.o is None else ("v", r.o.v)) for r in got.collect()}
    for site, seq, ts, _ in rows:
        if seq % 2 == 0:
            before = [r for r in rows if r[0] == site and r[1] % 2 and (r[2], r[1]) <= (ts, seq)]
            assert found[seq] == (("v", max(before, key=lambda r: (r[2], r[1]))[3]) if before else None)


def test_instant_orders_like_time_then_seq(skewed):
    rows, df = skewed
    got = [r.seq for r in df.orderBy(instant()).select("seq").collect()]
    assert got == [r[1] for r in sorted(rows, key=lambda r: (r[2], r[1]))]

"""Shards of keys: few state calls, the order of each key, one timer a shard."""

import json
import random

import pandas as pd
import pytest

from emberline.streaming.ordered import KEY, PART_ROWS
from emberline.streaming.processors import AlarmProcessor, CallProcessor, DayProcessor, OrderProcessor

MINUTE = 60_000_000
DAY = 1440 * MINUTE


class Store:
    """State and timers of one shard, with the number of calls."""

    def __init__(self):
        self.calls, self.timers, self.values, self.maps = 0, [], {}, {}

    def getValueState(self, name, schema):
        store = self

        class Value:
            def get(self):
                store.calls += 1
                return store.values.get(name)

            def update(self, value):
                store.calls += 1
                store.values[name] = value

        return Value()

    def getMapState(self, name, key, value):
        store, held = self, self.maps.setdefault(name, {})

        class Map:
            def getValue(self, at):
                store.calls += 1
                return held[at]

            def updateValue(self, at, value):
                store.calls += 1
                held[at] = value

            def removeKey(self, at):
                store.calls += 1
                del held[at]

        return Map()

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.append(ms)


class Clock:
    def __init__(self, us=0):
        self.us = us

    def getCurrentWatermarkInMs(self):
        return self.us // 1000


def started(processor, *keys):
    processor.keys = keys
    store = Store()
    processor.init(store)
    return store


def frame(rows, processor):
    return pd.DataFrame(rows, columns=[KEY, "us", "seq", *[n for n, _ in processor.fields]])


def rows_of(frames):
    return [tuple(None if pd.isna(v) else v for v in r) for f in frames for r in f.itertuples(index=False)]


def site(n):
    return json.dumps({"site_id": n})


def test_state_calls_do_not_grow_with_keys_or_chunks():
    order = OrderProcessor(True, MINUTE)
    store = started(order, ("site_id", "bigint"))
    rows = [(site(None if s == 7 else s), MINUTE * i + s, 1000 * s + i) for s in range(40) for i in range(200)]
    random.Random(3).shuffle(rows)
    assert rows_of(order.handleInputRows((0,), iter([frame(rows[:5000], order), frame(rows[5000:], order)]), Clock())) == []
    assert len(store.timers) == 1
    half = rows_of(order.handleExpiredTimer((0,), Clock(100 * MINUTE), None))
    rest = rows_of(order.handleExpiredTimer((0,), Clock(DAY), None))
    assert store.calls < 30 and not store.maps["parts"]
    assert max(r[1] for r in half) < 100 * MINUTE <= min(r[1] for r in rest)
    for s in range(40):
        mine = [r[2] for r in half + rest if r[0] == (None if s == 7 else s)]
        assert mine == [1000 * s + i for i in range(200)]


def test_a_part_holds_few_rows_and_late_rows_are_set_aside():
    order = OrderProcessor(True, MINUTE)
    store = started(order, ("site_id", "bigint"))
    many = [(site(1), i, i) for i in range(3 * PART_ROWS + 5)]
    assert rows_of(order.handleInputRows((0,), iter([frame(many[::-1], order)]), Clock())) == []
    assert len(store.maps["parts"]) == 4
    late = rows_of(order.handleInputRows((0,), iter([frame([(site(2), 5, 9), (site(2), 2 * MINUTE, 10)], order)]), Clock(MINUTE)))
    assert (2, 5, None, 9) in late and [r[2] for r in late if r[0] == 1] == [r[2] for r in many]
    assert len(late) == len(many) + 1


@pytest.mark.parametrize("cut", [1, 3, 6])
def test_states_of_keys_stay_apart_over_batches(cut):
    calls = CallProcessor(False)
    started(calls, ("site_id", "bigint"), ("entity_id", "string"))
    entity = lambda s, e: json.dumps({"site_id": s, "entity_id": e})
    rows = [(entity(1, "a"), 0, 1, "f", "off", "on"), (entity(2, "a"), 1, 2, "f", "off", "on"), (entity(1, "b"), 2, 3, "f", "off", "on")]
    rows += [(entity(1, "a"), 5_000_000, 4, "f", None, "off"), (entity(2, "a"), 7_000_001, 5, "f", None, "off"), (entity(1, "b"), 9_000_002, 6, "f", None, "off")]
    got = [r for part in (rows[:cut], rows[cut:]) if part for r in rows_of(calls.handleInputRows((0,), iter([frame(part, calls)]), Clock()))]
    assert sorted((r[0], r[1], r[6]) for r in got) == [(1, "a", 5), (1, "b", 9), (2, "a", 7)]


def test_one_timer_serves_every_key_of_a_shard():
    alarms = AlarmProcessor(silence_s=60, buffered=True)
    store = started(alarms, ("site_id", "bigint"))
    reading = ("climate", "floor_1", None, "heat", 70.0, 65.0, "idle")
    rows = [(site(s), s * 10 * MINUTE, s, *reading) for s in range(1, 5)]
    assert rows_of(alarms.handleInputRows((0,), iter([frame(rows, alarms)]), Clock())) == []
    fired = []
    for _ in range(20):
        if not store.timers:
            break
        now = store.timers.pop() * 1000
        fired += rows_of(alarms.handleExpiredTimer((0,), Clock(now), None))
    assert [(r[0], r[1], r[3]) for r in fired] == [(s, "observer_silence", (s * 10 + 1) * MINUTE) for s in range(1, 5)]


def test_days_of_a_key_that_sleeps_are_closed_by_the_shard():
    days = DayProcessor(True, MINUTE)
    store = started(days, ("site_id", "bigint"))
    reading = ("climate", "floor_1", None, "heat", 70.0, 65.0, "idle")
    rows = [(site(s), s * DAY + MINUTE, s, *reading) for s in (0, 0, 1, 3)]
    assert rows_of(days.handleInputRows((0,), iter([frame(rows, days)]), Clock())) == []
    got = rows_of(days.handleExpiredTimer((0,), Clock(2 * DAY), None))
    assert sorted(r[:2] for r in got) == [(0, 0), (1, DAY)]
    assert store.timers[-1] * 1000 > 2 * DAY
    assert [r[:2] for r in rows_of(days.handleExpiredTimer((0,), Clock(5 * DAY), None))] == [(3, 3 * DAY)]

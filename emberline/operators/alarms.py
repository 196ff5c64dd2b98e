"""Alarms over the event history: long calls, silence, unresponsive floors, throttling and late alerts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.scalars import by_floor, plus_seconds, seconds_between
from emberline.functions.timeline import keep_slice, moment, scan
from emberline.operators.edges import calls_until
from emberline.schema import (
    ALERT_INTERVAL_S,
    LATE_ALERT_S,
    LONG_CALL_S,
    NO_RESPONSE_DEFAULT_S,
    NO_RESPONSE_S,
    SHORT_CALL_S,
    SILENCE_S,
)

FLOOR = ("site_id", "floor")
CALL_KEY = ("site_id", "entity_id", "floor", "call_ts", "call_seq")


def calls_with_readings(on_off: DataFrame, climate: DataFrame) -> DataFrame:
    """Start edges and the thermostat readings of the floor, each tagged with the call it falls into.

    Equi-keyed on the floor and linear in the rows: the call is the latest start at or before the row, and the row is
    inside when it lies before the end of that call. The start row carries the reading in force at the start.
    """
    starts = calls_until(on_off).withColumn("is_start", F.lit(True))
    readings = climate.select("site_id", "floor", "ts", "seq", "current_temp", "setpoint", *keep_slice(climate))
    both = starts.unionByName(readings, allowMissingColumns=True)
    rows = scan(
        both,
        FLOOR,
        latest={
            "call": F.when(
                F.col("is_start"), F.struct("entity_id", F.col("ts").alias("call_ts"), F.col("seq").alias("call_seq"), "until", "until_seq")
            ),
            "seen": F.when(F.col("is_start").isNull(), F.struct("current_temp", "setpoint")),
        },
    )
    inside = F.col("until").isNull() | (moment() < moment("until", "until_seq"))
    return (
        rows.drop("entity_id", "until", "until_seq")
        .filter(F.col("call").isNotNull())
        .select("*", "call.*")
        .filter(inside)
        .drop("call")
    )


def _open_for(as_of: Column) -> Column:
    return seconds_between(F.col("call_ts"), F.least(F.coalesce("until", as_of), as_of))


def long_calls(
    on_off: DataFrame,
    climate: DataFrame,
    as_of: Column,
    threshold_s: float = LONG_CALL_S,
    floors: Sequence[str] | None = ("floor_2",),
) -> DataFrame:
    """Calls open for at least the threshold, warned once, with the thermostat state at the time of the warning."""
    if floors is not None:
        on_off, climate = on_off.filter(F.col("floor").isin(*floors)), climate.filter(F.col("floor").isin(*floors))
    rows = calls_with_readings(on_off, climate).filter(_open_for(as_of) >= threshold_s)
    warn_at = plus_seconds(F.col("call_ts"), threshold_s)
    return (
        rows.filter(F.col("ts") <= warn_at)
        .groupBy(*CALL_KEY)
        .agg(F.max_by("seen", F.struct("ts", "seq")).alias("seen"))
        .select(
            "site_id",
            "entity_id",
            "floor",
            warn_at.alias("ts"),
            F.col("call_seq").alias("seq"),
            F.col("call_ts").alias("started_at"),
            F.lit(threshold_s).cast("long").alias("threshold_s"),
            F.col("seen.current_temp").alias("current_temp"),
            F.col("seen.setpoint").alias("setpoint"),
        )
    )


def long_call_escalations(warnings: DataFrame) -> DataFrame:
    """The second and later long-call warnings of a site's day.

    A floor can warn at most once per threshold, so the rows of one site and day are few by construction.
    """
    today = Window.partitionBy("site_id", F.to_date("ts")).orderBy("ts", "seq")
    return warnings.withColumn("long_call_count_today", F.row_number().over(today)).filter(
        F.col("long_call_count_today") >= 2
    )


def silence_gaps(observations: DataFrame, as_of: Column, threshold_s: float = SILENCE_S) -> DataFrame:
    """Gaps between observations of a site of at least the threshold, the open tail included."""
    rows = observations.filter(F.col("ts") <= as_of).select("site_id", "ts", "seq", *keep_slice(observations))
    gap = seconds_between(F.col("ts"), F.coalesce("next_ts", as_of))
    return (
        scan(rows, ["site_id"], following={"next_ts": F.col("ts")})
        .withColumn("gap_s", gap)
        .filter(F.col("gap_s") >= threshold_s)
        .select(
            "site_id",
            F.col("ts").alias("last_event_ts"),
            "seq",
            F.col("next_ts").alias("next_event_ts"),
            "gap_s",
            plus_seconds(F.col("ts"), threshold_s).alias("ts"),
        )
    )


def floor_no_response(
    on_off: DataFrame,
    climate: DataFrame,
    as_of: Column,
    thresholds_s: Mapping[str, float] = NO_RESPONSE_S,
    default_s: float = NO_RESPONSE_DEFAULT_S,
) -> DataFrame:
    """Calls open past the floor's threshold without the temperature rising above its value at the start.

    The highest reading only grows, so looking once at the threshold equals looking at every tick.
    """
    rows = calls_with_readings(on_off, climate).withColumn("threshold_s", by_floor(thresholds_s, default_s))
    warn_at = plus_seconds(F.col("call_ts"), F.col("threshold_s"))
    calls = (
        rows.filter((_open_for(as_of) >= F.col("threshold_s")) & (F.col("ts") <= warn_at))
        .groupBy(*CALL_KEY, "threshold_s")
        .agg(
            F.max(F.when(F.col("is_start"), F.col("seen.current_temp"))).alias("start_temp"),
            F.max("current_temp").alias("highest"),
        )
    )
    return calls.filter(F.col("start_temp").isNotNull() & (F.coalesce("highest", "start_temp") <= F.col("start_temp"))).select(
        "site_id",
        "entity_id",
        "floor",
        warn_at.alias("ts"),
        F.col("call_seq").alias("seq"),
        F.col("call_ts").alias("call_start_time"),
        F.round(F.col("threshold_s") / 60, 2).alias("minutes_elapsed"),
        "start_temp",
        F.greatest("start_temp", "highest").alias("current_temp"),
        F.lit("high").alias("severity"),
    )


def short_calls(furnace_sessions: DataFrame, threshold_s: float = SHORT_CALL_S) -> DataFrame:
    """Furnace sessions of positive duration below the threshold."""
    return furnace_sessions.filter((F.col("duration_s") > 0) & (F.col("duration_s") < threshold_s)).withColumn(
        "threshold_s", F.lit(threshold_s).cast("long")
    )


def _groups(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of sorted rows with equal values in ``names``, batch borders aside."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        codes = [batch.column(n).dictionary_encode() for n in names]
        numbers = np.stack([c.indices.to_numpy() for c in codes]) if batch.num_rows else np.zeros((len(names), 0), int)
        change = np.flatnonzero((numbers[:, 1:] != numbers[:, :-1]).any(axis=0)) + 1
        for low, high in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            if low == high:
                continue
            mine = tuple(batch.column(n)[low].as_py() for n in names)
            if mine != key and held:
                yield key, held
                held = []
            key = mine
            held.append(batch.slice(low, high - low))
    if held:
        yield key, held


def block_exits(times: np.ndarray, start: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the chain of sent alerts leaves a block, by where it enters.

    ``times`` are the block's alert times in order, ``start`` its beginning. A chain from before the block enters at an alert of the
    block's first ``step`` or at the first one after. Returns the last entries that lead to the same exit, these exits, and how many alerts come after each.
    """
    n = len(times)
    following = np.searchsorted(times, times + step)
    last = np.where(following == n, np.arange(n), np.minimum(following, n - 1))
    while True:  # doubling: twice as many alerts ahead each turn
        ahead = last[last]
        if (ahead == last).all():
            break
        last = ahead
    entries = np.arange(min(int(np.searchsorted(times, start + step)) + 1, n))
    exits = last[entries]
    kept = np.append(np.flatnonzero(exits[1:] != exits[:-1]), len(exits) - 1)
    return times[entries[kept]], times[exits[kept]], n - 1 - exits[kept]


def throttle(alerts: DataFrame, keys: Sequence[str] = ("site_id", "kind"), interval_s: float = ALERT_INTERVAL_S, block: int = 64) -> DataFrame:
    """Mark the alerts that are sent: the first one, then the first at least ``interval_s`` after the last sent.

    Whether an alert is sent depends on the last one *sent*, which no window frame can express. The time line of a key is cut into blocks of
    ``block`` intervals that many tasks follow at once: each finds where a chain of sent alerts leaves the block for every place where
    it may enter, by doubling along "the next alert an interval later". These are few, as chains soon meet. One pass over them, a row per block,
    tells where the chain enters each block, and then the blocks are marked, again all at once. Keys are compared as text in which null is a value
    of its own.
    """
    step = int(interval_s * 1_000_000)
    if step <= 0:
        return alerts.withColumns({"sent": F.lit(True), "suppressed_before": F.lit(0).cast("long")})
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in alerts.schema.fields)
    at = F.unix_micros("ts")
    keyed = alerts.withColumns({"_key": F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), "_at": at, "_block": F.floor(at / F.lit(step * block))})

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, number), parts in _groups(batches, ("_key", "_block")):
            times = np.concatenate([p.column("_at").to_numpy() for p in parts])
            entries, exits, after = block_exits(times, number * step * block, step)
            columns = [pa.array([key]), pa.array([number]), pa.array([len(times)]), *[pa.array([x.tolist()], pa.list_(pa.int64())) for x in (entries, exits, after)]]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "_block", "n", "entries", "exits", "after"])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, held = None, None, 0
        for batch in batches:
            before, waiting = [], []
            for row in batch.to_pylist():
                if row["_key"] != key:
                    key, last, held = row["_key"], None, 0
                before.append(last)
                waiting.append(held)
                i = 0 if last is None else int(np.searchsorted(row["entries"], last + step))
                if i < len(row["entries"]):
                    # the first alert of all enters by itself
                    last, held = (row["exits"][i], row["after"][i])
                else:
                    held += row["n"]
            columns = [batch.column("_key"), batch.column("_block"), pa.array(before, pa.int64()), pa.array(waiting, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["_key", "_block", "_last", "_held"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _groups(batches, ("_key", "_block")):
            last, held = parts[0].column("_last")[0].as_py(), parts[0].column("_held")[0].as_py()
            for part in parts:
                times = part.column("_at").to_numpy()
                sent, before = np.zeros(len(times), bool), np.zeros(len(times), np.int64)
                place = 0
                while place < len(times):
                    go = place if last is None else int(np.searchsorted(times, last + step))
                    go = max(go, place)
                    held += min(go, len(times)) - place
                    if go < len(times):
                        sent[go], before[go] = True, held
                        last, held = int(times[go]), 0
                    place = go + 1
                named = [c for c in part.schema.names if not c.startswith("_")]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in named], pa.array(sent), pa.array(before)], [*named, "sent", "suppressed_before"])

    blocks = ["_key", "_block"]
    exits = keyed.select(*blocks, "_at").repartition(*blocks).sortWithinPartitions(*blocks, "_at")
    exits = exits.mapInArrow(leave, "_key string, _block bigint, n bigint, entries array<bigint>, exits array<bigint>, after array<bigint>")
    entries = exits.repartition("_key").sortWithinPartitions(*blocks).mapInArrow(enter, "_key string, _block bigint, _last bigint, _held bigint")
    return (
        keyed.join(entries.hint("merge"), blocks)
        .repartition(*blocks)
        .sortWithinPartitions(*blocks, "ts", "seq")
        .mapInArrow(mark, f"{out}, sent boolean, suppressed_before bigint")
    )


def late_alerts(alerts: DataFrame, sent_at: Column, limit_s: float = LATE_ALERT_S) -> DataFrame:
    """Flag alerts sent more than ``limit_s`` after (or before) the event they report."""
    lag = F.abs((F.unix_micros(sent_at) - F.unix_micros("ts")) / 1_000_000)
    return alerts.withColumn("late", F.coalesce(lag > limit_s, F.lit(False)))


def warnings_log(parts: Mapping[str, DataFrame]) -> DataFrame:
    """All warnings as ``(site_id, kind, ts, floor)``; the mapping names the kinds."""
    out = None
    for kind, rows in parts.items():
        floor = F.col("floor") if "floor" in rows.columns else F.lit(None).cast("string")
        part = rows.select("site_id", F.lit(kind).alias("kind"), "ts", "seq", floor.alias("floor"))
        out = part if out is None else out.unionByName(part)
    return out


def warnings_daily(warnings: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Warning counts per site and day, one column per kind."""
    return warnings.groupBy("site_id", F.to_date("ts").alias("date")).agg(
        *[F.count_if(F.col("kind") == k).alias(k) for k in kinds]
    )

"""Views composed of several operators: lookback window, recent sessions and warnings, context roll-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.skew import keyed_join
from emberline.schema import (
    FLOOR_DAILY,
    FLOORS,
    FURNACE_DAILY,
    LONG_CALL,
    NO_RESPONSE,
    RUNTIME_ANOMALY,
    SESSION_ENDED,
    SHORT_CALL,
    SILENCE,
    WARNING_LABELS,
)

# fixed values: the events the context view shows
CONTEXT_EVENTS = (
    SESSION_ENDED,
    FURNACE_DAILY,
    FLOOR_DAILY,
    LONG_CALL,
    SHORT_CALL,
    NO_RESPONSE,
    RUNTIME_ANOMALY,
    SILENCE,
)


def lookback(as_of: Column, hours: float) -> Column:
    return F.timestamp_micros(F.unix_micros(as_of) - F.lit(int(hours * 3_600_000_000)))


def context_events(log: DataFrame, as_of: Column, hours: float, events: Sequence[str] = CONTEXT_EVENTS) -> DataFrame:
    """Events of the lookback window, which ends at ``as_of``, and the day summaries of the day before it."""
    since = lookback(as_of, hours)
    summary = F.col("event_type").isin(FURNACE_DAILY, FLOOR_DAILY) & (F.col("date") == F.date_sub(F.to_date(since), 1))
    return log.filter(F.col("event_type").isin(*events) & (F.col("ts").between(since, as_of) | F.coalesce(summary, F.lit(False))))


def recent_sessions(sessions: DataFrame, n: int = 8) -> DataFrame:
    """The newest ``n`` sessions per site. The rank limit is applied before the shuffle as well as after it."""
    newest = Window.partitionBy("site_id").orderBy(F.col("ts").desc(), F.col("seq").desc())
    return sessions.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= n)


def recent_warnings(
    log: DataFrame, as_of: Column, hours: float, labels: Mapping[str, str] = WARNING_LABELS
) -> DataFrame:
    """Warnings of the lookback window with their labels, newest first within the site's rank."""
    label = None
    for kind, text in labels.items():
        test = F.col("event_type") == kind
        label = F.when(test, text) if label is None else label.when(test, text)
    rows = log.filter(F.col("event_type").isin(*labels) & F.col("ts").between(lookback(as_of, hours), as_of))
    return rows.withColumn("label", label)


def context_rollup(
    snapshot: DataFrame, live: DataFrame, furnace_days: DataFrame, as_of: Column, hours: float, floors: Sequence[str] = FLOORS
) -> DataFrame:
    """Per site: current state, today so far, yesterday, and the older days of the window, one row per section.

    Sections are stacked and not joined, so each keeps its own rows and no site is shuffled twice.
    """
    today, first = F.to_date(as_of), F.date_sub(F.to_date(lookback(as_of, hours)), 1)
    runtimes = [f"{f}_runtime_s" for f in floors]
    current = snapshot.withColumns({"section": F.lit("current"), "date": today})
    so_far = live.select(
        "site_id",
        F.lit("today").alias("section"),
        today.alias("date"),
        F.col("session_count"),
        F.col("furnace_today_s").alias("furnace_runtime_s"),
        *[F.col(f"{f}_today_s").alias(r) for f, r in zip(floors, runtimes)],
    )
    past = furnace_days.filter((F.col("date") >= first) & (F.col("date") < today)).select(
        "site_id",
        F.when(F.col("date") == F.date_sub(today, 1), "yesterday").otherwise("older").alias("section"),
        "date",
        "session_count",
        F.col("total_furnace_runtime_s").alias("furnace_runtime_s"),
        *[F.col(f"runtime_{f}_s").alias(r) for f, r in zip(floors, runtimes)],
        "outdoor_temp_min_f",
        "outdoor_temp_max_f",
        "outdoor_temp_avg_f",
    )
    return current.unionByName(so_far, allowMissingColumns=True).unionByName(past, allowMissingColumns=True)


def restart_tag(outcomes: DataFrame, run_id: Column, full_cycle: Column) -> DataFrame:
    """Tag events up to and including the first full heating cycle of a run as possibly spanning a restart.

    The first full cycle per site and run is found by a map-side-combined minimum; events are then compared with it.
    """
    rows = outcomes.withColumn("run_id", run_id)
    at = F.struct("ts", "seq")
    first = rows.groupBy("site_id", "run_id").agg(F.min(F.when(full_cycle, at)).alias("_first"))
    tagged = keyed_join(rows, first, ["site_id", "run_id"])
    return tagged.withColumn("across_restart", F.col("_first").isNull() | (at <= F.col("_first"))).drop("_first")

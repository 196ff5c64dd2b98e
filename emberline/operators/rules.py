"""Statistical rules: anomalies, efficiency, degradation and time-of-day shifts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.scalars import by_floor, confidence, day_period, iso_week, seconds_between, severity
from emberline.functions.skew import keyed_join
from emberline.schema import LONG_SESSION_DEFAULT_S, LONG_SESSION_S, SHORT_SESSION_S


def floor_runtime_anomaly(
    floor_days: DataFrame, lookback: int = 14, multiplier: float = 1.5, min_history: int = 3, min_mean_s: float = 300
) -> DataFrame:
    """Days whose runtime exceeds ``multiplier`` times the mean of the preceding summaries of the floor."""
    fired = with_runtime_baseline(floor_days, lookback, multiplier, min_history, min_mean_s).filter("fired").drop("fired")
    flat = F.col("baseline_stddev_s") == 0
    z = F.try_divide(F.col("runtime_s") - F.col("baseline_mean_s"), F.col("baseline_stddev_s"))
    return fired.withColumn("confidence", F.when(flat, 0.5).otherwise(confidence(z))).withColumn(
        "severity", F.when(flat, "medium").otherwise(severity(F.col("confidence")))
    )


def with_runtime_baseline(
    floor_days: DataFrame, lookback: int = 14, multiplier: float = 1.5, min_history: int = 3, min_mean_s: float = 300, carry: Sequence[str] = ()
) -> DataFrame:
    """Every day of a floor with the figures of the summaries before it, and whether it ``fired``; the columns ``carry`` stay.

    The window runs over day summaries, at most one row per floor and day.
    """
    prior = Window.partitionBy("site_id", "floor").orderBy("date").rowsBetween(-lookback, -1)
    runtime = F.col("total_runtime_s")
    rows = floor_days.select(
        "site_id",
        "floor",
        "date",
        runtime.alias("runtime_s"),
        F.avg(runtime).over(prior).alias("baseline_mean_s"),
        F.stddev_pop(runtime).over(prior).alias("baseline_stddev_s"),
        F.count(runtime).over(prior).alias("history_count"),
        *carry,
    )
    threshold = F.col("baseline_mean_s") * multiplier
    enough = (F.col("history_count") >= min_history) & (F.col("baseline_mean_s") >= min_mean_s)
    return rows.withColumns({"threshold_s": threshold, "fired": F.coalesce(enough & (F.col("runtime_s") > threshold), F.lit(False))})


def session_duration_anomaly(
    sessions: DataFrame,
    baseline: DataFrame,
    on: Sequence[str] = ("key",),
    short_s: float = SHORT_SESSION_S,
    fallback_s: Mapping[str, float] = LONG_SESSION_S,
    default_s: float = LONG_SESSION_DEFAULT_S,
) -> DataFrame:
    """Sessions that are too short, or longer than 1.5 times the p95 of their key (never below the fallback)."""
    keyed = sessions.filter(F.col("duration_s").isNotNull()).withColumn(
        "key", F.coalesce("floor", "entity_id", F.lit("unknown"))
    )
    limits = baseline.select(*on, F.col("p95").alias("baseline_p95_s"))
    rows = keyed_join(keyed, limits, on, "left")
    least = by_floor(fallback_s, default_s).cast("double")
    limit = F.greatest(F.col("baseline_p95_s") * 1.5, least)
    rows = rows.withColumns({"_short": F.col("duration_s") < short_s, "_limit": limit})
    found = rows.filter(F.col("_short") | (F.col("duration_s") > F.col("_limit")))
    proxy = (F.col("duration_s") - F.col("_limit")) / F.col("_limit")
    return (
        found.withColumn("confidence", F.when(F.col("_short"), 1.0).otherwise(confidence(proxy)))
        .select(
            "site_id",
            "floor",
            "ts",
            "seq",
            "duration_s",
            F.when(F.col("_short"), "short").otherwise("long").alias("finding"),
            F.when(F.col("_short"), F.lit(float(short_s))).otherwise(F.col("_limit")).alias("threshold_s"),
            F.when(~F.col("_short"), F.col("baseline_p95_s")).alias("baseline_p95_s"),
            F.when(F.col("_short"), "short_cycle").otherwise("overheating_risk").alias("likely_cause"),
            "confidence",
        )
        .withColumn("severity", severity(F.col("confidence")))
    )


def cycle_gains(cycles: DataFrame) -> DataFrame:
    """Closed heating cycles as sessions with their temperature gain, the input of the efficiency rule."""
    return cycles.filter("closed").select(
        "site_id",
        "floor",
        F.col("ended_at").alias("ts"),
        seconds_between(F.col("cycle_ts"), F.col("ended_at")).alias("duration_s"),
        (F.col("end_temp") - F.col("start_temp")).alias("temp_delta_f"),
    )


def heating_efficiency(
    gains: DataFrame,
    as_of: Column,
    groups: Sequence[str] = ("site_id", "floor"),
    min_sessions: int = 5,
    min_duration_s: float = 60,
    lookback_days: int | None = 14,
) -> DataFrame:
    """Degrees gained per minute of heating, over sessions that did gain, from midnight ``lookback_days`` ago to ``as_of``."""
    rows = gains.filter((F.col("duration_s") >= min_duration_s) & (F.col("temp_delta_f") > 0) & (F.col("ts") <= as_of))
    if lookback_days is not None:
        rows = rows.filter(F.col("ts") >= F.date_trunc("day", as_of) - F.expr(f"INTERVAL {lookback_days} DAYS"))
    return (
        rows.groupBy(*groups)
        .agg(
            F.count(F.lit(1)).alias("session_count"),
            F.sum("duration_s").alias("_s"),
            F.sum("temp_delta_f").alias("_gain"),
        )
        .filter((F.col("session_count") >= min_sessions) & (F.col("_s") > 0))
        .select(
            *groups,
            F.round(F.col("_gain") / (F.col("_s") / 60), 3).alias("score_f_per_min"),
            "session_count",
            F.round(F.col("_s") / 60, 1).alias("total_runtime_min"),
            F.round("_gain", 1).alias("total_temp_gain_f"),
        )
    )


def efficiency_extremes(scores: DataFrame, group: str = "site_id") -> DataFrame:
    """Least and most efficient floor; a group with one scored floor has no extremes."""
    at = F.struct("score_f_per_min", "floor")
    return (
        scores.groupBy(group)
        .agg(F.min(at).alias("worst"), F.max(at).alias("best"), F.count(F.lit(1)).alias("floors"))
        .filter(F.col("floors") > 1)
        .select(
            group,
            F.col("worst.floor").alias("worst_floor"),
            F.col("worst.score_f_per_min").alias("worst_score"),
            F.col("best.floor").alias("best_floor"),
            F.col("best.score_f_per_min").alias("best_score"),
        )
    )


def split_by_position(
    sessions: DataFrame, group: Sequence[str] = ("site_id",), min_sessions: int = 8
) -> DataFrame:
    """Mark each group's oldest three quarters as baseline, the rest as window; small groups are left out.

    The row at the cut is found by counting: hours first, then the seconds of the hour with the cut, then the instants of its second, at last
    the rows of that instant. So no window ever holds more than counts, or the rows of one instant, and marking is a comparison.
    Rows equal in time and ``seq`` fall on the same side. ``sessions`` is read once per step; hand in a stored table.
    """
    group = list(group)
    total = F.max("_through").over(Window.partitionBy(*group))
    counted = _running_counts(sessions, group, F.date_trunc("hour", "ts")).withColumn("_total", total)
    cut = counted.filter(F.col("_total") >= min_sessions).withColumn("_keep", F.greatest(F.lit(1), F.floor(F.col("_total") * 3 / 4)))
    border = _crossing(cut, group)
    for outer, inner in ((F.date_trunc("hour", "ts"), F.date_trunc("second", "ts")), (F.date_trunc("second", "ts"), F.col("ts"))):
        inside = keyed_join(sessions, border, group).filter(outer == F.col("_border"))
        border = _crossing(_running_counts(inside, [*group, "_keep"], inner, group), group)
    tied = keyed_join(sessions, border, group).filter(F.col("ts") == F.col("_border"))
    at = tied.withColumn("_i", F.row_number().over(Window.partitionBy(*group).orderBy("seq"))).filter(F.col("_i") == F.col("_keep"))
    last = at.select(*group, F.col("ts").alias("_last_ts"), F.col("seq").alias("_last_seq"))
    older = (F.col("ts") < F.col("_last_ts")) | ((F.col("ts") == F.col("_last_ts")) & (F.col("seq") <= F.col("_last_seq")))
    return keyed_join(sessions, last, group).withColumn("part", F.when(older, "baseline").otherwise("window")).drop("_last_ts", "_last_seq")


def _running_counts(rows: DataFrame, keys: Sequence[str], unit: Column, group: Sequence[str] | None = None) -> DataFrame:
    """Rows per unit of time (``_n``), and up to and with it (``_through``)."""
    counts = rows.groupBy(*keys, unit.alias("_unit")).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*(group or keys)).orderBy("_unit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("_through", F.sum("_n").over(along))


def _crossing(counts: DataFrame, group: Sequence[str]) -> DataFrame:
    """The unit of time in which a group's ``_keep``-th row lies, and which row of it that is."""
    before = F.col("_through") - F.col("_n")
    here = counts.filter((F.col("_through") >= F.col("_keep")) & (before < F.col("_keep")))
    return here.select(*group, F.col("_unit").alias("_border"), (F.col("_keep") - before).alias("_keep"))


def time_of_day_shift(
    marked: DataFrame,
    groups: Sequence[str] = ("site_id", "floor"),
    ratio: float = 1.8,
    min_events: int = 8,
    min_window_events: int = 3,
) -> DataFrame:
    """Periods of the day whose share of a floor's sessions grew by ``ratio`` between baseline and window.

    ``marked`` carries ``part`` = baseline or window. A period absent from the baseline has no ratio (null).
    """
    groups = list(groups)
    old, new = F.col("part") == "baseline", F.col("part") == "window"
    counts = (
        marked.withColumn("period", day_period(F.col("ts")))
        .groupBy(*groups, "period")
        .agg(F.count_if(old).alias("historical_count"), F.count_if(new).alias("observed_count"))
    )
    floor = Window.partitionBy(*groups)
    shares = counts.withColumns(
        {
            "historical_total": F.sum("historical_count").over(floor),
            "observed_total": F.sum("observed_count").over(floor),
        }
    ).filter(
        (F.col("historical_total") >= min_events)
        & (F.col("observed_total") > 0)
        & (F.col("observed_count") >= min_window_events)
    )
    rows = shares.withColumns(
        {
            "_now": F.col("observed_count") / F.col("observed_total"),
            "_then": F.col("historical_count") / F.col("historical_total"),
        }
    ).withColumn("_ratio", F.when(F.col("_then") > 0, F.try_divide(F.col("_now"), F.col("_then"))))
    return rows.filter(F.col("_ratio").isNull() | (F.col("_ratio") >= ratio)).select(
        *groups,
        "period",
        F.round("_now", 3).alias("observed_share"),
        F.round("_then", 3).alias("historical_share"),
        F.round("_ratio", 2).alias("ratio"),
        "observed_count",
        "observed_total",
        "historical_count",
        "historical_total",
    )


def efficiency_degradation(
    sessions: DataFrame,
    groups: Sequence[str] = ("site_id", "floor"),
    min_weeks: int = 3,
    min_events_per_week: int = 3,
    slope_s_per_week: float = 60.0,
) -> DataFrame:
    """Floors whose weekly mean duration rises: a slope over the week index and no fall in the last three weeks.

    Sessions are reduced to one row per floor and ISO week before anything is ordered.
    """
    groups = list(groups)
    weekly = (
        sessions.filter(F.col("duration_s").isNotNull())
        .groupBy(*groups, iso_week(F.col("ts")).alias("week"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("duration_s").alias("mean_s"))
        .filter(F.col("n") >= min_events_per_week)
    )
    along = Window.partitionBy(*groups).orderBy("week")
    rows = weekly.withColumns(
        {
            "i": F.row_number().over(along) - 1,
            "left": F.count(F.lit(1)).over(Window.partitionBy(*groups)) - F.row_number().over(along),
            "fell": F.coalesce(F.col("mean_s") < F.lag("mean_s").over(along), F.lit(False)),
        }
    )
    trend = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("weeks_analysed"),
        F.coalesce(F.regr_slope("mean_s", "i"), F.lit(0.0)).alias("slope"),
        F.max(F.when((F.col("left") < 2) & F.col("fell"), F.lit(True))).isNotNull().alias("fell"),
        F.min("week").alias("earliest_week"),
        F.max("week").alias("latest_week"),
        F.array_sort(F.collect_list(F.struct("week", F.round("mean_s", 1).alias("mean_s")))).alias("weeks"),
    )
    return trend.filter(
        (F.col("weeks_analysed") >= min_weeks) & (F.col("slope") >= slope_s_per_week) & ~F.col("fell")
    ).select(
        *groups,
        F.round("slope", 1).alias("slope_s_per_week"),
        "weeks_analysed",
        "weeks.week",
        F.col("weeks.mean_s").alias("weekly_mean_s"),
        "earliest_week",
        "latest_week",
    ).withColumnRenamed("week", "week_keys")


def insights(efficiency: DataFrame, degradation: DataFrame, shift: DataFrame) -> DataFrame:
    """All findings as one table."""
    return (
        efficiency.withColumn("insight", F.lit("heating_efficiency"))
        .unionByName(degradation.withColumn("insight", F.lit("efficiency_degradation")), allowMissingColumns=True)
        .unionByName(shift.withColumn("insight", F.lit("time_of_day_shift")), allowMissingColumns=True)
    )

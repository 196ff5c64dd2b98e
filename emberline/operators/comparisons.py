"""Week over week, trends, correlations, reconciliation and duration baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.scalars import correlation, correlation_label, percent_change
from emberline.schema import FLOORS


def latest_wins(rows: DataFrame, keys: Sequence[str], seq: str = "seq") -> DataFrame:
    """One row per key, the one with the highest ``seq``; partial aggregation runs before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(seq)).alias("_r"))
    return newest.select(*keys, "_r.*")


def stored(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored summaries as read: where they carry a ``seq``, the latest of a repeated key counts."""
    return latest_wins(rows, keys) if "seq" in rows.columns else rows


def distinct_dates(rows: DataFrame) -> DataFrame:
    return rows.select("site_id", "date").distinct()


def weekly_comparison(furnace_days: DataFrame, floors: Sequence[str] = FLOORS) -> DataFrame:
    """The last seven days with data against the seven before, per site; sites below seven days are left out.

    Day summaries are one row per site and day, so the ranking window holds days, not events.
    """
    recent = Window.partitionBy("site_id").orderBy(F.col("date").desc())
    ranked = stored(furnace_days, ["site_id", "date"]).withColumn("_r", F.dense_rank().over(recent)).filter(F.col("_r") <= 14)
    weeks = {"this": F.col("_r") <= 7, "last": F.col("_r") > 7}
    aggs = [F.max("_r").alias("_days")]
    for week, test in weeks.items():
        pick = lambda c, test=test: F.when(test, F.col(c))
        days = F.count_if(test)
        aggs += [
            days.alias(f"{week}_days"),
            F.coalesce(F.sum(pick("total_furnace_runtime_s")), F.lit(0)).alias(f"{week}_furnace_s"),
            F.coalesce(F.sum(pick("session_count")), F.lit(0)).alias(f"{week}_sessions"),
            F.avg(pick("outdoor_temp_avg_f")).alias(f"{week}_outdoor_avg_f"),
        ]
        for f in floors:
            mean = F.coalesce(F.sum(pick(f"runtime_{f}_s")), F.lit(0)) / F.nullif(days, F.lit(0))
            aggs += [
                F.coalesce(mean, F.lit(0.0)).alias(f"{week}_{f}_daily_s"),
                F.avg(pick(f"setpoint_{f}_f")).alias(f"{week}_{f}_setpoint_f"),
            ]
    out = ranked.groupBy("site_id").agg(*aggs).filter(F.col("_days") >= 7).drop("_days")
    growth = {
        "furnace_pct": percent_change(F.col("last_furnace_s"), F.col("this_furnace_s")),
        "sessions_pct": percent_change(F.col("last_sessions"), F.col("this_sessions")),
        **{f"{f}_pct": percent_change(F.col(f"last_{f}_daily_s"), F.col(f"this_{f}_daily_s")) for f in floors},
        "partial": F.col("last_days") < 7,
    }
    if "floor_2" in floors:
        growth["floor_2_up"] = F.col("this_floor_2_daily_s") > F.col("last_floor_2_daily_s")
    return out.withColumns(growth)


def runtime_trend(
    floor_days: DataFrame, end: Column, days: int = 14, floors: Sequence[str] = FLOORS
) -> DataFrame:
    """Date by floor runtime over the last ``days`` days up to ``end``, days without data shown empty.

    Empty days after a site's newest day are dropped. The outdoor value is the first floor's that has one.
    """
    start = F.date_sub(end, days - 1)
    rows = floor_days.filter(F.col("date").between(start, end))
    wide = rows.groupBy("site_id", "date").agg(
        *[F.max(F.when(F.col("floor") == f, F.col("total_runtime_s"))).alias(f"{f}_s") for f in floors],
        F.coalesce(
            *[F.max(F.when(F.col("floor") == f, F.col("outdoor_temp_avg_f"))) for f in floors]
        ).alias("outdoor_temp_f"),
    )
    # every day up to the next day with data repeats as an empty day: the spine needs no second table
    along = Window.partitionBy("site_id").orderBy("date")
    before = F.coalesce(F.date_add(F.lag("date").over(along), 1), start)
    spread = wide.withColumn("_from", before).withColumn("_day", F.explode(F.sequence("_from", "date")))
    own = F.col("_day") == F.col("date")
    return spread.select(
        "site_id",
        F.col("_day").alias("date"),
        *[F.when(own, F.col(c)).alias(c) for c in (*[f"{f}_s" for f in floors], "outdoor_temp_f")],
    )


def floor_trend(floor_days: DataFrame, floor: str, end: Column, days: int = 14) -> DataFrame:
    """Single-floor detail of the trend."""
    return floor_days.filter(
        (F.col("floor") == floor) & F.col("date").between(F.date_sub(end, days - 1), end)
    ).select("site_id", "date", "total_calls", "total_runtime_s", "avg_duration_s", "max_duration_s", "outdoor_temp_avg_f")


def temp_correlation(floor_days: DataFrame) -> DataFrame:
    """Pearson r of the day's outdoor average and the floor's runtime."""
    days = stored(floor_days, ["site_id", "floor", "date"])
    known = days.filter(F.col("outdoor_temp_avg_f").isNotNull() & F.col("total_runtime_s").isNotNull())
    out = known.groupBy("site_id", "floor").agg(
        F.count(F.lit(1)).alias("n"), correlation(F.col("outdoor_temp_avg_f"), F.col("total_runtime_s")).alias("r")
    )
    return out.withColumn("label", correlation_label(F.col("r")))


def session_temp_correlation(furnace: DataFrame) -> DataFrame:
    """Pearson r of outdoor temperature and session duration, with the coverage of the data behind it."""
    known = furnace.filter(F.col("duration_s").isNotNull()).withColumn("date", F.to_date("ended_at"))
    has = F.col("outdoor_temp_f").isNotNull()
    out = known.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(has).alias("with_temp"),
        F.count_if(~has).alias("without_temp"),
        F.count_distinct("date").alias("days"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.avg(F.when(has, F.col("duration_s"))).alias("avg_duration_s"),
        F.avg("outdoor_temp_f").alias("avg_outdoor_f"),
        correlation(F.col("outdoor_temp_f"), F.col("duration_s")).alias("r"),
    )
    return out.withColumn("label", correlation_label(F.col("r")))


def reconcile_daily(summaries: DataFrame, calls: DataFrame) -> DataFrame:
    """Day totals against totals recomputed from calls: pairs and days checked, and each mismatch with its delta.

    Only days with a summary are compared, its latest version; a summary without calls compares with zero.
    """
    raw = _raw_totals(calls)
    joined = stored(summaries, ["site_id", "floor", "date"]).select("site_id", "floor", "date", F.col("total_runtime_s").alias("summary_s")).join(
        raw, ["site_id", "floor", "date"], "left"
    )
    checked = joined.withColumn("raw_s", F.coalesce("raw_s", F.lit(0)))
    return checked.withColumns(
        {"delta_s": F.col("summary_s") - F.col("raw_s"), "mismatch": F.col("summary_s") != F.col("raw_s")}
    )


def reconcile_totals(checked: DataFrame) -> DataFrame:
    return checked.groupBy("site_id").agg(
        F.count_distinct("date").alias("days_checked"),
        F.count(F.lit(1)).alias("pairs_checked"),
        F.count_if("mismatch").alias("mismatches"),
        F.sum(F.abs("delta_s")).alias("abs_delta_s"),
    )


def _raw_totals(calls: DataFrame) -> DataFrame:
    return (
        calls.filter(F.col("duration_s").isNotNull())
        .groupBy("site_id", "floor", F.to_date("ended_at").alias("date"))
        .agg(F.sum("duration_s").alias("raw_s"))
    )


def unreconciled_days(summaries: DataFrame, calls: DataFrame) -> DataFrame:
    """Days with calls of known duration and no summary yet."""
    return distinct_dates(_raw_totals(calls)).join(distinct_dates(summaries), ["site_id", "date"], "left_anti")


def duration_baseline(sessions: DataFrame, keys: Sequence[str] = ("site_id", "key")) -> DataFrame:
    """Exact duration statistics per key, percentiles by linear interpolation.

    Durations are first counted per value with map-side combine, so the percentile buffer of the largest key holds
    distinct whole seconds and not sessions.
    """
    key = F.coalesce("floor", "entity_id", F.lit("unknown"))
    counts = (
        sessions.filter(F.col("duration_s").isNotNull())
        .withColumn("key", key)
        .groupBy(*keys, "duration_s")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    stats = counts.groupBy(*keys).agg(
        F.sum("n").alias("count"),
        F.min("duration_s").alias("min"),
        F.max("duration_s").alias("max"),
        F.percentile("duration_s", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.95)), F.col("n")).alias("_p"),
    )
    at = lambda i: F.round(F.col("_p")[i], 6)
    return stats.select(*keys, "count", "min", "max", at(0).alias("median"), at(1).alias("p75"), at(2).alias("p95"))


SKETCH_K = 800


def rank_error(k: int = SKETCH_K) -> float:
    """By how much of all rows the rank of a quantile from a sketch may be off, with a certainty of 99 %."""
    return 2.296 / k**0.9723


def duration_sketches(sessions: DataFrame, keys: Sequence[str] = ("site_id", "key"), k: int = SKETCH_K) -> DataFrame:
    """Durations of each key and day as a mergeable sketch of a few KB, with count, least and largest: what a store keeps.

    A day that changed is sketched anew by itself; ``merged_baseline`` puts any days together without their sessions.
    """
    key = F.coalesce("floor", "entity_id", F.lit("unknown"))
    known = sessions.filter(F.col("duration_s").isNotNull()).withColumns({"key": key, "date": F.to_date("ts")})
    return known.groupBy(*keys, "date").agg(
        F.count(F.lit(1)).alias("count"), F.min("duration_s").alias("min"), F.max("duration_s").alias("max"), F.kll_sketch_agg_bigint("duration_s", F.lit(k)).alias("sketch")
    )


def merged_baseline(sketches: DataFrame, keys: Sequence[str] = ("site_id", "key")) -> DataFrame:
    """Duration statistics over stored days; ranks of the percentiles are off by ``rank_error`` at most, the rest is exact."""
    merged = sketches.groupBy(*keys).agg(
        F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_bigint("sketch").alias("_s")
    )
    at = lambda q: F.kll_sketch_get_quantile_bigint("_s", F.lit(q))
    return merged.select(*keys, "count", "min", "max", at(0.5).alias("median"), at(0.75).alias("p75"), at(0.95).alias("p95"))

"""Daily and monthly roll-ups, range summaries, duty cycle and the live view."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalars import mean, seconds_between
from emberline.functions.timeline import scan
from emberline.operators.comparisons import stored
from emberline.schema import FLOORS, WARNING_KINDS

DAY = ("site_id", "date")


def active_days(observations: DataFrame) -> DataFrame:
    """Days on which a site observed anything; a day without events has no summary.

    Days repeat: the summaries group by day anyway, and their map-side aggregation removes the repeats before the
    shuffle, which a separate ``distinct`` would pay for twice.
    """
    return observations.select("site_id", F.to_date("ts").alias("date"))


def _facts(**parts: DataFrame) -> DataFrame:
    """Rows of several streams as one narrow fact table, so that all day figures come from one aggregation."""
    out = None
    for name, rows in parts.items():
        if rows is None:
            continue
        part = rows.withColumn("fact", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _calls_part(calls: DataFrame) -> DataFrame:
    return calls.select("site_id", F.to_date("ts").alias("date"), "floor", "duration_s")


def _outdoor_part(outdoor: DataFrame) -> DataFrame:
    return outdoor.select("site_id", F.to_date("ts").alias("date"), "temperature_f")


def floor_daily_summary(
    calls: DataFrame, outdoor: DataFrame, days: DataFrame, floors: Sequence[str] = FLOORS
) -> DataFrame:
    """Calls per site, day and floor; idle floors of an active day get zero rows.

    A call counts wholly on the day it ends. One aggregation on (site, day), then the floors are unfolded.
    """
    facts = _facts(day=days, call=_calls_part(calls), outdoor=_outdoor_part(outdoor))
    aggs = []
    for f in floors:
        mine = (F.col("fact") == "call") & (F.col("floor") == f)
        aggs += [
            F.count_if(mine).alias(f"n_{f}"),
            F.sum(F.when(mine, F.col("duration_s"))).alias(f"s_{f}"),
            F.max(F.when(mine, F.col("duration_s"))).alias(f"m_{f}"),
        ]
    daily = facts.groupBy(*DAY).agg(mean(F.col("temperature_f")).alias("outdoor"), *aggs)
    unfolded = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("floor"),
                    F.col(f"n_{f}").alias("total_calls"),
                    F.coalesce(f"s_{f}", F.lit(0)).alias("total_runtime_s"),
                    F.col(f"m_{f}").alias("max_duration_s"),
                )
                for f in floors
            ]
        )
    )
    average = F.when(F.col("total_calls") > 0, F.round(F.col("total_runtime_s") / F.col("total_calls"), 1))
    return daily.select(*DAY, F.round("outdoor", 1).alias("outdoor_temp_avg_f"), unfolded).select(
        "site_id", "floor", "date", "total_calls", "total_runtime_s", average.alias("avg_duration_s"), "max_duration_s",
        "outdoor_temp_avg_f",
    )


def setpoint_samples(climate_all: DataFrame) -> DataFrame:
    """The setpoint in force at every thermostat row; a row without attributes repeats the last one.

    ``climate_all`` is the thermostat observations as they came, attribute-free rows included.
    """
    a = F.col("attributes")
    given = a["temperature"].isNotNull() | a["current_temperature"].isNotNull() | a["hvac_action"].isNotNull()
    rows = scan(
        climate_all, ["site_id", "entity_id"], latest={"_sp": F.when(given, F.struct(a["temperature"].alias("v")))}
    )
    return rows.select("site_id", "floor", "ts", F.col("_sp.v").alias("setpoint")).filter(F.col("setpoint").isNotNull())


def furnace_daily_summary(
    furnace: DataFrame,
    calls: DataFrame,
    outdoor: DataFrame,
    days: DataFrame | None = None,
    setpoints: DataFrame | None = None,
    warnings: DataFrame | None = None,
    floors: Sequence[str] = FLOORS,
    kinds: Sequence[str] = WARNING_KINDS,
) -> DataFrame:
    """One wide row per site and day: furnace, floors, outdoor temperature, setpoints and warnings."""
    facts = _facts(
        day=days,
        furnace=furnace.select("site_id", F.to_date("ts").alias("date"), "duration_s"),
        call=_calls_part(calls),
        outdoor=_outdoor_part(outdoor),
        setpoint=None if setpoints is None else setpoints.select("site_id", F.to_date("ts").alias("date"), "floor", "setpoint"),
        warning=None if warnings is None else warnings.select("site_id", F.to_date("ts").alias("date"), "kind"),
    )
    return daily_figures(facts, floors, kinds, days is not None, setpoints is not None, warnings is not None)


def daily_figures(
    facts: DataFrame,
    floors: Sequence[str] = FLOORS,
    kinds: Sequence[str] = WARNING_KINDS,
    active_only: bool = True,
    setpoints: bool = False,
    warnings: bool = False,
) -> DataFrame:
    """The wide row per site and day from ``(site_id, date, fact, floor, duration_s, temperature_f[, setpoint][, kind])``, one aggregation.

    ``active_only`` leaves out days without a fact ``day``.
    """
    is_furnace, is_call = F.col("fact") == "furnace", F.col("fact") == "call"
    aggs = [
        F.coalesce(F.sum(F.when(is_furnace, F.col("duration_s"))), F.lit(0)).alias("total_furnace_runtime_s"),
        F.count_if(is_furnace).alias("session_count"),
        F.round(F.min("temperature_f"), 6).alias("outdoor_temp_min_f"),
        F.round(F.max("temperature_f"), 6).alias("outdoor_temp_max_f"),
        F.round(mean(F.col("temperature_f")), 1).alias("outdoor_temp_avg_f"),
    ]
    for f in floors:
        mine = is_call & (F.col("floor") == f)
        aggs += [
            F.coalesce(F.sum(F.when(mine, F.col("duration_s"))), F.lit(0)).alias(f"runtime_{f}_s"),
            F.count_if(mine).alias(f"sessions_{f}"),
        ]
    none = F.lit(None).cast("double")
    for f in floors:
        value = F.round(mean(F.when(F.col("floor") == f, F.col("setpoint"))), 1) if setpoints else F.first(none)
        aggs.append(value.alias(f"setpoint_{f}_f"))
    for k in kinds if warnings else ():
        aggs.append(F.count_if(F.col("kind") == k).alias(f"warn_{k}"))
    daily = facts.groupBy(*DAY).agg(F.max(F.when(F.col("fact") == "day", F.lit(True))).alias("_active"), *aggs)
    if active_only:
        daily = daily.filter("_active")
    return daily.drop("_active")


def day_summary(saved: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Stored day summaries where they exist, else the figures recomputed from the events of the day."""
    missing = recomputed.join(saved.select(*DAY), list(DAY), "left_anti")
    return saved.withColumn("source", F.lit("stored")).unionByName(missing.withColumn("source", F.lit("recomputed")))


def monthly_summary(furnace_days: DataFrame, floors: Sequence[str] = FLOORS, kinds: Sequence[str] = WARNING_KINDS) -> DataFrame:
    """Calendar-month figures over day summaries; the outdoor average is the average of day averages."""
    sums = ["total_furnace_runtime_s", "session_count"]
    sums += [f"{m}_{f}{u}" for f in floors for m, u in (("runtime", "_s"), ("sessions", ""))]
    sums += [f"warn_{k}" for k in kinds]
    return (
        stored(furnace_days, ["site_id", "date"]).groupBy("site_id", F.trunc("date", "MM").alias("_first"))
        .agg(
            F.count(F.lit(1)).alias("day_count"),
            *[F.sum(c).alias(c) for c in sums],
            F.round(mean(F.col("outdoor_temp_avg_f")), 1).alias("outdoor_avg_f"),
            F.round(F.min("outdoor_temp_min_f"), 1).alias("outdoor_min_f"),
            F.round(F.max("outdoor_temp_max_f"), 1).alias("outdoor_max_f"),
        )
        .select(
            "site_id",
            F.date_format("_first", "yyyy-MM").alias("month"),
            F.dayofmonth(F.last_day("_first")).alias("days_in_month"),
            "day_count",
            *sums,
            "outdoor_avg_f",
            "outdoor_min_f",
            "outdoor_max_f",
        )
    )


def range_runtime_summary(floor_days: DataFrame, start: Column, end: Column) -> DataFrame:
    """Per floor over an inclusive date range: days, total, whole-second average and longest day."""
    days = F.count_distinct("date")
    return (
        floor_days.filter(F.col("date").between(start, end))
        .groupBy("site_id", "floor")
        .agg(
            days.alias("days"),
            F.sum("total_runtime_s").alias("total_s"),
            F.max("total_runtime_s").alias("max_s"),
        )
        .withColumn("avg_s", F.floor(F.col("total_s") / F.col("days")))
    )


def parse_bound(text: str, end_of_day: bool = False) -> datetime:
    """A window bound from ``YYYY-MM-DD`` or ``YYYY-MM-DDTHH:MM[:SS]``; a date-only end means 23:59:59."""
    at = datetime.fromisoformat(text)
    return at + timedelta(days=1, seconds=-1) if end_of_day and len(text) == 10 else at


def duty_cycle(furnace: DataFrame, start: str, end: str, sites: DataFrame | None = None) -> DataFrame:
    """Share of the window the furnace was on; sessions are clipped to the window, unknown durations are left out.

    Every site of ``sites`` gets a row, those without a session in the window one of zeros.
    """
    low, high = parse_bound(start), parse_bound(end, end_of_day=True)
    length = (high - low).total_seconds()
    lo, hi = (F.lit(t.isoformat(" ")).cast("timestamp") for t in (low, high))
    began = F.timestamp_micros(F.unix_micros("ended_at") - F.col("duration_s") * 1_000_000)
    inside = (
        furnace.filter(F.col("duration_s").isNotNull() & (F.col("ended_at") > lo))
        .withColumn("began", began)
        .filter(F.col("began") < hi)
    )
    on = (F.unix_micros(F.least("ended_at", hi)) - F.unix_micros(F.greatest("began", lo))) / 1_000_000
    clipped = inside.withColumn("on_s", on).filter(F.col("on_s") > 0).select("site_id", "on_s", "duration_s")
    if sites is not None:
        clipped = clipped.unionByName(sites.select("site_id").distinct(), allowMissingColumns=True)
    total = F.coalesce(F.sum("on_s"), F.lit(0.0))
    return clipped.groupBy("site_id").agg(
        F.count("on_s").alias("session_count"),
        total.alias("total_on_s"),
        F.lit(length).alias("window_duration_s"),
        (total / length * 100).alias("duty_cycle_pct"),
        F.count_if(F.col("on_s") < F.col("duration_s")).alias("clipped_count"),
    )


def duty_cycle_windows(furnace: DataFrame, windows: DataFrame, bucket_s: int = 86400, on: Sequence[str] = ()) -> DataFrame:
    """Share of each window of a table the furnace was on, by site; pairs without a common moment have no row.

    ``windows`` is ``window_id, start, end`` (timestamps, the end excluded), with the columns ``on`` where a window is for some rows only. Sessions
    and windows are dealt into the buckets of time they touch and meet there by equality; a pair counts in the first bucket both
    touch. Sessions of unknown duration are left out, others clipped to the window.
    """
    on = list(on)
    width = F.lit(int(bucket_s * 1_000_000))
    began = F.unix_micros("ended_at") - F.col("duration_s") * 1_000_000
    touched = lambda low, high: F.sequence(F.floor(low / width), F.floor(F.greatest(low, high - 1) / width))
    sessions = furnace.filter(F.col("duration_s") > 0).select("site_id", *[c for c in on if c != "site_id"], "duration_s", began.alias("_from"), F.unix_micros("ended_at").alias("_to"))
    spans = windows.select("window_id", *on, F.unix_micros("start").alias("_low"), F.unix_micros("end").alias("_high")).filter("_high > _low")
    left = sessions.withColumn("_bucket", F.explode(touched(F.col("_from"), F.col("_to"))))
    right = spans.withColumn("_bucket", F.explode(touched(F.col("_low"), F.col("_high"))))
    first = F.floor(F.greatest("_from", "_low") / width)
    pairs = left.join(right, [*on, "_bucket"]).filter((F.col("_from") < F.col("_high")) & (F.col("_to") > F.col("_low")) & (F.col("_bucket") == first))
    on_us = F.least("_to", "_high") - F.greatest("_from", "_low")
    keys = ["site_id", "window_id"]
    sums = pairs.withColumn("_on", on_us).groupBy(*keys, "_low", "_high").agg(
        F.count(F.lit(1)).alias("session_count"), F.sum("_on").alias("_on"), F.count_if(F.col("_on") < F.col("duration_s") * 1_000_000).alias("clipped_count")
    )
    length = (F.col("_high") - F.col("_low")) / 1_000_000
    total = F.col("_on") / 1_000_000
    return sums.select(*keys, "session_count", total.alias("total_on_s"), length.alias("window_duration_s"), (total / length * 100).alias("duty_cycle_pct"), "clipped_count")


def live_status(
    calls: DataFrame, furnace: DataFrame, open_now: DataFrame, as_of: Column, floors: Sequence[str] = FLOORS, sites: DataFrame | None = None
) -> DataFrame:
    """Runtime of the current day including sessions still in flight at ``as_of``.

    ``calls`` / ``furnace`` are ended sessions, ``open_now`` the open ones of both kinds, all up to ``as_of``. Every site of
    ``sites`` gets a row, idle ones with zeros.
    """
    today = F.to_date("ts") == F.to_date(as_of)
    running = seconds_between(F.col("on_since"), as_of)
    facts = _facts(
        call=calls.filter(today).select("site_id", "floor", "duration_s"),
        furnace=furnace.filter(today).select("site_id", "duration_s"),
        open=open_now.select("site_id", "floor", running.alias("duration_s")),
    )
    if sites is not None:
        facts = facts.unionByName(sites.select("site_id").distinct(), allowMissingColumns=True)

    def part(fact: str, floor: str | None) -> Column:
        return (F.col("fact") == fact) & (F.col("floor").isNull() if floor is None else F.col("floor") == floor)

    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("duration_s"))), F.lit(0))

    aggs = [
        total(part("furnace", None)).alias("furnace_committed_s"),
        total(part("open", None)).alias("furnace_in_flight_s"),
        (F.count_if(F.col("fact") == "furnace") + F.count_if(part("open", None))).alias("session_count"),
    ]
    for f in floors:
        aggs += [total(part("call", f)).alias(f"{f}_committed_s"), total(part("open", f)).alias(f"{f}_in_flight_s")]
    out = facts.groupBy("site_id").agg(*aggs)
    return out.withColumns(
        {"furnace_today_s": F.col("furnace_committed_s") + F.col("furnace_in_flight_s")}
        | {f"{f}_today_s": F.col(f"{f}_committed_s") + F.col(f"{f}_in_flight_s") for f in floors}
    )

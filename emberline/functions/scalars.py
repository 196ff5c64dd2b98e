"""Column expressions: time arithmetic, parsing, labels and scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end``, fractions dropped."""
    return ((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1_000_000)).cast("long")


def plus_seconds(ts: Column, seconds: Column | float) -> Column:
    seconds = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.timestamp_micros(F.unix_micros(ts) + (seconds.cast("double") * 1_000_000).cast("long"))


def by_floor(values: Mapping[str, float], default: float | None = None, floor: str = "floor") -> Column:
    """A per-floor constant; floors outside the mapping get ``default``."""
    out = None
    for name, value in values.items():
        test = F.col(floor) == name
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


FIXED_POINT_END = 9e12
DECIMAL_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def number_of(text: Column) -> Column:
    """Decimal text as a finite number; null for everything else, Java literals such as ``5d`` or ``0x1p3`` included."""
    bare = F.trim(text)
    value = F.when(bare.rlike(DECIMAL_NUMBER), bare.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def numeric_state(state: Column) -> Column:
    """A sensor state as a finite number; null for missing, placeholder and non-numeric states."""
    return number_of(state)


def parse_time(text: Column) -> Column:
    """ISO-8601 text as a timestamp; ``Z`` and offsets are honoured, naive text is UTC, bad text is null."""
    return F.try_to_timestamp(text)


def day_period(ts: Column) -> Column:
    hour = F.hour(ts)
    return F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")


def iso_week(ts: Column) -> Column:
    """ISO week key such as ``2026-W10``."""
    year = F.extract(F.lit("YEAROFWEEK"), ts).cast("string")
    return F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def confidence(z: Column) -> Column:
    """0 up to two deviations, 1 from five on, linear in between."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.abs(z) - 2) / 3))


def severity(score: Column) -> Column:
    return F.when(score <= 0.33, "low").when(score <= 0.66, "medium").otherwise("high")


def percent_change(last: Column, this: Column) -> Column:
    return F.when(last != 0, (this - last) / last * 100.0)


def mean(value: Column) -> Column:
    """Mean of readings in fixed point (six decimals): the sum is exact, so the result does not depend on row order.

    A group with a reading beyond fixed point takes the plain mean, so that no reading fails the job or is left out.
    """
    near = F.when(F.abs(value) < FIXED_POINT_END, value)
    exact = F.sum(F.round(near * 1_000_000).cast("long").cast("decimal(20,0)")).cast("double") / F.nullif(F.count(value), F.lit(0)) / 1_000_000
    return F.when(F.count(near) == F.count(value), exact).otherwise(F.avg(value))


def correlation(x: Column, y: Column) -> Column:
    """Pearson r over the rows where both sides are known; null below two rows or without variance.

    ``corr`` divides by zero on a constant column under ANSI rules, hence the explicit form.
    """
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.when(F.count(x) >= 2, F.try_divide(F.covar_pop(x, y), F.nullif(spread, F.lit(0.0))))


def correlation_label(r: Column) -> Column:
    size = F.abs(r)
    strength = (
        F.when(size >= 0.7, "strong").when(size >= 0.4, "moderate").when(size >= 0.2, "weak").otherwise("negligible")
    )
    return F.when(r.isNotNull(), F.concat_ws(" ", strength, F.when(r > 0, "positive").otherwise("negative")))

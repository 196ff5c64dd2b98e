"""Ordered scans over keyed time lines: previous row, latest known value, running totals.

Every scan runs in the order ``(ts, seq)`` inside its keys. When no key is oversized this is one window per key set.
When a key holds too many rows for one task its time line is cut into *slices*: rows are scanned inside their slice,
each slice is reduced to one row by a map-side-combined aggregate, and the values carried over slice borders come from
a window over those few rows. Slicing changes how the work is spread, never the result, so stale statistics are safe.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ("ts", "seq")
SLICE = "_slice"

ROWS_PER_SLICE = 4_000_000
MAX_SLICES = 8192


def measure_slices(
    df: DataFrame,
    key: str = "site_id",
    ts: str = "ts",
    rows_per_slice: int = ROWS_PER_SLICE,
    max_slices: int = MAX_SLICES,
) -> DataFrame | None:
    """Cut points in time for every oversized key, or ``None`` when there is no such key.

    A key is oversized above ``max(rows_per_slice, all rows / max_slices)`` rows. The cuts over all keys are therefore
    at most ``2 * max_slices``, whatever the size of the table, which is what makes the result safe to broadcast.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total, largest = counts.agg(F.sum("n"), F.max("n")).first()
    if not total:
        return None
    limit = max(rows_per_slice, -(-total // max_slices))
    if largest <= limit:
        return None
    # as many slices as a key's rows need; the largest one sets the resolution, which the limit bounds
    resolution = max(2, -(-largest // limit))
    hot = counts.filter(F.col("n") > limit).withColumn("cuts", F.ceil(F.col("n") / limit).cast("int") - 1)
    hot_keys = [r[0] for r in hot.select(key).collect()]
    steps = [i / resolution for i in range(1, resolution)]
    spread = (
        df.filter(F.col(key).isin(hot_keys))
        .groupBy(key)
        .agg(F.percentile_approx(F.unix_micros(ts), steps, F.lit(max(20_000, 20 * resolution))).alias("q"))
    )
    bounds = hot.join(spread, key).select(
        key,
        F.array_distinct(
            F.expr(f"transform(sequence(1, cuts), i -> q[greatest(cast(i * {resolution} / (cuts + 1) as int), 1) - 1])")
        ).alias("_bounds"),
    )
    rows = [tuple(r) for r in bounds.collect()]
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"{key} {kind}, _bounds array<bigint>")


def with_slices(df: DataFrame, slices: DataFrame | None, ts: str = "ts") -> DataFrame:
    """Add the slice number to the rows of oversized keys (-1 elsewhere); no-op without oversized keys."""
    if slices is None:
        return df
    key = slices.columns[0]
    bounds, at = F.col("_bounds"), F.unix_micros(ts)
    halvings = F.array(*[F.lit(2**p) for p in range(MAX_SLICES.bit_length(), -1, -1)])

    def descend(low: Column, step: Column) -> Column:
        reach = low + step
        return F.when((reach <= F.size(bounds)) & (F.try_element_at(bounds, reach) <= at), reach).otherwise(low)

    number = F.when(bounds.isNull(), F.lit(-1)).otherwise(F.aggregate(halvings, F.lit(0), descend))
    return df.join(F.broadcast(slices), key, "left").withColumn(SLICE, number).drop("_bounds")


def instant() -> Column:
    """Position on a time line as one number.

    Aggregates ordered by a struct fall back to sorting; a decimal keeps them on hash aggregation.
    """
    return F.unix_micros("ts").cast("decimal(18,0)") * F.lit(Decimal(10) ** 19) + F.col("seq").cast("decimal(19,0)")


def keep_slice(df: DataFrame) -> list[str]:
    """The slice column for projections, when the frame carries one."""
    return [SLICE] if SLICE in df.columns else []


def moment(ts: str = "ts", seq: str = "seq") -> Column:
    """Position on a time line, comparable with other positions."""
    return F.struct(F.col(ts).alias("ts"), F.col(seq).alias("seq"))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    *,
    previous: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
    latest: Mapping[str, Column] | None = None,
    running: Mapping[str, Column] | None = None,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Add columns computed along each key's time line.

    ``previous`` / ``following``: the expression on the neighbouring row, nulls kept.
    ``latest``: the last non-null value of the expression up to this row; wrap in a struct to keep null readings.
    ``running``: running total of the expression up to this row.
    """
    previous, following = dict(previous or {}), dict(following or {})
    latest, running = dict(latest or {}), dict(running or {})
    if SLICE not in df.columns:
        along = Window.partitionBy(*keys).orderBy(*order)
        so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        added = {name: F.lag(e).over(along) for name, e in previous.items()}
        added |= {name: F.lead(e).over(along) for name, e in following.items()}
        added |= {name: F.last(e, ignorenulls=True).over(so_far) for name, e in latest.items()}
        added |= {name: F.sum(e).over(so_far) for name, e in running.items()}
        return df.select("*", *[e.alias(name) for name, e in added.items()])
    return _sliced_scan(df, list(keys), previous, following, latest, running, list(order))


def _sliced_scan(df, keys, previous, following, latest, running, order):
    at = F.struct(*order)
    pack = {name: F.struct(e.alias("v")) for name, e in {**previous, **following}.items()}
    summaries, carries = [], []
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(1, Window.unboundedFollowing)
    for name in previous:
        summaries.append(F.max_by(pack[name], at).alias(name))
        carries.append(F.last(name, ignorenulls=True).over(before).alias(f"_c_{name}"))
    for name in following:
        summaries.append(F.min_by(pack[name], at).alias(name))
        carries.append(F.first(name, ignorenulls=True).over(after).alias(f"_c_{name}"))
    for name, e in latest.items():
        summaries.append(F.max_by(e, F.when(e.isNotNull(), at)).alias(name))
        carries.append(F.last(name, ignorenulls=True).over(before).alias(f"_c_{name}"))
    for name, e in running.items():
        summaries.append(F.sum(e).alias(name))
        carries.append(F.sum(name).over(before).alias(f"_c_{name}"))
    carry = (
        df.filter(F.col(SLICE) >= 0)
        .groupBy(*keys, SLICE)
        .agg(*summaries)
        .select(*keys, SLICE, *carries)
    )
    along = Window.partitionBy(*keys, SLICE).orderBy(*order)
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {name: F.lag(pack[name]).over(along) for name in previous}
    local |= {name: F.lead(pack[name]).over(along) for name in following}
    local |= {name: F.last(e, ignorenulls=True).over(so_far) for name, e in latest.items()}
    local |= {name: F.sum(e).over(so_far) for name, e in running.items()}
    names = [*previous, *following, *latest, *running]
    base = df.columns
    rows = df.select("*", *[e.alias(f"_l_{name}") for name, e in local.items()]).join(carry, [*keys, SLICE], "left")

    def merged(name: str) -> Column:
        here, carried = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if name in running:
            return F.when(here.isNotNull() | carried.isNotNull(), F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0)))
        value = F.coalesce(here, carried)
        return value["v"] if name in pack else value

    return rows.select(*base, *[merged(name).alias(name) for name in names])


def as_of(
    rows: DataFrame,
    readings: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, Mapping[str, Column]],
    when: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Attach to each row the latest readings at or before it: one union and one scan, no range join.

    ``values`` names a struct column per reading stream, ``{out: {field: expression}}``; ``when[out]`` says which
    reading rows feed ``out`` (default: all). Null fields of a reading are kept, rows without a reading get null.
    """
    when = when or {}
    packed = {
        name: F.when(when.get(name, F.lit(True)), F.struct(*[e.alias(f) for f, e in fields.items()]))
        for name, fields in values.items()
    }
    right = readings.select(*keys, *ORDER, *keep_slice(readings), *[e.alias(n) for n, e in packed.items()])
    left = rows.withColumn("_asked", F.lit(True))
    both = left.unionByName(right, allowMissingColumns=True)
    seen = scan(both, keys, latest={f"_seen_{name}": F.col(name) for name in packed})
    return (
        seen.filter("_asked")
        .drop("_asked", *packed)
        .withColumnsRenamed({f"_seen_{name}": name for name in packed})
    )

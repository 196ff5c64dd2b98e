"""As-of enrichment: outdoor temperature, other zones calling, thermostat state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalars import seconds_between
from emberline.functions.timeline import as_of, keep_slice
from emberline.schema import FLOORS


def with_outdoor(
    rows: DataFrame, outdoor: DataFrame, scope: str = "day", max_age_s: float | None = None, out: str = "outdoor_temp_f"
) -> DataFrame:
    """Latest outdoor reading at each row's time.

    ``scope='day'`` looks back to the row's UTC midnight only (the time lines are then cut by day as well);
    ``'unbounded'`` looks back without limit. ``max_age_s`` nulls readings older than that.
    """
    reading = {"_o": {"temp": F.col("temperature_f"), "at": F.col("ts")}}
    if scope == "day":
        day = F.to_date("ts")
        found = as_of(rows.withColumn("_day", day), outdoor.withColumn("_day", day), ["site_id", "_day"], reading)
    else:
        found = as_of(rows, outdoor, ["site_id"], reading)
    temp = F.col("_o.temp")
    if max_age_s is not None:
        temp = F.when(seconds_between(F.col("_o.at"), F.col("ts")) <= max_age_s, temp)
    return found.withColumn(out, temp).drop("_o", "_day")


def with_zone_context(rows: DataFrame, on_off: DataFrame, outdoor: DataFrame, floors: Sequence[str] = FLOORS) -> DataFrame:
    """Same-day outdoor temperature and the set of zones calling at each row's time, in one scan per site.

    ``zones`` holds one bit per floor, so that later aggregates stay on fixed-width buffers; see ``zone_names``.
    """
    readings = on_off.select("site_id", "ts", "seq", "floor", "edge", *keep_slice(on_off)).unionByName(
        outdoor.select("site_id", "ts", "seq", "temperature_f", *keep_slice(outdoor)), allowMissingColumns=True
    )
    values = {"_o": {"temp": F.col("temperature_f"), "at": F.col("ts")}}
    when = {"_o": F.col("temperature_f").isNotNull()}
    for i, floor in enumerate(floors):
        values[f"_z{i}"] = {"on": F.col("edge") == "started"}
        when[f"_z{i}"] = F.col("floor") == floor
    found = as_of(rows, readings, ["site_id"], values, when)
    zones = F.lit(0)
    for i in range(len(floors)):
        zones = zones + F.when(F.col(f"_z{i}.on"), F.lit(2**i)).otherwise(F.lit(0))
    same_day = F.to_date("_o.at") == F.to_date("ts")
    return found.withColumns(
        {"outdoor_temp_f": F.when(same_day, F.col("_o.temp")), "zones": zones}
    ).drop("_o", *[f"_z{i}" for i in range(len(floors))])


def zone_names(zones: Column, own: Column, floors: Sequence[str] = FLOORS) -> Column:
    """The zones of a ``zones`` bit set as a sorted array, without ``own``."""
    names = [F.when((zones.bitwiseAND(2**i) != 0) & (own != f), F.lit(f)) for i, f in enumerate(floors)]
    return F.array_sort(F.array_compact(F.array(*names)))

"""The derived tables of a fleet, each built once from the observations and shared by the queries."""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.timeline import SLICE
from emberline.operators import asof, comparisons, edges, gauges, rollups, thermostat
from emberline.plans import derived
from emberline.schema import CALL, CLIMATE, FURNACE, OUTDOOR
from emberline.sources import sinks
from emberline.sources.event_table import PARTS, all_observations, observations
from emberline.sources.scratch import scratch_path

ROWS_PER_SCAN_TASK = 250_000


class Fleet:
    """Lazy derived tables over an event table. ``until`` keeps observations up to a time (filter on the scan)."""

    def __init__(self, events: DataFrame, until=None):
        self.events = events if until is None else events.filter(F.col("ts") <= until)

    def observations(self, *kinds: str) -> DataFrame:
        return observations(self.events, *kinds)

    @cached_property
    def call_edges(self) -> DataFrame:
        return edges.edges(self.observations(CALL), CALL)

    @cached_property
    def furnace_edges(self) -> DataFrame:
        return edges.edges(self.observations(FURNACE), FURNACE)

    @cached_property
    def calls(self) -> DataFrame:
        return edges.sessions(self.call_edges)

    @cached_property
    def stored_calls(self) -> DataFrame:
        """The calls, written once for rules that read them several times."""
        return self._stored(self.calls.drop(SLICE), "calls")

    @cached_property
    def furnace(self) -> DataFrame:
        return edges.sessions(self.furnace_edges)

    @cached_property
    def furnace_with_outdoor(self) -> DataFrame:
        return asof.with_outdoor(self.furnace, self.outdoor)

    @cached_property
    def outdoor(self) -> DataFrame:
        return edges.outdoor_readings(self.observations(OUTDOOR))

    @cached_property
    def climate_observations(self) -> DataFrame:
        return self.observations(CLIMATE)

    @cached_property
    def climate(self) -> DataFrame:
        return thermostat.climate_rows(self.climate_observations)

    @cached_property
    def climate_in_context(self) -> DataFrame:
        return asof.with_zone_context(self.climate, self.call_edges, self.outdoor)

    @cached_property
    def days(self) -> DataFrame:
        """Active days; every event yields a thermostat row, so that kind alone covers all days."""
        return rollups.active_days(self.climate_observations)

    @cached_property
    def floor_days(self) -> DataFrame:
        return rollups.floor_daily_summary(self.calls, self.outdoor, self.days)

    @cached_property
    def setpoints(self) -> DataFrame:
        return rollups.setpoint_samples(self.climate_observations)

    @cached_property
    def furnace_days(self) -> DataFrame:
        return rollups.furnace_daily_summary(self.furnace, self.calls, self.outdoor, self.days, self.setpoints)

    @cached_property
    def gauge_samples(self) -> DataFrame:
        return gauges.gauge_samples(
            self.call_edges, self.furnace_edges, self.furnace, thermostat.changes(self.climate), self.outdoor
        )

    @cached_property
    def scan_tasks(self) -> int:
        """As many tasks as the observations there may be need, and enough to use the cluster."""
        spark = self.events.sparkSession
        least = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        return max(least, math.ceil(self.events.count() * len(PARTS) / ROWS_PER_SCAN_TASK))

    def fused(self) -> DataFrame:
        return derived.timeline(all_observations(self.events), look_up_old=True, parts=self.scan_tasks)

    def _stored(self, rows: DataFrame, name: str) -> DataFrame:
        spark = self.events.sparkSession
        path = scratch_path(spark, name)
        rows.write.parquet(path)
        return spark.read.parquet(path)

    @cached_property
    def timeline(self) -> DataFrame:
        """The fused scan of all observations, written once to the shared folder."""
        return self._stored(self.fused(), "timeline")

    @cached_property
    def lean_timeline(self) -> DataFrame:
        """The part of it that warnings and day figures need, written once."""
        return self._stored(derived.without_context(self.fused()), "lean-timeline")

    def stored_p95(self) -> dict[str, float]:
        """The long end of call durations by floor, from a stored baseline; a row per floor."""
        spark = self.events.sparkSession
        path = scratch_path(spark, "baseline")
        sinks.save_baseline(comparisons.duration_baseline(derived.sessions(self.timeline), keys=["key"]), path)
        return {r["key"]: r["p95"] for r in sinks.load_baseline(spark, path).select("key", "p95").collect()}

    def derived_log(self, as_of, scale: dict) -> DataFrame:
        """Every derived event as one log ``(event_type, site_id, floor, ts, seq, ...)``; ``scale`` names the thresholds."""
        return derived.derived_log(self.timeline, as_of, scale, self.stored_p95())

    def warnings(self, as_of, scale: dict) -> DataFrame:
        """All warning kinds as ``(site_id, kind, ts, seq, floor)``."""
        return derived.warnings(self.lean_timeline, as_of, scale)


def present(df: DataFrame) -> DataFrame:
    """Output layout: dates as ``YYYY-MM-DD`` text, timestamps without zone, integers as bigint, arrays as comma-joined text."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if f.name == SLICE:
            continue
        if kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "timestamp":
            c = c.cast("timestamp_ntz")
        elif kind == "integer":
            c = c.cast("bigint")
        elif kind == "array":
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(f.name))
    return df.select(*out)

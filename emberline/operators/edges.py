"""Entity lookup, sensor parsing, on/off edges and the sessions between them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalars import numeric_state, seconds_between
from emberline.functions.timeline import keep_slice, scan
from emberline.schema import CALL, ENTITIES, FURNACE, OUTDOOR

ENTITY = ("site_id", "entity_id")


def entity_lookup(observations: DataFrame, entities: Mapping[str, tuple[str, str | None]] | DataFrame = ENTITIES) -> DataFrame:
    """Add ``kind`` and ``floor``; unknown entities are dropped.

    A mapping is a fixed naming scheme and becomes a CASE expression. A DataFrame ``(entity_id, kind, floor[, site_id])``
    is joined, and Catalyst broadcasts it only when its measured size allows.
    """
    rows = observations.drop("kind", "floor")
    if isinstance(entities, DataFrame):
        on = ["site_id", "entity_id"] if "site_id" in entities.columns else ["entity_id"]
        return rows.join(entities, on)

    def pick(position: int) -> Column:
        out = F.lit(None).cast("string")
        for entity, value in entities.items():
            out = F.when(F.col("entity_id") == entity, F.lit(value[position])).otherwise(out)
        return out

    return rows.filter(F.col("entity_id").isin(*entities)).withColumns({"kind": pick(0), "floor": pick(1)})


def outdoor_readings(observations: DataFrame) -> DataFrame:
    """Numeric outdoor readings; placeholder and malformed states are dropped."""
    rows = observations.filter(F.col("kind") == OUTDOOR)
    return rows.select(
        "site_id", "entity_id", "ts", "seq", numeric_state(F.col("new_state")).alias("temperature_f"), *keep_slice(rows)
    ).filter(F.col("temperature_f").isNotNull())


def edges(observations: DataFrame, kind: str = CALL) -> DataFrame:
    """``off->on`` and ``on->off`` changes; every other change (such as from ``unavailable``) is ignored."""
    old, new = F.col("old_state"), F.col("new_state")
    started, ended = (old == "off") & (new == "on"), (old == "on") & (new == "off")
    rows = observations.filter((F.col("kind") == kind) & (started | ended))
    return rows.select(
        "site_id", "entity_id", "floor", "ts", "seq", F.when(new == "on", "started").otherwise("ended").alias("edge"),
        *keep_slice(rows),
    )


def sessions(on_off: DataFrame) -> DataFrame:
    """One row per end edge. The start is the edge just before it; without one the duration is unknown."""
    known = F.col("_edge") == "started"
    rows = scan(on_off, ENTITY, previous={"_edge": F.col("edge"), "_at": F.col("ts")})
    return rows.filter(F.col("edge") == "ended").select(
        "site_id",
        "entity_id",
        "floor",
        "ts",
        "seq",
        F.when(known, F.col("_at")).alias("started_at"),
        F.col("ts").alias("ended_at"),
        F.when(known, seconds_between(F.col("_at"), F.col("ts"))).alias("duration_s"),
        *keep_slice(rows),
    )


def calls_until(on_off: DataFrame) -> DataFrame:
    """One row per start edge with the next edge of the entity (null while still open)."""
    rows = scan(on_off, ENTITY, following={"until": F.col("ts"), "until_seq": F.col("seq")})
    return rows.filter(F.col("edge") == "started").drop("edge")


def floor_calls(observations: DataFrame) -> DataFrame:
    return sessions(edges(observations, CALL))


def furnace_calls(observations: DataFrame) -> DataFrame:
    return sessions(edges(observations, FURNACE))


def open_sessions(observations: DataFrame, kind: str = CALL, strict_bootstrap: bool = False) -> DataFrame:
    """Entities that are on now, and since when.

    By default the last edge decides. ``strict_bootstrap`` lets the last row of any state decide, so that a trailing
    ``unavailable`` counts as off.
    """
    if strict_bootstrap:
        rows = observations.filter(F.col("kind") == kind)
        state = (F.col("old_state") == "off") & (F.col("new_state") == "on")
    else:
        rows = edges(observations, kind)
        state = F.col("edge") == "started"
    last = rows.groupBy("site_id", "entity_id", "floor").agg(
        F.max_by(F.struct(F.coalesce(state, F.lit(False)).alias("on"), F.col("ts").alias("since")), F.struct("ts", "seq")).alias("last")
    )
    return last.filter("last.on").select("site_id", "entity_id", "floor", F.col("last.since").alias("on_since"))

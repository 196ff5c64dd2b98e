"""Observations projected from a per-user event table ``events(event_id, ts, user_id, event_type, value, props)``.

A user is a site. One event yields up to four observations, each kind being its own narrow projection of the scan, so
a query that needs one kind reads only the columns of that kind and pushes the event-type filter into the file scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.timeline import SLICE, keep_slice, measure_slices, scan, with_slices
from emberline.schema import CALL, CLIMATE, FURNACE, OBSERVATION, OUTDOOR

EVENTS_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"

# rank of a kind among the observations of one event; makes seq unique inside a site
RANK = {OUTDOOR: 0, CLIMATE: 1, CALL: 2, FURNACE: 3}

_SLICES: dict[tuple[str, str, int], DataFrame | None] = {}


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Scan the event table as ``site_id, event_id, ts, ...``, sliced where a site is oversized."""
    events = spark.read.schema(EVENTS_SCHEMA).parquet(path).withColumnRenamed("user_id", "site_id")
    # a table that has got or lost files is measured again
    known = (spark.sparkContext.applicationId, path, hash(tuple(sorted(events.inputFiles()))))
    if known not in _SLICES:
        _SLICES[known] = measure_slices(events)
    return with_slices(events, _SLICES[known])


def observations(events: DataFrame, *kinds: str, old_state: bool = True) -> DataFrame:
    """Observations of the given kinds (all by default).

    The table has no previous states; they are looked up unless ``old_state`` is off, as it must be on a stream.
    """
    out = None
    for kind in kinds or PARTS:
        part = _shape(events, kind)
        if old_state and kind in (CALL, FURNACE):
            part = _with_old_state(part)
        out = part if out is None else out.unionByName(part)
    return out


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _floor() -> Column:
    return F.concat(F.lit("floor_"), (F.col("event_id") % 3 + 1).cast("string"))


def _fields(kind: str, entity: Column, state: Column, floor=None, attributes=None) -> list[Column]:
    nothing = F.lit(None)
    return [
        (F.col("event_id") * 4 + RANK[kind]).alias("seq"),
        entity.alias("entity_id"),
        F.lit(kind).alias("kind"),
        (nothing.cast("string") if floor is None else floor).alias("floor"),
        nothing.cast("string").alias("old_state"),
        state.alias("new_state"),
        (nothing.cast(OBSERVATION["attributes"].dataType) if attributes is None else attributes).alias("attributes"),
    ]


def _shape(events: DataFrame, kind: str) -> DataFrame:
    test, fields = PARTS[kind]()
    rows = events if test is None else events.filter(test)
    seq, *others = fields
    return rows.select("site_id", seq, "ts", *others, *keep_slice(events))


def all_observations(events: DataFrame) -> DataFrame:
    """The observations of all kinds from one scan, without previous states."""
    parts = [(test, F.struct(*fields)) for test, fields in (part() for part in PARTS.values())]
    rows = F.array(*[one if test is None else F.when(test, one) for test, one in parts])
    unfolded = events.select("site_id", "ts", *keep_slice(events), F.inline(F.array_compact(rows)))
    return unfolded.select(*[f.name for f in OBSERVATION.fields], *keep_slice(events))


def _with_old_state(rows: DataFrame) -> DataFrame:
    columns = [c for c in rows.columns if c != SLICE]
    before = scan(rows.drop("old_state"), ["site_id", "entity_id"], previous={"old_state": F.col("new_state")})
    return before.select(*columns, *keep_slice(rows))


def _calls() -> tuple[Column | None, list[Column]]:
    state = F.when(F.col("event_type").isin("click", "view"), "on").otherwise("off")
    entity = F.concat(F.lit("binary_sensor."), _floor(), F.lit("_heating_call"))
    return F.col("event_type").isin("click", "view", "purchase", "signup"), _fields(CALL, entity, state, _floor())


def _furnace() -> tuple[Column | None, list[Column]]:
    return None, _fields(FURNACE, F.lit("binary_sensor.furnace_heating"), F.when(_k() < 50, "on").otherwise("off"))


def _outdoor() -> tuple[Column | None, list[Column]]:
    state = F.when(_k() % 17 == 0, "unavailable").otherwise(F.col("value").cast("string"))
    return F.col("event_type") == "view", _fields(OUTDOOR, F.lit("sensor.outdoor_temperature"), state)


def _climate() -> tuple[Column | None, list[Column]]:
    attributes = F.struct(
        (F.lit(60) + _k() % 10).cast("double").alias("temperature"),
        (F.lit(55) + F.round("value").cast("int") % 20).cast("double").alias("current_temperature"),
        F.when(_k() % 3 < 2, "heating").otherwise("idle").alias("hvac_action"),
    )
    mode = F.when(_k() % 17 == 0, "off").otherwise("heat")
    entity = F.concat(F.lit("climate."), _floor(), F.lit("_thermostat"))
    return None, _fields(CLIMATE, entity, mode, _floor(), attributes)


# which events yield an observation of a kind (None: all), and its fields
PARTS = {CALL: _calls, FURNACE: _furnace, OUTDOOR: _outdoor, CLIMATE: _climate}

"""JSON-lines event logs: reading, flattening of raw change messages, validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions.scalars import number_of, parse_time
from emberline.schema import ATTRIBUTES, CLIMATE, ENTITIES, OUTDOOR

STATE_CHANGED = "state_changed"
SOURCE = "ha.websocket"

# --- fixed values: states accepted by validation --------------------------------------------------------------------
BINARY_STATES = ("on", "off", "unavailable")
CLIMATE_MODES = ("heat", "off", "cool")
OUTDOOR_EXEMPT = ("unavailable", "unknown")
TOP_LEVEL = ("schema", "source", "ts", "data")
DATA_FIELDS = ("entity_id", "old_state", "new_state")

ENVELOPE = T.StructType(
    [
        T.StructField("site_id", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("schema", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("ts", T.StringType()),
    ]
)

STATE_CHANGE_DATA = T.StructType(
    [
        T.StructField("entity_id", T.StringType()),
        T.StructField("old_state", T.StringType()),
        T.StructField("new_state", T.StringType()),
        T.StructField("attributes", ATTRIBUTES),
    ]
)

CHECKED = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("schema", "source", "ts")],
        T.StructField("data", STATE_CHANGE_DATA),
    ]
)

_STATE = T.StructType([T.StructField("state", T.StringType()), T.StructField("attributes", ATTRIBUTES)])
MESSAGE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField(
            "event",
            T.StructType(
                [
                    T.StructField(
                        "data",
                        T.StructType(
                            [
                                T.StructField("entity_id", T.StringType()),
                                T.StructField("old_state", _STATE),
                                T.StructField("new_state", _STATE),
                            ]
                        ),
                    )
                ]
            ),
        ),
    ]
)


def event_name(schema: Column) -> Column:
    """Event name of a schema tag: producer prefix and version dropped, ``a.b.floor_call_ended.v1`` -> ``floor_call_ended``."""
    return F.regexp_extract(schema, r"([^.]+)\.v\d+$", 1)


def parse_log(lines: DataFrame, event: str, data: T.StructType) -> DataFrame:
    """Rows of one event type from log lines (column ``value``): the envelope and the fields of ``data``.

    Blank lines, malformed JSON and other event types are dropped. Missing fields are null; a bad time is a null ts.
    """
    shape = T.StructType([*ENVELOPE.fields, T.StructField("data", data)])
    rows = lines.select(F.from_json("value", shape).alias("e")).select("e.*").filter(event_name(F.col("schema")) == event)
    taken = {"site_id", "seq", "ts"}
    fields = [F.col(f"data.{f.name}").alias(f.name) for f in data.fields if f.name not in taken]
    return rows.select("site_id", "seq", parse_time(F.col("ts")).alias("ts"), *fields)


def read_log(spark: SparkSession, path: str, event: str = STATE_CHANGED, data: T.StructType = STATE_CHANGE_DATA) -> DataFrame:
    """Read a JSON-lines log, one event type at a time."""
    return parse_log(spark.read.text(path), event, data)


def malformed_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines that are not JSON, for quarantine."""
    return lines.filter((F.trim("value") != "") & F.try_parse_json(F.col("value")).isNull())


def flatten_state_changes(messages: DataFrame, watch: Sequence[str] = ()) -> DataFrame:
    """Observations from raw change messages (column ``value``); other message types and missing entities are dropped.

    ``watch`` limits the entities; empty means all. Attributes are kept only when at least one is given.
    """
    m = messages.withColumn("m", F.from_json("value", MESSAGE)).filter(F.col("m.type") == "event")
    d = "m.event.data"
    rows = m.filter(F.coalesce(F.col(f"{d}.entity_id"), F.lit("")) != "")
    if watch:
        rows = rows.filter(F.col(f"{d}.entity_id").isin(*watch))
    a = F.col(f"{d}.new_state.attributes")
    given = a["temperature"].isNotNull() | a["current_temperature"].isNotNull() | a["hvac_action"].isNotNull()
    return rows.select(
        *[c for c in messages.columns if c != "value"],
        F.col(f"{d}.entity_id").alias("entity_id"),
        F.col(f"{d}.old_state.state").alias("old_state"),
        F.col(f"{d}.new_state.state").alias("new_state"),
        F.when(given, a).alias("attributes"),
    )


def validate_observations(
    lines: DataFrame,
    entities: Mapping[str, tuple[str, str | None]] = ENTITIES,
    event: str = STATE_CHANGED,
    source: str = SOURCE,
) -> DataFrame:
    """Add ``errors`` (violation codes, empty when valid) and ``unknown_entity`` (a warning only) to log lines."""
    # three typed parses per line: the keys of both levels tell absent from null, and a number typed field is null for
    # a value that is not a JSON number
    rows = lines.filter(F.col("value") != "").select(
        *lines.columns,
        F.json_object_keys("value").alias("_keys"),
        F.json_object_keys(F.get_json_object("value", "$.data")).alias("_data_keys"),
        F.from_json("value", CHECKED).alias("_v"),
    )

    def any_absent(keys: str, wanted: Sequence[str]) -> Column:
        return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), F.col(keys))) > 0

    def number(path: str) -> Column:
        return F.col(f"_v.data.attributes.{path}").isNotNull()

    def named(wanted: str) -> list[str]:
        return [e for e, (k, _) in entities.items() if k == wanted]

    entity, state = F.col("_v.data.entity_id"), F.col("_v.data.new_state")
    has_data = F.col("_data_keys").isNotNull()
    binary, outdoor = entity.startswith("binary_sensor."), entity.isin(*named(OUTDOOR))
    climate = entity.isin(*named(CLIMATE)) & state.isNotNull()
    numeric = state.isin(*OUTDOOR_EXEMPT) | number_of(state).isNotNull()
    checks = [
        ("missing_top_level", any_absent("_keys", TOP_LEVEL)),
        ("bad_schema", ~F.coalesce(event_name(F.col("_v.schema")) == event, F.lit(False))),
        ("bad_source", ~F.col("_v.source").eqNullSafe(F.lit(source))),
        ("bad_ts", F.coalesce("_v.ts", F.lit("")) == ""),
        ("data_not_object", ~has_data),
        ("missing_data_fields", has_data & any_absent("_data_keys", DATA_FIELDS)),
        ("empty_new_state", has_data & (F.coalesce(state, F.lit("")) == "")),
        ("bad_binary_state", has_data & binary & ~state.isin(*BINARY_STATES)),
        ("bad_outdoor_state", has_data & outdoor & ~numeric),
        ("bad_climate_mode", has_data & climate & ~state.isin(*CLIMATE_MODES)),
        ("climate_temperature_not_numeric", has_data & climate & ~number("temperature")),
        ("climate_current_temperature_not_numeric", has_data & climate & ~number("current_temperature")),
    ]
    found = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in checks]))
    errors = (
        F.when(F.col("_keys").isNotNull(), found)
        .when(F.try_parse_json(F.col("value")).isNull(), F.array(F.lit("invalid_json")))
        .otherwise(F.array(F.lit("not_an_object")))
    )
    known = F.coalesce(entity.isin(*entities), F.lit(False))
    return rows.select(*lines.columns, errors.alias("errors"), (has_data & ~known).alias("unknown_entity"))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid lines and the quarantine."""
    ok = F.size("errors") == 0
    return validated.filter(ok).drop("errors"), validated.filter(~ok)


def validation_summary(validated: DataFrame) -> DataFrame:
    """Counts of total, valid and invalid lines, unknown entities and each violation, in one pass."""
    state = F.when(F.size("errors") == 0, "valid").otherwise("invalid")
    measures = F.array_compact(F.array(F.lit("total"), state, F.when(F.col("unknown_entity"), "unknown_entity")))
    return (
        validated.select(F.explode(F.concat(measures, F.col("errors"))).alias("measure"))
        .groupBy("measure")
        .agg(F.count(F.lit(1)).alias("n"))
    )



import os
import sys
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from emberline.operators.edges import entity_lookup  # noqa: E402
from emberline.schema import ATTRIBUTES  # noqa: E402

START = datetime(2024, 1, 15)
RAW = "site_id bigint, seq bigint, ts timestamp, entity_id string, old_state string, new_state string, attributes " + (
    "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in ATTRIBUTES.fields) + ">"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def clock(text):
    """``HH:MM[:SS]`` on the scenario day."""
    parts = [int(p) for p in text.split(":")]
    return START + timedelta(hours=parts[0], minutes=parts[1], seconds=parts[2] if len(parts) > 2 else 0)


@pytest.fixture(scope="session")
def observe(spark):
    """Build observations from ``(ts, entity, old, new[, (setpoint, temp, action)])``, numbered in the given order."""

    def build(*rows, site=1):
        data = []
        for i, (ts, entity, old, new, *attributes) in enumerate(rows):
            ts = (clock(ts) if isinstance(ts, str) else ts).replace(tzinfo=timezone.utc)
            data.append((site, i, ts, entity, old, new, attributes[0] if attributes else None))
        return entity_lookup(spark.createDataFrame(data, RAW))

    return build


CALLS = {i: f"binary_sensor.floor_{i}_heating_call" for i in (1, 2, 3)}
STATS = {i: f"climate.floor_{i}_thermostat" for i in (1, 2, 3)}
FURNACE = "binary_sensor.furnace_heating"
OUTDOOR = "sensor.outdoor_temperature"


def switch(entity, on, off):
    return [(on, entity, "off", "on"), (off, entity, "on", "off")]


def golden_day():
    """Twenty-four hours of one site: furnace, three floors, outdoor readings."""
    rows = []
    for on, off in (("06:00", "06:40"), ("13:00", "14:00"), ("17:00", "22:00")):
        rows += switch(FURNACE, on, off)
    for floor, spans in {
        1: (("06:05", "06:10"), ("18:30", "18:35"), ("18:35", "18:40")),
        2: (("13:05", "13:35"), ("17:05", "18:15")),
        3: (("06:20", "06:30"), ("18:50", "19:10")),
    }.items():
        for on, off in spans:
            rows += switch(CALLS[floor], on, off)
    rows += [(t, OUTDOOR, None, v) for t, v in (("08:00", "35.5"), ("10:00", "42.0"), ("12:00", "48.5"), ("16:00", "45.0"), ("20:00", "38.0"))]
    # stable sort: at 18:35 the end comes before the next start
    return sorted(rows, key=lambda r: clock(r[0]))


def at(text):
    return F.lit(clock(text).isoformat(" ")).cast("timestamp")


def dicts(df, *order):
    return [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]

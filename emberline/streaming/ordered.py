"""Keyed stateful processing in event order with bounded memory, and the helpers that start and read such streams."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from emberline.functions.timeline import SLICE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTE_US = 60_000_000
LATE = "late_seq"
SHARD, KEY = "shard", "shard_key"
SHARDS = 512
PART_ROWS = 4096  # rows of a stored part
HELD_ROWS = 65_536  # rows put in order of time before they are cut into parts
FRAME_ROWS = 10_000  # rows of an emitted frame


def _plain(column: pd.Series) -> list:
    """Values of a column with missing ones as ``None``."""
    values = column.tolist()
    return [None if v is None or v != v else v for v in values] if column.dtype.kind in "fO" else values


class KeyState:
    """The state of the key at hand, among those of its shard."""

    def __init__(self):
        self.held, self.key, self.changed = {}, None, False

    def get(self):
        return self.held.get(self.key)

    def update(self, value) -> None:
        self.held[self.key], self.changed = value, True


class OrderedProcessor(StatefulProcessor):
    """Hands the rows of a key to ``step`` sorted by ``(us, seq)`` and emits what it returns.

    Spark groups by shards of keys and not by keys, since a call of the worker and a read or write of its state cost as much as many rows. The
    states of a shard's keys (``self.state`` is that of the key at hand) are one value, read and written once a batch.

    Buffered, rows wait in parts of a map state until the horizon, the watermark cut down to a whole chunk of ``chunk_us`` microseconds, has
    passed their chunk. A part has a few thousand rows that lie next to each other in time, whatever the length of a chunk. Parts are read in order
    of time and their rows handed over chunk by chunk, so files may arrive in any order within the watermark delay, and a chunk of a shard and the
    parts around it are in memory at once. A row older than the horizon comes too late to be put in order: it is emitted as a row with
    its ``us`` and ``seq`` (as ``late_seq``) and nothing else.

    Unbuffered, rows are processed as they arrive. Times are microseconds in ``us``.
    """

    #: columns handed to ``step`` after ``us`` and ``seq``, with their types
    fields: tuple[tuple[str, str], ...] = ()
    #: columns of the emitted rows with their types
    output: tuple[tuple[str, str], ...] = ()
    #: whether keys have times at which ``advance`` must be called
    timers = False
    #: set by ``process``
    keys: tuple[tuple[str, str], ...] = ()
    grace_us = 0
    live = False

    def __init__(self, buffered: bool = False, chunk_us: int = MINUTE_US):
        self.buffered, self.chunk_us = buffered, chunk_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, KeyState()
        self.columns = [KEY, "us", "seq", *[n for n, _ in self.fields]]
        self.states = handle.getValueState("states", "doc binary")
        if self.buffered:
            self.parts = handle.getMapState("parts", "part bigint", "rows binary")
            self.index = handle.getValueState("index", "doc string")

    def step(self, key: tuple, rows: list[tuple]) -> Iterable[tuple]:
        raise NotImplementedError

    def seed(self, key: tuple, rows: pd.DataFrame) -> None:
        """Takes over the state a key had before the stream began."""
        raise NotImplementedError

    def due(self) -> int | None:
        """When ``advance`` must be called for the key at hand."""
        return None

    def advance(self, key: tuple, now_us: int) -> Iterable[tuple]:
        """Called when a timer has expired; every row up to ``now_us`` has been processed."""
        return ()

    def handleInitialState(self, key, initialState, timerValues) -> None:
        index = self._load()
        for text, rows in initialState.groupby(KEY, sort=False):
            self.seed(self._at(text), rows)
        self._save(index)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        index = self._load()
        found = self._buffered(index, rows, self._horizon(timerValues)) if self.buffered else self._unbuffered(rows)
        yield from self._frames(found)
        self._save(index)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        index, horizon = self._load(), self._horizon(timerValues)
        yield from self._frames(self._expired(index, horizon))
        self._save(index)

    def close(self) -> None:
        pass

    def wake(self, us: int) -> None:
        """Have ``advance`` called once the horizon has passed this time."""
        if self.live:
            self.handle.registerTimer(us // 1000 + 1)
        else:
            at = (us // self.chunk_us + 1) * self.chunk_us
            self.handle.registerTimer(max((at - self.grace_us) // 1000 + 1, 1))

    def _horizon(self, timers) -> int:
        if self.live:
            return timers.getCurrentProcessingTimeInMs() * 1000
        watermark = timers.getCurrentWatermarkInMs() * 1000
        return (watermark + self.grace_us) // self.chunk_us * self.chunk_us if watermark > 0 else 0

    def _load(self) -> dict:
        """Reads the states of a shard; returns the numbers, first and last chunks of its parts."""
        stored = self.states.get()
        self.state.held, self.state.changed = pickle.loads(stored[0]) if stored else {}, False
        stored = self.index.get() if self.buffered else None
        return json.loads(stored[0]) if stored else {"next": 0, "parts": []}

    def _save(self, index: dict) -> None:
        if self.state.changed:
            self.states.update((pickle.dumps(self.state.held),))
        times = []
        if self.buffered:
            self.index.update((json.dumps(index),))
            times = [(lo + 1) * self.chunk_us - 1 for _, lo, _ in index["parts"]]
        if self.timers:
            for text in self.state.held:
                self.state.key = text
                times.append(self.due())
        # one timer a shard; when it expires, it sets the next one
        soonest = min((t for t in times if t is not None), default=None)
        if soonest is not None:
            self.wake(soonest)
        self.state.held = {}

    def _at(self, text: str) -> tuple:
        """Makes a key the one at hand; its text is a JSON object."""
        self.state.key = text
        return tuple(json.loads(text).values())

    def _rows(self, frame: pd.DataFrame) -> list[tuple]:
        return list(zip(*[_plain(frame[c]) for c in self.columns]))

    def _unbuffered(self, frames: Iterable[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            yield from self._steps(self._rows(frame))

    def _buffered(self, index: dict, frames: Iterable[pd.DataFrame], horizon: int) -> Iterator[tuple]:
        names = [n for n, _ in self.output]
        held = []
        for frame in frames:
            late = frame[frame["us"] < horizon]
            for text, us, seq in zip(*[late[c].tolist() for c in (KEY, "us", "seq")]):
                yield (*self._at(text), *[us if n == "us" else None for n in names], seq)
            held += self._rows(frame[frame["us"] >= horizon] if len(late) else frame)
            if len(held) >= HELD_ROWS:
                self._keep(index, held)
                held = []
        self._keep(index, held)
        yield from self._drain(index, horizon)

    def _expired(self, index: dict, horizon: int) -> Iterator[tuple]:
        if self.buffered:
            yield from self._drain(index, horizon)
        if self.timers:
            for text in list(self.state.held):
                key = self._at(text)
                for row in self.advance(key, horizon):
                    yield (*key, *row, None)

    def _keep(self, index: dict, rows: list[tuple]) -> None:
        rows.sort(key=itemgetter(1))
        for first in range(0, len(rows), PART_ROWS):
            some = rows[first : first + PART_ROWS]
            self.parts.updateValue((index["next"],), (pickle.dumps(some),))
            index["parts"].append([index["next"], some[0][1] // self.chunk_us, some[-1][1] // self.chunk_us])
            index["next"] += 1

    def _drain(self, index: dict, horizon: int) -> Iterator[tuple]:
        end = horizon // self.chunk_us
        ready = sorted((p for p in index["parts"] if p[1] < end), key=itemgetter(1), reverse=True)
        if not ready:
            return
        chunks: dict[int, list[tuple]] = {}
        order: list[int] = []
        rest: list[tuple] = []
        while ready or order:
            if ready and (not order or ready[-1][1] <= order[0]):
                number = ready.pop()[0]
                for row in pickle.loads(self.parts.getValue((number,))[0]):
                    chunk = row[1] // self.chunk_us
                    if chunk >= end:
                        rest.append(row)
                    elif chunk in chunks:
                        chunks[chunk].append(row)
                    else:
                        chunks[chunk] = [row]
                        heappush(order, chunk)
                self.parts.removeKey((number,))
                if len(rest) >= HELD_ROWS:
                    self._keep(index, rest)
                    rest = []
            else:
                yield from self._steps(chunks.pop(heappop(order)))
        index["parts"] = [p for p in index["parts"] if p[1] >= end]
        self._keep(index, rest)

    def _steps(self, rows: Iterable[tuple]) -> Iterator[tuple]:
        """Hands rows of any keys to ``step``, key by key."""
        keys: dict[str, list[tuple]] = {}
        for text, *row in rows:
            keys.setdefault(text, []).append(row)
        for text, mine in keys.items():
            key = self._at(text)
            mine.sort(key=itemgetter(0, 1))
            for row in self.step(key, [tuple(r) for r in mine]):
                yield (*key, *row, None)

    def _frames(self, rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
        some = []
        for row in rows:
            some.append(row)
            if len(some) == FRAME_ROWS:
                yield self._frame(some)
                some = []
        if some:
            yield self._frame(some)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        columns = {}
        for (name, kind), values in zip([*self.keys, *self.output, (LATE, "bigint")], zip(*rows)):
            columns[name] = pd.array(values, dtype="Int64") if kind == "bigint" and None in values else list(values)
        return pd.DataFrame(columns)


def shard_of(keys: list[str], shards: int) -> list[Column]:
    """The shard of a row by its keys, and the keys as text in which null is a value of its own."""
    return [F.pmod(F.xxhash64(*keys), F.lit(shards)).alias(SHARD), F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias(KEY)]


def process(
    rows: DataFrame,
    keys: list[str],
    processor: OrderedProcessor,
    delay: str = "1 hour",
    grace: str = "0 seconds",
    live: bool = False,
    initial: DataFrame | None = None,
    shards: int = SHARDS,
) -> DataFrame:
    """Run a processor over a stream of observations; times in the output are microseconds.

    ``delay`` is how long rows are waited for; those up to ``grace`` later are emitted as late rows, still later ones are dropped by
    the watermark. ``live`` lets timers follow the clock instead of the watermark. ``initial`` holds the state of keys to begin with. ``shards``
    is how many groups the keys are dealt into; like the number of shuffle partitions it stays as it is for the life of a checkpoint.
    """
    types = dict(rows.dtypes)
    timed = not live and (processor.buffered or processor.timers)
    processor.keys, processor.live = tuple((k, types[k]) for k in keys), live
    processor.grace_us = _micros(grace) if timed else 0
    spec = ", ".join(f"{n} {t}" for n, t in [*processor.keys, *processor.output, (LATE, "bigint")])
    waited = f"{(_micros(delay) + _micros(grace)) // 1000} milliseconds"
    # a row without a time has no place in the order
    shaped = (rows.filter(F.col("ts").isNotNull()) if processor.buffered else rows).withColumn("us", F.unix_micros("ts"))
    shaped = (shaped.withWatermark("ts", waited) if timed else shaped).select(*shard_of(keys, shards), *["ts"] * timed, "us", "seq", *[n for n, _ in processor.fields])
    mode = "processingTime" if live else "eventTime" if timed else "none"
    start = None if initial is None else initial.select(*shard_of(keys, shards), *[c for c in initial.columns if c not in keys]).groupBy(SHARD)
    return shaped.groupBy(SHARD).transformWithStateInPandas(processor, spec, "append", mode, start)


def _micros(span: str) -> int:
    """``'2 hours'`` and the like in microseconds."""
    return pd.Timedelta(span).value // 1000


def on_time(rows: DataFrame) -> DataFrame:
    """What a processor derived, without the rows that came too late."""
    return rows.filter(F.col(LATE).isNull()).drop(LATE)


def late_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that came too late: their keys, ``us`` and ``seq``."""
    return rows.filter(F.col(LATE).isNotNull()).select(*keys, "us", F.col(LATE).alias("seq"))


def use_state_store(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB store, which also keeps large state out of the executor heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def run_available(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that is available, append it to parquet, and stop. Restartable from ``checkpoint``."""
    query = (
        rows.drop(SLICE)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def micros(df: DataFrame, *columns: str) -> DataFrame:
    """Microsecond columns as timestamps; ``us`` becomes ``ts``."""
    for c in columns:
        df = df.withColumn(c, F.timestamp_micros(c))
    return df.withColumnRenamed("us", "ts") if "us" in columns else df

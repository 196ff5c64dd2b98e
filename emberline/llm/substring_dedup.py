"""Removal of repeated word passages, with a count-min prefilter.

A window is ``window`` consecutive words of one document. Its anchor is the smallest hash of the ``gram``-word shingles in it, so
equal windows have equal anchors, and neighbouring windows mostly share one: a run of windows is one entry, about an
eighth of all.

1. Each task sums the anchors of its slices into a sparse count-min sketch. The sketches are merged block by block, every block of
   cells in a task of its own; the width follows the size of the corpus and nothing is broadcast. A merged count is never
   below the number of windows with that anchor.
2. A second pass asks the merged sketch for its anchors. Only windows of anchors counted twice go on. An anchor that a slice
   holds twice is known to repeat and is not asked for.
3. The windows that go on are grouped exactly, by 96-bit fingerprints; all but the first occurrence lose their words. Of
   equal windows in one slice only the first enters the shuffle, so a passage in a third of all documents stays a small group.

Defined results: a null text has no words; texts with fewer words than a window keep all; a window repeats only against an
earlier start (smaller ``doc_id``, or the same document and an earlier word), judged on the input. Rows that share a ``doc_id``, or
have none, are documents of their own, ordered by ``doc_id`` (null first) and text hash. An empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.store import packed, slices, unpacked, written
from emberline.llm.words import WHITE, WORD_BASE, Words, find_words, mix, powers, prefix, stretches

SLICE_BYTES = 2 << 20
BLOCK_BITS = 21
LEAST_PARTS = 64  # blocks and buckets there are at least, so that small inputs use many tasks too
CELLS_PER_BYTE = 0.32  # 16 cells an anchor, an anchor about every 50 bytes
SECOND_BASE = 0x8CB92BA72F3D8DD7
GROUP_WINDOWS = 500_000
LONGEST_RUN = 255
RUNS = "_doc long, runs binary"


def ordered_documents(docs: DataFrame) -> DataFrame:
    """``packed(docs)`` with ``_doc``, a unique long in the order of ``doc_id``: the id itself where it is unique."""
    rows = packed(docs)
    unique = docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int")
    if unique and docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return rows.withColumn("_doc", F.col("doc_id").cast("long"))
    sorted_rows = rows.withColumn("_hash", F.xxhash64("text")).repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash")
    return written(sorted_rows.drop("_hash").withColumn("_doc", F.monotonically_increasing_id()), "ordered")


def window_fingerprints(words: Words, size: int, base: int) -> np.ndarray:
    """Hashes of ``size`` words from every word on, across texts; callers use those within one text."""
    n = len(words.hash)
    if n < size:
        return np.zeros(0, np.uint64)
    at = np.arange(n - size + 1)
    sums = prefix(words.hash * powers(base, n))
    return mix((sums[at + size] - sums[at]) * powers(pow(base, -1, 2**64), n)[: len(at)])


def anchor_runs(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first word, number of windows, anchor, whether the anchor occurs twice in the run."""
    low = window_fingerprints(words, gram, WORD_BASE)
    twice = np.zeros(len(low), bool)
    span, width = window - gram + 1, 1
    while width < span:
        step = min(width, span - width)
        if len(low) <= step:
            low, twice = low[:0], twice[:0]
            break
        left, right = low[:-step], low[step:]
        twice = np.where(left < right, twice[:-step], np.where(right < left, twice[step:], True))
        low = np.minimum(left, right)
        width += step
    last = np.repeat(words.first[1:], words.counts)
    at = np.flatnonzero(np.arange(len(words.hash)) + window <= last)
    if not len(at):
        return at, at, low[:0], twice[:0]
    anchors = low[at]
    new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (at[1:] != at[:-1] + 1)])
    begin = np.flatnonzero(new)
    sizes = np.diff(np.append(begin, len(at)))
    again = np.logical_or.reduceat(twice[at], begin) | (sizes > span)
    parts = -(-sizes // LONGEST_RUN)
    if parts.max() == 1:
        return at[begin], sizes, anchors[begin], again
    piece = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    whole = np.repeat(np.arange(len(begin)), parts)
    return at[begin][whole] + piece * LONGEST_RUN, np.minimum(sizes[whole] - piece * LONGEST_RUN, LONGEST_RUN), anchors[begin][whole], again[whole]


def by_block(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts by block, the blocks there are, and where each begins (and the end)."""
    blocks = (cells >> np.uint64(BLOCK_BITS)).astype(np.int64)
    order = np.argsort(blocks, kind="stable")
    there, begin = np.unique(blocks[order], return_index=True)
    return order, there, np.append(begin, len(cells))


def partition_sketches(docs: DataFrame, blocks: int, window: int, gram: int) -> DataFrame:
    """Sparse sketches of slices: ``block, cells, counts`` (cell numbers in the block, counts of one or two-or-more)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch, "text", SLICE_BYTES):
                _, _, anchors, twice = anchor_runs(find_words(data, offsets, WHITE, lower=False), window, gram)
                cells, counts = np.unique(np.concatenate([anchors, anchors[twice]]) % np.uint64(blocks << BLOCK_BITS), return_counts=True)
                order, there, begin = by_block(cells)
                inner = (cells[order] & np.uint64((1 << BLOCK_BITS) - 1)).astype("<u4")
                small = np.minimum(counts[order], 2).astype(np.uint8)
                cuts = stretches(begin[:-1], int(begin[-1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(there), pa.array([inner[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([small[a:b].tobytes() for a, b in cuts], pa.binary())],
                    ["block", "cells", "counts"],
                )

    return docs.select("text").mapInArrow(sketch, "block long, cells binary, counts binary")


def merge_sketches(group: pa.Table) -> pa.Table:
    total = np.zeros(1 << BLOCK_BITS, np.uint8)
    for cells, counts in zip(group.column("cells").to_pylist(), group.column("counts").to_pylist(), strict=True):
        cell = np.frombuffer(cells, "<u4")  # distinct within one sketch
        total[cell] = np.minimum(total[cell] + np.frombuffer(counts, np.uint8), 2)
    return pa.table({"block": group.column("block").slice(0, 1), "repeated": pa.array([np.packbits(total >= 2).tobytes()], pa.binary())})


def asked_runs(docs: DataFrame, blocks: int, window: int, gram: int) -> DataFrame:
    """The runs of all slices, by the block of the sketch that knows their anchors; a negative block needs no answer."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "cells", "docs", "counts", "starts", "sizes"]
        for batch in batches:
            ids = batch.column("_doc").to_numpy(zero_copy_only=False)
            for low, _, data, offsets in slices(batch, "text", SLICE_BYTES):
                words = find_words(data, offsets, WHITE, lower=False)
                at, sizes, anchors, twice = anchor_runs(words, window, gram)
                doc = words.doc()[at] if len(at) else at
                cells = anchors % np.uint64(blocks << BLOCK_BITS)
                _, back, counts = np.unique(cells, return_inverse=True, return_counts=True)
                sure = twice | (counts[back] > 1)
                block = np.where(sure, -1 - (doc % 64), (cells >> np.uint64(BLOCK_BITS)).astype(np.int64))
                order = np.argsort(block, kind="stable")
                there, begin = np.unique(block[order], return_index=True)
                cuts = stretches(begin, len(order))
                columns = [
                    (cells & np.uint64((1 << BLOCK_BITS) - 1)).astype("<u4")[order],
                    (at - words.first[doc]).astype("<i4")[order],
                    sizes.astype(np.uint8)[order],
                ]
                cell, start, size = [pa.array([c[a:b].tobytes() for a, b in cuts], pa.binary()) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(there), cell, *named(ids[low + doc][order], cuts), start, size], names)

    return docs.select("_doc", "text").mapInArrow(ask, "block long, cells binary, docs binary, counts binary, starts binary, sizes binary")


def named(owner: np.ndarray, cuts: list) -> tuple[pa.Array, pa.Array]:
    """For each cut the runs of equal owners: the owners and how often each stands."""
    docs, counts = [], []
    for a, b in cuts:
        part = owner[a:b]
        begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        docs.append(part[begin].astype("<i8").tobytes())
        counts.append(np.diff(np.append(begin, len(part))).astype("<u4").tobytes())
    return pa.array(docs, pa.binary()), pa.array(counts, pa.binary())


def owners(group: pa.Table) -> np.ndarray:
    return np.repeat(joined(group, "docs", "<i8"), joined(group, "counts", "<u4"))


def rows_by_doc(docs: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """One row per document: its values of the columns side by side, as little-endian 32-bit integers."""
    order = np.argsort(docs, kind="stable")
    values = np.stack([c[order].astype("<i4") for c in columns], axis=1) if len(order) else np.zeros((0, len(columns)), "<i4")
    there, begin = np.unique(docs[order], return_index=True)
    cuts = stretches(begin, len(order))
    return pa.table({"_doc": pa.array(there.astype(np.int64)), "runs": pa.array([values[a:b].tobytes() for a, b in cuts], pa.binary())})


def joined(group: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(group.column(column).to_pylist()), kind)


def answer(asked: pa.Table, sketch: pa.Table) -> pa.Table:
    docs, starts, sizes = owners(asked), joined(asked, "starts", "<i4"), joined(asked, "sizes", np.uint8)
    if asked.num_rows and asked.column("block")[0].as_py() >= 0:
        bits = np.unpackbits(np.frombuffer(sketch.column("repeated")[0].as_py(), np.uint8)).astype(bool)
        again = bits[joined(asked, "cells", "<u4")]
        docs, starts, sizes = docs[again], starts[again], sizes[again]
    return rows_by_doc(docs, starts, sizes)


def likely_windows(docs: DataFrame, buckets: int, window: int) -> DataFrame:
    """Fingerprints of the windows estimated repeated, by bucket; windows a slice holds before are ``later_*`` at once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "high", "low", "docs", "counts", "starts", "later_docs", "later_starts"]
        for batch in batches:
            ids, runs = batch.column("_doc").to_numpy(), batch.column("_runs").to_pylist()
            for first, end, data, offsets in slices(batch, "text", SLICE_BYTES):
                words = find_words(data, offsets, WHITE, lower=False)
                places = []
                for i in range(end - first):
                    pairs = np.frombuffer(b"".join(runs[first + i]), "<i4").reshape(-1, 2).astype(np.int64)
                    total = np.concatenate([[0], np.cumsum(pairs[:, 1])])
                    places.append(np.repeat(pairs[:, 0] - total[:-1], pairs[:, 1]) + np.arange(total[-1]) + words.first[i])
                at = np.concatenate(places) if places else np.zeros(0, np.int64)
                at = at[np.argsort(at)]
                high, low = window_fingerprints(words, window, WORD_BASE), window_fingerprints(words, window, SECOND_BASE)
                high, low = high[at] if len(at) else high[:0], (low[at] if len(at) else low[:0]).astype(np.uint32)
                doc = words.doc()[at] if len(at) else at
                owner, start = ids[first + doc], at - words.first[doc]
                order = np.lexsort((start, owner, low, high))
                same = np.concatenate([[False], (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])]) if len(order) else np.zeros(0, bool)
                later, order = order[same], order[~same]
                order = np.sort(order)  # by document and start again
                bucket = (high[order] % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                order, bucket = order[by], bucket[by]
                there, begin = np.unique(bucket, return_index=True)
                cuts = stretches(begin, len(bucket))
                put = lambda values, kind: pa.array([values[order][a:b].astype(kind).tobytes() for a, b in cuts], pa.binary())  # noqa: E731, B023
                aside = lambda values, kind: pa.array([values[later].astype(kind).tobytes() if k == 0 else b"" for k in range(len(cuts))], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array(there), put(high, "<u8"), put(low, "<u4"), *named(owner[order], cuts), put(start, "<i4"), aside(owner, "<i8"), aside(start, "<i4")], names
                )

    shape = "bucket long, high binary, low binary, docs binary, counts binary, starts binary, later_docs binary, later_starts binary"
    return docs.select("_doc", "text", "_runs").mapInArrow(cut, shape)


def later_windows(group: pa.Table) -> pa.Table:
    """All occurrences of the windows of a bucket but the first of each."""
    high, low = joined(group, "high", "<u8"), joined(group, "low", "<u4")
    docs, starts = owners(group), joined(group, "starts", "<i4")
    order = np.lexsort((starts, docs, low, high))
    same = np.concatenate([[False], (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])]) if len(order) else np.zeros(0, bool)
    again = order[same]
    return rows_by_doc(np.concatenate([docs[again], joined(group, "later_docs", "<i8")]), np.concatenate([starts[again], joined(group, "later_starts", "<i4")]))


def repeated_windows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """``_doc, _starts`` of the documents with windows that start earlier too: packed starts of those windows."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(LEAST_PARTS, math.ceil(size * CELLS_PER_BYTE / (1 << BLOCK_BITS)))
    sketch = partition_sketches(docs, blocks, window, gram).groupBy("block").applyInArrow(merge_sketches, "block long, repeated binary")
    asked = asked_runs(docs, blocks, window, gram)
    runs = written(asked.groupBy("block").cogroup(sketch.groupBy("block")).applyInArrow(answer, RUNS), "likely")
    likely = runs.groupBy("_doc").agg(F.collect_list("runs").alias("_runs"))
    # a run has about half as many windows as its anchor is wide
    buckets = max(LEAST_PARTS, math.ceil((runs.agg(F.sum(F.octet_length("runs"))).first()[0] or 0) / 8 * (window - gram + 2) / 2 / GROUP_WINDOWS))
    found = likely_windows(docs.select("_doc", "text").join(likely.hint("shuffle_hash"), "_doc"), buckets, window)
    return found.groupBy("bucket").applyInArrow(later_windows, RUNS).groupBy("_doc").agg(F.collect_list("runs").alias("_starts"))


def without_repeats(docs: DataFrame, window: int = 20, gram: int = 5) -> DataFrame:
    """``doc_id, text, _rest`` with ``_n_words``, ``_removed`` (disjoint runs of removed words) and ``_kept`` (words, one space apart)."""
    rows = ordered_documents(docs)
    starts = repeated_windows(rows, window, min(gram, window))
    both = rows.join(starts.hint("shuffle_hash"), "_doc", "left")
    kind = "array<struct<start:int,length:int>>"

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column("_starts").to_pylist()
            counts, removed, kept = [], [], []
            for first, end, data, offsets in slices(batch, "text", SLICE_BYTES):
                words = find_words(data, offsets, WHITE, lower=False)
                raw = data.tobytes()
                for i in range(end - first):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    n = b - a
                    keep = np.ones(n, bool)
                    if starts[first + i]:
                        at = np.frombuffer(b"".join(starts[first + i]), "<i4").astype(np.int64)
                        edge = np.bincount(at, minlength=n + window + 1) - np.bincount(at + window, minlength=n + window + 1)[: n + window + 1]
                        keep = np.cumsum(edge)[:n] == 0
                    flips = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8)))
                    counts.append(n)
                    removed.append([{"start": s, "length": e - s} for s, e in flips.reshape(-1, 2).tolist()])
                    if len(flips):
                        kept.append(b" ".join([raw[s:e] for s, e in zip(words.start[a:b][keep].tolist(), words.end[a:b][keep].tolist(), strict=True)]))
                    else:
                        kept.append(b" ".join(raw[offsets[i] : offsets[i + 1]].split()))
            new = [pa.array(counts, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "text", "_rest")], *new], ["doc_id", "text", "_rest", "_n_words", "_removed", "_kept"])

    shape = "doc_id {}, text string, _rest {}, _n_words long, _removed {}, _kept string".format(*[both.schema[c].dataType.simpleString() for c in ("doc_id", "_rest")], kind)
    return both.mapInArrow(remove, shape)


def drop_repeats(docs: DataFrame, window: int = 20, gram: int = 5) -> DataFrame:
    """The documents with repeated passages cut out of their texts; a text that loses nothing, null included, stays as it is."""
    done = without_repeats(docs, window, gram)
    return unpacked(done.withColumn("text", F.when(F.size("_removed") > 0, F.col("_kept")).otherwise(F.col("text"))), docs.columns)

"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ``window`` words (a shorter item is one window); a window is the set of its word
shingles. The shingles of a window are ordered by how rare they are in the corpus, and only its necessary prefix - for a
similarity ``t`` the ``n - ceil(t * n) + 1`` rarest of ``n`` - is looked for in the documents: a passage that holds ``t`` of
the set holds one of these. A hit fixes where the window may lie; length and position bounds drop what would stick out of
the document, and what remains is verified on the words: equality with ``t = 1``, else the share of the set within a
window of the item's size.

Documents are never shuffled: windows go to the tasks in blocks of at most ``block`` windows, so what is broadcast has a
fixed bound, and a larger benchmark takes more passes. Frequencies are summed per task before the exchange.

Defined results: a null text or one without words has no hit; null or wordless texts of items match nothing; an item without an id hits words and adds no id; items with equal ids or
texts count once per id; repeated documents are judged alike; an empty benchmark hits nothing; an empty table gives none;
other columns pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.store import packed, slices, unpacked, written
from emberline.llm.words import LOWER, NOT_ALNUM, find_words, windows

SLICE_BYTES = 2 << 20
FILTER_BITS = 20
HITS = "array<struct<start:int,length:int>>"


def item_windows(items: DataFrame, window: int | None) -> DataFrame:
    """Distinct windows of all items: ``words`` (separated by one space, lower case), ``n``, ``items`` (ids as strings)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item").to_pylist()
            texts, sizes, owners = [], [], []
            for low, _, data, offsets in slices(batch, "text", SLICE_BYTES):
                words = find_words(data, offsets, NOT_ALNUM, lower=True)
                plain = LOWER[data].tobytes()
                for i in range(len(offsets) - 1):
                    spans = list(zip(words.start[words.first[i] : words.first[i + 1]].tolist(), words.end[words.first[i] : words.first[i + 1]].tolist(), strict=True))
                    size = min(window or len(spans), len(spans))
                    for at in range(len(spans) - size + 1 if size else 0):
                        texts.append(b" ".join(plain[s:e] for s, e in spans[at : at + size]).decode())
                        sizes.append(size)
                        owners.append(ids[low + i])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(owners, pa.string())], ["words", "n", "item"])

    rows = items.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(cut, "words string, n int, item string")
    return rows.groupBy("words", "n").agg(F.collect_set("item").alias("items"))


class Block:
    """Some windows with their shingles; ``order`` keeps the prefixes, once the frequencies are known."""

    def __init__(self, rows: list, shingle: int, similarity: float):
        self.texts = [r["words"].encode() for r in rows]
        self.items = [r["items"] for r in rows]
        self.similarity = similarity
        data = np.frombuffer(b"\n".join(self.texts), np.uint8) if rows else np.zeros(0, np.uint8)
        ends = np.cumsum([len(t) for t in self.texts]) + np.arange(len(rows))
        offsets = np.concatenate([[0], np.minimum(ends + 1, len(data))]).astype(np.int64) if rows else np.zeros(1, np.int64)
        words = find_words(data, offsets, NOT_ALNUM, lower=True)
        self.sizes = words.counts
        self.shingle = np.minimum(self.sizes, shingle)
        entry, place, token, width = [], [], [], []
        owner = words.doc()
        for k in np.unique(self.shingle[self.shingle > 0]).tolist():
            at, hashes = windows(words, k)
            mine = self.shingle[owner[at]] == k
            entry.append(owner[at[mine]])
            place.append(at[mine] - words.first[owner[at[mine]]])
            token.append(hashes[mine])
            width.append(np.full(int(mine.sum()), k))
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        self.entry, self.place, self.token, self.width = join(entry, np.int64), join(place, np.int64), join(token, np.uint64), join(width, np.int64)
        self.widths = sorted(set(self.width.tolist()))

    def tokens(self) -> dict[int, np.ndarray]:
        return {k: np.unique(self.token[self.width == k]) for k in self.widths}

    def order(self, frequency: dict[tuple[int, int], int]) -> None:
        """Keep each window's rarest shingles, as many as its similarity makes necessary."""
        counts = np.array([frequency.get((k, t), 0) for k, t in zip(self.width.tolist(), self.token.view(np.int64).tolist(), strict=True)], np.int64)
        by = np.lexsort((self.place, self.token, counts, self.entry))
        # repeats of a shingle are one member of the set
        new_entry = np.concatenate([[True], self.entry[by][1:] != self.entry[by][:-1]]) if len(by) else np.zeros(0, bool)
        new = new_entry | np.concatenate([[True], self.token[by][1:] != self.token[by][:-1]]) if len(by) else new_entry
        rank = np.cumsum(new) - 1
        first = np.maximum.accumulate(np.where(new_entry, rank, 0)) if len(by) else rank
        members = np.bincount(self.entry[by][new], minlength=len(self.texts)) if len(by) else np.zeros(0, int)
        prefix = members - np.ceil(self.similarity * members - 1e-9).astype(int) + 1
        self.members = members
        self.sets = None
        if self.similarity < 1:
            self.sets = [set() for _ in self.texts]
            for e, t in zip(self.entry.tolist(), self.token.tolist(), strict=True):
                self.sets[e].add(t)
        keep = by[(rank - first) < prefix[self.entry[by]]] if len(by) else by
        self.probe = {}
        for k in self.widths:
            mine = keep[self.width[keep] == k]
            mine = mine[np.argsort(self.token[mine], kind="stable")]
            self.probe[k] = (self.token[mine], self.entry[mine], self.place[mine], membership(self.token[mine]))
        del self.entry, self.place, self.token, self.width


def membership(tokens: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << FILTER_BITS, bool)
    table[(tokens & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
    return table


def found(hashes: np.ndarray, tokens: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``hashes`` of members of the sorted ``tokens``, and where these members begin."""
    likely = np.flatnonzero(table[(hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
    at = np.searchsorted(tokens, hashes[likely])
    same = (at < len(tokens)) & (tokens[np.minimum(at, len(tokens) - 1)] == hashes[likely]) if len(tokens) else np.zeros(len(likely), bool)
    return likely[same], at[same]


def shingle_counts(docs: DataFrame, block) -> DataFrame:
    """How often the block's shingles occur in all documents: ``width, token, n``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = block.value.tokens()
        tables = {k: membership(t) for k, t in tokens.items()}
        totals = {k: np.zeros(len(t), np.int64) for k, t in tokens.items()}
        for batch in batches:
            for _, _, data, offsets in slices(batch, "text", SLICE_BYTES):
                words = find_words(data, offsets, NOT_ALNUM, lower=True)
                for k, known in tokens.items():
                    _, at = found(windows(words, k)[1], known, tables[k])
                    totals[k] += np.bincount(at, minlength=len(known))
        for k, known in tokens.items():
            some = np.flatnonzero(totals[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(known[some].view(np.int64)), pa.array(totals[k][some])], ["width", "token", "n"])

    return docs.select("text").mapInArrow(count, "width int, token long, n long").groupBy("width", "token").agg(F.sum("n").alias("n"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans ``(start, length)`` as disjoint ones."""
    out: list[list[int]] = []
    for start, length in sorted(spans):
        if out and start <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length - out[-1][0])
        else:
            out.append([start, length])
    return [(a, b) for a, b in out]


def slice_hits(block: Block, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[list, set]]]:
    """Word counts of the texts, and of those with hits the spans of words and the items."""
    words = find_words(data, offsets, NOT_ALNUM, lower=True)
    hits: dict[int, tuple[list, set]] = {}
    plain, owner = None, None
    seen: set[tuple[int, int]] = set()
    for k in block.widths:
        tokens, entries, places, table = block.probe[k]
        at, hashes = windows(words, k)
        where, begin = found(hashes, tokens, table)
        if not len(where):
            continue
        if plain is None:
            plain, owner = LOWER[data].tobytes(), words.doc()
        begins = dict(zip(at.tolist(), range(len(at)), strict=True)) if block.similarity < 1 else {}
        for i, j in zip(where.tolist(), begin.tolist(), strict=True):
            pos, token = int(at[i]), tokens[j]
            doc = int(owner[pos])
            low, high = int(words.first[doc]), int(words.first[doc + 1])
            while j < len(tokens) and tokens[j] == token:
                entry, size = int(entries[j]), int(block.sizes[entries[j]])
                if block.similarity >= 1:
                    starts = [pos - int(places[j])]
                else:
                    starts = range(pos - size + k, pos + 1)
                for start in starts:
                    if start < low or start + size > high or (start, entry) in seen:
                        continue
                    seen.add((start, entry))
                    if block.similarity >= 1:
                        same = b" ".join([plain[s:e] for s, e in zip(words.start[start : start + size].tolist(), words.end[start : start + size].tolist(), strict=True)]) == block.texts[entry]
                    else:
                        here = hashes[begins[start] : begins[start] + size - k + 1].tolist()
                        same = len(block.sets[entry].intersection(here)) >= math.ceil(block.similarity * block.members[entry] - 1e-9)
                    if same:
                        spans, items = hits.setdefault(doc, ([], set()))
                        spans.append((start - low, size))
                        items.update(block.items[entry])
                j += 1
    return words.counts, hits


def with_hits(docs: DataFrame, items: DataFrame, window: int | None = 13, shingle: int = 5, similarity: float = 1.0, block: int = 100_000) -> DataFrame:
    """``doc_id, text, _rest`` with ``_n_words``, ``_hits`` (disjoint runs of hit words) and ``_items`` (ids, as strings)."""
    spark = docs.sparkSession
    out = packed(docs).withColumns({"_n_words": F.lit(0).cast("long"), "_hits": F.array().cast(HITS), "_items": F.array().cast("array<string>")})
    wanted = written(item_windows(items, window), "windows")
    blocks = max(1, math.ceil(wanted.count() / block))
    if blocks > 1:
        wanted = written(wanted.withColumn("_block", F.pmod(F.xxhash64("words"), F.lit(blocks))), "window-blocks")
    for number in range(blocks):
        rows = (wanted if blocks == 1 else wanted.filter(F.col("_block") == number)).select("words", "items").collect()
        held = Block(rows, shingle, similarity)
        counts = shingle_counts(docs, spark.sparkContext.broadcast(held)).collect() if rows else []
        held.order({(r["width"], r["token"]): r["n"] for r in counts})
        out = out.mapInArrow(matcher(spark.sparkContext.broadcast(held)), out.schema)
        if number % 4 == 3:
            out = written(out, "hits")
    return out


def matcher(block):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = block.value
        for batch in batches:
            spans, items = batch.column("_hits").to_pylist(), batch.column("_items").to_pylist()
            counts = np.zeros(batch.num_rows, np.int64)
            for low, high, data, offsets in slices(batch, "text", SLICE_BYTES):
                counts[low:high], hits = slice_hits(held, data, offsets)
                for i, (found_spans, found_items) in hits.items():
                    before = [(s["start"], s["length"]) for s in spans[low + i]]
                    spans[low + i] = [{"start": a, "length": b} for a, b in merged(before + found_spans)]
                    items[low + i] = sorted({*items[low + i], *found_items})
            new = {"_n_words": pa.array(counts), "_hits": pa.array(spans, batch.schema.field("_hits").type), "_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(name, batch.column(name)) for name in batch.schema.names], batch.schema.names)

    return match


def judged(docs: DataFrame, items: DataFrame, share: float = 0.05, **options) -> DataFrame:
    """``with_hits`` with ``_n_hit`` and ``_contaminated``: at least ``share`` of the words, and at least one, are hit."""
    hit = F.aggregate("_hits", F.lit(0).cast("long"), lambda total, s: total + s["length"])
    marked = with_hits(docs, items, **options).withColumn("_n_hit", hit)
    part = Fraction(share).limit_denominator(1_000_000)
    return marked.withColumn("_contaminated", (F.col("_n_hit") > 0) & (F.col("_n_hit") * part.denominator >= F.col("_n_words") * part.numerator))


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = 0.05, **options) -> DataFrame:
    """The documents that are not contaminated, with the columns they had."""
    return unpacked(judged(docs, items, share, **options).filter(~F.col("_contaminated")), docs.columns)



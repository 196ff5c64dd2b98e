"""Spelling variants among the words of a corpus by permuterm rotations.

All rotations of a word with a terminator are sorted. Two words that differ in one replaced code point agree in the prefix of a
rotation that begins right behind it and ends right before it; a word with one code point more has such a prefix equal to a whole
rotation of the shorter word. So the words around one edited place are a prefix range of the sorted rotations: at most one word without
and one for each letter of the alphabet with a code point there. Ranges are range-partitioned and sorted, and a scan along each gives
every member its number of neighbours and its most frequent one, so no pairs are ever listed. A deletion from a run of equal letters is
counted at the first of them only, so that each neighbour counts once.

Counting comes first: each task counts distinct words and hands on partial counts, so a frequent word is one row a task.

Defined results: a null or empty text has no words; repeated rows count as often as they occur; a null ``doc_id`` is read as an empty text
where a document's words are altered; an empty table gives no words; other columns are not read. Words are compared by code points,
ties go to the smallest.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.store import slices, written
from emberline.llm.words import BYTE_VALUES, LOWER, runs_inside, span_hashes

SLICE_BYTES = 2 << 20
HELD_WORDS = 400_000  # words a task counts before it hands them on
LONG_WORD = 64  # bytes; checksums of longer words are taken one by one
TERMINATOR = "$"  # no letter
LATIN = 0xC3  # lead byte of the letters U+00C0 to U+00FF
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), LATIN]] = True


def _checksum_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


CHECKSUMS = _checksum_table()


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes of ASCII letters and of the code points U+00C0 to U+00FF."""
    inside = LETTER[data]
    inside[1:] |= data[:-1] == LATIN
    return inside


def checksums(data: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of spans of bytes, each continued from the checksum of what stands before it."""
    out = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-size, kind="stable")
    ordered, begin = size[order], start[order]
    state = out[order]
    for i in range(int(min(ordered[0], LONG_WORD)) if len(ordered) else 0):
        n = int(np.searchsorted(-ordered, -i, side="left"))  # spans longer than i
        state[:n] = CHECKSUMS[(state[:n] ^ data[begin[:n] + i]) & 0xFF] ^ state[:n] >> 8
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = zlib.crc32(data[start[k] : start[k] + size[k]].tobytes(), int(before[k]))
    return out


def altered(word: str, checksum: int, rate: int) -> str:
    """The word, without one code point if ``rate`` divides the checksum."""
    if checksum % rate:
        return word
    i = checksum % len(word)
    return word[:i] + word[i + 1 :]


def word_counts(docs: DataFrame, drop_rate: int | None = None) -> DataFrame:
    """``word, n``: lower-cased runs of letters and how often they occur in all texts.

    With ``drop_rate`` a document's word whose CRC-32 with the id (``<doc_id>:<word>``) is divided by it loses a code point first.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def handed_on() -> pa.RecordBatch:
            columns = [pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for low, high, data, offsets in slices(batch, "text", SLICE_BYTES):
                data = LOWER[data]
                start, end = runs_inside(letters(data), offsets)
                if not len(start):
                    continue
                hashes = span_hashes(data, start, end, BYTE_VALUES)
                raw = data.tobytes()
                if drop_rate:
                    doc = np.searchsorted(offsets, start, side="right") - 1
                    order = np.lexsort((hashes, doc))
                    fresh = np.flatnonzero(np.concatenate([[True], (doc[order][1:] != doc[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])]))
                    one, times = order[fresh], np.diff(np.append(fresh, len(order)))
                    before = np.array([zlib.crc32(f"{'' if names[low + d] is None else names[low + d]}:".encode()) for d in range(high - low)], np.uint32)
                    sums = checksums(data, start[one], (end - start)[one], before[doc[one]])
                    hit = sums % drop_rate == 0
                    for k, n, checksum in zip(one[hit].tolist(), times[hit].tolist(), sums[hit].tolist(), strict=True):
                        word = altered(raw[start[k] : end[k]].decode(), checksum, drop_rate).encode()
                        held[word] = held.get(word, 0) + n
                    one, times = one[~hit], times[~hit]
                else:
                    one, times = np.arange(len(start)), np.ones(len(start), np.int64)
                kinds, where, back = np.unique(hashes[one], return_index=True, return_inverse=True)
                totals = np.zeros(len(kinds), np.int64)
                np.add.at(totals, back, times)
                for k, n in zip(one[where].tolist(), totals.tolist(), strict=True):
                    word = raw[start[k] : end[k]]
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD_WORDS:
                    yield handed_on()
                    held.clear()
        yield handed_on()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rotations(words: DataFrame) -> DataFrame:
    """``range, word, n, edited, first``: every prefix range a word is in. ``edited`` tells whether the word has a code point at the
    range's place (and ``first`` that it is the first of its run there), or is the range's whole rotation."""
    at = F.posexplode(F.sequence(F.lit(0), F.char_length("word")))
    placed = words.select("word", "n", at.alias("_", "i"))
    turned: Callable[[Column], Column] = lambda skip: F.concat(F.substr("word", F.col("i") + 1 + skip), F.lit(TERMINATOR), F.substr("word", F.lit(1), F.col("i")))
    here, before = F.substr("word", F.col("i") + 1, F.lit(1)), F.substr("word", F.col("i"), F.lit(1))
    whole = F.struct(turned(F.lit(0)).alias("range"), F.lit(False).alias("edited"), F.lit(False).alias("first"))
    skipping = F.struct(turned(F.lit(1)).alias("range"), F.lit(True).alias("edited"), ((F.col("i") == 0) | (here != before)).alias("first"))
    both = F.when(F.col("i") < F.char_length("word"), F.array(whole, skipping)).otherwise(F.array(whole))
    return placed.select("word", "n", F.inline(both))


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near, near, near_n`` of every word (unique, with counts ``n``) that has a near word: how many, and the most frequent one."""
    spread = rotations(words).repartitionByRange("range")
    inside = Window.partitionBy("range")
    ranked = inside.orderBy(F.col("n").desc(), "word")
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scanned = spread.select(
        "word",
        "edited",
        "first",
        F.row_number().over(ranked).alias("_place"),
        F.count(F.when(F.col("edited"), 1)).over(whole).alias("_edited"),
        F.count(F.when(F.col("first"), 1)).over(whole).alias("_first"),
        F.count(F.lit(1)).over(whole).alias("_all"),
        *[F.nth_value(c, k).over(whole).alias(f"_{c}{k}") for c in ("word", "n") for k in (1, 2)],
    ).filter("_all > 1")
    top = F.col("_place") == 1
    found = scanned.select(
        "word",
        F.when(~F.col("edited"), F.col("_first")).otherwise(F.col("_edited") - 1 + F.when(F.col("first"), F.col("_all") - F.col("_edited")).otherwise(0)).alias("here"),
        F.when(top, F.col("_word2")).otherwise(F.col("_word1")).alias("near"),
        F.when(top, F.col("_n2")).otherwise(F.col("_n1")).alias("near_n"),
    )
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    summed = found.groupBy("word").agg(F.sum("here").alias("n_near"), best.alias("_best"))
    return summed.select("word", "n_near", F.col("_best.near").alias("near"), (-F.col("_best.minus")).alias("near_n"))


def rooted(forms: DataFrame) -> DataFrame:
    """``word, root`` of every word that has a form (``word, form``; no circles), by doubling the way each turn."""
    state = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        joined = state.join(ahead, state["root"] == ahead["_at"], "left")
        state = written(joined.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        if state.filter("_moved").isEmpty():
            return state.select("word", "root")
        state = state.drop("_moved")


def variants(counts: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of the words (``word, n``) with enough code points and occurrences.

    A word's form is its most frequent near word (ties: the smallest), if that occurs ``ratio`` times as often (at least twice); its root ends the chain of forms.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their words, or chains may not end")
    words = written(counts.filter((F.char_length("word") >= min_length) & (F.col("n") >= min_count)), "words")
    near = neighbours(words)
    joined = words.join(near, "word", "left")
    formed = F.col("near_n") >= ratio * F.col("n")
    judged = written(
        joined.select("word", F.when(formed, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("near_n")).alias("form_n")), "forms"
    )
    roots = rooted(judged.filter("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

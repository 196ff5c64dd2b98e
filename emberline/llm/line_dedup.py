"""Line deduplication with DataFrame functions only.

A line's key is the line without blanks at its ends, A-Z in lower case. The hashed keys are range-partitioned by
``(key, document, position)`` and sorted so inside partitions, so one frequent line spreads over many partitions. The
first occurrences stream out of these sorted runs: each task sums its runs before anything is exchanged by key. Lines find the repeated keys
by key; the keys that hold more than a part in ``HOT_PARTS`` of all lines, at most so many, are broadcast instead, so that none of them fills a task. What
returns to a document is a compressed keep bitmap - the runs of kept lines - and never text.

Defined results: a null or empty text is one empty line; keys shorter than ``min_chars`` are always kept; every row is a
document of its own when documents are counted, rows equal in ``doc_id`` and text share one bitmap; a null ``doc_id`` is a
value like any other; an empty table gives an empty result; other columns pass through ``drop_lines`` untouched.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.store import packed, unpacked, written

BLANKS = " \t\n\x0b\x0c\r"
HOT_PARTS = 1024
RUNS = "array<struct<start:int,length:int>>"


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """Blanks off both ends, A-Z lower-cased and nothing else; ASCII lines take the fast built-in."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line with a long enough key: key hash, document, position, line count, first of its key in the row."""
    keys = F.transform(text_lines(F.col("text")), line_key)
    hashed = F.transform(keys, lambda k, i: F.struct(F.when(F.char_length(k) >= min_chars, F.md5(k.cast("binary"))).alias("key"), i.alias("pos")))
    ordered = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.array_sort(hashed).alias("_keys"))
    flagged = F.transform(
        "_keys",
        lambda x, i: F.struct(
            x["key"].alias("key"),
            x["pos"].alias("pos"),
            F.when(i == 0, True).otherwise(~F.get("_keys", i - 1)["key"].eqNullSafe(x["key"])).alias("fresh"),
        ),
    )
    return (
        ordered.select("doc_id", "_text", F.size("_keys").alias("n_lines"), F.explode(flagged).alias("_line"))
        .select("_line.key", "doc_id", "_text", "_line.pos", "n_lines", "_line.fresh")
        .filter(F.col("key").isNotNull())
    )


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Keep bitmaps of the documents that lose lines: ``doc_id, _text`` (hash of the text), ``n_lines, n_dropped, kept``.

    A key in at least ``min_docs`` documents loses all its lines, or with ``keep_first`` all but the first in order of
    ``doc_id`` and position. ``kept`` lists the runs of kept lines. Documents without a row keep everything.
    """
    # written first: the range partitioning samples its input, and both uses below read it again
    lines = written(occurrences(docs, min_chars), "lines")
    runs = lines.repartitionByRange("key", "doc_id", "pos").sortWithinPartitions("key", "doc_id", "pos")
    counts = runs.groupBy("key").agg(
        F.sum(F.col("fresh").cast("long")).alias("_docs"), F.min(F.struct("doc_id", "_text", "pos")).alias("_first"), F.count(F.lit(1)).alias("_lines")
    )
    repeated = written(counts.filter(F.col("_docs") >= min_docs).select("key", "_first", "_lines"), "repeated")
    limit = lines.count() // HOT_PARTS
    # fewer than HOT_PARTS keys can have more lines than that
    hot = F.broadcast(repeated.filter(F.col("_lines") > limit).select("key", F.col("_first").alias("_hot")))
    met = lines.join(hot, "key", "left")
    others = met.filter(F.col("_hot").isNull()).drop("_hot").join(repeated.filter(F.col("_lines") <= limit).drop("_lines"), "key")
    lost = met.filter(F.col("_hot").isNotNull()).withColumnRenamed("_hot", "_first").unionByName(others)
    if keep_first:
        lost = lost.filter(~F.struct("doc_id", "_text", "pos").eqNullSafe(F.col("_first")))
    dropped = lost.groupBy("doc_id", "_text").agg(F.max("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("_pos"))
    starts = F.concat(F.array(F.lit(0)), F.transform("_pos", lambda p: p + 1))
    ends = F.concat("_pos", F.array("n_lines"))
    kept = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s).alias("length"))), lambda r: r["length"] > 0)
    return dropped.select("doc_id", "_text", "n_lines", F.size("_pos").alias("n_dropped"), kept.cast(RUNS).alias("kept"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Documents beside their bitmap columns ``_n_dropped`` and ``_kept`` (null: all kept)."""
    right = bitmaps.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hash"), F.col("n_dropped").alias("_n_dropped"), F.col("kept").alias("_kept"))
    same = docs["doc_id"].eqNullSafe(right["_id"]) & (F.xxhash64(docs["text"]) == right["_hash"])
    return docs.join(right.hint("shuffle_hash"), same, "left").drop("_id", "_hash")


def kept_lines(text: Column, kept: Column) -> Column:
    lines = text_lines(text)
    return F.when(kept.isNull(), lines).otherwise(F.flatten(F.transform(kept, lambda r: F.slice(lines, r["start"] + 1, r["length"]))))


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the text of the kept lines; a text without dropped lines, null included, stays as it is.

    With ``drop_emptied`` documents go of whose lines only blanks stay; documents that lost no line never go.
    """
    joined = with_bitmaps(packed(docs), keep_bitmaps(docs.select("doc_id", "text"), min_docs, min_chars, keep_first))
    text = F.when(F.col("_kept").isNull(), F.col("text")).otherwise(F.array_join(kept_lines(F.col("text"), F.col("_kept")), "\n"))
    shorter = joined.withColumn("text", text)
    if drop_emptied:
        shorter = shorter.filter(F.col("_kept").isNull() | (F.btrim("text", F.lit(BLANKS)) != ""))
    return unpacked(shorter, docs.columns)

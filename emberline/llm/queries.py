"""Queries of the operators in this package over the given tables, and the SQL counterparts where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import (
    chat_events,
    decontaminate,
    language_id,
    line_dedup,
    mpeg_audio,
    ngram_join,
    packing,
    pieces,
    quality,
    ranked_search,
    spelling,
    substring_dedup,
    zip_archives,
)
from emberline.llm.store import table, written

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    LLM_QUERIES[function.__name__] = function
    return function


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents go everywhere; counts and the digest of what stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=10, min_chars=1))
    kept = F.array_join(line_dedup.kept_lines(F.col("text"), F.col("_kept")), "\n")
    return joined.select(
        "doc_id",
        F.size(line_dedup.text_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("_n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.when(F.col("_kept").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).cast("binary"), 256).alias("kept_sha256"),
    )


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside 13-word benchmark windows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.judged(docs, table(spark, sf_dir, "benchmark"), share=0.05, window=13)
    return marked.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ",").cast("binary"), 256).alias("items_sha256"),
        F.col("_contaminated").alias("contaminated"),
    )


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens; the digest of each piece's ids and its place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)
    narrow = written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces")
    return packing.pack(narrow, capacity=2048)


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in 20-word windows that start earlier elsewhere go; counts and the digest of what stays."""
    done = substring_dedup.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=20)
    return done.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.aggregate("_removed", F.lit(0).cast("long"), lambda total, s: total + s["length"]).alias("n_removed"),
        F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"),
    )


@query
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are at least 90 % alike."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.component_ids(docs, size=3, similarity=(9, 10)).drop("v")


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, from a model that never saw a quarter of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = language_id.train(docs.filter(~held_out).select("text", "lang"))
    return language_id.with_language(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score")
    )


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: weak label, number of votes, score, and whether it is judged good."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.with_quality(docs, quality.train(docs))
    return judged.select(
        "doc_id", F.col("_weak").alias("weak_label"), F.col("_votes").alias("n_votes"), F.col("_quality").alias("quality"), (F.col("_quality") >= 0.5).alias("good")
    )


@query
def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as MPEG audio and read back."""
    media = written(mpeg_audio.stored(table(spark, sf_dir, "documents").select("doc_id", "text"), unit=192), "media")
    back = mpeg_audio.with_facts(media)
    names = ("layer", "rate", "frames", "table_frames", "samples", "duration", "bad_checksums", "min_kbps", "max_kbps")
    told = {name: F.col("facts")[name].cast("string") for name in names}
    seeks = F.col("facts")["seek_offsets"]
    told["seek_points"] = F.size(seeks).cast("string")
    told["seek_crc32"] = F.crc32(F.array_join(F.transform(seeks, lambda at: at.cast("string")), ",").cast("binary")).cast("string")
    feature = F.concat_ws(";", *[F.concat(F.lit(f"{name}="), F.coalesce(value, F.lit(""))) for name, value in told.items()])
    same = [F.col("facts")[name].alias(name) for name in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")]
    return back.select("doc_id", "n_bytes", *same, feature.alias("feature"))


@query
def op6_zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records in ZIP packages, read back by ranges."""
    archives = zip_archives.archived(table(spark, sf_dir, "pages"), least_bytes=100)
    return zip_archives.records(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op8_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as event logs, rebuilt, rendered and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    log = written(chat_events.event_log(turns.union(extra)), "events")
    return chat_events.conversation_digests(chat_events.messages(log))


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents for every benchmark item."""
    return ranked_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), top=50)


@query
def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as SentencePiece ids and decoded again; counts and digests."""
    done = pieces.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    digits = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(digits.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their near words, the form each is a variant of, and the root of its forms."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(spelling.word_counts(docs, drop_rate=97), min_length=5, min_count=3, ratio=2)

"""The corpus pipeline: five stages over ``documents``, each on everything its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next one's ``docs``. All but the
last return the columns of documents. Nulls, empty texts, repeated rows, empty tables and further columns are handled as the
operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from emberline.llm.store import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go, and all if no document teaches a language. Text in a language that no label teaches is not told apart.

    From here on ``lang`` is the language found in the text, whatever the label was; the pieces that are packed carry it.
    """
    return language_id.keep_identified(docs, language_id.train(docs), into="lang")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines found in ten documents the first stays; documents of which nothing is left go."""
    shorter = line_dedup.drop_lines(docs, min_docs=10, keep_first=True, drop_emptied=True)
    return shorter.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else shorter


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 of their five-word shingles, the one with the least id stays."""
    return ngram_join.keep_one(docs, size=5, similarity=(4, 5))


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words in 13-word windows of the benchmark go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), share=0.05, window=13)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, each with its document's language, in sequences of at most 2048 tokens."""
    carry = [c for c in ("lang",) if c in docs.columns]
    # workers that have run the earlier stages remember fewer pre-tokens
    pieces = packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0, cached=200_000, carry=carry)
    return packing.pack(written(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces"), capacity=2048)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_join", keep_one_of_each_group),
    ("decontaminate", drop_benchmark_text),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

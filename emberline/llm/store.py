"""Written intermediate tables and small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.sources.scratch import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``doc_id, text, _rest``: all other columns in one struct, so that no name of theirs can clash with a new column."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", text)]
    return docs.select("doc_id", F.col(text).alias("text"), F.struct(*rest, F.lit(0).alias("_none")).alias("_rest"))


def unpacked(df: DataFrame, columns: list[str], new: Mapping[str, Column] | None = None) -> DataFrame:
    """The columns of the table that ``packed`` took, in their order; those in ``new`` with new values."""
    new = new or {}
    return df.select(*[new[c].alias(c) if c in new else F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c) for c in columns])


def text_hash() -> Column:
    return F.xxhash64("text")


def distinct_texts(docs: DataFrame, hashes: list[int]) -> DataFrame:
    """``_hash, text``: each distinct text with one of a bounded number of hashes, once."""
    return docs.select(text_hash().alias("_hash"), "text").filter(F.col("_hash").isin(hashes)).distinct()


def slices(batch: pa.RecordBatch, column: str, limit: int):
    """Cut a batch into runs of rows with about ``limit`` bytes of ``column`` each; a longer value stands alone.

    Yields ``(first row, end row, data, offsets)``: the UTF-8 bytes of the rows as one ``uint8`` array and the ``n + 1``
    places where each row begins in it. Nulls have no bytes.
    """
    import numpy as np

    values = batch.column(column)
    if pa.types.is_string(values.type):
        values = values.cast(pa.large_string())
    elif not pa.types.is_large_string(values.type):
        values = values.cast(pa.large_binary())
    if values.null_count:
        values = values.fill_null("" if pa.types.is_large_string(values.type) else b"")
    n = len(values)
    if not n:
        return
    _, at, data = values.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[values.offset : values.offset + n + 1]
    everything = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), n)
        low, high = int(offsets[first]), int(offsets[end])
        yield first, end, everything[low:high], offsets[first : end + 1] - low
        first = end

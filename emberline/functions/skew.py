"""Joins of many rows with a one-row-per-key table when single keys may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def keyed_join(rows: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows with ``per_key`` (one row per key), which is broadcast where its measured size allows.

    Where it does not, both sides are shuffled, and adaptive execution splits the rows of a hot key by measured size and repeats the key's one row
    for each part (``spark.sql.adaptive.skewJoin.enabled``, on by default).
    """
    return rows.join(per_key, list(keys), how)

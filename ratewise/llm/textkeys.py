"""Texts found again by their digest, so that jobs can carry keys instead of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small


def text_key(text: str = "text") -> Column:
    """128 bits of the text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def texts_of(docs: DataFrame, keys: DataFrame, rows: int) -> DataFrame:
    """``text_key, text`` for the distinct ``keys``; copies of a text are collapsed before they meet.

    ``rows`` bounds the number of keys; few keys are broadcast, many are joined by shuffle.
    """
    keyed = docs.select(text_key().alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    some = keyed.join(broadcast_if_small(keys, rows, 32), "text_key", "left_semi")
    return some.groupBy("text_key").agg(F.first("text").alias("text"))

"""Table contracts: which columns a job needs, and how keys and ratings are typed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATING_COLUMNS = ("user_id", "item_id", "rating")
ITEM_COLUMNS = ("item_id", "text")
INTERACTION_COLUMNS = ("user_id", "game_title", "behavior_name", "value")


class ContractError(ValueError):
    """A table does not meet its contract."""


def require_columns(df: DataFrame, columns: Iterable[str], name: str) -> DataFrame:
    """Fail at plan time, naming the missing and the present columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"{name}: missing columns {missing}, present columns {df.columns}")
    return df


def number_or_zero(column) -> F.Column:
    """Numeric coercion: text that is no number, NULL and NaN become 0."""
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.nanvl(value.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def as_ratings(df: DataFrame, string_ids: bool = False) -> DataFrame:
    """The ratings contract with a double rating; ids keep their type unless asked otherwise."""
    require_columns(df, RATING_COLUMNS, "ratings")
    user, item = F.col("user_id"), F.col("item_id")
    if string_ids:
        user, item = user.cast("string").alias("user_id"), item.cast("string").alias("item_id")
    return df.select(user, item, number_or_zero("rating").alias("rating"))


def training_ratings(df: DataFrame) -> DataFrame:
    """Ratings that a model may learn from: rows whose rating is NULL, NaN or no number are dropped.

    ``invalid_ratings`` counts them.
    """
    require_columns(df, RATING_COLUMNS, "ratings")
    value = F.nanvl(F.col("rating").try_cast("double"), F.lit(None).cast("double"))
    return df.select("user_id", "item_id", value.alias("rating")).filter(F.col("rating").isNotNull())


def invalid_ratings(df: DataFrame) -> DataFrame:
    """``n``, ``n_invalid``: all rows, and those that ``training_ratings`` drops."""
    value = F.nanvl(F.col("rating").try_cast("double"), F.lit(None).cast("double"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(value.isNull(), 1)).alias("n_invalid"))


def as_items(df: DataFrame) -> DataFrame:
    require_columns(df, ITEM_COLUMNS, "items")
    return df.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def duplicate_pairs(ratings: DataFrame) -> DataFrame:
    """(user, item) pairs that occur more than once, with their count."""
    return (
        ratings.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    )


def check_unique_pairs(ratings: DataFrame) -> DataFrame:
    """Raise when a user rated an item twice. Runs one job; the pairs never reach the driver."""
    first = duplicate_pairs(ratings).limit(1).collect()
    if first:
        raise ContractError(f"Duplicate user-item ratings, for example {first[0].asDict()}")
    return ratings

"""Row filters: behaviour modes, activity, samples, text constraints, metadata limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import number_or_zero
from ..functions.recipes import GOAL_HIGH_PROTEIN, GOAL_LOW_CALORIE
from ..functions.text import col, contains_any, hash_order, strip
from .ranking import rank_rows

BEHAVIOURS = {"play_only": ["play"], "purchase_only": ["purchase"], "both": ["purchase", "play"]}


def filter_behaviour(interactions: DataFrame, mode: str) -> DataFrame:
    if mode not in BEHAVIOURS:
        raise ValueError(f"mode must be one of {sorted(BEHAVIOURS)}")
    cleaned = F.lower(strip(F.col("behavior_name")))
    return interactions.withColumn("behavior_name", cleaned).filter(cleaned.isin(BEHAVIOURS[mode]))


def implicit_ratings(interactions: DataFrame, transform: str = "log1p") -> DataFrame:
    """One rating per interaction: a purchase counts 1, otherwise the (coerced) value."""
    if transform not in ("raw", "log1p"):
        raise ValueError("transform must be 'raw' or 'log1p'")
    raw = F.when(F.col("behavior_name") == "purchase", F.lit(1.0)).otherwise(number_or_zero("value"))
    return interactions.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("game_title").cast("string").alias("item_id"),
        (F.log1p(raw) if transform == "log1p" else raw).alias("rating"),
    )


def highest_rating(ratings: DataFrame) -> DataFrame:
    """One row per (user, item): the highest rating."""
    return ratings.groupBy("user_id", "item_id").agg(F.max("rating").alias("rating"))


def active_users(ratings: DataFrame, min_interactions: int) -> DataFrame:
    """Keep users with at least so many rows; 0 and 1 keep everyone."""
    if min_interactions <= 1:
        return ratings
    keep = (
        ratings.groupBy("user_id")
        .agg(F.count("item_id").alias("n"))
        .filter(F.col("n") >= min_interactions)
    )
    return ratings.join(keep, "user_id", "left_semi")


def sample_users(ratings: DataFrame, n: int | None, seed: int = 42) -> DataFrame:
    """All rows of n users picked by hash order; None or n <= 0 keeps everyone."""
    if n is None or n <= 0:
        return ratings
    users = ratings.select("user_id").distinct().withColumn("_order", hash_order(seed, "user_id"))
    if n <= 100_000:
        picked = users.orderBy("_order", "user_id").limit(n)
    else:  # a large limit would put all picked users into one task
        ranked = rank_rows(users, [], [F.col("_order"), F.col("user_id")])
        picked = ranked.filter(F.col("rank") <= n)
    return ratings.join(picked.select("user_id"), "user_id", "left_semi")


def items_in_use(items: DataFrame, ratings: DataFrame) -> DataFrame:
    return items.join(ratings.select("item_id").distinct(), "item_id", "left_semi")


def known_only(rows: DataFrame, params: DataFrame, key: str) -> DataFrame:
    """Rows whose id was seen in training."""
    return rows.join(params.select(key), key, "left_semi")


def unknown_only(rows: DataFrame, params: DataFrame, key: str) -> DataFrame:
    return rows.join(params.select(key), key, "left_anti")


def contains_id(params: DataFrame, key: str, value) -> bool:
    """Was this one id seen in training?"""
    return bool(params.filter(F.col(key) == F.lit(value)).limit(1).collect())


def drop_known(candidates: DataFrame, known: DataFrame) -> DataFrame:
    return candidates.join(known.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")


def text_constraints(
    candidates: DataFrame,
    avoid: Column | str | None = None,
    must_include: Column | str | None = None,
    text: str = "text",
) -> DataFrame:
    """Drop texts with an avoid term; if must-include terms are given, keep texts with any."""
    out = candidates
    if avoid is not None:
        out = out.filter(~contains_any(text, col(avoid)))
    if must_include is not None:
        wanted = col(must_include)
        out = out.filter((F.size(wanted) == 0) | contains_any(text, wanted))
    return out


def at_most(column: str, limit: Column | float) -> Column:
    """Missing values pass."""
    bound = F.lit(limit) if isinstance(limit, (int, float)) else limit
    return F.col(column).isNull() | (F.col(column) <= bound)


def at_least(column: str, limit: float) -> Column:
    return F.col(column).isNull() | (F.col(column) >= F.lit(limit))


def metadata_limits(
    candidates: DataFrame,
    max_time: Column | float | None = None,
    goal: Column | str | None = None,
    strict_protein: bool = True,
    strict_calories: bool = True,
) -> DataFrame:
    """Time, protein and calorie limits; an item without metadata passes each of them."""
    out = candidates
    if max_time is not None:
        out = out.filter(at_most("time_min", max_time))
    if goal is not None:
        asked = F.coalesce(col(goal), F.lit(""))
        if strict_protein:
            out = out.filter((asked != GOAL_HIGH_PROTEIN) | at_least("protein_score", 2.0))
        if strict_calories:
            out = out.filter((asked != GOAL_LOW_CALORIE) | at_least("low_calorie_score", 1.0))
    return out

"""Reproducible splits. Every choice follows a hash of the ids, never a random generator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_bucket, hash_order
from .ranking import rank_rows, top_k


def holdout_split(ratings: DataFrame, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; each row decides for itself, so nothing is shuffled."""
    marked = ratings.withColumn("_b", hash_bucket(seed, 10_000, "user_id", "item_id"))
    edge = round(test_share * 10_000)
    train = marked.filter(F.col("_b") >= edge).drop("_b")
    test = marked.filter(F.col("_b") < edge).drop("_b")
    return train, test


def fold_column(ratings: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    return ratings.withColumn("fold", hash_bucket(f"fold{seed}", folds, "user_id", "item_id"))


def new_user_split(ratings: DataFrame, frac_new_users: float, seed: int = 42) -> DataFrame:
    """Adds ``part``: 'train' for old users, 'update' or 'test' halves for the new ones.

    The new users are an exact number of users in hash order; each of their histories is
    halved by position, also in hash order. Both rankings split hot users.
    """
    users = ratings.select("user_id").distinct().withColumn("_h", hash_order(seed, "user_id"))
    ranked = rank_rows(users, [], [F.col("_h"), F.col("user_id")])
    wanted = ranked.agg(F.round(F.count(F.lit(1)) * F.lit(float(frac_new_users)))).scalar()
    new_users = ranked.withColumn("_n", wanted).filter(F.col("rank") <= F.col("_n")).select("user_id")
    old = ratings.join(new_users, "user_id", "left_anti").withColumn("part", F.lit("train"))
    new = ratings.join(new_users, "user_id", "left_semi")
    new = new.withColumn("_h", hash_order(f"half{seed}", "user_id", "item_id"))
    halves = rank_rows(new, ["user_id"], [F.col("_h"), F.col("item_id")], "_r")
    halves = halves.withColumn("part", F.when(F.col("_r") % 2 == 1, "update").otherwise("test"))
    return old.unionByName(halves.drop("_h", "_r"))


def per_user_holdout(
    ratings: DataFrame, n_test: int = 1, positive_threshold: float = 4.0, seed: int = 42
) -> DataFrame:
    """Adds ``is_test``: n_test positives per user in hash order, else the n_test top rated.

    Users with n_test or fewer rows are dropped. Only n_test rows per user and map task are
    shuffled to find the test rows.
    """
    positive = F.col("rating") >= F.lit(float(positive_threshold))
    users = (
        ratings.groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(positive.cast("int")).alias("_pos"))
        .filter(F.col("_n") > n_test)
        .select("user_id", (F.col("_pos") >= n_test).alias("_by_hash"))
    )
    rows = ratings.join(users, "user_id")
    level = F.when(F.col("_by_hash"), positive.cast("double")).otherwise(F.col("rating").cast("double"))
    shuffle = F.when(F.col("_by_hash"), hash_order(seed, "user_id", "item_id"))
    test = top_k(
        rows.withColumn("_level", level).withColumn("_shuffle", shuffle),
        ["user_id"],
        [F.desc("_level"), F.asc("_shuffle"), F.asc("item_id")],
        n_test,
        "_rank",
    ).select("user_id", "item_id", F.lit(True).alias("is_test"))
    return (
        rows.drop("_by_hash")
        .join(test, ["user_id", "item_id"], "left")
        .withColumn("is_test", F.coalesce("is_test", F.lit(False)))
    )

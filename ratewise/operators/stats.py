"""Descriptive statistics: features per user and item, popularity, profiles, data health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import as_ratings
from ..functions.text import col, strip
from ..session import broadcast_if_small
from .quantiles import exact_percentiles


def rating_features(ratings: DataFrame, side: str) -> DataFrame:
    """Count, mean, sample deviation, min and max per user or item, with the global values.

    ``side`` is "user" or "item". The global row is a scalar subquery, not a join.
    """
    if side not in ("user", "item"):
        raise ValueError("side must be 'user' or 'item'")
    rows = as_ratings(ratings, string_ids=True)
    mean = rows.agg(F.avg("rating")).scalar()
    std = rows.agg(F.coalesce(F.stddev_samp("rating"), F.lit(0.0))).scalar()
    return (
        rows.groupBy(f"{side}_id")
        .agg(
            F.count(F.lit(1)).alias(f"{side}_interactions"),
            F.avg("rating").alias(f"{side}_rating_mean"),
            F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias(f"{side}_rating_std"),
            F.min("rating").alias(f"{side}_rating_min"),
            F.max("rating").alias(f"{side}_rating_max"),
        )
        .withColumn("global_rating_mean", mean)
        .withColumn("global_rating_std", std)
    )


def popularity(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def popular_items(ratings: DataFrame, n: int) -> DataFrame:
    """The n most rated items, ties by id, with their rank."""
    top = popularity(ratings).orderBy(F.desc("n"), "item_id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "item_id")))


def ingest_report(ratings: DataFrame, items: DataFrame) -> DataFrame:
    """Rows, users, items, and the share of items whose text is more than their id."""
    enriched = items.agg(
        F.coalesce(F.avg((F.col("text") != F.col("item_id").cast("string")).cast("double")), F.lit(0.0))
    ).scalar()
    return ratings.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("user_id").alias("n_users"),
        F.countDistinct("item_id").alias("n_items"),
    ).withColumn("enriched_text_ratio", enriched)


def column_profile(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Missing rate and number of distinct values per column, in long form."""
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    aggregates = []
    for i, name in enumerate(df.columns):
        aggregates.append(F.avg(F.col(name).isNull().cast("double")).alias(f"m{i}"))
        aggregates.append(distinct(F.col(name)).alias(f"d{i}"))
    row = df.agg(*aggregates)
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                F.col(f"m{i}").alias("missing_rate"),
                F.col(f"d{i}").alias("n_distinct"),
            )
            for i, name in enumerate(df.columns)
        ]
    )
    return row.select(F.inline(entries))


def describe(
    df: DataFrame,
    measures: dict[str, Column],
    percentiles=(0.25, 0.5, 0.75, 0.9, 0.95),
    approximate: bool = False,
) -> DataFrame:
    """Count, mean, deviation, min, percentiles and max of each measure, one row per measure."""
    plain = [
        F.struct(
            F.lit(measure).alias("measure"),
            F.count(measure).alias("n"),
            F.avg(measure).alias("mean"),
            F.stddev_samp(measure).alias("std"),
            F.min(measure).cast("double").alias("min"),
            F.max(measure).cast("double").alias("max"),
            *([F.percentile_approx(measure, list(percentiles)).cast("array<double>").alias("quantiles")] if approximate else []),
        ).alias(measure)
        for measure in measures
    ]
    wide = df.select(*[c.alias(m) for m, c in measures.items()])
    rows = wide.agg(*plain).select(F.inline(F.array(*[F.col(m) for m in measures])))
    if not approximate:
        found = exact_percentiles(wide, {m: F.col(m) for m in measures}, list(percentiles))
        rows = rows.join(broadcast_if_small(found, len(measures), 64 + 8 * len(percentiles)), "measure", "left")
    return rows.select(
        "measure", "n", "mean", "std", "min",
        *[F.col("quantiles")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(percentiles)],
        "max",
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter(F.col(column).isNotNull())


def top_tokens(df: DataFrame, lists: Column | str, n: int = 30) -> DataFrame:
    """The n most frequent entries of a list column, trimmed and lower-cased."""
    entries = df.select(F.explode(col(lists)).alias("token"))
    cleaned = entries.select(F.lower(strip("token")).alias("token")).filter(F.length("token") > 0)
    counted = cleaned.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "token").limit(n)


def duplicate_rate(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows that repeat an earlier value; NULL counts as one value."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    for name in columns:
        has_null = F.max(F.col(name).isNull().cast("int"))
        aggregates.append((F.countDistinct(name) + F.coalesce(has_null, F.lit(0))).alias(f"d_{name}"))
    row = df.agg(*aggregates)
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("column_name"),
                F.coalesce(
                    F.try_divide((F.col("n") - F.col(f"d_{name}")).cast("double"), F.col("n")), F.lit(0.0)
                ).alias("duplicate_rate"),
            )
            for name in columns
        ]
    )
    return row.select(F.inline(entries))


def rating_distribution(ratings: DataFrame) -> DataFrame:
    users = ratings.agg(F.countDistinct("user_id")).scalar()
    items = ratings.agg(F.countDistinct("item_id")).scalar()
    return (
        ratings.groupBy("rating")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("n_users", users)
        .withColumn("n_items", items)
    )


def data_health(ratings: DataFrame, head_share: float = 0.2, cold_below: int = 5) -> DataFrame:
    """Sparsity, share of the ratings held by the most rated items, share of cold users.

    All figures follow from two histograms "count -> number of items" and "count -> number of users".
    Ids with equal counts are interchangeable, and with R ratings a histogram has at most sqrt(2R)
    rows, small enough for one ordered window. Without ratings the shares and the sparsity are null.
    """
    items, users = (
        ratings.groupBy(key).agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(
            F.count(F.lit(1)).alias("m"), F.count(key).alias("known")
        )
        for key in ("item_id", "user_id")
    )
    whole = Window.orderBy(F.desc("n"))
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    everything = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.ceil(F.sum("m").over(everything) * F.lit(head_share)) - F.coalesce(F.sum("m").over(before), F.lit(0))
    head = items.withColumn("_taken", F.greatest(F.lit(0), F.least(F.col("m"), left)))
    total = F.sum(F.col("n") * F.col("m"))
    of_items = head.agg(
        F.struct(
            F.coalesce(F.sum("known"), F.lit(0)).alias("n_items"),
            F.try_divide(F.sum(F.col("n") * F.col("_taken")).cast("double"), total).alias("head_item_share"),
        )
    ).scalar()
    cold = F.sum(F.when(F.col("n") < cold_below, F.col("m")).otherwise(0)).cast("double")
    row = users.agg(
        F.coalesce(total, F.lit(0)).alias("n_ratings"),
        F.coalesce(F.sum("known"), F.lit(0)).alias("n_users"),
        F.try_divide(cold, F.sum("m")).alias("cold_user_share"),
    ).withColumn("_items", of_items)
    cells = F.col("n_users").cast("double") * F.col("_items.n_items")
    return row.select(
        "n_ratings", "n_users", F.col("_items.n_items").alias("n_items"),
        (1.0 - F.try_divide(F.col("n_ratings").cast("double"), cells)).alias("sparsity"),
        F.col("_items.head_item_share").alias("head_item_share"), "cold_user_share",
    )


def new_user_cohort(
    ratings: DataFrame, ladder=(5, 10, 15, 20), enough: int = 10, fallback: float = 0.2
) -> DataFrame:
    """Users with few ratings: the first threshold that yields enough users, else a quantile.

    As in a plain loop over the ladder, the last threshold stays in force when none yields
    enough users but it yields some; the quantile is used when it yields none.
    """
    counts = ratings.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.agg(
        *[F.sum((F.col("n") <= t).cast("int")).alias(f"t{t}") for t in ladder],
        F.percentile("n", fallback).alias("quantile"),
    )
    last = ladder[-1]
    choice = F.coalesce(
        *[F.when(F.col(f"t{t}") >= enough, F.lit(float(t))) for t in ladder],
        F.when(F.col(f"t{last}") > 0, F.lit(float(last))),
        F.col("quantile"),
    )
    threshold = sizes.select(choice).scalar()
    return counts.withColumn("threshold", threshold).filter(F.col("n") <= F.col("threshold"))

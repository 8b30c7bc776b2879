"""Error, ranking, coverage and diversity metrics over prediction and recommendation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.recipes import jaccard
from ..functions.text import hash_bucket


def squared_error(actual: str = "rating", predicted: str = "rating_pred") -> Column:
    return F.pow(F.col(actual) - F.col(predicted), 2)


def rmse(predictions: DataFrame, actual: str = "rating", predicted: str = "rating_pred") -> DataFrame:
    return predictions.agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(squared_error(actual, predicted))).alias("rmse")
    )


def hits_per_user(recommended: DataFrame, relevant: DataFrame) -> DataFrame:
    """Per user: number of recommended, relevant, and both.

    Both tables are stacked and grouped by (user, item) first, so a user with very many rows
    is spread over all tasks, and only counts meet per user.
    """
    rec = recommended.select("user_id", "item_id", F.lit(1).alias("rec"), F.lit(0).alias("rel"))
    rel = relevant.select("user_id", "item_id", F.lit(0).alias("rec"), F.lit(1).alias("rel"))
    pairs = (
        rec.unionByName(rel)
        .groupBy("user_id", "item_id")
        .agg(F.max("rec").alias("rec"), F.max("rel").alias("rel"))
    )
    return pairs.groupBy("user_id").agg(
        F.sum("rec").alias("n_rec"),
        F.sum("rel").alias("n_rel"),
        F.sum(F.col("rec") * F.col("rel")).alias("n_hit"),
    )


def top_n_metrics(recommended: DataFrame, test: DataFrame, threshold: float = 4.0) -> DataFrame:
    """Mean precision and recall over users with relevant and recommended items; F1 of the means."""
    relevant = test.filter(F.col("rating") >= threshold)
    users = hits_per_user(recommended, relevant).filter((F.col("n_rec") > 0) & (F.col("n_rel") > 0))
    means = users.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.coalesce(F.avg(F.col("n_hit") / F.col("n_rec")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.avg(F.col("n_hit") / F.col("n_rel")), F.lit(0.0)).alias("recall"),
    )
    p, r = F.col("precision"), F.col("recall")
    return means.withColumn(
        "f1_score", F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(F.lit(0.0))
    )


def discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank.cast("double") + 1.0)


def ideal_gain(hits: Column) -> Column:
    """Gain of a list whose first ``hits`` places are all hits."""
    places = F.when(hits > 0, F.sequence(F.lit(1), hits.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(0.0), lambda s, r: s + discount(r))


def ranking_metrics(recommended: DataFrame, test_items: DataFrame, k: int, users: DataFrame | None = None) -> DataFrame:
    """Precision, recall and NDCG at k, averaged over the users that have test items.

    ``ndcg_retrieved`` compares with the best order of the hits found; ``ndcg_standard`` with
    the best list possible. ``recommended`` holds ``user_id, item_id, rank`` with rank <= k.
    ``users`` restricts the average to these users.
    """
    hits = recommended.join(
        test_items.select("user_id", "item_id", F.lit(1).alias("hit")), ["user_id", "item_id"], "left"
    )
    gained = hits.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_rec"),
        F.count("hit").alias("n_hit"),
        F.sum(F.when(F.col("hit") == 1, discount(F.col("rank"))).otherwise(F.lit(0.0))).alias("dcg"),
    )
    wanted = test_items.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rel"))
    if users is not None:
        wanted = wanted.join(users.select("user_id"), "user_id", "left_semi")
    per_user = wanted.join(gained, "user_id", "left").na.fill(0, ["n_rec", "n_hit"]).na.fill(0.0, ["dcg"])
    ideal_found = ideal_gain(F.col("n_hit"))
    ideal_best = ideal_gain(F.least(F.col("n_rel"), F.lit(k)))
    return per_user.agg(
        F.count(F.lit(1)).alias("n_users"),
        F.coalesce(F.avg(F.coalesce(F.try_divide("n_hit", "n_rec"), F.lit(0.0))), F.lit(0.0)).alias("precision"),
        F.coalesce(F.avg(F.col("n_hit") / F.col("n_rel")), F.lit(0.0)).alias("recall"),
        F.coalesce(
            F.avg(F.when(ideal_found > 0, F.try_divide(F.col("dcg"), ideal_found)).otherwise(F.lit(0.0))),
            F.lit(0.0),
        ).alias("ndcg_retrieved"),
        F.coalesce(F.avg(F.coalesce(F.try_divide(F.col("dcg"), ideal_best), F.lit(0.0))), F.lit(0.0)).alias(
            "ndcg_standard"
        ),
    )


def catalogue_metrics(recommended: DataFrame, train: DataFrame, n_users: Column, amount: int) -> DataFrame:
    """Coverage: distinct recommended over trained items. Diversity: over all places offered."""
    n_items = train.agg(F.countDistinct("item_id")).scalar()
    row = recommended.agg(F.countDistinct("item_id").alias("n_recommended")).withColumn("_items", n_items)
    row = row.withColumn("_places", n_users * F.lit(amount))
    share = lambda total: F.coalesce(F.try_divide(F.col("n_recommended"), F.col(total)), F.lit(0.0))
    return row.select("n_recommended", share("_items").alias("coverage"), share("_places").alias("diversity"))


def intra_list_diversity(lists: DataFrame, key: str, item_set: str = "ingredients") -> DataFrame:
    """1 - mean Jaccard over the pairs of a list; a list of one item is fully diverse.

    For result lists only: these hold at most k items, so they fit one array.
    """
    sets = lists.groupBy(key).agg(F.collect_list(item_set).alias("_sets"))
    n = F.size("_sets")
    starts = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(
        starts,
        F.lit(0.0),
        lambda s, i: s
        + F.aggregate(
            F.slice(F.col("_sets"), i + 1, n),
            F.lit(0.0),
            lambda t, other: t + jaccard(F.element_at(F.col("_sets"), i), other),
        ),
    )
    pairs = n * (n - 1) / 2
    mean = F.when(n >= 2, total / F.greatest(pairs, F.lit(1.0))).otherwise(F.lit(0.0))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - mean))
    return sets.select(key, n.cast("long").alias("n_items"), value.alias("diversity"))


def arm_column(rows: DataFrame, traffic_split: float = 0.5, seed: int = 42) -> DataFrame:
    """Adds ``arm``: 'a' for the given share of the rows, by hash, else 'b'."""
    bucket = hash_bucket(f"arm{seed}", 10_000, "user_id", "item_id")
    return rows.withColumn("arm", F.when(bucket < round(traffic_split * 10_000), "a").otherwise("b"))


def arm_metrics(predictions: DataFrame, threshold: float = 4.0) -> DataFrame:
    """RMSE, share of predictions at or above the threshold, and rows per arm."""
    return predictions.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(squared_error())).alias("rmse"),
        F.avg((F.col("rating_pred") >= threshold).cast("double")).alias("ctr"),
    )


def arm_lift(per_arm: DataFrame) -> DataFrame:
    """Relative gain of arm b over arm a, in percent; positive is better for both metrics."""
    value = lambda arm, name: F.max(F.when(F.col("arm") == arm, F.col(name)))
    row = per_arm.agg(
        value("a", "rmse").alias("ra"), value("b", "rmse").alias("rb"),
        value("a", "ctr").alias("ca"), value("b", "ctr").alias("cb"),
    )
    return row.select(
        (F.try_divide(F.col("ra") - F.col("rb"), F.col("ra")) * 100).alias("rmse_gain_pct"),
        (F.try_divide(F.col("cb") - F.col("ca"), F.col("ca")) * 100).alias("ctr_gain_pct"),
    )


def cohort_rmse(predictions: DataFrame, new_users: DataFrame) -> DataFrame:
    """RMSE of the new users, of all others, and the difference."""
    flagged = predictions.join(
        new_users.select("user_id", F.lit(True).alias("_new")), "user_id", "left"
    ).withColumn("_e", squared_error())
    is_new = F.coalesce(F.col("_new"), F.lit(False))
    out = flagged.agg(
        F.count(F.when(is_new, 1)).alias("n_new"),
        F.count(F.when(~is_new, 1)).alias("n_old"),
        F.sqrt(F.avg(F.when(is_new, F.col("_e")))).alias("rmse_new"),
        F.sqrt(F.avg(F.when(~is_new, F.col("_e")))).alias("rmse_old"),
    )
    return out.withColumn("rmse_gap", F.col("rmse_new") - F.col("rmse_old"))


def normalized_comparison(reports: DataFrame, metrics: list[str], lower_is_better=("rmse",)) -> DataFrame:
    """Min-max per metric over the compared models (one row each); errors are inverted."""
    limits = reports.agg(
        *[F.min(m).alias(f"_lo_{m}") for m in metrics], *[F.max(m).alias(f"_hi_{m}") for m in metrics]
    )
    out = reports
    for m in metrics:
        low = limits.select(f"_lo_{m}").scalar()
        high = limits.select(f"_hi_{m}").scalar()
        scaled = (F.col(m) - low) / (high - low + F.lit(1e-10))
        out = out.withColumn(f"{m}_norm", (1.0 - scaled) if m in lower_is_better else scaled)
    return out

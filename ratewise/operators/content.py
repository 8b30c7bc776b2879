"""Content profiles: what a user's ratings say about the features of items.

Item features come in long form ``item_id, feature, value``; zero values may be left out, but
then each item needs at least one row to count as described.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import training_ratings
from ..functions.kernels import unit
from ..functions.text import hash_order
from ..session import broadcast_if_small, cut_lineage
from .contentlists import best_by_similarity
from .model import Model, attach_params
from .ranking import rank_rows, stable, top_k
from .recommend import first_unknown_items
from .search import search_topk


def long_features(items: DataFrame, columns: list[str]) -> DataFrame:
    """Numeric feature columns to long form."""
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return items.select("item_id", F.inline(entries))


def user_profiles(ratings: DataFrame, features: DataFrame, min_rating: float = 0) -> DataFrame:
    """``user_id, feature, value``: features averaged with weight rating - min_rating.

    Only items with features count. Weights that do not sum to a positive number leave the
    plain weighted sums (zeros when all weights are zero).
    """
    weighted = training_ratings(ratings).select("user_id", "item_id", (F.col("rating") - min_rating).alias("_w"))
    described = weighted.join(features.select("item_id").distinct(), "item_id", "left_semi")
    totals = described.groupBy("user_id").agg(F.sum("_w").alias("_total"))
    sums = (
        weighted.join(features, "item_id")
        .groupBy("user_id", "feature")
        .agg(F.sum(F.col("_w") * F.col("value")).alias("_s"))
    )
    divisor = F.when(F.col("_total") > 0, F.col("_total")).otherwise(F.lit(1.0))
    return sums.join(totals, "user_id").select("user_id", "feature", (F.col("_s") / divisor).alias("value"))


def fit_content(
    ratings: DataFrame, features: DataFrame | None = None, min_rating: float = 0, max_rating: float = 5,
    mode: str = "profile_mean", n_neighbors: int = 50,
) -> Model:
    """User table with one score per user; with ``mode="similarity"`` lists of similar items instead.

    With features the score is the mean over the profile vector. Its sum needs only the row sums
    of the items, so the profile itself is not expanded. Without features it is the mean rating.
    """
    rows = training_ratings(ratings)
    mean, n_users, n_items = rows.agg(F.avg("rating"), F.countDistinct("user_id"), F.countDistinct("item_id")).first()
    items = rows.select("item_id").distinct()
    if mode not in ("profile_mean", "similarity"):
        raise ValueError("mode must be 'profile_mean' or 'similarity'")
    if mode == "similarity":
        if features is None:
            raise ValueError("similarity mode needs features")
        return _fit_similarity(rows, features, mean, n_users, min_rating, max_rating, n_neighbors)
    if features is None:
        users = rows.groupBy("user_id").agg(F.avg("rating").alias("score"))
    else:
        n_features = features.agg(F.countDistinct("feature")).first()[0]
        row_sums = features.groupBy("item_id").agg(F.sum("value").alias("_v"))
        weighted = rows.select("user_id", "item_id", (F.col("rating") - min_rating).alias("_w"))
        sums = weighted.join(row_sums, "item_id").groupBy("user_id").agg(
            F.sum("_w").alias("_total"), F.sum(F.col("_w") * F.col("_v")).alias("_s")
        )
        score = F.col("_s") / F.when(F.col("_total") > 0, F.col("_total")).otherwise(F.lit(1.0)) / n_features
        users = (
            rows.select("user_id").distinct().join(sums, "user_id", "left")
            .select("user_id", F.coalesce(score, F.lit(0.0)).alias("score"))
        )
    meta = {
        "global_mean": mean, "n_users": n_users, "n_items": n_items, "min_rating": min_rating,
        "max_rating": max_rating, "mode": "user_mean" if features is None else "profile_mean",
    }
    return Model("content", {"users": users, "items": items}, meta)


def _fit_similarity(rows, features, mean, n_users, min_rating, max_rating, n_neighbors) -> Model:
    """Tables ``items`` (item_id, mean), ``similar`` (item_id, neighbor, sim) and ``ratings``.

    All items with features or ratings are known; one without ratings has the global mean.
    """
    rows = cut_lineage(rows)
    known = features.select("item_id").unionByName(rows.select("item_id")).distinct()
    means = rows.groupBy("item_id").agg(F.avg("rating").alias("mean"))
    items = cut_lineage(known.join(means, "item_id", "left").select("item_id", F.coalesce("mean", F.lit(mean)).alias("mean")))
    lists = similar_items(features, n_neighbors)
    similar = cut_lineage(lists.select(F.col("query_id").alias("item_id"), F.col("item_id").alias("neighbor"), "sim"))
    meta = {
        "global_mean": mean, "n_users": n_users, "n_items": items.count(), "min_rating": min_rating,
        "max_rating": max_rating, "mode": "similarity", "n_neighbors": n_neighbors,
    }
    users = cut_lineage(rows.select("user_id").distinct())
    return Model("content", {"users": users, "items": items, "similar": similar, "ratings": rows}, meta)


def _deviations(model: Model, ratings: DataFrame) -> DataFrame:
    """``user_id, neighbor, dev``: ratings less their item's mean."""
    means = model.items().select(F.col("item_id").alias("neighbor"), F.col("mean").alias("_mean"))
    rows = ratings.select("user_id", F.col("item_id").alias("neighbor"), "rating")
    joined = rows.join(broadcast_if_small(means, model.meta["n_items"], 32), "neighbor")
    return joined.select("user_id", "neighbor", (F.col("rating") - F.col("_mean")).alias("dev"))


def _weighted(rows: DataFrame) -> DataFrame:
    """``user_id, item_id, _add``: weighted mean of the deviations per pair."""
    sums = rows.groupBy("user_id", "item_id").agg(F.sum(F.col("sim") * F.col("dev")).alias("_num"), F.sum(F.abs("sim")).alias("_den"))
    return sums.select("user_id", "item_id", F.when(F.col("_den") > 1e-9, F.col("_num") / F.col("_den")).otherwise(F.lit(0.0)).alias("_add"))


def _predict_similarity(model: Model, pairs: DataFrame, bound: bool) -> DataFrame:
    """The item's mean plus the weighted deviations of those of its similar items that the user rated."""
    asked = pairs.select("user_id", "item_id").distinct()
    met = asked.join(model.tables["similar"], "item_id").join(_deviations(model, model.tables["ratings"]), ["user_id", "neighbor"])
    adds = _weighted(met).withColumnsRenamed({"user_id": "_user", "item_id": "_item"})
    rows = attach_params(pairs, model, {}, {"mean": "_m"})
    same = (F.col("user_id") == F.col("_user")) & (F.col("item_id") == F.col("_item"))
    possible = F.col("user_known") & F.col("item_known")
    score = F.when(possible, F.col("_m") + F.coalesce("_add", F.lit(0.0))).otherwise(F.lit(float(model.meta["global_mean"])))
    return (
        rows.join(adds, same, "left").withColumn("prediction_possible", possible)
        .withColumn("rating_pred", model.bounded(score, bound)).select(*pairs.columns, "rating_pred", "prediction_possible")
    )


def _recommend_similarity(model: Model, users: DataFrame, known: DataFrame | None, amount: int, bound: bool) -> DataFrame:
    """Items with a rated item in their list are scored; the others keep their mean, so the first of these suffice."""
    wanted = users.select("user_id").filter(F.col("user_id").isNotNull()).distinct()
    trained = cut_lineage(wanted.join(model.users(), "user_id", "left_semi"))
    means = model.items().select("item_id", F.col("mean").alias("_m"))
    rated = _deviations(model, model.tables["ratings"].join(trained, "user_id", "left_semi"))
    both = best_by_similarity(trained, rated, model.items(), model.tables["similar"], known, amount)
    strangers = wanted.join(model.users(), "user_id", "left_anti")
    flat = means.select("item_id", F.lit(float(model.meta["global_mean"])).alias("score"))
    both = both.unionByName(first_unknown_items(strangers, flat, known, amount).select("user_id", "item_id", "score"))
    best = top_k(both, ["user_id"], [F.desc(stable("score")), F.asc("item_id")], amount)
    return best.select("user_id", "item_id", model.bounded(F.col("score"), bound).alias("rating_pred"), "rank")


def predict_content(model: Model, pairs: DataFrame, bound: bool = True) -> DataFrame:
    if model.meta["mode"] == "similarity":
        return _predict_similarity(model, pairs, bound)
    rows = attach_params(pairs, model, {"score": "_s"}, {})
    possible = F.col("user_known") & F.col("item_known")
    score = F.when(possible, F.col("_s")).otherwise(F.lit(float(model.meta["global_mean"])))
    return (
        rows.withColumn("prediction_possible", possible)
        .withColumn("rating_pred", model.bounded(score, bound))
        .select(*pairs.columns, "rating_pred", "prediction_possible")
    )


def recommend_content(
    model: Model, users: DataFrame, known: DataFrame | None = None, amount: int = 10, bound: bool = True
) -> DataFrame:
    """A user's score is the same for all items, so ties decide: the first unknown items by id.

    In similarity mode scores differ by item.
    """
    if model.meta["mode"] == "similarity":
        return _recommend_similarity(model, users, known, amount, bound)
    scores = model.items().withColumn("score", F.lit(0.0))
    rows = first_unknown_items(users, scores, known, amount).drop("score")
    own = broadcast_if_small(model.users(), model.meta["n_users"], 32)
    rows = rows.join(own, "user_id", "left")
    score = F.coalesce("score", F.lit(float(model.meta["global_mean"])))
    return rows.select("user_id", "item_id", model.bounded(score, bound).alias("rating_pred"), "rank")


def feature_vectors(features: DataFrame) -> DataFrame:
    """Sparse unit vectors ``item_id, idx, w``."""
    numbers = rank_rows(features.select("feature").distinct(), [], [F.asc("feature")], "no")
    packed = (
        features.filter(F.col("value") != 0)
        .join(numbers, "feature")
        .groupBy("item_id")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("no").cast("int").alias("no"), F.col("value").alias("w")))).alias("v"))
    )
    return packed.select(
        "item_id", F.transform("v", lambda x: x["no"]).alias("idx"), unit(F.transform("v", lambda x: x["w"])).alias("w")
    )


def similar_items(features: DataFrame, k: int) -> DataFrame:
    """The k items most similar by feature cosine, per item, itself left out.

    A feature shared by very many items would make a self join on the feature quadratic; the
    blocked search returns k rows per item instead, and searches equal vectors once. One more than k
    is asked for, so that k are left without the item itself.
    """
    vectors = feature_vectors(features)
    queries = vectors.select(F.col("item_id").alias("query_id"), "idx", "w")
    others = search_topk(queries, vectors, k + 1, "sparse").filter("query_id <> item_id")
    return top_k(others, ["query_id"], [F.asc("rank")], k)


def content_new_user_list(items: DataFrame, n: int = 10, preferences=None, seed: int = 42) -> DataFrame:
    """List for a user without history: without preferences random items, else the first n."""
    order = [F.asc("item_id")] if preferences is not None else [hash_order(seed, "item_id"), F.asc("item_id")]
    return items.select("item_id").orderBy(*order).limit(n)

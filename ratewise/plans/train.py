"""One entry for all models: fit, predict, recommend, update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import check_unique_pairs
from ..operators import bias, content, factors, neighborlists, neighbors
from ..operators.model import Model
from ..operators.ranking import stable, top_k
from ..operators.recommend import recommend_bias

#: Settings of the named models.
PRESETS = {
    "baseline": dict(method="sgd", n_epochs=30, lr=0.01, reg=0.02),
    "kernel_mf": dict(n_factors=50, n_epochs=30, kernel="linear", lr=0.01, reg=0.02),
    "item_cf": dict(axis="item", n_neighbors=50),
    "user_cf": dict(axis="user", n_neighbors=50),
    "linear_als": dict(n_factors=20, n_epochs=10, reg=0.1),
    "content": {},
    "global_mean": {},
}
_FIT = {
    "baseline": bias.fit_bias, "kernel_mf": factors.fit_factors,
    "item_cf": neighbors.fit_neighbors, "user_cf": neighbors.fit_neighbors,
    "linear_als": factors.fit_linear_als, "content": content.fit_content, "global_mean": bias.fit_global_mean,
}


def fit_model(name: str, ratings: DataFrame, check_unique: bool = True, **settings) -> Model:
    """Fit a named model with its preset; settings override the preset."""
    if name not in PRESETS:
        raise ValueError(f"model must be one of {sorted(PRESETS)}")
    if check_unique:
        check_unique_pairs(ratings)
    return _FIT[name](ratings, **{**PRESETS[name], **settings})


def predict(model: Model, pairs: DataFrame, bound: bool = True) -> DataFrame:
    """Adds ``rating_pred`` and ``prediction_possible`` to (user_id, item_id) rows."""
    if model.kind == "bias":
        return bias.predict_bias(model, pairs, bound)
    if model.kind == "kernel_mf":
        return factors.predict_factors(model, pairs, bound)
    if model.kind == "content":
        return content.predict_content(model, pairs, bound)
    return neighbors.predict_neighbors(model, pairs, bound)


def recommend(
    model: Model,
    users: DataFrame,
    known: DataFrame | None = None,
    amount: int = 10,
    bound: bool = True,
    include_user: bool = True,
    candidates: DataFrame | None = None,
) -> DataFrame:
    """Top-N for all given users at once: ``user_id, item_id, rating_pred, rank``.

    The best of all trained items, or of a table of ``candidates`` (user_id, item_id).
    """
    if candidates is not None:
        asked = candidates.join(users.select("user_id").distinct(), "user_id", "left_semi")
        if known is not None:
            asked = asked.join(known.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
        scored = predict(model, asked.select("user_id", "item_id"), bound=False)
        best = top_k(scored, ["user_id"], [F.desc(stable("rating_pred")), F.asc("item_id")], amount)
        out = best.select("user_id", "item_id", model.bounded(F.col("rating_pred"), bound).alias("rating_pred"), "rank")
    elif model.kind in ("item_cf", "user_cf"):
        out = neighborlists.recommend_neighbors(model, users, known, amount, bound)
    elif model.kind == "bias":
        out = recommend_bias(model, users, known, amount, bound)
    elif model.kind == "content":
        out = content.recommend_content(model, users, known, amount, bound)
    else:
        out = factors.recommend_factors(model, users, known, amount, bound)
    return out if include_user else out.drop("user_id")


def update_users(model: Model, ratings: DataFrame, lr: float = 0.01, n_epochs: int = 20, **options) -> Model:
    """Fold in new or changed users; pass all ratings of each of them."""
    check_unique_pairs(ratings)
    if model.kind == "bias":
        return bias.update_bias_users(model, ratings, lr, n_epochs, **options)
    if model.kind == "kernel_mf":
        return factors.update_factor_users(model, ratings, lr, n_epochs, **options)
    raise ValueError(f"{model.kind} models are refitted, not updated")


def fold_users(model: Model, ratings: DataFrame, lr: float = 0.01, n_epochs: int = 20, **options) -> DataFrame:
    """The new parameters of the users in ``ratings`` alone; ``options`` go to ``fold_factor_users``."""
    check_unique_pairs(ratings)
    if model.kind == "bias":
        return bias.fold_bias_users(model, ratings, lr, n_epochs, **options)
    if model.kind == "kernel_mf":
        return factors.fold_factor_users(model, ratings, lr, n_epochs, **options)
    raise ValueError(f"{model.kind} models are refitted, not updated")


def model_score(model: Model | None, candidates: DataFrame, out: str = "model_score") -> DataFrame:
    """Adds the unbounded prediction for the row's ``user_id``; 0 without model or user."""
    if model is None or "user_id" not in candidates.columns:
        return candidates.withColumn(out, F.lit(0.0))
    reserved = {"rating_pred", "prediction_possible", out}
    if model.kind in ("bias", "kernel_mf") and not any(c in reserved or c.startswith("_") for c in candidates.columns):
        # a pair's prediction reads its two parameter rows only, so the candidates get it as they are
        scored = predict(model, candidates, bound=False)
        asked = F.col("user_id").isNotNull() & F.col("item_id").isNotNull()
        rest = [c for c in candidates.columns if c not in ("user_id", "item_id")]
        return scored.select("user_id", "item_id", *rest, F.when(asked, F.col("rating_pred")).otherwise(F.lit(0.0)).alias(out))
    asked = candidates.filter(F.col("user_id").isNotNull()).select("user_id", "item_id").distinct()
    scored = predict(model, asked, bound=False).select("user_id", "item_id", F.col("rating_pred").alias(out))
    joined = candidates.join(scored, ["user_id", "item_id"], "left")
    return joined.withColumn(out, F.coalesce(out, F.lit(0.0)))

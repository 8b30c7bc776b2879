"""Top-N lists for whole tables of users."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .model import Model
from .ranking import rank_rows, stable, top_k

#: Places per chunk when a user's candidate places are spelt out.
CHUNK = 50_000


def first_unknown_items(
    users: DataFrame, item_scores: DataFrame, known: DataFrame | None, amount: int
) -> DataFrame:
    """Top-N for models whose item order is the same for every user.

    ``item_scores`` holds ``item_id, score``. The items are ranked once. Among the first
    ``amount + (number of known items)`` places of that ranking there are at least ``amount``
    unknown ones, so only these places are spelt out per user: the work is linear in users plus
    known pairs, never users x items.
    """
    ranked = rank_rows(item_scores, [], [F.desc(stable("score")), F.asc("item_id")], "place")
    n_items = item_scores.count()
    wanted = users.select("user_id").distinct()
    if known is None:
        wanted = wanted.withColumn("places", F.lit(min(amount, n_items)).cast("long"))
    else:
        counts = known.groupBy("user_id").agg(F.count(F.lit(1)).alias("_k"))
        wanted = wanted.join(counts, "user_id", "left").select(
            "user_id", F.least(F.lit(n_items), F.lit(amount) + F.coalesce("_k", F.lit(0))).alias("places")
        )
    deepest = wanted.agg(F.coalesce(F.max("places"), F.lit(0))).first()[0]
    chunks = wanted.filter(F.col("places") > 0).withColumn(
        "_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("places") - 1) / CHUNK)))
    )
    if deepest > CHUNK:  # a user with a very long history must not be spelt out by one task
        chunks = chunks.repartition("user_id", "_c")
    spelt = chunks.select(
        "user_id",
        F.explode(
            F.sequence(F.col("_c") * CHUNK + 1, F.least(F.col("places"), (F.col("_c") + 1) * CHUNK))
        ).alias("place"),
    )
    reach = ranked.filter(F.col("place") <= deepest).select("place", "item_id", "score")
    rows = spelt.join(broadcast_if_small(reach, deepest, 64), "place")
    if known is not None:
        rows = rows.join(known.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    return top_k(rows, ["user_id"], [F.asc("place")], amount).drop("place")


def recommend_bias(
    model: Model,
    users: DataFrame,
    known: DataFrame | None = None,
    amount: int = 10,
    bound: bool = True,
    include_user: bool = True,
) -> DataFrame:
    """Top-N by unbounded score; the ratings shown are bounded only afterwards."""
    scores = model.items().select("item_id", F.col("bias").alias("score"))
    rows = first_unknown_items(users, scores, known, amount)
    own = model.users().select("user_id", F.col("bias").alias("_bu"))
    rows = rows.join(broadcast_if_small(own, model.meta["n_users"], 32), "user_id", "left")
    score = F.lit(float(model.meta["global_mean"])) + F.coalesce("_bu", F.lit(0.0)) + F.col("score")
    out = rows.select("user_id", "item_id", model.bounded(score, bound).alias("rating_pred"), "rank")
    return out if include_user else out.drop("user_id")

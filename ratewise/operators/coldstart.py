"""Lists for users without history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stats import popular_items


def hybrid_list(
    recommended: DataFrame, ratings: DataFrame, n: int = 10, alpha: float = 0.5, users: DataFrame | None = None
) -> DataFrame:
    """Per user ``int(n*alpha)`` model items, then popular items up to n.

    ``recommended`` holds ``user_id, item_id, rank``; ``users`` (``user_id``) adds those without
    model items, who get popular items only. No item comes twice. A list can lose at most n places
    to repeats, so the 2n most popular items fill it; only those 2n rows are broadcast.
    """
    n_model = int(n * alpha)
    popular = popular_items(ratings, 2 * n)
    model_rows = recommended.filter(F.col("rank") <= n_model).select(
        "user_id", "item_id", F.lit(0).alias("source"), F.col("rank").cast("int").alias("place")
    )
    everyone = recommended.select("user_id")
    everyone = (everyone if users is None else everyone.unionByName(users.select("user_id"))).distinct()
    listed = popular.select((F.col("rank") - 1).cast("int").alias("place"), F.col("item_id"))
    places = everyone.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(2 * n - 1))).alias("place"))
    filled = places.join(F.broadcast(listed), "place")
    rows = model_rows.unionByName(filled.select("user_id", "item_id", F.lit(1).alias("source"), "place"))
    first = rows.groupBy("user_id", "item_id").agg(F.min(F.struct("source", "place")).alias("p"))
    order = Window.partitionBy("user_id").orderBy("p.source", "p.place", "item_id")
    ranked = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    source = F.when(F.col("p.source") == 0, "model").otherwise("popular")
    return ranked.select("user_id", "item_id", source.alias("source"), "rank")

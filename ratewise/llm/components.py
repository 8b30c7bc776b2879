"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` from edges ``a, b``: the smallest node of each component.

    Every round each node takes the smallest label among itself and its neighbours, then the label
    of its label, so paths shorten by at least half. Minima are formed before the shuffle; only the
    number of changed labels comes to the driver. Nulls are not nodes; an empty table gives none.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <=> b = false AND a IS NOT NULL AND b IS NOT NULL").distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        named = labels.select(F.col("node").alias("b"), "label")
        near = both.join(named, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        best = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut_lineage(best.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label")))
        labels = new.select("node", "label")
        if not new.filter("old <> label").take(1):
            return labels

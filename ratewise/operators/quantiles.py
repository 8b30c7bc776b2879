"""Exact percentiles of many columns at once, by rank selection in a distributed histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage


def exact_percentiles(df: DataFrame, measures: dict[str, Column], percentiles: list[float]) -> DataFrame:
    """``measure, quantiles`` (doubles, in the order of ``percentiles``), interpolated between ranks.

    Equal values are counted where they are read, so a shuffle carries different (measure, value) pairs.
    These are dealt out by range; with the counts of earlier ranges each range knows the ranks of its own
    values, and only the values at the wanted ranks leave it: no task holds a measure's values. Nulls are
    left out; NaN counts as the largest value; a measure without values has no row.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), c.cast("double").alias("value")) for m, c in measures.items()])
    counted = df.select(F.inline(pairs)).filter(F.col("value").isNotNull()).groupBy("measure", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    # both uses of the ranges must see the same ones
    ranged = cut_lineage(counted.repartitionByRange(parts, "measure", "value").withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy("measure", "_part").agg(F.sum("n").alias("_sum"))
    of = Window.partitionBy("measure")
    earlier = of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "measure", "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"), F.sum("_sum").over(of).alias("_total")
    )
    inside = Window.partitionBy("measure", "_part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("_end", F.sum("n").over(inside)).join(
        broadcast_if_small(offsets, parts + len(measures), 64), ["measure", "_part"]
    ).withColumn("_end", F.col("_end") + F.col("_offset"))
    at = lambda rank: F.max(F.when((rank < F.col("_end")) & (rank >= F.col("_end") - F.col("n")), F.col("value")))
    place = lambda p: F.lit(float(p)) * (F.col("_total") - 1)
    picked = placed.groupBy("measure").agg(
        F.max("_total").alias("_total"),
        *[at(F.floor(place(p))).alias(f"l{i}") for i, p in enumerate(percentiles)],
        *[at(F.ceil(place(p))).alias(f"u{i}") for i, p in enumerate(percentiles)],
    )
    between = lambda i, p: F.when(F.col(f"l{i}") == F.col(f"u{i}"), F.col(f"l{i}")).otherwise(
        (F.ceil(place(p)) - place(p)) * F.col(f"l{i}") + (place(p) - F.floor(place(p))) * F.col(f"u{i}")
    )
    return picked.select("measure", F.array(*[between(i, p) for i, p in enumerate(percentiles)]).alias("quantiles"))

"""Distributed prefix sums."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def running(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows before this one within ``keys``.

    A range shuffle on (keys, order) lets any number of partitions share a key, so a key that
    holds a third of all rows is summed by many tasks. Partitions are summed on their own; a key
    that goes on from earlier partitions gets their totals added (one row per partition and key).
    The ranged rows are written before they are used twice. Null is a key like any other. Rows
    that tie in ``order`` get their sums in any order; a run of ties stays in one partition, so
    callers order by something that spreads. ``df`` is read twice (to find the ranges, then to
    deal rows), so it should be a written table of the few columns needed.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(k).asc_nulls_last() for k in keys]
    ranged = cut_lineage(
        df.withColumn("_value", value).repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id())
    )
    sums = ranged.groupBy("_part", *keys).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("_part").alias("_at"), *[F.col(k).alias(f"_of_{k}") for k in keys],
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"),
    ).filter("_offset <> 0")
    within = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.col("_part") == F.col("_at"))
    local = ranged.withColumn("_local", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return local.join(offsets, same, "left").select(
        *df.columns, (F.col("_local") + F.coalesce("_offset", F.lit(0))).alias(name)
    )

"""Ranking, top-k, scaling and blending.

Scores are ranked after rounding to nine decimals. Sums of doubles depend on the order in which
partitions arrive, so without rounding two equal scores could swap places between two runs.
Equal scores are ordered by ascending id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col
from ..session import broadcast_if_small, cut_lineage


def stable(score: Column | str) -> Column:
    return F.round(col(score), 9)


def rank_rows(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Exact row numbers per key (or over the whole table) that survive any hot key.

    A range shuffle on (key, order) may split a key over several partitions, which a plain
    window cannot. Each partition numbers its own rows; a key that continues from earlier
    partitions gets their row counts added. At most one key per partition continues, so the
    offset table has no more rows than there are partitions. The order must be total; the
    ranged table is materialised so that both uses see the same partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(
        df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn(
            "_part", F.spark_partition_id()
        )
    )
    counts = ranged.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        counts.withColumn("_offset", F.sum("_n").over(earlier))
        .filter(F.col("_offset") > 0)
        .select("_part", *keys, "_offset")
    )
    local = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    return (
        ranged.withColumn("_local", local)
        .join(broadcast_if_small(offsets, parts), ["_part", *keys], "left")
        .withColumn(name, (F.col("_local") + F.coalesce("_offset", F.lit(0))).cast("long"))
        .drop("_part", "_local", "_offset")
    )


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per key with their rank.

    Spark keeps only k rows per key and map task before the shuffle (WindowGroupLimit), so a
    hot key sends k rows per task, not all of its rows.
    """
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(name, number).filter(F.col(name) <= k)


def minmax(value: Column | str, keys: list[str]) -> Column:
    """Scale to 0..1 within a candidate list; a list with (almost) equal values becomes 0."""
    over = Window.partitionBy(*keys)
    low, high = F.min(col(value)).over(over), F.max(col(value)).over(over)
    return F.when(high - low < 1e-8, F.lit(0.0)).otherwise((col(value) - low) / (high - low))


def blend(
    candidates: DataFrame,
    keys: list[str],
    first: str,
    second: str,
    weight: float,
    out: str = "score",
) -> DataFrame:
    """``weight * minmax(first) + (1 - weight) * minmax(second)`` per candidate list."""
    mixed = F.lit(float(weight)) * minmax(first, keys) + F.lit(1.0 - float(weight)) * minmax(second, keys)
    return candidates.withColumn(out, mixed)


def head_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n rows by key."""
    return df.orderBy(key).limit(n)

"""Sharding by extendible hashing.

A directory is indexed by the first bits of a key's hash. A bucket that holds more bytes than a
shard may have is split on its next bit; the others stay as they are, so every shard is as shallow
as its size allows. Splits are found from byte sums per prefix, several bits at a time: only rows
of buckets that are still too large are summed again, and sums are formed before the shuffle, so a
hot key costs one row per task.

Rows whose key is the same cannot be told apart by any bit. When all bits are used up, such a
bucket is cut into runs of at most the limit by distributed prefix sums (column ``run``). A single
row larger than the limit is a shard of its own (``oversize``).

Null keys hash as a key of their own; null texts have 0 bytes; repeated rows are kept; an empty
table gives no shards. A kept column with the name of an output column gets ``_source`` behind it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .names import columns, renamed
from .prefix import running

HASH_BITS = 60


def key_hash(key: Column) -> Column:
    """60 evenly spread bits; null is a key of its own."""
    text = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")


def _shift(value: str, by: Column) -> Column:
    return F.call_function("shiftright", F.col(value), by.cast("int"))


#: Column names of intermediate tables.
OWN = ["_sh_hash", "_sh_cell", "_sh_top", "_sh_order", "_sh_before", "_sh_alone", "_value", "_part", "_local", "_sum", "_at", "_offset", "_of__sh_hash", "b", "n"]


def _prefix(bits: Column | int) -> Column:
    return _shift("_sh_hash", F.lit(HASH_BITS) - (F.lit(bits) if isinstance(bits, int) else bits))


def _leaves(cells: DataFrame, low: int, high: int, max_bytes: int) -> DataFrame:
    """For each cell of ``high`` bits the smallest depth above ``low`` whose bucket fits, or null."""
    depths = F.explode(F.sequence(F.lit(low + 1 if low else 0), F.lit(high))).alias("depth")
    each = cells.select("_sh_cell", "b", "n", depths).withColumn("_sh_top", _shift("_sh_cell", F.lit(high) - F.col("depth")))
    fits = each.groupBy("depth", "_sh_top").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).filter(f"b <= {max_bytes} OR n = 1")
    first = each.select("_sh_cell", "depth", "_sh_top").join(fits, ["depth", "_sh_top"]).groupBy("_sh_cell").agg(F.min("depth").alias("depth"))
    return cells.select("_sh_cell").join(first, "_sh_cell", "left")


def _runs(rows: DataFrame, keep: list[str], max_bytes: int) -> DataFrame:
    """Buckets of one hash: cut where the running bytes pass a multiple of what surely fits.

    Runs start at multiples of the limit less the largest row, so no run exceeds the limit unless
    a row alone does; such rows get runs of their own, numbered below zero.
    """
    small = F.when(F.col("bytes") <= max_bytes, F.col("bytes")).otherwise(0)
    tops = rows.groupBy("_sh_hash").agg(F.max(small).alias("_sh_top"))
    spread = F.xxhash64(*[F.col(c) for c in rows.columns], F.monotonically_increasing_id())
    placed = running(cut_lineage(rows.withColumn("_sh_order", spread)), ["_sh_hash"], [F.col("_sh_order")], small, "_sh_before")
    alone = running(placed, ["_sh_hash"], [F.col("_sh_order")], (F.col("bytes") > max_bytes).cast("long"), "_sh_alone")
    width = F.greatest(F.lit(max_bytes) - F.col("_sh_top"), F.lit(1))
    run = F.when(F.col("bytes") > max_bytes, -1 - F.col("_sh_alone")).otherwise(F.floor(F.col("_sh_before") / width))
    return alone.join(tops, "_sh_hash").select(
        *keep, "bytes", F.lit(HASH_BITS).alias("depth"), F.col("_sh_hash").alias("prefix"), run.cast("long").alias("run")
    )


def assign(
    rows: DataFrame, key: str, size: Column, max_bytes: int, keep: list[str] | None = None, bits_per_round: int = 8
) -> DataFrame:
    """``keep`` columns (the key if not given) with ``bytes, depth, prefix, run, oversize``.

    ``depth`` bits of the hash select the bucket, ``prefix`` is their value; (depth, prefix, run)
    names a shard. ``size`` is the bytes of a row. A kept column with one of these names, or with one that
    the work itself uses (``OWN``), gets ``_source`` behind it.
    """
    asked = [key] if keep is None else keep
    keep = renamed(asked, ["bytes", "depth", "prefix", "run", "oversize", *OWN])
    todo = cut_lineage(rows.select(
        *(c.alias(n) for c, n in zip(columns(rows, asked), keep)), key_hash(F.col(key)).alias("_sh_hash"), F.coalesce(size, F.lit(0)).cast("long").alias("bytes")
    ))
    done = []
    for low in range(0, HASH_BITS, bits_per_round):
        high = min(low + bits_per_round, HASH_BITS)
        cells = cut_lineage(todo.groupBy(_prefix(high).alias("_sh_cell")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")))
        leaves = cut_lineage(_leaves(cells, low, high, max_bytes))
        found = todo.withColumn("_sh_cell", _prefix(high)).join(broadcast_if_small(leaves, leaves.count()), "_sh_cell")
        done.append(found.filter("depth is not null").select(
            *keep, "bytes", "depth", _prefix(F.col("depth")).alias("prefix"), F.lit(0).cast("long").alias("run")
        ))
        if not leaves.filter("depth is null").take(1):
            break
        todo = cut_lineage(found.filter("depth is null").select(*todo.columns))
    else:
        done.append(_runs(todo, keep, max_bytes))
    return reduce(DataFrame.unionByName, done).withColumn("oversize", F.col("bytes") > max_bytes)


def directory(shards: DataFrame) -> DataFrame:
    """One row per shard: ``depth, prefix, run, n_rows, bytes, oversize``."""
    return shards.groupBy("depth", "prefix", "run").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("bytes").alias("bytes"), F.max("oversize").alias("oversize")
    )

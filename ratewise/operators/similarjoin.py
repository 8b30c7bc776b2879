"""Top-k similarity join of entities by their common raters, pruned by norm bounds.

Entities are dealt to blocks whose squared norms lie within a factor of sqrt(2) of each other. A
first round compares each block with itself; the k-th best similarity found there is a lower bound
t(x) of what an entity's list can need. The sum of products of two entities is at most the norm of
one times the largest rating of the other times the root of the number of ratings of the shorter
one, so

    sim(x, y) <= |x| sqrt(n_x) max(y) / (s_x s_y)    and    sim(x, y) <= |y| sqrt(n_y) max(x) / (s_x s_y)

where s is the centred norm. In the second round an entity is sent only to blocks of levels whose
bound reaches t(x): a short history never meets very long ones, nor the other way round, once it has
k better partners. A task compares two blocks as one small matrix and returns at most k rows per
entity, none below t(x), so rows out are linear in k and no table of all pairs exists.

Entities with more than ``HOT_ROWS`` ratings stay out of the blocks: there can be few of them, and
their sums with all others come from a plain join and aggregation, which any number of tasks share.

An entity is sent once per block that it is compared with. Where there are more than ``MOST_BLOCKS`` and
every history is an array of bearable length, blocks get whole histories instead (``histories``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .ranking import stable, top_k

#: Ratings and entities of one block, cells of one matrix, products expanded at a time.
BLOCK_ROWS = 200_000
BLOCK_ENTITIES = 2_000
CELLS = 4_000_000
EXPAND = 4_000_000
HOT_ROWS = 1_000_000
MOST_BLOCKS = 20

FOUND = ["id", "neighbor", "sim"]


def runs(sizes: np.ndarray, limit: int, most: int) -> list[tuple[int, int]]:
    """Consecutive runs whose sizes add up to ``limit`` and that have ``most`` members, at most; a larger one goes alone."""
    out, at, total = [], 0, np.concatenate([[0], np.cumsum(sizes)])
    while at < len(sizes):
        end = int(np.searchsorted(total, total[at] + limit, "right")) - 1
        end = min(max(at + 1, end), at + most, len(sizes))
        out.append((at, end))
        at = end
    return out


def expanded(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges ``starts[i] .. starts[i] + counts[i]``, and the i of each."""
    row = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts), row


def plain(ids) -> pd.Series:
    """Ids as a column that Arrow takes as one piece, whatever their type; an empty one of numbers it would not take for strings."""
    values = np.asarray(ids)
    return pd.Series(values, dtype=values.dtype if len(values) and values.dtype.kind in "biuf" else object)


def best_of_blocks(left: pd.DataFrame, right: pd.DataFrame, n_context: int, k: int) -> pd.DataFrame:
    """At most k rows per entity of ``left``: its most similar ones in ``right`` that share a rater.

    Both come with ``c, e, r`` and, repeated in every row of an entity, ``m`` (mean), ``q`` (centred
    squared norm) and ``t`` (no list entry is below it).
    """
    a, a_ids = pd.factorize(left["e"], sort=True)
    b, b_ids = pd.factorize(right["e"], sort=True)
    order = np.argsort(a, kind="stable")
    a, left = a[order], left.iloc[order]
    context = pd.factorize(pd.concat([left["c"], right["c"]], ignore_index=True))[0]
    a_context, b_context = context[: len(left)], context[len(left) :]
    order = np.argsort(b_context, kind="stable")
    b, right = b[order], right.iloc[order]
    counts = np.bincount(b_context, minlength=context.max() + 1)
    starts = np.cumsum(counts) - counts
    value, other_value = left["r"].to_numpy(), right["r"].to_numpy()
    first, b_first = (np.unique(codes, return_index=True)[1] for codes in (a, b))
    am, aq, at = (left[c].to_numpy()[first] for c in "mqt")
    bm, bq = (right[c].to_numpy()[b_first] for c in "mq")
    ends = np.concatenate([first, [len(a)]])
    fan = counts[a_context]
    sizes = np.add.reduceat(fan, first)
    same = pd.Index(b_ids).get_indexer(a_ids)
    out = []
    for low, high in runs(sizes, EXPAND, max(1, CELLS // len(b_ids))):
        shape = (high - low, len(b_ids))
        dot, met = np.zeros(shape[0] * shape[1]), np.zeros(shape[0] * shape[1], np.int64)
        rows = np.arange(ends[low], ends[high])
        for begin, end in runs(fan[rows], EXPAND, len(rows)):
            some = rows[begin:end]
            place, of = expanded(starts[a_context[some]], fan[some])
            cell = (a[some][of] - low) * shape[1] + b[place]
            dot += np.bincount(cell, value[some][of] * other_value[place], len(dot))
            met += np.bincount(cell, minlength=len(dot))
        scale = np.sqrt(np.outer(aq[low:high], bq))
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = np.where(scale > 0, (dot.reshape(shape) - n_context * np.outer(am[low:high], bm)) / scale, 0.0)
        sim[met.reshape(shape) == 0] = -np.inf
        own = np.flatnonzero(same[low:high] >= 0)
        sim[own, same[low:high][own]] = -np.inf
        rounded = np.round(sim, 9)
        sim[rounded < np.round(at[low:high], 9)[:, None]] = -np.inf
        best = np.argsort(-np.where(np.isfinite(sim), rounded, -np.inf), axis=1, kind="stable")[:, :k]
        chosen = np.take_along_axis(sim, best, axis=1)
        row, place = np.nonzero(np.isfinite(chosen))
        out.append(pd.DataFrame({"id": plain(np.asarray(a_ids)[low + row]), "neighbor": plain(np.asarray(b_ids)[best[row, place]]), "sim": chosen[row, place]}))
    return pd.concat(out, ignore_index=True)


def entity_table(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """``e, m, q, n, top, norm, level``: statistics, number of ratings, largest rating, norm and its level."""
    sums = rows.groupBy("e").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("r")).alias("top"), F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"))
    own = stats.select(F.col("id").alias("e"), F.col("mean").alias("m"), F.col("norm2").alias("q"))
    return sums.join(own, "e").withColumn("level", F.floor(4 * F.log2("norm")).cast("int"))


def _or_infinite(value: Column, divisor: Column) -> Column:
    """Bounds are raised a little, so that rounding never hides a pair."""
    return F.coalesce(F.try_divide(value * (1 + 1e-9), divisor), F.lit(float("inf")))


def nearest_pruned(ratings: DataFrame, stats: DataFrame, entity: str, context: str, n_context: int, k: int) -> DataFrame:
    """``id, neighbor, sim, rank``: the k most similar entities with common raters, per entity."""
    rows = ratings.filter(F.col("rating") != 0).select(
        F.col(context).alias("c"), F.col(entity).alias("e"), F.col("rating").cast("double").alias("r")
    )
    kind = rows.schema["e"].dataType.simpleString()
    schema = f"id {kind}, neighbor {kind}, sim double"
    entities = cut_lineage(entity_table(rows, stats))
    spread = F.sqrt("q")
    # one row per level: as many as there are powers of a quarter between the least and the largest norm
    levels = entities.groupBy("level").agg(
        F.sum(F.when(F.col("n") <= HOT_ROWS, F.col("n"))).alias("rows"), F.count_if(F.col("n") <= HOT_ROWS).alias("members"),
        F.min(spread).alias("least"), F.max("top").alias("top"), F.max(_or_infinite(F.col("norm") * F.sqrt("n"), spread)).alias("reach"),
        F.count_if(F.col("n") > HOT_ROWS).alias("hot"), F.min("m").alias("lowest"),
    ).orderBy("level").collect()
    signed = any(r["lowest"] < 0 for r in levels)  # the bounds need means that are not negative
    blocks, at = {}, 0
    for r in levels:
        if r["members"]:
            subs = max(-(-r["rows"] // BLOCK_ROWS), -(-r["members"] // BLOCK_ENTITIES))
            blocks[r["level"]] = (at, subs, r)
            at += subs
    parts: list[DataFrame] = []
    if at > MOST_BLOCKS:
        from . import histories

        n, longest = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
        if longest <= histories.LONGEST:
            found = histories.nearest_of_blocks(rows, entities, n, n_context, k)
            return top_k(found, ["id"], [F.desc(stable("sim")), F.asc("neighbor")], k)
    if blocks:
        pick = lambda n: F.element_at(F.create_map(*[F.lit(v) for level, b in blocks.items() for v in (level, b[n])]), F.col("level"))
        dealt = entities.filter(F.col("n") <= HOT_ROWS).withColumn(
            "block", pick(0) + F.pmod(F.xxhash64(F.lit("block"), "e"), pick(1)).cast("int")
        )
        dealt = cut_lineage(dealt)
        wide = broadcast_if_small(dealt.select("e", "m", "q", "block"), dealt.count(), 48)
        placed = rows.join(wide, "e").withColumn("t", F.lit(float("-inf")))
        own = placed.groupBy("block").applyInPandas(lambda pdf: best_of_blocks(pdf, pdf, n_context, k), schema)
        own = cut_lineage(own)
        parts.append(own)
        if at > 1:
            least = own.groupBy(F.col("id").alias("e")).agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).alias("t"))
            known = dealt.join(least, "e", "left").withColumn("t", F.coalesce("t", F.lit(float("-inf"))))
            others = F.array(*[
                F.struct(F.lit(b[0]).alias("first"), F.lit(b[1]).alias("subs"), *(F.lit(b[2][c]).cast("double").alias(c) for c in ("least", "top", "reach")))
                for b in blocks.values()
            ])
            open_ = known.withColumn("o", F.explode(others)).withColumn("s", spread)
            by_left = _or_infinite(F.col("norm") * F.sqrt("n") * F.col("o.top"), F.col("s") * F.col("o.least"))
            by_right = _or_infinite(F.col("top") * F.col("o.reach"), F.col("s"))
            open_ = open_.filter(F.lit(signed) | (F.least(by_left, by_right) >= F.col("t") - 1e-9))
            sent = open_.select(
                "e", "m", "q", "t", F.col("block").alias("_a"),
                F.explode(F.sequence(F.col("o.first"), F.col("o.first") + F.col("o.subs") - 1)).alias("_b"),
            ).filter("_a <> _b")
            sent = cut_lineage(sent)
            asked = rows.join(sent, "e")
            tiles = sent.select("_a", F.col("_b").alias("block")).distinct()
            given = placed.join(tiles, "block").select("_a", "block", "c", "e", "r", "m", "q", "t")
            given = given.toDF(*[f"_g_{c}" for c in given.columns])  # both sides stem from the same table

            def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
                if not len(left) or not len(right):
                    return pd.DataFrame({n: plain([]) for n in FOUND})
                return best_of_blocks(left, right.rename(columns=lambda c: c.removeprefix("_g_")), n_context, k)

            parts.append(asked.groupBy("_a", "_b").cogroup(given.groupBy("_g__a", "_g_block")).applyInPandas(run, schema))
    if any(r["hot"] for r in levels):
        parts.append(_with_hot(rows, entities, n_context))
    if not parts:
        return ratings.sparkSession.createDataFrame([], f"{schema}, rank int")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return top_k(found, ["id"], [F.desc(stable("sim")), F.asc("neighbor")], k)


def _with_hot(rows: DataFrame, entities: DataFrame, n_context: int) -> DataFrame:
    """All pairs that a hot entity is part of, in both directions."""
    hot = entities.filter(F.col("n") > HOT_ROWS)
    some = rows.join(broadcast_if_small(hot.select("e"), hot.count()), "e", "left_semi").select("c", F.col("e").alias("h"), F.col("r").alias("hr"))
    dots = rows.join(some, "c").filter("e <> h").groupBy("e", "h").agg(F.sum(F.col("r") * F.col("hr")).alias("dot"))
    side = lambda e, s: entities.select(F.col("e").alias(e), F.col("m").alias(f"m{s}"), F.col("q").alias(f"q{s}"), F.col("n").alias(f"n{s}"))
    both = dots.join(side("e", "a"), "e").join(side("h", "b"), "h")
    scale = F.sqrt(F.col("qa") * F.col("qb"))
    sim = F.when(scale > 0, (F.col("dot") - F.lit(float(n_context)) * F.col("ma") * F.col("mb")) / F.nullif(scale, F.lit(0.0))).otherwise(F.lit(0.0))
    one = F.struct(F.col("e").alias("id"), F.col("h").alias("neighbor"), sim.alias("sim"))
    other = F.struct(F.col("h").alias("id"), F.col("e").alias("neighbor"), sim.alias("sim"))
    # a pair of two hot entities comes from either side
    return both.select(F.inline(F.when(F.col("na") > HOT_ROWS, F.array(one)).otherwise(F.array(one, other))))

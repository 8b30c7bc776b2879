"""Sums of rating products of entities from whole histories, one block of entities per task.

A context's history (the entities it rated) is sent, as arrays, once to every block that one of its entities
belongs to. A block then holds all contexts of its entities, so a task has the complete sums of its
entities with all partners: nothing is added up afterwards, and only what is asked for leaves the
task. A rating is sent at most once per entity of its context, in a few bytes, however many blocks there are.

Histories are arrays, so contexts with more than ``LONGEST`` ratings are left to the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import hash_bucket
from ..session import broadcast_if_small, cut_lineage, fits_broadcast
from .ranking import rank_rows
from .similarjoin import expanded, plain, runs

#: Ratings of the entities of one block, longest history, products expanded at a time.
BLOCK_RATINGS = 200_000
LONGEST = 20_000
EXPAND = 4_000_000
#: Ratings of the asked contexts of one block and lane; products made and cells scored at a time for asked pairs.
LIST_RATINGS = 2_000_000
ASKED_AT_ONCE = 500_000
SCORED_AT_ONCE = 250_000


def histories(rows: DataFrame, blocks: int, upward: bool = False) -> DataFrame:
    """``block, own, es, rs`` per context and block from ``c, e, r``: the history, and where the block's entities are in it.

    ``upward`` leaves out what comes before the first of them.
    """
    entry = F.struct("e", "r", hash_bucket("h", blocks, "e").alias("b"))
    packed = rows.groupBy("c").agg(F.array_sort(F.collect_list(entry)).alias("h"))
    packed = packed.select("h", F.explode(F.array_distinct(F.transform("h", lambda x: x["b"]))).alias("block"))
    if upward:
        first = F.array_position(F.transform("h", lambda x: x["b"]), F.col("block"))
        packed = packed.select(F.slice("h", first, F.size("h")).alias("h"), "block")
    places = F.transform("h", lambda x, i: F.when(x["b"] == F.col("block"), i))
    return packed.select(
        "block", F.filter(places, lambda i: i.isNotNull()).alias("own"), F.col("h.e").alias("es"), F.col("h.r").alias("rs")
    )


def block_sums(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, entity numbers, partner numbers, sums) for runs of the block's entities, by entity and partner; ids are sorted."""
    sizes = pdf["es"].str.len().to_numpy()
    codes, ids = pd.factorize(np.concatenate(pdf["es"].tolist()), sort=True)
    value = np.concatenate(pdf["rs"].tolist())
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(pdf)), pdf["own"].str.len())
    at = np.concatenate(pdf["own"].tolist()) + starts[row]
    order = np.argsort(codes[at], kind="stable")
    row, at = row[order], at[order]
    first = np.flatnonzero(np.diff(codes[at], prepend=-1))
    fan = np.add.reduceat(sizes[row], first)
    ends = np.append(first, len(at))
    for low, high in runs(fan, EXPAND, len(first)):
        keys, sums = [], []
        for begin, end in runs(sizes[row[ends[low] : ends[high]]], EXPAND, ends[high] - ends[low]):
            some = slice(ends[low] + begin, ends[low] + end)
            place, of = expanded(starts[row[some]], sizes[row[some]])
            unique, inverse = np.unique(codes[at[some]][of].astype(np.int64) * len(ids) + codes[place], return_inverse=True)
            keys.append(unique)
            sums.append(np.bincount(inverse, value[at[some]][of] * value[place], len(unique)))
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        yield np.asarray(ids), key // len(ids), key % len(ids), np.bincount(inverse, np.concatenate(sums), len(key))


def count_blocks(n_ratings: int) -> int:
    return max(4, -(-n_ratings // BLOCK_RATINGS))


def pair_sums(rows: DataFrame, n_ratings: int) -> DataFrame:
    """``id_a < id_b, dot`` for all pairs with a common context, complete."""
    kind = rows.schema["e"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for ids, entity, partner, dot in block_sums(pdf):
            up = partner > entity
            out.append(pd.DataFrame({"id_a": plain(ids[entity[up]]), "id_b": plain(ids[partner[up]]), "dot": dot[up]}))
        return pd.concat(out, ignore_index=True)

    sent = histories(rows, count_blocks(n_ratings), upward=True)
    return sent.groupBy("block").applyInPandas(run, f"id_a {kind}, id_b {kind}, dot double")


def _sizes(of_lists: pa.ChunkedArray) -> np.ndarray:
    return pc.list_value_length(of_lists).to_numpy().astype(np.int64)


def _flat(of_lists: pa.ChunkedArray) -> pa.Array:
    return of_lists.combine_chunks().flatten()


def _numbers(of_lists: pa.ChunkedArray) -> np.ndarray:
    return _flat(of_lists).to_numpy(zero_copy_only=False)


def _sorted_ids(values: pa.Array) -> pa.Array:
    ids = pc.unique(values)
    return ids.take(pc.array_sort_indices(ids))


def _places(values: pa.Array, ids: pa.Array) -> np.ndarray:
    """Where the values are in ``ids``, -1 for those that are not."""
    return pc.fill_null(pc.index_in(values, value_set=ids), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _asked_products(met: pa.Table, x_ids: pa.Array, y_ids: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(low, high, keys, sums) for runs of the asked entities: sorted keys ``(x - low) * partners + y`` of pairs that share a context."""
    parts = []
    for batch in met.to_batches():  # partners that nobody asks for are left out before the next batch is looked at
        some = pa.Table.from_batches([batch])
        x, y = _places(_flat(some["mine"]), x_ids), _places(_flat(some["es"]), y_ids)
        here, of = y >= 0, np.repeat(np.arange(len(some)), _sizes(some["es"]))
        parts.append((
            x, np.repeat(np.arange(len(some)), _sizes(some["mine"])), _numbers(some["mine_rs"]), np.bincount(of[here], minlength=len(some)),
            y[here].astype(np.int32), _numbers(some["rs"])[here],
        ))
    rows = np.cumsum([0] + [len(p[3]) for p in parts])
    row = np.concatenate([p[1] + at for p, at in zip(parts, rows)])
    x, own, sizes, y, value = (np.concatenate([p[n] for p in parts]) for n in (0, 2, 3, 4, 5))
    del parts
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(x, kind="stable")
    order = order[np.searchsorted(x[order], 0):]
    x, row, own = x[order], row[order], own[order]
    fan = sizes[row]
    ends = np.searchsorted(x, np.arange(len(x_ids) + 1))
    total = np.concatenate([[0], np.cumsum(fan)])
    for low, high in runs(total[ends[1:]] - total[ends[:-1]], ASKED_AT_ONCE, len(x_ids)):
        keys, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
        for begin, end in runs(fan[ends[low] : ends[high]], ASKED_AT_ONCE, max(1, ends[high] - ends[low])):
            some = slice(ends[low] + begin, ends[low] + end)
            place, pair = expanded(starts[row[some]], fan[some])
            key, dot = _summed([(x[some][pair] - low) * len(y_ids) + y[place]], [own[some][pair] * value[place]])
            keys.append(key)
            sums.append(dot)
        yield low, high, *_summed(keys, sums)


def _asked_in_block(met: pa.Table, lists: pa.Table, n_context: int, k: int) -> pa.Table:
    """``c, i, num, den`` of the pairs in ``lists``: their sums over the k most similar entities of the context."""
    i, i_sizes, length = _flat(lists["of"]), _sizes(lists["of"]), _sizes(lists["js"])
    start = np.cumsum(length) - length
    x_ids, y_ids = _sorted_ids(i), _sorted_ids(_flat(lists["js"]))
    x, y, row = _places(i, x_ids), _places(_flat(lists["js"]), y_ids).astype(np.int32), np.repeat(np.arange(len(lists)), i_sizes)
    mj, qj = _numbers(lists["ms"]), _numbers(lists["qs"])
    dev = _numbers(lists["rs"]) - mj
    mi, qi = _numbers(lists["mis"]), _numbers(lists["qis"])
    self_of = _places(x_ids, y_ids)
    num, den = np.zeros(len(x)), np.zeros(len(x))
    by_entity = np.argsort(x, kind="stable")
    ends = np.searchsorted(x[by_entity], np.arange(len(x_ids) + 1))
    # without histories of the asked entities there are no products
    products = _asked_products(met, x_ids, y_ids) if len(met) else [(0, len(x_ids), np.zeros(0, np.int64), np.zeros(0))]
    for low, high, key, dot in products:
        mine = by_entity[ends[low] : ends[high]]
        widest = 2 ** np.ceil(np.log2(length[row[mine]])).astype(np.int64)
        order = np.argsort(widest, kind="stable")  # histories of like length share a matrix
        mine, widest = mine[order], widest[order]
        for begin, end in runs(widest, SCORED_AT_ONCE, max(1, len(mine))):
            at = mine[begin:end]
            size = length[row[at]][:, None]
            column = np.arange(size.max())[None, :]
            there = column < size
            place = np.where(there, start[row[at]][:, None] + column, 0)
            partner, pair = y[place], x[at][:, None]
            sim = np.zeros(place.shape)
            if len(key):
                wanted = (pair - low) * len(y_ids) + partner
                found = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
                sim = np.where(key[found] == wanted, dot[found], 0.0)
            scale = np.sqrt(qi[at][:, None] * qj[place])
            with np.errstate(divide="ignore", invalid="ignore"):
                sim = np.where(scale > 0, (sim - n_context * mi[at][:, None] * mj[place]) / scale, 0.0)
            itself = there & (partner == self_of[pair])
            sim = np.where(itself, np.where(qi[at][:, None] > 0, 1.0, 0.0), sim)  # counts where it is the only one
            there &= ~itself | (size == 1)
            rounded = np.where(there, np.round(sim, 9), -np.inf)
            if rounded.shape[1] > k:
                last = -np.partition(-rounded, k - 1, axis=1)[:, k - 1 : k]
                before = rounded > last
                there &= before | ((rounded == last) & (np.cumsum(rounded == last, axis=1) <= k - before.sum(axis=1, keepdims=True)))
            sim = np.where(there, sim, 0.0)
            num[at], den[at] = (sim * dev[place]).sum(axis=1), np.abs(sim).sum(axis=1)
    c = lists["c"].combine_chunks().take(pa.array(row))
    return pa.table({"c": c, "i": i, "num": num, "den": den})


def asked_scores(rows: DataFrame, rated: DataFrame, entities: DataFrame, asked: DataFrame, n_context: int, k: int) -> DataFrame:
    """``c, i, num, den`` per pair of ``asked`` (``c, i, m, q``): weighted deviations of its k neighbours, and the weights.

    ``rated`` (``c, j, r``) are the histories to choose from, ``entities`` (``j, m, q``) their means and centred squared
    norms, ``rows`` (``c, e, r``) all ratings that products are made of. A block of asked entities gets the histories they are in, less the entities that no
    asked context has, and the histories of its asked contexts; it makes its products and scores its pairs, so
    neither products nor pairs x history are ever rows. Many pairs of few entities are dealt to several lanes.
    """
    c_type, kind = asked.schema["c"].dataType.simpleString(), rows.schema["e"].dataType.simpleString()
    asked = asked.withColumn("i", F.col("i").cast(kind))
    mine = rows.join(asked.select(F.col("i").alias("e")).distinct(), "e", "left_semi")
    contexts = asked.groupBy("c").agg(F.count(F.lit(1)).alias("_n"))
    near = rated.join(contexts, "c").join(entities, "j")
    packed = cut_lineage(near.groupBy("c").agg(
        F.array_sort(F.collect_list(F.struct("j", "r", "m", "q"))).alias("h"), F.first("_n").alias("_n")
    ))
    met = packed.select(F.explode("h.j").alias("e")).distinct()
    blocks = max(4, -(-mine.count() // BLOCK_RATINGS))
    sent = packed.agg(F.sum(F.size("h") * F.least(F.col("_n"), F.lit(blocks)))).first()[0] or 0
    lanes = max(1, -(-sent // (blocks * LIST_RATINGS)))
    block, lane = hash_bucket("h", blocks, "e"), hash_bucket("l", lanes, "c")
    own = mine.groupBy("c", block.alias("b")).agg(F.collect_list(F.struct("e", "r")).alias("o"))
    partners = rows.join(met, "e", "left_semi").groupBy("c").agg(F.collect_list(F.struct("e", "r")).alias("h"))
    every = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("l")
    sums = own.join(partners, "c").select(
        "b", every, F.col("o.e").alias("mine"), F.col("o.r").alias("mine_rs"), F.col("h.e").alias("es"), F.col("h.r").alias("rs")
    )
    of = asked.groupBy("c", hash_bucket("h", blocks, "i").alias("b")).agg(F.collect_list(F.struct("i", "m", "q")).alias("o"))
    lists = of.join(packed, "c").select(
        F.col("b").alias("_b"), lane.alias("_l"), "c", F.col("o.i").alias("of"), F.col("o.m").alias("mis"), F.col("o.q").alias("qis"),
        F.col("h.j").alias("js"), *[F.col(f"h.{x}").alias(f"{x}s") for x in ("r", "m", "q")],
    )

    def run(met: pa.Table, lists: pa.Table) -> pa.Table:
        if not len(lists):
            return pa.schema([pa.field(n, t) for n, t in types]).empty_table()
        return _asked_in_block(met, lists, n_context, k)

    schema = f"c {c_type}, i {kind}, num double, den double"
    types = list(zip(("c", "i", "num", "den"), to_arrow_schema(asked.select("c", "i", "m", "q").schema).types))
    return sums.groupBy("b", "l").cogroup(lists.groupBy("_b", "_l")).applyInArrow(run, schema)


def _nearest_in_block(block: pa.Table, mean: np.ndarray, spread: np.ndarray, n_context: int, k: int) -> pa.Table:
    """``id, neighbor, sim`` of the block's entities, all by number; ``mean`` and ``spread`` are indexed by it."""
    sizes, e, r = _sizes(block["es"]), _numbers(block["es"]), _numbers(block["rs"])
    starts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(block)), _sizes(block["own"]))
    at = _numbers(block["own"]) + starts[row]
    order = np.argsort(e[at], kind="stable")
    row, at = row[order], at[order]
    first = np.flatnonzero(np.diff(e[at], prepend=-1))
    fan, ends = np.add.reduceat(sizes[row], first), np.append(first, len(at))
    out = []
    for low, high in runs(fan, ASKED_AT_ONCE, len(first)):
        keys, sums = [], []
        for begin, end in runs(sizes[row[ends[low] : ends[high]]], ASKED_AT_ONCE, ends[high] - ends[low]):
            some = slice(ends[low] + begin, ends[low] + end)
            place, of = expanded(starts[row[some]], sizes[row[some]])
            owner = np.searchsorted(first[low:high], np.arange(some.start, some.stop), "right") - 1
            other = e[at[some]][of] != e[place]
            place, of = place[other], of[other]
            key, dot = _summed([owner[of] * len(mean) + e[place]], [r[at[some]][of] * r[place]])
            keys.append(key)
            sums.append(dot)
            del place, of, other
        key, dot = _summed(keys, sums)
        owner, partner = key // len(mean), key % len(mean)
        entity = e[at[first[low:high]]]
        scale = spread[entity][owner] * spread[partner]
        with np.errstate(divide="ignore", invalid="ignore"):
            sim = np.where(scale > 0, (dot - n_context * mean[entity][owner] * mean[partner]) / scale, 0.0)
        rounded = np.round(sim, 9)
        open_ = np.flatnonzero(rounded >= _last_of_best(rounded, np.bincount(owner, minlength=high - low), k)[owner])
        open_ = open_[np.lexsort((partner[open_], -rounded[open_], owner[open_]))]
        counts = np.bincount(owner[open_], minlength=high - low)
        best = open_[np.arange(len(open_)) - np.repeat(np.cumsum(counts) - counts, counts) < k]
        out.append((entity[owner[best]], partner[best].astype(np.int32), sim[best]))
    return pa.table({n: np.concatenate([o[x] for o in out]) for x, n in enumerate(("id", "neighbor", "sim"))})


def _summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and the sums of their values; empties both lists."""
    key, value = np.concatenate(keys), np.concatenate(values)
    keys.clear(), values.clear()
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(value, first) if len(first) else value


def _last_of_best(scores: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of every run of ``sizes`` scores, less than all for shorter ones."""
    out, starts = np.full(len(sizes), -np.inf), np.cumsum(sizes) - sizes
    long = np.flatnonzero(sizes > k)
    long = long[np.argsort(sizes[long], kind="stable")]  # runs of like size share a matrix
    for begin, end in runs(sizes[long], SCORED_AT_ONCE, max(1, len(long))):
        mine = long[begin:end]
        while len(mine):
            width = sizes[mine[-1]]
            part = mine[2 * sizes[mine] >= width]
            column = np.arange(width)[None, :]
            there = column < sizes[part][:, None]
            matrix = np.where(there, -scores[np.where(there, starts[part][:, None] + column, 0)], np.inf)
            out[part] = -np.partition(matrix, k - 1, axis=1)[:, k - 1]
            mine = mine[: len(mine) - len(part)]
    return out


def nearest_of_blocks(rows: DataFrame, entities: DataFrame, n_ratings: int, n_context: int, k: int) -> DataFrame:
    """``id, neighbor, sim``: the k most similar partners per entity. ``entities`` holds ``e, m, q`` (mean, centred squared norm).

    Entities are numbered in the order of their ids, so a history is sent in a few bytes per rating. Means and
    spreads reach the tasks once where they fit a broadcast, else with the ratings.
    """
    kind = rows.schema["e"].dataType.simpleString()
    numbered = rank_rows(entities.select("e", "m", F.sqrt("q").alias("s")), [], [F.asc("e")], "_no")
    numbered = cut_lineage(numbered.select("e", "m", "s", (F.col("_no") - 1).cast("int").alias("no")))
    n = numbered.count()
    shared = fits_broadcast(rows.sparkSession, n, 48)
    rating = "r" if shared else F.struct("r", "m", "s").alias("r")
    own = broadcast_if_small(numbered, n, 48)
    sent = histories(rows.join(own, "e").select("c", F.col("no").alias("e"), rating), count_blocks(n_ratings))
    if shared:
        table = numbered.select("no", "m", "s").toPandas().sort_values("no")
        stats = rows.sparkSession.sparkContext.broadcast((table["m"].to_numpy(), table["s"].to_numpy()))
    else:
        sent = sent.select("block", "own", "es", *[F.col(f"rs.{x}").alias(f"{x}s") for x in ("r", "m", "s")])

    def run(block: pa.Table) -> pa.Table:
        if shared:
            mean, spread = stats.value
        else:
            mean, spread, e = np.zeros(n), np.zeros(n), _numbers(block["es"])
            mean[e], spread[e] = _numbers(block["ms"]), _numbers(block["ss"])
        return _nearest_in_block(block, mean, spread, n_context, k)

    found = sent.groupBy("block").applyInArrow(run, "id int, neighbor int, sim double")
    ids = broadcast_if_small(numbered.select("e", "no"), n, 48)
    for column in ("id", "neighbor"):
        name = ids.select(F.col("no").alias(column), F.col("e").alias(f"_{column}"))
        found = found.join(name, column).drop(column).withColumnRenamed(f"_{column}", column)
    return found.select(F.col("id").cast(kind).alias("id"), F.col("neighbor").cast(kind).alias("neighbor"), "sim")

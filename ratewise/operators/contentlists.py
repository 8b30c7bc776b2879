"""Exact top-N lists from lists of similar items, without a row per user and scored item.

An item is scored for a user where a rated item is in its list; all others keep their mean, so of these the
first unknown ones by mean suffice. A task holds a block of users with their deviations and a block of items with
their means and lists. It adds up the weighted deviations of a few users at a time and returns ``amount`` rows per
user, so what is shuffled is ratings x item blocks and lists x user blocks, never the scored pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_bucket
from ..session import cut_lineage
from .histories import _flat, _last_of_best, _numbers, _places, _sizes, _sorted_ids
from .similarjoin import expanded, runs

#: Ratings and known pairs of a block of users, list entries of a block of items, sums of one step.
USER_RATINGS = 3_000_000
LIST_ENTRIES = 3_000_000
SUMMED_AT_ONCE = 500_000


def _grouped(owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by owner, and where each of n owners starts and how many it has."""
    sizes = np.bincount(owner, minlength=n)
    return np.argsort(owner, kind="stable"), np.cumsum(sizes) - sizes, sizes


def _is_in(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` are among the sorted ``keys``."""
    at = np.searchsorted(keys, wanted)
    return keys[np.minimum(at, len(keys) - 1)] == wanted if len(keys) else np.zeros(len(wanted), bool)


def _first_free(n_users: int, n_items: int, taken: np.ndarray, amount: int) -> np.ndarray:
    """Keys of the first ``amount`` places of every user that are not among the sorted keys ``taken``."""
    out, open_, need, at, width = [], np.arange(n_users), np.full(n_users, amount), 0, 2 * amount
    while len(open_) and at < n_items:
        # few users at a time, so that a wide step stays small
        more, step = [], min(width, n_items - at)
        for begin in range(0, len(open_), max(1, SUMMED_AT_ONCE // step)):
            mine = open_[begin : begin + max(1, SUMMED_AT_ONCE // step)]
            keys = mine[:, None] * n_items + np.arange(at, at + step)[None, :]
            free = ~_is_in(taken, keys.ravel()).reshape(keys.shape)
            free &= np.cumsum(free, axis=1) <= need[mine][:, None]
            out.append(keys[free])
            need[mine] -= free.sum(axis=1)
            more.append(mine[need[mine] > 0])
        open_, at, width = np.concatenate(more), at + step, 2 * width
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _lists_of_cell(users: pa.Table, items: pa.Table, amount: int) -> pa.Table:
    """``user_id, item_id, score``: the ``amount`` best items of the cell per user."""
    ids, mean = items["item_id"].combine_chunks(), _numbers_of(items["mean"])
    by_id = _places(ids, _sorted_ids(ids))
    place = np.empty(len(ids), np.int64)
    place[np.lexsort((by_id, -np.round(mean, 9)))] = np.arange(len(ids))
    item_at = np.argsort(place)
    mean, by_id, n_items = mean[item_at], by_id[item_at], len(ids)
    user_ids = _sorted_ids(users["user_id"].combine_chunks())
    user = _places(users["user_id"].combine_chunks(), user_ids)
    # ratings by user, list entries by the rated item
    j_ids = _sorted_ids(_flat(users["js"]))
    j, dev, of = _places(_flat(users["js"]), j_ids), _numbers(users["devs"]), np.repeat(user, _sizes(users["js"]))
    order, start, length = _grouped(of, len(user_ids))
    j, dev = j[order], dev[order]
    neighbor = _places(_flat(items["neighbors"]), j_ids)
    met = np.flatnonzero(neighbor >= 0)
    entry = np.repeat(place, _sizes(items["neighbors"]))[met]
    order, e_start, e_fan = _grouped(neighbor[met], len(j_ids))
    entry, sim = entry[order].astype(np.int32), _numbers(items["sims"])[met[order]]
    del neighbor, met, order, of
    k_place = _places(_flat(users["ks"]), ids)
    k_user = np.repeat(user, _sizes(users["ks"]))[k_place >= 0]
    known = np.unique(k_user * n_items + place[k_place[k_place >= 0]])
    fan = np.bincount(np.repeat(np.arange(len(user_ids)), length), e_fan[j], len(user_ids)).astype(np.int64)
    out = []
    for low, high in runs(fan, SUMMED_AT_ONCE, max(1, SUMMED_AT_ONCE // (8 * amount))):
        rated = slice(start[low], start[high - 1] + length[high - 1])
        owner = np.repeat(np.arange(high - low), length[low:high])
        keys, nums, dens = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
        for begin, end in runs(e_fan[j[rated]], SUMMED_AT_ONCE, max(1, len(owner))):
            some = slice(rated.start + begin, rated.start + end)
            at, row = expanded(e_start[j[some]], e_fan[j[some]])
            keys.append(owner[begin:end][row] * n_items + entry[at])
            nums.append(sim[at] * dev[some][row])
            dens.append(np.abs(sim[at]))
            keys, nums, dens = _added(keys, nums, dens)
        key, num, den = keys[0], nums[0], dens[0]
        mine = known[np.searchsorted(known, low * n_items) : np.searchsorted(known, high * n_items)] - low * n_items
        with np.errstate(divide="ignore", invalid="ignore"):
            score = mean[key % n_items] + np.where(den > 1e-9, num / den, 0.0)
        rest = _first_free(high - low, n_items, np.union1d(key, mine), amount)
        fresh = ~_is_in(mine, key)
        key, score = key[fresh], score[fresh]
        rounded = np.round(score, 9)
        best = rounded >= _last_of_best(rounded, np.bincount(key // n_items, minlength=high - low), amount)[key // n_items]
        key, score = np.concatenate([key[best], rest]), np.concatenate([score[best], mean[rest % n_items]])
        owner, at = key // n_items, key % n_items
        order = np.lexsort((by_id[at], -np.round(score, 9), owner))
        counts = np.bincount(owner, minlength=high - low)
        order = order[np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts) < amount]
        out.append((owner[order] + low, item_at[at[order]], score[order]))
    owner, at, score = (np.concatenate([o[n] for o in out]) for n in range(3))
    return pa.table({"user_id": user_ids.take(pa.array(owner)), "item_id": ids.take(pa.array(at)), "score": score})


def _numbers_of(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def _added(keys: list, nums: list, dens: list) -> tuple[list, list, list]:
    """One array each: sorted different keys with their sums."""
    key, num, den = np.concatenate(keys), np.concatenate(nums), np.concatenate(dens)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    if not len(first):
        return [key], [num], [den]
    return [key[first]], [np.add.reduceat(num[order], first)], [np.add.reduceat(den[order], first)]


def best_by_similarity(
    users: DataFrame, deviations: DataFrame, items: DataFrame, similar: DataFrame, known: DataFrame | None, amount: int
) -> DataFrame:
    """``user_id, item_id, score`` with the ``amount`` best items per user and block of items.

    ``users`` (``user_id``), ``deviations`` (``user_id, neighbor, dev``), ``items`` (``item_id, mean``),
    ``similar`` (``item_id, neighbor, sim``), ``known`` (``user_id, item_id``) pairs that are left out.
    """
    kind, user_kind = (df.schema[c].dataType.simpleString() for df, c in ((items, "item_id"), (users, "user_id")))
    lists = similar.groupBy("item_id").agg(F.collect_list(F.struct(F.col("neighbor").cast(kind).alias("neighbor"), "sim")).alias("l"))
    n_entries = similar.count()
    listed = similar.select(F.col("neighbor").alias("_listed")).distinct()
    near = deviations.join(listed, F.col("neighbor") == F.col("_listed"), "left_semi")
    packed = near.groupBy("user_id").agg(F.collect_list(F.struct(F.col("neighbor").cast(kind).alias("neighbor"), "dev")).alias("h"))
    packed = cut_lineage(users.join(packed, "user_id", "left").select("user_id", "h.neighbor", "h.dev"))
    n_users, n_rated = packed.agg(F.count(F.lit(1)), F.sum(F.greatest(F.lit(0), F.coalesce(F.size("dev"), F.lit(0))))).first()
    pairs = None if known is None else known.select("user_id", F.col("item_id").try_cast(kind).alias("item_id")).filter("item_id IS NOT NULL")
    i_blocks = max(1, -(-n_entries // LIST_ENTRIES))
    n_known = 0 if known is None else -(-pairs.count() // i_blocks)
    u_blocks = max(-(-8 // i_blocks), -(-max(n_rated or 0, n_known, n_users) // USER_RATINGS))
    u_of, i_of = hash_bucket("u", u_blocks, "user_id").alias("u"), hash_bucket("i", i_blocks, "item_id").alias("i")
    all_of = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    no_ids, no_values = F.array().cast(f"array<{kind}>"), F.array().cast("array<double>")
    left = packed.select(
        u_of, all_of(i_blocks, "i"), "user_id", F.coalesce("neighbor", no_ids).alias("js"), F.coalesce("dev", no_values).alias("devs"), no_ids.alias("ks")
    )
    if known is not None:
        masks = pairs.join(packed.select("user_id"), "user_id", "left_semi").groupBy("user_id", i_of).agg(F.collect_list("item_id").alias("ks"))
        left = left.unionByName(masks.select(u_of, "i", "user_id", no_ids.alias("js"), no_values.alias("devs"), "ks"))
    right = items.join(lists, "item_id", "left").select(
        all_of(u_blocks, "_u"), i_of.alias("_i"), "item_id", "mean",
        F.coalesce("l.neighbor", no_ids).alias("neighbors"), F.coalesce("l.sim", no_values).alias("sims"),
    )

    def run(users: pa.Table, items: pa.Table) -> pa.Table:
        if not len(users) or not len(items):
            return pa.table({"user_id": users["user_id"][:0], "item_id": items["item_id"][:0], "score": pa.array([], "double")})
        return _lists_of_cell(users, items, amount)

    schema = f"user_id {user_kind}, item_id {kind}, score double"
    return left.groupBy("u", "i").cogroup(right.groupBy("_u", "_i")).applyInArrow(run, schema)

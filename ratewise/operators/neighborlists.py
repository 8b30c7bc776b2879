"""Exact top-N lists of neighbourhood models over all items, without users x items rows.

A prediction is the target's mean plus a weighted mean of terms ``sign(sim) * deviation`` of the k
neighbours. In a context of at most k ratings all are neighbours, and the sums are sparse products of
the ratings with the stored similarities plus, for pairs without common raters, a product of one factor
per target and one per context. In longer ones let P be the rated entities with positive similarity. If
P has at most k members, the prediction is at most the larger of P's own weighted mean and the largest
negative deviation; without P it is at most the latter; else it is at most the largest deviation.

A task holds a block of contexts with their ratings, and a block of targets with the histories they are
in, from which it makes their products (``histories``); where a history is too long for an array, the stored
products are sent instead. It adds up the bounds of the whole tile, scores the most promising pairs of every list exactly, and then
only those whose bound still reaches the list's last place. It returns ``amount`` rows per list, so
what is shuffled afterwards is linear in users, never in users x items.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.text import hash_bucket
from ..session import broadcast_if_small, cut_lineage
from . import histories
from .model import Model
from .neighbors import _sides, predict_neighbors, stored_products
from .ranking import stable, top_k
from .recommend import first_unknown_items
from .similarjoin import expanded, plain, runs

#: Size of a tile: targets, products of a target block, ratings of a context block.
TARGETS = 4_000
EDGES = 4_000_000
CONTEXT_ROWS = 2_000_000
#: Contexts with more ratings are scored pair by pair.
LONGEST = 500_000
CELLS = 2_000_000
EXPAND = 4_000_000
SLACK = 1e-7


class Tile:
    """A block of contexts against a block of targets; everything is numbered within the tile."""

    def __init__(self, left: pd.DataFrame, right: pd.DataFrame, n_context: int, k: int):
        self.n_context, self.k = n_context, k
        targets = right[right["kind"] == 1].sort_values("i", ignore_index=True)
        self.x_ids = np.asarray(plain(targets["i"]))
        self.mi, self.qi = targets["m"].to_numpy(), targets["q"].to_numpy()
        rated = left[left["kind"] == 0]
        self.c_ids = np.sort(np.asarray(plain(left.loc[left["kind"] == 1, "c"].unique())))
        y, y_ids = pd.factorize(rated["j"], sort=True)
        c = pd.Index(self.c_ids).get_indexer(rated["c"])
        order = np.lexsort((y, c))
        self.y, self.c = y[order], c[order]
        self.dev = rated["v"].to_numpy()[order]
        first = np.unique(y, return_index=True)[1]
        self.mj, self.qj = rated["m"].to_numpy()[first], rated["q"].to_numpy()[first]
        self.length = np.bincount(self.c, minlength=len(self.c_ids))
        self.start = np.cumsum(self.length) - self.length
        self.self_of = pd.Index(self.x_ids).get_indexer(y_ids) if len(y_ids) else np.zeros(0, int)
        self._edges(right[right["kind"] == 0], y_ids)
        masked = left[left["kind"] == 2]
        mask_c, mask_x = pd.Index(self.c_ids).get_indexer(masked["c"]), pd.Index(self.x_ids).get_indexer(masked["j"])
        inside = (mask_c >= 0) & (mask_x >= 0)
        order = np.argsort(mask_c[inside], kind="stable")
        self.mask_c, self.mask_x = mask_c[inside][order], mask_x[inside][order]

    def _edges(self, edges: pd.DataFrame, y_ids) -> None:
        x = pd.Index(self.x_ids).get_indexer(edges["i"])
        y = pd.Index(y_ids).get_indexer(edges["j"]) if len(y_ids) else np.full(len(edges), -1)
        here = (x >= 0) & (y >= 0)
        x, y, dot = x[here], y[here], edges["v"].to_numpy()[here]
        key = y.astype(np.int64) * len(self.x_ids) + x
        order = np.argsort(key, kind="stable")
        self.key, self.dot = key[order], dot[order]
        self.px, y = x[order], y[order]
        self.ps = self._sim(self.px, y, self.dot)
        self.apart = self.ps - self._sim(self.px, y, np.zeros(len(y)))  # more than without common raters
        self.fan = np.bincount(y, minlength=len(y_ids))
        self.p_start = np.cumsum(self.fan) - self.fan

    def _sim(self, x, y, dot) -> np.ndarray:
        scale = np.sqrt(self.qi[x] * self.qj[y])
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(scale > 0, (dot - self.n_context * self.mi[x] * self.mj[y]) / scale, 0.0)

    def chunks(self) -> list[tuple[int, int]]:
        """Runs of contexts whose bounds are added up at once."""
        fan = np.bincount(self.c, self.fan[self.y] if len(self.y) else None, len(self.c_ids)).astype(np.int64)
        return runs(fan, EXPAND, max(1, CELLS // max(1, len(self.x_ids))))

    def bounds(self, low: int, high: int) -> np.ndarray:
        """No prediction of contexts [low, high) exceeds its bound; known pairs have none."""
        shape = (high - low, len(self.x_ids))
        size = shape[0] * shape[1]
        num, den, n, num_all, den_all = (np.zeros(size) for _ in range(5))
        rows = np.arange(self.start[low], self.start[high - 1] + self.length[high - 1])
        fan = self.fan[self.y[rows]]
        for begin, end in runs(fan, EXPAND, max(1, len(rows))):
            some = rows[begin:end]
            place, of = expanded(self.p_start[self.y[some]], self.fan[self.y[some]])
            cell = (self.c[some][of] - low) * shape[1] + self.px[place]
            sim, apart, dev = self.ps[place], self.apart[place], self.dev[some][of]
            num_all += np.bincount(cell, apart * dev, size)
            den_all += np.bincount(cell, np.abs(sim) - np.abs(sim - apart), size)
            up = sim > 0
            num += np.bincount(cell[up], (sim * dev)[up], size)
            den += np.bincount(cell[up], sim[up], size)
            n += np.bincount(cell[up], minlength=size)
        c = self.c[rows] - low
        most, least, signed, plain = (np.zeros(shape[0]) for _ in range(4))
        np.maximum.at(most, c, self.dev[rows])  # largest deviation and largest negative one, at least 0
        np.maximum.at(least, c, -self.dev[rows])
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(self.qj > 0, self.mj / np.sqrt(self.qj), 0.0)[self.y[rows]]
            factor = np.where(self.qi > 0, -self.n_context * self.mi / np.sqrt(self.qi), 0.0)
            signed += np.bincount(c, share * self.dev[rows], shape[0])
            plain += np.bincount(c, np.abs(share), shape[0])
            num, den, n, num_all, den_all = (v.reshape(shape) for v in (num, den, n, num_all, den_all))
            num_all = num_all + np.outer(signed, factor)
            den_all = den_all + np.outer(plain, np.abs(factor))
            every = np.where(den_all > 1e-9, num_all / den_all, 0.0)
            mean = np.where(den > 0, num / den, 0.0)
        few = self.length[low:high] <= self.k
        out = np.maximum(np.where(n <= self.k, mean, most[:, None]), least[:, None])
        # sums so small that rounding decides count as open
        out = np.where(few[:, None] & (den_all > 1e-7), every, out) + self.mi[None, :]
        # the target's own rating counts where it is the only one
        own = self.self_of[self.y[rows]]
        at = (self.c[rows][own >= 0] - low, own[own >= 0])
        out[at] = np.maximum(out[at], self.mi[at[1]] + np.maximum(most, least)[at[0]])
        begin, end = np.searchsorted(self.mask_c, [low, high])
        out[self.mask_c[begin:end] - low, self.mask_x[begin:end]] = -np.inf
        return out

    def exact(self, c: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Predictions of pairs."""
        out = np.zeros(len(c))
        for begin, end in runs(self.length[c], EXPAND, max(1, len(c))):
            out[begin:end] = self._exact(c[begin:end], x[begin:end])
        return out

    def _exact(self, c: np.ndarray, x: np.ndarray) -> np.ndarray:
        place, pair = expanded(self.start[c], self.length[c])
        y, mine = self.y[place], x[pair]
        key = y.astype(np.int64) * len(self.x_ids) + mine
        at = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        dot = np.where(self.key[at] == key, self.dot[at], 0.0) if len(self.key) else np.zeros(len(key))
        sim = self._sim(mine, y, dot)
        own = self.self_of[y] == mine if len(y) else np.zeros(0, bool)
        alone = self.length[c][pair] == 1
        sim[own & alone] = np.where(self.qi[mine[own & alone]] > 0, 1.0, 0.0)
        keep = ~own | alone
        y, pair, sim, dev = y[keep], pair[keep], sim[keep], self.dev[place[keep]]
        order = np.lexsort((y, -np.round(sim, 9), pair))
        counts = np.bincount(pair, minlength=len(c))
        rank = np.arange(len(pair)) - np.repeat(np.cumsum(counts) - counts, counts)
        near = order[rank < self.k]
        num = np.bincount(pair[near], sim[near] * dev[near], len(c))
        den = np.bincount(pair[near], np.abs(sim[near]), len(c))
        return self.mi[x] + np.where(den > 1e-9, num / np.where(den > 1e-9, den, 1.0), 0.0)


def lists_of_tile(left: pd.DataFrame, right: pd.DataFrame, n_context: int, k: int, amount: int, by_context: bool) -> pd.DataFrame:
    """``c, i, score``: the ``amount`` best pairs per context, or per target."""
    empty = pd.DataFrame({"c": plain([]), "i": plain([]), "score": plain([])})
    if not len(left) or not (right["kind"] == 1).any():
        return empty
    tile = Tile(left, right, n_context, k)
    if not len(tile.c_ids):
        return empty
    n_lists = len(tile.c_ids) if by_context else len(tile.x_ids)
    last = np.full(n_lists, -np.inf)  # what the last place of a full list has
    c, x, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for low, high in tile.chunks():
        bound = tile.bounds(low, high)
        axis = 1 if by_context else 0
        for step in range(2):
            reach = last[low:high, None] if by_context else last[None, :]
            open_ = np.isfinite(bound) & (bound >= reach - SLACK)
            if step == 0 and bound.shape[axis] > amount:  # the most promising ones first
                top = np.argpartition(-bound, amount - 1, axis=axis)
                chosen = np.zeros(bound.shape, bool)
                np.put_along_axis(chosen, top[:, :amount] if by_context else top[:amount], True, axis=axis)
                open_ &= chosen
            more_c, more_x = np.nonzero(open_)
            bound[more_c, more_x] = -np.inf
            c, x = np.concatenate([c, more_c + low]), np.concatenate([x, more_x])
            score = np.concatenate([score, tile.exact(more_c + low, more_x)])
            owner, other = (c, x) if by_context else (x, c)
            order = np.lexsort((other, -np.round(score, 9), owner))
            counts = np.bincount(owner, minlength=n_lists)
            first = np.cumsum(counts) - counts
            rank = np.arange(len(order)) - np.repeat(first, counts)
            order = order[rank < amount]
            c, x, score = c[order], x[order], score[order]
            counts = np.minimum(counts, amount)
            full = np.flatnonzero(counts == amount)
            last[full] = score[np.cumsum(counts)[full] - 1]
    return pd.DataFrame({"c": plain(tile.c_ids[c]), "i": plain(tile.x_ids[x]), "score": score})


def tiles(n_entities: int, n_edges: int, n_rated: int) -> tuple[int, int]:
    """Blocks of targets, blocks of contexts."""
    t_blocks = max(1, -(-n_entities // TARGETS), -(-n_edges // EDGES))
    return t_blocks, max(1, -(-n_rated // CONTEXT_ROWS), -(-8 // t_blocks))


def _flat(column: pd.Series) -> np.ndarray:
    return np.concatenate(column.tolist()) if len(column) else np.zeros(0)


def _tile_rows(left: pd.DataFrame, right: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The rows of a tile from packed contexts and from the histories that its targets are in."""
    names = ["kind", "c", "j", "v", "m", "q"]

    def rows(kind: int, c, j, v=0.0, m=0.0, q=0.0) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(names, (kind, plain(c), plain(j), v, m, q))))

    rated, masked = left[left["js"].str.len() > 0], left[left["ks"].str.len() > 0]
    mean, own = _flat(rated["ms"]), left[~left["mask"]]
    parts = [rows(1, own["c"], own["c"])]
    if len(rated):
        c = np.repeat(rated["c"].to_numpy(), rated["js"].str.len())
        parts.append(rows(0, c, _flat(rated["js"]), _flat(rated["rs"]) - mean, mean, _flat(rated["qs"])))
    if len(masked):
        parts.append(rows(2, np.repeat(masked["c"].to_numpy(), masked["ks"].str.len()), _flat(masked["ks"])))
    met = right["own"].str.len() > 0
    targets, sources = right[~met], right[met]
    edges = [pd.DataFrame({"kind": 1, "i": plain(targets["i"]), "j": plain(targets["i"]), "v": 0.0, "m": plain(targets["m"]), "q": plain(targets["q"])})]
    if len(sources):
        for ids, entity, partner, dot in histories.block_sums(sources):
            other = entity != partner
            edges.append(pd.DataFrame({"kind": 0, "i": plain(ids[entity[other]]), "j": plain(ids[partner[other]]), "v": dot[other]}))
    return pd.concat(parts, ignore_index=True), pd.concat([e for e in edges if len(e)] or edges, ignore_index=True)


def _from_histories(
    model: Model, rows: DataFrame, lengths: DataFrame, targets: DataFrame, known: DataFrame | None,
    amount: int, n_rated: int, most: int, n_targets: int | None,
) -> DataFrame:
    """``c, i, score``: a tile gets its contexts as arrays, and the whole histories that its targets are in.

    The products of the targets are added up inside the tile, so the table of all products is neither made
    nor sent to every block of contexts. ``most`` bounds how many there are.
    """
    meta, stats = model.meta, model.tables["stats"]
    entity, context = _sides(meta["axis"])
    by_user = meta["axis"] == "item"
    n_entities = meta["n_items"] if by_user else meta["n_users"]
    t_blocks, c_blocks = tiles(n_entities, min(most, n_entities * n_entities), n_rated)
    short = lengths.select("c", hash_bucket("n", c_blocks, "c").alias("_c"))
    own = stats.select(F.col("id").alias("j"), F.col("mean").alias("m"), F.col("norm2").alias("q"))
    given = rows.filter("rating > 0").join(broadcast_if_small(own, n_entities, 48), "j")
    packed = given.groupBy("c").agg(F.collect_list(F.struct("j", F.col("rating").cast("double").alias("r"), "m", "q")).alias("h"))
    i_type, c_type = targets.schema["i"].dataType, rows.schema["c"].dataType
    no_ids, no_values = F.array().cast(ArrayType(i_type)), F.array().cast("array<double>")
    all_targets = F.explode(F.sequence(F.lit(0), F.lit(t_blocks - 1))).alias("_t")
    all_contexts = F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("_cb")
    t_of = lambda column: hash_bucket("h", t_blocks, column)  # as histories deals entities to blocks
    left = short.join(packed, "c", "left").select(
        "_c", all_targets, F.lit(False).alias("mask"), "c", F.coalesce("h.j", no_ids).alias("js"),
        *[F.coalesce(f"h.{x}", no_values).alias(f"{x}s") for x in ("r", "m", "q")], no_ids.alias("ks"),
    )
    if known is not None:
        pairs = known.select(F.col(context).alias("c"), F.col(entity).cast(i_type).alias("j")).filter("j IS NOT NULL").join(short, "c")
        masks = pairs.groupBy("_c", t_of("j").alias("_t"), "c").agg(F.collect_set("j").alias("ks"))
        left = left.unionByName(masks.select(
            "_c", "_t", F.lit(True).alias("mask"), "c", no_ids.alias("js"), *[no_values.alias(f"{x}s") for x in ("r", "m", "q")], "ks"
        ))
    nonzero = model.tables["ratings"].filter(F.col("rating") != 0).select(
        F.col(context).alias("c"), F.col(entity).alias("e"), F.col("rating").cast("double").alias("r")
    )
    zero = F.lit(0.0)
    right = histories.histories(nonzero, t_blocks).select(
        F.col("block").alias("_tb"), all_contexts, F.lit("0").cast(i_type).alias("i"), zero.alias("m"), zero.alias("q"), "own", "es", "rs"
    ).unionByName(targets.select(
        t_of("i").alias("_tb"), all_contexts, "i", "m", "q", F.array().cast("array<int>").alias("own"), no_ids.alias("es"), no_values.alias("rs")
    ))
    right = right.toDF(*[f"_r_{c}" for c in right.columns])  # both sides stem from the same tables
    n_context, k = meta["n_context"], meta["n_neighbors"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) and len(right):
            left, right = _tile_rows(left, right.rename(columns=lambda c: c.removeprefix("_r_")))
        else:  # no lists
            left, right = left[:0], pd.DataFrame({"kind": []})
        return lists_of_tile(left, right, n_context, k, amount, by_user)

    schema = f"c {c_type.simpleString()}, i {i_type.simpleString()}, score double"
    return left.groupBy("_c", "_t").cogroup(right.groupBy("_r__cb", "_r__tb")).applyInPandas(run, schema)


def _from_products(
    model: Model, rows: DataFrame, lengths: DataFrame, targets: DataFrame, known: DataFrame | None,
    amount: int, n_rated: int, most: int, n_targets: int | None,
) -> DataFrame:
    """``c, i, score`` where histories are too long for arrays: a tile gets ratings and stored products as rows."""
    meta, stats = model.meta, model.tables["stats"]
    entity, context = _sides(meta["axis"])
    by_user = meta["axis"] == "item"
    n_entities = meta["n_items"] if by_user else meta["n_users"]
    products = stored_products(model)
    n_products = products.count()
    t_blocks, c_blocks = tiles(n_entities, 2 * n_products, n_rated)
    short = lengths.filter(F.col("n") <= LONGEST).select("c", hash_bucket("n", c_blocks, "c").alias("_c"))
    own = stats.select(F.col("id").alias("j"), F.col("mean").alias("m"), F.col("norm2").alias("q"))
    given = rows.filter("rating > 0").join(broadcast_if_small(own, n_entities, 48), "j")
    given = given.join(short, "c")
    all_targets = F.explode(F.sequence(F.lit(0), F.lit(t_blocks - 1))).alias("_t")
    all_contexts = F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("_cb")
    t_of = lambda column: hash_bucket("t", t_blocks, column)
    i_type, c_type = targets.schema["i"].dataType, rows.schema["c"].dataType
    zero, some = F.lit(0.0), F.lit("0")  # any id where none is needed: nulls would turn ids into floats
    left = given.select("_c", all_targets, F.lit(0).alias("kind"), "c", "j", (F.col("rating") - F.col("m")).alias("v"), "m", "q").unionByName(
        short.select("_c", all_targets, F.lit(1).alias("kind"), "c", some.cast(i_type).alias("j"), zero.alias("v"), zero.alias("m"), zero.alias("q"))
    )
    if known is not None:
        pairs = known.select(F.col(context).alias("c"), F.col(entity).alias("j")).distinct().filter("j IS NOT NULL").join(short, "c")
        left = left.unionByName(
            pairs.select("_c", t_of("j").alias("_t"), F.lit(2).alias("kind"), "c", "j", zero.alias("v"), zero.alias("m"), zero.alias("q"))
        )
    ways = F.array(
        F.struct(F.col("id_a").alias("i"), F.col("id_b").alias("j"), "dot"), F.struct(F.col("id_b").alias("i"), F.col("id_a").alias("j"), "dot")
    )
    edges = products.select(F.inline(ways))
    if not by_user:
        edges = edges.join(broadcast_if_small(targets.select("i"), n_targets, 32), "i", "left_semi")
    right = edges.select(
        t_of("i").alias("_tb"), all_contexts, F.lit(0).alias("kind"), "i", "j", F.col("dot").alias("v"), zero.alias("m"), zero.alias("q")
    ).unionByName(
        targets.select(t_of("i").alias("_tb"), all_contexts, F.lit(1).alias("kind"), "i", some.cast(i_type).alias("j"), zero.alias("v"), "m", "q")
    )
    right = right.toDF(*[f"_r_{c}" for c in right.columns])  # both sides stem from the same tables
    n_context, k = meta["n_context"], meta["n_neighbors"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return lists_of_tile(left, right.rename(columns=lambda c: c.removeprefix("_r_")), n_context, k, amount, by_user)

    schema = f"c {c_type.simpleString()}, i {i_type.simpleString()}, score double"
    return left.groupBy("_c", "_t").cogroup(right.groupBy("_r__cb", "_r__tb")).applyInPandas(run, schema)


def recommend_neighbors(model: Model, users: DataFrame, known: DataFrame | None = None, amount: int = 10, bound: bool = True) -> DataFrame:
    """``user_id, item_id, rating_pred, rank``: the best of all trained items for every user.

    Unknown users get the global mean for all items, so ids decide.
    """
    meta = model.meta
    by_user = meta["axis"] == "item"  # a list per context; else one per target
    entity, context = _sides(meta["axis"])
    ratings, stats = model.tables["ratings"], model.tables["stats"]
    spark = ratings.sparkSession
    wanted = users.select("user_id").filter(F.col("user_id").isNotNull()).distinct()
    trained = ratings.select("user_id").distinct()
    asked = cut_lineage(wanted.join(trained, "user_id", "left_semi"))
    n_asked = asked.count()
    targets = stats.select(F.col("id").alias("i"), F.col("mean").alias("m"), F.col("norm2").alias("q"))
    rows = ratings
    if by_user:
        rows = ratings.join(broadcast_if_small(asked, n_asked, 32), "user_id", "left_semi")
    else:
        targets = targets.join(broadcast_if_small(asked.select(F.col("user_id").alias("i")), n_asked, 32), "i", "left_semi")
    rows = rows.select(F.col(context).alias("c"), F.col(entity).alias("j"), "rating")
    lengths = cut_lineage(rows.groupBy("c").agg(F.count_if(F.col("rating") > 0).alias("n")))
    n_rated = lengths.filter(F.col("n") <= LONGEST).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    longer = [r["c"] for r in lengths.filter(F.col("n") > LONGEST).select("c").collect()]  # one in LONGEST ratings at most
    n_entities = meta["n_items"] if by_user else meta["n_users"]
    whole = ratings.filter(F.col("rating") != 0).groupBy(context).agg(F.count(F.lit(1)).alias("n"))
    longest, most = whole.agg(F.max("n"), F.sum(F.col("n") * F.col("n"))).first()
    wanted_targets = None if by_user else n_asked
    lists = _from_products if longer or (longest or 0) > histories.LONGEST else _from_histories
    found = lists(model, rows, lengths, targets, known, amount, n_rated, most or 0, wanted_targets)
    found = found.select(F.col("c").alias(context), F.col("i").alias(entity), "score").select("user_id", "item_id", "score")
    if longer:
        spelt = targets.select(F.col("i").alias(entity), F.explode(F.array(*[F.lit(c).cast(rows.schema["c"].dataType) for c in longer])).alias(context))
        if known is not None:
            spelt = spelt.join(known.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
        scored = predict_neighbors(model, spelt.select("user_id", "item_id"), bound=False)
        found = found.unionByName(scored.select("user_id", "item_id", F.col("rating_pred").alias("score")))
    strangers = wanted.join(trained, "user_id", "left_anti")
    scores = ratings.select("item_id").distinct().withColumn("score", F.lit(float(meta["global_mean"] or 0.0)))
    if not strangers.isEmpty():
        found = found.unionByName(first_unknown_items(strangers, scores, known, amount).select("user_id", "item_id", "score"))
    best = top_k(found, ["user_id"], [F.desc(stable("score")), F.asc("item_id")], amount)
    return best.select("user_id", "item_id", model.bounded(F.col("score"), bound).alias("rating_pred"), "rank")

"""Kernel matrix factorization by stratified block SGD.

Users and items are hashed to B blocks each. Stratum s pairs user block b with item block
(b + s) mod B: the pairs of a stratum share no user and no item, so B tasks can update their
parameters at the same time without conflict (Gemulla et al., KDD 2011). An epoch is B strata.
A user or item with very many ratings has them spread over the B cells of its block row.

The number of strata follows the items only. User blocks that are too large for one task are cut
into lanes: every lane steps its own users and a copy of the item block, and the copies are
averaged by their number of ratings after the stratum (parallel SGD, Zinkevich et al. 2010). So a
stratum runs B x lanes tasks, however many users there are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from ..contracts import training_ratings
from ..functions.kernels import KERNELS, dot, kernel_score
from ..functions.text import col, hash_bucket, hash_order
from ..session import broadcast_if_small, cut_lineage, fits_broadcast
from . import longfold
from .bias import grid_block, grid_blocks, grid_cell, replace_users
from .filters import known_only
from .model import Model, attach_params
from .search import search_topk

CELL_RATINGS = 500_000
BLOCK_BYTES = 64 * 1024 * 1024
#: Pairs of one numpy step of a prediction in cells.
SCORED_AT_ONCE = 100_000


def random_normals(key: Column | str, n: int, mean: float, sd: float, seed: int) -> Column:
    """n normal deviates that depend only on the key and the seed (Box-Muller over hashes)."""

    def uniform(i: Column, salt: int) -> Column:
        return (F.pmod(F.xxhash64(col(key), i, F.lit(seed), F.lit(salt)), F.lit(2**31)) + 0.5) / float(2**31)

    return F.transform(
        F.sequence(F.lit(1), F.lit(n)),
        lambda i: F.lit(float(mean))
        + F.lit(float(sd)) * F.sqrt(-2.0 * F.log(uniform(i, 1))) * F.cos(F.lit(2 * math.pi) * uniform(i, 2)),
    )


def _gradient(meta: dict, r, bu, bi, p, q):
    """Prediction error terms per rating: (bias gradient, user gradient, item gradient), without reg."""
    low, span = meta["min_rating"], meta["max_rating"] - meta["min_rating"]
    if meta["kernel"] == "rbf":
        near = np.exp(-meta["gamma"] * np.square(p - q).sum(axis=1))
        pull = ((low + span * near - r) * 2 * near * meta["gamma"])[:, None]
        return None, pull * (q - p), pull * (p - q)
    linear = meta["global_mean"] + bu + bi + np.einsum("ij,ij->i", p, q)
    if meta["kernel"] == "linear":
        error = linear - r
    else:
        s = 1 / (1 + np.exp(-linear))
        error = (low + span * s - r) * s * (1 - s)
    return error, error[:, None] * q, error[:, None] * p


def _sgd_pass(meta: dict, users, items, ratings, bu, bi, P, Q) -> None:
    """One pass over a cell in mini batches, in place.

    When a user or item occurs c times in a batch its summed step is damped to what c single
    steps of the same size would reach, so long histories stay stable.
    """
    lr, reg = meta["lr"], meta["reg"]
    size = 256
    for at in range(0, len(ratings), size):
        u, i, r = users[at : at + size], items[at : at + size], ratings[at : at + size]
        p, q = P[u], Q[i]
        error, gp, gq = _gradient(meta, r, bu[u], bi[i], p, q)
        for ids, factors, grad, own, bias in ((u, P, gp, p, bu), (i, Q, gq, q, bi)):
            unique, inverse, c = np.unique(ids, return_inverse=True, return_counts=True)
            damp = lr * ((1 - (1 - lr) ** c) / (lr * c))[inverse] if lr > 0 else np.zeros(len(ids))
            np.subtract.at(factors, ids, damp[:, None] * (grad + reg * own))
            if error is not None:
                np.subtract.at(bias, ids, damp * (error + reg * bias[ids]))


def _place(seed: str, *columns: str) -> Column:
    """The first 60 bits of the hash order: they sort as the hash does, in a quarter of its bytes."""
    return F.conv(F.substring(hash_order(seed, *columns), 1, 15), 16, 10).cast("long")


def _stratum(cells: DataFrame, params: DataFrame, s: int, blocks: int, lanes: int, meta: dict, seed: int) -> DataFrame:
    names = [c for c in params.columns if c != "n"]

    def run(ratings: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame({name: [] for name in [*names, "n"]})
        if not len(ratings):
            return block[names].assign(n=0)
        side = block["user_id"].notna().to_numpy()
        users, items = block[side], block[~side]
        bu, bi = users["bias"].to_numpy(copy=True), items["bias"].to_numpy(copy=True)
        P = np.array(users["factors"].tolist(), dtype=np.float64)
        Q = np.array(items["factors"].tolist(), dtype=np.float64)
        ratings = ratings.sort_values(["_h", "_u", "_i"])
        u = pd.Index(users["user_id"].astype(ratings["_u"].dtype)).get_indexer(ratings["_u"])
        i = pd.Index(items["item_id"].astype(ratings["_i"].dtype)).get_indexer(ratings["_i"])
        _sgd_pass(meta, u, i, ratings["_r"].to_numpy(), bu, bi, P, Q)
        users = users.assign(bias=bu, factors=list(P), n=0)
        items = items.assign(bias=bi, factors=list(Q), n=np.bincount(i, minlength=len(items)))
        return pd.concat([users, items], ignore_index=True)[[*names, "n"]]

    left = cells.filter(F.pmod(F.col("_ub") + s, F.lit(blocks)) == F.col("_ib"))
    # own names for the rating columns: both sides of the cogroup stem from the same table
    left = left.select(
        F.col("_ub").alias("_cell"), F.col("_lane").alias("_l"), F.col("user_id").alias("_u"),
        F.col("item_id").alias("_i"), F.col("rating").alias("_r"),
        _place(f"{seed}", "user_id", "item_id").alias("_h"),
    )
    is_user = F.col("user_id").isNotNull()
    key = F.when(is_user, F.col("block")).otherwise(F.pmod(F.col("block") - s, F.lit(blocks)))
    lane = F.when(is_user, F.array("lane")).otherwise(F.sequence(F.lit(0), F.lit(lanes - 1)))
    right = params.select(*names, key.alias("_key"), F.explode(lane).alias("_to"))
    schema = f"{params.select(*names).schema.simpleString()[7:-1]}, n long"
    stepped = left.groupBy("_cell", "_l").cogroup(right.groupBy("_key", "_to")).applyInPandas(run, schema)
    if lanes == 1:
        return stepped
    stepped = cut_lineage(stepped)  # read twice below
    items = stepped.filter(F.col("item_id").isNotNull())
    # a copy without ratings of the item says nothing, unless no copy has any
    weight = F.greatest(F.col("n").cast("double"), F.lit(1e-9))
    averaged = (
        items.select("item_id", "block", weight.alias("_w"), array_to_vector(F.concat(F.array("bias"), "factors")).alias("_v"))
        .groupBy("item_id", "block")
        .agg(Summarizer.mean(F.col("_v"), F.col("_w")).alias("_m"))
        .select("item_id", "block", vector_to_array("_m").alias("_a"))
    )
    averaged = averaged.select(
        F.lit(None).cast(params.schema["user_id"].dataType).alias("user_id"), "item_id", F.col("_a")[0].alias("bias"),
        F.slice("_a", 2, meta["n_factors"]).alias("factors"), "block", F.lit(0).alias("lane"), F.lit(0).cast("long").alias("n"),
    )
    return stepped.filter(F.col("user_id").isNotNull()).unionByName(averaged)


def fit_factors(
    ratings: DataFrame,
    kernel: str = "linear",
    n_factors: int = 100,
    n_epochs: int = 100,
    lr: float = 0.01,
    reg: float = 1.0,
    gamma: float | str = "auto",
    init_mean: float = 0.0,
    init_sd: float = 0.1,
    min_rating: float = 0,
    max_rating: float = 5,
    seed: int = 42,
    track_rmse: bool = False,
    lanes: int = 1,
) -> Model:
    """Biases and factor vectors for one of the kernels linear, sigmoid and rbf.

    ``lanes`` above 1 splits the users of every block and averages the item blocks after each
    stratum (parameter averaging). It is a choice of method, so it never follows from the size of
    the data; it is kept in ``meta``.
    """
    if kernel not in KERNELS:
        raise ValueError(f"kernel must be one of {KERNELS}")
    rows = training_ratings(ratings)
    mean, n, n_users, n_items = rows.agg(
        F.avg("rating"), F.count(F.lit(1)), F.countDistinct("user_id"), F.countDistinct("item_id")
    ).first()
    meta = {
        "kernel": kernel, "n_factors": n_factors, "lr": lr, "reg": reg, "init_mean": init_mean, "init_sd": init_sd,
        "gamma": 1.0 / n_factors if gamma == "auto" else float(gamma), "global_mean": mean, "seed": seed,
        "n_users": n_users, "n_items": n_items, "min_rating": min_rating, "max_rating": max_rating, "lanes": lanes,
    }
    per_block = max(1, BLOCK_BYTES // (8 * (n_factors + 4)))
    blocks = max(4, math.ceil(n_items / per_block), math.ceil(n_users / (lanes * per_block)), math.ceil(math.sqrt(n / (lanes * CELL_RATINGS))))
    cells = rows.withColumns(
        {
            "_ub": hash_bucket("u", blocks, "user_id"), "_ib": hash_bucket("i", blocks, "item_id"),
            "_lane": hash_bucket("lane", lanes, "user_id"),
        }
    ).persist()

    def start(key: str, other: str, salt: int) -> DataFrame:
        other_type = rows.schema[other].dataType
        return rows.select(key).distinct().select(
            F.col(key), F.lit(None).cast(other_type).alias(other), F.lit(0.0).alias("bias"),
            random_normals(key, n_factors, init_mean, init_sd, seed + salt).alias("factors"),
            hash_bucket("u" if key == "user_id" else "i", blocks, key).alias("block"),
            (hash_bucket("lane", lanes, key) if key == "user_id" else F.lit(0)).alias("lane"),
        )

    params = cut_lineage(start("user_id", "item_id", 0).unionByName(start("item_id", "user_id", 1)))
    history = []
    try:
        for epoch in range(1, n_epochs + 1):
            for s in range(blocks):
                params = _stratum(cells, params, s, blocks, lanes, meta, seed + epoch)
            params = cut_lineage(params)
            if track_rmse or epoch == n_epochs:
                model = _as_model(params, meta)
                error = F.pow(F.col("rating") - F.col("rating_pred"), 2)
                scored = predict_factors(model, cells.select("user_id", "item_id", "rating"), bound=False)
                history.append((epoch, scored.agg(F.sqrt(F.avg(error))).first()[0]))
    finally:
        cells.unpersist()
    return _as_model(params, meta, history)


def _as_model(params: DataFrame, meta: dict, history=()) -> Model:
    tables = {
        "users": params.filter(F.col("user_id").isNotNull()).select("user_id", "bias", "factors"),
        "items": params.filter(F.col("item_id").isNotNull()).select("item_id", "bias", "factors"),
    }
    return Model("kernel_mf", tables, meta, list(history))


def _score(meta: dict, bu, bi, p, q):
    """The unbounded prediction as ``kernel_score`` gives it, for arrays."""
    low, span = float(meta["min_rating"]), float(meta["max_rating"] - meta["min_rating"])
    if meta["kernel"] == "rbf":
        return low + span * np.exp(-meta["gamma"] * np.square(p - q).sum(axis=1))
    linear = float(meta["global_mean"]) + bu + bi + np.einsum("ij,ij->i", p, q)
    return linear if meta["kernel"] == "linear" else low + span / (1 + np.exp(-linear))


def _taken(values, at):
    """The rows of ``values`` at these places, zeros for a place behind the last."""
    out, known = np.zeros((len(at), *values.shape[1:])), at < len(values)
    out[known] = values[at[known]]
    return out


def _predict_in_cells(model: Model, pairs: DataFrame, blocks: int) -> DataFrame:
    """Adds ``_score`` and ``_possible``. The pairs go to a grid of user and item blocks as they are, and parameters to the
    cells of their block, so no vector is sent once per pair."""
    meta, n = model.meta, model.meta["n_factors"]
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_every")

    def side(params: DataFrame, key: str, other: str) -> DataFrame:
        copies = params.filter(F.col(key).isNotNull()).select(key, "bias", "factors", grid_block(key, blocks).alias("_block"), every)
        grid = ("_block", "_every") if key == "user_id" else ("_every", "_block")
        none = F.lit(None).cast(pairs.schema[other].dataType).alias(other)
        cell = grid_cell(*[F.col(c) for c in grid], blocks)
        return copies.select(key, none, "bias", "factors", cell)

    params = side(model.users(), "user_id", "item_id").unionByName(side(model.items(), "item_id", "user_id"))
    cell = grid_cell(grid_block("user_id", blocks), grid_block("item_id", blocks), blocks)

    def run(rows: pa.Table, params: pa.Table) -> pa.Table:
        rows = rows.select(names)
        found, places, biases, vectors = [], [], [], []
        for key in ("user_id", "item_id"):
            mine = params.filter(pc.is_valid(params[key]))
            at = pc.index_in(rows[key], value_set=mine[key].combine_chunks(), skip_nulls=True)
            found.append(pc.is_valid(at))
            # an unknown id is given the place behind all others
            places.append(pc.fill_null(at, len(mine)).to_numpy())
            biases.append(mine["bias"].to_numpy())
            vectors.append(mine["factors"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(mine), n))
        score = np.empty(len(rows))
        for start in range(0, len(rows), SCORED_AT_ONCE):
            u, i = (x[start : start + SCORED_AT_ONCE] for x in places)
            bu, bi, p, q = _taken(biases[0], u), _taken(biases[1], i), _taken(vectors[0], u), _taken(vectors[1], i)
            score[start : start + len(u)] = _score(meta, bu, bi, p, q)
        return rows.append_column("_score", pa.array(score)).append_column("_possible", pc.and_(*found))

    names = pairs.columns
    # a schema of its own: add() would change the one that the caller's table keeps
    schema = StructType([*pairs.schema.fields, StructField("_score", DoubleType()), StructField("_possible", BooleanType())])
    left = pairs.select("*", cell)
    return left.groupBy("_cell").cogroup(params.groupBy("_cell")).applyInArrow(run, schema)


def _prediction_blocks(model: Model, pairs: DataFrame) -> int:
    """Blocks of the grid where pairs are predicted in cells: both sides too large to be broadcast, and many pairs."""
    width, meta = 32 + 8 * model.meta["n_factors"], model.meta
    if any(fits_broadcast(pairs.sparkSession, meta[size], width) for size in ("n_users", "n_items")):
        return 0
    if any(t.schema[key].dataType != pairs.schema[key].dataType for t, key in ((model.users(), "user_id"), (model.items(), "item_id"))):
        return 0
    blocks = grid_blocks(pairs.count())
    return blocks and max(blocks, math.ceil(max(meta["n_users"], meta["n_items"]) * width / (2 * BLOCK_BYTES)))


def predict_factors(model: Model, pairs: DataFrame, bound: bool = True) -> DataFrame:
    """An unknown id has bias 0 and a zero vector; what that predicts depends on the kernel."""
    meta = model.meta
    blocks = _prediction_blocks(model, pairs)
    if blocks:
        rows = _predict_in_cells(model, pairs, blocks)
        score, possible = F.col("_score"), F.col("_possible")
    else:
        rows = attach_params(pairs, model, {"bias": "_bu", "factors": "_p"}, {"bias": "_bi", "factors": "_q"})
        zeros = F.array_repeat(F.lit(0.0), meta["n_factors"])
        score = kernel_score(
            meta["kernel"], meta["global_mean"], F.coalesce("_bu", F.lit(0.0)), F.coalesce("_bi", F.lit(0.0)),
            F.coalesce("_p", zeros), F.coalesce("_q", zeros), meta["gamma"], *model.bounds(),
        )
        possible = F.col("user_known") & F.col("item_known")
    return (
        rows.withColumn("rating_pred", model.bounded(score, bound))
        .withColumn("prediction_possible", possible)
        .select(*pairs.columns, "rating_pred", "prediction_possible")
    )


def recommend_factors(
    model: Model, users: DataFrame, known: DataFrame | None = None, amount: int = 10, bound: bool = True
) -> DataFrame:
    """Top-N for a table of users as one maximum inner product search.

    All kernels rank items by an inner product: linear and sigmoid by p.q + b, RBF by 2 p.q - |q|^2.
    """
    meta = model.meta
    zeros = F.array_repeat(F.lit(0.0), meta["n_factors"])
    asked = users.select("user_id").distinct().join(model.users(), "user_id", "left").select(
        "user_id", F.coalesce("bias", F.lit(0.0)).alias("_bu"), F.coalesce("factors", zeros).alias("_p")
    )
    if meta["kernel"] == "rbf":
        query = F.concat(F.transform("_p", lambda x: 2.0 * x), F.array(F.lit(-1.0)))
        item = F.concat("factors", F.array(dot("factors", "factors")))
    else:
        query = F.concat("_p", F.array(F.lit(1.0)))
        item = F.concat("factors", F.array(F.col("bias")))
    queries = asked.select(F.col("user_id").alias("query_id"), query.alias("vec"))
    items = model.items().select("item_id", item.alias("vec"))
    skip = None if known is None else known.select(F.col("user_id").alias("query_id"), "item_id")
    found = search_topk(queries, items, amount, "dense", exclude=skip).withColumnRenamed("query_id", "user_id")
    found = found.join(broadcast_if_small(asked, meta["n_users"], 32 + 8 * meta["n_factors"]), "user_id")
    low, high = model.bounds()
    linear = F.lit(float(meta["global_mean"])) + F.col("_bu") + F.col("sim")
    if meta["kernel"] == "linear":
        score = linear
    elif meta["kernel"] == "sigmoid":
        score = F.lit(low) + F.lit(high - low) / (1.0 + F.exp(-linear))
    else:
        score = F.lit(low) + F.lit(high - low) * F.exp(F.lit(-meta["gamma"]) * (dot("_p", "_p") - F.col("sim")))
    return found.select("user_id", "item_id", model.bounded(score, bound).alias("rating_pred"), "rank")


def update_factor_users(
    model: Model, ratings: DataFrame, lr: float = 0.01, n_epochs: int = 20, seed: int = 42, chunk: int | None = None,
    method: str = "sgd", part: int = longfold.PART,
) -> Model:
    """Fit the users in ``ratings`` from a fresh start, items frozen; see ``fold_factor_users``."""
    updated = replace_users(model, fold_factor_users(model, ratings, lr, n_epochs, seed, chunk, method, part))
    updated.meta.update(fold_chunk=chunk, fold_method=method)
    return updated


def fold_factor_users(
    model: Model, ratings: DataFrame, lr: float = 0.01, n_epochs: int = 20, seed: int = 42, chunk: int | None = None,
    method: str = "sgd", part: int = longfold.PART,
) -> DataFrame:
    """New ``user_id, bias, factors`` of the users in ``ratings``, items frozen; unknown items are dropped.

    ``sgd``: given the items, users do not depend on each other. Each runs plain SGD over its ratings, in
    an order that follows from the seed, the epoch and the user's own ratings, whoever else is in
    the batch; a task steps many users at once, one rating per user and round. A history is one
    row of (factors + 2) doubles per rating. ``chunk`` asks for histories to be cut into parts of
    about that many ratings, whose parameters are averaged by their number of ratings (parallel
    SGD, Zinkevich et al. 2010); it is another method, so only the caller chooses it.

    ``expected``: the expected value of the same steps in closed form, from sums over the history
    (``longfold``). For the linear kernel only. No order, no row that grows with the history, and
    more than ``part`` ratings of a user are added up by several tasks.
    """
    if method not in ("sgd", "expected"):
        raise ValueError("method must be sgd or expected")
    meta = dict(model.meta, lr=lr)
    start = random_normals("user_id", meta["n_factors"], meta["init_mean"], meta["init_sd"], seed)
    rows = known_only(training_ratings(ratings), model.items(), "item_id")
    if method == "expected":
        if meta["kernel"] != "linear" or chunk is not None:
            raise ValueError("the expected pass needs the linear kernel and no chunk")
        return longfold.fold_by_sums(rows, model.items(), meta["n_items"], meta, start, lr, n_epochs, part)
    fixed = broadcast_if_small(
        model.items().select("item_id", "bias", "factors"), meta["n_items"], 32 + 8 * meta["n_factors"]
    )
    if chunk is None:
        rows = rows.withColumn("_c", F.lit(0))
    else:
        lengths = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
        rows = rows.join(lengths, "user_id").withColumn("_c", F.pmod(F.xxhash64("item_id"), F.ceil(F.col("_n") / chunk)))
    chunks = (
        rows.join(fixed, "item_id")
        .groupBy("user_id", "_c")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        hash_order(seed, "user_id", "item_id").alias("h"), F.col("rating").alias("r"),
                        F.col("bias").alias("b"), F.col("factors").alias("q"),
                    )
                )
            ).alias("v")
        )
    )
    chunks = chunks.select(
        "user_id", F.transform("v", lambda x: x["r"]).alias("r"), F.transform("v", lambda x: x["b"]).alias("b"),
        F.flatten(F.transform("v", lambda x: x["q"])).alias("q"), start.alias("start"),
    )
    id_type = model.users().schema["user_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            yield _fold_users(meta, batch, n_epochs, seed)

    fitted = chunks.mapInPandas(run, f"user_id {id_type}, n long, bias double, factors array<double>")
    if chunk is None:
        return fitted.select("user_id", "bias", "factors")
    parts = fitted.select(
        "user_id", "n", (F.col("bias") * F.col("n")).alias("b"), F.posexplode("factors").alias("f", "x")
    )
    per_factor = parts.groupBy("user_id", "f").agg(
        F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum(F.col("x") * F.col("n")).alias("x")
    )
    return per_factor.groupBy("user_id").agg(
        F.max(F.col("b") / F.col("n")).alias("bias"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("f", (F.col("x") / F.col("n")).alias("v")))), lambda y: y["v"]
        ).alias("factors"),
    )


def _fold_users(meta: dict, batch: pd.DataFrame, n_epochs: int, seed: int) -> pd.DataFrame:
    lengths = np.array([len(x) for x in batch["r"]])
    P = np.array(batch["start"].tolist(), dtype=np.float64)
    bu = np.zeros(len(batch))
    user = np.repeat(np.arange(len(batch)), lengths)
    place = np.concatenate([np.arange(n) for n in lengths])
    r = np.concatenate(batch["r"].tolist())
    bi = np.concatenate(batch["b"].tolist())
    Q = np.concatenate(batch["q"].tolist()).reshape(len(r), -1)
    rounds = [np.flatnonzero(place == t) for t in range(lengths.max())]
    for epoch in range(n_epochs):
        # places are drawn one after the other, so a longer history in the batch adds places and moves none
        for t in np.argsort(np.random.default_rng([seed, epoch]).random(len(rounds)), kind="stable"):
            at = rounds[t]
            u = user[at]
            error, gp, _ = _gradient(meta, r[at], bu[u], bi[at], P[u], Q[at])
            if error is not None:
                bu[u] -= meta["lr"] * (error + meta["reg"] * bu[u])
            P[u] -= meta["lr"] * (gp + meta["reg"] * P[u])
    return pd.DataFrame({"user_id": batch["user_id"], "n": lengths, "bias": bu, "factors": list(P)})


def fit_linear_als(ratings: DataFrame, n_factors: int = 20, n_epochs: int = 10, reg: float = 0.1, seed: int = 42, **bounds) -> Model:
    """Linear kernel by least squares: bias model first, ``ml.recommendation.ALS`` on the rest.

    ALS wants integer ids, which StringIndexer-free hashing cannot give without clashes, so the
    ids are numbered by the distributed ranking.
    """
    from pyspark.ml.recommendation import ALS

    from .bias import fit_bias, predict_bias
    from .ranking import rank_rows

    base = fit_bias(ratings, "als", n_epochs, 1.0, **bounds)
    number = lambda params, key: rank_rows(params.select(key), [], [F.asc(key)], f"_{key}").withColumn(
        f"_{key}", F.col(f"_{key}").cast("int")
    )
    users, items = number(base.users(), "user_id"), number(base.items(), "item_id")
    # the numbers come with the biases, so a rating is joined once per side
    sides = {
        "users": cut_lineage(base.users().join(users, "user_id")), "items": cut_lineage(base.items().join(items, "item_id")),
    }
    numbers = {"users": ["_user_id"], "items": ["_item_id"]}
    rest = predict_bias(Model(base.kind, sides, base.meta), training_ratings(ratings), bound=False, also=numbers)
    rest = rest.filter(F.col("_user_id").isNotNull() & F.col("_item_id").isNotNull())
    rest = rest.select("_user_id", "_item_id", (F.col("rating") - F.col("rating_pred")).cast("float").alias("_rest"))
    rest = rest.persist()  # ALS reads its input twice
    try:
        fitted = ALS(
            rank=n_factors, maxIter=n_epochs, regParam=reg, seed=seed, userCol="_user_id", itemCol="_item_id",
            ratingCol="_rest", coldStartStrategy="nan", checkpointInterval=5,
        ).fit(rest)
    finally:
        rest.unpersist()

    def side(params, factors, key):
        zeros = F.array_repeat(F.lit(0.0), n_factors)
        vectors = factors.select(F.col("id").alias(f"_{key}"), F.col("features").cast("array<double>").alias("factors"))
        return cut_lineage(params.join(vectors, f"_{key}", "left").select(key, "bias", F.coalesce("factors", zeros).alias("factors")))

    meta = dict(
        base.meta, kernel="linear", n_factors=n_factors, gamma=1.0 / n_factors, lr=0.01, reg=reg, seed=seed,
        init_mean=0.0, init_sd=0.1,
    )
    tables = {
        "users": side(sides["users"], fitted.userFactors, "user_id"),
        "items": side(sides["items"], fitted.itemFactors, "item_id"),
    }
    return Model("kernel_mf", tables, meta, base.history)

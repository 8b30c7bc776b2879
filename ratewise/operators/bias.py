"""Rating = mean + user bias + item bias, fitted by alternating aggregations."""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import training_ratings
from ..session import broadcast_if_small, cut_lineage, fits_broadcast
from .filters import known_only
from .model import Model, attach_params

#: From this many ratings on a fit lays them out in BLOCKS x BLOCKS cells, more where a cell would hold over CELL_RATINGS.
LAID_OUT = 1_000_000
BLOCKS = 8
CELL_RATINGS = 4_000_000


def _new_bias(method: str, reg: float, lr: float):
    """Bias from the residual count ``n`` and sum ``s`` of one user or item.

    ``als``: the ridge solution s / (reg + n). ``sgd``: one pass of updates
    ``b += lr * (t - (1 + reg) * b)`` over n targets t in random order has the expectation
    ``a^n * b + (1 - a^n) / (1 + reg) * mean(t)`` with ``a = 1 - lr * (1 + reg)``; it needs no
    order, and unlike a summed gradient step it cannot diverge for long histories.
    """
    if method == "als":
        return F.col("s") / (F.lit(float(reg)) + F.col("n"))
    decay = F.pow(F.lit(1.0 - lr * (1.0 + reg)), F.col("n"))
    return decay * F.col("old") + (1.0 - decay) / F.lit(1.0 + reg) * F.col("s") / F.col("n")


def grid_blocks(n_ratings: int) -> int:
    """Blocks per side of the grid, 0 for so few ratings that none is laid out."""
    return 0 if n_ratings < LAID_OUT else max(BLOCKS, math.ceil(math.sqrt(n_ratings / CELL_RATINGS)))


def grid_block(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def grid_cell(users, items, blocks: int) -> Column:
    return (users * F.lit(blocks) + items).alias("_cell")


def _lay_out(targets: DataFrame, blocks: int) -> DataFrame:
    """The targets by cell of a grid of user and item blocks: a user or item is in ``blocks`` cells at most.

    So each sends that many partial sums, however many tasks there are, and a hot one is spread over as many cells.
    """
    parts = max(blocks * blocks, int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cell = grid_cell(grid_block("user_id", blocks), grid_block("item_id", blocks), blocks)
    return targets.select("user_id", "item_id", "t", cell).repartition(parts, "_cell").sortWithinPartitions("_cell")


def _cell_sums(targets: DataFrame, own: str, other: str, fixed: DataFrame, blocks: int) -> DataFrame:
    """``own, n, s, ss`` per cell: the other side's biases go to the cells, the ratings stay where they are."""
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_every")
    copies = fixed.filter(F.col(other).isNotNull()).select(other, "_b", grid_block(other, blocks).alias("_block"), every)
    grid = ("_block", "_every") if other == "user_id" else ("_every", "_block")
    copies = copies.select(other, "_b", grid_cell(*[F.col(c) for c in grid], blocks))

    def run(ratings: pa.Table, biases: pa.Table) -> pa.Table:
        at = pc.index_in(ratings[other], value_set=biases[other].combine_chunks(), skip_nulls=True)
        rest = pc.subtract(ratings["t"], biases["_b"].take(at))
        rows = pa.table({own: ratings[own], "s": rest, "ss": pc.multiply(rest, rest)}).filter(pc.is_valid(at))
        sums = rows.group_by(own, use_threads=False).aggregate([("s", "count"), ("s", "sum"), ("ss", "sum")])
        return sums.select([own, "s_count", "s_sum", "ss_sum"]).rename_columns([own, "n", "s", "ss"])

    schema = f"{own} {targets.schema[own].dataType.simpleString()}, n long, s double, ss double"
    return targets.groupBy("_cell").cogroup(copies.groupBy("_cell")).applyInArrow(run, schema)


def _half_epoch(
    targets: DataFrame, own: str, other: str, own_params, other_params, sizes, step, blocks: int = 0, error: bool = True
) -> DataFrame:
    """New biases of one side with the other side fixed; ``error`` adds the squared error after the step."""
    rows = targets
    residual = F.col("t")
    fixed = None if other_params is None else other_params.select(other, F.col("bias").alias("_b"))
    if fixed is not None and blocks and not fits_broadcast(targets.sparkSession, sizes[other], 32):
        parts = _cell_sums(targets, own, other, fixed, blocks)
        wanted = [F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")]
    else:
        if fixed is not None:
            rows = rows.join(broadcast_if_small(fixed, sizes[other], 32), other)
            residual = F.col("t") - F.col("_b")
        parts = rows
        wanted = [F.count(F.lit(1)).alias("n"), F.sum(residual).alias("s"), F.sum(residual * residual).alias("ss")]
    sums = parts.groupBy(own).agg(*(wanted if error else wanted[:2]))
    if own_params is not None:
        old = own_params.select(own, F.col("bias").alias("old"))
        sums = sums.join(broadcast_if_small(old, sizes[own], 32), own, "left")
    else:
        sums = sums.withColumn("old", F.lit(0.0))
    out = sums.withColumn("bias", step)
    if not error:
        return out.select(own, "bias")
    # sum (t - b)^2 = ss - 2 b s + n b^2, so the training error costs no further pass
    sse = F.col("ss") - 2 * F.col("bias") * F.col("s") + F.col("n") * F.col("bias") * F.col("bias")
    return out.select(own, "bias", sse.alias("sse"))


def fit_bias(
    ratings: DataFrame,
    method: str = "sgd",
    n_epochs: int = 100,
    reg: float = 1.0,
    lr: float = 0.01,
    min_rating: float = 0,
    max_rating: float = 5,
    checkpoint_every: int = 1,
) -> Model:
    """Fit biases. Each half epoch is one join with the other side's biases and one aggregation.

    While a side's biases fit the broadcast bound the ratings are not shuffled, only partial
    sums are. From ``LAID_OUT`` ratings on they are shuffled once into cells, so that partial sums are few; beyond
    the bound biases are sent to the cells then. With fewer ratings it is a shuffle join. Lineage is cut
    every ``checkpoint_every`` epochs and at the end; the training error is recorded there. An
    ``sgd`` step reads both sides of the epoch before, so its plan would double with every
    epoch: it is cut after each half epoch.
    """
    if method not in ("sgd", "als"):
        raise ValueError("method must be 'sgd' or 'als'")
    rows = training_ratings(ratings)
    own = rows.storageLevel == StorageLevel.NONE  # another fit may hold the same rows: leave them to it
    if own:
        rows.persist()
    cells = None
    try:
        mean, n_ratings = rows.agg(F.avg("rating"), F.count(F.lit(1))).first()
        targets = rows.select("user_id", "item_id", (F.col("rating") - F.lit(mean)).alias("t"))
        blocks = grid_blocks(n_ratings)
        if blocks:
            targets = cells = _lay_out(targets, blocks).persist()
            cells.count()
            if own:
                rows.unpersist()
        # first step: users against items without bias, so each side's size is known in time
        sizes: dict[str, int] = {}
        step = _new_bias(method, reg, lr)
        users = items = None
        history = []
        sgd = method == "sgd"
        for epoch in range(1, n_epochs + 1):
            users = _half_epoch(targets, "user_id", "item_id", users if sgd else None, items, sizes, step, blocks, False)
            cut = sgd or epoch in (1, n_epochs) or epoch % checkpoint_every == 0
            if cut:
                users = cut_lineage(users)
            if epoch == 1:
                sizes["user_id"] = n_users = users.count()
            items = _half_epoch(targets, "item_id", "user_id", items if sgd else None, users, sizes, step, blocks)
            if cut:
                items = cut_lineage(items)
                sse = items.agg(F.sum("sse")).first()[0]
                history.append((epoch, (max(sse, 0.0) / n_ratings) ** 0.5))
            if epoch == 1:
                sizes["item_id"] = n_items = items.count()
    finally:
        if cells is not None:
            cells.unpersist()
        if own:
            rows.unpersist()
    meta = {
        "global_mean": mean, "n_users": n_users, "n_items": n_items, "reg": reg, "method": method,
        "min_rating": min_rating, "max_rating": max_rating,
    }
    return Model("bias", {"users": users.select("user_id", "bias"), "items": items.select("item_id", "bias")}, meta, history)


def predict_bias(model: Model, pairs: DataFrame, bound: bool = True, also: dict | None = None) -> DataFrame:
    """Adds ``rating_pred`` and ``prediction_possible``; an unknown id contributes no bias.

    ``also`` names further parameter columns per side that the rows shall get, ``{"users": [...], "items": [...]}``.
    """
    also = also or {}
    extra = {side: {c: c for c in also.get(side, [])} for side in ("users", "items")}
    rows = attach_params(pairs, model, {"bias": "_bu"} | extra["users"], {"bias": "_bi"} | extra["items"])
    score = (
        F.lit(float(model.meta["global_mean"]))
        + F.coalesce("_bu", F.lit(0.0))
        + F.coalesce("_bi", F.lit(0.0))
    )
    return (
        rows.withColumn("rating_pred", model.bounded(score, bound))
        .withColumn("prediction_possible", F.col("user_known") & F.col("item_known"))
        .select(*pairs.columns, "rating_pred", "prediction_possible", *extra["users"], *extra["items"])
    )


def update_bias_users(model: Model, ratings: DataFrame, lr: float = 0.01, n_epochs: int = 20) -> Model:
    """Fit the users in ``ratings`` anew, items frozen; all their ratings must be passed."""
    return replace_users(model, fold_bias_users(model, ratings, lr, n_epochs))


def fold_bias_users(model: Model, ratings: DataFrame, lr: float = 0.01, n_epochs: int = 20) -> DataFrame:
    """New ``user_id, bias`` of the users in ``ratings``.

    With fixed items the epochs only repeat the same contraction, so n epochs of the expected
    update collapse into one closed form with exponent ``n_epochs * n``: a single aggregation.
    """
    reg = float(model.meta["reg"])
    rows = known_only(training_ratings(ratings), model.items(), "item_id")
    fixed = broadcast_if_small(model.items().select("item_id", "bias"), model.meta["n_items"], 32)
    residual = F.col("rating") - F.lit(float(model.meta["global_mean"])) - F.col("bias")
    sums = rows.join(fixed, "item_id").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(residual).alias("m")
    )
    decay = F.pow(F.lit(1.0 - lr * (1.0 + reg)), F.col("n") * n_epochs)
    return sums.select("user_id", ((1.0 - decay) / F.lit(1.0 + reg) * F.col("m")).alias("bias"))


def replace_users(model: Model, fresh: DataFrame) -> Model:
    """Upsert of user parameters: fresh rows win over old ones."""
    fresh = cut_lineage(fresh)
    old = model.users().join(fresh.select("user_id"), "user_id", "left_anti")
    users = cut_lineage(old.unionByName(fresh.select(*old.columns)))
    tables = dict(model.tables, users=users)
    return Model(model.kind, tables, dict(model.meta, n_users=users.count()), model.history)


def fit_global_mean(ratings: DataFrame, min_rating: float = 0, max_rating: float = 5) -> Model:
    """The mean of all ratings for every known pair: a bias model whose biases are 0."""
    rows = training_ratings(ratings)
    mean, n_users, n_items = rows.agg(F.avg("rating"), F.countDistinct("user_id"), F.countDistinct("item_id")).first()
    side = lambda key: cut_lineage(rows.select(key).distinct().withColumn("bias", F.lit(0.0)))
    meta = {"global_mean": mean, "n_users": n_users, "n_items": n_items, "min_rating": min_rating, "max_rating": max_rating}
    return Model("bias", {"users": side("user_id"), "items": side("item_id")}, meta)

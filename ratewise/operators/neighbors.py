"""Neighbourhood models: item-item and user-user cosine on mean-centred, zero-filled ratings.

The dense matrix is never built. With N users, m_i = sum_u r_ui / N (zeros included),

    sim(i, j) = (sum_u r_ui r_uj - N m_i m_j) / sqrt((sum r_i^2 - N m_i^2) (sum r_j^2 - N m_j^2))

so only the products over common raters need work; pairs without a common rater still have the
(negative) similarity given by the formula with product 0. The user-user form swaps the roles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import training_ratings
from ..functions.text import hash_bucket
from ..session import broadcast_if_small, cut_lineage
from . import histories
from .model import Model
from .ranking import stable, top_k
from .similarjoin import nearest_pruned, plain

#: Rows of one (context block, entity block) cell, and products expanded at a time in a task.
CELL_ROWS = 400_000
EXPAND = 4_000_000
#: Longest history that is looked up row by row; longer ones are scored tile by tile.
HEAVY = 2_000
TILE = 1_000
TILE_CONTEXTS = 64


def _sides(axis: str) -> tuple[str, str]:
    """(compared entity, context that two entities share)."""
    if axis == "item":
        return "item_id", "user_id"
    if axis == "user":
        return "user_id", "item_id"
    raise ValueError("axis must be 'item' or 'user'")


def _sum_by_pair(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(inverse, weights=np.concatenate(values), minlength=len(unique))


def _cell_products(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of products for all entity pairs (one from each of the cell's two blocks)."""
    low, high = pdf["_a"].iat[0], pdf["_b"].iat[0]
    left, right = pdf[pdf["_own"] == low], pdf[pdf["_own"] == high]
    empty = pd.DataFrame({"id_a": pdf["e"][:0], "id_b": pdf["e"][:0], "dot": np.zeros(0)})
    if not len(left) or not len(right):
        return empty
    l_code, l_ids = pd.factorize(left["e"], sort=True)
    r_code, r_ids = pd.factorize(right["e"], sort=True)
    context = pd.factorize(pd.concat([left["c"], right["c"]], ignore_index=True))[0]
    l_ctx, r_ctx = context[: len(left)], context[len(left) :]
    order = np.argsort(r_ctx, kind="stable")
    r_code, r_val = r_code[order], right["r"].to_numpy()[order]
    counts = np.bincount(r_ctx, minlength=context.max() + 1)
    starts = np.cumsum(counts) - counts
    l_val = left["r"].to_numpy()
    fan = counts[l_ctx]
    ends = np.cumsum(fan)
    keys, sums = [], []
    at = 0
    while at < len(left):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + EXPAND, side="right")))
        n = fan[at:stop]
        row = np.repeat(np.arange(at, stop), n)
        other = np.arange(len(row)) - np.repeat(ends[at:stop] - n - base, n) + starts[l_ctx[row]]
        key = l_code[row].astype(np.int64) * len(r_ids) + r_code[other]
        product = l_val[row] * r_val[other]
        if low == high:
            upper = l_code[row] < r_code[other]
            key, product = key[upper], product[upper]
        key, total = _sum_by_pair([key], [product])
        keys.append(key)
        sums.append(total)
        at = stop
    key, total = _sum_by_pair(keys, sums)
    return pd.DataFrame(
        {"id_a": np.asarray(l_ids)[key // len(r_ids)], "id_b": np.asarray(r_ids)[key % len(r_ids)], "dot": total}
    )


def common_products(ratings: DataFrame, axis: str = "item") -> DataFrame:
    """``id_a < id_b, dot``: sum of rating products over the common raters of each pair.

    Where every history is an array of bearable length and the ratings fill more than one cell, blocks of
    entities get whole histories and their sums are complete (``histories``). Otherwise the sparse rating matrix is cut into cells (context block x entity block). A task gets the
    cells of two entity blocks for one context block and sums the products before anything is
    shuffled; a rating is sent to one task per entity block instead of to every partner. A hot
    entity is spread over the context blocks and a hot context over the entity blocks, as many as
    the longest context needs.
    """
    entity, context = _sides(axis)
    rows = ratings.filter(F.col("rating") != 0).select(
        F.col(context).alias("c"), F.col(entity).alias("e"), F.col("rating").cast("double").alias("r")
    )
    n, longest = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    n, longest = n or 0, longest or 0
    cells = max(1, -(-n // CELL_ROWS))
    if cells > 1 and longest <= histories.LONGEST:
        return histories.pair_sums(rows, n)
    # a cell's share of the longest context has at most EXPAND products
    blocks = max(4, int(np.ceil(np.sqrt(cells))), int(np.ceil(longest / np.sqrt(EXPAND))))
    context_blocks = max(1, -(-cells // blocks))
    rows = rows.withColumn("_own", hash_bucket("e", blocks, "e"))
    if blocks > 8:
        # send a rating only to blocks that its context touches at all
        touched = rows.groupBy("c").agg(F.collect_set("_own").alias("_partners"))
        rows = rows.join(touched, "c")
        partners = F.col("_partners")
    else:
        partners = F.sequence(F.lit(0), F.lit(blocks - 1))
    rows = (
        rows.withColumn("_c", hash_bucket("c", context_blocks, "c"))
        .withColumn("_p", F.explode(partners))
        .select("c", "e", "r", "_own", "_c", F.least("_own", "_p").alias("_a"), F.greatest("_own", "_p").alias("_b"))
    )
    id_type = rows.schema["e"].dataType.simpleString()
    products = rows.groupBy("_c", "_a", "_b").applyInPandas(
        _cell_products, f"id_a {id_type}, id_b {id_type}, dot double"
    )
    ordered = products.select(
        F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "dot"
    )
    if context_blocks == 1:
        return ordered
    return ordered.groupBy("id_a", "id_b").agg(F.sum("dot").alias("dot"))


def entity_stats(ratings: DataFrame, axis: str, n_context: int) -> DataFrame:
    """``id, mean, norm2``: zero-filled mean and squared norm of the centred vector."""
    entity, _ = _sides(axis)
    sums = ratings.groupBy(F.col(entity).alias("id")).agg(
        F.sum("rating").alias("s"), F.sum(F.col("rating") * F.col("rating")).alias("q")
    )
    mean = F.col("s") / F.lit(float(n_context))
    norm2 = F.col("q") - F.col("s") * mean
    # a constant vector leaves only rounding noise
    return sums.select("id", mean.alias("mean"), F.when(norm2 > F.col("q") * 1e-12, norm2).otherwise(F.lit(0.0)).alias("norm2"))


def cosine(dot: Column, n_context: int, mean_a, mean_b, norm_a, norm_b) -> Column:
    """Similarity from the sum of products; 0 where a norm is 0."""
    scale = F.sqrt(norm_a * norm_b)
    centred = dot - F.lit(float(n_context)) * mean_a * mean_b
    return F.when(scale > 0, centred / F.nullif(scale, F.lit(0.0))).otherwise(F.lit(0.0))


def fit_neighbors(
    ratings: DataFrame, axis: str = "item", n_neighbors: int = 50, min_rating: float = 0, max_rating: float = 5
) -> Model:
    """Neighbourhood model: its ratings, one row of statistics per entity, and the products.

    Ratings and statistics are written once. ``products`` is by far the largest table; it stays a plan
    until ``stored_products`` writes it, so what needs no products (nearest lists) never makes them.
    """
    _sides(axis)
    rows = cut_lineage(training_ratings(ratings))
    mean, n_users, n_items = rows.agg(
        F.avg("rating"), F.countDistinct("user_id"), F.countDistinct("item_id")
    ).first()
    n_context = n_users if axis == "item" else n_items
    meta = {
        "axis": axis, "global_mean": mean, "n_users": n_users, "n_items": n_items, "n_context": n_context,
        "n_neighbors": n_neighbors, "min_rating": min_rating, "max_rating": max_rating,
    }
    stats = cut_lineage(entity_stats(rows, axis, n_context))
    tables = {"ratings": rows, "stats": stats, "products": common_products(rows, axis)}
    return Model(f"{axis}_cf", tables, meta)


def stored_products(model: Model) -> DataFrame:
    """The products, written on first use and kept with the model."""
    if not model.meta.get("products_stored"):
        model.tables["products"] = cut_lineage(model.tables["products"])
        model.meta["products_stored"] = True
    return model.tables["products"]


def similarity_edges(model: Model) -> DataFrame:
    """``id_a < id_b, sim`` for the pairs with at least one common rater: the full table, one row per such pair."""
    meta = model.meta
    n_entities = meta["n_items"] if meta["axis"] == "item" else meta["n_users"]
    stats = broadcast_if_small(model.tables["stats"], n_entities, 48)
    rows = model.tables["products"]
    for side in ("a", "b"):
        rows = rows.join(
            stats.select(F.col("id").alias(f"id_{side}"), F.col("mean").alias(f"m{side}"), F.col("norm2").alias(f"q{side}")),
            f"id_{side}",
        )
    sim = cosine(F.col("dot"), meta["n_context"], F.col("ma"), F.col("mb"), F.col("qa"), F.col("qb"))
    return rows.select("id_a", "id_b", sim.alias("sim"))


def nearest_entities(model: Model, k: int) -> DataFrame:
    """``id, neighbor, sim, rank``: the k most similar entities with common raters, per entity.

    A pruned join over the ratings; the table of all products is neither needed nor made.
    """
    entity, context = _sides(model.meta["axis"])
    return nearest_pruned(model.tables["ratings"], model.tables["stats"], entity, context, model.meta["n_context"], k)


def neighbor_candidates(model: Model, users: DataFrame, per_item: int) -> DataFrame:
    """``user_id, item_id``: the items among the ``per_item`` nearest of any item a user rated.

    An opt-in shortcut for lists from an item-item model: items without a near rated item are not
    scored. A rating brings at most ``per_item`` candidates, so the work is linear in the ratings.
    """
    if model.kind != "item_cf":
        raise ValueError("neighbour candidates need an item-item model")
    near = nearest_entities(model, per_item).select(F.col("id").alias("item_id"), F.col("neighbor").alias("_to"))
    rated = model.tables["ratings"].filter(F.col("rating") > 0).join(users.select("user_id").distinct(), "user_id", "left_semi")
    return rated.join(near, "item_id").select("user_id", F.col("_to").alias("item_id")).distinct()


def _score_tiles(
    requests: DataFrame, rated: DataFrame, products: DataFrame, n_context: int, k: int, n_entities: int, n_contexts: int
) -> DataFrame:
    """``c, i, j, sim, dev`` of the k best candidates per request and tile, for long histories.

    A request in a context with very many ratings would meet all of them as rows. Here a task
    holds one block of targets, one block of rated entities, the products between the two, and
    the requests and ratings of a few contexts. It builds the similarity tile as a small matrix
    and returns k rows per request; the k best over all tiles are picked afterwards.
    """
    blocks = max(1, -(-n_entities // TILE))
    context_blocks = max(1, -(-n_contexts // TILE_CONTEXTS))
    asked = requests.withColumns({"_c": hash_bucket("t", context_blocks, "c"), "_a": hash_bucket("e", blocks, "i")})
    given = rated.withColumns({"_c": hash_bucket("t", context_blocks, "c"), "_b": hash_bucket("e", blocks, "j")})
    targets = asked.groupBy("_c").agg(F.collect_set("_a").alias("_as"))
    sources = given.groupBy("_c").agg(F.collect_set("_b").alias("_bs"))
    tiles = targets.join(sources, "_c").select("_c", F.explode("_as").alias("_a"), "_bs")
    tiles = tiles.select("_c", "_a", F.explode("_bs").alias("_b"))
    none = F.lit(None)
    id_type = requests.schema["i"].dataType
    context_type = requests.schema["c"].dataType
    columns = ["_c", "_a", "_b", "kind", "c", "x", "y", "m", "q", "v"]
    both_ways = products.select(
        F.inline(
            F.array(
                F.struct(F.col("id_a").alias("x"), F.col("id_b").alias("y"), "dot"),
                F.struct(F.col("id_b").alias("x"), F.col("id_a").alias("y"), "dot"),
            )
        )
    ).withColumns({"_a": hash_bucket("e", blocks, "x"), "_b": hash_bucket("e", blocks, "y")})
    rows = (
        asked.join(sources, "_c").withColumn("_b", F.explode("_bs"))
        .select("_c", "_a", "_b", F.lit(0).alias("kind"), "c", F.col("i").alias("x"), none.cast(id_type).alias("y"),
                F.col("mi").alias("m"), F.col("qi").alias("q"), F.lit(0.0).alias("v"))
        .unionByName(
            given.join(targets, "_c").withColumn("_a", F.explode("_as"))
            .select("_c", "_a", "_b", F.lit(1).alias("kind"), "c", none.cast(id_type).alias("x"), F.col("j").alias("y"),
                    F.col("mj").alias("m"), F.col("qj").alias("q"), F.col("r").alias("v"))
        )
        .unionByName(
            both_ways.join(tiles, ["_a", "_b"])
            .select("_c", "_a", "_b", F.lit(2).alias("kind"), none.cast(context_type).alias("c"), "x", "y",
                    F.lit(0.0).alias("m"), F.lit(0.0).alias("q"), F.col("dot").alias("v"))
        )
        .select(*columns)
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asked, given, dots = (pdf[pdf["kind"] == n] for n in (0, 1, 2))
        if not len(asked) or not len(given):
            return pd.DataFrame({c: plain([]) for c in ("c", "i", "j", "sim", "dev")})
        x, x_ids = pd.factorize(asked["x"], sort=True)
        y, y_ids = pd.factorize(given["y"], sort=True)
        mx, qx, my, qy = np.zeros(len(x_ids)), np.zeros(len(x_ids)), np.zeros(len(y_ids)), np.zeros(len(y_ids))
        mx[x], qx[x], my[y], qy[y] = asked["m"], asked["q"], given["m"], given["q"]
        tile = np.zeros((len(x_ids), len(y_ids)))
        px = pd.Index(x_ids).get_indexer(dots["x"].astype(asked["x"].dtype))
        py = pd.Index(y_ids).get_indexer(dots["y"].astype(given["y"].dtype))
        here = (px >= 0) & (py >= 0)
        tile[px[here], py[here]] = dots["v"].to_numpy()[here]
        scale = np.sqrt(np.outer(qx, qy))
        with np.errstate(divide="ignore", invalid="ignore"):
            tile = np.where(scale > 0, (tile - n_context * np.outer(mx, my)) / scale, 0.0)
        tile[np.asarray(x_ids)[:, None] == np.asarray(y_ids)[None, :]] = -np.inf
        deviation = (given["v"] - given["m"]).to_numpy()
        out = []
        for context, at in asked.groupby("c").indices.items():
            mine = np.flatnonzero((given["c"] == context).to_numpy())
            mine = mine[np.argsort(y[mine], kind="stable")]
            if not len(mine):
                continue
            sims = tile[np.ix_(x[at], y[mine])]
            best = np.argsort(-np.round(sims, 9), axis=1, kind="stable")[:, :k]
            chosen = np.take_along_axis(sims, best, axis=1)
            row, place = np.nonzero(np.isfinite(chosen))
            picked = best[row, place]
            out.append(
                pd.DataFrame(
                    {"c": context, "i": np.asarray(x_ids)[x[at][row]], "j": np.asarray(y_ids)[y[mine][picked]],
                     "sim": chosen[row, place], "dev": deviation[mine][picked]}
                )
            )
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: plain([]) for c in ("c", "i", "j", "sim", "dev")})

    schema = (
        f"c {context_type.simpleString()}, i {id_type.simpleString()}, j {id_type.simpleString()}, sim double, dev double"
    )
    return rows.groupBy("_c", "_a", "_b").applyInPandas(run, schema)


def _from_stored(model: Model, known: DataFrame, rated: DataFrame, lengths: DataFrame, n_heavy: int, n_entities: int) -> DataFrame:
    """``c, i, num, den`` per request: pairs meet the stored products as rows, long histories tile by tile."""
    meta, products = model.meta, stored_products(model)
    looked_up = known.join(lengths.filter(F.col("_len") <= HEAVY), "c").join(rated, "c")
    looked_up = looked_up.filter((F.col("j") != F.col("i")) | (F.col("_len") == 1))
    looked_up = looked_up.withColumns({"id_a": F.least("i", "j"), "id_b": F.greatest("i", "j")})
    with_dot = looked_up.join(products, ["id_a", "id_b"], "left")
    sim = cosine(
        F.coalesce(F.col("dot"), F.lit(0.0)), meta["n_context"], F.col("mi"), F.col("mj"), F.col("qi"), F.col("qj")
    )
    sim = F.when(F.col("i") == F.col("j"), F.when(F.col("qi") > 0, 1.0).otherwise(0.0)).otherwise(sim)
    scored = with_dot.select("c", "i", "j", sim.alias("sim"), (F.col("r") - F.col("mj")).alias("dev"))
    if n_heavy:
        heavy = lengths.filter(F.col("_len") > HEAVY).select("c")
        tiles = _score_tiles(
            known.join(heavy, "c", "left_semi"), rated.join(heavy, "c", "left_semi"), products,
            meta["n_context"], meta["n_neighbors"], n_entities, n_heavy,
        )
        scored = scored.unionByName(tiles)
    nearest = top_k(scored, ["c", "i"], [F.desc(stable("sim")), F.asc("j")], meta["n_neighbors"])
    return nearest.groupBy("c", "i").agg(
        F.sum(F.col("sim") * F.col("dev")).alias("num"), F.sum(F.abs("sim")).alias("den")
    )


def predict_neighbors(model: Model, pairs: DataFrame, bound: bool = True) -> DataFrame:
    """Adds ``rating_pred``: mean of the target plus the weighted deviations of its k neighbours.

    Where the ratings fill more than one cell, blocks of asked entities make their products and score
    their pairs inside a task (``histories``). Otherwise histories of at most HEAVY ratings are joined to the requests, so a request
    grows to HEAVY rows at most; longer ones go through ``_score_tiles``. The neighbours of (user, item) are the k entities most similar to the target (by signed
    similarity) among those rated in the same context, the target itself excluded unless it is
    the only one. Unknown user or item: global mean; no raters or zero weight: target's mean.
    """
    meta = model.meta
    entity, context = _sides(meta["axis"])
    n_entities = meta["n_items"] if meta["axis"] == "item" else meta["n_users"]
    ratings, stats = model.tables["ratings"], model.tables["stats"]
    stats = broadcast_if_small(stats, n_entities, 48)
    known_context = ratings.select(F.col(context).alias("c")).distinct().withColumn("_known", F.lit(True))
    target = stats.select(F.col("id").alias("i"), F.col("mean").alias("mi"), F.col("norm2").alias("qi"))
    requests = (
        pairs.select(F.col(context).alias("c"), F.col(entity).alias("i"))
        .distinct()
        .join(target, "i", "left")
        .join(known_context, "c", "left")
    )
    rated = ratings.filter(F.col("rating") > 0).select(
        F.col(context).alias("c"), F.col(entity).alias("j"), F.col("rating").alias("r")
    )
    lengths = (
        ratings.filter(F.col("rating") > 0).groupBy(F.col(context).alias("c")).agg(F.count(F.lit(1)).alias("_len"))
    )
    n_heavy = lengths.filter(F.col("_len") > HEAVY).count()
    nonzero = ratings.filter(F.col("rating") != 0).select(
        F.col(context).alias("c"), F.col(entity).alias("e"), F.col("rating").cast("double").alias("r")
    )
    n, longest = nonzero.groupBy("c").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    # inside blocks of asked entities, where the products would be a table far larger than the ratings
    some = not n_heavy and not meta.get("products_stored") and (n or 0) > CELL_ROWS and longest <= histories.LONGEST
    if some:
        requests = cut_lineage(requests)
        known = requests.filter(F.col("mi").isNotNull() & F.col("_known"))
        asked = known.select("c", "i", F.col("mi").alias("m"), F.col("qi").alias("q"))
        own = stats.select(F.col("id").alias("j"), F.col("mean").alias("m"), F.col("norm2").alias("q"))
        weighted = histories.asked_scores(nonzero, rated, own, asked, meta["n_context"], meta["n_neighbors"])
    else:
        rated = rated.join(stats.select(F.col("id").alias("j"), F.col("mean").alias("mj"), F.col("norm2").alias("qj")), "j")
        known = requests.filter(F.col("mi").isNotNull() & F.col("_known")).drop("_known")
        weighted = _from_stored(model, known, rated, lengths, n_heavy, n_entities)
    prediction = F.when(
        F.col("mi").isNull() | F.col("_known").isNull(), F.lit(float(meta["global_mean"]))
    ).otherwise(F.col("mi") + F.when(F.col("den") > 1e-9, F.col("num") / F.col("den")).otherwise(F.lit(0.0)))
    weighted = weighted.withColumnsRenamed({"c": "_c", "i": "_i"})
    found = (F.col("c") == F.col("_c")) & (F.col("i") == F.col("_i"))
    out = requests.join(weighted, found, "left").select(
        F.col("c").alias(context), F.col("i").alias(entity),
        model.bounded(prediction, bound).alias("rating_pred"),
        (F.col("mi").isNotNull() & F.col("_known").isNotNull()).alias("prediction_possible"),
    )
    out = out.withColumnsRenamed({"user_id": "_user", "item_id": "_item"})
    same = F.col("user_id").eqNullSafe(F.col("_user")) & F.col("item_id").eqNullSafe(F.col("_item"))
    return pairs.join(out, same, "left").select(*pairs.columns, "rating_pred", "prediction_possible")


def pair_similarity(pairs: DataFrame, ratings: DataFrame, axis: str = "user") -> DataFrame:
    """Cosine, Euclid and co-rated Pearson for given pairs ``id_a, id_b``.

    Cosine and Euclid run over the zero-filled vectors: norms over all ratings, products over
    the common ones. Pearson uses the common ratings only and is 0 below two of them.
    """
    entity, context = _sides(axis)
    rows = ratings.filter(F.col("rating") > 0)
    side = lambda s: rows.select(
        F.col(entity).alias(f"id_{s}"), F.col(context).alias("_c"), F.col("rating").cast("double").alias(f"r{s}")
    )
    norm = rows.groupBy(F.col(entity).alias("_id")).agg(
        F.sum(F.col("rating").cast("double") * F.col("rating")).alias("_q")
    )
    both = pairs.join(side("a"), "id_a").join(side("b"), ["id_b", "_c"])
    common = both.groupBy("id_a", "id_b").agg(
        F.count(F.lit(1)).alias("n_common"),
        F.sum(F.col("ra") * F.col("rb")).alias("dot"),
        F.sum("ra").alias("sa"), F.sum("rb").alias("sb"),
        F.sum(F.col("ra") * F.col("ra")).alias("qa"), F.sum(F.col("rb") * F.col("rb")).alias("qb"),
    )
    out = pairs.join(common, ["id_a", "id_b"], "left")
    for s in ("a", "b"):
        out = out.join(norm.select(F.col("_id").alias(f"id_{s}"), F.col("_q").alias(f"_n{s}")), f"id_{s}", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    n = F.coalesce(F.col("n_common"), F.lit(0))
    spread = F.sqrt(
        F.greatest(F.lit(0.0), n * zero("qa") - zero("sa") * zero("sa"))
        * F.greatest(F.lit(0.0), n * zero("qb") - zero("sb") * zero("sb"))
    )
    distance = F.sqrt(F.greatest(F.lit(0.0), zero("_na") + zero("_nb") - 2 * zero("dot")))
    return out.select(
        "id_a", "id_b", n.cast("long").alias("n_common"),
        F.coalesce(F.try_divide(zero("dot"), F.sqrt(zero("_na") * zero("_nb"))), F.lit(0.0)).alias("cosine"),
        distance.alias("euclid"),
        (1.0 / (1.0 + distance)).alias("euclid_similarity"),
        F.when(n < 2, F.lit(0.0))
        .otherwise(F.coalesce(F.try_divide(n * zero("dot") - zero("sa") * zero("sb"), spread), F.lit(0.0)))
        .alias("pearson"),
    )

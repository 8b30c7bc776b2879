"""Pruned nearest lists and exact top-N lists of neighbourhood models against full scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewise.operators import content, contentlists, histories, neighborlists, neighbors, similarjoin
from ratewise.operators.ranking import stable, top_k
from ratewise.plans import train as T


def skewed(spark, seed, n_users=60, n_items=45):
    """Long and short histories, some entities rated by nearly all, some constant."""
    rng = np.random.default_rng(seed)
    chance = np.outer(rng.beta(0.5, 1.5, n_users), rng.beta(0.5, 1.5, n_items)) ** 0.6
    dense = np.where(rng.random((n_users, n_items)) < chance, rng.integers(1, 6, (n_users, n_items)), 0)
    dense[:, 4], dense[7, :], dense[:, 9] = 3, rng.integers(1, 6, n_items), 0
    dense[3, 9] = 5
    rows = [(int(u), int(i), float(dense[u, i])) for u, i in zip(*np.nonzero(dense))]
    return spark.createDataFrame(rows + [(2, 40, 0.0)], "user_id long, item_id long, rating double").dropDuplicates(["user_id", "item_id"])


def all_edges(model, k):
    edges = neighbors.similarity_edges(model)
    both = edges.select("id_a", "id_b", "sim").union(edges.select("id_b", "id_a", "sim")).toDF("id", "neighbor", "sim")
    return top_k(both, ["id"], [F.desc(stable("sim")), F.asc("neighbor")], k)


def as_lists(df, key, value):
    out = {}
    for r in df.orderBy(key, "rank").collect():
        out.setdefault(r[key], []).append(tuple(round(r[v], 8) if isinstance(r[v], float) else r[v] for v in value))
    return out


@pytest.mark.parametrize("axis, k, rows, entities, hot", [("item", 3, 40, 5, 10**6), ("user", 4, 200_000, 2_000, 10**6), ("item", 5, 60, 10, 25), ("user", 2, 30, 4, 20)])
def test_nearest_lists(spark, monkeypatch, axis, k, rows, entities, hot):
    monkeypatch.setattr(similarjoin, "BLOCK_ROWS", rows)
    monkeypatch.setattr(similarjoin, "BLOCK_ENTITIES", entities)
    monkeypatch.setattr(similarjoin, "HOT_ROWS", hot)
    model = neighbors.fit_neighbors(skewed(spark, 3), axis, 5)
    got = neighbors.nearest_entities(model, k)
    assert "products_stored" not in model.meta
    value = ("neighbor", "sim", "rank")
    assert as_lists(got, "id", value) == as_lists(all_edges(model, k), "id", value)


@pytest.mark.parametrize("axis, k, named", [("item", 3, False), ("user", 4, False), ("item", 5, True)])
def test_nearest_lists_from_histories(spark, monkeypatch, axis, k, named):
    """With many blocks every rating used to be sent to nearly all of them."""
    ratings = skewed(spark, 3)
    if named:
        ratings = ratings.selectExpr("user_id", "concat('i', item_id) AS item_id", "rating")
    want = all_edges(neighbors.fit_neighbors(ratings, axis, 5), k)
    monkeypatch.setattr(similarjoin, "BLOCK_ENTITIES", 2)
    monkeypatch.setattr(similarjoin, "MOST_BLOCKS", 3)
    monkeypatch.setattr(histories, "BLOCK_RATINGS", 60)
    monkeypatch.setattr(histories, "EXPAND", 50)
    cut, real = [], similarjoin.cut_lineage
    monkeypatch.setattr(similarjoin, "cut_lineage", lambda df: cut.append(df.columns) or real(df))
    got = neighbors.nearest_entities(neighbors.fit_neighbors(ratings, axis, 5), k)
    value = ("neighbor", "sim", "rank")
    assert as_lists(got, "id", value) == as_lists(want, "id", value)
    assert not any("_b" in columns for columns in cut)


@pytest.mark.parametrize("named, bound", [(False, "67108864"), (True, "0")])
def test_histories_are_sent_in_few_bytes(spark, monkeypatch, named, bound):
    """Each rating used to go to nearly all blocks as an id, the rating, a mean and a spread."""
    ratings = skewed(spark, 5)
    if named:
        ratings = ratings.selectExpr("user_id", "concat('i', item_id) AS item_id", "rating")
    want = all_edges(neighbors.fit_neighbors(ratings, "item", 5), 4)
    monkeypatch.setattr(similarjoin, "BLOCK_ENTITIES", 2)
    monkeypatch.setattr(similarjoin, "MOST_BLOCKS", 3)
    monkeypatch.setattr(histories, "BLOCK_RATINGS", 60)
    monkeypatch.setattr(histories, "ASKED_AT_ONCE", 40)
    monkeypatch.setattr(histories, "SCORED_AT_ONCE", 30)
    sent, real = [], histories.histories
    monkeypatch.setattr(histories, "histories", lambda rows, *a: sent.append(rows.schema) or real(rows, *a))
    key = "spark.ratewise.broadcastBytes"
    before = spark.conf.get(key, None)
    spark.conf.set(key, bound)
    try:
        got = neighbors.nearest_entities(neighbors.fit_neighbors(ratings, "item", 5), 4)
        value = ("neighbor", "sim", "rank")
        assert as_lists(got, "id", value) == as_lists(want, "id", value)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    assert sent[-1]["e"].dataType.simpleString() == "int" and sent[-1]["r"].dataType.simpleString() == ("struct<r:double,m:double,s:double>" if named else "double")


def test_small_matrices_and_chunks():
    rng = np.random.default_rng(5)
    import pandas as pd

    rows = pd.DataFrame([(c, e, float(rng.integers(1, 6))) for c in range(30) for e in range(12) if rng.random() < 0.4], columns=["c", "e", "r"])
    rows["m"], rows["q"], rows["t"] = rows["e"] * 0.01, 1.0 + rows["e"], -np.inf
    want = similarjoin.best_of_blocks(rows, rows, 30, 4)
    old = similarjoin.EXPAND, similarjoin.CELLS
    similarjoin.EXPAND, similarjoin.CELLS = 7, 24
    try:
        pd.testing.assert_frame_equal(similarjoin.best_of_blocks(rows, rows, 30, 4), want)
    finally:
        similarjoin.EXPAND, similarjoin.CELLS = old


def test_bounds_spare_work(spark, monkeypatch):
    """Entities with good partners of their own size are not sent to blocks of other sizes."""
    rows = [(u, i, 5.0) for g in range(6) for u in range(g * 10, g * 10 + 4) for i in range(g * 10, g * 10 + 4)]
    rows += [(u, 1000 + i, 1.0) for u in range(200) for i in range(5)]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    sent = []
    real = similarjoin.cut_lineage
    monkeypatch.setattr(similarjoin, "cut_lineage", lambda df: sent.append(df.columns) or real(df))
    model = neighbors.fit_neighbors(ratings, "item", 5)
    got = as_lists(neighbors.nearest_entities(model, 3), "id", ("neighbor", "rank"))
    assert got == as_lists(all_edges(model, 3), "id", ("neighbor", "rank"))
    assert ["e", "m", "q", "t", "_a", "_b"] in sent


@pytest.mark.parametrize("axis, k, amount, sizes", [
    ("item", 3, 4, {}), ("user", 3, 4, {}),
    ("item", 20, 5, {"TARGETS": 7, "CONTEXT_ROWS": 50, "EXPAND": 40, "CELLS": 60}),
    ("user", 20, 5, {"TARGETS": 9, "CONTEXT_ROWS": 60, "EXPAND": 50, "CELLS": 80}),
    ("item", 4, 3, {"LONGEST": 20, "EDGES": 300}), ("user", 4, 3, {"LONGEST": 25}),
])
def test_lists_equal_scores_of_all_pairs(spark, monkeypatch, axis, k, amount, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(neighborlists, name, value)
    ratings = skewed(spark, 8)
    model = neighbors.fit_neighbors(ratings, axis, k)
    users = ratings.select("user_id").filter("user_id % 4 <> 1").union(spark.createDataFrame([(999,), (None,)], "user_id long"))
    known = ratings.filter("rating > 2").union(spark.createDataFrame([(999, 0, 1.0)], ratings.schema))
    pairs = users.filter("user_id IS NOT NULL").distinct().crossJoin(ratings.select("item_id").distinct())
    value = ("item_id", "rating_pred", "rank")
    for skip in (known, None):
        want = T.recommend(model, users, skip, amount, candidates=pairs)
        got = T.recommend(model, users, skip, amount)
        assert as_lists(got, "user_id", value) == as_lists(want, "user_id", value)


@pytest.mark.parametrize("axis", ["item", "user"])
def test_lists_need_no_table_of_all_products(spark, monkeypatch, axis):
    """The products of a tile's targets are made in the tile; histories too long for arrays take the stored ones."""
    ratings, value = skewed(spark, 8), ("item_id", "rating_pred", "rank")
    model = neighbors.fit_neighbors(ratings, axis, 6)
    got = as_lists(T.recommend(model, ratings, ratings, 4), "user_id", value)
    assert not model.meta.get("products_stored")
    monkeypatch.setattr(histories, "LONGEST", 3)
    assert got == as_lists(T.recommend(model, ratings, ratings, 4), "user_id", value)
    assert model.meta["products_stored"]


def test_only_promising_pairs_are_scored(spark, monkeypatch):
    """Items that cannot enter a list are dropped on their bounds."""
    import pandas as pd

    rng = np.random.default_rng(2)
    rows = [(u, i, float(rng.integers(1, 6))) for u in range(80) for i in range(120) if rng.random() < 0.15 and (u % 4 == i % 4 or rng.random() < 0.02)]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    model = neighbors.fit_neighbors(ratings, "item", 50)
    stats = model.tables["stats"].toPandas().set_index("id")
    products = neighbors.stored_products(model).toPandas()
    frame = pd.DataFrame(rows, columns=["c", "j", "r"])
    given = frame.assign(kind=0, m=stats["mean"].loc[frame["j"]].to_numpy(), q=stats["norm2"].loc[frame["j"]].to_numpy())
    given["v"] = given["r"] - given["m"]
    left = pd.concat([given, pd.DataFrame({"c": range(80), "j": 0, "kind": 1, "v": 0.0, "m": 0.0, "q": 0.0})])
    edges = pd.concat([products.set_axis(["i", "j", "v"], axis=1), products.set_axis(["j", "i", "v"], axis=1)]).assign(kind=0, m=0.0, q=0.0)
    right = pd.concat([edges, pd.DataFrame({"i": stats.index, "j": 0, "kind": 1, "v": 0.0, "m": stats["mean"].to_numpy(), "q": stats["norm2"].to_numpy()})])
    scored = []
    real = neighborlists.Tile.exact
    monkeypatch.setattr(neighborlists.Tile, "exact", lambda self, c, x: scored.append(len(c)) or real(self, c, x))
    out = neighborlists.lists_of_tile(left, right, model.meta["n_context"], 50, 5, True)
    assert len(out) == 80 * 5 and sum(scored) < 80 * 120 / 4
    tile = neighborlists.Tile(left, right, model.meta["n_context"], 50)
    bound = tile.bounds(0, 80)
    c, x = np.indices(bound.shape)
    assert (tile.exact(c.ravel(), x.ravel()) <= bound.ravel() + 1e-9).all()


def test_all_models_through_the_dispatcher(spark, small_ratings):
    features = spark.createDataFrame([("i1", "f", 1.0), ("i2", "f", 1.0), ("i2", "g", 1.0), ("i3", "g", 2.0)], "item_id string, feature string, value double")
    asked = spark.createDataFrame([("u2", "i2"), ("u2", "i3"), ("u9", "i1")], "user_id string, item_id string")
    fits = {n: T.fit_model(n, small_ratings, **({"n_epochs": 1} if n == "linear_als" else {})) for n in ("item_cf", "linear_als", "global_mean")}
    for model in fits.values():  # string ids, and tasks that return no rows
        assert T.recommend(model, asked, small_ratings, 2).count() > 0
    assert {r["rating_pred"] for r in T.predict(fits["global_mean"], asked).collect()} == {4.0}
    model = T.fit_model("content", small_ratings, features=features, mode="similarity", n_neighbors=2)
    got = {(r["user_id"], r["item_id"]): (r["rating_pred"], r["prediction_possible"]) for r in T.predict(model, asked).collect()}
    # i2's only rated similar item is i1, 0.5 below its mean; i3 is similar to i2 only, which u2 has not rated
    assert got == {("u2", "i2"): (2.5, True), ("u2", "i3"): (4.0, True), ("u9", "i1"): (4.0, False)}
    lists = as_lists(T.recommend(model, asked, small_ratings, 2), "user_id", ("item_id", "rating_pred"))
    assert lists == {"u2": [("i3", 4.0), ("i2", 2.5)], "u9": [("i1", 4.0), ("i2", 4.0)]}


@pytest.mark.parametrize("entries, rated, at_once, named", [(3_000_000, 3_000_000, 500_000, False), (30, 60, 7, True)])
def test_similarity_lists_are_made_in_cells(spark, monkeypatch, entries, rated, at_once, named):
    """Every scored pair used to be a row, which was shuffled, written and joined with the known ones."""
    ratings = skewed(spark, 9)
    features = spark.createDataFrame([(i, f"f{i * 7 % (5 + d)}-{d}", 1.0 + d) for i in range(2, 50) for d in range(2)], "item_id long, feature string, value double")
    users = ratings.select("user_id").union(spark.createDataFrame([(777,)], "user_id long"))
    if named:
        ratings, features = (df.withColumn("item_id", F.concat(F.lit("i"), "item_id")) for df in (ratings, features))
    model = T.fit_model("content", ratings, features=features, mode="similarity", n_neighbors=3)
    pairs = users.distinct().crossJoin(model.items().select("item_id")).join(ratings, ["user_id", "item_id"], "left_anti")
    scored = T.predict(model, pairs, bound=False)
    want = top_k(scored, ["user_id"], [F.desc(stable("rating_pred")), F.asc("item_id")], 6)
    monkeypatch.setattr(contentlists, "LIST_ENTRIES", entries)
    monkeypatch.setattr(contentlists, "USER_RATINGS", rated)
    monkeypatch.setattr(contentlists, "SUMMED_AT_ONCE", at_once)
    cut, real = [], content.cut_lineage
    monkeypatch.setattr(content, "cut_lineage", lambda df: cut.append(df.columns) or real(df))
    got = T.recommend(model, users, ratings, 6, bound=False)
    value = ("item_id", "rating_pred", "rank")
    assert as_lists(got, "user_id", value) == as_lists(want, "user_id", value)
    assert not any("item_id" in columns for columns in cut)

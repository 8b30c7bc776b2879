import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ratewise.operators import bias, content, factors, histories, neighbors
from ratewise.operators.model import Model
from ratewise.plans import train as T


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


# --- bias ----------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "epochs, users, items",
    [
        (1, {"u1": 0.0, "u2": 0.0}, {"i1": 1 / 3, "i2": -1 / 2}),
        (2, {"u1": 1 / 18, "u2": -1 / 6}, {"i1": 10 / 27, "i2": -19 / 36}),
    ],
)
def test_als_by_hand(small_ratings, epochs, users, items):
    model = bias.fit_bias(small_ratings, "als", epochs, 1.0)
    assert model.meta["global_mean"] == 4.0
    assert as_dict(model.users(), "user_id", "bias") == pytest.approx(users)
    assert as_dict(model.items(), "item_id", "bias") == pytest.approx(items)


def test_checkpoint_interval_changes_nothing(random_ratings):
    ratings, _ = random_ratings
    one, three = (bias.fit_bias(ratings, "als", 4, 1.0, checkpoint_every=n) for n in (1, 3))
    assert as_dict(one.items(), "item_id", "bias") == pytest.approx(as_dict(three.items(), "item_id", "bias"))
    assert [e for e, _ in one.history] == [1, 2, 3, 4]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 5)), min_size=3, max_size=30, unique_by=lambda t: t[:2]))
def test_als_objective_never_rises(spark, rows):
    ratings = spark.createDataFrame([(u, i, float(r)) for u, i, r in rows], "user_id long, item_id long, rating double")
    reg, last = 1.0, math.inf
    mean = sum(r for *_, r in rows) / len(rows)
    for epochs in (1, 3):
        model = bias.fit_bias(ratings, "als", epochs, reg)
        bu, bi = as_dict(model.users(), "user_id", "bias"), as_dict(model.items(), "item_id", "bias")
        value = sum((r - mean - bu[u] - bi[i]) ** 2 for u, i, r in rows)
        value += reg * (sum(b * b for b in bu.values()) + sum(b * b for b in bi.values()))
        assert value <= last + 1e-9
        last = value


def test_sgd_step_equals_expected_sequential_updates(spark):
    targets, lr, reg = [1.0, 2.0, 5.0, 4.0], 0.05, 0.1
    rows = [("u", f"i{n}", t) for n, t in enumerate(targets)]
    model = bias.fit_bias(spark.createDataFrame(rows, "user_id string, item_id string, rating double"), "sgd", 1, reg, lr)
    rng, mean, results = np.random.default_rng(0), np.mean(targets), []
    for _ in range(4000):
        b = 0.0
        for t in rng.permutation(targets):
            b += lr * (t - mean - (1 + reg) * b)
        results.append(b)
    assert as_dict(model.users(), "user_id", "bias")["u"] == pytest.approx(np.mean(results), abs=2e-3)


@pytest.mark.parametrize("method, names, broadcast", [("als", False, "0"), ("als", True, "0"), ("sgd", True, "0"), ("als", False, "67108864")])
def test_bias_in_cells_equals_plain(spark, random_ratings, monkeypatch, method, names, broadcast):
    ratings, _ = random_ratings
    if names:
        name = lambda key: F.when(F.col(key) != 2, F.concat(F.lit("n"), key)).alias(key)  # one id is missing
        ratings = ratings.select(name("user_id"), name("item_id"), "rating")
    fit = lambda: bias.fit_bias(ratings, method, 3, 1.0)
    want = fit()
    monkeypatch.setattr(bias, "LAID_OUT", 1)
    monkeypatch.setattr(bias, "BLOCKS", 3)
    key, calls, sums = "spark.ratewise.broadcastBytes", [], bias._cell_sums
    monkeypatch.setattr(bias, "_cell_sums", lambda *a: calls.append(1) or sums(*a))
    before = spark.conf.get(key, None)
    spark.conf.set(key, broadcast)
    try:
        got = fit()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    assert len(calls) == (5 if broadcast == "0" else 0)
    for side in ("user_id", "item_id"):
        mine, theirs = (as_dict(m.tables[f"{side[:4]}s"], side, "bias") for m in (got, want))
        assert mine == pytest.approx(theirs, abs=1e-12)
    assert [e for e, _ in got.history] == [1, 2, 3] and [x for _, x in got.history] == pytest.approx([x for _, x in want.history])


def test_bias_fit_sends_few_partial_sums(spark, monkeypatch):
    """Ratings lie anywhere; the fit sends a sum per user and block, not one per user and task."""
    monkeypatch.setattr(bias, "LAID_OUT", 1)
    monkeypatch.setattr(bias, "BLOCKS", 2)
    rows = spark.range(0, 40 * 60, 1, 60).select((F.col("id") % 40).alias("user_id"), F.floor(F.col("id") / 40).alias("item_id"), F.lit(1.0).alias("rating"))
    seen, half = [], bias._half_epoch
    monkeypatch.setattr(bias, "_half_epoch", lambda targets, *a: seen.append(targets.select("user_id", "item_id", F.spark_partition_id().alias("_p")).collect()) or half(targets, *a))
    bias.fit_bias(rows, "als", 1, 1.0)
    for laid in seen:
        assert len({(r["user_id"], r["_p"]) for r in laid}) <= 2 * 40 and len({(r["item_id"], r["_p"]) for r in laid}) <= 2 * 60
        assert len(laid) == 40 * 60


def test_predict_unknown_and_bounds(small_ratings, spark):
    model = bias.fit_bias(small_ratings, "als", 2, 1.0, max_rating=4)
    pairs = spark.createDataFrame([("u1", "i1"), ("new", "i2"), ("u2", "new"), ("new", "new")], "user_id string, item_id string")
    got = {(r[0], r[1]): r for r in T.predict(model, pairs).collect()}
    assert got["u1", "i1"]["rating_pred"] == 4.0 and got["u1", "i1"]["prediction_possible"]
    assert got["new", "i2"]["rating_pred"] == pytest.approx(4 - 19 / 36) and not got["new", "i2"]["prediction_possible"]
    assert got["u2", "new"]["rating_pred"] == pytest.approx(4 - 1 / 6)
    assert got["new", "new"]["rating_pred"] == 4.0


@pytest.mark.parametrize("amount", [1, 4, 30])
def test_recommend_equals_scoring_everything(random_ratings, amount):
    ratings, dense = random_ratings
    model = bias.fit_bias(ratings, "als", 2, 1.0)
    bi = as_dict(model.items(), "item_id", "bias")
    got = {}
    for r in T.recommend(model, ratings, ratings, amount).collect():
        got.setdefault(r["user_id"], {})[r["rank"]] = r["item_id"]
    for u in range(len(dense)):
        free = sorted((i for i in bi if dense[u, i] == 0), key=lambda i: (-round(bi[i], 9), i))[:amount]
        assert [got.get(u, {})[n] for n in sorted(got.get(u, {}))] == free


def test_fold_in_touches_only_its_users(random_ratings):
    ratings, _ = random_ratings
    model = bias.fit_bias(ratings.filter("user_id < 20"), "als", 3, 1.0)
    updated = T.update_users(model, ratings.filter("user_id >= 18"), 0.01, 20)
    before, after = as_dict(model.users(), "user_id", "bias"), as_dict(updated.users(), "user_id", "bias")
    assert set(after) == set(before) | set(range(18, 25))
    assert all(after[u] == before[u] for u in before if u < 18)
    assert as_dict(model.items(), "item_id", "bias") == as_dict(updated.items(), "item_id", "bias")
    assert updated.meta["n_users"] == len(after)


# --- neighbours ----------------------------------------------------------------------------------


def dense_prediction(dense, u, i, k):
    """Item-item prediction on the full matrix, the slow way."""
    means = dense.mean(axis=0)
    centred = dense - means
    norms = np.sqrt((centred**2).sum(axis=0))
    rated = [j for j in np.flatnonzero(dense[u] > 0) if j != i] or list(np.flatnonzero(dense[u] > 0))
    sims = {j: centred[:, i] @ centred[:, j] / (norms[i] * norms[j]) if norms[i] * norms[j] > 1e-9 else 0.0 for j in rated}
    best = sorted(rated, key=lambda j: (-round(sims[j], 9), j))[:k]
    weight = sum(abs(sims[j]) for j in best)
    return means[i] + (sum(sims[j] * (dense[u, j] - means[j]) for j in best) / weight if weight > 1e-9 else 0.0)


@pytest.mark.parametrize("axis", ["item", "user"])
@pytest.mark.parametrize("k, heavy", [(3, 2000), (50, 2000), (3, 6), (4, 0)])
def test_neighbours_equal_dense_matrix(spark, random_ratings, monkeypatch, axis, k, heavy):
    ratings, dense = random_ratings
    monkeypatch.setattr(neighbors, "HEAVY", heavy)
    monkeypatch.setattr(neighbors, "TILE", 7)
    monkeypatch.setattr(neighbors, "TILE_CONTEXTS", 4)
    pairs = spark.createDataFrame([(u, i) for u in range(25) for i in range(18)], "user_id long, item_id long")
    model = neighbors.fit_neighbors(ratings, axis, k)
    got = {(r[0], r[1]): r["rating_pred"] for r in neighbors.predict_neighbors(model, pairs, bound=False).collect()}
    for (u, i), value in got.items():
        want = dense_prediction(dense, u, i, k) if axis == "item" else dense_prediction(dense.T, i, u, k)
        assert value == pytest.approx(want, abs=1e-9), (u, i)


def test_neighbours_by_hand(small_ratings, spark):
    model = neighbors.fit_neighbors(small_ratings, "item")
    edge = neighbors.similarity_edges(model).first()
    assert (edge["id_a"], edge["id_b"], edge["sim"]) == ("i1", "i2", pytest.approx(1.0))
    pairs = spark.createDataFrame([("u2", "i2"), ("u9", "i1")], "user_id string, item_id string")
    got = {(r[0], r[1]): r["rating_pred"] for r in T.predict(model, pairs).collect()}
    assert got == {("u2", "i2"): pytest.approx(1.0), ("u9", "i1"): 4.0}


@pytest.mark.parametrize("cell_rows, expand", [(10, 4_000_000), (400_000, 7), (1, 50)])
def test_products_do_not_depend_on_the_blocks(random_ratings, monkeypatch, cell_rows, expand):
    ratings, dense = random_ratings
    monkeypatch.setattr(neighbors, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(neighbors, "EXPAND", expand)
    got = {(r["id_a"], r["id_b"]): r["dot"] for r in neighbors.common_products(ratings, "item").collect()}
    gram = dense.T @ dense
    want = {(a, b): gram[a, b] for a in range(18) for b in range(a + 1, 18) if gram[a, b] != 0}
    assert got == want


@pytest.mark.parametrize("block, expand", [(10, 4_000_000), (30, 7), (1, 50)])
def test_products_of_histories_are_complete_in_their_block(random_ratings, monkeypatch, block, expand):
    """Cells of contexts used to give a row per pair and cell, which were shuffled again to be added up."""
    ratings, dense = random_ratings
    monkeypatch.setattr(neighbors, "CELL_ROWS", 20)
    monkeypatch.setattr(histories, "BLOCK_RATINGS", block)
    monkeypatch.setattr(histories, "EXPAND", expand)
    products = neighbors.common_products(ratings, "item")
    gram = dense.T @ dense
    want = {(a, b): gram[a, b] for a in range(18) for b in range(a + 1, 18) if gram[a, b] != 0}
    assert {(r["id_a"], r["id_b"]): r["dot"] for r in products.collect()} == want
    assert "FlatMapGroupsInPandas" in products._jdf.queryExecution().optimizedPlan().toString().split("\n")[0]


@pytest.mark.parametrize("axis", ["item", "user"])
def test_predictions_make_only_the_products_they_meet(spark, random_ratings, monkeypatch, axis):
    ratings, _ = random_ratings
    pairs = spark.createDataFrame([(u, i) for u in range(0, 27, 2) for i in range(1, 20, 3)], "user_id long, item_id long")
    rows = lambda df: {(r[0], r[1]): (round(r[2], 9), r[3]) for r in df.collect()}
    want = rows(neighbors.predict_neighbors(neighbors.fit_neighbors(ratings, axis, 4), pairs))
    monkeypatch.setattr(neighbors, "CELL_ROWS", 20)
    monkeypatch.setattr(histories, "BLOCK_RATINGS", 30)
    model = neighbors.fit_neighbors(ratings, axis, 4)
    assert rows(neighbors.predict_neighbors(model, pairs)) == want
    assert "products_stored" not in model.meta


@pytest.mark.parametrize("axis, named, lists, at_once", [("item", True, 2_000_000, 2_000_000), ("user", False, 9, 30), ("item", False, 5, 7)])
def test_asked_pairs_are_scored_in_their_block(spark, random_ratings, monkeypatch, axis, named, lists, at_once):
    """Requests used to be joined with all ratings of their context, and these with the products, as rows."""
    ratings, _ = random_ratings
    ratings = ratings.unionByName(spark.createDataFrame([(30, 2, 4.0), (31, 30, 3.0), (32, 31, 0.0), (1, 32, 0.0)], ratings.schema))
    pairs = spark.createDataFrame([(u, i) for u in range(34) for i in range(0, 34, 2)], "user_id int, item_id int").filter("user_id <> 4")
    if named:
        name = lambda df: df.withColumns({c: F.concat(F.lit("n"), F.col(c)) for c in ("user_id", "item_id")})
        ratings, pairs = name(ratings), name(pairs)
    rows = lambda df: {(r[0], r[1]): (round(r[2], 9), r[3]) for r in df.collect()}
    want = rows(neighbors.predict_neighbors(neighbors.fit_neighbors(ratings, axis, 4), pairs, bound=False))
    monkeypatch.setattr(neighbors, "CELL_ROWS", 20)
    monkeypatch.setattr(histories, "BLOCK_RATINGS", 30)
    monkeypatch.setattr(histories, "LIST_RATINGS", lists)
    monkeypatch.setattr(histories, "ASKED_AT_ONCE", at_once)
    monkeypatch.setattr(histories, "SCORED_AT_ONCE", at_once)
    model = neighbors.fit_neighbors(ratings, axis, 4)
    got = neighbors.predict_neighbors(model, pairs, bound=False)
    assert rows(got) == want and len(want) == pairs.count()
    plan = got._jdf.queryExecution().analyzed().toString()
    assert "dot#" not in plan and "products_stored" not in model.meta


@pytest.mark.parametrize("longest", [20_000, 5])
def test_names_as_ids_and_long_histories(spark, random_ratings, monkeypatch, longest):
    ratings, dense = random_ratings
    named = ratings.selectExpr("user_id", "concat('i', item_id) AS item_id", "rating")
    monkeypatch.setattr(neighbors, "CELL_ROWS", 20)
    monkeypatch.setattr(histories, "LONGEST", longest)
    gram = dense.T @ dense
    want = {tuple(sorted((f"i{a}", f"i{b}"))): gram[a, b] for a in range(18) for b in range(a + 1, 18) if gram[a, b] != 0}
    assert {(r["id_a"], r["id_b"]): r["dot"] for r in neighbors.common_products(named, "item").collect()} == want


def test_pair_similarity(spark):
    rows = [(1, "a", 5.0), (1, "b", 4.0), (1, "e", 3.0), (2, "a", 4.0), (2, "b", 5.0), (2, "e", 4.0), (3, "c", 5.0)]
    ratings = spark.createDataFrame(rows, "user_id long, item_id string, rating double")
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "id_a long, id_b long")
    got = {r["id_b"]: r for r in neighbors.pair_similarity(pairs, ratings).collect()}
    x, y = np.array([5, 4, 3.0]), np.array([4, 5, 4.0])
    assert got[2]["cosine"] == pytest.approx(x @ y / np.sqrt((x @ x) * (y @ y)))
    assert got[2]["euclid"] == pytest.approx(np.sqrt(3))
    assert got[2]["pearson"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
    assert (got[3]["cosine"], got[3]["pearson"], got[3]["n_common"]) == (0.0, 0.0, 0)


# --- content -------------------------------------------------------------------------------------


def test_content_profiles(spark, small_ratings):
    wide = spark.createDataFrame([("i1", 1, 0), ("i2", 1, 1)], "item_id string, f int, g int")
    features = content.long_features(wide, ["f", "g"])
    got = {(r[0], r[1]): r[2] for r in content.user_profiles(small_ratings, features, 1).collect()}
    assert got == {("u1", "f"): 1.0, ("u1", "g"): pytest.approx(2 / 6), ("u2", "f"): 1.0, ("u2", "g"): 0.0}
    model = content.fit_content(small_ratings, features, 1)
    assert as_dict(model.users(), "user_id", "score") == pytest.approx({"u1": (1 + 2 / 6) / 2, "u2": 0.5})
    least = content.fit_content(small_ratings, features, 4).users().filter("user_id = 'u2'").first()
    assert least["score"] == 0.0


# --- factors -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def factor_model(random_ratings):
    return factors.fit_factors(random_ratings[0], "linear", 4, 4, 0.05, 0.02, min_rating=1, track_rmse=True)


@pytest.mark.parametrize("kernel, lr", [("linear", 0.05), ("sigmoid", 0.1), ("rbf", 0.1)])
def test_training_error_falls(random_ratings, kernel, lr):
    model = factors.fit_factors(random_ratings[0], kernel, 4, 3, lr, 0.01, min_rating=1, track_rmse=True)
    errors = [e for _, e in model.history]
    assert errors[-1] < errors[0]
    assert model.users().count() == 25 and model.items().count() == 18


def test_lanes_average_the_items(random_ratings):
    model = factors.fit_factors(random_ratings[0], "linear", 4, 4, 0.05, 0.02, min_rating=1, track_rmse=True, lanes=3)
    errors = [e for _, e in model.history]
    assert model.meta["lanes"] == 3 and errors[-1] < errors[0] and model.users().count() == 25 and model.items().count() == 18


def test_fit_is_repeatable(random_ratings, factor_model):
    again = factors.fit_factors(random_ratings[0], "linear", 4, 4, 0.05, 0.02, min_rating=1)
    a, b = (as_dict(m.users(), "user_id", "factors") for m in (factor_model, again))
    assert all(a[u] == pytest.approx(b[u]) for u in a)


def test_factors_beat_the_mean(random_ratings, factor_model):
    _, dense = random_ratings
    assert factor_model.history[-1][1] < dense[dense > 0].std()


def test_factor_lists_equal_scoring_everything(spark, random_ratings):
    ratings, dense = random_ratings
    for kernel in factors.KERNELS:
        model = factors.fit_factors(ratings, kernel, 3, 1, 0.05, 0.02, min_rating=1)
        pairs = spark.createDataFrame([(u, i) for u in range(25) for i in range(18)], "user_id long, item_id long")
        scores = {(r[0], r[1]): r["rating_pred"] for r in T.predict(model, pairs, bound=False).collect()}
        got = {}
        for r in T.recommend(model, ratings, ratings, 4, bound=False).collect():
            got.setdefault(r["user_id"], []).append((r["rank"], r["item_id"], r["rating_pred"]))
        for u, rows in got.items():
            free = sorted((-scores[u, i], i) for i in range(18) if dense[u, i] == 0)[:4]
            assert [(i, pytest.approx(-s)) for s, i in free] == [(i, s) for _, i, s in sorted(rows)]


def test_factor_fold_in_is_plain_sgd_per_user(random_ratings, factor_model):
    ratings, _ = random_ratings
    updated = T.update_users(factor_model, ratings.filter("user_id >= 20"), 0.05, 20)
    scored = T.predict(updated, ratings.filter("user_id >= 20"), bound=False)
    error = scored.agg(F.sqrt(F.avg(F.pow(F.col("rating") - F.col("rating_pred"), 2)))).first()[0]
    assert error < 1.4
    assert as_dict(updated.items(), "item_id", "bias") == as_dict(factor_model.items(), "item_id", "bias")
    chunked = factors.update_factor_users(factor_model, ratings.filter("user_id >= 20"), 0.05, 20, chunk=5)
    assert chunked.users().count() == updated.users().count() == 25 and chunked.meta["fold_chunk"] == 5


@pytest.mark.parametrize("records", ["1", "10000"])
def test_factor_fold_in_ignores_who_shares_the_batch(spark, random_ratings, factor_model, records):
    ratings, _ = random_ratings
    alone = as_dict(T.update_users(factor_model, ratings.filter("user_id = 21"), 0.05, 5).users(), "user_id", "bias")[21]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, records)
    try:
        among = as_dict(T.update_users(factor_model, ratings.coalesce(1), 0.05, 5).users(), "user_id", "bias")[21]
    finally:
        spark.conf.set(key, before)
    assert among == pytest.approx(alone, abs=1e-12)


@pytest.mark.parametrize("name", ["item_cf", "user_cf"])
def test_neighbours_without_ids_get_the_mean(spark, small_ratings, name):
    model = T.fit_model(name, small_ratings)
    pairs = spark.createDataFrame([("u1", None), (None, "i1"), (None, None), ("u2", "i2")], "user_id string, item_id string")
    got = {(r["user_id"], r["item_id"]): (r["rating_pred"], r["prediction_possible"]) for r in T.predict(model, pairs).collect()}
    assert len(got) == 4 and got["u2", "i2"][1]
    assert all(got[k] == (pytest.approx(4.0), False) for k in [("u1", None), (None, "i1"), (None, None)])


def test_linear_als(random_ratings):
    ratings, _ = random_ratings
    model = factors.fit_linear_als(ratings, 3, 3)
    base = bias.fit_bias(ratings, "als", 3, 1.0)
    error = lambda m: T.predict(m, ratings, bound=False).agg(F.avg(F.pow(F.col("rating") - F.col("rating_pred"), 2))).first()[0]
    assert error(model) < error(base)


def test_linear_als_joins_a_rating_once_per_side(random_ratings, monkeypatch):
    """ALS reads its input twice: it is held, and biases and numbers come with one join per side."""
    from pyspark.ml.recommendation import ALS

    seen, fit = [], ALS.fit

    def look(self, rest):
        seen.append((rest.storageLevel.useMemory, rest._jdf.queryExecution().analyzed().toString().count("Join "), rest.count()))
        return fit(self, rest)

    monkeypatch.setattr(ALS, "fit", look)
    factors.fit_linear_als(random_ratings[0], 3, 2)
    assert seen == [(True, 2, random_ratings[0].count())]


@pytest.mark.parametrize("kernel", ["linear", "sigmoid", "rbf"])
def test_predictions_in_cells_equal_joins(spark, monkeypatch, kernel):
    vector = lambda key, salt: factors.random_normals(key, 3, 0.1, 0.5, salt).alias("factors")
    users = spark.range(30).select(F.concat(F.lit("u"), "id").alias("user_id"), (F.col("id") / 50).alias("bias"), vector("id", 1))
    items = spark.range(20).select(F.col("id").alias("item_id"), (F.col("id") / -40).alias("bias"), vector("id", 2))
    meta = {"kernel": kernel, "n_factors": 3, "gamma": 0.3, "global_mean": 2.5, "min_rating": 1, "max_rating": 5, "n_users": 30, "n_items": 20}
    model = Model("kernel_mf", {"users": users, "items": items}, meta)
    pairs = spark.range(33 * 23).select(
        F.when(F.col("id") % 33 != 32, F.concat(F.lit("u"), F.col("id") % 33)).alias("user_id"),
        F.when(F.col("id") % 23 != 22, F.col("id") % 23).alias("item_id"), F.col("id").alias("row"),
    )
    pairs = pairs.unionByName(pairs.filter("row = 5"))
    result = lambda: sorted(tuple(r) for r in factors.predict_factors(model, pairs, bound=False).select("row", "user_id", "item_id", "prediction_possible", "rating_pred").collect())
    want, calls, cells = result(), [], factors._predict_in_cells
    monkeypatch.setattr(bias, "LAID_OUT", 1)
    monkeypatch.setattr(bias, "BLOCKS", 3)
    monkeypatch.setattr(factors, "SCORED_AT_ONCE", 7)
    monkeypatch.setattr(factors, "_predict_in_cells", lambda *a: calls.append(1) or cells(*a))
    key = "spark.ratewise.broadcastBytes"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "0")
    try:
        got = result()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    assert calls and len(got) == 33 * 23 + 1 and [r[:4] for r in got] == [r[:4] for r in want]
    assert [r[4] for r in got] == pytest.approx([r[4] for r in want], abs=1e-12)


def test_predictions_in_cells_leave_the_table_of_pairs_as_it_is(spark, small_ratings, monkeypatch):
    """The first prediction used to add its columns to the schema that the table keeps, so a second one failed."""
    factors_of = lambda key: factors.random_normals(key, 2, 0.1, 0.5, 1).alias("factors")
    sides = {f"{s}s": small_ratings.select(f"{s}_id").distinct().select(f"{s}_id", F.lit(0.5).alias("bias"), factors_of(f"{s}_id")) for s in ("user", "item")}
    meta = {"kernel": "linear", "n_factors": 2, "gamma": 0.3, "global_mean": 2.5, "min_rating": 1, "max_rating": 5, "n_users": 2, "n_items": 2}
    pairs = small_ratings.select("user_id", "item_id", "rating")
    before, rows = list(pairs.schema.names), []
    for _ in range(2):
        rows.append(sorted(tuple(r) for r in factors._predict_in_cells(Model("kernel_mf", sides, meta), pairs, 2).collect()))
    assert pairs.schema.names == before and rows[0] == rows[1] and len(rows[0]) == 3


def test_candidates_are_scored_as_they_are(spark, small_ratings):
    """Neither made distinct nor joined back; without user or item the score is 0, and copies stay."""
    model = bias.fit_bias(small_ratings, "als", 2, 1.0)
    rows = [(1, "u1", "i1"), (2, "u1", "i1"), (3, None, "i1"), (4, "u2", None), (5, "u9", "i2"), (6, None, None), (7, "u2", "i2")]
    candidates = spark.createDataFrame(rows, "sim int, user_id string, item_id string")
    scored = T.model_score(model, candidates)
    assert scored.columns == ["user_id", "item_id", "sim", "model_score"]
    plan = scored._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join ") == 2 and "Distinct" not in plan and "Deduplicate" not in plan
    bu, bi = as_dict(model.users(), "user_id", "bias"), as_dict(model.items(), "item_id", "bias")
    want = {n: 4.0 + bu.get(u, 0.0) + bi.get(i, 0.0) if u and i else 0.0 for n, u, i in rows}
    assert as_dict(scored, "sim", "model_score") == pytest.approx(want) and scored.count() == 7
    wanted = candidates.filter("item_id = 'i2'")
    narrow = model.about(wanted)
    assert narrow.meta["n_items"] == 1 and [r["item_id"] for r in narrow.items().collect()] == ["i2"] and model.meta["n_items"] == 2
    assert as_dict(T.model_score(narrow, wanted), "sim", "model_score") == pytest.approx({n: want[n] for n in (5, 7)})


# --- all -----------------------------------------------------------------------------------------


def test_round_trip(spark, random_ratings, factor_model, tmp_path):
    ratings, _ = random_ratings
    factor_model.save(str(tmp_path / "m"))
    loaded = Model.load(spark, str(tmp_path / "m"))
    pairs = ratings.select("user_id", "item_id")
    want, got = (sorted(tuple(r) for r in T.predict(m, pairs).collect()) for m in (factor_model, loaded))
    assert want == got and loaded.history == factor_model.history and loaded.kind == "kernel_mf"


def test_dispatcher(small_ratings):
    with pytest.raises(ValueError, match="model must be one of"):
        T.fit_model("unknown", small_ratings)
    with pytest.raises(ValueError, match="Duplicate"):
        T.fit_model("baseline", small_ratings.unionByName(small_ratings))
    assert T.fit_model("item_cf", small_ratings).meta["n_neighbors"] == 50
    # without candidates the lists cover all items
    assert T.recommend(T.fit_model("user_cf", small_ratings), small_ratings).count() == 4


def test_neighbour_lists_from_candidates(small_ratings, spark):
    model = T.fit_model("item_cf", small_ratings)
    candidates = spark.createDataFrame([("u2", "i1"), ("u2", "i2")], "user_id string, item_id string")
    got = T.recommend(model, small_ratings, small_ratings, 5, candidates=candidates).collect()
    assert [(r["user_id"], r["item_id"], r["rank"]) for r in got] == [("u2", "i2", 1)]


@pytest.mark.parametrize("name", ["baseline", "item_cf", "kernel_mf"])
def test_ratings_that_are_no_numbers_are_not_learned(spark, name):
    from ratewise.contracts import invalid_ratings

    good = [("u1", "i1", "5"), ("u1", "i2", "3"), ("u2", "i1", "4")]
    clean, odd = (spark.createDataFrame(good + more, "user_id string, item_id string, rating string") for more in ([], [("u3", "i1", None), ("u2", "i2", "oops"), ("u2", "i9", "NaN")]))
    fits = [T.fit_model(name, rows, False, **({} if name == "item_cf" else {"n_epochs": 2})) for rows in (clean, odd)]
    pairs = clean.select("user_id", "item_id")
    want, got = (sorted((r["user_id"], r["item_id"], round(r["rating_pred"], 9)) for r in T.predict(m, pairs).collect()) for m in fits)
    assert want == got
    assert tuple(invalid_ratings(odd).first()) == (6, 3)


def test_ratings_are_stepped_in_hash_order_by_a_short_key(spark):
    """What is sent with a rating is eight bytes, and sorts as the hash it comes from."""
    from pyspark.sql import functions as F
    from ratewise.functions.text import hash_order
    from ratewise.operators.factors import _place

    rows = spark.range(2000).select(F.col("id").alias("u"), (F.col("id") * 7).alias("i"))
    got = rows.select("u", _place("43", "u", "i").alias("short"), hash_order("43", "u", "i").alias("whole"))
    assert got.schema["short"].dataType.simpleString() == "bigint"
    got = got.collect()
    assert [r["u"] for r in sorted(got, key=lambda r: r["short"])] == [r["u"] for r in sorted(got, key=lambda r: r["whole"])]

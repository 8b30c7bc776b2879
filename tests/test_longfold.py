"""Expected folds against a plain loop of expected steps."""

import numpy as np
import pytest

from ratewise.operators import factors, longfold
from ratewise.plans import train as T


def looped(x, y, start, lr, reg, n_epochs):
    """n_epochs * n expected steps, one after the other."""
    now = np.concatenate([[0.0], start])
    x = np.column_stack([np.ones(len(x)), x])
    for _ in range(n_epochs * len(x)):
        now = now - lr * (x.T @ (x @ now - y) / len(x) + reg * now)
    return now


def sums_of(x, y):
    x = np.column_stack([np.ones(len(x)), x])
    return np.concatenate([[len(x)], (x.T @ x).ravel(), x.T @ y])


@pytest.mark.parametrize("reg", [0.0, 0.02, 1.0])
@pytest.mark.parametrize("n", [1, 7, 200])
def test_closed_form_is_the_loop(reg, n):
    rng = np.random.default_rng(n)
    x, y, start = rng.normal(size=(n, 3)), rng.normal(size=n), rng.normal(size=3)
    got = longfold.solve(sums_of(x, y), np.concatenate([[0.0], start]), 0.01, reg, 4)
    assert got == pytest.approx(looped(x, y, start, 0.01, reg, 4), abs=1e-9)


def test_very_long_history_ends_at_the_ridge_solution():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(500, 2)), rng.normal(size=500)
    sums = sums_of(x, y) * 20_000  # ten million ratings
    got = longfold.solve(sums, np.zeros(3), 0.01, 0.1, 20)
    full = np.column_stack([np.ones(500), x])
    want = np.linalg.solve(full.T @ full / 500 + 0.1 * np.eye(3), full.T @ y / 500)
    assert got == pytest.approx(want)


@pytest.fixture(scope="module")
def model(random_ratings):
    return factors.fit_factors(random_ratings[0].filter("user_id < 20"), "linear", 3, 2, 0.05, 0.02)


@pytest.mark.parametrize("part, records", [(1_000_000, "10000"), (4, "10000"), (1_000_000, "3"), (4, "3")])
def test_fold_equals_the_loop_however_it_is_dealt(spark, random_ratings, model, part, records):
    ratings, dense = random_ratings
    items = {r["item_id"]: (r["bias"], list(r["factors"])) for r in model.items().collect()}
    starts = {
        r[0]: np.array(r[1])
        for r in ratings.select("user_id", factors.random_normals("user_id", 3, 0.0, 0.1, 42)).distinct().collect()
    }
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, records)
    try:
        rows = factors.fold_factor_users(model, ratings, 0.05, 3, method="expected", part=part).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted(r["user_id"] for r in rows) == sorted(set(np.nonzero(dense)[0]))
    for row in rows:
        known = [i for i in np.flatnonzero(dense[row["user_id"]]) if i in items]
        x = np.array([items[i][1] for i in known])
        y = np.array([dense[row["user_id"], i] - model.meta["global_mean"] - items[i][0] for i in known])
        want = looped(x, y, starts[row["user_id"]], 0.05, 0.02, 3)
        assert [row["bias"], *row["factors"]] == pytest.approx(want, abs=1e-8)


def test_edges(spark, random_ratings, model):
    ratings, _ = random_ratings
    none = T.update_users(model, ratings.limit(0), method="expected")
    assert none.users().count() == model.users().count()
    unknown = ratings.filter("user_id = 24").withColumn("item_id", ratings.item_id + 1000)
    assert T.fold_users(model, unknown, method="expected").count() == 0
    rbf = factors.fit_factors(ratings, "rbf", 2, 1, 0.05, 0.02)
    with pytest.raises(ValueError):
        T.update_users(rbf, ratings, method="expected")

import pytest
from pyspark.sql import functions as F

from ratewise.operators.ranking import minmax, rank_rows, top_k
from ratewise.operators.split import new_user_split, per_user_holdout
from ratewise.session import broadcast_if_small, ensure_checkpoint_dir


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds most rows."""
    return spark.range(5000).select(
        F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 10).alias("k"), F.pmod(F.xxhash64("id"), F.lit(997)).alias("v"), "id"
    )


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_rank_rows_equals_sorting(skewed, keys):
    got = {r["id"]: r["rank"] for r in rank_rows(skewed, keys, [F.desc("v"), F.asc("id")]).collect()}
    groups = {}
    for r in skewed.collect():
        groups.setdefault(r["k"] if keys else None, []).append((-r["v"], r["id"]))
    want = {i: n for rows in groups.values() for n, (_, i) in enumerate(sorted(rows), 1)}
    assert got == want


def test_top_k_prunes_before_the_shuffle(skewed):
    out = top_k(skewed, ["k"], [F.desc("v"), F.asc("id")], 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert out.count() == 3 * skewed.select("k").distinct().count()


def test_minmax_of_equal_values_is_zero(spark):
    rows = spark.createDataFrame([(1, 5.0), (1, 7.0), (2, 3.0), (2, 3.0)], "q int, x double")
    got = sorted((r[0], r[1]) for r in rows.select("q", minmax("x", ["q"])).collect())
    assert got == [(1, 0.0), (1, 1.0), (2, 0.0), (2, 0.0)]


def test_broadcast_needs_a_size(spark):
    hinted = lambda rows: "ResolvedHint" in broadcast_if_small(spark.range(3), rows)._jdf.queryExecution().analyzed().toString()
    assert hinted(1000) and not hinted(10**9)


def test_checkpoint_dir_of_the_session_is_kept(spark):
    assert ensure_checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()


def test_holdout(random_ratings):
    ratings, dense = random_ratings
    split = per_user_holdout(ratings, 2, 4.0).collect()
    by_user = {}
    for r in split:
        by_user.setdefault(r["user_id"], []).append(r)
    assert set(by_user) == {u for u in range(len(dense)) if (dense[u] > 0).sum() > 2}
    for rows in by_user.values():
        test = sorted(r["rating"] for r in rows if r["is_test"])
        assert len(test) == 2
        if sum(r["rating"] >= 4 for r in rows) >= 2:
            assert test[0] >= 4
        else:
            assert test == sorted(r["rating"] for r in rows)[-2:]


def test_new_user_split_halves_histories(random_ratings):
    ratings, dense = random_ratings
    rows = new_user_split(ratings, 0.2).collect()
    assert len(rows) == int((dense > 0).sum())
    parts = {}
    for r in rows:
        parts.setdefault(r["user_id"], []).append(r["part"])
    new = [p for p in parts.values() if "train" not in p]
    assert len(new) == round(0.2 * len(parts))
    assert all(set(p) == {"train"} for p in parts.values() if "train" in p)
    assert all(0 <= p.count("update") - p.count("test") <= 1 for p in new)

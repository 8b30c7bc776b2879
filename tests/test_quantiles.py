import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewise.operators.quantiles import exact_percentiles
from ratewise.operators.stats import data_health, describe

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize("seed", [1, 2])
def test_percentiles_equal_numpy(spark, seed):
    """A hot value, few different values, all different values, nulls, and one value only."""
    rng = np.random.default_rng(seed)
    n = 701 + seed
    hot = np.where(rng.random(n) < 0.4, 7.0, rng.normal(size=n) * 50)
    few, gaps = rng.integers(-3, 3, n), rng.random(n)
    rows = [(float(h), int(f), float(g) if g > 0.3 else None, 5 if i == 3 else None, None) for i, (h, f, g) in enumerate(zip(hot, few, gaps))]
    df = spark.createDataFrame(rows, "hot double, few int, gaps double, one int, none int").repartition(5)
    got = {r["measure"]: r["quantiles"] for r in exact_percentiles(df, {c: F.col(c) for c in df.columns}, SHARES).collect()}
    assert set(got) == {"hot", "few", "gaps", "one"}
    for name, values in (("hot", hot), ("few", few), ("gaps", gaps[gaps > 0.3]), ("one", [5.0])):
        assert got[name] == pytest.approx(list(np.quantile(values, SHARES)), abs=1e-9)


def test_describe_keeps_measures_without_values(spark):
    df = spark.createDataFrame([(1, None), (2, None), (4, None)], "a int, b int")
    got = {r["measure"]: r for r in describe(df, {"a": F.col("a"), "b": F.col("b")}, (0.5,)).collect()}
    assert (got["a"]["n"], got["a"]["min"], got["a"]["p50"], got["a"]["max"]) == (3, 1.0, 2.0, 4.0)
    assert (got["b"]["n"], got["b"]["p50"], got["b"]["max"]) == (0, None, None)
    assert describe(df.limit(0), {"a": F.col("a")}, (0.5,)).first()["n"] == 0
    near = describe(df, {"a": F.col("a")}, (0.5,), approximate=True).first()
    assert near["p50"] == 2.0


def test_health_from_histograms(spark):
    rows = [(u, i, 1.0) for u in range(10) for i in range(u + 1)]
    df = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    got = data_health(df, 0.2, 5).first()
    assert (got["n_ratings"], got["n_users"], got["n_items"]) == (55, 10, 10)
    assert got["sparsity"] == pytest.approx(0.45) and got["cold_user_share"] == pytest.approx(0.4)
    assert got["head_item_share"] == pytest.approx(19 / 55)
    empty = data_health(df.limit(0)).first()
    assert empty["n_ratings"] == 0 and empty["sparsity"] is None

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewise.operators import cells as C
from ratewise.operators.model import Model
from ratewise.operators.search import search_topk
from ratewise.operators.textindex import dense_index, load_index, search

LONG = "long, vec array<double>"


def frame(spark, array, key):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(array)], f"{key} {LONG}")


def lists(df):
    return {(r["query_id"], r["rank"]): (r["item_id"], round(r["sim"], 9)) for r in df.collect()}


@pytest.fixture(scope="module")
def groups(spark):
    """1,500 vectors around 30 directions, a third of them equal to the first one."""
    rng = np.random.default_rng(5)
    heart = rng.normal(size=(30, 12))
    points = heart[rng.integers(0, 30, 1500)] + 0.25 * rng.normal(size=(1500, 12))
    points[::3] = points[0]
    asked = heart[rng.integers(0, 30, 80)] + 0.25 * rng.normal(size=(80, 12))
    return frame(spark, asked, "query_id"), frame(spark, points, "item_id")


@pytest.fixture(scope="module")
def index(groups):
    return C.fit_cells(groups[1], 24, 16)


def test_every_row_is_in_one_block(groups, index):
    ids = [i for r in index.tables["blocks"].collect() for i in r["item_ids"]]
    assert sorted(ids) == list(range(1500))


@pytest.mark.parametrize("probes", [1, 5, 1000])
def test_exact_lists_equal_full_search(groups, index, probes):
    queries, items = groups
    assert lists(C.search_cells(index, queries, 10, probes, exact=True)) == lists(search_topk(queries, items, 10))


def test_small_blocks_and_packs(groups, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_BYTES", 40 * 12 * 8)
    monkeypatch.setattr(C, "PACK", 7)
    monkeypatch.setattr(C, "MATRIX", 100)
    queries, items = groups
    index = C.fit_cells(items, 24, 16)
    hot = index.tables["blocks"].groupBy("cell").count().agg(F.max("count")).first()[0]
    assert hot >= 10  # the cell of the copies is split
    assert lists(C.search_cells(index, queries, 7, 3, exact=True)) == lists(search_topk(queries, items, 7))


def test_recall_of_the_measured_probes(groups, index):
    """The probes measured on half of the queries reach the recall on the other half."""
    queries, items = groups
    probes = C.probes_for(index, queries.filter("query_id < 40"), 10, 0.97)
    assert 1 <= probes < 24
    others = queries.filter("query_id >= 40")
    want, got = (set(r) for r in (
        [tuple(x) for x in f.select("query_id", "item_id").collect()]
        for f in (search_topk(others, items, 10), C.search_cells(index, others, 10, probes))
    ))
    assert len(want & got) >= 0.95 * len(want)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    items = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", [nan, 1.0]), ("e", [1.0, None]), ("f", [inf, 0.0]), ("g", [0.0, 0.0])],
        "item_id string, vec array<double>",
    )
    asked = spark.createDataFrame([(1, [2.0, 1.0]), (2, None), (3, [nan, 0.0])], f"query_id {LONG}")
    index = C.fit_cells(items, 4)
    assert lists(C.search_cells(index, asked, 9, 1, exact=True)) == {(1, 1): ("a", 2.0), (1, 2): ("b", 1.0), (1, 3): ("g", 0.0)}
    assert C.search_cells(index, asked, 0).count() == 0
    empty = C.fit_cells(items.limit(0), 4)
    assert C.search_cells(empty, asked, 3, exact=True).count() == 0 and C.probes_for(empty, asked, 3) == 1
    with pytest.raises(Exception, match="different lengths"):
        C.search_cells(index, spark.createDataFrame([(1, [1.0])], f"query_id {LONG}"), 1).collect()


def test_dense_index_with_cells(spark, groups, tmp_path):
    queries, items = groups
    texts = items.select("item_id", F.lit("x").alias("text"))
    index = dense_index(texts, items.withColumnRenamed("vec", "embedding"), cells=24)
    index.save(str(tmp_path / "i"))
    loaded = load_index(spark, str(tmp_path / "i"))
    want = lists(search(loaded, queries, 5))
    assert lists(search(loaded, queries, 5, approximate=True, probes=24)) == want
    near = lists(search(loaded, queries, 5, approximate=True, probes=8))
    assert len({(q, v) for (q, _), v in near.items()} & {(q, v) for (q, _), v in want.items()}) >= 0.9 * len(want)
    plain = Model("index", {"vectors": index.tables["vectors"]}, {"index_type": "dense"})
    with pytest.raises(ValueError, match="cells"):
        search(plain, queries, 5, approximate=True)

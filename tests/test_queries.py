"""Registered queries against their SQL on the smallest data (tools/check.py runs all of them)."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "s6_movielens_items", "p7_j8_metadata_limits", "a13_data_health", "w1_m2_top10_bias", "j7_m9_item_similarity_edges",
    "m9_m11_predict_item_item", "t3_j9_w2_sparse_top50", "e5_evaluate_topk", "e17_e9_case_reports", "q1_stream_fold_in",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SAMPLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    result = duck.execute(entry.oracle_sql()[name])
    want = rows_of([c[0] for c in result.description], result.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "item_id", "rating_pred", "rank"] and df.limit(1).count() == 1

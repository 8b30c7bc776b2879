"""Extendible hashing: every shard fits, and no shard is deeper than it must be."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ratewise.llm import shards

LIMIT = 1000


def place(spark, rows, **options):
    df = spark.createDataFrame([(k, "x" * n, "y") for k, n in rows], "key long, text string, bytes string")
    return shards.assign(df, "key", F.octet_length("text"), LIMIT, ["key", "bytes"], **options)


@pytest.mark.parametrize("bits", [3, 8])
def test_fits_and_is_minimal(spark, bits):
    rows = [(i, 37 * i % 400) for i in range(400)] + [(1000, 5000), (None, 300), (None, 200)]
    out = place(spark, rows, bits_per_round=bits).collect()
    assert Counter((r["key"], r["bytes"]) for r in out) == Counter(rows)
    assert all(r["bytes_source"] == "y" for r in out)
    size, count = Counter(), Counter()
    for r in out:
        size[r["depth"], r["prefix"], r["run"]] += r["bytes"]
        count[r["depth"], r["prefix"], r["run"]] += 1
    assert all(b <= LIMIT or count[s] == 1 for s, b in size.items())
    for depth, prefix, _ in size:  # the bucket above did not fit
        above = sum(b for (d, p, _), b in size.items() if d >= depth and p >> (d - depth + 1) == prefix >> 1)
        rows_above = sum(n for (d, p, _), n in count.items() if d >= depth and p >> (d - depth + 1) == prefix >> 1)
        assert depth == 0 or (above > LIMIT and rows_above > 1)


def test_same_key_is_cut_into_runs(spark):
    rows = [(5, 90)] * 60 + [(5, 1500)] * 2 + [(6, 10)]
    out = place(spark, rows).collect()
    assert Counter((r["key"], r["bytes"]) for r in out) == Counter(rows)
    groups = defaultdict(list)
    for r in out:
        groups[r["depth"], r["prefix"], r["run"]].append(r["bytes"])
    assert all(sum(g) <= LIMIT or len(g) == 1 for g in groups.values())
    assert sum(r["oversize"] for r in out) == 2


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, None), (1, None)], "key long, text string")
    out = shards.assign(df, "key", F.octet_length("text"), LIMIT).collect()
    assert [(r["bytes"], r["depth"]) for r in out] == [(0, 0)] * 2
    none = shards.assign(df.limit(0), "key", F.octet_length("text"), LIMIT)
    assert none.count() == 0 and shards.directory(none).count() == 0


def test_directory(spark):
    out = place(spark, [(i, 100) for i in range(50)])
    got = shards.directory(out).agg(F.sum("n_rows"), F.sum("bytes"), F.max("bytes")).first()
    assert got[0] == 50 and got[1] == 5000 and got[2] <= LIMIT


def test_kept_columns_with_inner_names(spark):
    inner = ["_sh_hash", "_sh_cell", "_value", "_part", "bytes", "b"]
    rows = spark.createDataFrame([(i % 3, "x" * 40, *range(10, 16)) for i in range(30)], "k long, t string, " + ", ".join(f"`{c}` long" for c in inner))
    out = shards.assign(rows, "k", F.octet_length("t"), 100, keep=["k", *inner]).collect()
    assert len(out) == 30 and all([r[f"{c}_source"] for c in inner] == list(range(10, 16)) for r in out)

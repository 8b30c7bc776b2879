"""The stream must end where one batch update ends, whatever the batches and replays."""

import pytest

from ratewise.operators import bias, factors
from ratewise.plans import train as T
from ratewise.streaming.foldin import UserFoldIn


def params(model):
    return {r["user_id"]: r["bias"] for r in model.users().collect()}


@pytest.mark.parametrize("kind", ["bias", "factors"])
def test_stream_equals_batch(spark, random_ratings, tmp_path, kind):
    ratings, _ = random_ratings
    old, new = ratings.filter("user_id < 18"), ratings.filter("user_id >= 15")
    if kind == "bias":
        model = bias.fit_bias(old, "als", 2, 1.0)
    else:
        model = factors.fit_factors(old, "linear", 3, 1, 0.05, 0.02)
    source = str(tmp_path / "in")
    for n in range(3):  # every history arrives in three files
        new.filter(f"item_id % 3 = {n}").coalesce(1).write.mode("append").parquet(source)
    job = UserFoldIn(model, str(tmp_path / "state"))
    stream = spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 1).parquet(source)
    job.start(stream, str(tmp_path / "progress")).awaitTermination()
    want = params(T.update_users(model, new))
    assert params(job.current(spark)) == pytest.approx(want)

    for batch in (1, 2):
        rows = spark.read.parquet(f"{tmp_path}/state/history/batch={batch}").collect()
        job.process(spark.createDataFrame(rows, new.schema), batch)
    assert job.history(spark).count() == new.count()
    assert params(job.current(spark)) == pytest.approx(want)


def test_merged_batches_give_the_same_and_are_not_read_again(spark, random_ratings, tmp_path):
    ratings, _ = random_ratings
    model = bias.fit_bias(ratings.filter("user_id < 18"), "als", 2, 1.0)
    new = ratings.filter("user_id >= 15")
    part = lambda n: new.filter(f"item_id % 4 = {n}")
    job = UserFoldIn(model, str(tmp_path / "state"), buckets=4)
    for n in range(2):
        job.process(part(n), n)
    before = params(job.current(spark))
    assert job.compact(spark) == 1 and job.compact(spark) == 1
    assert params(job.current(spark)) == pytest.approx(before)
    job.process(part(1).limit(3), 1)  # a replay of a merged batch
    for n in (2, 3):
        job.process(part(n), n)
    files = [name for name in job._read(spark, "pairs").inputFiles() if "/pairs/batch=" in name]
    assert files and all("batch=2" in name or "batch=3" in name for name in files)
    assert job.history(spark).count() == new.count()
    assert params(job.current(spark)) == pytest.approx(params(T.update_users(model, new)))


def test_a_batch_opens_only_the_buckets_of_its_users(spark, random_ratings, tmp_path):
    ratings, _ = random_ratings
    model = bias.fit_bias(ratings, "als", 2, 1.0)
    job = UserFoldIn(model, str(tmp_path / "state"), buckets=8)
    job.process(ratings, 0)
    one = ratings.filter("user_id = 4")
    job.process(one.withColumn("rating", one.rating + 0.5), 1)
    folders = {p.name for p in (tmp_path / "state" / "users" / "batch=1").glob("bucket=*")}
    assert len(folders) == 1
    plan = job.history(spark, 1, [int(folders.pop().split("=")[1])])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    got, first = job.current(spark), params(T.update_users(model, ratings))
    now = params(got)
    assert now.pop(4) > first.pop(4) and now == pytest.approx(first)


def test_expected_factors_by_stream(spark, random_ratings, tmp_path):
    ratings, _ = random_ratings
    model = factors.fit_factors(ratings.filter("user_id < 18"), "linear", 3, 1, 0.05, 0.02)
    new = ratings.filter("user_id >= 15")
    job = UserFoldIn(model, str(tmp_path / "state"), buckets=4, method="expected", part=4)
    for n in range(2):
        job.process(new.filter(f"item_id % 2 = {n}"), n)
    want = T.update_users(model, new, method="expected")
    vectors = lambda m: {r["user_id"]: list(r["factors"]) for r in m.users().collect()}
    assert params(job.current(spark)) == pytest.approx(params(want))
    got, expected = vectors(job.current(spark)), vectors(want)
    assert got.keys() == expected.keys() and all(got[u] == pytest.approx(expected[u]) for u in got)


def test_empty_batches_change_nothing(spark, random_ratings, tmp_path):
    ratings, _ = random_ratings
    model = bias.fit_bias(ratings.filter("user_id < 18"), "als", 2, 1.0)
    job = UserFoldIn(model, str(tmp_path / "state"), buckets=4)
    job.process(ratings.limit(0), 0)
    assert params(job.current(spark)) == pytest.approx(params(model))
    assert job.compact(spark) == 0
    job.process(ratings.filter("user_id >= 18"), 1)
    job.process(ratings.limit(0), 2)
    assert params(job.current(spark)) == pytest.approx(params(T.update_users(model, ratings.filter("user_id >= 18"))))

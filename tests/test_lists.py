"""Reranking, diversity, judging, metrics, and whole request batches against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from ratewise.functions import recipes as R
from ratewise.operators import coldstart, metrics, rerank
from ratewise.operators.diversify import select_diverse
from ratewise.operators.judge import judge, sanitize_violations
from ratewise.operators.recipes import recipe_metadata
from ratewise.operators.textindex import fit_tfidf
from ratewise.plans import evaluate as E
from ratewise.plans.retrieve import answer_questionnaires, questionnaire_meals, recommend_free_text

FOODS = ["tofu", "egg", "salmon", "chicken breast", "cheese", "rice", "soy sauce", "lemon", "beans", "olive oil"]


@pytest.fixture(scope="module")
def items(spark):
    rows = []
    for n in range(60):
        a, b, c = FOODS[n % 10], FOODS[(n * 3 + 1) % 10], FOODS[(n * 7 + 2) % 10]
        rows.append((n, f"title: dish {n}\ningredients: {a}; {b}; {c}\ndirections: Bake {n + 5} minutes."))
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def index(items):
    return fit_tfidf(items)


def test_greedy_selection(spark):
    rows = [
        (1, 0, 1, "a", 1.0, ["x", "y"]), (1, 0, 2, "b", 0.99, ["x", "y"]), (1, 0, 3, "c", 0.8, ["z"]),
        (1, 0, 4, "d", 0.8, ["z"]), (1, 1, 1, "a", 0.9, ["x", "y"]), (1, 1, 2, "e", 0.7, []),
    ]
    schema = "session_id long, meal_no int, position int, item_id string, score double, ingredients array<string>"
    got = [(r["meal_no"], r["rank"], r["item_id"]) for r in select_diverse(spark.createDataFrame(rows, schema), 2, 0.25).collect()]
    # b: 0.99 - 0.25 < c: 0.8; second meal: a: 0.9 - 0.25 = 0.65 < e: 0.7 (no ingredients, no overlap)
    assert sorted(got) == [(0, 1, "a"), (0, 2, "c"), (1, 1, "e"), (1, 2, "a")]
    none = select_diverse(spark.createDataFrame(rows, schema), 2, 0.25, forbid_repeat=True).collect()
    assert sorted((r["meal_no"], r["rank"], r["item_id"]) for r in none)[2:] == [(1, 1, "e")]
    assert select_diverse(spark.createDataFrame(rows, schema), 0).count() == 0


def test_generated_queries(items):
    rows = rerank.generate_queries(items).collect()
    assert rows == rerank.generate_queries(items.repartition(3)).orderBy("item_id", "query_no").collect() or sorted(rows) == sorted(
        rerank.generate_queries(items.repartition(3)).collect()
    )
    by_item = {}
    for r in rows:
        by_item.setdefault(r["item_id"], []).append(r["query"])
    meta = {int(r["item_id"]): r for r in recipe_metadata(items).collect()}
    for item, queries in by_item.items():
        assert 2 <= len(queries) <= 4 and len(set(queries)) == len(queries)
        base = queries[0]
        assert base.split(" with ")[0].rsplit(" ", 1)[1] in rerank.MEALS
        bucket = next(b for b in (30, 45, 60) if meta[item]["time_min"] <= b or b == 60)
        assert queries[1] == f"{base} under {bucket} minutes"
        assert (f"{base} no dairy" in queries) == meta[item]["has_dairy"]
    assert set(by_item) == set(range(60))


def test_hard_negatives_and_training(items, index):
    pairs = rerank.hard_negatives(index, rerank.generate_queries(items), 20, 4).collect()
    groups = {}
    for r in pairs:
        groups.setdefault(r["query_id"], []).append(r)
    for rows in groups.values():
        positive = [r for r in rows if r["label"] == 1]
        assert len(positive) == 1 and positive[0]["item_id"] == positive[0]["seed_id"]
        assert len(rows) <= 5 and all(r["item_id"] != r["seed_id"] for r in rows if r["label"] == 0)
    samples = rerank.training_samples(index, items, 20, 4)
    model, info = rerank.train_reranker(samples)
    assert info["n_samples"] == len(pairs) and info["pos_rate"] == pytest.approx(len(groups) / len(pairs))
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    scored = rerank.rerank_probability(model, samples)
    area = BinaryClassificationEvaluator(rawPredictionCol="rerank_p", labelCol="label").evaluate(scored)
    assert area > 0.6
    with pytest.raises(ValueError, match="no training samples"):
        rerank.train_reranker(samples.filter("false"))


def test_pair_features_by_hand(spark):
    text = "title: T\ningredients: chicken; cheese\ndirections: Bake 40 minutes."
    pairs = spark.createDataFrame([("high protein chicken under 30 minutes", 1, text, 0.5)], "query string, item_id long, text string, sim double")
    row = rerank.pair_features(pairs).first().asDict()
    assert [row[f] for f in rerank.FEATURES] == [
        0.5, 2 / 6, 1, 0, 0, 0, 0, 0, 0, 0, 40, 0, 1, 0, 0.0, 1, 2,
    ]
    known = spark.createDataFrame([("1", 20, 3.0, 1.0)], "item_id string, time_min int, protein_score double, low_calorie_score double")
    row = rerank.pair_features(pairs, known).first()
    assert (row["time_min"], row["time_ok"], row["protein_score"], row["protein_ok"]) == (20, 1, 3, 1)


def test_query_dedup(spark):
    rows = [(1, 1, " Egg  soup"), (1, 2, "egg soup "), (1, 3, " "), (1, 4, "b"), (1, 5, "c"), (1, 6, "d"), (1, 7, "e")]
    got = rerank.dedup_queries(spark.createDataFrame(rows, "item_id long, query_no int, query string")).collect()
    assert [(r["query_no"], r["query"]) for r in sorted(got, key=lambda r: r["query_no"])] == [(1, "Egg  soup"), (2, "b"), (3, "c"), (4, "d")]


@pytest.mark.parametrize(
    "must, avoid, text, relevance, violations",
    [
        ([], [], "tofu bowl", 2.0, []), (["tofu"], [], "tofu bowl", 4.0, []), (["egg"], [], "tofu bowl", 0.0, ["missing_must_include"]),
        (["tofu"], ["bowl"], "tofu bowl", 2.0, ["contains_avoid_term"]), ([], [], "nothing", 1.0, []),
    ],
)
def test_judge(spark, must, avoid, text, relevance, violations):
    row = spark.createDataFrame([("tofu please", text, must, avoid)], "query string, text string, must_include array<string>, avoid array<string>")
    got = judge(row).first()
    assert (got["relevance"], got["violations"]) == (relevance, violations)


def test_sanitizing(spark):
    row = spark.range(1).select(
        F.array(F.lit("contains_avoid_term"), F.lit("missing_must_include"), F.lit("other")).alias("v"),
        F.array().cast("array<string>").alias("m"), F.array(F.lit("x")).alias("a"),
    )
    assert row.select(sanitize_violations("v", "m", "a").alias("o")).first()["o"] == ["contains_avoid_term", "other"]


def test_ndcg_by_hand(spark):
    lists = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "user_id long, item_id long, rank int")
    test = spark.createDataFrame([(1, 11), (1, 99), (2, 10)], "user_id long, item_id long")
    row = metrics.ranking_metrics(lists, test, 3).first()
    gain = 1 / math.log2(3)
    assert gain == pytest.approx(0.63093, abs=1e-5)
    assert row["n_users"] == 2 and row["ndcg_retrieved"] == pytest.approx(gain / 2)
    assert row["ndcg_standard"] == pytest.approx(gain / (1 + 1 / math.log2(3)) / 2)
    assert (row["precision"], row["recall"]) == (pytest.approx(1 / 6), pytest.approx(0.25))
    one = metrics.ranking_metrics(lists, test, 3, users=lists.select("user_id").distinct()).first()
    assert one["n_users"] == 1 and one["recall"] == 0.5


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "user_id long, item_id long, rank int, rating double")
    row = metrics.top_n_metrics(empty, empty).first()
    assert (row["n_users"], row["precision"], row["f1_score"]) == (0, 0.0, 0.0)
    assert metrics.ranking_metrics(empty, empty, 5).first()["ndcg_retrieved"] == 0.0


def test_list_diversity(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (1, ["b", "c"]), (1, ["b", "c"]), (2, ["a"]), (3, []), (3, ["a"])], "l long, ingredients array<string>")
    got = {r["l"]: r["diversity"] for r in metrics.intra_list_diversity(rows, "l").collect()}
    assert got == {1: pytest.approx(1 - (1 / 3 + 1 / 3 + 1) / 3), 2: 1.0, 3: 1.0}


def test_hybrid_list(spark):
    lists = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 9, 3)], "user_id long, item_id long, rank int")
    ratings = spark.createDataFrame([(u, i, 1.0) for i in (5, 7, 9) for u in range(i)], "user_id long, item_id long, rating double")
    got = coldstart.hybrid_list(lists, ratings, 4, 0.5).orderBy("rank").collect()
    assert [(r["item_id"], r["source"]) for r in got] == [(7, "model"), (8, "model"), (9, "popular"), (5, "popular")]
    users = spark.createDataFrame([(2,), (1,)], "user_id long")
    new = coldstart.hybrid_list(lists, ratings, 2, 0.5, users).filter("user_id = 2").orderBy("rank").collect()
    assert [(r["item_id"], r["source"]) for r in new] == [(9, "popular"), (7, "popular")]


def test_questionnaire_batch(spark, items, index):
    schema = (
        "request_id long, goal string, meal string, cuisines array<string>, dietary array<string>, must_include string, "
        "avoid string, max_time int, extra string, daily_plan boolean, include_snack boolean"
    )
    requests = spark.createDataFrame(
        [
            (1, "随便推荐", "晚餐", [], [], "tofu", "milk; salmon", 30, "beans", False, False),
            (2, "增肌/高蛋白", "不限", [], [], "", "", 0, "egg chicken beans", True, True),
        ],
        schema,
    )
    assert questionnaire_meals(requests).count() == 5
    meta = recipe_metadata(items)
    facts = {int(r["item_id"]): r for r in meta.collect()}
    texts = dict(items.collect())
    strict = dict(strict_must_include=True, strict_high_protein=True, strict_low_calorie=True)
    got = answer_questionnaires(requests, index, meta, k=4, per_meal_k=2, **strict).collect()
    first = [r for r in got if r["request_id"] == 1]
    assert 0 < len(first) <= 4 and sorted(r["rank"] for r in first) == list(range(1, len(first) + 1))
    for r in first:
        text = texts[r["item_id"]]
        assert "tofu" in text and "salmon" not in text and "cheese" not in text and r["time_min"] <= 30
    second = [r for r in got if r["request_id"] == 2]
    assert {r["meal"] for r in second} == {"早餐", "午餐", "晚餐", "加餐/零食"}
    assert all(facts[r["item_id"]]["protein_score"] >= 2 for r in second)
    assert all(r["preview"].startswith("title: dish") and "\n" not in r["preview"] for r in got)

    # by default only time and avoid terms filter; every switch changes what passes
    def passed(**switches):
        rows = answer_questionnaires(requests, index, meta, k=1000, per_meal_k=1000, candidate_k=1000, fill=True, **switches).collect()
        return {(r["request_id"], r["item_id"]) for r in rows}

    usual, everything = passed(), passed(strict_time=False, strict_exclude=False)
    own = {i for r, i in usual if r == 1}
    assert any("tofu" not in texts[i] for i in own) and not any("salmon" in texts[i] or "cheese" in texts[i] for i in own)
    assert any(facts[i]["protein_score"] < 2 for r, i in usual if r == 2) and usual < everything
    assert passed(strict_must_include=True) < usual and passed(strict_high_protein=True) < usual
    assert any("cheese" in texts[i] for r, i in passed(expand_avoid=False) if r == 1)

    model, _ = rerank.train_reranker(rerank.training_samples(index, items, 20, 4))
    ranked = answer_questionnaires(requests, index, meta, reranker=model, k=4, per_meal_k=2).collect()
    assert {r["request_id"] for r in ranked} == {1, 2} and all(-0.3 <= r["score"] <= 1.0 for r in ranked)


def test_free_text_without_model(spark, index):
    asked = spark.createDataFrame([("q1", "tofu and beans")], "query_id string, text string")
    got = recommend_free_text(asked, index, k=5).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5]
    assert [r["sim"] for r in got] == sorted((r["sim"] for r in got), reverse=True)
    assert {r["model_score"] for r in got} == {0.0} and got[0]["score"] == pytest.approx(0.3)


def test_case_reports(spark, index):
    rows = [("a", "tofu dinner", "", "", 3, 10, True), ("b", "salmon", "", "salmon", 3, 10, True), ("c", "salmon", "", "salmon", 3, 10, False)]
    cases = spark.createDataFrame(rows, "case_id string, query string, must_include string, avoid string, k int, candidate_k int, apply_filters boolean")
    got = {r["case_id"]: r for r in E.case_reports(cases, index).collect()}
    assert got["a"]["n_retrieved"] == 10 and got["a"]["n_after_filter"] == 3 and len(got["a"]["items"]) == 3
    assert got["b"]["n_after_filter"] == 0 and got["b"]["diversity"] == 1.0 and got["b"]["violation_rate"] == 0.0
    assert got["c"]["violation_rate"] == 1.0 and got["c"]["items"][0]["violations"] == ["contains_avoid_term"]


def test_cross_validation_and_grid(random_ratings):
    ratings, dense = random_ratings
    from ratewise.operators.bias import fit_bias

    folds = E.cross_validate(ratings, lambda rows: fit_bias(rows, "als", 1), 3)
    assert folds.agg(F.sum("n")).first()[0] == int((dense > 0).sum())
    row = E.cv_summary(folds).first()
    assert row["ci_low"] <= row["rmse_mean"] <= row["ci_high"]
    grid = E.grid_search(ratings, "baseline", {"reg": [0.1, 5.0]}, folds=2, method="als", n_epochs=1).collect()
    assert sorted(r["rank"] for r in grid) == [1, 2]
    assert E.parameter_grid({"a": [1, 2], "b": [3]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]


def test_fits_of_a_grid_share_the_broadcast_bound(random_ratings, monkeypatch):
    """What the driver may collect for broadcasts does not grow with the number of fits."""
    from ratewise.operators import bias
    from ratewise.session import broadcast_bytes

    ratings, _ = random_ratings
    spark = ratings.sparkSession
    before, seen = broadcast_bytes(spark), []
    real = bias.broadcast_if_small
    monkeypatch.setattr(bias, "broadcast_if_small", lambda df, *size: seen.append(broadcast_bytes(df.sparkSession)) or real(df, *size))
    E.grid_search(ratings, "baseline", {"reg": [0.1, 5.0]}, folds=2, method="als", n_epochs=1).collect()
    assert seen and set(seen) == {before // 4} and broadcast_bytes(spark) == before


def test_picks_hand_on_columns_of_their_candidate(spark):
    """What the lists need later travels with the pick; the candidates are not joined a second time."""
    rows = [("s", 0, p, p * 10, 1.0 - p / 10, [f"x{p}"], f"meal {p}", p / 7) for p in range(5)]
    schema = "session_id string, meal_no int, position int, item_id long, score double, ingredients array<string>, meal_name string, sim double"
    got = select_diverse(spark.createDataFrame(rows, schema), 3, 0.25, keep=["meal_name", "sim"]).collect()
    assert sorted((r["rank"], r["item_id"], r["meal_name"], r["sim"]) for r in got) == [(p + 1, p * 10, f"meal {p}", p / 7) for p in range(3)]

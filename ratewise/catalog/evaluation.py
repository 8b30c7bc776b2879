"""Queries over splits, metrics, model selection, and the streaming fold-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bias, metrics
from ..operators.split import holdout_split, new_user_split, per_user_holdout
from ..operators.stats import new_user_cohort, popular_items
from ..plans import evaluate as E
from ..plans import train as T
from ..streaming.foldin import UserFoldIn
from .base import (
    EMBEDDINGS, RATINGS, TRAIN_TEST, als_ctes, bucket_sql, embeddings, hash_sql, query, r6, ratings, scratch, shared, table, with_,
)
from .data import cohort_ctes
from .models import als3, als_train2, fold_items_model, fold_steps_sql, folded_columns

_MODEL = [RATINGS, *TRAIN_TEST, *als_ctes(2, source="train")]
_CLIPPED = "least(5.0, greatest(0.0, (SELECT m FROM mu) + coalesce(bu, 0) + coalesce(bi, 0)))"
_SCORED = f"scored AS (SELECT test.*, {_CLIPPED} AS p FROM test LEFT JOIN bu2 USING (user_id) LEFT JOIN bi2 USING (item_id))"


def _split(spark, sf):
    return holdout_split(ratings(spark, sf), 0.2, 42)


def _scored(spark, sf):
    return T.predict(als_train2(spark, sf), _split(spark, sf)[1])


@query(
    "e1_holdout_split",
    with_(RATINGS, *TRAIN_TEST) + "SELECT 'train' AS part, user_id, item_id FROM train UNION ALL SELECT 'test', user_id, item_id FROM test",
)
def _(spark, sf):
    train, test = _split(spark, sf)
    named = lambda df, part: df.select(F.lit(part).alias("part"), "user_id", "item_id")
    return named(train, "train").unionByName(named(test, "test"))


@query(
    "e2_new_user_split",
    with_(
        RATINGS, f"u AS (SELECT user_id, row_number() OVER (ORDER BY {hash_sql('42', 'user_id')}, user_id) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM ratings))",
        "nu AS (SELECT user_id FROM u WHERE rk <= round(n * 0.2))",
        f"h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {hash_sql('half42', 'user_id', 'item_id')}, item_id) AS r FROM ratings SEMI JOIN nu USING (user_id))",
    )
    + "SELECT user_id, item_id, rating, 'train' AS part FROM ratings ANTI JOIN nu USING (user_id) UNION ALL "
    "SELECT user_id, item_id, rating, CASE WHEN r % 2 = 1 THEN 'update' ELSE 'test' END FROM h",
)
def _(spark, sf):
    return new_user_split(ratings(spark, sf), 0.2)


@query("e3_rmse", with_(*_MODEL, _SCORED) + "SELECT count(*) AS n, round(sqrt(avg(pow(rating - p, 2))), 6) AS rmse FROM scored")
def _(spark, sf):
    return metrics.rmse(_scored(spark, sf)).select("n", r6("rmse"))


_LISTS = [
    "cand AS (SELECT user_id, item_id, bi FROM (SELECT DISTINCT user_id FROM test) CROSS JOIN bi2 ANTI JOIN train USING (user_id, item_id))",
    "lists AS MATERIALIZED (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(bi, 9) DESC, item_id) AS rank FROM cand QUALIFY rank <= 10)",
]
_TOPN = [
    "rel AS (SELECT user_id, item_id FROM test WHERE rating >= 4)",
    "pu AS (SELECT user_id, nrec, nrel, coalesce(nhit, 0) AS nhit FROM (SELECT user_id, count(*) AS nrec FROM lists GROUP BY 1) "
    "JOIN (SELECT user_id, count(*) AS nrel FROM rel GROUP BY 1) USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS nhit FROM lists JOIN rel USING (user_id, item_id) GROUP BY 1) USING (user_id))",
    "topn AS (SELECT count(*) AS n_users, avg(nhit / nrec) AS p, avg(nhit / nrel) AS r FROM pu)",
]
_F1 = "CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END"


def _lists(spark, sf):
    train, test = _split(spark, sf)
    return T.recommend(als_train2(spark, sf), test.select("user_id"), train, 10)


@query(
    "e4_top_n_metrics",
    with_(*_MODEL, *_LISTS, *_TOPN)
    + f"SELECT n_users, round(p, 6) AS precision, round(r, 6) AS recall, round({_F1}, 6) AS f1_score FROM topn",
)
def _(spark, sf):
    out = metrics.top_n_metrics(_lists(spark, sf), _split(spark, sf)[1])
    return out.select("n_users", r6("precision"), r6("recall"), r6("f1_score"))


def holdout_ctes(source: str, n_test: int, threshold: float) -> list[str]:
    h = hash_sql("42", "user_id", "item_id")
    return [
        f"cn AS (SELECT user_id, count(*) AS n, count(*) FILTER (rating >= {threshold}) AS pos FROM {source} GROUP BY 1 HAVING count(*) > {n_test})",
        f"ho AS MATERIALIZED (SELECT user_id, item_id, rating, row_number() OVER (PARTITION BY user_id ORDER BY "
        f"CASE WHEN pos >= {n_test} THEN CASE WHEN rating >= {threshold} THEN 1.0 ELSE 0.0 END ELSE rating END DESC, "
        f"CASE WHEN pos >= {n_test} THEN {h} END, item_id) <= {n_test} AS is_test FROM {source} JOIN cn USING (user_id))",
        "htrain AS MATERIALIZED (SELECT user_id, item_id, rating FROM ho WHERE NOT is_test)",
        "htest AS MATERIALIZED (SELECT user_id, item_id, rating FROM ho WHERE is_test)",
    ]


@query("w4_per_user_holdout", with_(RATINGS, *holdout_ctes("ratings", 5, 4.0)) + "SELECT user_id, item_id, rating, is_test FROM ho")
def _(spark, sf):
    return per_user_holdout(ratings(spark, sf), 5, 4.0)


_RANKED = [
    "hits AS (SELECT l.user_id, l.rank, t.item_id IS NOT NULL AS hit FROM lists l LEFT JOIN htest t ON t.user_id = l.user_id AND t.item_id = l.item_id)",
    "hu AS (SELECT user_id, count(*) AS nrec, count(*) FILTER (hit) AS nhit, coalesce(sum(1 / log2(rank + 1)) FILTER (hit), 0) AS dcg FROM hits GROUP BY 1)",
    "ideal AS (SELECT n, sum(1 / log2(g + 1)) AS idcg FROM (SELECT unnest(generate_series(0, 10)) AS n) LEFT JOIN (SELECT unnest(generate_series(1, 10)) AS g) ON g <= n GROUP BY 1)",
    "tu AS (SELECT user_id, count(*) AS nrel FROM htest GROUP BY 1)",
    "pu AS (SELECT tu.user_id, coalesce(nhit / nrec, 0) AS p, coalesce(nhit, 0) / nrel AS r, CASE WHEN coalesce(nhit, 0) > 0 THEN dcg / a.idcg ELSE 0 END AS nr, "
    "coalesce(dcg, 0) / b.idcg AS ns FROM tu LEFT JOIN hu USING (user_id) JOIN ideal a ON a.n = coalesce(nhit, 0) JOIN ideal b ON b.n = least(nrel, 10))",
]
_RANKING = "round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(nr), 6) AS ndcg_retrieved, round(avg(ns), 6) AS ndcg_standard FROM pu"


def _round_ranking(out):
    return out.select("n_users", *[r6(c) for c in ("precision", "recall", "ndcg_retrieved", "ndcg_standard")])


@query(
    "e5_evaluate_topk",
    with_(
        RATINGS, *holdout_ctes("ratings", 5, 4.0),
        "fit AS MATERIALIZED (SELECT user_id, item_id, rating FROM ratings ANTI JOIN htest USING (user_id, item_id))",
        *als_ctes(2, source="fit"),
        "cand AS (SELECT user_id, item_id, bi FROM (SELECT DISTINCT user_id FROM htest) CROSS JOIN bi2 ANTI JOIN htrain USING (user_id, item_id))",
        _LISTS[1], *_RANKED,
    )
    + f"SELECT count(*) AS n_users, {_RANKING}",
)
def _(spark, sf):
    fit = lambda rows: bias.fit_bias(rows, "als", 2, 1.0)
    return _round_ranking(E.evaluate_topk(ratings(spark, sf), fit, 10, 4.0, 5))


_PROFILE_RATINGS = (
    "pr AS MATERIALIZED (SELECT user_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS item_id, max(1 + event_id % 5)::DOUBLE AS rating FROM events GROUP BY 1, 2)"
)


def _profile_ratings(spark, sf):
    rows = table(spark, sf, "events").select(
        "user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"), (1 + F.col("event_id") % 5).cast("double").alias("r")
    )
    return rows.groupBy("user_id", "item_id").agg(F.max("r").alias("rating"))


@query(
    "e6_evaluate_hybrid",
    with_(
        RATINGS, *als_ctes(3), _PROFILE_RATINGS, *holdout_ctes("pr", 3, 4.0),
        "v AS MATERIALIZED (SELECT vec_id AS item_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)",
        "pn AS (SELECT user_id FROM htrain WHERE item_id IN (SELECT item_id FROM v) GROUP BY 1 HAVING count(*) >= 3)",
        "pm AS (SELECT user_id, d, avg(x) AS x FROM htrain JOIN v USING (item_id) JOIN pn USING (user_id) GROUP BY 1, 2)",
        "pf AS MATERIALIZED (SELECT user_id, d, x / sqrt(sum(x * x) OVER (PARTITION BY user_id)) AS x FROM pm)",
        "sm AS (SELECT user_id, item_id, sum(pf.x * v.x) AS sim FROM pf JOIN v USING (d) GROUP BY 1, 2)",
        "nr AS (SELECT * FROM sm QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(sim, 9) DESC, item_id) <= 120)",
        "fr AS (SELECT user_id, item_id, sim, (SELECT m FROM mu) + coalesce(bu, 0) + coalesce(bi, 0) AS ms FROM nr ANTI JOIN htrain USING (user_id, item_id) "
        "LEFT JOIN bu3 USING (user_id) LEFT JOIN bi3 USING (item_id))",
        "lm AS (SELECT user_id, min(sim) AS lo, max(sim) AS hi, min(ms) AS mlo, max(ms) AS mhi FROM fr GROUP BY 1)",
        "sc AS (SELECT user_id, item_id, sim, 0.7 * CASE WHEN mhi - mlo < 1e-8 THEN 0 ELSE (ms - mlo) / (mhi - mlo) END + (1 - 0.7) * "
        "CASE WHEN hi - lo < 1e-8 THEN 0 ELSE (sim - lo) / (hi - lo) END AS score FROM fr JOIN lm USING (user_id))",
        "lists AS MATERIALIZED (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, round(sim, 9) DESC, item_id) AS rank FROM sc QUALIFY rank <= 10)",
        *_RANKED,
    )
    + f"SELECT count(*) AS n_users, {_RANKING} WHERE user_id IN (SELECT user_id FROM lists)",
)
def _(spark, sf):
    out = E.evaluate_hybrid(
        _profile_ratings(spark, sf), embeddings(spark, sf), als3(spark, sf), k=10, candidate_k=120, alpha=0.7, n_test=3
    )
    return _round_ranking(out)


_CATALOGUE = (
    "cat AS (SELECT count(DISTINCT item_id) AS n_recommended, count(DISTINCT item_id) / (SELECT count(DISTINCT item_id) FROM train) AS coverage, "
    "count(DISTINCT item_id) / (10 * (SELECT count(DISTINCT user_id) FROM test)) AS diversity FROM lists)"
)


@query(
    "e7_e8_coverage_diversity",
    with_(*_MODEL, *_LISTS, _CATALOGUE) + "SELECT n_recommended, round(coverage, 6) AS coverage, round(diversity, 6) AS diversity FROM cat",
)
def _(spark, sf):
    train, test = _split(spark, sf)
    n_users = test.agg(F.countDistinct("user_id")).scalar()
    out = metrics.catalogue_metrics(_lists(spark, sf), train, n_users, 10)
    return out.select("n_recommended", r6("coverage"), r6("diversity"))


def _cv_ctes(folds: int, epochs: int, reg: float, name: str) -> list[str]:
    """``cv{name}(fold, n, rmse)`` of the bias model; every relation carries the name."""
    ctes, parts = [], []
    bucket = bucket_sql("fold42", folds, "user_id", "item_id")
    for f in range(folds):
        tag = f"{name}_{f}"
        ctes += [f"tr{tag} AS MATERIALIZED (SELECT * FROM ratings WHERE {bucket} <> {f})", f"te{tag} AS (SELECT * FROM ratings WHERE {bucket} = {f})"]
        for cte in als_ctes(epochs, reg, source=f"tr{tag}"):
            cte = cte.replace("mu AS", f"mu{tag} AS").replace("FROM mu)", f"FROM mu{tag})")
            for e in range(1, epochs + 1):
                cte = cte.replace(f"bu{e} ", f"bu{tag}_{e} ").replace(f"bi{e} ", f"bi{tag}_{e} ")
            ctes.append(cte)
        parts.append(
            f"SELECT {f} AS fold, count(*) AS n, sqrt(avg(pow(rating - least(5.0, greatest(0.0, (SELECT m FROM mu{tag}) + coalesce(bu, 0) + coalesce(bi, 0))), 2))) AS rmse "
            f"FROM te{tag} LEFT JOIN bu{tag}_{epochs} USING (user_id) LEFT JOIN bi{tag}_{epochs} USING (item_id)"
        )
    return [*ctes, f"cv{name} AS ({' UNION ALL '.join(parts)})"]


def _folds(spark, sf):
    return shared(
        spark, sf, "folds", lambda: E.cross_validate(ratings(spark, sf), lambda rows: bias.fit_bias(rows, "als", 2, 1.0), 3)
    )


@query("e10_cross_validation", with_(RATINGS, *_cv_ctes(3, 2, 1.0, "x")) + "SELECT fold, n, round(rmse, 6) AS rmse FROM cvx")
def _(spark, sf):
    return _folds(spark, sf).select("fold", "n", r6("rmse"))


@query(
    "e10_cross_validation_summary",
    with_(RATINGS, *_cv_ctes(3, 2, 1.0, "x"))
    + "SELECT round(avg(rmse), 6) AS rmse_mean, round(stddev_pop(rmse), 6) AS rmse_std, round(avg(rmse) - 1.96 * stddev_pop(rmse), 6) AS ci_low, "
    "round(avg(rmse) + 1.96 * stddev_pop(rmse), 6) AS ci_high FROM cvx",
)
def _(spark, sf):
    out = E.cv_summary(_folds(spark, sf))
    return out.select(*[r6(c) for c in out.columns])


_GRID = [(f"g{e}{i}", e, reg) for i, reg in enumerate((0.02, 1.0)) for e in (1, 2)]


@query(
    "e11_grid_search",
    with_(
        RATINGS, *[cte for name, e, reg in _GRID for cte in _cv_ctes(2, e, reg, name)],
        "gr AS (" + " UNION ALL ".join(
            f"SELECT '{{\"n_epochs\": {e}, \"reg\": {reg}}}' AS params, avg(rmse) AS m, stddev_pop(rmse) AS s FROM cv{name}" for name, e, reg in _GRID
        ) + ")",
    )
    + "SELECT params, round(m, 6) AS rmse_mean, round(s, 6) AS rmse_std, CAST(row_number() OVER (ORDER BY round(m, 9), params) AS INTEGER) AS rank FROM gr",
)
def _(spark, sf):
    grid = {"reg": [0.02, 1.0], "n_epochs": [1, 2]}
    out = E.grid_search(ratings(spark, sf), "baseline", grid, folds=2, method="als")
    return out.select("params", r6("rmse_mean"), r6("rmse_std"), "rank")


_ARM = f"CASE WHEN {bucket_sql('arm42', 10000, 'user_id', 'item_id')} < 5000 THEN 'a' ELSE 'b' END"
_ARMS = [
    f"arms AS (SELECT {_ARM} AS arm, rating, CASE WHEN {_ARM} = 'a' THEN (SELECT m FROM mu) ELSE p END AS p FROM scored)",
    "pa AS (SELECT arm, count(*) AS n, sqrt(avg(pow(rating - p, 2))) AS rmse, avg(CASE WHEN p >= 3.2 THEN 1.0 ELSE 0.0 END) AS ctr FROM arms GROUP BY 1)",
]


def _arms(spark, sf):
    rows = metrics.arm_column(_scored(spark, sf))
    mean = als_train2(spark, sf).meta["global_mean"]
    shown = F.when(F.col("arm") == "a", F.lit(mean)).otherwise(F.col("rating_pred"))
    return metrics.arm_metrics(rows.withColumn("rating_pred", shown), 3.2)


@query("e12_arm_metrics", with_(*_MODEL, _SCORED, *_ARMS) + "SELECT arm, n, round(rmse, 6) AS rmse, round(ctr, 6) AS ctr FROM pa")
def _(spark, sf):
    return _arms(spark, sf).select("arm", "n", r6("rmse"), r6("ctr"))


@query(
    "e12_arm_lift",
    with_(*_MODEL, _SCORED, *_ARMS)
    + "SELECT round((a.rmse - b.rmse) / a.rmse * 100, 6) AS rmse_gain_pct, round((b.ctr - a.ctr) / nullif(a.ctr, 0) * 100, 6) AS ctr_gain_pct "
    "FROM pa a JOIN pa b ON a.arm = 'a' AND b.arm = 'b'",
)
def _(spark, sf):
    return metrics.arm_lift(_arms(spark, sf)).select(r6("rmse_gain_pct"), r6("ctr_gain_pct"))


@query(
    "e13_cohort_rmse",
    with_(*_MODEL, _SCORED, *cohort_ctes("train"), "fl AS (SELECT s.*, user_id IN (SELECT user_id FROM cohort) AS new FROM scored s)")
    + "SELECT count(*) FILTER (new) AS n_new, count(*) FILTER (NOT new) AS n_old, round(sqrt(avg(pow(rating - p, 2)) FILTER (new)), 6) AS rmse_new, "
    "round(sqrt(avg(pow(rating - p, 2)) FILTER (NOT new)), 6) AS rmse_old, "
    "round(sqrt(avg(pow(rating - p, 2)) FILTER (new)) - sqrt(avg(pow(rating - p, 2)) FILTER (NOT new)), 6) AS rmse_gap FROM fl",
)
def _(spark, sf):
    out = metrics.cohort_rmse(_scored(spark, sf), new_user_cohort(_split(spark, sf)[0]))
    return out.select("n_new", "n_old", r6("rmse_new"), r6("rmse_old"), r6("rmse_gap"))


_FULL = (
    "SELECT round((SELECT sqrt(avg(pow(rating - p, 2))) FROM scored), 6) AS rmse, round(p, 6) AS precision, round(r, 6) AS recall, "
    f"round({_F1}, 6) AS f1_score, round(coverage, 6) AS coverage, round(diversity, 6) AS diversity, 'bias' AS model_name FROM topn CROSS JOIN cat"
)


@query("e18_evaluate_model", with_(*_MODEL, _SCORED, *_LISTS, *_TOPN, _CATALOGUE) + _FULL)
def _(spark, sf):
    train, test = _split(spark, sf)
    out = E.evaluate_model("bias", als_train2(spark, sf), train, test, 10)
    return out.select("model_name", *[r6(c) for c in out.columns if c != "model_name"])


def _compared(spark, sf):
    from ..operators.content import fit_content
    from ..operators.factors import fit_factors

    train, test = _split(spark, sf)

    def build():
        models = {
            "bias": als_train2(spark, sf), "user mean": fit_content(train),
            "factors": fit_factors(train, "linear", 4, 1, 0.02, 0.02),
        }
        return E.compare_models(models, train, test)

    return shared(spark, sf, "compared", build)


@query("e18_compare_models")
def _(spark, sf):
    return _compared(spark, sf)


@query(
    "e14_normalized_comparison",
    with_("rows AS (SELECT l_returnflag AS model_name, avg(l_discount) AS rmse, avg(l_tax) AS precision FROM lineitem GROUP BY 1)")
    + "SELECT model_name, round(rmse, 6) AS rmse, round(precision, 6) AS precision, "
    "round(1 - (rmse - (SELECT min(rmse) FROM rows)) / ((SELECT max(rmse) - min(rmse) FROM rows) + 1e-10), 5) AS rmse_norm, "
    "round((precision - (SELECT min(precision) FROM rows)) / ((SELECT max(precision) - min(precision) FROM rows) + 1e-10), 5) AS precision_norm FROM rows",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    rows = lines.groupBy(F.col("l_returnflag").alias("model_name")).agg(
        F.avg("l_discount").alias("rmse"), F.avg("l_tax").alias("precision")
    )
    out = metrics.normalized_comparison(rows, ["rmse", "precision"])
    return out.select(
        "model_name", r6("rmse"), r6("precision"), F.round("rmse_norm", 5).alias("rmse_norm"), F.round("precision_norm", 5).alias("precision_norm")
    )


@query(
    "q1_stream_fold_in",
    with_(
        RATINGS, *als_ctes(3),
        "ev AS (SELECT CASE WHEN user_id % 2 = 0 THEN user_id ELSE user_id + 1000000 END AS user_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS item_id, "
        "max(1 + event_id % 5)::DOUBLE AS rating FROM events GROUP BY 1, 2)",
        "f AS (SELECT user_id, count(*) AS n, avg(rating - (SELECT m FROM mu) - bi) AS t FROM ev JOIN bi3 USING (item_id) GROUP BY 1)",
    )
    + "SELECT user_id, round((1 - pow(1 - 0.01 * 2.0, n * 20)) / 2.0 * t, 6) AS bias FROM f UNION ALL "
    "SELECT user_id, round(bu, 6) FROM bu3 WHERE user_id NOT IN (SELECT user_id FROM f)",
)
def _(spark, sf):
    stream = (
        spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/event[s].parquet")
        .select(
            F.when(F.col("user_id") % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1_000_000).alias("user_id"),
            F.get_json_object("props", "$.k").cast("long").alias("item_id"),
            (1 + F.col("event_id") % 5).cast("double").alias("rating"),
        )
    )
    folder = scratch(spark, sf, "foldin")
    job = UserFoldIn(als3(spark, sf), folder, lr=0.01, n_epochs=20)
    started = job.start(stream, f"{folder}/stream")
    started.awaitTermination()
    return job.current(spark).users().select("user_id", r6("bias"))


@query(
    "q1_stream_factors",
    "WITH RECURSIVE ev AS (SELECT user_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS item_id, "
    "max(1 + event_id % 5)::DOUBLE AS rating FROM events GROUP BY 1, 2),\n" + fold_steps_sql("ev"),
)
def _(spark, sf):
    """Factors of the events' users after two micro batches with a merge of the first in between."""
    folder = scratch(spark, sf, "foldin-factors")
    events = table(spark, sf, "events").select(
        "event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        (1 + F.col("event_id") % 5).cast("double").alias("rating"),
    )
    arriving = ["user_id", "item_id", "rating"]
    job = UserFoldIn(fold_items_model(spark, sf), f"{folder}/state", 0.01, 2, buckets=8, method="expected")
    for half in range(2):  # what comes first is folded, merged, and folded again with the rest
        events.filter(F.col("event_id") % 2 == half).select(*arriving).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.select(*arriving).schema).parquet(f"{folder}/in")
        job.start(stream, f"{folder}/progress").awaitTermination()
        if half == 0:
            job.compact(spark)
    return folded_columns(job.current(spark).users())

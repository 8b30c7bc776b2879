"""Queries over fitted models: biases, neighbours, content, factors, and the lists they give."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bias, content, factors, neighbors
from ..operators.split import holdout_split
from ..plans import train as T
from .base import (
    FEATURES, RATINGS, REQUESTS, TRAIN_TEST, als_ctes, features, query, r6, ratings, requests, scratch, shared, table, with_,
)


def als3(spark, sf):
    return shared(spark, sf, "als3", lambda: bias.fit_bias(ratings(spark, sf), "als", 3, 1.0))


def als_train2(spark, sf):
    """Two epochs on the train part of the hash split."""

    def build():
        train, _ = holdout_split(ratings(spark, sf), 0.2, 42)
        return bias.fit_bias(train, "als", 2, 1.0)

    return shared(spark, sf, "als_train2", build)


@query("m1_global_mean", with_(RATINGS) + "SELECT round(avg(rating), 6) AS global_mean FROM ratings")
def _(spark, sf):
    return ratings(spark, sf).agg(r6(F.avg("rating"), "global_mean"))


@query(
    "m2_bias_als_parameters",
    with_(RATINGS, *als_ctes(3))
    + "SELECT 'user' AS side, user_id AS id, round(bu, 6) AS bias FROM bu3 UNION ALL SELECT 'item', item_id, round(bi, 6) FROM bi3",
)
def _(spark, sf):
    model = als3(spark, sf)
    users = model.users().select(F.lit("user").alias("side"), F.col("user_id").alias("id"), r6("bias"))
    return users.unionByName(model.items().select(F.lit("item").alias("side"), F.col("item_id").alias("id"), r6("bias")))


def _sgd_ctes(epochs: int, reg: float, lr: float) -> list[str]:
    out = ["mu AS (SELECT avg(rating) AS m FROM ratings)"]
    a, inverse = 1 - lr * (1 + reg), 1 + reg
    for e in range(1, epochs + 1):
        old_u = f"coalesce((SELECT bu FROM bu{e - 1} o WHERE o.user_id = t.user_id), 0)" if e > 1 else "0"
        item = f" - bi FROM ratings JOIN bi{e - 1} USING (item_id)" if e > 1 else " FROM ratings"
        out.append(
            f"bu{e} AS MATERIALIZED (SELECT user_id, pow({a}, n) * {old_u} + (1 - pow({a}, n)) / {inverse} * m AS bu FROM "
            f"(SELECT user_id, count(*) AS n, avg(x) AS m FROM (SELECT user_id, rating - (SELECT m FROM mu){item}) q(user_id, x) GROUP BY 1) t)"
        )
        old_i = f"coalesce((SELECT bi FROM bi{e - 1} o WHERE o.item_id = t.item_id), 0)" if e > 1 else "0"
        out.append(
            f"bi{e} AS MATERIALIZED (SELECT item_id, pow({a}, n) * {old_i} + (1 - pow({a}, n)) / {inverse} * m AS bi FROM "
            f"(SELECT item_id, count(*) AS n, avg(rating - (SELECT m FROM mu) - bu) AS m FROM ratings JOIN bu{e} USING (user_id) GROUP BY 1) t)"
        )
    return out


@query(
    "m3_bias_sgd_parameters",
    with_(RATINGS, *_sgd_ctes(2, 0.02, 0.01))
    + "SELECT 'user' AS side, user_id AS id, round(bu, 6) AS bias FROM bu2 UNION ALL SELECT 'item', item_id, round(bi, 6) FROM bi2",
)
def _(spark, sf):
    model = bias.fit_bias(ratings(spark, sf), "sgd", 2, 0.02, 0.01)
    users = model.users().select(F.lit("user").alias("side"), F.col("user_id").alias("id"), r6("bias"))
    return users.unionByName(model.items().select(F.lit("item").alias("side"), F.col("item_id").alias("id"), r6("bias")))


_PREDICT = "least(5.0, greatest(0.0, (SELECT m FROM mu) + coalesce(bu, 0) + coalesce(bi, 0)))"


@query(
    "m4_j1_predict_bias",
    with_(RATINGS, REQUESTS, *als_ctes(3))
    + f"SELECT user_id, item_id, round({_PREDICT}, 6) AS rating_pred, bu IS NOT NULL AND bi IS NOT NULL AS prediction_possible "
    "FROM requests LEFT JOIN bu3 USING (user_id) LEFT JOIN bi3 USING (item_id)",
)
def _(spark, sf):
    out = bias.predict_bias(als3(spark, sf), requests(spark, sf))
    return out.select("user_id", "item_id", r6("rating_pred"), "prediction_possible")


_TOP10 = [
    "cand AS (SELECT user_id, item_id, (SELECT m FROM mu) + bu + bi AS p, bi FROM bu3 CROSS JOIN bi3 ANTI JOIN ratings USING (user_id, item_id))",
    "top AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(bi, 9) DESC, item_id) AS INTEGER) AS rank FROM cand QUALIFY rank <= 10)",
]


@query(
    "w1_m2_top10_bias",
    with_(RATINGS, *als_ctes(3), *_TOP10)
    + "SELECT user_id, item_id, round(least(5.0, greatest(0.0, p)), 6) AS rating_pred, rank FROM top",
)
def _(spark, sf):
    rows = ratings(spark, sf)
    out = T.recommend(als3(spark, sf), rows.select("user_id"), rows, 10)
    return out.select("user_id", "item_id", r6("rating_pred"), "rank")


@query(
    "p12_top3_without_user",
    with_(RATINGS, *als_ctes(3), *_TOP10)
    + "SELECT item_id, round(least(5.0, greatest(0.0, p)), 6) AS rating_pred, rank FROM top WHERE rank <= 3",
)
def _(spark, sf):
    rows = ratings(spark, sf)
    out = T.recommend(als3(spark, sf), rows.select("user_id"), rows, 3, include_user=False)
    return out.select("item_id", r6("rating_pred"), "rank")


@query(
    "j6_top5_of_all_items",
    with_(RATINGS, *als_ctes(3))
    + "SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(bi, 9) DESC, item_id) AS INTEGER) AS rank "
    "FROM bu3 CROSS JOIN bi3 QUALIFY rank <= 5",
)
def _(spark, sf):
    out = T.recommend(als3(spark, sf), ratings(spark, sf).select("user_id"), None, 5)
    return out.select("user_id", "item_id", "rank")


@query(
    "m7_update_users_bias",
    with_(
        RATINGS, *TRAIN_TEST, *als_ctes(2, source="train"),
        "again AS (SELECT user_id, count(*) AS n, avg(rating - (SELECT m FROM mu) - bi) AS t FROM ratings JOIN bi2 USING (item_id) "
        "WHERE user_id % 5 = 0 OR user_id NOT IN (SELECT user_id FROM train) GROUP BY 1)",
    )
    + "SELECT user_id, round((1 - pow(1 - 0.01 * 2.0, n * 20)) / 2.0 * t, 6) AS bias FROM again UNION ALL "
    "SELECT user_id, round(bu, 6) FROM bu2 WHERE user_id NOT IN (SELECT user_id FROM again)",
)
def _(spark, sf):
    model, rows = als_train2(spark, sf), ratings(spark, sf)
    changed = rows.filter("user_id % 5 = 0").unionByName(
        rows.filter("user_id % 5 <> 0").join(model.users().select("user_id"), "user_id", "left_anti")
    )
    return T.update_users(model, changed, 0.01, 20).users().select("user_id", r6("bias"))


def _history_sql(epochs: int) -> str:
    parts = [
        f"SELECT {e} AS epoch, round(sqrt(avg(pow(rating - (SELECT m FROM mu) - bu - bi, 2))), 6) AS train_rmse "
        f"FROM ratings JOIN bu{e} USING (user_id) JOIN bi{e} USING (item_id)"
        for e in range(1, epochs + 1)
    ]
    return with_(RATINGS, *als_ctes(epochs)) + " UNION ALL ".join(parts)


@query("m8_training_rmse", _history_sql(3))
def _(spark, sf):
    return als3(spark, sf).training_history().select("epoch", r6("train_rmse"))


# --- neighbours ----------------------------------------------------------------------------------


def _neighbor_ctes(axis: str) -> list[str]:
    e, c = ("item_id", "user_id") if axis == "item" else ("user_id", "item_id")
    return [
        RATINGS,
        f"nc AS (SELECT count(DISTINCT {c})::DOUBLE AS n FROM ratings)",
        f"st AS MATERIALIZED (SELECT {e} AS id, sum(rating) / (SELECT n FROM nc) AS m, sum(rating * rating) - sum(rating) * sum(rating) / (SELECT n FROM nc) AS q FROM ratings GROUP BY 1)",
        f"dots AS MATERIALIZED (SELECT a.{e} AS id_a, b.{e} AS id_b, sum(a.rating * b.rating) AS dot FROM ratings a JOIN ratings b ON a.{c} = b.{c} AND a.{e} < b.{e} GROUP BY 1, 2)",
    ]


_SIM = "({dot} - (SELECT n FROM nc) * sa.m * sb.m) / sqrt(sa.q * sb.q)"


@query(
    "j7_m9_item_similarity_edges",
    with_(*_neighbor_ctes("item"))
    + f"SELECT id_a, id_b, round({_SIM.format(dot='dot')}, 6) AS sim FROM dots JOIN st sa ON sa.id = id_a JOIN st sb ON sb.id = id_b",
)
def _(spark, sf):
    model = neighbors.fit_neighbors(ratings(spark, sf), "item", 20)
    return neighbors.similarity_edges(model).select("id_a", "id_b", r6("sim"))


def _predict_sql(axis: str, k: int) -> str:
    e, c = ("item_id", "user_id") if axis == "item" else ("user_id", "item_id")
    return with_(
        *_neighbor_ctes(axis), REQUESTS,
        f"rq AS (SELECT {e} AS i, {c} AS c FROM requests WHERE {e} IN (SELECT id FROM st) AND {c} IN (SELECT {c} FROM ratings))",
        f"pr AS (SELECT rq.c, rq.i, r.{e} AS j, r.rating, least(rq.i, r.{e}) AS lo, greatest(rq.i, r.{e}) AS hi FROM rq JOIN ratings r ON r.{c} = rq.c AND r.{e} <> rq.i)",
        f"sc AS (SELECT c, i, j, rating - sb.m AS dev, {_SIM.format(dot='coalesce(dot, 0)')} AS sim FROM pr LEFT JOIN dots ON id_a = lo AND id_b = hi "
        "JOIN st sa ON sa.id = i JOIN st sb ON sb.id = j)",
        f"nn AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY c, i ORDER BY round(sim, 9) DESC, j) <= {k})",
        "w AS (SELECT c, i, sum(sim * dev) AS num, sum(abs(sim)) AS den FROM nn GROUP BY 1, 2)",
    ) + (
        f"SELECT user_id, item_id, round(least(5.0, greatest(0.0, CASE WHEN rq.i IS NULL THEN (SELECT avg(rating) FROM ratings) "
        f"ELSE st.m + CASE WHEN den > 1e-9 THEN num / den ELSE 0 END END)), 6) AS rating_pred, rq.i IS NOT NULL AS prediction_possible "
        f"FROM requests LEFT JOIN rq ON rq.i = {e} AND rq.c = requests.{c} LEFT JOIN st ON st.id = rq.i LEFT JOIN w ON w.i = rq.i AND w.c = rq.c"
    )


@query("m9_m11_predict_item_item", _predict_sql("item", 20))
def _(spark, sf):
    model = neighbors.fit_neighbors(ratings(spark, sf), "item", 20)
    out = neighbors.predict_neighbors(model, requests(spark, sf))
    return out.select("user_id", "item_id", r6("rating_pred"), "prediction_possible")


@query("m10_m11_predict_user_user", _predict_sql("user", 20))
def _(spark, sf):
    model = neighbors.fit_neighbors(ratings(spark, sf), "user", 20)
    out = neighbors.predict_neighbors(model, requests(spark, sf))
    return out.select("user_id", "item_id", r6("rating_pred"), "prediction_possible")


@query(
    "w3_nearest_items",
    with_(
        *_neighbor_ctes("item"),
        f"e AS (SELECT id_a, id_b, {_SIM.format(dot='dot')} AS sim FROM dots JOIN st sa ON sa.id = id_a JOIN st sb ON sb.id = id_b)",
        "both_ways AS (SELECT id_a AS item_id, id_b AS neighbor, sim FROM e UNION ALL SELECT id_b, id_a, sim FROM e)",
    )
    + "SELECT item_id, neighbor, round(sim, 6) AS sim, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 9) DESC, neighbor) AS INTEGER) AS rank "
    "FROM both_ways QUALIFY rank <= 10",
)
def _(spark, sf):
    model = neighbors.fit_neighbors(ratings(spark, sf), "item")
    return neighbors.nearest_entities(model, 10).select(F.col("id").alias("item_id"), "neighbor", r6("sim"), "rank")


@query(
    "w1_top5_near_items",
    with_(
        *_neighbor_ctes("item"),
        f"e AS (SELECT id_a, id_b, {_SIM.format(dot='dot')} AS sim FROM dots JOIN st sa ON sa.id = id_a JOIN st sb ON sb.id = id_b)",
        "both_ways AS (SELECT id_a AS x, id_b AS y, sim FROM e UNION ALL SELECT id_b, id_a, sim FROM e)",
        "near AS (SELECT x, y FROM both_ways QUALIFY row_number() OVER (PARTITION BY x ORDER BY round(sim, 9) DESC, y) <= 2)",
        "cand AS (SELECT DISTINCT user_id, y AS item_id FROM ratings JOIN near ON x = item_id ANTI JOIN ratings r2 ON r2.user_id = ratings.user_id AND r2.item_id = near.y)",
        "pr AS (SELECT c.user_id, c.item_id AS i, r.item_id AS j, r.rating, least(c.item_id, r.item_id) AS lo, greatest(c.item_id, r.item_id) AS hi FROM cand c JOIN ratings r ON r.user_id = c.user_id)",
        f"sc AS (SELECT user_id, i, j, sa.m AS mi, rating - sb.m AS dev, {_SIM.format(dot='coalesce(dot, 0)')} AS sim FROM pr LEFT JOIN dots ON id_a = lo AND id_b = hi "
        "JOIN st sa ON sa.id = i JOIN st sb ON sb.id = j)",
        "nn AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY user_id, i ORDER BY round(sim, 9) DESC, j) <= 20)",
        "w AS (SELECT user_id, i AS item_id, any_value(mi) + CASE WHEN sum(abs(sim)) > 1e-9 THEN sum(sim * dev) / sum(abs(sim)) ELSE 0 END AS p FROM nn GROUP BY 1, 2)",
    )
    + "SELECT user_id, item_id, round(least(5.0, greatest(0.0, p)), 6) AS rating_pred, "
    "CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(p, 9) DESC, item_id) AS INTEGER) AS rank FROM w QUALIFY rank <= 5",
)
def _(spark, sf):
    rows = ratings(spark, sf)
    model = neighbors.fit_neighbors(rows, "item", 20)
    candidates = neighbors.neighbor_candidates(model, rows, 2)
    out = T.recommend(model, rows, rows, 5, candidates=candidates)
    return out.select("user_id", "item_id", r6("rating_pred"), "rank")


def _lists_sql(axis: str, amount: int) -> str:
    """All users times all items; all ratings of a context are neighbours, as none has more than 500."""
    e, c = ("item_id", "user_id") if axis == "item" else ("user_id", "item_id")
    return with_(
        *_neighbor_ctes(axis),
        "s2 AS (SELECT id_a AS i, id_b AS j, -(SELECT n FROM nc) * sa.m * sb.m / sqrt(sa.q * sb.q) AS s0, dot / sqrt(sa.q * sb.q) AS d "
        "FROM dots JOIN st sa ON sa.id = id_a JOIN st sb ON sb.id = id_b)",
        "sims AS MATERIALIZED (SELECT i, j, s0, d FROM s2 UNION ALL SELECT j, i, s0, d FROM s2)",
        f"dev AS MATERIALIZED (SELECT {c} AS c, {e} AS j, rating - m AS dev, m / sqrt(q) AS a FROM ratings JOIN st ON st.id = {e})",
        "own AS (SELECT c, sum(dev * a) AS b, sum(a) AS a FROM dev GROUP BY 1)",
        "met AS (SELECT c, i, sum(d * dev) AS num, sum(abs(s0 + d) - abs(s0)) AS den FROM dev JOIN sims USING (j) GROUP BY 1, 2)",
        f"w AS (SELECT own.c AS {c}, st.id AS {e}, st.m AS m, coalesce(num, 0) - (SELECT n FROM nc) * st.m / sqrt(st.q) * own.b AS num, "
        "coalesce(den, 0) + (SELECT n FROM nc) * st.m / sqrt(st.q) * own.a AS den "
        f"FROM own CROSS JOIN st LEFT JOIN met ON met.c = own.c AND met.i = st.id ANTI JOIN ratings r ON r.{c} = own.c AND r.{e} = st.id)",
        "p AS (SELECT user_id, item_id, m + CASE WHEN den > 1e-9 THEN num / den ELSE 0 END AS p FROM w)",
    ) + (
        "SELECT user_id, item_id, round(least(5.0, greatest(0.0, p)), 6) AS rating_pred, "
        f"CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(p, 9) DESC, item_id) AS INTEGER) AS rank FROM p QUALIFY rank <= {amount}"
    )


def _lists(axis: str):
    def run(spark, sf):
        rows = ratings(spark, sf)
        out = T.recommend(neighbors.fit_neighbors(rows, axis, 500), rows, rows, 5)
        return out.select("user_id", "item_id", r6("rating_pred"), "rank")

    return run


query("w1_top5_item_item", _lists_sql("item", 5))(_lists("item"))
query("w1_top5_user_user", _lists_sql("user", 5))(_lists("user"))


@query(
    "x18_pair_similarity",
    with_(
        RATINGS, "u AS (SELECT DISTINCT user_id FROM ratings)",
        "pairs AS (SELECT a.user_id AS id_a, b.user_id AS id_b FROM u a JOIN u b ON b.user_id = a.user_id + 1)",
        "nrm AS (SELECT user_id, sum(rating * rating) AS q FROM ratings GROUP BY 1)",
        "co AS (SELECT id_a, id_b, count(*) AS n, sum(x.rating * y.rating) AS dot, corr(x.rating, y.rating) AS c FROM pairs JOIN ratings x ON x.user_id = id_a "
        "JOIN ratings y ON y.user_id = id_b AND y.item_id = x.item_id GROUP BY 1, 2)",
        "f AS (SELECT id_a, id_b, coalesce(n, 0) AS n, coalesce(dot, 0) AS dot, c, na.q AS qa, nb.q AS qb FROM pairs LEFT JOIN co USING (id_a, id_b) "
        "JOIN nrm na ON na.user_id = id_a JOIN nrm nb ON nb.user_id = id_b)",
    )
    + "SELECT id_a, id_b, n AS n_common, round(dot / sqrt(qa * qb), 6) AS cosine, round(sqrt(qa + qb - 2 * dot), 6) AS euclid, "
    "round(1 / (1 + sqrt(qa + qb - 2 * dot)), 6) AS euclid_similarity, "
    "round(CASE WHEN n < 2 OR c IS NULL OR isnan(c) THEN 0 ELSE c END, 6) AS pearson FROM f",
)
def _(spark, sf):
    rows = ratings(spark, sf)
    users = rows.select("user_id").distinct()
    pairs = users.select(F.col("user_id").alias("id_a"), (F.col("user_id") + 1).alias("user_id")).join(users, "user_id")
    pairs = pairs.select("id_a", F.col("user_id").alias("id_b"))
    out = neighbors.pair_similarity(pairs, rows, "user")
    return out.select("id_a", "id_b", "n_common", *[r6(c) for c in ("cosine", "euclid", "euclid_similarity", "pearson")])


# --- content -------------------------------------------------------------------------------------


@query(
    "m12_user_profiles",
    with_(RATINGS, FEATURES, "tot AS (SELECT user_id, sum(rating - 1) AS w FROM ratings GROUP BY 1)")
    + "SELECT user_id, feature, round(sum((rating - 1) * value) / CASE WHEN any_value(w) > 0 THEN any_value(w) ELSE 1 END, 6) AS value "
    "FROM ratings JOIN features USING (item_id) JOIN tot USING (user_id) GROUP BY 1, 2",
)
def _(spark, sf):
    return content.user_profiles(ratings(spark, sf), features(spark, sf), 1).select("user_id", "feature", r6("value"))


@query(
    "m13_similar_items_by_content",
    with_(
        FEATURES, "n AS (SELECT item_id, sqrt(sum(value * value)) AS n FROM features GROUP BY 1)",
        "s AS (SELECT a.item_id, b.item_id AS neighbor, sum(a.value * b.value) / any_value(na.n * nb.n) AS sim FROM features a JOIN features b "
        "ON a.feature = b.feature AND a.item_id <> b.item_id JOIN n na ON na.item_id = a.item_id JOIN n nb ON nb.item_id = b.item_id GROUP BY 1, 2)",
    )
    + "SELECT item_id, neighbor, round(sim, 6) AS sim, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 9) DESC, neighbor) AS INTEGER) AS rank FROM s QUALIFY rank <= 5",
)
def _(spark, sf):
    out = content.similar_items(features(spark, sf), 5)
    return out.select(F.col("query_id").alias("item_id"), F.col("item_id").alias("neighbor"), r6("sim"), "rank")


@query(
    "m14_predict_content",
    with_(
        RATINGS, REQUESTS, FEATURES, "nf AS (SELECT count(DISTINCT feature) AS n FROM features)",
        "rs AS (SELECT item_id, sum(value) AS v FROM features GROUP BY 1)",
        "us AS (SELECT user_id, sum((rating - 1) * v) / CASE WHEN sum(rating - 1) > 0 THEN sum(rating - 1) ELSE 1 END / (SELECT n FROM nf) AS s "
        "FROM ratings JOIN rs USING (item_id) GROUP BY 1)",
    )
    + "SELECT user_id, item_id, round(CASE WHEN s IS NULL OR item_id NOT IN (SELECT item_id FROM ratings) THEN (SELECT avg(rating) FROM ratings) ELSE s END, 6) AS rating_pred "
    "FROM requests LEFT JOIN us USING (user_id)",
)
def _(spark, sf):
    model = content.fit_content(ratings(spark, sf), features(spark, sf), 1, 5)
    return content.predict_content(model, requests(spark, sf), bound=False).select("user_id", "item_id", r6("rating_pred"))


@query(
    "m14_predict_user_mean",
    with_(RATINGS, REQUESTS, "us AS (SELECT user_id, avg(rating) AS s FROM ratings GROUP BY 1)")
    + "SELECT user_id, item_id, round(CASE WHEN s IS NULL OR item_id NOT IN (SELECT item_id FROM ratings) THEN (SELECT avg(rating) FROM ratings) ELSE s END, 6) AS rating_pred "
    "FROM requests LEFT JOIN us USING (user_id)",
)
def _(spark, sf):
    model = content.fit_content(ratings(spark, sf))
    return content.predict_content(model, requests(spark, sf)).select("user_id", "item_id", r6("rating_pred"))


@query(
    "w1_top5_content",
    with_(
        RATINGS, "i AS (SELECT DISTINCT item_id FROM ratings)", "u AS (SELECT user_id, avg(rating) AS s FROM ratings GROUP BY 1)",
        "c AS (SELECT user_id, item_id, s FROM u CROSS JOIN i ANTI JOIN ratings USING (user_id, item_id))",
    )
    + "SELECT user_id, item_id, round(s, 6) AS rating_pred, CAST(row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS INTEGER) AS rank FROM c QUALIFY rank <= 5",
)
def _(spark, sf):
    rows = ratings(spark, sf)
    out = T.recommend(content.fit_content(rows), rows.select("user_id"), rows, 5)
    return out.select("user_id", "item_id", r6("rating_pred"), "rank")


@query(
    "m15_model_score",
    with_(RATINGS, REQUESTS, *als_ctes(3))
    + "SELECT user_id, item_id, round(CASE WHEN user_id IS NULL THEN 0 ELSE (SELECT m FROM mu) + coalesce(bu, 0) + coalesce(bi, 0) END, 6) AS model_score "
    "FROM (SELECT CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS user_id, item_id FROM requests) LEFT JOIN bu3 USING (user_id) LEFT JOIN bi3 USING (item_id)",
)
def _(spark, sf):
    asked = requests(spark, sf).withColumn("user_id", F.when(F.col("user_id") % 10 != 0, F.col("user_id")))
    return T.model_score(als3(spark, sf), asked).select("user_id", "item_id", r6("model_score"))


# --- factors -------------------------------------------------------------------------------------


def _vector_sql(name: str, key: str, modulus: int) -> str:
    return (
        f"{name} AS (SELECT vec_id AS {key}, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d, (vec_id % {modulus}) / 100.0 AS b FROM embeddings)"
    )


def _fixed_factors(spark, sf, kernel):
    """Embeddings as given parameters of users and items, to check the scoring alone."""
    from ..operators.model import Model

    rows = table(spark, sf, "embeddings")
    vectors = F.transform("embedding", lambda x: x.cast("double")).alias("factors")
    users = rows.filter("vec_id % 3 <> 0").select(F.col("vec_id").alias("user_id"), (F.col("vec_id") % 7 / 100.0).alias("bias"), vectors)
    items = rows.filter("vec_id % 4 <> 0").select(F.col("vec_id").alias("item_id"), (F.col("vec_id") % 11 / 100.0).alias("bias"), vectors)
    meta = {
        "kernel": kernel, "n_factors": 64, "gamma": 1 / 64, "global_mean": 3.5, "min_rating": 1, "max_rating": 5,
        "n_users": users.count(), "n_items": items.count(), "lr": 0.01, "reg": 0.02, "init_mean": 0.0, "init_sd": 0.1,
    }
    return Model("kernel_mf", {"users": users, "items": items}, meta)


_FIXED = [
    _vector_sql("uv", "user_id", 7), _vector_sql("iv", "item_id", 11), REQUESTS,
    "us AS (SELECT * FROM uv WHERE user_id % 3 <> 0)", "ist AS (SELECT * FROM iv WHERE item_id % 4 <> 0)",
    "dims AS (SELECT unnest(generate_series(1, 64)) AS d)",
    "s AS (SELECT r.user_id, r.item_id, coalesce(max(u.b), 0) AS bu, coalesce(max(i.b), 0) AS bi, sum(coalesce(u.x, 0) * coalesce(i.x, 0)) AS dot, "
    "sum(pow(coalesce(u.x, 0) - coalesce(i.x, 0), 2)) AS dist, count(u.x) > 0 AND count(i.x) > 0 AS prediction_possible "
    "FROM requests r CROSS JOIN dims LEFT JOIN us u ON u.user_id = r.user_id AND u.d = dims.d LEFT JOIN ist i ON i.item_id = r.item_id AND i.d = dims.d GROUP BY 1, 2)",
]
_SCORES = {
    "linear": "3.5 + bu + bi + dot",
    "sigmoid": "1 + 4 / (1 + exp(-(3.5 + bu + bi + dot)))",
    "rbf": "1 + 4 * exp(-dist / 64)",
}


def _kernel_query(kernel: str):
    @query(
        f"m6_predict_{kernel}",
        with_(*_FIXED) + f"SELECT user_id, item_id, round(least(5.0, greatest(1.0, {_SCORES[kernel]})), 6) AS rating_pred, prediction_possible FROM s",
    )
    def _(spark, sf):
        out = factors.predict_factors(_fixed_factors(spark, sf, kernel), requests(spark, sf))
        return out.select("user_id", "item_id", r6("rating_pred"), "prediction_possible")


for _kernel in _SCORES:
    _kernel_query(_kernel)


@query(
    "w1_top10_factors",
    with_(
        _vector_sql("uv", "user_id", 7), _vector_sql("iv", "item_id", 11), REQUESTS,
        "s AS (SELECT u.user_id, i.item_id, any_value(u.b) AS bu, any_value(i.b) AS bi, sum(u.x * i.x) AS dot FROM uv u JOIN iv i ON u.d = i.d "
        "WHERE u.user_id % 3 <> 0 AND i.item_id % 4 <> 0 GROUP BY 1, 2)",
        "c AS (SELECT * FROM s ANTI JOIN requests USING (user_id, item_id))",
    )
    + "SELECT user_id, item_id, round(least(5.0, greatest(1.0, 3.5 + bu + bi + dot)), 6) AS rating_pred, "
    "CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(bi + dot, 9) DESC, item_id) AS INTEGER) AS rank FROM c QUALIFY rank <= 10",
)
def _(spark, sf):
    model = _fixed_factors(spark, sf, "linear")
    out = T.recommend(model, model.users(), requests(spark, sf), 10)
    return out.select("user_id", "item_id", r6("rating_pred"), "rank")


def _trained(spark, sf, kernel):
    return shared(
        spark, sf, f"mf_{kernel}",
        lambda: factors.fit_factors(ratings(spark, sf), kernel, 8, 2, 0.02, 0.02, min_rating=1, max_rating=5, track_rmse=True),
    )


def _fit_query(kernel: str):
    @query(f"m5_fit_{kernel}")
    def _(spark, sf):
        model = _trained(spark, sf, kernel)
        users = model.users().select(F.lit("user").alias("side"), F.col("user_id").alias("id"), "bias", "factors")
        return users.unionByName(model.items().select(F.lit("item").alias("side"), F.col("item_id").alias("id"), "bias", "factors"))


for _kernel in _SCORES:
    _fit_query(_kernel)


@query("m5_fit_linear_als")
def _(spark, sf):
    model = factors.fit_linear_als(ratings(spark, sf), 8, 3)
    return model.users().select("user_id", "bias", "factors")


@query(
    "m5_m8_fit_facts",
    with_(RATINGS)
    + "SELECT DISTINCT 'user' AS side, user_id AS id, true AS whole, true AS below_mean FROM ratings "
    "UNION ALL SELECT DISTINCT 'item', item_id, true, true FROM ratings",
)
def _(spark, sf):
    """What SQL can say about fits: every user and item has one finite row of the right width, and the fit beats the mean."""
    rows = ratings(spark, sf)
    spread_of_mean = rows.agg(F.stddev_pop("rating")).first()[0]
    model = factors.fit_linear_als(rows, 8, 3)
    error = F.pow(F.col("rating") - F.col("rating_pred"), 2)
    rmse = T.predict(model, rows, bound=False).agg(F.sqrt(F.avg(error))).first()[0]
    finite = F.forall(F.concat("factors", F.array("bias")), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e6))
    whole = ((F.size("factors") == 8) & finite).alias("whole")
    facts = [p.select(F.lit(side).alias("side"), F.col(f"{side}_id").alias("id"), whole) for side, p in (("user", model.users()), ("item", model.items()))]
    return facts[0].unionByName(facts[1]).withColumn("below_mean", F.lit(rmse < spread_of_mean))


@query("m8_training_rmse_factors")
def _(spark, sf):
    return _trained(spark, sf, "linear").training_history()


@query("m7_update_users_factors")
def _(spark, sf):
    rows = ratings(spark, sf)
    changed = rows.filter("user_id % 5 = 0")
    return T.update_users(_trained(spark, sf, "linear"), changed, 0.01, 20).users()


def fold_items_model(spark, sf):
    """Parts with two given factors and customers with a given one, to check the fold alone."""
    from ..operators.model import Model

    part = table(spark, sf, "part")
    centred = lambda column, modulus, scale: (F.col(column) % modulus - modulus // 2) / scale
    items = part.select(
        F.col("p_partkey").alias("item_id"), centred("p_partkey", 11, 20.0).alias("bias"),
        F.array(centred("p_size", 7, 5.0), centred("p_partkey", 13, 10.0)).alias("factors"),
    )
    users = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.lit(0.5).alias("bias"), F.array(F.lit(0.2), F.lit(-0.2)).alias("factors")
    )
    meta = {
        "kernel": "linear", "n_factors": 2, "gamma": 0.5, "global_mean": 3.0, "min_rating": 1, "max_rating": 5,
        "n_users": users.count(), "n_items": items.count(), "lr": 0.01, "reg": 0.02, "init_mean": 0.1, "init_sd": 0.0,
    }
    return Model("kernel_mf", {"users": users, "items": items}, meta)


def fold_steps_sql(rated: str) -> str:
    """All expected steps, one by one, for the table ``rated`` (user_id, item_id, rating)."""
    ctes = [
        "it AS (SELECT p_partkey AS item_id, (p_partkey % 11 - 5) / 20.0 AS b, (p_size % 7 - 3) / 5.0 AS q, (p_partkey % 13 - 6) / 10.0 AS w FROM part)",
        f"x AS (SELECT user_id, q::DOUBLE AS q, w::DOUBLE AS w, (rating - 3.0 - b)::DOUBLE AS y FROM {rated} JOIN it USING (item_id))",
        "m AS (SELECT user_id, count(*) AS n, avg(q) AS q1, avg(w) AS w1, avg(q * q) AS qq, avg(q * w) AS qw, avg(w * w) AS ww, "
        "avg(y) AS y1, avg(q * y) AS qy, avg(w * y) AS wy FROM x GROUP BY 1)",
        "t AS (SELECT user_id, 0 AS k, 0.0::DOUBLE AS b, 0.1::DOUBLE AS f, 0.1::DOUBLE AS g FROM m UNION ALL "
        "SELECT user_id, k + 1, b - 0.01 * (b + q1 * f + w1 * g - y1 + 0.02 * b), f - 0.01 * (q1 * b + qq * f + qw * g - qy + 0.02 * f), "
        "g - 0.01 * (w1 * b + qw * f + ww * g - wy + 0.02 * g) FROM t JOIN m USING (user_id) WHERE k < 2 * n)",
    ]
    return ",\n".join(ctes) + (
        "\nSELECT user_id, round(b, 6) AS bias, round(f, 6) AS factor_1, round(g, 6) AS factor_2 FROM t JOIN m USING (user_id) WHERE k = 2 * n "
        "UNION ALL SELECT c_custkey, 0.5, 0.2, -0.2 FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM m)"
    )


def folded_columns(users):
    vector = F.col("factors")
    return users.select("user_id", r6("bias"), r6(vector[0], "factor_1"), r6(vector[1], "factor_2"))


@query("m7_fold_factors_by_sums", f"WITH RECURSIVE {RATINGS},\n" + fold_steps_sql("ratings"))
def _(spark, sf):
    """All customers, from sums over their whole histories."""
    folded = T.update_users(fold_items_model(spark, sf), ratings(spark, sf), 0.01, 2, method="expected")
    return folded_columns(folded.users())


@query(
    "m16_train_dispatcher",
    with_(RATINGS, REQUESTS, *_sgd_ctes(2, 0.02, 0.01))
    + f"SELECT user_id, item_id, round({_PREDICT}, 6) AS rating_pred, bu IS NOT NULL AND bi IS NOT NULL AS prediction_possible "
    "FROM requests LEFT JOIN bu2 USING (user_id) LEFT JOIN bi2 USING (item_id)",
)
def _(spark, sf):
    model = T.fit_model("baseline", ratings(spark, sf), n_epochs=2)
    return T.predict(model, requests(spark, sf)).select("user_id", "item_id", r6("rating_pred"), "prediction_possible")


def _content_sql(k: int) -> list[str]:
    return [
        RATINGS, FEATURES, "n AS (SELECT item_id, sqrt(sum(value * value)) AS n FROM features GROUP BY 1)",
        "s AS (SELECT a.item_id, b.item_id AS neighbor, sum(a.value * b.value) / any_value(na.n * nb.n) AS sim FROM features a JOIN features b "
        "ON a.feature = b.feature AND a.item_id <> b.item_id JOIN n na ON na.item_id = a.item_id JOIN n nb ON nb.item_id = b.item_id GROUP BY 1, 2)",
        f"near AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 9) DESC, neighbor) <= {k})",
        "im AS (SELECT item_id, coalesce(avg(rating), (SELECT avg(rating) FROM ratings)) AS m FROM (SELECT DISTINCT item_id FROM features UNION SELECT item_id FROM ratings) "
        "LEFT JOIN ratings USING (item_id) GROUP BY 1)",
        "ad AS (SELECT r.user_id, near.item_id, sum(sim * (rating - im.m)) / sum(abs(sim)) AS a FROM near JOIN ratings r ON r.item_id = neighbor "
        "JOIN im ON im.item_id = neighbor GROUP BY 1, 2)",
    ]


def similarity_model(spark, sf):
    return T.fit_model("content", ratings(spark, sf), features=features(spark, sf), mode="similarity", n_neighbors=20)


@query(
    "m14_predict_content_similarity",
    with_(*_content_sql(20), REQUESTS)
    + "SELECT user_id, item_id, round(CASE WHEN u.user_id IS NULL OR im.item_id IS NULL THEN (SELECT avg(rating) FROM ratings) "
    "ELSE least(5.0, greatest(0.0, m + coalesce(a, 0))) END, 6) AS rating_pred, u.user_id IS NOT NULL AND im.item_id IS NOT NULL AS prediction_possible "
    "FROM requests LEFT JOIN (SELECT DISTINCT user_id FROM ratings) u USING (user_id) LEFT JOIN im USING (item_id) LEFT JOIN ad USING (user_id, item_id)",
)
def _(spark, sf):
    out = T.predict(similarity_model(spark, sf), requests(spark, sf))
    return out.select("user_id", "item_id", r6("rating_pred"), "prediction_possible")


@query(
    "w1_top5_content_similarity",
    with_(
        *_content_sql(20),
        "p AS (SELECT u.user_id, im.item_id, m + coalesce(a, 0) AS p FROM (SELECT DISTINCT user_id FROM ratings) u CROSS JOIN im "
        "LEFT JOIN ad ON ad.user_id = u.user_id AND ad.item_id = im.item_id ANTI JOIN ratings r ON r.user_id = u.user_id AND r.item_id = im.item_id)",
    )
    + "SELECT user_id, item_id, round(least(5.0, greatest(0.0, p)), 6) AS rating_pred, "
    "CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(p, 9) DESC, item_id) AS INTEGER) AS rank FROM p QUALIFY rank <= 5",
)
def _(spark, sf):
    rows = ratings(spark, sf)
    return T.recommend(similarity_model(spark, sf), rows, rows, 5).select("user_id", "item_id", r6("rating_pred"), "rank")


@query(
    "m16_train_global_mean",
    with_(RATINGS, REQUESTS)
    + "SELECT user_id, item_id, round((SELECT avg(rating) FROM ratings), 6) AS rating_pred, user_id IN (SELECT user_id FROM ratings) "
    "AND item_id IN (SELECT item_id FROM ratings) AS prediction_possible FROM requests",
)
def _(spark, sf):
    model = T.fit_model("global_mean", ratings(spark, sf))
    return T.predict(model, requests(spark, sf)).select("user_id", "item_id", r6("rating_pred"), "prediction_possible")


@query("s13_model_round_trip", with_(RATINGS, *als_ctes(3)) + "SELECT user_id, round(bu, 6) AS bias FROM bu3")
def _(spark, sf):
    from ..operators.model import Model

    path = scratch(spark, sf, "model")
    als3(spark, sf).save(path)
    return Model.load(spark, path).users().select("user_id", r6("bias"))

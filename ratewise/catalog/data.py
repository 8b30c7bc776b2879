"""Queries over sources, filters, joins, statistics and expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..contracts import as_items, as_ratings, duplicate_pairs, number_or_zero
from ..functions import recipes as R
from ..functions import text as X
from ..functions.kernels import clip, kernel_score
from ..operators import coldstart, filters, stats
from ..operators.content import content_new_user_list
from ..operators.ranking import head_rows
from ..operators.recipes import recipe_metadata
from ..operators.textindex import normalize_embeddings
from ..plans.ingest import ratings_from_interactions
from ..sources.readers import enrich_items, movielens_tables
from .base import (
    DOC_ITEMS, EMBEDDINGS, INTERACTIONS, RATINGS, RECIPES, REQUESTS, doc_items, embeddings, hash_sql,
    interactions, query, r6, ratings, recipes, requests, table, with_,
)

# --- sources -------------------------------------------------------------------------------------


@query("s2_load_ratings", with_(RATINGS) + "SELECT user_id, item_id, rating FROM ratings")
def _(spark, sf):
    return as_ratings(ratings(spark, sf))


@query("s2_load_items", "SELECT doc_id AS item_id, length(coalesce(text, '')) AS n FROM documents")
def _(spark, sf):
    return as_items(doc_items(spark, sf)).select("item_id", F.length("text").cast("long").alias("n"))


_MOVIES = [
    RATINGS,
    "counted AS (SELECT user_id FROM ratings GROUP BY 1 HAVING count(*) >= 35)",
    f"picked AS (SELECT user_id FROM counted ORDER BY {hash_sql('42', 'user_id')}, user_id LIMIT 200)",
    "kept AS (SELECT * FROM ratings WHERE user_id IN (SELECT user_id FROM picked))",
]


def _movielens(spark, sf):
    rated = ratings(spark, sf).select(
        F.col("user_id").alias("userId"), F.col("item_id").alias("movieId"), "rating", F.lit(0).alias("timestamp")
    )
    movies = table(spark, sf, "part").select(
        F.col("p_partkey").alias("movieId"), F.col("p_name").alias("title"),
        F.concat_ws("|", "p_brand", "p_type").alias("genres"),
    )
    return movielens_tables(rated, movies, min_interactions=35, n_users=200)


@query("s6_movielens_ratings", with_(*_MOVIES) + "SELECT user_id, item_id, rating FROM kept")
def _(spark, sf):
    return _movielens(spark, sf)[0].drop("timestamp")


@query(
    "s6_movielens_items",
    with_(*_MOVIES)
    + "SELECT p_partkey AS item_id, p_name || ' | genres: ' || p_brand || ', ' || p_type AS text FROM part "
    "WHERE p_partkey IN (SELECT item_id FROM kept)",
)
def _(spark, sf):
    return _movielens(spark, sf)[1]


@query(
    "s10_t5_unit_embeddings",
    with_(
        EMBEDDINGS,
        "dims AS (SELECT item_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM item_emb)",
        "norms AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM dims GROUP BY 1)",
    )
    + "SELECT item_id, CAST(d AS BIGINT) AS d, round((x / n)::FLOAT::DOUBLE, 5) AS x FROM dims JOIN norms USING (item_id)",
)
def _(spark, sf):
    unit = normalize_embeddings(embeddings(spark, sf))
    return unit.select("item_id", F.posexplode("embedding").alias("d", "x")).select(
        "item_id", (F.col("d") + 1).cast("long").alias("d"), F.round(F.col("x").cast("double"), 5).alias("x")
    )


@query(
    "s8_j3_enriched_items",
    with_(
        "store AS (SELECT p_partkey AS appid, p_name AS name, p_brand AS genres, CASE WHEN p_size > 25 THEN p_type END AS developer, "
        "trim(regexp_replace(regexp_replace(lower(trim(p_name)), '\\s+', ' ', 'g'), '[^a-z0-9 ]+', '', 'g')) AS norm FROM part)",
        "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY appid) AS rn FROM store) WHERE rn = 1)",
        "ids AS (SELECT DISTINCT upper(replace(p_name, ' ', '  ')) || '!' AS item_id FROM part UNION SELECT DISTINCT c_mktsegment FROM customer)",
        "normed AS (SELECT item_id, regexp_replace(regexp_replace(lower(trim(item_id)), '\\s+', ' ', 'g'), '[^a-z0-9 ]+', '', 'g') AS norm FROM ids)",
    )
    + "SELECT item_id, coalesce('name: ' || name || ' | genres: ' || genres || coalesce(' | developer: ' || developer, '') "
    "|| ' | short_description: about ' || appid, item_id) AS text FROM normed LEFT JOIN one USING (norm)",
)
def _(spark, sf):
    part = table(spark, sf, "part")
    store = part.select(
        F.col("p_partkey").alias("appid"), F.col("p_name").alias("name"), F.col("p_brand").alias("genres"),
        F.when(F.col("p_size") > 25, F.col("p_type")).alias("developer"),
    )
    details = part.select(
        F.col("p_partkey").alias("steam_appid"), F.concat(F.lit("about "), F.col("p_partkey")).alias("short_description")
    )
    ids = part.select(F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("  "))), F.lit("!")).alias("item_id"))
    ids = ids.unionByName(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("item_id")))
    return enrich_items(ids, store, details)


# --- filters and predicates ----------------------------------------------------------------------

_BEHAVIOUR = "lower(trim(behavior_name))"
_NUMBER = "coalesce(try_cast(value AS DOUBLE), 0)"


def _implicit(mode: str, transform: str) -> str:
    raw = f"CASE WHEN {_BEHAVIOUR} = 'purchase' THEN 1.0 ELSE {_NUMBER} END"
    rating = f"ln(1 + {raw})" if transform == "log1p" else raw
    behaviours = {"play_only": "('play')", "purchase_only": "('purchase')", "both": "('play', 'purchase')"}[mode]
    return (
        f"implicit AS (SELECT CAST(user_id AS VARCHAR) AS user_id, game_title AS item_id, {rating} AS rating "
        f"FROM interactions WHERE {_BEHAVIOUR} IN {behaviours})"
    )


@query(
    "p1_behaviour_both",
    with_(INTERACTIONS)
    + f"SELECT user_id, game_title, {_BEHAVIOUR} AS behavior_name, value FROM interactions WHERE {_BEHAVIOUR} IN ('play', 'purchase')",
)
def _(spark, sf):
    return filters.filter_behaviour(interactions(spark, sf), "both")


@query(
    "p1_behaviour_purchase_only",
    with_(INTERACTIONS)
    + f"SELECT user_id, game_title, {_BEHAVIOUR} AS behavior_name, value FROM interactions WHERE {_BEHAVIOUR} = 'purchase'",
)
def _(spark, sf):
    return filters.filter_behaviour(interactions(spark, sf), "purchase_only")


@query(
    "p2_implicit_rating_log1p",
    with_(INTERACTIONS, _implicit("both", "log1p")) + "SELECT user_id, item_id, round(rating, 6) AS rating FROM implicit",
)
def _(spark, sf):
    rows = filters.implicit_ratings(filters.filter_behaviour(interactions(spark, sf), "both"), "log1p")
    return rows.select("user_id", "item_id", r6("rating"))


@query(
    "a4_highest_rating_per_pair",
    with_(INTERACTIONS, _implicit("both", "raw"))
    + "SELECT user_id, item_id, round(max(rating), 6) AS rating FROM implicit GROUP BY 1, 2",
)
def _(spark, sf):
    rows = filters.implicit_ratings(filters.filter_behaviour(interactions(spark, sf), "both"), "raw")
    return filters.highest_rating(rows).select("user_id", "item_id", r6("rating"))


@query(
    "p1_p5_interactions_to_ratings",
    with_(
        INTERACTIONS, _implicit("play_only", "log1p"),
        "best AS (SELECT user_id, item_id, max(rating) AS rating FROM implicit GROUP BY 1, 2)",
        "active AS (SELECT user_id FROM best GROUP BY 1 HAVING count(*) >= 10)",
        f"picked AS (SELECT user_id FROM active ORDER BY {hash_sql('42', 'user_id')}, user_id LIMIT 50)",
    )
    + "SELECT user_id, item_id, round(rating, 6) AS rating FROM best WHERE user_id IN (SELECT user_id FROM picked)",
)
def _(spark, sf):
    rows = ratings_from_interactions(interactions(spark, sf), "play_only", "log1p", 10, 50)
    return rows.select("user_id", "item_id", r6("rating"))


@query(
    "p3_duplicate_pairs",
    with_(INTERACTIONS)
    + "SELECT CAST(user_id AS VARCHAR) AS user_id, game_title AS item_id, count(*) AS n FROM interactions "
    f"WHERE {_BEHAVIOUR} IN ('play', 'purchase') GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(spark, sf):
    return duplicate_pairs(filters.implicit_ratings(filters.filter_behaviour(interactions(spark, sf), "both")))


@query(
    "p4_active_users",
    with_(RATINGS)
    + "SELECT user_id, item_id, rating FROM ratings WHERE user_id IN (SELECT user_id FROM ratings GROUP BY 1 HAVING count(*) >= 40)",
)
def _(spark, sf):
    return filters.active_users(ratings(spark, sf), 40)


@query(
    "p5_sample_users",
    with_(RATINGS, f"picked AS (SELECT DISTINCT user_id, {hash_sql('42', 'user_id')} AS h FROM ratings ORDER BY h, user_id LIMIT 300)")
    + "SELECT user_id, item_id, rating FROM ratings WHERE user_id IN (SELECT user_id FROM picked)",
)
def _(spark, sf):
    return filters.sample_users(ratings(spark, sf), 300)


@query(
    "p6_text_constraints",
    with_(RECIPES)
    + "SELECT item_id FROM recipes WHERE NOT (contains(lower(text), 'salmon') OR contains(lower(text), 'egg') OR contains(lower(text), 'milk')) "
    "AND (contains(lower(text), 'tofu') OR contains(lower(text), 'oil') OR contains(lower(text), 'lemon'))",
)
def _(spark, sf):
    rows = recipes(spark, sf)
    avoid = X.split_terms(F.lit("Salmon, EGG；milk"))
    must = X.split_terms(F.lit("tofu\noil; Lemon"))
    return filters.text_constraints(rows, avoid, must).select("item_id")


@query(
    "p8_head_rows",
    with_(DOC_ITEMS) + "SELECT item_id FROM items ORDER BY item_id LIMIT 100",
)
def _(spark, sf):
    return head_rows(doc_items(spark, sf), "item_id", 100).select("item_id")


@query(
    "p9_clip",
    "SELECT l_orderkey, l_linenumber, least(30.0, greatest(5.0, l_quantity)) AS clipped FROM lineitem",
)
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", clip("l_quantity", 5, 30).alias("clipped"))


_KNOWN_ITEMS = "known_items AS (SELECT DISTINCT CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS item_id FROM events)"


def _known_items(spark, sf):
    """Items that occur in an event."""
    return requests(spark, sf).select("item_id").distinct()


@query(
    "p11_known_items_only",
    with_(RATINGS, _KNOWN_ITEMS) + "SELECT user_id, item_id, rating FROM ratings SEMI JOIN known_items USING (item_id)",
)
def _(spark, sf):
    return filters.known_only(ratings(spark, sf), _known_items(spark, sf), "item_id")


@query(
    "p13_unknown_requests",
    with_(RATINGS, "asked AS (SELECT DISTINCT l_suppkey AS user_id, l_orderkey AS item_id FROM lineitem)")
    + "SELECT user_id, item_id FROM asked WHERE user_id NOT IN (SELECT user_id FROM ratings) OR item_id NOT IN "
    "(SELECT item_id FROM ratings)",
)
def _(spark, sf):
    rows = ratings(spark, sf)
    asked = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("user_id"), F.col("l_orderkey").alias("item_id")).distinct()
    users = rows.select("user_id").distinct()
    new_user = filters.unknown_only(asked, users, "user_id")
    new_item = filters.unknown_only(filters.known_only(asked, users, "user_id"), rows.select("item_id").distinct(), "item_id")
    return new_user.select("user_id", "item_id").unionByName(new_item.select("user_id", "item_id"))


@query(
    "j2_items_with_embeddings",
    with_(DOC_ITEMS, EMBEDDINGS)
    + "SELECT item_id, length(text) AS n, CAST(len(embedding) AS BIGINT) AS dims FROM items JOIN item_emb USING (item_id)",
)
def _(spark, sf):
    from ..operators.textindex import dense_index

    index = dense_index(doc_items(spark, sf), embeddings(spark, sf))
    joined = index.tables["texts"].join(index.tables["vectors"], "item_id")
    return joined.select("item_id", F.length("text").cast("long").alias("n"), F.size("vec").cast("long").alias("dims"))


@query(
    "j4_items_in_use",
    with_(_KNOWN_ITEMS) + "SELECT p_partkey AS item_id, p_name AS text FROM part WHERE p_partkey IN (SELECT item_id FROM known_items)",
)
def _(spark, sf):
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("text"))
    return filters.items_in_use(items, requests(spark, sf))


@query(
    "j5_drop_known",
    with_(RATINGS, REQUESTS) + "SELECT user_id, item_id FROM requests ANTI JOIN ratings USING (user_id, item_id)",
)
def _(spark, sf):
    return filters.drop_known(requests(spark, sf), ratings(spark, sf)).select("user_id", "item_id")


# --- aggregations --------------------------------------------------------------------------------


def _features_sql(side: str) -> str:
    return with_(
        RATINGS, "g AS (SELECT avg(rating) AS gm, coalesce(stddev_samp(rating), 0) AS gs FROM ratings)"
    ) + (
        f"SELECT CAST({side}_id AS VARCHAR) AS {side}_id, count(*) AS {side}_interactions, "
        f"round(avg(rating), 6) AS {side}_rating_mean, round(coalesce(stddev_samp(rating), 0), 6) AS {side}_rating_std, "
        f"min(rating) AS {side}_rating_min, max(rating) AS {side}_rating_max, "
        "round(any_value(gm), 6) AS global_rating_mean, round(any_value(gs), 6) AS global_rating_std "
        f"FROM ratings CROSS JOIN g GROUP BY {side}_id"
    )


def _rounded_features(spark, sf, side):
    out = stats.rating_features(ratings(spark, sf), side)
    rounded = [f"{side}_rating_mean", f"{side}_rating_std", "global_rating_mean", "global_rating_std"]
    return out.select(*[r6(c) if c in rounded else F.col(c) for c in out.columns])


@query("a1_a3_item_features", _features_sql("item"))
def _(spark, sf):
    return _rounded_features(spark, sf, "item")


@query("a2_a3_user_features", _features_sql("user"))
def _(spark, sf):
    return _rounded_features(spark, sf, "user")


@query(
    "a5_popular_items",
    with_(RATINGS, "c AS (SELECT item_id, count(*) AS n FROM ratings GROUP BY 1)")
    + "SELECT item_id, n, CAST(row_number() OVER (ORDER BY n DESC, item_id) AS INTEGER) AS rank FROM c ORDER BY rank LIMIT 25",
)
def _(spark, sf):
    return stats.popular_items(ratings(spark, sf), 25)


@query(
    "a6_ingest_report",
    with_(RATINGS)
    + "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, "
    "(SELECT round(avg(CASE WHEN p_size > 10 THEN 1.0 ELSE 0.0 END), 6) FROM part) AS enriched_text_ratio FROM ratings",
)
def _(spark, sf):
    items = table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.when(F.col("p_size") > 10, F.col("p_name")).otherwise(F.col("p_partkey").cast("string")).alias("text"),
    )
    report = stats.ingest_report(ratings(spark, sf), items)
    return report.withColumn("enriched_text_ratio", r6("enriched_text_ratio"))


@query(
    "a7_column_profile",
    "SELECT 'lang' AS column_name, round(avg(CASE WHEN nullif(lang, 'en') IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate, "
    "count(DISTINCT nullif(lang, 'en')) AS n_distinct FROM documents UNION ALL "
    "SELECT 'source', round(avg(CASE WHEN source IS NULL THEN 1.0 ELSE 0.0 END), 6), count(DISTINCT source) FROM documents UNION ALL "
    "SELECT 'n_chars', round(avg(CASE WHEN n_chars IS NULL THEN 1.0 ELSE 0.0 END), 6), count(DISTINCT n_chars) FROM documents",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.nullif("lang", F.lit("en")).alias("lang"), "source", "n_chars")
    return stats.column_profile(docs).select("column_name", r6("missing_rate"), "n_distinct")


def _describe_sql(measure: str, expression: str, source: str) -> str:
    quantiles = ", ".join(
        f"round(quantile_cont({expression}::DOUBLE, {p}), 6) AS p{round(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95)
    )
    return (
        f"SELECT '{measure}' AS measure, count({expression}) AS n, round(avg({expression}), 6) AS mean, "
        f"round(stddev_samp({expression}), 6) AS std, min({expression})::DOUBLE AS min, {quantiles}, "
        f"max({expression})::DOUBLE AS max FROM {source}"
    )


_PARSED = (
    "parsed AS (SELECT len(list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+'), lambda t: length(t) > 0)) AS words, "
    "n_chars FROM documents)"
)


@query(
    "a8_length_describe",
    with_(_PARSED) + _describe_sql("words", "words", "parsed") + " UNION ALL " + _describe_sql("chars", "n_chars", "parsed"),
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    # word lists arrive as JSON text, as in a raw recipe file
    raw = docs.select(F.to_json(F.filter(F.split("text", X.NON_WORD), lambda t: F.length(t) > 0)).alias("raw"), "n_chars")
    out = stats.describe(raw, {"words": F.size(F.from_json("raw", "array<string>")), "chars": F.col("n_chars")})
    return out.select("measure", "n", *[r6(c) for c in out.columns if c not in ("measure", "n")])


@query("a9_value_counts", "SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return stats.value_counts(table(spark, sf, "documents"), "source")


@query(
    "a10_top_tokens",
    "SELECT token, count(*) AS n FROM (SELECT lower(unnest(string_split(p_name, ' '))) AS token FROM part "
    "UNION ALL SELECT lower(unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))) FROM documents) "
    "GROUP BY 1 ORDER BY n DESC, token LIMIT 30",
)
def _(spark, sf):
    names = table(spark, sf, "part").select(F.to_json(F.split("p_name", " ")).alias("raw"))
    texts = doc_items(spark, sf).select(F.to_json(F.regexp_extract_all("text", F.lit(X.WORD + "+"), F.lit(0))).alias("raw"))
    return stats.top_tokens(names.unionByName(texts), X.json_list("raw"), 30)


@query(
    "a11_duplicate_rate",
    "SELECT 'text' AS column_name, round((count(*) - count(DISTINCT text)) / count(*), 6) AS duplicate_rate FROM documents UNION ALL "
    "SELECT 'lang', round((count(*) - count(DISTINCT lang)) / count(*), 6) FROM documents",
)
def _(spark, sf):
    return stats.duplicate_rate(table(spark, sf, "documents"), ["text", "lang"]).select("column_name", r6("duplicate_rate"))


@query(
    "a12_rating_distribution",
    with_(RATINGS)
    + "SELECT rating, count(*) AS n, (SELECT count(DISTINCT user_id) FROM ratings) AS n_users, "
    "(SELECT count(DISTINCT item_id) FROM ratings) AS n_items FROM ratings GROUP BY rating",
)
def _(spark, sf):
    return stats.rating_distribution(ratings(spark, sf))


@query(
    "a13_data_health",
    with_(
        RATINGS, "pi AS (SELECT item_id, count(*) AS n FROM ratings GROUP BY 1)",
        "ranked AS (SELECT n, row_number() OVER (ORDER BY n DESC, item_id) AS rn, count(*) OVER () AS m FROM pi)",
        "pu AS (SELECT user_id, count(*) AS n FROM ratings GROUP BY 1)",
    )
    + "SELECT count(*) AS n_ratings, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items, "
    "round(1 - count(*) / (count(DISTINCT user_id) * count(DISTINCT item_id)), 6) AS sparsity, "
    "(SELECT round(sum(CASE WHEN rn <= ceil(m * 0.2) THEN n ELSE 0 END) / sum(n), 6) FROM ranked) AS head_item_share, "
    "(SELECT round(avg(CASE WHEN n < 30 THEN 1.0 ELSE 0.0 END), 6) FROM pu) AS cold_user_share FROM ratings",
)
def _(spark, sf):
    out = stats.data_health(ratings(spark, sf), 0.2, 30)
    return out.select("n_ratings", "n_users", "n_items", r6("sparsity"), r6("head_item_share"), r6("cold_user_share"))


_COHORT = [
    "per_user AS (SELECT user_id, count(*) AS n FROM {source} GROUP BY 1)",
    "cut AS (SELECT CASE WHEN count(*) FILTER (n <= 5) >= 10 THEN 5.0 WHEN count(*) FILTER (n <= 10) >= 10 THEN 10.0 "
    "WHEN count(*) FILTER (n <= 15) >= 10 THEN 15.0 WHEN count(*) FILTER (n <= 20) >= 10 THEN 20.0 "
    "WHEN count(*) FILTER (n <= 20) > 0 THEN 20.0 ELSE quantile_cont(n, 0.2) END::DOUBLE AS threshold FROM per_user)",
    "cohort AS (SELECT user_id, n, threshold FROM per_user CROSS JOIN cut WHERE n <= threshold)",
]


def cohort_ctes(source: str) -> list[str]:
    return [c.replace("{source}", source) for c in _COHORT]


@query("a14_new_user_cohort", with_(RATINGS, *cohort_ctes("ratings")) + "SELECT user_id, n, threshold FROM cohort")
def _(spark, sf):
    return stats.new_user_cohort(ratings(spark, sf))


# --- expressions ---------------------------------------------------------------------------------


@query(
    "x1_split_terms",
    "SELECT doc_id, unnest(t) AS term, CAST(generate_subscripts(t, 1) AS BIGINT) AS pos FROM (SELECT doc_id, list_filter(list_transform("
    "regexp_split_to_array(text, '[，,;；\\n]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 0) AS t FROM documents)",
)
def _(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(X.split_terms("text")).alias("p", "term"))
    return rows.select("doc_id", "term", (F.col("p") + 1).cast("long").alias("pos"))


_PHRASES = (
    "phrases AS (SELECT item_id, list_distinct(list_transform(list_filter(list_transform(regexp_split_to_array("
    "regexp_extract(text, '(?m)^ingredients:(.*)$', 1), '[;,]+'), lambda x: trim(lower(x))), lambda x: length(x) > 0), "
    "lambda x: regexp_replace(x, '\\s+', ' ', 'g'))) AS ing, "
    "lower(regexp_extract(text, '(?m)^directions:(.*)$', 1)) AS d FROM recipes)"
)


@query("x2_ingredient_phrases", with_(RECIPES, _PHRASES) + "SELECT item_id, unnest(ing) AS phrase FROM phrases")
def _(spark, sf):
    return recipes(spark, sf).select("item_id", F.explode(R.ingredient_phrases("text")).alias("phrase"))


def _has(words: list[str], text: str = "j") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _hits(words: list[str], text: str = "j") -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{w}') AS INTEGER)" for w in words) + ")"


_META_CTES = [
    RECIPES, _PHRASES,
    "joined AS (SELECT item_id, len(ing) AS cnt, array_to_string(ing, ' ; ') AS j, d, "
    "try_cast(regexp_extract(d, '(\\d+)\\s*(?:-|to)\\s*(\\d+)\\s*(?:minutes?|mins?)', 2) AS INTEGER) AS hi, "
    "coalesce(try_cast(regexp_extract(d, '(\\d+)\\s*(?:minutes?|mins?)', 1) AS INTEGER), 0) + "
    "60 * coalesce(try_cast(regexp_extract(d, '(\\d+)\\s*(?:hours?|hrs?|hr)\\b', 1) AS INTEGER), 0) AS total FROM phrases)",
    f"scored AS (SELECT *, least({_hits(R.HIGH_CALORIE_WORDS)}, 8) + CASE WHEN {_has(R.FRY_WORDS, 'd')} THEN 2.0 ELSE 0.0 END AS pen, "
    f"least({_hits(R.LOW_CALORIE_WORDS, '(j || chr(10) || d)')}, 4) + CASE WHEN {_has(R.LIGHT_COOKING_WORDS, 'd')} THEN 0.5 ELSE 0.0 END AS low FROM joined)",
    "meta AS (SELECT CAST(item_id AS VARCHAR) AS item_id, CASE WHEN hi IS NOT NULL THEN hi WHEN total > 0 THEN total END AS time_min, "
    f"CAST(cnt AS INTEGER) AS ingredients_count, CAST({_hits(R.PROTEIN_WORDS)} + CASE WHEN contains(j, 'protein') THEN 0.5 ELSE 0 END AS DOUBLE) AS protein_score, "
    "CAST(greatest(0, least(5, low - 0.5 * pen)) AS DOUBLE) AS low_calorie_score, CAST(pen AS DOUBLE) AS high_calorie_penalty, "
    + ", ".join(f"{_has(words)} AS {name}" for name, words in R.ALLERGENS.items())
    + " FROM scored)",
]


@query("t7_x4_x7_recipe_metadata", with_(*_META_CTES) + "SELECT * FROM meta")
def _(spark, sf):
    return recipe_metadata(recipes(spark, sf))


@query(
    "p7_j8_metadata_limits",
    with_(*_META_CTES)
    + "SELECT CAST(item_id AS BIGINT) AS item_id, time_min, protein_score FROM meta WHERE (time_min IS NULL OR time_min <= 30) AND protein_score >= 2",
)
def _(spark, sf):
    from ..operators.recipes import attach_metadata

    rows = recipes(spark, sf)
    joined = attach_metadata(rows, recipe_metadata(rows))
    kept = filters.metadata_limits(joined, max_time=30, goal=F.lit(R.GOAL_HIGH_PROTEIN))
    return kept.select("item_id", "time_min", "protein_score")


@query(
    "u2_jaccard_next_item",
    with_(RECIPES, _PHRASES, "n AS (SELECT item_id - 1 AS item_id, ing AS other FROM phrases)")
    + "SELECT item_id, round(len(list_intersect(ing, other)) / len(list_distinct(list_concat(ing, other))), 6) AS jaccard FROM phrases JOIN n USING (item_id)",
)
def _(spark, sf):
    sets = recipes(spark, sf).select("item_id", R.ingredient_phrases("text").alias("a"))
    following = sets.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    return sets.join(following, "item_id").select("item_id", r6(R.jaccard("a", "b"), "jaccard"))


@query(
    "u3_expand_avoid_terms",
    with_(
        "base AS (SELECT p_partkey AS item_id, CASE p_partkey % 4 WHEN 0 THEN ['milk', 'egg'] WHEN 1 THEN ['nut'] WHEN 2 THEN ['peanut', 'cream', 'dairy'] ELSE ['pork'] END AS b FROM part)",
        f"dairy AS (SELECT item_id, unnest({R.DAIRY_WORDS + ['dairy']}) AS term FROM base WHERE list_has_any(b, ['milk', 'dairy']))",
        f"nuts AS (SELECT item_id, unnest({R.TREE_NUT_WORDS + ['nuts', 'nut']}) AS term FROM base WHERE list_has_any(b, ['nuts', 'nut']))",
        "pea AS (SELECT item_id, unnest(['peanut', 'peanuts']) AS term FROM base WHERE list_contains(b, 'peanut'))",
    )
    + "SELECT item_id, unnest(b) AS term FROM base UNION SELECT * FROM dairy UNION SELECT * FROM nuts UNION SELECT * FROM pea",
)
def _(spark, sf):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, "Milk, egg").when(k == 1, " nut ").when(k == 2, "peanut;cream；Dairy").otherwise("pork")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), R.expand_avoid_terms(X.split_terms(raw)).alias("t"))
    return rows.select("item_id", F.explode("t").alias("term"))


@query(
    "x9_query_intent",
    with_("q AS (SELECT p_partkey AS item_id, p_size, p_type FROM part)")
    + "SELECT item_id, CASE p_type WHEN 'ECONOMY' THEN p_size WHEN 'PROMO' THEN p_size END AS minutes, "
    "p_type IN ('ECONOMY', 'SMALL') AS high_protein, p_type = 'PROMO' AS low_calorie FROM q",
)
def _(spark, sf):
    size, kind = F.col("p_size").cast("string"), F.col("p_type")
    text = (
        F.when(kind == "ECONOMY", F.concat(F.lit("High Protein dinner UNDER "), size, F.lit(" minutes")))
        .when(kind == "PROMO", F.concat(F.lit("low-calorie snack ready in "), size, F.lit(" minute")))
        .when(kind == "SMALL", F.lit("protein please"))
        .when(kind == "LARGE", F.lit("low protein"))
        .otherwise(F.lit("anything"))
    )
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"), X.query_time_limit(text).alias("minutes"),
        X.wants_high_protein(text).alias("high_protein"), X.wants_low_calorie(text).alias("low_calorie"),
    )


@query(
    "x10_keyword_overlap",
    "SELECT a.conv_id, a.turn, round(len(list_filter(q, lambda t: contains(lower(b.text), t))) / len(q), 6) AS overlap FROM "
    "(SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda t: length(t) > 0) AS q "
    "FROM conversations) a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE len(q) > 0",
)
def _(spark, sf):
    talk = table(spark, sf, "conversations")
    following = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    rows = talk.filter(F.size(X.words("text")) > 0).join(following, ["conv_id", "turn"])
    return rows.select("conv_id", "turn", r6(X.keyword_overlap("text", "reply"), "overlap"))


@query(
    "x11_normalize_name",
    "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '[^a-z0-9 ]+', '', 'g') AS name FROM documents",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalize_name("text").alias("name"))


@query(
    "x14_labelled_concat",
    "SELECT p_partkey, concat_ws(' | ', 'p_name: ' || p_name, 'p_brand: ' || nullif(CASE WHEN p_size > 20 THEN p_brand ELSE '  ' END, '  '), 'p_size: ' || p_size) AS text FROM part",
)
def _(spark, sf):
    rows = table(spark, sf, "part").withColumn("p_brand", F.when(F.col("p_size") > 20, F.col("p_brand")).otherwise("  "))
    return rows.select("p_partkey", X.labelled_concat(["p_name", "p_brand", "p_size"]).alias("text"))


@query(
    "x16_preview",
    "SELECT doc_id, CASE WHEN length(t) > 140 THEN substr(t, 1, 140) || '…' ELSE t END AS preview, "
    "CASE WHEN length(s) > 240 THEN substr(s, 1, 240) || '...' ELSE s END AS summary FROM (SELECT doc_id, "
    "regexp_replace(replace(text, chr(10), ' '), '^\\s+|\\s+$', '', 'g') AS t, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM documents)",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.preview("text").alias("preview"), X.summary("text").alias("summary"))


@query(
    "x19_kernels",
    with_(
        "v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)",
        "p AS (SELECT a.vec_id, sum(a.x * b.x) AS dot, sum((a.x - b.x) * (a.x - b.x)) AS dist FROM v a JOIN v b "
        "ON b.vec_id = a.vec_id + 1 AND a.d = b.d GROUP BY 1)",
    )
    + "SELECT vec_id, round(3 + 0.1 + 0.2 + dot, 6) AS linear, round(1 + 4 / (1 + exp(-(3 + 0.1 + 0.2 + dot))), 6) AS sigmoid, "
    "round(1 + 4 * exp(-0.5 * dist), 6) AS rbf FROM p",
)
def _(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("p"))
    following = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q"))
    score = lambda k: r6(kernel_score(k, 3.0, F.lit(0.1), F.lit(0.2), "p", "q", 0.5, 1, 5), k)
    return vectors.join(following, "vec_id").select("vec_id", score("linear"), score("sigmoid"), score("rbf"))


@query("x20_number_or_zero", with_(INTERACTIONS) + f"SELECT user_id, game_title, {_NUMBER} AS value FROM interactions")
def _(spark, sf):
    return interactions(spark, sf).select("user_id", "game_title", number_or_zero("value").alias("value"))


@query(
    "u1_hybrid_list",
    with_(
        RATINGS,
        "own AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS rk FROM ratings)",
        "pop AS (SELECT item_id, row_number() OVER (ORDER BY n DESC, item_id) AS pl FROM (SELECT item_id, count(*) AS n FROM ratings GROUP BY 1)) ",
        "u AS (SELECT user_id, item_id, 0 AS src, rk AS pl FROM own WHERE rk <= 5 UNION ALL "
        "SELECT user_id, pop.item_id, 1, pl FROM (SELECT user_id FROM own UNION SELECT user_id FROM events) CROSS JOIN pop WHERE pl <= 20)",
        "f AS (SELECT user_id, item_id, min(src * 1000 + pl) AS o FROM u GROUP BY 1, 2)",
    )
    + "SELECT user_id, item_id, CASE WHEN o < 1000 THEN 'model' ELSE 'popular' END AS source, "
    "CAST(row_number() OVER (PARTITION BY user_id ORDER BY o, item_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10",
)
def _(spark, sf):
    from ..operators.ranking import top_k

    rows = ratings(spark, sf)
    own = top_k(rows, ["user_id"], [F.desc("rating"), F.asc("item_id")], 10)
    return coldstart.hybrid_list(own, rows, 10, 0.5, requests(spark, sf).select("user_id"))


@query(
    "m17_new_user_list",
    with_(DOC_ITEMS) + f"SELECT item_id FROM items ORDER BY {hash_sql('42', 'item_id')}, item_id LIMIT 20",
)
def _(spark, sf):
    return content_new_user_list(doc_items(spark, sf), 20)

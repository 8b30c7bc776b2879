"""Queries over text and vector indexes, reranking, lists and judging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import recipes as R
from ..functions import text as X
from ..operators import rerank
from ..operators.cells import fit_cells, search_cells
from ..operators.diversify import select_diverse
from ..operators.judge import AVOID_HIT, MUST_MISS, judge, sanitize_violations
from ..operators.metrics import intra_list_diversity
from ..operators.ranking import blend, minmax, stable, top_k
from ..operators.recipes import recipe_metadata
from ..operators.search import search_topk
from ..operators.textindex import encode, fit_tfidf, keyword_enrichment, load_index, postings, search, stored_vectors
from ..plans.evaluate import case_reports
from ..plans.retrieve import answer_questionnaires, recommend_free_text
from ..session import cut_lineage
from .base import (
    DOC_ITEMS, ORACLES, RATINGS, RECIPES, als_ctes, benchmark_queries, bucket_sql, doc_items, embeddings, query, r6, recipes,
    scratch, shared, table, with_,
)
from .data import _META_CTES, _PHRASES
from .models import als3


def doc_index(spark, sf):
    return stored_vectors(doc_terms(spark, sf))


def doc_terms(spark, sf):
    """The same index for queries that need its vocabulary only: vectors stay a plan until ``doc_index`` asks for them."""
    return shared(spark, sf, "doc_index", lambda: fit_tfidf(doc_items(spark, sf)))


def recipe_index(spark, sf):
    return stored_vectors(shared(spark, sf, "recipe_index", lambda: fit_tfidf(recipes(spark, sf))))


# --- TF-IDF in SQL -------------------------------------------------------------------------------

_STOP = "stop AS (SELECT unnest([" + ", ".join(f"'{w}'" for w in X.ENGLISH_STOP_WORDS) + "]) AS term)"
_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"


def tfidf_ctes(source: str, key: str = "item_id", max_features: int | None = None, min_df: int = 2, bigrams: bool = False) -> list[str]:
    """``vocab(term, df, idf)`` and ``post(item_id, term, weight)`` of a table ``key, text``."""
    tokens = (
        f"kept AS (SELECT {key}, term, row_number() OVER (PARTITION BY {key} ORDER BY pos) AS pos FROM (SELECT {key}, unnest({_WORDS}) AS term, "
        f"generate_subscripts({_WORDS}, 1) AS pos FROM {source}) ANTI JOIN stop USING (term))"
    )
    grams = f"grams AS (SELECT {key}, term FROM kept"
    if bigrams:
        grams += f" UNION ALL SELECT a.{key}, a.term || ' ' || b.term FROM kept a JOIN kept b ON a.{key} = b.{key} AND b.pos = a.pos + 1"
    return [
        _STOP, tokens, grams + ")",
        f"tf AS MATERIALIZED (SELECT {key}, term, count(*) AS tf FROM grams GROUP BY 1, 2)",
        f"vocab AS MATERIALIZED (SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM {source})) / (1 + count(*))) + 1 AS idf, sum(tf) AS total FROM tf "
        f"GROUP BY 1 HAVING count(*) >= {min_df} " + (f"ORDER BY total DESC, term LIMIT {max_features})" if max_features else ")"),
        f"wt AS (SELECT {key}, term, tf * idf AS w FROM tf JOIN vocab USING (term))",
        f"post AS MATERIALIZED (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM wt)",
    ]


def encoded_ctes(source: str, key: str = "query_id") -> list[str]:
    """``enc(query_id, term, weight)``: query vectors with the vocabulary of the index."""
    return [
        f"qtf AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({_WORDS}) AS term FROM {source}) JOIN vocab USING (term) GROUP BY 1, 2)",
        f"qw AS (SELECT {key}, term, tf * idf AS w FROM qtf JOIN vocab USING (term))",
        f"enc AS MATERIALIZED (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM qw)",
    ]


def found_ctes(k: int) -> list[str]:
    return [
        "sims AS (SELECT query_id, item_id, sum(enc.weight * post.weight) AS sim FROM enc JOIN post USING (term) GROUP BY 1, 2)",
        f"found AS MATERIALIZED (SELECT query_id, item_id, sim, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, item_id) AS INTEGER) AS rank "
        f"FROM sims WHERE round(sim, 9) > 0 QUALIFY rank <= {k})",
    ]


_BENCH = "qs AS (SELECT item_id AS query_id, text FROM benchmark)"
_DOC_SEARCH = [DOC_ITEMS, _BENCH, *tfidf_ctes("items"), *encoded_ctes("qs"), *found_ctes(50)]


@query("t1_vocabulary", with_(DOC_ITEMS, *tfidf_ctes("items")) + "SELECT term, df, round(idf, 6) AS idf FROM vocab")
def _(spark, sf):
    return doc_terms(spark, sf).tables["vocabulary"].select("term", "df", r6("idf"))


@query(
    "t1_postings",
    with_(DOC_ITEMS, *tfidf_ctes("items")) + "SELECT item_id, count(*) AS terms, round(sum(weight), 6) AS total, round(max(weight), 6) AS top FROM post GROUP BY 1",
)
def _(spark, sf):
    rows = postings(doc_index(spark, sf))
    return rows.groupBy("item_id").agg(
        F.count("term").alias("terms"), r6(F.sum("weight"), "total"), r6(F.max("weight"), "top")
    )


@query(
    "t1_bigram_vocabulary",
    with_(RECIPES, *tfidf_ctes("recipes", max_features=300, bigrams=True)) + "SELECT term, df, round(idf, 6) AS idf FROM vocab",
)
def _(spark, sf):
    index = fit_tfidf(recipes(spark, sf), max_features=300, ngram_max=2)
    return index.tables["vocabulary"].select("term", "df", r6("idf"))


@query(
    "t2_encoded_queries",
    with_(DOC_ITEMS, _BENCH, *tfidf_ctes("items"), *encoded_ctes("qs")) + "SELECT query_id, term, round(weight, 6) AS weight FROM enc",
)
def _(spark, sf):
    index = doc_terms(spark, sf)
    vectors = encode(benchmark_queries(spark, sf), index.tables["vocabulary"], index.meta, "query_id")
    pairs = vectors.select("query_id", F.inline(F.arrays_zip("idx", "w"))).withColumnRenamed("idx", "term_no")
    return pairs.join(index.tables["vocabulary"], "term_no").select("query_id", "term", r6("w", "weight"))


@query("t3_j9_w2_sparse_top50", with_(*_DOC_SEARCH) + "SELECT query_id, item_id, round(sim, 6) AS sim, rank FROM found")
def _(spark, sf):
    found = search(doc_index(spark, sf), benchmark_queries(spark, sf), 50)
    return found.select("query_id", "item_id", r6("sim"), "rank")


_DENSE_TOP10 = (
    with_(
        "v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)",
        "s AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id, sum(a.x * b.x) AS sim FROM v a JOIN v b USING (d) GROUP BY 1, 2)",
    )
    + "SELECT query_id, item_id, round(sim, 6) AS sim, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, item_id) AS INTEGER) AS rank "
    "FROM s QUALIFY rank <= 10"
)


@query("t4_j10_dense_top10", _DENSE_TOP10)
def _(spark, sf):
    items = embeddings(spark, sf).withColumnRenamed("embedding", "vec")
    found = search_topk(items.withColumnRenamed("item_id", "query_id"), items, 10, "dense")
    return found.select("query_id", "item_id", r6("sim"), "rank")


@query("t4_j10_cells_top10", _DENSE_TOP10)
def _(spark, sf):
    items = embeddings(spark, sf).withColumnRenamed("embedding", "vec")
    found = search_cells(fit_cells(items, 64), items.withColumnRenamed("item_id", "query_id"), 10, exact=True)
    return found.select("query_id", "item_id", r6("sim"), "rank")


@query(
    "t6_w5_keyword_enrichment",
    with_(
        RECIPES, *tfidf_ctes("recipes", bigrams=True),
        "best AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY round(weight, 9) DESC, term) AS rk FROM post QUALIFY rk <= 8)",
        "tg AS (SELECT item_id, string_agg(term, ',' ORDER BY rk) AS tags FROM best GROUP BY 1)",
    )
    + "SELECT item_id, coalesce(tags, '') AS tags, text AS summary FROM recipes LEFT JOIN tg USING (item_id)",
)
def _(spark, sf):
    out = keyword_enrichment(recipes(spark, sf))
    return out.select("item_id", F.array_join("tags", ",").alias("tags"), "summary")


@query(
    "w6_minmax_per_query",
    with_(
        *_DOC_SEARCH,
        "lim AS (SELECT query_id, min(sim) AS lo, max(sim) AS hi FROM found GROUP BY 1)",
    )
    + "SELECT query_id, item_id, round(CASE WHEN hi - lo < 1e-8 THEN 0 ELSE (sim - lo) / (hi - lo) END, 6) AS scaled FROM found JOIN lim USING (query_id)",
)
def _(spark, sf):
    found = search(doc_index(spark, sf), benchmark_queries(spark, sf), 50)
    return found.select("query_id", "item_id", r6(minmax("sim", ["query_id"]), "scaled"))


_BLENDED = [
    "us AS (SELECT query_id, CASE WHEN query_id % 4 = 3 THEN NULL ELSE query_id END AS user_id FROM qs)",
    "ms AS (SELECT f.*, CASE WHEN user_id IS NULL THEN 0 ELSE (SELECT m FROM mu) + coalesce(bu, 0) + coalesce(bi, 0) END AS ms FROM found f JOIN us USING (query_id) "
    "LEFT JOIN bu3 USING (user_id) LEFT JOIN bi3 USING (item_id))",
    "lim AS (SELECT query_id, min(sim) AS lo, max(sim) AS hi, min(ms) AS mlo, max(ms) AS mhi FROM ms GROUP BY 1)",
    "bl AS (SELECT query_id, item_id, sim, ms, 0.7 * CASE WHEN mhi - mlo < 1e-8 THEN 0 ELSE (ms - mlo) / (mhi - mlo) END "
    "+ (1 - 0.7) * CASE WHEN hi - lo < 1e-8 THEN 0 ELSE (sim - lo) / (hi - lo) END AS score FROM ms JOIN lim USING (query_id))",
]


@query(
    "r9_w7_w8_free_text",
    with_(RATINGS, *als_ctes(3), *_DOC_SEARCH, *_BLENDED)
    + "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, round(sim, 9) DESC, item_id) AS INTEGER) AS rank, item_id, "
    "round(score, 6) AS score, round(sim, 6) AS sim, round(ms, 6) AS model_score, "
    "CASE WHEN query_id % 4 = 3 THEN 'text similarity' ELSE 'blend: 0.70*model + 0.30*text similarity' END AS reason FROM bl QUALIFY rank <= 10",
)
def _(spark, sf):
    asked = benchmark_queries(spark, sf).withColumn("user_id", F.when(F.col("query_id") % 4 != 3, F.col("query_id")))
    out = recommend_free_text(asked, doc_index(spark, sf), als3(spark, sf), 10, 50, 0.7)
    return out.select("query_id", "rank", "item_id", r6("score"), r6("sim"), r6("model_score"), "reason")


_CONVERSATIONS = "qs AS (SELECT conv_id * 100000 + turn AS query_id, text FROM conversations)"


@query(
    "r9_conversation_requests",
    with_(DOC_ITEMS, _CONVERSATIONS, *tfidf_ctes("items"), *encoded_ctes("qs"), *found_ctes(5))
    + "SELECT query_id, item_id, round(sim, 6) AS sim, rank FROM found",
)
def _(spark, sf):
    talk = table(spark, sf, "conversations")
    asked = talk.select((F.col("conv_id") * 100000 + F.col("turn")).alias("query_id"), "text")
    return search(doc_index(spark, sf), asked, 5).select("query_id", "item_id", r6("sim"), "rank")


@query(
    "s14_index_round_trip",
    with_(
        RECIPES, "qs AS (SELECT item_id AS query_id, text FROM recipes)", *tfidf_ctes("recipes"), *encoded_ctes("qs"), *found_ctes(3)
    )
    + "SELECT query_id, item_id, round(sim, 6) AS sim, rank FROM found",
)
def _(spark, sf):
    path = scratch(spark, sf, "index")
    recipe_index(spark, sf).save(path)
    index = load_index(spark, path)
    asked = recipes(spark, sf).select(F.col("item_id").alias("query_id"), "text")
    return search(index, asked, 3).select("query_id", "item_id", r6("sim"), "rank")


# --- weak supervision and reranking --------------------------------------------------------------


def _pick_sql(choices: list, salt: str) -> str:
    quoted = ", ".join(repr(c) for c in choices)
    return f"([{quoted}])[1 + {bucket_sql(salt, len(choices), 'item_id')}]"


_GENERATED = [
    *_META_CTES,
    "ph AS (SELECT item_id, phrase, row_number() OVER (PARTITION BY item_id ORDER BY md5(concat_ws(':', '42', CAST(item_id AS VARCHAR), phrase)), phrase) AS rk "
    "FROM (SELECT item_id, unnest(ing) AS phrase FROM phrases) WHERE length(phrase) BETWEEN 2 AND 24 QUALIFY rk <= 2)",
    "pk AS (SELECT item_id, string_agg(phrase, ' and ' ORDER BY rk) AS words FROM ph GROUP BY 1)",
    f"bs AS (SELECT r.item_id, {_pick_sql(rerank.GOALS, 'goal42').replace('CAST(item_id', 'CAST(r.item_id')} || ' ' || "
    f"{_pick_sql(rerank.MEALS, 'meal42').replace('CAST(item_id', 'CAST(r.item_id')} || coalesce(' with ' || words, '') AS base, "
    f"CASE WHEN time_min IS NULL THEN {_pick_sql(rerank.MINUTES, 'minutes42').replace('CAST(item_id', 'CAST(r.item_id')} WHEN time_min <= 30 THEN 30 "
    "WHEN time_min <= 45 THEN 45 ELSE 60 END AS t, has_dairy, has_tree_nuts OR has_peanut AS nuts FROM recipes r JOIN meta ON meta.item_id = CAST(r.item_id AS VARCHAR) "
    "LEFT JOIN pk ON pk.item_id = r.item_id)",
    "gq AS (SELECT item_id, 1 AS query_no, base AS query FROM bs UNION ALL SELECT item_id, 2, base || ' under ' || t || ' minutes' FROM bs UNION ALL "
    "SELECT item_id, 3, base || ' no dairy' FROM bs WHERE has_dairy UNION ALL "
    "SELECT item_id, CASE WHEN has_dairy THEN 4 ELSE 3 END, base || ' no nuts' FROM bs WHERE nuts)",
]


@query("r1_generated_queries", with_(*_GENERATED) + "SELECT item_id, query_no, query FROM gq")
def _(spark, sf):
    return rerank.generate_queries(recipes(spark, sf))


@query(
    "u4_dedup_queries",
    "SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY no) AS INTEGER) AS query_no, query FROM (SELECT conv_id AS item_id, min(turn) AS no, "
    "arg_min(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), turn) AS query, regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS norm "
    "FROM conversations GROUP BY conv_id, norm) WHERE length(norm) > 0 QUALIFY query_no <= 4",
)
def _(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("item_id"), F.col("turn").alias("query_no"), F.col("text").alias("query")
    )
    return rerank.dedup_queries(rows)


@query(
    "r2_hard_negatives",
    with_(
        *_GENERATED, "qs AS (SELECT item_id || '#' || query_no AS query_id, query AS text, item_id AS seed_id FROM gq)",
        *tfidf_ctes("recipes"), *encoded_ctes("qs"), *found_ctes(80),
        "lb AS (SELECT f.query_id, text AS query, seed_id, item_id, sim FROM found f JOIN qs USING (query_id))",
        "pos AS (SELECT * FROM lb WHERE item_id = seed_id)",
        "neg AS (SELECT * FROM lb SEMI JOIN pos USING (query_id) WHERE item_id <> seed_id "
        "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY md5(concat_ws(':', '42', query_id, CAST(item_id AS VARCHAR))), item_id) <= 10)",
    )
    + "SELECT query_id, query, seed_id, item_id, round(sim, 6) AS sim, 1 AS label FROM pos UNION ALL SELECT query_id, query, seed_id, item_id, round(sim, 6), 0 FROM neg",
)
def _(spark, sf):
    pairs = rerank.hard_negatives(recipe_index(spark, sf), rerank.generate_queries(recipes(spark, sf)), 80, 10)
    return pairs.withColumn("sim", r6("sim"))


_PAIRS = [
    *_META_CTES, _BENCH.replace("SELECT item_id AS query_id, text", "SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'high protein dinner under 20 minutes' "
    "WHEN 1 THEN 'low calorie lunch with tofu' ELSE 'egg and lemon, ready in 45 minutes' END AS text"),
    *tfidf_ctes("recipes"), *encoded_ctes("qs"), *found_ctes(30),
]


def _pairs(spark, sf):
    kind = F.col("item_id") % 3
    text = (
        F.when(kind == 0, "high protein dinner under 20 minutes").when(kind == 1, "low calorie lunch with tofu")
        .otherwise("egg and lemon, ready in 45 minutes")
    )
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("text"))
    found = search(recipe_index(spark, sf), asked, 30)
    return found.join(asked.withColumnRenamed("text", "query"), "query_id").join(recipes(spark, sf), "item_id")


_PAIR_FEATURES = [
    *_PAIRS,
    "limits AS (SELECT query_id, text AS query, CASE query_id % 3 WHEN 0 THEN 20 WHEN 2 THEN 45 END AS lim, query_id % 3 = 0 AS want_p, query_id % 3 = 1 AS want_c, "
    "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda t: length(t) > 0) AS q FROM qs)",
    "feat AS (SELECT query_id, f.item_id, sim, rank, len(list_filter(q, lambda t: contains(lower(r.text), t))) / len(q) AS kw_overlap, "
    + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in R.ALLERGENS)
    + ", coalesce(time_min, -1)::DOUBLE AS time_min, CASE WHEN lim IS NOT NULL AND time_min IS NOT NULL AND time_min > lim THEN 0.0 ELSE 1.0 END::DOUBLE AS time_ok, "
    "protein_score, CASE WHEN want_p AND protein_score < 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS protein_ok, low_calorie_score, "
    "CASE WHEN want_c AND low_calorie_score < 1 THEN 0.0 ELSE 1.0 END::DOUBLE AS low_calorie_ok, ingredients_count::DOUBLE AS ingredients_count "
    "FROM found f JOIN limits USING (query_id) JOIN recipes r ON r.item_id = f.item_id JOIN meta ON meta.item_id = CAST(f.item_id AS VARCHAR))",
]


@query(
    "r3_pair_features",
    with_(*_PAIR_FEATURES)
    + "SELECT query_id, item_id, round(sim, 6) AS sim, round(kw_overlap, 6) AS kw_overlap, "
    + ", ".join(f for f in rerank.FEATURES if f not in ("sim", "kw_overlap"))
    + " FROM feat",
)
def _(spark, sf):
    out = rerank.pair_features(_pairs(spark, sf), recipe_metadata(recipes(spark, sf)))
    return out.select("query_id", "item_id", *[r6(f) if f in ("sim", "kw_overlap") else F.col(f) for f in rerank.FEATURES])


@query("r4_train_reranker")
def _(spark, sf):
    samples = rerank.training_samples(recipe_index(spark, sf), recipes(spark, sf), 40, 5)
    model, info = rerank.train_reranker(cut_lineage(samples))
    weights = list(zip(info["features"], [float(w) for w in model.coefficients]))
    out = spark.createDataFrame(weights, "feature string, weight double")
    return out.withColumns({"n_samples": F.lit(info["n_samples"]), "pos_rate": F.lit(info["pos_rate"])})


@query(
    "r4_training_facts",
    f"SELECT count(*) AS n_samples, round(avg(label), 6) AS pos_rate, true AS separates FROM ({ORACLES['r2_hard_negatives']})",
)
def _(spark, sf):
    """What SQL can say about training: the samples, their share of positives, and an AUC well above one half."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    samples = cut_lineage(rerank.training_samples(recipe_index(spark, sf), recipes(spark, sf), 80, 10))
    model, info = rerank.train_reranker(samples)
    scored = rerank.rerank_probability(model, samples).withColumn("label", F.col("label").cast("double"))
    auc = BinaryClassificationEvaluator(rawPredictionCol="rerank_p").evaluate(scored)
    return spark.createDataFrame([(info["n_samples"], round(info["pos_rate"], 6), auc > 0.55)], "n_samples long, pos_rate double, separates boolean")


@query(
    "r5_rerank_blend",
    with_(
        *_PAIR_FEATURES,
        "b AS (SELECT query_id, item_id, sim, (kw_overlap + protein_ok + low_calorie_ok) / 3 AS p FROM feat)",
        "lim2 AS (SELECT query_id, min(sim) AS lo, max(sim) AS hi, min(p) AS plo, max(p) AS phi FROM b GROUP BY 1)",
    )
    + "SELECT query_id, item_id, round((1 - 0.6) * CASE WHEN hi - lo < 1e-8 THEN 0 ELSE (sim - lo) / (hi - lo) END + "
    "0.6 * CASE WHEN phi - plo < 1e-8 THEN 0 ELSE (p - plo) / (phi - plo) END, 6) AS score FROM b JOIN lim2 USING (query_id)",
)
def _(spark, sf):
    rows = rerank.pair_features(_pairs(spark, sf), recipe_metadata(recipes(spark, sf)))
    given = rows.withColumn("rerank_p", (F.col("kw_overlap") + F.col("protein_ok") + F.col("low_calorie_ok")) / 3)
    out = rerank.rerank_blend(given.withColumn("score", F.col("sim")), ["query_id"], 0.6)
    return out.select("query_id", "item_id", r6("score"))


def _greedy_ctes(n: int, penalty: float) -> list[str]:
    """``picked1..n``: the greedy choice, one step after the other."""
    out = []
    for k in range(1, n + 1):
        worst, seen = "0", ""
        if k > 1:
            overlap = "len(list_intersect(c.ing, p.ing)) / greatest(1, len(list_distinct(list_concat(c.ing, p.ing))))"
            worst = f"(SELECT max({overlap}) FROM picked{k - 1} p WHERE p.query_id = c.query_id)"
            seen = f" ANTI JOIN picked{k - 1} USING (query_id, item_id)"
        before = f"SELECT * FROM picked{k - 1} UNION ALL " if k > 1 else ""
        out.append(f"cost{k} AS MATERIALIZED (SELECT *, round(sim - {penalty} * {worst}, 9) AS v FROM cand c{seen})")
        out.append(
            f"picked{k} AS MATERIALIZED ({before}SELECT query_id, item_id, pos, sim, ing, {k}::INTEGER AS rank FROM cost{k} "
            "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY v DESC, pos) = 1)"
        )
    return out


@query(
    "r6_diverse_selection",
    with_(
        *_PAIRS, "cand AS (SELECT query_id, f.item_id, rank AS pos, sim, ing FROM found f JOIN phrases p ON p.item_id = f.item_id)",
        *_greedy_ctes(5, 0.25),
    )
    + "SELECT query_id AS session_id, 0::INTEGER AS meal_no, item_id, rank, round(sim, 6) AS score FROM picked5",
)
def _(spark, sf):
    rows = _pairs(spark, sf).select(
        F.col("query_id").alias("session_id"), F.lit(0).alias("meal_no"), F.col("rank").alias("position"), "item_id",
        F.col("sim").alias("score"), R.ingredient_phrases("text").alias("ingredients"),
    )
    return select_diverse(rows, 5).withColumn("score", r6("score"))


_GOALS = list(R.GOALS)


def questionnaires(spark, sf):
    """One request per customer."""
    n = F.col("c_custkey")
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))
    return table(spark, sf, "customer").select(
        n.alias("request_id"), pick(_GOALS).alias("goal"), pick(list(R.MEALS)).alias("meal"),
        F.when(n % 2 == 0, F.array(pick(list(R.CUISINES)))).otherwise(F.array().cast("array<string>")).alias("cuisines"),
        F.when(n % 3 == 0, F.array(pick(list(R.DIETS)))).otherwise(F.array().cast("array<string>")).alias("dietary"),
        F.when(n % 5 == 0, "tofu, lemon").otherwise("").alias("must_include"),
        F.when(n % 4 == 0, "milk；salmon").when(n % 4 == 1, "nut").otherwise("").alias("avoid"),
        F.when(n % 7 == 0, 30).otherwise(0).alias("max_time"),
        F.when(n % 2 == 1, "chicken or beans with soy").otherwise("tofu egg shrimp").alias("extra"),
        (n % 6 == 0).alias("daily_plan"), (n % 12 == 0).alias("include_snack"),
    )


def _arms(values) -> str:
    """SQL CASE over the customer number, one arm per value."""
    values = list(values)
    return f"CASE c_custkey % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_AVOID_MILK = ", ".join(["milk", "salmon"] + [w for w in R.DAIRY_WORDS + ["dairy"] if w != "milk"])
_AVOID_NUT = ", ".join(["nut"] + R.TREE_NUT_WORDS + ["nuts"])


@query(
    "x17_questionnaire_query",
    "SELECT c_custkey AS request_id, coalesce(nullif(concat_ws('; ', "
    f"nullif({_arms(R.GOALS.values())}, ''), nullif({_arms(R.MEALS.values())}, ''), "
    f"CASE WHEN c_custkey % 2 = 0 THEN 'cuisine: ' || {_arms(R.CUISINES.values())} END, "
    f"CASE WHEN c_custkey % 3 = 0 THEN 'dietary: ' || {_arms(R.DIETS.values())} END, "
    "CASE WHEN c_custkey % 7 = 0 THEN 'ready in 30 minutes' END, CASE WHEN c_custkey % 5 = 0 THEN 'include: tofu, lemon' END, "
    f"CASE c_custkey % 4 WHEN 0 THEN 'avoid: {_AVOID_MILK}' WHEN 1 THEN 'avoid: {_AVOID_NUT}' END, "
    "CASE WHEN c_custkey % 2 = 1 THEN 'chicken or beans with soy' ELSE 'tofu egg shrimp' END), ''), 'random') AS query FROM customer",
)
def _(spark, sf):
    asked = questionnaires(spark, sf).withColumns(
        {"must": X.split_terms("must_include"), "not_wanted": R.expand_avoid_terms(X.split_terms("avoid"))}
    )
    text = R.questionnaire_query("goal", "meal", "cuisines", "dietary", "must", "not_wanted", "max_time", "extra")
    return asked.select("request_id", text.alias("query"))


@query("r8_r7_questionnaire_batch")
def _(spark, sf):
    return answer_questionnaires(
        questionnaires(spark, sf), recipe_index(spark, sf), recipe_metadata(recipes(spark, sf)), k=5, per_meal_k=2
    )


# --- judging and reports -------------------------------------------------------------------------

_JUDGED = [
    *_DOC_SEARCH,
    "j AS (SELECT f.query_id, f.item_id, rank, q.text AS query, lower(i.text) AS t, CASE WHEN query_id % 2 = 0 THEN ['the', 'qu'] ELSE [] END AS must, "
    "CASE WHEN query_id % 3 = 0 THEN ['tion ', 'xyz'] ELSE [] END AS av, list_filter(regexp_split_to_array(lower(q.text), '[^\\p{L}\\p{N}_]+'), "
    "lambda x: length(x) > 0) AS w FROM found f JOIN qs q USING (query_id) JOIN items i ON i.item_id = f.item_id)",
    "h AS (SELECT *, len(list_filter(must, lambda x: contains(t, x))) > 0 AS hm, len(list_filter(av, lambda x: contains(t, x))) > 0 AS ha, "
    "len(list_filter(w, lambda x: contains(t, x))) > 0 AS hq FROM j)",
    "v AS (SELECT *, CASE WHEN ha THEN 1 ELSE 0 END + CASE WHEN len(must) > 0 AND NOT hm THEN 2 ELSE 0 END AS viol, "
    "1.0 + CASE WHEN hm THEN 2 ELSE 0 END + CASE WHEN hq THEN 1 ELSE 0 END AS raw FROM h)",
    "judged AS (SELECT *, CASE WHEN viol > 0 THEN greatest(0, raw - 2) ELSE raw END::DOUBLE AS relevance FROM v)",
]


def _judged(spark, sf):
    asked = benchmark_queries(spark, sf)
    empty = F.array().cast("array<string>")
    rows = search(doc_index(spark, sf), asked, 50).join(asked.withColumnRenamed("text", "query"), "query_id")
    rows = rows.join(doc_items(spark, sf), "item_id").withColumns(
        {
            "must_include": F.when(F.col("query_id") % 2 == 0, F.array(F.lit("the"), F.lit("QU"))).otherwise(empty),
            "avoid": F.when(F.col("query_id") % 3 == 0, F.array(F.lit("tion "), F.lit("xyz"))).otherwise(empty),
        }
    )
    return judge(rows)


@query(
    "e15_e16_keyword_judge",
    with_(*_JUDGED)
    + "SELECT query_id, item_id, relevance, CASE viol WHEN 0 THEN '' WHEN 1 THEN 'contains_avoid_term' WHEN 2 THEN 'missing_must_include' "
    "ELSE 'contains_avoid_term,missing_must_include' END AS violations FROM judged",
)
def _(spark, sf):
    return _judged(spark, sf).select("query_id", "item_id", "relevance", F.array_join("violations", ",").alias("violations"))


_CASES = [
    RECIPES, _PHRASES,
    "qs AS (SELECT item_id AS query_id, CASE item_id % 3 WHEN 0 THEN 'high protein dinner with chicken' WHEN 1 THEN 'low calorie lunch with tofu' "
    "ELSE 'egg and lemon' END AS text FROM benchmark)",
    *tfidf_ctes("recipes"), *encoded_ctes("qs"), *found_ctes(40),
    "cs AS (SELECT query_id, text AS query, query_id % 2 = 0 AS af, CASE WHEN query_id % 4 < 2 THEN ['salmon', 'sugar'] ELSE [] END AS av, "
    "CASE WHEN query_id % 5 = 0 THEN ['tofu', 'egg'] ELSE [] END AS must, 5 + query_id % 4 AS k FROM qs)",
    "rw AS (SELECT f.query_id, f.item_id, rank, query, af, av, must, k, lower(r.text) AS t, ing FROM found f JOIN cs USING (query_id) JOIN recipes r ON r.item_id = f.item_id "
    "JOIN phrases p ON p.item_id = f.item_id)",
    "hh AS (SELECT *, len(list_filter(must, lambda x: contains(t, x))) > 0 AS hm, len(list_filter(av, lambda x: contains(t, x))) > 0 AS ha FROM rw)",
    "kp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM hh WHERE NOT af OR (NOT ha AND (len(must) = 0 OR hm)) QUALIFY place <= k)",
    "jd AS (SELECT *, CASE WHEN ha OR (len(must) > 0 AND NOT hm) THEN 1.0 ELSE 0.0 END AS bad, 1.0 + CASE WHEN hm THEN 2 ELSE 0 END + "
    "CASE WHEN len(list_filter(regexp_split_to_array(query, ' '), lambda x: contains(t, x))) > 0 THEN 1 ELSE 0 END AS raw FROM kp)",
    "pairs AS (SELECT a.query_id, avg(len(list_intersect(a.ing, b.ing)) / len(list_distinct(list_concat(a.ing, b.ing)))) AS mj FROM jd a JOIN jd b "
    "ON a.query_id = b.query_id AND a.place < b.place GROUP BY 1)",
    "agg AS (SELECT query_id, count(*) AS n_after_filter, avg(CASE WHEN bad > 0 THEN greatest(0, raw - 2) ELSE raw END) AS avg_relevance, avg(bad) AS violation_rate FROM jd GROUP BY 1)",
    "ret AS (SELECT query_id, count(*) AS n_retrieved FROM found GROUP BY 1)",
]


def _cases(spark, sf):
    n = F.col("item_id")
    text = F.when(n % 3 == 0, "high protein dinner with chicken").when(n % 3 == 1, "low calorie lunch with tofu").otherwise("egg and lemon")
    return table(spark, sf, "benchmark").select(
        n.alias("case_id"), text.alias("query"), F.when(n % 5 == 0, "tofu; egg").otherwise("").alias("must_include"),
        F.when(n % 4 < 2, "salmon, sugar").otherwise("").alias("avoid"), (5 + n % 4).cast("int").alias("k"),
        F.lit(40).alias("candidate_k"), (n % 2 == 0).alias("apply_filters"),
    )


@query(
    "e17_e9_case_reports",
    with_(*_CASES)
    + "SELECT query_id AS case_id, coalesce(n_retrieved, 0) AS n_retrieved, coalesce(n_after_filter, 0) AS n_after_filter, "
    "round(greatest(0, least(1, 1 - coalesce(mj, 0))), 6) AS diversity, round(coalesce(avg_relevance, 0), 6) AS avg_relevance, "
    "round(coalesce(violation_rate, 0), 6) AS violation_rate FROM cs LEFT JOIN ret USING (query_id) LEFT JOIN agg USING (query_id) LEFT JOIN pairs USING (query_id)",
)
def _(spark, sf):
    out = case_reports(_cases(spark, sf), recipe_index(spark, sf))
    return out.select("case_id", "n_retrieved", "n_after_filter", r6("diversity"), r6("avg_relevance"), r6("violation_rate"))


@query(
    "s12_report_sink",
    with_(*_CASES)
    + "SELECT query_id AS case_id, query, round(coalesce(avg_relevance, 0), 6) AS avg_relevance, CAST(coalesce(n_after_filter, 0) AS INTEGER) AS n_items "
    "FROM cs LEFT JOIN agg USING (query_id)",
)
def _(spark, sf):
    from ..sources.readers import write_report

    path = scratch(spark, sf, "report")
    write_report(case_reports(_cases(spark, sf), recipe_index(spark, sf)), path)
    n_items = F.coalesce(F.size("items"), F.lit(0))
    return spark.read.json(path).select("case_id", "query", r6("avg_relevance"), n_items.alias("n_items"))


@query(
    "e9_intra_list_diversity",
    with_(RECIPES, _PHRASES, "l AS (SELECT item_id, item_id // 8 AS list_id, ing FROM phrases)",
          "p AS (SELECT a.list_id, avg(len(list_intersect(a.ing, b.ing)) / len(list_distinct(list_concat(a.ing, b.ing)))) AS mj FROM l a JOIN l b "
          "ON a.list_id = b.list_id AND a.item_id < b.item_id GROUP BY 1)")
    + "SELECT list_id, count(*) AS n_items, round(1 - coalesce(any_value(mj), 0), 6) AS diversity FROM l LEFT JOIN p USING (list_id) GROUP BY 1",
)
def _(spark, sf):
    rows = recipes(spark, sf).select(
        F.floor(F.col("item_id") / 8).alias("list_id"), R.ingredient_phrases("text").alias("ingredients")
    )
    return intra_list_diversity(rows, "list_id").select("list_id", "n_items", r6("diversity"))


@query(
    "e16_outside_labels",
    with_(
        "j AS (SELECT doc_id, doc_id % 2 = 0 AS has_must, doc_id % 3 = 0 AS has_avoid, text LIKE '%a%' AS one, text LIKE '%e%' AS two FROM documents)",
    )
    + f"SELECT doc_id, concat_ws(',', CASE WHEN one AND has_must THEN '{MUST_MISS}' END, CASE WHEN two AND has_avoid THEN '{AVOID_HIT}' END, 'tone') AS labels FROM j",
)
def _(spark, sf):
    """Labels of another judge, which also names constraints that a case does not have."""
    given = lambda share: F.when(F.col("doc_id") % share == 0, F.array(F.lit("egg"))).otherwise(F.array().cast("array<string>"))
    found = F.filter(
        F.array(F.when(F.contains("text", F.lit("a")), F.lit(MUST_MISS)), F.when(F.contains("text", F.lit("e")), F.lit(AVOID_HIT)), F.lit("tone")),
        lambda x: x.isNotNull(),
    )
    cases = table(spark, sf, "documents").select("doc_id", given(2).alias("must"), given(3).alias("avoid"), found.alias("found"))
    return cases.select("doc_id", F.array_join(sanitize_violations("found", "must", "avoid"), ",").alias("labels"))

"""Queries over file readers: a given table is written in the raw format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers as S
from .base import INTERACTIONS, RATINGS, interactions, query, ratings, scratch, table, with_


@query(
    "s3_generic_csv_ratings",
    with_(RATINGS) + "SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id, rating FROM ratings",
)
def _(spark, sf):
    return _generic(spark, sf)[0]


@query("s3_generic_csv_items", "SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name || ', \"' || p_brand || '\"' AS text FROM part")
def _(spark, sf):
    return _generic(spark, sf)[1]


def _generic(spark, sf):
    folder = scratch(spark, sf, "generic")
    rated = ratings(spark, sf).select(F.col("user_id").alias("who"), F.col("rating").alias("stars"), F.col("item_id").alias("what"))
    rated.write.option("header", True).csv(f"{folder}/ratings")
    words = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"'))
    items = table(spark, sf, "part").select(F.col("p_partkey").alias("what"), words.alias("words"))
    items.write.option("header", True).option("escape", '"').csv(f"{folder}/items")
    return S.prepare_from_csv(spark, f"{folder}/ratings", f"{folder}/items", "who", "what", "stars", "words")


@query("s4_tab_ratings", with_(RATINGS) + "SELECT user_id, item_id, rating FROM ratings")
def _(spark, sf):
    path = scratch(spark, sf, "tab")
    rows = ratings(spark, sf).select("user_id", "item_id", "rating", F.lit(881250949).alias("ts"))
    rows.write.option("sep", "\t").csv(path)
    return S.read_tab_ratings(spark, path)


@query(
    "s5_item_genres",
    "SELECT p_partkey AS item_id, "
    + ", ".join(f"CAST(CASE WHEN p_size % {g + 2} = 0 THEN 1 ELSE 0 END AS INTEGER) AS genre_{g}" for g in range(19))
    + " FROM part",
)
def _(spark, sf):
    path = scratch(spark, sf, "genres")
    flags = [(F.col("p_size") % (g + 2) == 0).cast("int").alias(f"g{g}") for g in range(19)]
    title = F.concat("p_name", F.lit(" é")).alias("title")
    rows = table(spark, sf, "part").select("p_partkey", title, F.lit("1994"), F.lit("-"), F.lit("url"), *flags)
    rows.write.option("sep", "|").option("encoding", "ISO-8859-1").csv(path)
    return S.read_item_genres(spark, path)


def _log(spark, sf, header: bool):
    path = scratch(spark, sf, "log")
    rows = interactions(spark, sf).withColumn("zero", F.lit(0))
    rows = rows.toDF("UserId", "GameTitle", "behavior", "hours", "zero")
    # untidy names keep their blanks, as in a raw log
    rows.write.option("header", header).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return S.read_interactions(spark, path)


_LOG = with_(INTERACTIONS) + "SELECT CAST(user_id AS VARCHAR) AS user_id, game_title, behavior_name, value FROM interactions"


@query("s7_interactions_bare", _LOG)
def _(spark, sf):
    return _log(spark, sf, False)


@query("s7_interactions_header", _LOG)
def _(spark, sf):
    return _log(spark, sf, True)


@query(
    "s9_recipe_csv",
    with_(
        "raw AS (SELECT CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS title, string_split(p_name, ' ') AS ing, p_size % 3 = 0 AS has_ner, "
        "p_size % 4 = 0 AS has_steps, CASE WHEN p_size % 2 = 0 THEN 'www/' || p_partkey END AS link, p_type, p_brand FROM part)",
        "txt AS (SELECT link, concat_ws(chr(10), 'title: ' || nullif(title, ''), 'ingredients: ' || CASE WHEN has_ner THEN p_brand ELSE array_to_string(ing, '; ') END, "
        "CASE WHEN has_steps THEN 'directions: Take \"' || p_type || '\". Stir.' END) AS text FROM raw)",
    )
    + "SELECT coalesce(link, md5(text)) AS item_id, text FROM txt",
)
def _(spark, sf):
    path = scratch(spark, sf, "recipes")
    size, empty = F.col("p_size"), F.array().cast("array<string>")
    steps = F.array(F.concat(F.lit(' Take "'), "p_type", F.lit('". ')), F.lit(""), F.lit("Stir."))
    raw = table(spark, sf, "part").select(
        F.when(size % 5 != 0, F.col("p_name")).alias("title"),
        F.to_json(F.split("p_name", " ")).alias("ingredients"),
        F.to_json(F.when(size % 4 == 0, steps).otherwise(empty)).alias("directions"),
        F.when(size % 2 == 0, F.concat(F.lit("www/"), F.col("p_partkey").cast("string"))).alias("link"),
        F.lit("Gathered").alias("source"),
        F.when(size % 3 == 0, F.to_json(F.array("p_brand"))).alias("NER"),
    )
    raw.write.option("header", True).option("escape", '"').csv(path)
    return S.read_recipes(spark, path)


@query(
    "s15_sampled_scan",
    "SELECT CAST(COLUMNS(*) AS VARCHAR) FROM part ORDER BY CAST(p_partkey AS VARCHAR) LIMIT 200",
)
def _(spark, sf):
    path = scratch(spark, sf, "sample")
    table(spark, sf, "part").write.option("header", True).csv(path)
    return S.sample_scan(spark, path, 200, ["p_partkey"])[0]


@query(
    "s3_csv_line_breaks",
    "SELECT CAST(doc_id AS VARCHAR) AS item_id, text FROM documents",
)
def _(spark, sf):
    """Texts with line breaks and quotes survive a CSV file."""
    folder = scratch(spark, sf, "lines")
    ratings(spark, sf).select(F.col("user_id").alias("who"), F.col("rating").alias("stars"), F.col("item_id").alias("what")).write.option("header", True).csv(f"{folder}/ratings")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("what"), F.col("text").alias("words"))
    docs.write.option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\n").csv(f"{folder}/items")
    return S.prepare_from_csv(spark, f"{folder}/ratings", f"{folder}/items", "who", "what", "stars", "words")[1]


@query(
    "s11_eval_cases",
    "SELECT text AS query, CASE WHEN item_id % 2 = 0 THEN 'egg, tofu' ELSE '' END AS must_include, '' AS avoid, "
    "CASE WHEN item_id % 3 = 0 THEN 5 ELSE 10 END::INTEGER AS k, 50::INTEGER AS candidate_k, item_id % 5 = 0 AS apply_filters FROM benchmark WHERE item_id % 7 <> 0",
)
def _(spark, sf):
    """Cases written as JSON, with settings left out; every seventh has a blank query and drops out."""
    path = scratch(spark, sf, "cases")
    key = F.col("item_id")
    rows = table(spark, sf, "benchmark").select(
        F.when(key % 7 == 0, F.lit("  ")).otherwise(F.col("text")).alias("query"), F.when(key % 2 == 0, "egg, tofu").alias("must_include"),
        F.when(key % 3 == 0, 5).alias("k"), F.when(key % 5 == 0, True).alias("apply_filters"),
    )
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns)))).write.text(path)  # one JSON array, as such files are
    return S.read_eval_cases(spark, path).drop("case_id")


@query(
    "p10_s9_long_recipes",
    "SELECT 'o/' || o_orderkey AS item_id, 'ingredients: ' || string_agg(p_name, '; ' ORDER BY l_linenumber, p_name) || chr(10) || "
    "'directions: ' || string_agg('Add ' || p_name || '.', ' ' ORDER BY l_linenumber, p_name) AS text "
    "FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey HAVING o_orderkey % 10 <> 0",
)
def _(spark, sf):
    """Recipes of all lines of an order: no ingredient or step is cut; those without content drop out."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    named = lines.join(table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey")
    whole = named.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("o")), "o").groupBy("o").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))), lambda x: x["p_name"]).alias("parts")
    )
    blank = F.col("o") % 10 == 0
    empty = F.array().cast("array<string>")
    steps = F.transform("parts", lambda p: F.concat(F.lit("Add "), p, F.lit(".")))
    raw = whole.select(
        F.lit(None).cast("string").alias("title"), F.to_json(F.when(blank, empty).otherwise(F.col("parts"))).alias("ingredients"),
        F.to_json(F.when(blank, empty).otherwise(steps)).alias("directions"), F.concat(F.lit("o/"), F.col("o").cast("string")).alias("link"),
        F.lit("Gathered").alias("source"), F.lit(None).cast("string").alias("NER"),
    )
    return S.recipe_items(raw)

"""Registry of queries with their SQL counterparts, and the views they share.

Every query reads the given tables in full. The views derive the contract tables from them; each
is written twice, as DataFrame code and as SQL text, independently of the library.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_SHARED: dict = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the statement that must give the same rows."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def shared(spark: SparkSession, sf_dir: str, key: str, build):
    """Fit a model once per session and data folder."""
    slot = (spark.sparkContext.applicationId, sf_dir, key)
    if slot not in _SHARED:
        _SHARED[slot] = build()
    return _SHARED[slot]


def forget_shared() -> None:
    _SHARED.clear()


def scratch(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A fresh folder next to the checkpoints, for queries that write and read back."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def r6(value: Column | str, name: str | None = None) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column, 6).alias(name or value)


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- ratings: customers rate parts by quantity, 1..5 ---------------------------------------------

RATINGS = """ratings AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, max(1 + floor((l_quantity - 1) / 10)) AS rating
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratings contract table, written once per session as an ingest job would."""
    return shared(spark, sf_dir, "ratings", lambda: cut_lineage(_ratings(spark, sf_dir)))


def _ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item_id"),
        (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("r"),
    )
    return lines.join(orders, "o_orderkey").groupBy("user_id", "item_id").agg(F.max("r").alias("rating"))


# --- interactions: events, with untidy behaviour names -------------------------------------------

INTERACTIONS = """interactions AS (
  SELECT user_id, regexp_extract(props, '[0-9]+') AS game_title,
    CASE event_type WHEN 'view' THEN ' Play ' WHEN 'purchase' THEN 'PURCHASE' ELSE event_type END AS behavior_name,
    CASE WHEN event_id % 50 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value
  FROM events)"""


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "user_id", F.get_json_object("props", "$.k").alias("game_title"),
        F.when(event == "view", " Play ").when(event == "purchase", "PURCHASE").otherwise(event).alias("behavior_name"),
        F.when(F.col("event_id") % 50 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
    )


# --- requests to score: users and items that met in an event -------------------------------------

REQUESTS = """requests AS (
  SELECT DISTINCT user_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS item_id FROM events)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "user_id", F.get_json_object("props", "$.k").cast("long").alias("item_id")
    ).distinct()


# --- items ---------------------------------------------------------------------------------------

DOC_ITEMS = "items AS (SELECT doc_id AS item_id, text FROM documents)"


def doc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


#: Part name words -> foods, and part types -> directions, so that the lexicons have hits.
FOODS = {
    "small": "Peanut Butter", "hot": "olive  oil", "widget": "chicken breast", "plate": "wheat noodles",
    "gear": "soy sauce", "red": "cheddar cheese", "blue": "salmon", "bolt": "almond flour",
    "large": "shrimp", "ring": "egg", "rod": "tofu", "old": "brown sugar", "gizmo": "skinless turkey",
    "cold": "greek yogurt", "anvil": "black beans", "new": "lemon",
}
DIRECTIONS = {
    "ECONOMY": "Bake 30 minutes.", "STANDARD": "Fry 10-15 minutes, then rest 5 minutes.",
    "PROMO": "Steam 1 hour 20 minutes.", "SMALL": "Grill 8 to 12 mins.", "LARGE": "Roast 2 hrs.",
}


def _case(expression: str, mapping: dict[str, str]) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {expression} {arms} END"


RECIPES = f"""recipes AS (
  SELECT p_partkey AS item_id, 'title: ' || p_name || chr(10) || 'ingredients: ' ||
    {_case("split_part(p_name, ' ', 1)", FOODS)} || '; ' || {_case("split_part(p_name, ' ', 2)", FOODS)} ||
    ', water' || coalesce(chr(10) || 'directions: ' || {_case("p_type", DIRECTIONS)}, '') AS text
  FROM part)"""


def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    look = lambda c, m: F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), c)
    first, second = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    how = F.concat(F.lit("\ndirections: "), look(F.col("p_type"), DIRECTIONS))
    text = F.concat(
        F.lit("title: "), F.col("p_name"), F.lit("\ningredients: "), look(first, FOODS), F.lit("; "),
        look(second, FOODS), F.lit(", water"), F.coalesce(how, F.lit("")),
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), text.alias("text"))


# --- item features: brand and type flags, size ---------------------------------------------------

FEATURES = """features AS (
  SELECT p_partkey AS item_id, p_brand AS feature, 1.0::DOUBLE AS value FROM part
  UNION ALL SELECT p_partkey, p_type, 1.0::DOUBLE FROM part)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.explode(F.array("p_brand", "p_type")).alias("feature"),
        F.lit(1.0).alias("value"),
    )


EMBEDDINGS = "item_emb AS (SELECT vec_id AS item_id, embedding FROM embeddings)"


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")


# --- model fragments in SQL ----------------------------------------------------------------------


def als_ctes(epochs: int, reg: float = 1.0, source: str = "ratings") -> list[str]:
    """Unrolled bias fit: ``mu``, ``bu1..n``, ``bi1..n``."""
    out = [f"mu AS (SELECT avg(rating) AS m FROM {source})"]
    for e in range(1, epochs + 1):
        left = "" if e == 1 else f" JOIN bi{e - 1} USING (item_id)"
        minus = "" if e == 1 else " - bi"
        out.append(
            f"bu{e} AS MATERIALIZED (SELECT user_id, sum(rating - (SELECT m FROM mu){minus}) / ({reg} + count(*)) AS bu "
            f"FROM {source}{left} GROUP BY user_id)"
        )
        out.append(
            f"bi{e} AS MATERIALIZED (SELECT item_id, sum(rating - (SELECT m FROM mu) - bu) / ({reg} + count(*)) AS bi "
            f"FROM {source} JOIN bu{e} USING (user_id) GROUP BY item_id)"
        )
    return out


def bucket_sql(seed: str, buckets: int, *columns: str) -> str:
    parts = ", ".join([f"'{seed}'"] + [f"CAST({c} AS VARCHAR)" for c in columns])
    return f"(CAST('0x' || substr(md5(concat_ws(':', {parts})), 1, 8) AS BIGINT) % {buckets})"


def hash_sql(seed: str, *columns: str) -> str:
    parts = ", ".join([f"'{seed}'"] + [f"CAST({c} AS VARCHAR)" for c in columns])
    return f"md5(concat_ws(':', {parts}))"


TRAIN_TEST = [
    f"train AS (SELECT * FROM ratings WHERE {bucket_sql('42', 10000, 'user_id', 'item_id')} >= 2000)",
    f"test AS (SELECT * FROM ratings WHERE {bucket_sql('42', 10000, 'user_id', 'item_id')} < 2000)",
]

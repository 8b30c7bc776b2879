"""TF-IDF index as tables: a numbered vocabulary and one sparse unit vector per item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import as_items
from ..functions.kernels import unit
from ..functions.text import ENGLISH_STOP_WORDS, ngrams, summary, tokens
from ..session import broadcast_bytes, broadcast_if_small, cut_lineage, spread
from .cells import fit_cells, search_cells
from .model import Model
from .ranking import rank_rows, stable
from .search import search_topk

#: Text whose terms one task counts in memory.
TASK_CHARS = 8_000_000


def _grams(texts: DataFrame, meta: dict, *keep: str) -> DataFrame:
    """``keep`` columns and ``g``, the index terms of each text."""
    return texts.select(*keep, ngrams(tokens("text", meta["stop_words"]), meta["ngram_max"]).alias("g"))


def _vocabulary(items: DataFrame, meta: dict) -> DataFrame:
    """``term, term_no, df, idf``: the most frequent terms with df >= min_df, numbered by term.

    Total and document frequency come from one exploded pass whose partial sums are combined
    per task; the (document, term) pairs are not shuffled for it. Without a cut nobody asks for the
    totals, and a text gives each of its terms once.
    """
    grams = _grams(items, meta)
    if meta["max_features"]:
        marked = F.concat(
            F.transform("g", lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df"))),
            F.transform(F.array_distinct("g"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df"))),
        )
        terms = grams.select(F.inline(marked)).groupBy("term").agg(F.sum("tf").alias("total"), F.sum("df").alias("df"))
    else:
        terms = grams.select(F.explode(F.array_distinct("g")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    terms = terms.filter(F.col("df") >= meta["min_df"])
    if meta["max_features"]:
        terms = terms.orderBy(F.desc("total"), F.asc("term")).limit(meta["max_features"])
    if meta["max_features"] and meta["max_features"] <= 1_000_000:
        numbered = terms.withColumn("term_no", F.row_number().over(Window.orderBy("term")))
    else:
        numbered = rank_rows(terms, [], [F.asc("term")], "term_no")
    idf = F.log((F.lit(1.0 + meta["n_items"])) / (F.col("df") + 1.0)) + 1.0
    return numbered.select("term", F.col("term_no").cast("int").alias("term_no"), "df", idf.alias("idf"))


def encode(texts: DataFrame, vocabulary: DataFrame, meta: dict, key: str, parts: int | None = None) -> DataFrame:
    """Sparse unit vectors ``key, idx, w``; texts without a known term are left out.

    ``parts`` is the number of tasks: each counts the terms of all its texts in memory.

    The texts are dealt out by key, so counting and packing stay where a text is: a term is never
    shuffled while the vocabulary fits the broadcast bound, and beyond it once per text.
    """
    lookup = broadcast_if_small(vocabulary.select("term", "term_no", "idf"), meta["n_terms"], 96)
    counted = (
        _grams(texts.repartition(*([parts] if parts else []), key), meta, key)
        .select(key, F.explode("g").alias("term"))
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    weight = F.col("tf") * F.col("idf")
    known = counted.join(lookup, "term")
    if parts and meta["n_terms"] * 96 > broadcast_bytes(texts.sparkSession):  # shuffled by term: back to as many tasks
        known = known.repartition(parts, key)
    packed = known.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("term_no", weight.alias("w")))).alias("v"),
        F.sqrt(F.sum(weight * weight)).alias("norm"),
    )
    return packed.select(
        key, F.col("v.term_no").alias("idx"), F.transform("v.w", lambda x: x / F.col("norm")).alias("w"), "norm"
    ).drop("norm")


def fit_tfidf(
    items: DataFrame,
    max_features: int | None = None,
    min_df: int = 2,
    ngram_max: int = 1,
    stop_words: list[str] | None = ENGLISH_STOP_WORDS,
) -> Model:
    """Text index; max_features None or <= 0 keeps every term. Terms tied at the cut: by term."""
    texts = as_items(items)
    rows = spread(texts)
    n_items, n_chars = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    meta = {
        "index_type": "tfidf", "max_features": max_features if max_features and max_features > 0 else None,
        "min_df": min_df, "ngram_max": max(1, ngram_max), "stop_words": list(stop_words or []),
        "n_items": n_items,
    }
    vocabulary = cut_lineage(_vocabulary(rows, meta))
    meta["n_terms"] = vocabulary.count()
    parts = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_chars // TASK_CHARS))
    vectors = encode(texts, vocabulary, meta, "item_id", parts)
    return Model("index", {"vocabulary": vocabulary, "vectors": vectors, "texts": texts}, meta)


def stored_vectors(index: Model) -> Model:
    """The index with its vectors written, on first use; what needs the vocabulary alone never makes them."""
    if not index.meta.get("vectors_stored"):
        index.tables["vectors"] = cut_lineage(index.tables["vectors"])
        index.meta["vectors_stored"] = True
    return index


def postings(index: Model) -> DataFrame:
    """``item_id, term, weight`` of a text index."""
    pairs = index.tables["vectors"].select(
        "item_id", F.explode(F.arrays_zip("idx", "w")).alias("p")
    ).select("item_id", F.col("p.idx").alias("term_no"), F.col("p.w").alias("weight"))
    terms = index.tables["vocabulary"].select("term_no", "term")
    return pairs.join(broadcast_if_small(terms, index.meta["n_terms"], 64), "term_no").select(
        "item_id", "term", "weight"
    )


def dense_index(items: DataFrame, embeddings: DataFrame, cells: int | None = None) -> Model:
    """Index over stored vectors: items without a vector drop out; nothing left is an error.

    ``cells`` adds that many cells for approximate search.
    """
    rows = as_items(items).join(embeddings.select("item_id", F.col("embedding").alias("vec")), "item_id")
    if not rows.limit(1).collect():
        raise ValueError("no item has an embedding; do the item_id columns match?")
    vectors = rows.select("item_id", "vec")
    tables, meta = {"vectors": vectors, "texts": rows.select("item_id", "text")}, {"index_type": "dense"}
    if cells is not None:
        packed = fit_cells(vectors, cells)
        tables, meta = tables | packed.tables, meta | packed.meta
    return Model("index", tables, meta)


def load_index(spark: SparkSession, path: str) -> Model:
    """Read a saved index; one without a type is dense."""
    index = Model.load(spark, path)
    index.meta.setdefault("index_type", "dense")
    return index


def embed(items: DataFrame, encoder, schema: str = "item_id long, embedding array<float>") -> DataFrame:
    """Vectors from a user-supplied ``mapInPandas`` encoder, normalised to length one.

    The encoder gets an iterator of pandas batches with ``item_id, text``, so a model is loaded
    once per partition.
    """
    return normalize_embeddings(as_items(items).mapInPandas(encoder, schema))


def normalize_embeddings(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("item_id", unit("embedding").cast("array<float>").alias("embedding"))


def search(
    index: Model, queries: DataFrame, k: int, fill: bool | None = None, approximate: bool = False, probes: int = 16
) -> DataFrame:
    """Top-k items per query. Queries hold ``query_id, text`` (tfidf) or ``query_id, vec`` (dense).

    ``approximate`` looks only into the ``probes`` most promising cells of a dense index that has cells.
    """
    if approximate and "blocks" not in index.tables:
        raise ValueError("approximate search needs a dense index with cells")
    if index.meta.get("index_type", "dense") == "dense":
        if "vec" not in queries.columns:
            raise ValueError("a dense index needs query vectors (query_id, vec)")
        if approximate:
            found = search_cells(index, queries, k, probes)
            return found.filter(stable("sim") > 0) if fill is False else found
        return search_topk(queries, index.tables["vectors"], k, "dense", fill)
    vectors = encode(queries.select("query_id", "text"), index.tables["vocabulary"], index.meta, "query_id")
    return search_topk(vectors, index.tables["vectors"], k, "sparse", fill)


def keyword_enrichment(items: DataFrame, top: int = 8, max_features: int | None = None, min_df: int = 2) -> DataFrame:
    """``item_id, tags, summary``: the heaviest 1- and 2-grams of each text, and its beginning."""
    index = fit_tfidf(items, max_features, min_df, 2)
    # terms are numbered in order, so the array order settles ties by term
    best = F.slice(
        F.array_sort(
            F.transform(F.arrays_zip("idx", "w"), lambda p: F.struct((-F.round(p["w"], 9)).alias("s"), p["idx"].alias("t")))
        ),
        1,
        top,
    )
    picked = index.tables["vectors"].select("item_id", F.posexplode(best).alias("place", "p"))
    terms = broadcast_if_small(index.tables["vocabulary"].select("term_no", "term"), index.meta["n_terms"], 64)
    tags = (
        picked.select("item_id", "place", F.col("p.t").alias("term_no"))
        .join(terms, "term_no")
        .groupBy("item_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("tags"))
    )
    rows = index.tables["texts"].select("item_id", summary("text").alias("summary"))
    return rows.join(tags, "item_id", "left").select(
        "item_id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "summary"
    )

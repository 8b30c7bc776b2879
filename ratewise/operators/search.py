"""Exact top-k search of queries over vectors, dense or sparse.

Vectors are ordinary table rows: ``vec array<double>`` when dense, ``idx array<int>`` plus
``w array<double>`` when sparse. Scores of a block of queries against a block of items are one
matrix product inside a task, and only the best k per query leave the task. Scored pairs are
never rows, so a term or a value shared by very many items costs arithmetic but no shuffle.

Equal sparse vectors are searched once: of items with the same vector only the k lowest ids can be in
a list, and queries with the same vector share theirs. Vectors over few features or short texts shrink to
their different ones; where all differ, blocks are large enough that few copies of a block are sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hash_bucket
from ..session import broadcast_bytes, cut_lineage
from .ranking import stable, top_k
from .similarjoin import plain

#: Queries of one matrix product, queries and items per block of the two-sided search, and the entries of a block.
QUERY_BLOCK = 1_000
QUERIES_SENT = 20_000
ITEM_BLOCK = 50_000
BLOCK_ENTRIES = 8_000_000
#: Cells of one intermediate matrix.
CELLS = 4_000_000


def _columns(kind: str) -> list[str]:
    if kind not in ("dense", "sparse"):
        raise ValueError("kind must be 'dense' or 'sparse'")
    return ["vec"] if kind == "dense" else ["idx", "w"]


def _pack_queries(kind: str, queries: pd.DataFrame):
    """The query block as a matrix (terms x queries), with the term numbers when sparse."""
    n = len(queries)
    if kind == "dense":
        return None, np.array(queries["vec"].tolist(), dtype=np.float64).reshape(n, -1).T
    sizes = [len(x) for x in queries["idx"]]
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in queries["idx"]]) if n else np.zeros(0, np.int64)
    terms, local = np.unique(flat, return_inverse=True)
    matrix = np.zeros((len(terms), n))
    if len(flat):
        matrix[local, np.repeat(np.arange(n), sizes)] = np.concatenate(list(queries["w"]))
    return terms, matrix


def _scores(kind: str, packed, items: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, scores) of consecutive runs of items; scores are items x queries."""
    terms, matrix = packed
    if kind == "dense":
        step = max(1, CELLS // max(1, matrix.shape[1]))
        vectors = items["vec"].tolist()
        for start in range(0, len(items), step):
            yield start, np.array(vectors[start : start + step], dtype=np.float64) @ matrix
        return
    step = max(1, CELLS // max(1, len(terms), matrix.shape[1]))
    idx, weights = items["idx"].tolist(), items["w"].tolist()
    for start in range(0, len(items), step):
        part = idx[start : start + step]
        rows = np.repeat(np.arange(len(part)), [len(x) for x in part])
        flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in part])
        values = np.concatenate([np.asarray(x, dtype=np.float64) for x in weights[start : start + step]])
        block = np.zeros((len(part), len(terms)))
        if len(terms):
            at = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
            hit = terms[at] == flat
            block[rows[hit], at[hit]] = values[hit]
        yield start, block @ matrix


class _Best:
    """Running top-k per query. Items arrive in id order, so equal scores keep the lower id."""

    def __init__(self, n_queries: int, k: int, above: float):
        self.k, self.above = k, above
        self.score = np.full((n_queries, 0), -np.inf)  # rounded, for the order
        self.sim = np.zeros((n_queries, 0))
        self.item = np.zeros((n_queries, 0), dtype=np.int64)
        self.ids: list = []
        self.seen = 0

    def add(self, ids, scores: np.ndarray) -> None:
        """Take the scores (items x queries) of the next items, in runs that grow with what the lists have seen."""
        at = 0
        while at < len(scores):
            end = min(len(scores), at + max(8 * self.k, 2 * self.seen))
            self._add(ids[at:end], scores[at:end])
            self.seen += end - at
            at = end

    def _add(self, ids, scores: np.ndarray) -> None:
        if self.score.shape[1] >= self.k:
            # most scores lie below every last place: they are compared once, and neither rounded nor sorted
            least = np.maximum(self.score[:, -1] - 1e-9, self.above)
            open_ = scores > least
            if np.count_nonzero(open_) <= 4 * self.k * len(least):
                self._merge(np.asarray(ids), scores, *np.nonzero(open_))
                return
        sims = scores.T
        scores = np.round(sims, 9)
        scores[scores <= self.above] = -np.inf
        full = self.score.shape[1] >= self.k
        floor = self.score[:, -1:] if full else np.full((len(scores), 1), -np.inf)
        keep = np.flatnonzero((scores > floor).any(axis=0))
        if not len(keep):
            return
        numbers = np.arange(len(self.ids), len(self.ids) + len(keep))
        self.ids.extend(np.asarray(ids)[keep].tolist())
        score = np.concatenate([self.score, scores[:, keep]], axis=1)
        sim = np.concatenate([self.sim, sims[:, keep]], axis=1)
        item = np.concatenate([self.item, np.broadcast_to(numbers, (len(score), len(keep)))], axis=1)
        if score.shape[1] > 4 * self.k:
            # drop columns that are below every query's k-th best score before sorting
            kth = np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]
            useful = (score >= kth[:, None]).any(axis=0)
            score, sim, item = score[:, useful], sim[:, useful], item[:, useful]
        order = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
        self.score = np.take_along_axis(score, order, axis=1)
        self.sim = np.take_along_axis(sim, order, axis=1)
        self.item = np.take_along_axis(item, order, axis=1)

    def _merge(self, ids: np.ndarray, scores: np.ndarray, at: np.ndarray, query: np.ndarray) -> None:
        """Take single scores (item ``at``, ``query``) into full lists."""
        sim = scores[at, query]
        score = np.round(sim, 9)
        better = (score > self.score[query, -1]) & (score > self.above)
        if not better.any():
            return
        at, query, sim, score = at[better], query[better], sim[better], score[better]
        kept, number = np.unique(at, return_inverse=True)
        n, k = self.score.shape
        owner = np.concatenate([np.repeat(np.arange(n), k), query])
        score, sim = np.concatenate([self.score.ravel(), score]), np.concatenate([self.sim.ravel(), sim])
        item = np.concatenate([self.item.ravel(), len(self.ids) + number])
        self.ids.extend(ids[kept].tolist())
        order = np.lexsort((item, -score, owner))
        counts = np.bincount(owner, minlength=n)
        first = (np.cumsum(counts) - counts)[:, None] + np.arange(k)
        order = order[first.ravel()]
        self.score, self.sim, self.item = (x[order].reshape(n, k) for x in (score, sim, item))

    def rows(self, query_ids) -> pd.DataFrame:
        q, place = np.nonzero(np.isfinite(self.score))
        ids = self.ids
        return pd.DataFrame(
            {
                "query_id": plain(np.asarray(query_ids)[q]),
                "item_id": plain([ids[i] for i in self.item[q, place]]),
                "sim": self.sim[q, place],
            }
        )


def _search_broadcast(queries: DataFrame, items: DataFrame, k: int, kind: str, above: float, schema: str):
    """All queries fit one block of checked size: the items stay where they are."""
    spark = items.sparkSession
    block = spark.sparkContext.broadcast(queries.toPandas())

    def run(batches):
        query_block = block.value
        packed = _pack_queries(kind, query_block)
        best = _Best(len(query_block), k, above)
        for batch in batches:
            ids = batch["item_id"].to_numpy()
            for start, scores in _scores(kind, packed, batch):
                best.add(ids[start : start + len(scores)], scores)
        yield best.rows(query_block["query_id"].to_numpy())

    return items.sortWithinPartitions("item_id").mapInPandas(run, schema)


def _search_blocks(queries, items, exclude, k, kind, above, schema, n_queries):
    """Any number of queries: every query block meets every item block in a task of its own."""
    size = F.coalesce(F.sum(F.size(_columns(kind)[0])), F.lit(0))
    n_items, entries = items.agg(F.count(F.lit(1)), size).first()
    query_entries = queries.agg(size).first()[0]
    q_blocks = max(1, -(-n_queries // QUERIES_SENT), -(-query_entries // BLOCK_ENTRIES))
    i_blocks = max(1, -(-n_items // ITEM_BLOCK), -(-entries // BLOCK_ENTRIES))
    # every item is sent once per query block, so there are no more of these than keep the cores busy
    busy = 3 * items.sparkSession.sparkContext.defaultParallelism
    q_blocks = max(q_blocks, min(-(-n_queries // QUERY_BLOCK), -(-busy // i_blocks)))
    if q_blocks * i_blocks < 8:
        q_blocks = -(-8 // i_blocks)
    # own names for the query columns: both sides may stem from the same table
    names = {c: f"_own_{c}" for c in queries.columns}
    left = queries.withColumn("_q", hash_bucket("q", q_blocks, "query_id"))
    left = left.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(i_blocks - 1))))
    right = items.withColumn("_i", hash_bucket("i", i_blocks, "item_id"))
    if exclude is not None:
        # a pair belongs to one task only; an item block bounds the length of the list
        lists = (
            exclude.withColumn("_i", hash_bucket("i", i_blocks, "item_id"))
            .groupBy("query_id", "_i")
            .agg(F.collect_set("item_id").alias("_skip"))
        )
        left = left.join(lists, ["query_id", "_i"], "left")
        names["_skip"] = "_own_skip"
    left = left.select(
        F.col("_q").alias("_lq"), F.col("_i").alias("_li"), *[F.col(c).alias(a) for c, a in names.items()]
    )
    right = right.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def run(query_block: pd.DataFrame, item_block: pd.DataFrame) -> pd.DataFrame:
        if not len(query_block) or not len(item_block):
            return pd.DataFrame({"query_id": plain([]), "item_id": plain([]), "sim": plain([])})
        query_block = query_block.rename(columns={a: c for c, a in names.items()})
        item_block = item_block.sort_values("item_id", ignore_index=True)
        runs = range(0, len(query_block), QUERY_BLOCK)
        return pd.concat([of_run(query_block.iloc[at : at + QUERY_BLOCK], item_block) for at in runs], ignore_index=True)

    def of_run(query_block: pd.DataFrame, item_block: pd.DataFrame) -> pd.DataFrame:
        query_ids = query_block["query_id"].to_numpy()
        best = _Best(len(query_block), k, above)
        ids = item_block["item_id"].to_numpy()
        skip_item = skip_query = np.zeros(0, dtype=np.int64)
        if "_skip" in query_block:
            lists = [x if x is not None else [] for x in query_block["_skip"]]
            skip_query = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            flat = pd.Index(ids).get_indexer([v for x in lists for v in x])
            skip_query, skip_item = skip_query[flat >= 0], flat[flat >= 0]
        packed = _pack_queries(kind, query_block)
        for start, scores in _scores(kind, packed, item_block):
            here = (skip_item >= start) & (skip_item < start + len(scores))
            scores[skip_item[here] - start, skip_query[here]] = -np.inf
            best.add(ids[start : start + len(scores)], scores)
        return best.rows(query_ids)

    return left.groupBy("_lq", "_li").cogroup(right.groupBy("_q", "_i")).applyInPandas(run, schema)


def _search_classes(queries: DataFrame, items: DataFrame, k: int, above: float, schema: str) -> DataFrame:
    """Sparse search over the different vectors of both sides, spelt out as rows with their rank.

    The k best classes hold the k best items: each class before an item's own, by score and lowest id,
    brings a better one. A class whose better classes already have k items brings none.
    """
    vector = ["idx", "w"]
    members = top_k(items, vector, [F.asc("item_id")], k)
    classes = members.groupBy(*vector).agg(F.array_sort(F.collect_list("item_id")).alias("_all"))
    classes = cut_lineage(classes.withColumn("item_id", F.element_at("_all", 1)))
    first = queries.groupBy(*vector).agg(F.min("query_id").alias("_first"))
    named = cut_lineage(queries.join(first, vector).select("query_id", "_first", F.when(F.col("query_id") == F.col("_first"), F.struct(*vector)).alias("_v")))
    asked = named.filter(F.col("_v").isNotNull()).select("query_id", "_v.*")
    found = _search_blocks(asked, classes.select("item_id", *vector), None, k, "sparse", above, schema, asked.count())
    best = top_k(found, ["query_id"], [F.desc(stable("sim")), F.asc("item_id")], k).drop("rank")
    best = best.join(classes.select("item_id", "_all"), "item_id").withColumn("_s", stable("sim"))
    size = F.size("_all")
    better = F.sum(size).over(Window.partitionBy("query_id").orderBy(F.desc("_s"))) - F.sum(size).over(Window.partitionBy("query_id", "_s"))
    open_ = best.withColumn("_better", better).filter(F.col("_better") < k)
    spelt = open_.select(F.col("query_id").alias("_first"), F.explode("_all").alias("item_id"), "sim")
    lists = top_k(spelt, ["_first"], [F.desc(stable("sim")), F.asc("item_id")], k)
    return named.select("query_id", "_first").join(lists, "_first").select("query_id", "item_id", "sim", "rank")


def search_topk(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    kind: str = "dense",
    fill: bool | None = None,
    exclude: DataFrame | None = None,
) -> DataFrame:
    """``query_id, item_id, sim, rank`` with rank <= k by dot product, ties by item id.

    ``fill`` keeps items with similarity 0 or less, so that lists reach k (default for dense
    vectors). ``exclude`` holds (query_id, item_id) pairs that must not be returned.
    """
    columns = _columns(kind)
    queries = queries.select("query_id", *columns)
    items = items.select("item_id", *columns)
    schema = (
        f"query_id {queries.schema['query_id'].dataType.simpleString()}, "
        f"item_id {items.schema['item_id'].dataType.simpleString()}, sim double"
    )
    if k <= 0:
        return items.sparkSession.createDataFrame([], f"{schema}, rank int")
    fill = kind == "dense" if fill is None else fill
    above = -np.inf if fill else 0.0
    n_queries, width = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(columns[0])), F.lit(0))).first()
    if exclude is None and n_queries <= QUERY_BLOCK and width * 16 <= broadcast_bytes(items.sparkSession):
        found = _search_broadcast(queries, items, k, kind, above, schema)
    elif exclude is None and kind == "sparse":
        return _search_classes(queries, items, k, above, schema)
    else:
        found = _search_blocks(queries, items, exclude, k, kind, above, schema, n_queries)
    return top_k(found, ["query_id"], [F.desc(stable("sim")), F.asc("item_id")], k)

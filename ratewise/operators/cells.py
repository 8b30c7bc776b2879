"""Inner-product search in cells: an inverted file over dense vectors, with bounds for an exact stop.

``fit_cells`` deals every vector to the nearest of some centres. The centres come from k-means on a
bounded sample, the ``cells * sample_per_cell`` different vectors with the smallest hashes; everything
else covers all rows. A cell keeps its radius, the largest distance of a member from the centre, and its
members packed in blocks of about ``BLOCK_BYTES``, so a cell that holds a third of all rows is many blocks.

``search_cells`` sends a query to the ``probes`` cells whose centres have the largest product with it.
Queries of a cell travel in packs, an item block is shuffled once however many packs meet it, and one
matrix product scores a pack against a block; at most k rows a query leave it. With ``exact`` a second round
visits the other cells whose bound

    q x = q c + q (x - c) <= q c + |q| radius

reaches the query's k-th score of the first round. Without it, ``probes_for`` tells how many probes give
the wanted recall, measured on queries of the caller's choice.

Rows whose vector is null, or holds a null, NaN or infinite component, are left out of the index; such
queries get no rows. Vectors of different lengths are an error. An empty index answers with no rows. Ids
are unique on both sides; equal scores (to nine decimals) are ordered by item id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hash_bucket, hash_order
from ..session import broadcast_bytes, broadcast_if_small, cut_lineage
from .model import Model
from .ranking import stable, top_k

#: Bytes of packed vectors in an item block, queries in a pack, and cells of one intermediate matrix.
BLOCK_BYTES = 4 << 20
PACK = 500
MATRIX = 4_000_000


def usable(vec: str = "vec") -> Column:
    """Whether a vector is there and all its components are numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vec, finite), F.lit(False))


def _vectors(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.col("vec").cast("array<double>").alias("vec")).filter(usable())


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes != width).any():
        raise ValueError(f"vectors of different lengths: {width} and {int(sizes[sizes != width][0])}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _centres(rows: DataFrame, cells: int, sample: int, rounds: int, seed: int) -> np.ndarray:
    """Centres by k-means; one ordered partition, so that sums of doubles do not depend on the cluster."""
    chosen = rows.select("vec").distinct().orderBy(hash_order(seed, F.to_json("vec"))).limit(sample)
    held = cut_lineage(chosen.coalesce(1).select(array_to_vector("vec").alias("features")))
    if not held.take(1):
        return np.zeros((0, 0))
    fitted = KMeans(k=max(2, cells), maxIter=rounds, initMode="random", seed=seed).fit(held)
    return np.array([np.asarray(c) for c in fitted.clusterCenters()])


def _assign(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``item_id, vec, cell, distance`` of the nearest centre, ties to the lower number."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)
    kind = rows.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        half, step = (c * c).sum(axis=1) / 2, max(1, MATRIX // len(c))
        for batch in batches:
            x = _matrix(batch.column("vec"), c.shape[1])
            near = [np.argmax(x[i : i + step] @ c.T - half, axis=1) for i in range(0, len(x), step)]
            cell = np.concatenate(near or [np.zeros(0, np.int64)]).astype(np.int32)
            distance = np.sqrt(((x - c[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(distance)], names=["item_id", "vec", "cell", "distance"])

    return rows.mapInArrow(run, f"item_id {kind}, vec array<double>, cell int, distance double")


def _packed(rows: DataFrame, key: str, groups: list[str], extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per group: ids in order, their vectors end to end, and further columns beside the ids."""
    members = F.sort_array(F.collect_list(F.struct(key, *extra, "vec")))
    got = rows.groupBy(*groups).agg(members.alias("_m"))
    return got.select(
        *groups, *[F.col(f"_m.{c}").alias(f"{c}s") for c in (key, *extra)], F.flatten("_m.vec").alias(f"{key}_data")
    )


def fit_cells(items: DataFrame, cells: int = 256, sample_per_cell: int = 64, rounds: int = 8, seed: int = 0) -> Model:
    """The index of ``item_id, vec``: tables ``cells`` (cell, centre, radius, n) and ``blocks``."""
    spark, rows = items.sparkSession, _vectors(items, "item_id")
    centres = _centres(rows, cells, cells * sample_per_cell, rounds, seed)
    if centres.nbytes > broadcast_bytes(spark):
        raise ValueError("centres do not fit spark.ratewise.broadcastBytes; ask for fewer cells")
    kind, width = rows.schema["item_id"].dataType.simpleString(), centres.shape[1]
    if not len(centres):
        none = spark.createDataFrame([], "cell int, centre array<double>, radius double, n long")
        blocks = spark.createDataFrame([], f"cell int, part int, item_ids array<{kind}>, item_id_data array<double>")
        return Model("cells", {"cells": none, "blocks": blocks}, {"width": 0, "cells": 0})
    dealt = cut_lineage(_assign(rows, centres))
    found = dealt.groupBy("cell").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n"))
    listed = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    about = cut_lineage(listed.join(found, "cell"))
    parts = F.ceil(F.col("n") * (width * 8) / F.lit(BLOCK_BYTES)).cast("long")
    sizes = broadcast_if_small(about.select("cell", parts.alias("_parts")), len(centres), 16)
    split = dealt.join(sizes, "cell").withColumn("part", hash_bucket("part", F.col("_parts"), "item_id"))
    blocks = cut_lineage(_packed(split, "item_id", ["cell", "part"]))
    return Model("cells", {"cells": about, "blocks": blocks}, {"width": width, "cells": len(centres)})


class _Plan:
    """Which cells a query visits. Centres and radii are bounded by the number of cells."""

    def __init__(self, index: Model):
        rows = index.tables["cells"].orderBy("cell").collect()
        self.cell = np.array([r["cell"] for r in rows], np.int32)
        self.centre = np.array([r["centre"] for r in rows]).reshape(len(rows), index.meta["width"])
        self.radius = np.array([r["radius"] for r in rows])

    def products(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products with all centres, and the cells' places in falling order of them."""
        product = x @ self.centre.T
        return product, np.argsort(-np.round(product, 9), axis=1, kind="stable")


def _visits(queries: DataFrame, plan: _Plan, probes: int, width: int, beyond: bool) -> DataFrame:
    """Add ``cells``: the first ``probes``, or beyond those all whose bound reaches ``floor``."""
    shared = queries.sparkSession.sparkContext.broadcast(plan)
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        step = max(1, MATRIX // len(at.cell))
        for whole in batches:
            for low in range(0, whole.num_rows, step):
                batch = whole.slice(low, step)
                x = _matrix(batch.column("vec"), width)
                product, order = at.products(x)
                if beyond:
                    floor = batch.column("floor").to_numpy(zero_copy_only=False)
                    reach = np.linalg.norm(x, axis=1)[:, None] * at.radius
                    # room for the rounding of scores and of these sums
                    open_ = product + reach + 2e-9 + 1e-12 * (np.abs(product) + reach) >= floor[:, None]
                    np.put_along_axis(open_, order[:, :probes], False, axis=1)
                    lists = [at.cell[o] for o in open_]
                else:
                    lists = [at.cell[o] for o in order[:, :probes]]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(lists, pa.list_(pa.int32()))], names=["query_id", "vec", "floor", "cells"]
                )

    return queries.mapInArrow(run, f"query_id {kind}, vec array<double>, floor double, cells array<int>")


def _score(visits: DataFrame, index: Model, k: int) -> DataFrame:
    """``query_id, item_id, sim, cell``: the k best of every block that a query meets, none below its floor."""
    blocks, width = index.tables["blocks"], index.meta["width"]
    visits = cut_lineage(visits)
    asked = visits.select("query_id", "vec", "floor", F.explode("cells").alias("cell"))
    packs = visits.select(F.explode("cells").alias("cell")).groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(PACK)).cast("long").alias("_packs")
    )
    asked = asked.join(broadcast_if_small(packs, index.meta["cells"], 16), "cell")
    asked = asked.withColumn("pack", hash_bucket("pack", F.col("_packs"), "query_id"))
    pairs = _packed(asked, "query_id", ["cell", "pack"], ("floor",)).join(blocks, "cell")
    names = ["cell", "query_ids", "floors", "query_id_data", "item_ids", "item_id_data"]
    id_type = lambda c: pairs.schema[c].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell, query_ids, floors, q, item_ids, x = (batch.column(c)[row] for c in names)
                q, x = (m.values.to_numpy().reshape(-1, width) for m in (q, x))
                floors, step = floors.values.to_numpy(), max(1, MATRIX // len(x))
                for low in range(0, len(q), step):
                    sims = q[low : low + step] @ x.T
                    score = np.round(sims, 9)
                    least = np.round(floors[low : low + step], 9)[:, None]
                    if len(x) > k:
                        least = np.maximum(least, np.partition(score, len(x) - k, axis=1)[:, [len(x) - k]])
                    at, item = np.nonzero(score >= least)
                    # ids are in order, so the place settles ties
                    order = np.lexsort((item, -score[at, item], at))
                    at, item = at[order], item[order]
                    place = np.arange(len(at)) - np.searchsorted(at, at)
                    at, item = at[place < k], item[place < k]
                    yield pa.RecordBatch.from_arrays(
                        [query_ids.values.take(pa.array(at + low)), item_ids.values.take(pa.array(item)), pa.array(sims[at, item]), pa.array(np.full(len(at), cell.as_py(), np.int32))],
                        names=["query_id", "item_id", "sim", "cell"],
                    )

    return pairs.select(*names).mapInArrow(
        run, f"query_id {id_type('query_ids')}, item_id {id_type('item_ids')}, sim double, cell int"
    )


def _best(found: DataFrame, k: int) -> DataFrame:
    return top_k(found, ["query_id"], [F.desc(stable("sim")), F.asc("item_id")], k)


def _lists(index: Model, queries: DataFrame, k: int, probes: int, exact: bool) -> DataFrame:
    asked, plan, width = _vectors(queries, "query_id"), _Plan(index), index.meta["width"]
    if not index.meta["cells"] or k <= 0:
        kinds = [asked.schema["query_id"].dataType, index.tables["blocks"].schema["item_ids"].dataType.elementType]
        q, i = (x.simpleString() for x in kinds)
        return asked.sparkSession.createDataFrame([], f"query_id {q}, item_id {i}, sim double, cell int, rank int")
    probes = min(max(1, probes), len(plan.cell))
    open_floor = asked.withColumn("floor", F.lit(float("-inf")))
    first = _best(_score(_visits(open_floor, plan, probes, width, False), index, k), k)
    if not exact or probes == len(plan.cell):
        return first
    first = cut_lineage(first)
    floors = first.filter(F.col("rank") == k).select(F.col("query_id").alias("_id"), F.col("sim").alias("floor"))
    known = asked.join(floors, asked["query_id"].eqNullSafe(F.col("_id")), "left").select(
        "query_id", "vec", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")
    )
    second = _score(_visits(known, plan, probes, width, True), index, k)
    return _best(first.drop("rank").unionByName(second), k)


def search_cells(index: Model, queries: DataFrame, k: int, probes: int = 16, exact: bool = False) -> DataFrame:
    """``query_id, item_id, sim, rank`` with rank <= k for ``query_id, vec``; see the module for ``exact``."""
    return _lists(index, queries, k, probes, exact).drop("cell")


def probes_for(index: Model, queries: DataFrame, k: int, recall: float = 0.95) -> int:
    """The least number of probes that finds this share of the true lists of the given queries.

    The queries are searched exactly; what comes back is a histogram with a row per probe at most.
    """
    hits = _lists(index, queries, k, 1, True).select(F.col("query_id").alias("_id"), "cell")
    plan = _Plan(index)
    if not len(plan.cell):
        return 1
    asked = _vectors(queries, "query_id").withColumn("floor", F.lit(float("-inf")))
    orders = _visits(asked, plan, len(plan.cell), index.meta["width"], False).drop("vec", "floor")
    place = hits.join(orders, F.col("_id").eqNullSafe(F.col("query_id"))).select(
        F.array_position("cells", F.col("cell")).alias("place")
    )
    counts = {r["place"]: r["n"] for r in place.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, seen = sum(counts.values()), 0
    for at in sorted(counts):
        seen += counts[at]
        if seen >= recall * total:
            return int(at)
    return 1

"""Jaccard self-join of word shingles by chosen paths.

Texts with the same shingle set are one set first, however many copies there are. Then, in each of
several runs, every set chooses about ``1 / similarity`` of its shingles by hash; two sets whose
similarity reaches the threshold choose one in common with probability at least ``1 - 1/e``. Sets
that chose the same shingle meet in a node. Nodes that hold more than ``LEAF`` sets are split again
on further sampled tokens, level by level, and small nodes are compared by brute force on sketches.
A node that is still large after ``DEPTH`` levels is compared in blocks of ``LEAF``: pairs are
never given up. The number of runs follows from the wanted recall and the survival of a pair
through all levels.

What passes the sketches forms candidate groups. Inside a group all texts are compared exactly, in
blocks if the group is large; that gives the links and, by connected components, the classes. Only
linear outputs leave a comparison: a count of links and one leader per set.

Cases: a null text counts as empty; a text without words has no shingles, links to nothing and is
a class of its own; repeated rows are copies; a null id is kept and never names a class unless all
its ids are null; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .arrowtext import give_back, mix, slices, texts
from .components import components
from .names import columns, unused
from .shingles import shingles
from .textkeys import text_key, texts_of

SIMILARITY = 0.8
RECALL = 0.999
DEPTH = 4
LEAF = 1024
BLOCK = 512
BINS = 128
#: Sketches estimate the similarity within 0.035; five deviations below the threshold still pass.
SLACK = 0.18
SMALL = 32


def runs_for(recall: float, depth: int) -> int:
    """Runs so that a pair at the threshold is met with probability ``recall``, even at full depth."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-alive)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - alive)))


# --- sets ----------------------------------------------------------------------------------------


def describe(column: pa.Array, runs: int, similarity: float) -> tuple[pa.Array, ...]:
    """Per text: key of the shingle set, its size, its sketch, and the nodes it chose in all runs."""
    rows = len(column)
    row, hashes = shingles(column)
    n = np.bincount(row, minlength=rows).astype(np.int64)
    full, begin = np.flatnonzero(n), (np.cumsum(n) - n)
    key = np.zeros((rows, 2), np.uint64)
    sketch = np.zeros((rows, BINS), np.uint16)
    nodes, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if len(full):
        for k in (0, 1):
            key[full, k] = np.add.reduceat(mix(hashes, 21 + k), begin[full])
        spread = mix(hashes, 30)
        low = np.full(rows * BINS, np.uint64(2**64 - 1))
        np.minimum.at(low, row * BINS + (spread >> np.uint64(57)).astype(np.int64), spread & np.uint64(2**57 - 1))
        taken = low != np.uint64(2**64 - 1)
        sketch.reshape(-1)[taken] = (mix(low[taken], 31) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
        limit = np.minimum(2.0**64 / (similarity * np.maximum(n, 1)), 2.0**64 - 2048).astype(np.uint64)[row]
        for r in range(runs):
            odd, flip = (int(mix(np.array([r]), 40 + k)[0]) for k in (0, 1))
            chosen = np.flatnonzero((hashes ^ np.uint64(flip)) * np.uint64(odd | 1) <= limit)
            nodes.append(mix(hashes[chosen], 50 + r))
            owner.append(row[chosen])
    who = np.concatenate(owner)
    order = np.argsort(who, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=rows))]).astype(np.int32)
    return (
        pa.array([key[i].tobytes() for i in range(rows)], pa.binary()),
        pa.array(n),
        pa.array([sketch[i].tobytes() for i in range(rows)], pa.binary()),
        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(nodes)[order].view(np.int64))),
    )


def sets_of(docs: DataFrame, runs: int, similarity: float) -> DataFrame:
    """``doc_id, text_key, k, n, sketch, nodes`` per row; ``text_key`` finds the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), *describe(texts(b), runs, similarity)],
                names=["doc_id", "text_key", "k", "n", "sketch", "nodes"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    return cut_lineage(rows.mapInArrow(run, "doc_id long, text_key binary, k binary, n long, sketch binary, nodes array<long>"))


# --- nodes ---------------------------------------------------------------------------------------


def split(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Children of (node, set): one for each sketch token that the node's own hash chooses."""
    for b in batches:
        sketch = sketches(b.column("sketch"))
        node = b.column("node").to_numpy().view(np.uint64)
        filled = sketch > 0
        limit = np.minimum(2.0**64 / (similarity * np.maximum(filled.sum(1), 1)), 2.0**64 - 2048).astype(np.uint64)
        token = np.arange(BINS, dtype=np.uint64) * np.uint64(65536) + sketch
        drawn = mix(mix(token, 61) ^ node[:, None], 62)
        at, which = np.nonzero(filled & (drawn <= limit[:, None]))
        child = mix(mix(token[at, which], 63) ^ node[at], 64).view(np.int64)
        yield b.take(pa.array(at)).set_column(b.schema.get_field_index("node"), "node", pa.array(child))


def sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BINS)


def leaves(sets: DataFrame, similarity: float, depth: int, leaf: int) -> DataFrame:
    """``place, side, k, n, sketch``: sets that a task compares, ``place`` by ``place``.

    ``side`` 0 is compared with everything of its place, 1 with 2 only.
    """
    rows = sets.select(F.explode("nodes").alias("node"), "k")
    out = []
    members = None
    for level in range(1, depth + 1):
        # written before the join, so that a node which very many sets chose can be split there
        sizes = cut_lineage(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
        met = cut_lineage(rows.join(sizes, "node").select("node", "size", "k") if level == 1 else rows.join(sizes, "node"))
        small, large = met.filter(F.col("size") <= leaf), met.filter(F.col("size") > leaf)
        attach = (lambda df: df.join(sets.select("k", "n", "sketch"), "k")) if level == 1 else (lambda df: df)
        out.append(attach(small).select(F.col("node").alias("place"), F.lit(0).alias("side"), "k", "n", "sketch"))
        members = attach(large).select("node", "size", "k", "n", "sketch")
        if level == depth or not large.take(1):
            break
        members = members.drop("size")
        rows = cut_lineage(members.mapInArrow(partial(split, similarity=similarity), "node long, k binary, n long, sketch binary"))
    blocks = in_blocks(members, "node", "size", leaf)
    return _union([*out, blocks.select("place", "side", "k", "n", "sketch")])


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for f in frames[1:]:
        whole = whole.unionByName(f)
    return whole


def in_blocks(rows: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Deal a large group's rows to pairs of blocks, so that every two rows meet in one place."""
    count = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64("k", F.lit(5)), count).cast("int")
    dealt = rows.withColumn("_blocks", count).withColumn("_own", own)
    other = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    side = F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2)
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    return other.withColumn("side", side).withColumn(
        "place", F.when(F.col("_blocks") == 1, F.xxhash64(group)).otherwise(F.xxhash64(group, low, high))
    ).drop("_blocks", "_own", "_other")


# --- comparing -----------------------------------------------------------------------------------


def places(batches: Iterator[pa.RecordBatch], rows: int = 16_384, size: int = 16 << 20) -> Iterator[pa.Table]:
    """Tables of whole places from batches that are sorted by place."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        kept.append(b)
        if sum(x.num_rows for x in kept) >= rows or sum(x.nbytes for x in kept) >= size:
            table = pa.Table.from_batches(kept).combine_chunks()
            place = table["place"].to_numpy()
            cut = int(np.searchsorted(place, place[-1]))
            if cut:
                yield table.slice(0, cut)
                kept = table.slice(cut).to_batches()
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()
        kept = []
    give_back()


def alike(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sketches (rows of a and b) estimate a similarity of at least ``least``."""
    same = ((a == b) & (a > 0)).sum(-1)
    return same >= least * ((a > 0) | (b > 0)).sum(-1)


def sketch_pairs(table: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows, within places, that the sizes and the sketches let pass (of large places: as stars)."""
    place, side, n = (table[c].to_numpy() for c in ("place", "side", "n"))
    sketch = sketches(table["sketch"].combine_chunks())
    least = similarity - SLACK
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    size = np.diff(np.concatenate([start, [len(place)]]))
    out = []
    tiny = np.repeat(size <= SMALL, size)
    for d in range(1, min(SMALL, int(size.max(initial=1)))):
        i = np.flatnonzero((place[:-d] == place[d:]) & tiny[:-d])
        i = i[meets(n[i], n[i + d], side[i], side[i + d], similarity)]
        for part in np.array_split(i, len(i) // 32_768 + 1):
            out.append((part := part[alike(sketch[part], sketch[part + d], least)], part + d))
    for s, m in zip(start[size > SMALL], size[size > SMALL]):
        order = s + np.argsort(n[s : s + m], kind="stable")
        own, sizes, sides = sketch[order], n[order], side[order]
        own_pairs = []
        for i in range(m - 1):
            end = int(np.searchsorted(sizes, sizes[i] / similarity + 1e-9, "right"))
            j = i + 1 + np.flatnonzero(meets(sizes[i], sizes[i + 1 : end], sides[i], sides[i + 1 : end], similarity))
            if len(j):
                j = j[alike(own[i], own[j], least)]
                own_pairs.append((np.full(len(j), i), j))
        if own_pairs:  # a large place may have a million pairs: only its stars are kept
            label = leaders(m, *(np.concatenate([x[k] for x in own_pairs]) for k in (0, 1)))
            at = np.flatnonzero(label != np.arange(m))
            out.append((order[label[at]], order[at]))
    return tuple(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))


def meets(n1, n2, side1, side2, similarity: float) -> np.ndarray:
    """Sizes allow the similarity, and the sides are to be compared."""
    return (np.minimum(n1, n2) >= similarity * np.maximum(n1, n2) - 1e-9) & ((side1 == 0) | (side1 != side2))


def leaders(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first row of each row's component."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def candidate_edges(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for table in places(batches):
        label = leaders(table.num_rows, *sketch_pairs(table, similarity))
        at = np.flatnonzero(label != np.arange(len(label)))
        k = table["k"].combine_chunks()
        yield pa.RecordBatch.from_arrays([k.take(pa.array(at)), k.take(pa.array(label[at]))], names=["a", "b"])


def exact_pairs(column: pa.Array, side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts of one place whose shingle sets have at least the similarity."""
    row, hashes = shingles(column)
    m = len(column)
    n = np.bincount(row, minlength=m)
    _, code, seen = np.unique(hashes, return_inverse=True, return_counts=True)
    shared = seen[code] > 1
    row, (_, code) = row[shared], np.unique(code[shared], return_inverse=True)
    common = np.zeros((m, m), np.float32)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    width = max(256, (4 << 20) // max(m, 1))
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [low, low + width])
        block = np.zeros((m, width), np.float32)
        block[row[a:b], code[a:b] - low] = 1
        common += block @ block.T
    i, j = np.nonzero(np.triu(common, 1))
    inter = common[i, j].astype(np.float64)
    ok = (inter >= similarity * (n[i] + n[j] - inter) - 1e-9) & ((side[i] == 0) | (side[i] != side[j]))
    return i[ok], j[ok]


def exact_links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Per place and set: the documents it links to there, and its leader there."""
    for table in places(batches):
        place, side, w = (table[c].to_numpy() for c in ("place", "side", "w"))
        column, k = texts(table), table["k"].combine_chunks()
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        for s, e in zip(start, [*start[1:], len(place)]):
            i, j = exact_pairs(column.slice(s, e - s), side[s:e], similarity)
            if len(i):
                links = np.bincount(i, w[s + j], e - s) + np.bincount(j, w[s + i], e - s)
                at = np.flatnonzero(links > 0)
                label = leaders(e - s, i, j)
                yield pa.RecordBatch.from_arrays(
                    [k.take(pa.array(s + at)), k.take(pa.array(s + label[at])), pa.array(links[at].astype(np.int64))], names=["a", "b", "links"]
                )


def join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, depth: int = DEPTH, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """``doc_id, class_id, n_links, text_key, class_key`` for every row of ``docs`` (doc_id, text).

    ``class_key`` names the class whatever the ids are (null for texts without words), ``class_id`` is the smallest doc_id of the class, ``n_links`` the number of other documents
    (copies included) whose similarity to this one is at least the threshold.
    """
    rows = sets_of(docs, runs_for(recall, depth), similarity)
    sets = cut_lineage(rows.filter("n > 0").groupBy("k").agg(
        F.first(F.struct("text_key", "n", "sketch", "nodes")).alias("s"), F.count(F.lit(1)).alias("w"), F.min("doc_id").alias("first_id")
    ).select("k", "s.*", "w", "first_id"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(parts, "place").sortWithinPartitions("place")
    candidates = dealt(leaves(sets, similarity, depth, leaf)).mapInArrow(partial(candidate_edges, similarity=similarity), "a binary, b binary")
    groups = components(cut_lineage(candidates.distinct()))
    sizes = groups.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    wanted = cut_lineage(groups.join(sizes, "label").join(sets.select(F.col("k").alias("node"), "text_key", "w"), "node"))
    found = texts_of(docs, wanted.select("text_key").distinct(), wanted.count()).join(wanted, "text_key").select(F.col("node").alias("k"), "label", "size", "w", "text")
    exact = cut_lineage(dealt(in_blocks(found, "label", "size", block)).mapInArrow(
        partial(exact_links, similarity=similarity), "a binary, b binary, links long"
    ))
    links = exact.groupBy(F.col("a").alias("k")).agg(F.sum("links").alias("links"))
    classes = components(exact).select(F.col("node").alias("k"), "label")
    named = sets.select("k", "w", "first_id").join(classes, "k", "left").join(links, "k", "left").withColumn("label", F.coalesce("label", "k"))
    least = named.groupBy("label").agg(F.min("first_id").alias("class_id"))
    told = named.join(least, "label").select("k", F.col("label").alias("class_key"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    return rows.select("doc_id", "text_key", "k", "n").join(told, "k", "left").select(
        "doc_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "text_key", "class_key",
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without the near copies: of each class the row with the smallest id stays.

    Nulls come last, ties go by text; rows equal in id and text are one document. Rows without
    words all stay.
    """
    rows = join(docs, **options).filter("class_key IS NOT NULL")
    copies = cut_lineage(rows.groupBy("class_key", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    first = cut_lineage(copies.groupBy("class_key").agg(F.min(order).alias("m")))  # so that the join can split a large class
    same = (F.col("doc_id") == F.col("m.doc_id")) | (F.col("doc_id").isNull() & F.col("m.doc_id").isNull())
    same = same & (F.col("text_key") == F.col("m.text_key"))
    placed = cut_lineage(copies.join(first, "class_key").select("doc_id", "text_key", "n", F.coalesce(same, F.lit(False)).alias("stays")))
    key, packed = unused(docs, "_nj_key"), unused(docs, "_nj_row")
    keyed = docs.withColumn(key, text_key())
    named = lambda df: df.select(F.col("doc_id").alias("_nj_id"), F.col("text_key").alias("_nj_text"))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col("_nj_id")) & (F.col(key) == F.col("_nj_text"))
    gone, again = named(placed.filter(~F.col("stays"))), named(placed.filter("stays AND n > 1"))
    count_gone, count_again = gone.count(), again.count()
    kept = keyed.join(broadcast_if_small(gone.unionByName(again), count_gone + count_again), match, "left_anti").select(*columns(docs))
    if not count_again:
        return kept
    repeated = keyed.join(broadcast_if_small(again, count_again), match, "left_semi").groupBy("doc_id", key).agg(F.first(F.struct(*columns(docs))).alias(packed))
    return kept.unionByName(repeated.select(F.col(packed).alias("_nj_one")).select("_nj_one.*"))

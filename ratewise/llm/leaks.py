"""Benchmark decontamination: SimHash of item-sized windows, found through multi-index Hamming blocks.

Words are runs of letters and digits, lower-cased. A window is as many words as a benchmark item
has, at any word offset of a text. It has ``SEEDS`` SimHashes of 64 bits over its words, from independent
word hashes. The 64 bits are cut into ``BLOCKS`` wide blocks; an item is filed, per seed and block, under
every value that differs from its own in at most ``RADIUS // BLOCKS`` bits. Fingerprints that differ in at
most ``RADIUS`` bits are that close in some block, so a window that looks up its own blocks meets every
item within the radius and few others. Pairs within the radius under any seed are verified: shingles
of five words, weighted by how often they occur, and similarity sum(min) / sum(max) of the weights of
at least ``SIMILARITY``. A similar pair is lost only if it is beyond the radius under every seed;
the README has the measured share. ``complete=True`` also finds those, by shingles.

Fingerprints are made only where they can matter. Texts are matched, shingle by shingle, with the
benchmark's: of the windows of every item's size only those are built that hold as many shared shingles
as ``SIMILARITY`` needs, at every offset that can be the best one. This loses nothing.

The benchmark is the stated query set; its tables are broadcast only below a counted size. Nothing
is gathered per item or passage, so one passage in very many documents costs its windows only.

Cases: null texts count as empty and are clean; items without words match nothing; items shorter
than five words are compared by shingles of their own length; a text shorter than an item is one
window; repeated rows and items are judged alike; an empty benchmark leaves everything clean, an
empty table gives an empty result. ``flag`` carries the columns in ``keep`` (one with the name of an output
column gets ``_source`` behind it), ``remove`` all of them; others are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .names import columns, renamed, unused
from .textkeys import text_key, texts_of

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 14
BLOCKS = 5
SEEDS = 2


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def shingle_hashes(words: str, k: int) -> Column:
    """Hashes of all runs of ``k`` words of an array column, in order; empty if there are fewer."""
    run = ", ".join(f"`{words}`[i + {j}]" for j in range(k))
    return F.expr(f"if(size(`{words}`) < {k}, cast(array() as array<bigint>), transform(sequence(0, size(`{words}`) - {k}), i -> xxhash64({run})))")


def simhash(words: str, seed: int = 0) -> Column:
    """64 bits; bit b is set if it is set in the hashes of more than half of the words.

    Hashes are added up in lanes of 8 bits (16 for long windows), as many bits at once as a 64-bit
    number has lanes; very long windows are counted bit by bit.
    """

    def packed(bits: int) -> str:
        ones, most = sum(1 << low for low in range(0, 64, bits)), (1 << bits) - 1
        lanes = f"transform(sequence(0, {bits - 1}), k -> aggregate(h, 0L, (s, x) -> s + (shiftrightunsigned(x, k) & {ones}L)))"
        return _bits(lanes, f"shiftrightunsigned(a.l[b % {bits}], b - b % {bits}) & {most}")

    single = _bits("array(0L)", "aggregate(h, 0L, (s, x) -> s + (shiftrightunsigned(x, b) & 1L))")
    hashes = f"transform(`{words}`, w -> xxhash64({f'{seed}, w' if seed else 'w'}))"
    kinds = f"case when size(h) < 128 then {packed(8)} when size(h) < 32768 then {packed(16)} else {single} end"
    return F.expr(f"element_at(transform(array({hashes}), h -> {kinds}), 1)")


def _bits(sums: str, count: str) -> str:
    """The bits b whose ``count`` is more than half of the hashes ``h``; ``a.l`` are the sums, made once."""
    return (
        f"aggregate(sequence(0, 63), struct(0L as v, {sums} as l), (a, b) -> "
        f"struct(a.v | if(2 * ({count}) > size(h), shiftleft(1L, b), 0L) as v, a.l as l), a -> a.v)"
    )


def cuts(blocks: int) -> list[tuple[int, int]]:
    """First bit and width of each block."""
    edges = [b * 64 // blocks for b in range(blocks + 1)]
    return [(low, high - low) for low, high in zip(edges, edges[1:])]


def block(fingerprint: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fingerprint, low).bitwiseAND(F.lit((1 << width) - 1))


def prints(words: str) -> list[Column]:
    return [simhash(words, seed).alias(f"p{seed}") for seed in range(SEEDS)]


def numbered(bag: str) -> Column:
    """The bag with repeated shingles told apart: the n-th occurrence of one gets a hash of its own, so bags meet as sets."""
    again = f"transform(`{bag}`, (x, i) -> if(array_position(`{bag}`, x) = i + 1, x, xxhash64(x, size(filter(slice(`{bag}`, 1, i), y -> y = x)))))"
    return F.expr(f"if(size(array_distinct(`{bag}`)) = size(`{bag}`), `{bag}`, {again})")


def index_items(benchmark: DataFrame, item_id: str = "item_id") -> DataFrame:
    """``item_id, n_item, k, words, bag`` and fingerprints ``p0, ...`` of the items that have words."""
    words = benchmark.select(F.col(item_id).alias("item_id"), plain_words(F.col("text")).alias("words")).filter("size(words) > 0")
    sized = words.select("item_id", F.size("words").alias("n_item"), F.least(F.size("words"), F.lit(SHINGLE)).alias("k"), "words")
    bags = sized.withColumn("bag", bag_of("words"))
    return bags.select("item_id", "n_item", "k", "words", numbered("bag").alias("bag"), *prints("words"))


def bag_of(words: str) -> Column:
    """Hashes of the shingles of ``k`` words, ``k`` being a column."""
    return reduce(lambda out, k: F.when(F.col("k") == k, shingle_hashes(words, k)).otherwise(out), range(1, SHINGLE), shingle_hashes(words, SHINGLE))


def windows(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``text_key, start, size, k``: windows of the texts that share enough shingles with the items of some size.

    ``hits`` are the positions of shingles that some item of ``n_item`` words has. Any window can move
    right to its next hit, or to the end of the text, without losing one, so it starts at a hit or is
    the last; of ``need`` common shingles the last one must lie inside it, too.
    """
    sizes = {}
    for r in items.select("k", "n_item").distinct().orderBy("k", "n_item").collect():  # at most five k, one row per length
        sizes.setdefault(r["k"], []).append(r["n_item"])
    texts = docs.select(text_key().alias("text_key"), plain_words(F.col("text")).alias("words"))
    if not sizes:
        empty = texts.select("text_key", F.lit(0).alias("start"), F.lit(0).alias("size"), F.lit(0).alias("k"))
        return empty.filter(F.lit(False))
    # all shingles of the lengths that items need, in one pass
    of = lambda k: F.transform(shingle_hashes("words", k), lambda h, i: F.struct(F.lit(k).alias("k"), i.alias("pos"), h.alias("h")))
    placed = F.concat(*[of(k) for k in sizes])
    own = texts.select("text_key", F.size("words").alias("n"), F.inline(placed))
    known = cut_lineage(items.select("k", "n_item", F.explode(bag_of("words")).alias("h")).distinct())
    near = own.join(broadcast_if_small(known, known.count()), ["k", "h"]).groupBy("text_key", "n", "k", "n_item").agg(F.array_sort(F.collect_set("pos")).alias("hits"))
    lengths = reduce(lambda out, k: F.when(F.col("k") == k, F.lit(sizes[k])).otherwise(out), sizes, F.array().cast("array<int>"))
    need = lambda z: F.greatest(F.lit(1), F.ceil((z + F.col("n_item") - 2 * (F.col("k") - 1)) * (similarity / (1 + similarity)) - 1e-6).cast("int"))
    fits = F.filter(
        F.array_distinct(F.transform(lengths, lambda z: F.least(z, F.col("n")))),
        lambda z: (need(z) <= F.least(z, F.col("n_item")) - (F.col("k") - 1)) & (need(z) <= F.size("hits")),
    )
    sized = near.withColumn("size", F.explode(fits)).withColumn("need", need(F.col("size")))
    start = F.expr(
        "array_distinct(transform(filter(transform(sequence(0, size(hits) - need), i -> struct(least(hits[i], n - size) as s, hits[i + need - 1] as e)), "
        "x -> x.e <= x.s + size - k), x -> x.s))"
    )
    return sized.select("text_key", F.explode(start).alias("start"), "size", "k").distinct()


def fingerprinted(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``text_key, k, bag, p0, ...``: one row per different run of words of a text, wherever it stands."""
    of_text = places.groupBy("text_key").agg(F.collect_list(F.struct("start", "size", "k")).alias("at"))
    texts = texts_of(docs, places.select("text_key").distinct(), places.count()).withColumn("all", plain_words(F.col("text")))
    cut = texts.join(of_text, "text_key").select("text_key", "all", F.explode("at").alias("w")).select(
        "text_key", "w.k", F.slice("all", F.col("w.start") + 1, F.col("w.size")).alias("words")
    )
    runs = cut.distinct().withColumn("bag", bag_of("words"))
    return runs.select("text_key", "k", numbered("bag").alias("bag"), *prints("words"))


def matches(
    docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id", similarity: float = SIMILARITY, radius: int = RADIUS, complete: bool = False
) -> DataFrame:
    """``text_key, item_id, similarity``: the best window of each text for each item it leaks.

    ``complete`` also finds similar pairs beyond the radius, by shingles.
    """
    items = cut_lineage(index_items(benchmark, item_id))
    places = cut_lineage(windows(docs, items, similarity))
    known = cut_lineage(fingerprinted(docs, places))
    found = verify(known, items, similarity, radius)
    if complete:
        found = found.unionByName(verify_far(known, items, similarity))
    return found.groupBy("text_key", "item_id").agg(F.max("similarity").alias("similarity"))


def near_pairs(windows: DataFrame, items: DataFrame, radius: int, blocks: int = BLOCKS) -> DataFrame:
    """``windows`` with the ``item_id`` of every item within the radius under some seed, each pair once."""
    parts, spare = cuts(blocks), radius // blocks
    masks = {width: [sum(1 << b for b in bits) for n in range(spare + 1) for bits in combinations(range(width), n)] for _, width in parts}
    numbers = [(seed, b) for seed in range(SEEDS) for b in range(blocks)]
    look = F.array(*[F.struct(F.lit(i).alias("b"), block(F.col(f"p{seed}"), *parts[b]).alias("v")) for i, (seed, b) in enumerate(numbers)])

    def filed(i: int, seed: int, b: int) -> Column:
        own = block(F.col(f"p{seed}"), *parts[b])
        return F.transform(F.lit(masks[parts[b][1]]), lambda m: F.struct(F.lit(i).alias("b"), own.bitwiseXOR(m.cast("long")).alias("v")))

    under = F.concat(*[filed(i, *n) for i, n in enumerate(numbers)])
    right = items.select("item_id", *[F.col(f"p{s}").alias(f"i{s}") for s in range(SEEDS)], F.inline(under))
    rows = items.count() * sum(len(masks[parts[b][1]]) for _, b in numbers)
    left = windows.select("*", F.inline(look))
    met = left.join(broadcast_if_small(right, rows, 48), ["b", "v"])
    close = lambda i, seed, b: (F.bit_count(F.col(f"p{seed}").bitwiseXOR(F.col(f"i{seed}"))) <= radius) & (
        F.bit_count(block(F.col(f"p{seed}").bitwiseXOR(F.col(f"i{seed}")), *parts[b])) <= spare
    )
    first = reduce(lambda out, x: F.when(close(*x), F.lit(x[0])).otherwise(out), reversed([(i, *n) for i, n in enumerate(numbers)]), F.lit(-1))
    return met.filter(F.col("b") == first).select(*windows.columns, "item_id")


def verify(windows: DataFrame, items: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Pairs within the radius that are similar."""
    bags = items.select("item_id", F.col("k").alias("item_k"), F.col("bag").alias("item_bag")).dropDuplicates(["item_id", "item_k", "item_bag"])
    pairs = near_pairs(windows.select("text_key", "k", "bag", *[f"p{s}" for s in range(SEEDS)]), items, radius)
    both = pairs.join(broadcast_if_small(bags, items.count(), 1024), (F.col("k") == F.col("item_k")) & pairs["item_id"].eqNullSafe(bags["item_id"]))
    return compared(both.select("text_key", pairs["item_id"], "bag", "item_bag"), similarity)


def verify_far(windows: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """All similar pairs, by shingles: a similar window lacks at most ``size - ceil(similarity * size)`` of
    the item's shingles, so of any one more than that it holds one."""
    lead = F.expr(f"slice(array_sort(bag), 1, cast(size(bag) - ceil({similarity} * size(bag) - 1e-6) + 1 as int))")
    right = items.select("item_id", F.col("k").alias("item_k"), F.col("bag").alias("item_bag"), lead.alias("lead"))
    rows = items.agg(F.sum(F.size("bag"))).first()[0] or 0
    left = windows.select("text_key", "k", "bag", F.explode("bag").alias("h"))
    met = left.join(broadcast_if_small(right.withColumn("h", F.explode("lead")), rows, 512), "h")
    return compared(met.filter((F.col("k") == F.col("item_k")) & (F.get(F.array_intersect("lead", "bag"), F.lit(0)) == F.col("h"))), similarity)


def compared(pairs: DataFrame, similarity: float) -> DataFrame:
    """``text_key, item_id, similarity`` of the pairs that are similar enough; bags of unlike sizes are not compared."""
    sizes = F.least(F.size("bag"), F.size("item_bag")) >= (similarity - 1e-9) * F.greatest(F.size("bag"), F.size("item_bag"))
    counted = pairs.filter(sizes).withColumn("common", F.size(F.array_intersect("bag", "item_bag")))
    share = F.col("common") / (F.size("bag") + F.size("item_bag") - F.col("common"))
    return counted.select("text_key", "item_id", share.alias("similarity")).filter(F.col("similarity") >= similarity - 1e-9).groupBy("text_key", "item_id").agg(
        F.max("similarity").alias("similarity")
    )


def flag(docs: DataFrame, found: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``contaminated, n_items, item_id, similarity`` (the best item, ties to the lowest id)."""
    best = found.groupBy("text_key").agg(
        F.countDistinct("item_id").alias("n_items"), F.max_by("item_id", F.struct("similarity", -F.col("item_id"))).alias("item_id"), F.max("similarity").alias("similarity")
    )
    verdicts = cut_lineage(best)
    names = renamed(keep, ["contaminated", "n_items", "item_id", "similarity", "text_key"])
    kept = docs.select(*(c.alias(n) for c, n in zip(columns(docs, keep), names)), text_key().alias("text_key"))
    rows = kept.join(broadcast_if_small(verdicts, verdicts.count()), "text_key", "left")
    return rows.select(
        *columns(kept, names), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        "item_id", "similarity",
    )


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that leak nothing, with their columns."""
    key = unused(docs, "_lk_key")
    keys = cut_lineage(found.select(F.col("text_key").alias(key)).distinct())
    keyed = docs.withColumn(key, text_key())
    return keyed.join(broadcast_if_small(keys, keys.count(), 32), key, "left_anti").select(*columns(docs))

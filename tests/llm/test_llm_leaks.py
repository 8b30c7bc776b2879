"""Leaked benchmark items against all windows of all texts."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ratewise.llm import leaks


def words_of(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def bag(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def similarity(x, y, k):
    a, b = bag(x, k), bag(y, k)
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if both else 0.0


def brute(text, items):
    """Best similarity per item, over every window of every item's size."""
    words, out = words_of(text), {}
    sizes = {(len(words_of(t)), min(5, len(words_of(t)))) for _, t in items if words_of(t)}
    for item, t in items:
        own = words_of(t)
        if not own:
            continue
        k = min(5, len(own))
        best = 0.0
        for size in {s for s, kk in sizes if kk == k}:
            size = min(size, len(words))
            for i in range(len(words) - size + 1):
                best = max(best, similarity(words[i : i + size], own, k))
        if best >= 0.8 - 1e-9:
            out[item] = round(best, 6)
    return out


def text_of(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    items = [(i, text_of(rng, rng.randint(14, 60))) for i in range(12)] + [(20, "two words"), (21, None), (22, " ... "), (23, "Only, four words here")]
    docs = []
    for i in range(30):
        left, right = text_of(rng, rng.randint(0, 60)), text_of(rng, rng.randint(0, 60))
        inner = items[i % 12][1].split()
        if i % 3 == 1:  # a word changed at an end
            inner[-1] = "changed"
        if i % 3 == 2:  # half of the item only
            inner = inner[: len(inner) // 2]
        docs.append((i, f"{left} {' '.join(inner).upper() if i % 2 else ', '.join(inner)} {right}"))
    docs += [(100 + i, text_of(rng, 50)) for i in range(10)] + [(200, None), (201, ""), (202, items[3][1]), (203, "say TWO words."), (204, "four, words here only"), (205, "only four words here")]
    docs += [(202, items[3][1]), (None, items[4][1]), (300, text_of(rng, 5000) + " " + items[5][1])]
    return items, docs


def test_equals_all_windows(spark, data):
    items, docs = data
    table = spark.createDataFrame([(*d, 1.0, "k") for d in docs], "doc_id long, text string, similarity double, text_key string")
    bench = spark.createDataFrame([(*i, "w") for i in items + items[:2]], "item_id long, text string, words string")
    found = leaks.matches(table, bench)
    out = leaks.flag(table, found, ["doc_id", "text", "similarity"])
    rows = out.collect()
    assert len(rows) == len(docs) and "similarity_source" in out.columns
    for r in rows:
        want = brute(r["text"], items)
        assert (r["contaminated"], r["n_items"]) == (bool(want), len(want)), r["text"]
        if want:
            best = max(want.values())
            assert r["similarity"] == pytest.approx(best, abs=1e-6) and r["item_id"] == min(i for i, s in want.items() if s == best)
    kept = leaks.remove(table, found)
    assert kept.columns == table.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rows if not r["contaminated"])


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    rng, radius = random.Random(2), leaks.RADIUS
    base, other = rng.getrandbits(63), 0
    prints = [base] + [base ^ sum(1 << b for b in rng.sample(range(64), d)) for d in range(1, 24) for _ in range(6)]
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    items = spark.createDataFrame([(7, signed[0], other)], "item_id long, p0 long, p1 long")
    far = -1  # under the other seed all bits differ
    windows = spark.createDataFrame([(i, p, far) for i, p in enumerate(signed)] + [(1000 + i, far ^ signed[0], 0) for i in range(2)], "w long, p0 long, p1 long")
    found = [r["w"] for r in leaks.near_pairs(windows, items, radius).collect()]
    want = [i for i, p in enumerate(prints) if bin(p ^ base).count("1") <= radius] + [1000, 1001]
    assert sorted(found) == want  # each pair once


def test_recall_of_fingerprints_at_the_threshold(spark):
    """Pairs as unlike as the threshold allows: almost all are found by fingerprints alone, all with ``complete``."""
    rng = random.Random(8)
    items, docs, n = [], [], 0
    for i in range(1200):
        size = rng.choice([30, 50, 90])
        words = [f"w{i}x{j}" for j in range(size)]
        items.append((i, " ".join(words)))
        if i % 2:  # the last words changed
            new = words[: size - max(1, (size - 4) // 9)] + [f"c{i}x{j}" for j in range(max(1, (size - 4) // 9))]
        else:  # a short text that holds the first part only
            new = words[: size - (size - 4) // 5]
        docs.append((i, " ".join(new)))
        n += similarity(new, words, 5) >= 0.8
    assert n == 1200
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = leaks.matches(table, bench).select("item_id").distinct().count()
    assert found >= 0.99 * n
    assert leaks.matches(table, bench, complete=True).select("item_id").distinct().count() == n


def test_simhash_is_the_majority_of_word_bits(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["x"],), ([],)], "w array<string>")
    rows = df.select("w", leaks.simhash("w").alias("s"), F.transform("w", lambda x: F.xxhash64(x)).alias("h")).collect()
    for r in rows:
        bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r["h"]) > len(r["h"]))
        assert r["s"] % (1 << 64) == bits


def test_empty_tables(spark, data):
    items, docs = data
    none_docs, none_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert leaks.flag(table, leaks.matches(table, none_items), ["doc_id"]).filter("contaminated").count() == 0
    assert leaks.flag(none_docs, leaks.matches(none_docs, bench), ["doc_id"]).count() == 0
    assert leaks.remove(table, leaks.matches(table, none_items)).count() == len(docs)


def test_windows_between_the_aligned_ones(spark):
    """An insertion in the middle and changes at both ends: the best window starts at no aligned place."""
    rng = random.Random(5)
    items, docs = [], []
    for i, (n, ends, more) in enumerate([(60, 1, 2), (90, 2, 4)]):
        words = [f"w{i}x{j}" for j in range(n)]
        items.append((i, " ".join(words)))
        new = [f"n{i}x{j}" for j in range(ends)] + words[ends : n // 2] + [f"m{i}x{j}" for j in range(more)] + words[n // 2 : n - ends] + [f"o{i}x{j}" for j in range(ends)]
        docs.append((i, f"{text_of(rng, 40)} {' '.join(new)} {text_of(rng, 40)}"))
    found = leaks.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = {r["item_id"]: round(r["similarity"], 6) for r in found.collect()}
    assert rows == {i: s for i, (_, text) in enumerate(docs) for i2, s in brute(text, items).items() if i2 == i} and len(rows) == 2


def test_repeated_shingles_weigh(spark):
    """Weights count occurrences on both sides."""
    items = [(0, "a b c d e " * 6), (1, "p q r s t u " * 3 + "v w x y z")]
    docs = [(0, "a b c d e " * 7), (1, "a b c d e " * 3), (2, "p q r s t u " * 3 + "v w x y"), (3, "p q r s t u v w x y z")]
    found = leaks.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), complete=True)
    rows = sorted((r["item_id"], round(r["similarity"], 6)) for r in found.collect())
    assert rows == sorted((i, s) for _, text in docs for i, s in brute(text, items).items())


@pytest.mark.parametrize("n", [127, 128, 200, 40_000])
def test_long_windows_have_the_same_majority(spark, n):
    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), i)).alias("w"))
    r = df.select(leaks.simhash("w", 1).alias("s"), F.expr("transform(w, x -> xxhash64(1, x))").alias("h")).first()
    assert r["s"] % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r["h"]) > n)

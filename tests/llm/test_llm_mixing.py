"""Source mix against a plain loop."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from ratewise.llm import mixing

ROWS = [
    (i, "w " * n, source)
    for i, (n, source) in enumerate(
        [(random.Random(i).randint(0, 30), random.Random(-i).choice(["b", "a", "é", None, "hot", "hot", "hot"])) for i in range(150)]
    )
] + [(7, "again one two", "a"), (7, "again one two", "a"), (None, None, "a"), (None, "x y", None), (900, "", "wordless"), (901, "long " * 40_000, "b")]


def size(text):
    return len((text or "").encode().split())


def plain_targets(rows, weights=(3, 1, 2), share=1.5, epochs=2):
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += size(text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = share * sum(sizes.values()) - sum(epochs * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: epochs * sizes[s] if s in capped else rest * weight[s] / free for s in order}
        over = {s for s in order if target[s] > epochs * sizes[s] + 1e-9}
        if not over:
            return sizes, target
        capped |= over


def key(doc, text):
    return hashlib.md5(f"{mixing.SEED}:{'' if doc is None else doc}:{text or ''}".encode()).hexdigest()


def plain_plan(rows):
    sizes, target = plain_targets(rows)
    out, groups = [], defaultdict(list)
    for doc, text, source in rows:
        groups[source].append((key(doc, text), doc, size(text)))
    for source, members in groups.items():
        budget, before = math.floor(target[source]), 0
        for _, doc, n in sorted(members, key=lambda m: m[0]):
            whole, rest = divmod(budget, sizes[source]) if sizes[source] else (0, 0)
            out.append((doc, n, sizes[source], round(target[source], 6), whole * n + min(n, max(0, rest - before))))
            before += n
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "extra", 1) for r in ROWS], "doc_id long, text string, source string, target string, `a.b` int")


def test_plan_equals_a_loop(docs):
    got = [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.plan(docs).collect()]
    assert sorted(got, key=str) == plain_plan(ROWS)


def test_budgets_are_exact_and_reruns_agree(docs):
    rows = mixing.plan(docs).collect()
    taken, target = Counter(), {}
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert {s: math.floor(t) for s, t in target.items()} == dict(taken)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.plan(docs.repartition(5)).collect()))


def test_mixed_rows_hold_the_taken_words(docs):
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    words, want = Counter(), Counter()
    known = {(d, t) for d, t, _ in ROWS}
    for r in mixed.collect():
        words[r["doc_id"], r["source"]] += size(r["text"])
        assert any(d == r["doc_id"] and (t or "").startswith(r["text"]) for d, t in known)
    for r in mixing.plan(docs).collect():
        want[r["doc_id"], r["source"]] += r["taken"]
    assert words == +want


def test_empty_and_wordless(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.plan(spark.createDataFrame([], schema)).count() == 0
    assert mixing.apply_mix(spark.createDataFrame([], schema)).count() == 0
    rows = mixing.plan(spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 2


def test_first_words(spark):
    df = spark.createDataFrame([("  a b\n c ", n) for n in range(5)], "t string, n int")
    got = [r[0] for r in df.select(mixing.first_words(df.t, df.n)).collect()]
    assert got == ["", "  a", "  a b", "  a b\n c", "  a b\n c"]


def test_equal_rows_of_two_sources_stay_apart(spark, monkeypatch):
    """A document that two sources hold is taken from each as often as its own target says."""
    rows = [(i, f"w{i} x y z", s) for i in range(12) for s in ("a", "b", None)] + [(50 + i, "only a has this one", "a") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r["source"]: r["n"] for r in mixing.plan(docs).groupBy("source").agg({"taken": "sum"}).toDF("source", "n").collect()}
    for copies in (4096, 1):
        monkeypatch.setattr(mixing, "COPIES", copies)
        got = Counter()
        for r in mixing.apply_mix(docs).collect():
            got[r["source"]] += size(r["text"])
        assert dict(got) == want

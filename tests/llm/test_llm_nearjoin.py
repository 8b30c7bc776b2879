"""Chosen-path join against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ratewise.llm import nearjoin
from ratewise.llm.components import components


def shingle_set(text):
    words = (text or "").encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows, similarity=0.8):
    """(class row list, links) per row, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= similarity * (len(sets[i] | sets[j])) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in members[find(i)] if rows[j][0] is not None]
        out.append((doc, (min(ids) if ids else None) if sets[i] else doc, links[i]))
    return sorted(out, key=str)


def text_of(rng, n):
    return " ".join(rng.choice("abcdefghijklmnopqrst") * rng.randint(1, 3) + str(rng.randint(0, 99)) for _ in range(n))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = str(rng.random())
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [text_of(rng, rng.randint(30, 200)) for _ in range(40)]
    passage = text_of(rng, 70)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, edited(rng, base[i % 40], rng.randint(0, 3))) for i in range(60)]  # near copies
    hot = text_of(rng, 120)
    out += [(200 + i, edited(rng, hot, rng.randint(0, 2))) for i in range(60)]  # one large group
    out += [(300 + i, base[0]) for i in range(40)]  # exact copies
    out += [(400 + i, passage + " " + text_of(rng, rng.randint(20, 60))) for i in range(60)]  # a shared passage
    out += [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "one  two"), (505, "one"), (None, base[1]), (None, "only nulls here no id at all"), (1, "another text under a known id goes here"), (1, base[1])]
    out += [(600, "long " + " ".join(map(str, range(30_000)))), (601, " ".join(map(str, range(30_000))))]
    return out


def result(df):
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("leaf,block,depth", [(1024, 512, 4), (8, 16, 2)])
def test_equals_all_pairs(spark, rows, leaf, block, depth):
    docs = spark.createDataFrame([(d, t, 1, "n") for d, t in rows], "doc_id long, text string, n int, sketch string")
    got = nearjoin.join(docs, leaf=leaf, block=block, depth=depth, recall=0.99999)
    assert result(got) == brute(rows)


def test_keep_one_of_each_class(spark, rows):
    docs = spark.createDataFrame([(d, t, "a") for d, t in rows], "doc_id long, text string, `_nj_key` string")
    kept = nearjoin.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    classes = defaultdict(list)
    for (doc, text), (_, _, _) in zip(rows, rows_classes := [(0, 0, 0)] * len(rows)):
        classes[doc, text].append(1)
    want_classes = {c for _, c, _ in brute(rows)}
    assert {d for d, t in got if shingle_set(t)} == {c for c in want_classes if c not in (500, 501, 502)}
    assert sorted(str(d) for d, t in got if not shingle_set(t)) == ["500", "501", "502"]
    assert len(got) == len(set(got))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nearjoin.join(docs).count() == 0
    assert nearjoin.keep_one(docs).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert result(nearjoin.join(only)) == [(1, 1, 0), (2, 2, 0)]


def test_runs_reach_the_recall():
    """A pair at the threshold shares a chosen shingle in some run about as often as promised."""
    rng, missed, trials = np.random.default_rng(3), 0, 400
    runs = nearjoin.runs_for(0.99, 1)
    texts = []
    for _ in range(trials):
        words = [str(w) for w in rng.integers(0, 10**9, 84)]
        texts += [" ".join(words[:76]), " ".join(words[8:])]  # 72 and 72 shingles, 64 shared: 0.8
    column = pa.array(texts, pa.large_string())
    _, n, _, nodes = nearjoin.describe(column, runs, 0.8)
    chosen = [set(x) for x in nodes.to_pylist()]
    missed = sum(not chosen[2 * i] & chosen[2 * i + 1] for i in range(trials))
    assert missed <= 0.03 * trials


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if None not in (a, b) and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}

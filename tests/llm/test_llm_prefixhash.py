"""Spans, extensions and fingerprints against plain string comparison."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewise.llm import prefixhash as ph


def text_of(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoß😀") for _ in range(rng.randint(2, 8))) for _ in range(n))


def extension(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_spans_across_segments(monkeypatch):
    rng = random.Random(1)
    text = "".join(rng.choice("abc") for _ in range(400))
    whole = ph.Hashed(ph.code_points(text))
    want = [ph.prefixes(ph.code_points(text), w) for w in range(2)]
    monkeypatch.setattr(ph, "SEGMENT", 64)
    ph._powers.cache_clear(), ph._far.cache_clear()
    try:
        cut = ph.Hashed(ph.code_points(text))
        assert all((a == b).all() for a, b in zip(cut.prefix, want))
        for _ in range(500):
            i, j = rng.randint(0, 400), rng.randint(0, 400)
            n = rng.randint(0, 400 - max(i, j))
            assert (cut.span(i, i + n) == cut.span(j, j + n)) == (text[i : i + n] == text[j : j + n])
    finally:
        monkeypatch.undo()
        ph._powers.cache_clear(), ph._far.cache_clear()
    assert whole.span(3, 10) == ph.Hashed(ph.code_points(text[3:10])).span(0, 7)


def test_longest_extensions(spark):
    rng = random.Random(2)
    base = text_of(rng, 60)
    rows = []
    for _ in range(60):
        i, j = rng.randint(0, 80), rng.randint(0, 80)
        k = rng.randint(0, len(base))
        rows.append((base, base[:k] + "#" + base[k:], i, j if rng.random() < 0.5 else i))
    rows += [(None, "a", 0, 0), ("a", "a", None, None), ("a", "a", 2, 0), ("a", "a", 1, 1), ("", "", 0, 0)]
    df = spark.createDataFrame(rows, "left string, right string, at_left long, at_right long")
    for r in ph.longest_extensions(df).collect():
        a, b, i, j = r["left"] or "", r["right"] or "", r["at_left"] or 0, r["at_right"] or 0
        assert r["extension"] == (extension(a[i:], b[j:]) if i <= len(a) and j <= len(b) else 0)


def test_likeness_follows_common_text():
    rng = random.Random(3)
    for n in (12, 40, 200, 1500):
        a, other = text_of(rng, n), text_of(rng, n)
        words = a.split()
        early = " ".join(["new", "words"] + words)
        late = " ".join(words[: n // 2] + ["changed"] + words[n // 2 + 1 :])
        fa, fo, fe, fl, half = ph.fingerprints_of([a, other, early, late, a[: len(a) // 2]])
        assert ph.likeness(fa, fa) == 1.0
        assert ph.likeness(fa, fo) < 0.1
        assert ph.likeness(fa, half) == pytest.approx(2 / 3, abs=0.1)
        if n > 12:
            assert ph.likeness(fa, fe) > 0.8 and ph.likeness(fa, fl) > 0.8
        assert all(0 <= ph.likeness(x, y) <= 1 for x in (fa, fo, fe) for y in (fo, fl, half))


def test_repeating_texts():
    for a in ("And " * 900, "x" * 5000, "line one\n" * 30 + "line two\n" * 300, "ab"):
        b = ph.edited(a, "quite another text, long enough to stand in " * 200)
        fa, fb = ph.fingerprints_of([a, b])
        assert ph.likeness(fa, fb) >= (0.55 if len(a) > 10 else 0.0)
        assert len(fa) < 20_000


def test_slices_do_not_matter():
    rng = random.Random(4)
    strings = [text_of(rng, n) for n in (0, 1, 5, 80, 3000)] + ["", "a"]
    assert ph.fingerprints_of(strings) == [ph.fingerprints_of([s])[0] for s in strings]
    assert len(set(ph.fingerprints_of(["", "a", "b", "ab", "ba"]))) == 5


def check(spark, rows, partitions):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars string, edge int").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = [r.asDict() for r in ph.with_next(df).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    return got


@pytest.mark.parametrize("partitions", [1, 4, 50])
def test_next_document(spark, partitions):
    rng = random.Random(5)
    rows = [(i * 7 % 101, text_of(rng, rng.randint(0, 60)), "n", 3) for i in range(40)] + [(200, None, None, None)]
    got = check(spark, rows, partitions)
    texts = {i: t or "" for i, t, _, _ in rows}
    ids = sorted(texts, reverse=True)
    follow = dict(zip(ids, ids[1:] + ids[:1]))
    assert sorted((r["doc_id"] for r in got), reverse=True) == ids
    for r in got:
        a, b = texts[r["doc_id"]], texts[follow[r["doc_id"]]]
        changed = ph.edited(a, b)
        assert r["n_chars"] == len(a) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        prints = ph.fingerprints_of([a, changed, b])
        assert [r["fingerprint"], r["edited_fingerprint"]] == prints[:2]
        assert [r["near_edited"], r["near_next"]] == [ph.likeness(prints[0], p) for p in prints[1:]]


def test_repeated_ids_single_and_empty(spark):
    assert check(spark, [], 4) == []
    one = check(spark, [(7, "some words", None, 1)], 4)
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["n_chars"] == 10
    rows = [(1, "same text here", None, 1)] * 5 + [(None, "tail", None, 1)] * 2 + [(1, None, None, None)]
    got = check(spark, rows, 8)
    assert sorted(r["n_chars"] for r in got) == [0, 4, 4, 14, 14, 14, 14, 14]
    assert len({r["fingerprint"] for r in got}) == 3


def test_fingerprints_keep_their_key(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "`my id` long, body string")
    got = ph.fingerprints(df, "my id", "body").collect()
    assert len(got) == 3 and got[0]["fingerprint"] == ph.fingerprints_of([got[0]["my id"] and "a b" or ""])[0]
    assert np.isclose(ph.likeness(*[r["fingerprint"] for r in got if r["my id"]]), 1.0)
    assert df.select(F.count("body")).first()[0] == 2

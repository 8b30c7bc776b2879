"""Lattice sums against enumeration of all segmentations."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ratewise.llm import lattice

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def weights():
    return np.log(lattice.vocabulary(PATH).prior)


def segmentations(text, index):
    if not text:
        yield ()
    for n in range(1, len(text) + 1):
        if text[:n] in index:
            for rest in segmentations(text[n:], index):
                yield ((index[text[:n]],), *rest)
    if text and text[0] not in index:
        for rest in segmentations(text[1:], index):
            yield (tuple(lattice.vocabulary(PATH).bytes_at + b for b in text[0].encode("utf-8", "surrogatepass")), *rest)


def enumerated(word, weights):
    vocab = lattice.vocabulary(PATH)
    index = {p: i for i, p in enumerate(vocab.pieces)}
    uses, total = Counter(), 0.0
    for way in segmentations(lattice.MARK + word, index):
        flat = [i for edge in way for i in edge]
        p = math.exp(sum(weights[i] for i in flat))
        total += p
        for i in flat:
            uses[i] += p
    return math.log(total), {i: p / total for i, p in uses.items()}


WORDS = ["the", "a", "tioning", "ß", "日本", "\U0001f600x", "x" * 11, "hello,", "", "é\u0301"]


def test_sum_over_all_segmentations(weights):
    got = lattice.lattice(WORDS, weights, PATH)
    assert got == pytest.approx([enumerated(w, weights)[0] for w in WORDS], rel=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=7), min_size=1, max_size=4))
def test_any_words(words):
    words = [w.encode("utf-8", "replace").decode() for w in words]
    weights = np.log(lattice.vocabulary(PATH).prior)
    assert lattice.lattice(words, weights, PATH) == pytest.approx([enumerated(w, weights)[0] for w in words], rel=1e-9)


def test_expected_uses(weights):
    counts = np.zeros(len(weights))
    lattice.lattice(WORDS, weights, PATH, counts, np.arange(1.0, len(WORDS) + 1))
    want = np.zeros(len(weights))
    for k, w in enumerate(WORDS, 1):
        for i, p in enumerated(w, weights)[1].items():
            want[i] += k * p
    assert counts == pytest.approx(want, abs=1e-9)


def test_long_words_take_the_same_sum(weights, monkeypatch):
    word = "abcdefghij" * 9
    alone = lattice.lattice([word], weights, PATH)[0]
    monkeypatch.setattr(lattice, "LONG", 1000)
    assert lattice.lattice([word], weights, PATH)[0] == pytest.approx(alone, rel=1e-12)
    assert np.isfinite(lattice.lattice(["y" * 20_000], weights, PATH)).all()


def rows():
    texts = [None, "", "The the THE end. É", "one " * 500, "w" * 3000] + [" ".join(f"re{'ing' * (i % 3)}ed{j % 5}" for j in range(i)) for i in range(60)]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "null id the"), (3, "one " * 500)]


@pytest.mark.parametrize("head", [0, 5, 1000])
def test_base_and_model_scores(spark, head):
    data = rows()
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in data], "doc_id long, text string, score double, n int")
    got = lattice.score(docs, PATH, head=head).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    count, ends = Counter(), 0
    for d, t in data:
        if not held(d):
            count.update(words(t))
            ends += 1
    n, v = sum(count.values()) + ends, len(count) + 1
    base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    want = sorted((str(d), held(d), len(words(t)) + 1, sum(count[w] > 0 for w in words(t)) + 1, n, round(sum(base(count[w]) for w in words(t)) + base(ends), 6)) for d, t in data)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    by_text = {r["doc_id"]: r["score"] for r in got}
    assert all(math.isfinite(s) and s < 0 for s in by_text.values())
    # a text of one word 500 times is 500 times its word, and an end
    assert by_text[3] - by_text[0] < 500 * -0.1
    assert by_text[0] == by_text[1]


def test_training_raises_the_likelihood_of_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    total = lambda rounds: sum(r["score"] for r in lattice.score(docs, PATH, rounds=rounds).filter("held_out").collect())
    untrained, once, twice = total(0), total(1), total(3)
    assert untrained < once < twice


def test_without_training_documents_and_empty(spark):
    one = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lattice.score(spark.createDataFrame([(one, "a b")], "doc_id long, text string"), PATH).first()
    assert (r["n_known"], r["train_tokens"], r["held_out"]) == (0, 0, True) and r["base_score"] == pytest.approx(0.0)
    assert lattice.score(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0

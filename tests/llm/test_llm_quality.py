"""Rule ledger against a plain recomputation."""

import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ratewise.llm import quality
from ratewise.llm.arrowtext import Words


def plain(text):
    text = text or ""
    words = text.encode().split()
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [l for l in text.split("\n") if l.encode().split()]
    kinds = [unicodedata.category(c) for c in text]
    return {
        "n_words": len(words), "word_chars": sum(c not in " \t\n\x0b\x0c\r" for c in text), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "n_letters": sum(k[0] == "L" for k in kinds), "n_upper": sum(k == "Lu" for k in kinds),
    }


TEXTS = [None, "", " \n\t ", "one", "a b c\x1cd", "x " * 9, "a b c d e f g h " * 3 + "z", "l1\nl1\n\n l1\nl2 *#$", "ÀB é ß\n" * 30, "w" * 50_000 + " end", " ".join(map(str, range(5000)))]


def test_measures_equal_a_plain_recomputation():
    got = quality.measure(pa.array([t or "" for t in TEXTS], pa.large_string()))
    for i, text in enumerate(TEXTS):
        assert {m: int(got[m][i]) for m in quality.MEASURES} == plain(text), text and text[:40]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=80), min_size=1, max_size=4))
def test_repeated_words_of_few_letters(texts):
    column = pa.array(texts, pa.large_string())
    got = quality.repeated_words(Words(column), len(texts))
    assert got.tolist() == [plain(t)["n_repeat_words"] for t in texts]


def test_ledger_policies_and_clashing_columns(spark):
    rows = [(i, t, 7, "x") for i, t in enumerate(TEXTS)] + [(3, "one", 8, "x"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, `fail.bits` string")
    out = quality.ledger(docs, docs.columns)
    assert out.columns[:4] == ["doc_id", "text", "n_words_source", "fail.bits"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain(r["text"])
        assert {m: r[m] for m in quality.MEASURES} == want
        failed = {n for k, n in enumerate(quality.RULES) if r["fail_bits"] >> k & 1}
        assert ("few_words" in failed) == (want["n_words"] < 20)
        assert ("repeated_windows" in failed) == (100 * want["n_repeat_words"] > 30 * want["n_words"])


def test_ablation_equals_counting(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS * 2], "text string")
    out = quality.ledger(docs, [])
    bits = [r["fail_bits"] & quality.bits(quality.POLICIES["prose-1"]) for r in out.collect()]
    for r in quality.ablate(out, "prose-1").collect():
        own = quality.bits([r["rule"]])
        assert (r["failed"], r["only_this"], r["kept_without"]) == (
            sum(bool(b & own) for b in bits), sum(b == own for b in bits), sum(not b & ~own for b in bits)
        )


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = quality.ledger(docs, ["doc_id"])
    assert out.count() == 0
    assert [(r["failed"], r["kept_without"]) for r in quality.ablate(out, "base-1").collect()] == [(0, 0)] * 2


def test_policies_name_rules():
    for rules in quality.POLICIES.values():
        assert set(rules) <= set(quality.RULES)
    with pytest.raises(ValueError):
        quality.bits(["no such rule"])

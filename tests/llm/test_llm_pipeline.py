"""The pipeline's stages on a small table against plain recomputation, and queries against their SQL."""

import random
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from check import TABLES, rows_of
from test_llm_leaks import brute as leaks_of
from test_llm_mixing import plain_plan
from test_llm_nearjoin import shingle_set
from test_llm_quality import plain as measures_of
from test_llm_tokens import expected, got

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, `a.b` int, _row int"


def rejected(text):
    m = measures_of(text)
    return (
        m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"] or 100 * m["n_symbols"] > 5 * m["word_chars"] or 100 * m["n_dup_lines"] > 50 * m["n_lines"]
        or 100 * m["n_upper"] > 60 * m["n_letters"] or 100 * m["n_letters"] < 50 * m["word_chars"] or m["word_chars"] > 40 * m["n_words"]
    )


@pytest.fixture(scope="module")
def rows(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base = [text(rng.randint(25, 120)) for _ in range(60)]
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[i] + " more") for i in range(10)] + [(200 + i, base[0]) for i in range(8)]  # copies
    out += [(300 + i, f"{text(20)} {items[i % len(items)][1]} {text(9)}") for i in range(8)]  # leaks
    out += [(400, None), (401, ""), (402, "SHOUT " * 40), (403, "a*** " * 50), (404, " ".join(f"w{i}" for i in range(20_000))), (5, base[7]), (1, base[1]), (None, text(40))]
    extra = [("en", rng.choice(["s1", "s1", "s2", None]), len(t or ""), "x", 1, 2) for _, t in out]
    return items, [(*r, *e) for r, e in zip(out, extra)]


@pytest.fixture(scope="module")
def staged(spark, rows, tmp_path_factory):
    """What each stage was given and gave."""
    items, data = rows
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, out = spark.createDataFrame(data, SCHEMA), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, folder)
        made.write.parquet(f"{folder}/{k}.parquet")
        made = spark.read.parquet(f"{folder}/{k}.parquet")
        out.append((docs, made))
        docs = made
    return out


def rows_in(df):
    return Counter(tuple(r) for r in df.collect())


def test_columns_stay(staged):
    for docs, made in staged[:-1]:
        assert made.columns == docs.columns


def test_quality_stage(staged):
    docs, made = staged[0]
    assert rows_in(made) == Counter(r for r in map(tuple, docs.collect()) if not rejected(r[1]))


def test_near_duplicate_stage(staged):
    docs, made = staged[1]
    before, after = [tuple(r) for r in docs.collect()], [tuple(r) for r in made.collect()]
    sets = {r: shingle_set(r[1]) for r in {*before}}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    assert set(after) <= set(before) and len(after) == len(set(after))
    for i, a in enumerate(after):
        assert not any(near(a, b) for b in after[:i])
    for b in set(before) - set(after):
        assert any(near(a, b) for a in after)
        assert all(a[0] is not None and (b[0] is None or a[0] <= b[0]) for a in after if near(a, b))


def test_leak_stage(staged, rows):
    docs, made = staged[2]
    assert rows_in(made) == Counter(r for r in map(tuple, docs.collect()) if not leaks_of(r[1], rows[0]))
    assert docs.count() - made.count() >= 8


def test_mix_stage(staged):
    docs, made = staged[3]
    taken, want = Counter(), Counter()
    for r in made.collect():
        taken[r["doc_id"]] += len(r["text"].encode().split())
        assert r["n_chars"] == len(r["text"])
    for doc, _, _, _, n in plain_plan([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]):
        want[doc] += n
    assert taken == +want


def test_token_stage(staged):
    docs, made = staged[4]
    assert got(made) == expected([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_run_applies_the_stages_to_documents(spark):
    made = corpus_pipeline.run(spark, FOLDER)
    assert made.columns == ["doc_id", "copy", "start", "n_tokens", "ids_crc32"] and made.count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    result = duck.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in result.description], result.fetchall())


def test_every_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()

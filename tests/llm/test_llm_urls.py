"""URL rules against a plain matcher, trees against the fitted model and held-out labels."""

import random

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ratewise.llm import urls

URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.net", "http://Example.NET/", "https://a.example.net/en/x?y=/#z", "https://notexample.net/en/",
    "http://x.org/fr/1", "http://org/fr/", "http://example.com/de/1", "http://example.com/DE/1", "ftp://é.com/de/?q", "http://a.net?x://b.org/fr/",
    "http://a.com#frag", "://net/", "http://b.example.net/en", "http://l.example.com/de/" + "p" * 20_000, "http://u@h.net:80/x\ny", "x\n://net/a",
]


def plain(url):
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", "", None, None
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    best = None
    for r in urls.RULES:
        of, start = r.parts
        if (host == of or host.endswith("." + of)) and path.startswith(start) and (best is None or len(r.rule) > len(best.rule)):
            best = r
    return host, path, best and best.rule, best and best.verdict


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "p", "h") for i, u in enumerate(URLS)] + [(0, URLS[5], "p", "h")], "page_id long, url string, path string, host string")
    model = urls.fit(urls.label_by_rules(pages, urls.RULES))
    out = urls.judge(pages, model, urls.RULES, ["page_id", "path"])
    assert out.columns == ["page_id", "path_source", "host", "path", "rule", "verdict"]
    rows = out.collect()
    assert len(rows) == len(URLS) + 1
    for r, url in ((r, URLS[r["page_id"]]) for r in rows if r["page_id"]):
        host, path, rule, verdict = plain(url)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), url
        assert r["verdict"] == verdict or (verdict is None and r["verdict"] in ("allow", "block"))


def labelled(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioustrnl") for _ in range(rng.randint(3, 9)))
    for _ in range(n):
        bad = rng.random() < 0.4
        if bad:
            yield f"http://{word()}-{word()}{rng.randint(10, 9999)}.example.com/{'/'.join(str(rng.randint(0, 10**6)) for _ in range(rng.randint(2, 5)))}?a={rng.randint(0, 999)}&b={word()}&c=1", True
        else:
            yield f"https://{word()}.example.org/{word()}/{word()}" + (".html" if rng.random() < 0.5 else f"?p={rng.randint(1, 9)}"), False


@pytest.fixture(scope="module")
def fitted(spark):
    train = spark.createDataFrame(list(labelled(1500, 1)), "url string, blocked boolean")
    return urls.fit(train)


def test_held_out_accuracy(spark, fitted):
    test = spark.createDataFrame(list(labelled(500, 2)), "url string, blocked boolean")
    rows = urls.judge(test, fitted, [], ["blocked"]).collect()
    right = sum((r["verdict"] == "block") == r["blocked"] for r in rows) / len(rows)
    assert right > 0.97


def test_trees_as_columns_equal_the_model(spark):
    df = spark.createDataFrame(list(labelled(400, 3)), "url string, blocked boolean")
    rows = urls.lexical(df).withColumns({"suffix_seen": F.lit(1.0), "suffix_blocked": F.lit(0.5), "label": F.col("blocked").cast("double")})
    vectors = VectorAssembler(inputCols=urls.FEATURES, outputCol="features").transform(rows).cache()
    fitted = GBTClassifier(maxIter=4, maxDepth=3, seed=1).fit(vectors)
    own = urls.Model(None, 0.5, [t._java_obj.rootNode() for t in fitted.trees], list(fitted.treeWeights)).score()
    out = fitted.transform(vectors).select(own.alias("own"), vector_to_array("rawPrediction")[1].alias("raw")).collect()
    assert all(r["own"] * 2 == pytest.approx(r["raw"] * 2) or r["own"] == pytest.approx(r["raw"]) for r in out)


def test_sample_bound_and_one_kind(spark):
    df = spark.createDataFrame([(f"http://h{i}.com/{i}", i % 2 == 0) for i in range(3000)], "url string, blocked boolean")
    assert urls.fit(df, sample=500).suffixes.count() <= 500
    only = urls.fit(df.filter("blocked"))
    assert urls.judge(df.limit(3), only, [], []).select("verdict").distinct().first()["verdict"] == "block"
    none = urls.fit(df.limit(0))
    assert urls.judge(df.limit(3), none, [], []).select("verdict").distinct().first()["verdict"] == "allow"
    assert urls.judge(df.limit(0), none, urls.RULES, ["url"]).count() == 0


def test_suffixes_count_all_labelled_rows(spark):
    rows = [(f"http://h{i}.s{i % 700}.com/{i}", i % 3 == 0) for i in range(2800)] + [("http://a.s1.com/x", True)] * 5 + [("http://b.s2.com", None)]
    model = urls.fit(spark.createDataFrame(rows, "url string, blocked boolean"), sample=100)
    want = {}
    for url, bad in rows:
        if bad is not None:
            n, b = want.get(url.split("/")[2].split(".", 1)[1], (0, 0))
            want[url.split("/")[2].split(".", 1)[1]] = (n + 1, b + bad)
    keys = spark.createDataFrame([(s,) for s in want], "s string").withColumn("suffix_key", F.xxhash64("s"))
    got = {r["s"]: (r["_seen"], r["_blocked"]) for r in keys.join(model.counts, "suffix_key").collect()}
    assert got == want and model.counts.count() == len(want)


def test_copies_do_not_empty_or_overfill_the_sample(spark):
    pairs = [(f"http://h{i}.com/{i}", i % 2 == 0) for i in range(40)]
    many = spark.createDataFrame(pairs * 100, "url string, blocked boolean")
    rows = urls.training(many, "url", "blocked", 100, 7).collect()
    assert sorted((r["url"], r["blocked"]) for r in rows) == sorted(pairs)
    assert urls.fit(many, sample=100).trees
    hot = spark.createDataFrame(pairs + [pairs[0]] * 500, "url string, blocked boolean")
    assert urls.training(hot, "url", "blocked", 30, 7).count() == 30

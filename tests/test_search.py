import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewise.operators import search as S
from ratewise.operators.textindex import dense_index, fit_tfidf, keyword_enrichment, load_index, postings, search


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    items, queries = rng.integers(-2, 3, (60, 5)).astype(float), rng.integers(-2, 3, (12, 5)).astype(float)
    frame = lambda a, key: spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(a)], f"{key} long, vec array<double>")
    return frame(queries, "query_id"), frame(items, "item_id"), queries @ items.T


def sparse(df, key):
    pairs = F.filter(F.transform("vec", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"] != 0)
    return df.select(key, pairs.alias("p")).select(key, F.col("p.i").alias("idx"), F.col("p.x").alias("w"))


def brute(scores, k, fill, skip=()):
    out = {}
    for q, row in enumerate(scores):
        order = sorted((i for i in range(len(row)) if (q, i) not in skip and (fill or row[i] > 0)), key=lambda i: (-row[i], i))
        out.update({(q, n): (i, row[i]) for n, i in enumerate(order[:k], 1)})
    return out


@pytest.mark.parametrize("kind", ["dense", "sparse"])
@pytest.mark.parametrize("fill", [True, False])
@pytest.mark.parametrize("broadcast", ["0", "67108864"])
def test_search_equals_full_scoring(spark, vectors, monkeypatch, kind, fill, broadcast):
    queries, items, scores = vectors
    if kind == "sparse":
        queries, items = sparse(queries, "query_id"), sparse(items, "item_id")
    spark.conf.set("spark.ratewise.broadcastBytes", broadcast)
    monkeypatch.setattr(S, "ITEM_BLOCK", 7)
    monkeypatch.setattr(S, "CELLS", 40)
    try:
        got = S.search_topk(queries, items, 4, kind, fill).collect()
    finally:
        spark.conf.unset("spark.ratewise.broadcastBytes")
    assert {(r["query_id"], r["rank"]): (r["item_id"], r["sim"]) for r in got} == brute(scores, 4, fill)


def test_excluded_pairs(spark, vectors):
    queries, items, scores = vectors
    skip = {(q, i) for q in range(12) for i in range(60) if (q * 7 + i) % 3 == 0}
    pairs = spark.createDataFrame(sorted(skip), "query_id long, item_id long")
    got = S.search_topk(queries, items, 5, "dense", exclude=pairs).collect()
    assert {(r["query_id"], r["rank"]): (r["item_id"], r["sim"]) for r in got} == brute(scores, 5, True, skip)


@pytest.mark.parametrize("fill", [True, False])
def test_equal_vectors_are_searched_once(spark, vectors, monkeypatch, fill):
    queries, items, _ = vectors
    items = items.unionByName(items.withColumn("item_id", 60 + 3 * F.col("item_id"))).unionByName(items.withColumn("item_id", 61 + 3 * F.col("item_id")))
    queries = queries.unionByName(queries.withColumn("query_id", 40 - F.col("query_id")))
    rows = lambda df: [r["vec"] for r in sorted(df.collect())]
    ids = lambda df, key: sorted(r[key] for r in df.collect())
    scores = np.array(rows(queries)) @ np.array(rows(items)).T
    sent, real = [], S._search_blocks
    monkeypatch.setattr(S, "_search_blocks", lambda q, i, *more: sent.append((q.count(), i.count())) or real(q, i, *more))
    monkeypatch.setattr(S, "QUERY_BLOCK", 3)
    got = S.search_topk(sparse(queries, "query_id"), sparse(items, "item_id"), 7, "sparse", fill).collect()
    q_ids, i_ids = ids(queries, "query_id"), ids(items, "item_id")
    want = {(q_ids[q], n): (i_ids[i], sim) for (q, n), (i, sim) in brute(scores, 7, fill).items()}
    assert {(r["query_id"], r["rank"]): (r["item_id"], r["sim"]) for r in got} == want
    assert sent and all(q <= 12 and i <= 60 for q, i in sent)


def test_a_block_of_items_is_sent_to_few_blocks_of_queries(spark, vectors, monkeypatch):
    """Items used to be copied once per QUERY_BLOCK queries."""
    queries, items, scores = vectors
    monkeypatch.setattr(S, "QUERY_BLOCK", 1)
    monkeypatch.setattr(S, "QUERIES_SENT", 12)
    monkeypatch.setattr(S, "ITEM_BLOCK", 2)
    cut = []
    monkeypatch.setattr(S, "hash_bucket", lambda seed, n, *c, real=S.hash_bucket: cut.append((seed, n)) or real(seed, n, *c))
    got = S.search_topk(queries, items, 4, "dense").collect()
    assert {(r["query_id"], r["rank"]): (r["item_id"], r["sim"]) for r in got} == brute(scores, 4, True)
    assert ("q", 1) in cut


def test_edges_of_k(vectors):
    queries, items, _ = vectors
    assert S.search_topk(queries, items, 0).count() == 0
    assert S.search_topk(queries, items, 1000).count() == 12 * 60
    with pytest.raises(ValueError):
        S.search_topk(queries, items, 1, "other")


TEXTS = ["red apple pie", "green apple", "red wine and red cheese", "", None, "apple apple cider"]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "item_id long, text string")


def test_tfidf_weights(items):
    index = fit_tfidf(items)
    idf = {r["term"]: r["idf"] for r in index.tables["vocabulary"].collect()}
    assert set(idf) == {"red", "apple"}
    assert idf["apple"] == pytest.approx(np.log(7 / 4) + 1)
    weights = {(r["item_id"], r["term"]): r["weight"] for r in postings(index).collect()}
    norm = np.hypot(idf["red"], idf["apple"])
    assert weights[0, "red"] == pytest.approx(idf["red"] / norm)
    assert weights[2, "red"] == 1.0 and weights[5, "apple"] == 1.0 and (3, "red") not in weights


def test_vocabulary_cut_and_unlimited(items):
    assert [r["term"] for r in fit_tfidf(items, max_features=1).tables["vocabulary"].collect()] == ["apple"]
    everything = fit_tfidf(items, max_features=0, min_df=1, ngram_max=2, stop_words=None)
    terms = {r["term"]: r["term_no"] for r in everything.tables["vocabulary"].collect()}
    assert "red apple" in terms and "and" in terms
    assert [t for t, _ in sorted(terms.items(), key=lambda x: x[1])] == sorted(terms)


def test_index_round_trip(spark, items, tmp_path):
    index = fit_tfidf(items)
    index.save(str(tmp_path / "i"))
    loaded = load_index(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "Red APPLE"), (2, "nothing known")], "query_id long, text string")
    want, got = (sorted(tuple(r) for r in search(x, asked, 3).collect()) for x in (index, loaded))
    assert want == got and {r[0] for r in got} == {1} and got[0][1] == 0
    assert len(search(loaded, asked, 10, fill=True).filter("query_id = 1").collect()) == 4


def test_dense_index(spark, items, tmp_path):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (2, [0.0, 1.0]), (9, [1.0, 0.0])], "item_id long, embedding array<float>")
    index = dense_index(items, vectors)
    index.save(str(tmp_path / "d"))
    asked = spark.createDataFrame([("q", [0.6, 0.8])], "query_id string, vec array<double>")
    assert [r["item_id"] for r in search(load_index(spark, str(tmp_path / "d")), asked, 5).orderBy("rank").collect()] == [2, 0]
    with pytest.raises(ValueError, match="query vectors"):
        search(index, asked.select("query_id", F.lit("x").alias("text")), 1)
    with pytest.raises(ValueError, match="no item has an embedding"):
        dense_index(items.filter("item_id > 100"), vectors)


def test_embed(items):
    from ratewise.operators.textindex import embed

    def lengths(batches):
        for b in batches:
            b["embedding"] = [[float(len(t)), 0.0] for t in b["text"]]
            yield b[["item_id", "embedding"]]

    got = {r["item_id"]: list(r["embedding"]) for r in embed(items, lengths).collect()}
    assert got[0] == [1.0, 0.0] and got[3] == [0.0, 0.0]


def test_enrichment(items):
    got = {r["item_id"]: r for r in keyword_enrichment(items).collect()}
    assert got[2]["tags"] == ["red"] and got[3]["tags"] == [] and got[4]["summary"] == ""
    assert got[0]["tags"] == ["red", "apple"]


def test_terms_are_counted_where_the_text_is(spark, tmp_path):
    """One shuffle, of texts: neither single terms nor (item, term) pairs are shuffled while the vocabulary is small."""
    rows = [(i, " ".join(f"word{(i * 7 + j * j) % 40}" for j in range(30))) for i in range(50)]
    index = fit_tfidf(spark.createDataFrame(rows, "item_id long, text string"))
    plan = index.tables["vectors"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    plain = {i: {w: text.split().count(w) for w in text.split()} for i, text in rows}
    idf = {r["term"]: (r["term_no"], r["idf"]) for r in index.tables["vocabulary"].collect()}
    for r in index.tables["vectors"].collect():
        want = {idf[w][0]: n * idf[w][1] for w, n in plain[r["item_id"]].items() if w in idf}
        norm = sum(x * x for x in want.values()) ** 0.5
        assert dict(zip(r["idx"], r["w"])) == pytest.approx({t: x / norm for t, x in want.items()})


def test_vocabulary_alone_makes_no_vectors(spark, tmp_path):
    from ratewise.catalog import texts as C

    spark.createDataFrame([(i, f"some words and word{i % 3}") for i in range(9)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert not C.doc_terms(spark, str(tmp_path)).meta.get("vectors_stored")
    assert C.doc_index(spark, str(tmp_path)).meta["vectors_stored"]
    assert {r["term"] for r in C.doc_terms(spark, str(tmp_path)).tables["vocabulary"].collect()} == {"words", "word0", "word1", "word2"}


@pytest.mark.parametrize("above", [-np.inf, 0.0])
def test_running_lists_sort_only_scores_that_can_enter(monkeypatch, above):
    """Most scores are compared with the last place once; ties keep the lower id."""
    from ratewise.operators import search as module

    rng = np.random.default_rng(3)
    scores = np.round(rng.normal(size=(4000, 30)), 2) + rng.choice([0.0, 2e-10], size=(4000, 30))
    sorted_ = []
    real = module.np.argsort
    monkeypatch.setattr(module.np, "argsort", lambda x, **more: sorted_.append(x.size) or real(x, **more))
    best = module._Best(30, 5, above)
    for at in range(0, 4000, 200):
        best.add(np.arange(at, at + 200), scores[at : at + 200])
    assert len(sorted_) <= 2
    got = best.rows(np.arange(30))
    for q in range(30):
        order = np.lexsort((np.arange(4000), -np.round(scores[:, q], 9)))[:5]
        mine = got[got["query_id"] == q]
        assert mine["item_id"].tolist() == order.tolist() and (mine["sim"].to_numpy() == scores[order, q]).all()


@pytest.mark.parametrize("bound", ["67108864", "0"])
def test_a_task_counts_the_terms_of_a_bounded_text(spark, items, monkeypatch, bound):
    """Tasks grow in number with the text, whether the vocabulary is broadcast or not."""
    from ratewise.operators import textindex

    want = sorted(map(tuple, postings(fit_tfidf(items, min_df=1)).select("item_id", "term", F.round("weight", 9)).collect()))
    monkeypatch.setattr(textindex, "TASK_CHARS", 4)
    n_chars = items.agg(F.sum(F.length("text"))).first()[0]
    spark.conf.set("spark.ratewise.broadcastBytes", bound)
    try:
        index = fit_tfidf(items, min_df=1)
        assert index.tables["vectors"].rdd.getNumPartitions() == -(-n_chars // 4) > int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert sorted(map(tuple, postings(index).select("item_id", "term", F.round("weight", 9)).collect())) == want
    finally:
        spark.conf.unset("spark.ratewise.broadcastBytes")

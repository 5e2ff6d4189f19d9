"""Searches in parts: the same rows as by joins, and no pairs shuffled."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.operators import features, graph, resolve, retrieval


def shuffled(spark, run):
    """Result of run and the number of rows that it shuffled."""
    sc = spark.sparkContext

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    return run(), total() - before


def frame(spark, n, seed=3):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    return spark.createDataFrame([(f"d{i % (n - 5)}", " ".join(["all", *rnd.choices(words, weights=[1 / (j + 1) for j in range(40)], k=rnd.randrange(0, 20))])) for i in range(n)] + [("none", ""), ("d1", "all w1"), ("d1", "all w1")], "id string, text string")


@pytest.mark.parametrize("block", [50, 2_000_000])
def test_search_equals_plain_scoring(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval.blocks, "BLOCK", block)
    texts = frame(spark, 150)
    queries = spark.createDataFrame([(q, f"all w{q} w{q % 7} w{q % 3} w{q % 3}" + " unseen" * (q % 2)) for q in range(40)] + [(99, "unseen"), (98, None)], "query_id long, text string")
    terms = retrieval.query_terms(queries)
    index, idf = retrieval.bm25_index(texts.distinct(), "id")
    plain = [(r.query_id, r["rank"], r.id, round(r.score, 8)) for r in retrieval.top_k(retrieval.bm25(terms, index, idf, "id"), 4, "id").collect()]
    got = [(r.query_id, r["rank"], r.id, round(r.score, 8)) for r in retrieval.search(terms, texts, 4, "id").collect()]
    assert sorted(got) == sorted(plain) and len(got) == 160
    assert not retrieval.search(terms.filter("query_id >= 98"), texts, 4, "id").collect() and not retrieval.search(terms.limit(0), texts, 4, "id").collect()


def test_search_shuffles_no_pairs(spark):
    """Each of 200 queries shares a term with each of 600 documents."""
    texts, queries = frame(spark, 600), spark.range(200).select(F.col("id").alias("query_id"), F.concat(F.lit("all w"), F.col("id") % 40).alias("text"))
    _, n = shuffled(spark, lambda: retrieval.search(retrieval.query_terms(queries), texts, 3, "id").collect())
    assert n < 200 * 600 / 10


@pytest.mark.parametrize("block", [60, 2_000_000])
def test_similar_documents_shuffle_no_pairs(spark, monkeypatch, block):
    """All 120 documents share their rarest term with 29 others."""
    monkeypatch.setattr(features.blocks, "BLOCK", block)
    rnd = random.Random(1)
    rows = [(d, t, rnd.random() + 0.01) for d in range(120) for t in {f"g{d % 4}", *rnd.choices([f"w{i}" for i in range(12)], k=6)}]
    size = {d: sum(w * w for e, _, w in rows if e == d) ** 0.5 for d in range(120)}
    vec = {d: {t: w / size[d] for e, t, w in rows if e == d} for d in range(120)}
    want = {(a, b): sum(x * vec[b].get(t, 0) for t, x in vec[a].items()) for a in vec for b in vec if a < b}
    want = {k: round(x, 8) for k, x in want.items() if x >= 0.6}
    w = spark.createDataFrame([(d, t, x / size[d]) for d, t, x in rows], "doc_id long, term string, weight double").coalesce(2)
    got, n = shuffled(spark, lambda: {(r.doc_a, r.doc_b): round(r.cosine, 8) for r in features.similar_documents(w, 0.6).collect()})
    assert got == want and len(want) > 100 and n < 1500
    assert not features.similar_documents(w.limit(0)).collect()


def test_gram_counts(spark):
    """Counted in arrays as by expressions, also with signs beyond 16 bits."""
    texts = ["a", "", "  Ab cde  ab", "x\U0001f600y\U0001f600z q", "\t", "Number Lines"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", resolve.padded_words(F.col("text")).alias("p"), resolve.char_ngrams(F.col("text")).alias("g"))
    got = sorted(d.collect(), key=lambda r: r.i)
    rows, codes, n = resolve.gram_counts([r.p for r in got])
    for r in got:
        assert sorted(n[rows == r.i]) == sorted(Counter(r.g).values())
    assert len(set(codes)) == len({g for r in got for g in r.g})


def test_resolve_shuffles_no_ngrams(spark):
    ents = spark.createDataFrame([(f"k{i}", f"common register {i}", "the same words for all") for i in range(300)], "key string, name string, description string").coalesce(2)
    names = spark.createDataFrame([(f"common registers {i}",) for i in range(40)], "name string")
    got, n = shuffled(spark, lambda: resolve.resolve(names, ents, 0.3).collect())
    assert len(got) == 40 and n < 3000


def test_related_resolves_edges_once(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "a")], "src string, dst string")
    got = graph.related(edges, spark.createDataFrame([("a",), ("d",)], "key string"))
    assert {tuple(r) for r in got.collect()} == {("a", "a", 1), ("a", "b", 1), ("a", "c", 2), ("d", "c", 1), ("d", "b", 2), ("d", "d", 2)} - {("d", "d", 2), ("a", "a", 1)}
    assert "src" not in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("block", [40, 2_000_000])
def test_self_retrieval_shuffles_no_pairs(spark, monkeypatch, block):
    """All 90 documents share a term; keys are words, and some documents are alike."""
    monkeypatch.setattr(retrieval.blocks, "BLOCK", block)
    rnd = random.Random(5)
    docs = {f"d{i}": {t: rnd.random() for t in {"all", *rnd.choices([f"w{j}" for j in range(9)], k=rnd.randrange(1, 7))}} for i in range(89)}
    docs["d89"] = dict(docs["d3"])
    rows = [(d, t, x) for d, v in docs.items() for t, x in v.items()]
    w = spark.createDataFrame(rows, "doc_id string, term string, weight double").coalesce(2)
    index = w.withColumnRenamed("weight", "part")
    want = {}
    for d, v in docs.items():
        top = sorted(v, key=lambda t: (-round(v[t], 9), t))[:8]
        sets = [[top[i - 1] for i in c] for c in retrieval.combinations(len(top))] if len(top) >= 3 else []
        score = lambda e, s: round(sum(docs[e].get(t, 0) for t in s), 9)
        hits = [sum(score(e, s) > score(d, s) or score(e, s) == score(d, s) and e < d for e in docs if e != d and set(s) & set(docs[e])) < 5 for s in sets]
        want[d] = round(sum(hits) / len(hits), 9) if hits else 0.0
    got, n = shuffled(spark, lambda: {r.doc_id: round(r.self_retrieval, 9) for r in retrieval.self_retrieval(w, index).collect()})
    assert got == want and len(set(want.values())) > 3 and n < 5000


@pytest.mark.parametrize("block", [40, 2_000_000])
def test_self_retrieval_of_texts_shuffles_no_postings(spark, monkeypatch, block):
    """As from the index, with the entropy of all weights; documents of one text stand in several rows."""
    monkeypatch.setattr(retrieval.blocks, "BLOCK", block)
    texts = features.blocks.by_key(frame(spark, 150).select(F.col("id").alias("doc_id"), "text").distinct(), "doc_id").cache()
    post = features.postings(texts)
    weights = features.weigh(post, features.vocabulary(post, 150)).cache()
    index, _ = retrieval.bm25_index(texts)
    want = {r.doc_id: round(r.self_retrieval, 9) for r in retrieval.self_retrieval(weights, index).collect()}
    top = retrieval.own_terms(weights)
    got, n = shuffled(spark, lambda: {r.doc_id: round(r.self_retrieval, 9) for r in retrieval.self_retrieval_of(top, texts).collect()})
    postings = retrieval.postings(texts, "doc_id", retrieval.TOKEN1, ()).count()
    assert got == want and len(set(got.values())) > 3
    assert n < postings + top.count()  # by joins: postings by term and again by document
    ent = {r.doc_id: round(r.entropy, 9) for r in features.entropy(weights).collect()}
    assert {r.q: round(r.entropy, 9) for r in top.collect()} == ent
    assert not retrieval.self_retrieval_of(retrieval.own_terms(weights.limit(0)), texts).collect()

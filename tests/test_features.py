import math
import random
from collections import Counter
from itertools import combinations

import pytest

from lectern.operators import features, retrieval
from lectern.operators.features import postings, vocabulary, weigh

WORDS = [f"w{c}" for c in "abcdefghijklmnopqrstuv"]


def corpus(n=24, seed=1):
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choice(WORDS[: 8 + i % 14]) for _ in range(12 + i)) for i in range(n)]
    texts[7] = texts[3]
    return texts


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def bm25(q, docs):
    tok = [Counter(d.split()) for d in docs]
    dl = [sum(t.values()) for t in tok]
    avg, n, out = sum(dl) / len(dl), len(docs), []
    for t, length in zip(tok, dl):
        s = 0
        for w in q:
            df = sum(w in x for x in tok)
            if df:
                idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
                s += idf * (t[w] * 2.5 / (t[w] + 1.5 * (0.25 + 0.75 * length / avg)) + 1)
        out.append(s)
    return out


def test_bm25(spark):
    texts = corpus()
    q = ["wa", "wq", "wq", "none"]
    index, idf = retrieval.bm25_index(frame(spark, texts))
    queries = retrieval.query_terms(spark.createDataFrame([(1, " ".join(q))], "query_id long, text string"))
    got = {r.doc_id: r.score for r in retrieval.bm25(queries, index, idf).collect()}
    want = bm25(q, texts)
    assert all(got[i] == pytest.approx(want[i]) for i in got)
    assert len({round(want[i], 9) for i in range(len(texts)) if i not in got}) <= 1


def test_self_retrieval_is_brute_force(spark):
    texts = corpus()
    post = postings(frame(spark, texts), stop=())
    w = weigh(post, vocabulary(post, len(texts)))
    index, _ = retrieval.bm25_index(frame(spark, texts))
    got = {r.doc_id: r.self_retrieval for r in retrieval.self_retrieval(w, index).collect()}
    top = {}
    for r in w.collect():
        top.setdefault(r.doc_id, []).append((-round(r.weight, 9), r.term))
    for i, rows in top.items():
        terms = [t for _, t in sorted(rows)[:8]]
        combos = list(combinations(terms, 3))
        if len(combos) > 20:
            combos = combos[:: len(combos) // 20][:20]
        hits = sum(i in sorted(range(len(texts)), key=lambda j: (-round(s[j], 9), j))[:5] for s in (bm25(c, texts) for c in combos))
        assert got[i] == pytest.approx(hits / len(combos) if combos else 0.0)


def test_similar_documents_are_exact(spark):
    texts = corpus()
    post = postings(frame(spark, texts), stop=())
    w = weigh(post, vocabulary(post, len(texts)))
    vec = {}
    for r in w.collect():
        vec.setdefault(r.doc_id, {})[r.term] = r.weight
    want = {(a, b) for a, b in combinations(sorted(vec), 2) if sum(x * vec[b].get(t, 0) for t, x in vec[a].items()) >= 0.6}
    assert {(r.doc_a, r.doc_b) for r in features.similar_documents(w, 0.6).collect()} == want and (3, 7) in want


def test_entropy_bounds(spark):
    post = postings(frame(spark, ["wa wb wc wd", "wa wa", "we"]), stop=())
    got = {r.doc_id: r.entropy for r in features.entropy(weigh(post, vocabulary(post, 3))).collect()}
    assert 0.9 < got[0] <= 1 and got[1] == 0 and got[2] == 0


def test_measures(spark):
    ranks = spark.createDataFrame([(1, 5, 1), (1, 9, 2), (2, 4, 1), (2, 7, 3)], "query_id int, d int, rank int")
    gold = spark.createDataFrame([(1, 9), (2, 1)], "query_id int, d int")
    r = retrieval.measures(ranks, gold, "d").collect()[0]
    assert (r.recall_at_k, r.mrr, r.query_count) == (0.5, 0.25, 2) and r.ndcg_at_k == pytest.approx(0.5 / math.log2(3))


def test_overlap(spark):
    rows = [(1, 0, "a b", True, 2), (1, 1, "?", False, 0), (1, 2, "c d e", True, 3), (1, 3, "f", True, 1)]
    d = spark.createDataFrame(rows, "key int, pos int, text string, has_term boolean, n_words int")
    assert [r.pos for r in features.overlap_sentences(d, budget=5).orderBy("pos").collect()] == [0, 2]

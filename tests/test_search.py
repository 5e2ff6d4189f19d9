"""The bounded top-k against plain scoring."""

import random

import pytest

from lectern.operators import retrieval


@pytest.mark.parametrize("seed", [1, 2])
def test_bounded_search_equals_plain_scoring(spark, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    texts = spark.createDataFrame([(i, " ".join(rnd.choices(words, weights=[1 / (j + 1) for j in range(30)], k=rnd.randrange(1, 25)))) for i in range(120)], "doc_id long, text string")
    queries = spark.createDataFrame([(q, " ".join(rnd.choices(words, k=rnd.randrange(1, 6))) + (" unseen" if q % 3 == 0 else "")) for q in range(25)] + [(99, "unseen"), (98, None)], "query_id long, text string")
    index, idf = retrieval.bm25_index(texts)
    terms = retrieval.query_terms(queries)
    plain = {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 8)) for r in retrieval.top_k(retrieval.bm25(terms, index, idf), 4).collect()}
    got = {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 8)) for r in retrieval.bm25_top(terms, index, idf, 4).collect()}
    assert got == plain and len(got) > 50

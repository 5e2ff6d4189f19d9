import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lectern.llm import subjects, topics


def plain_step(rows, beta, alpha, rounds):
    """The E step word by word, in double precision."""
    v, k = beta.shape
    gammas, total = [], np.zeros((k, v))
    for row in rows:
        g = np.full(k, alpha + len(row) / k)
        for i in range(rounds if len(row) else 0):
            theta = np.exp(topics._digamma(g))
            shares = [beta[t] * theta / (beta[t] * theta).sum() for t in row]
            g = alpha + sum(shares)
            for t, s in zip(row, shares if i == rounds - 1 else []):
                total[:, t] += s
        gammas.append(g if len(row) else np.full(k, alpha))
    return np.array(gammas), total


def test_step_in_blocks_is_the_plain_one(monkeypatch):
    rnd = np.random.default_rng(3)
    beta = topics.expected_beta(rnd.gamma(1.0, 1.0, (5, 40)) + 0.05)
    lengths = np.array([0, 1, 9, 17, 0, 18, 19, 33, 2, 200, 9, 9, 64, 65, 0])
    rows = [rnd.integers(0, 40, n) for n in lengths]
    gamma, total = plain_step(rows, beta.astype(float), 0.1, 3)
    for piece in (1, 30, 1 << 15):
        monkeypatch.setattr(topics, "PIECE", piece)
        got = np.zeros((5, 40))
        assert np.allclose(topics.expectation(np.concatenate(rows), lengths, beta, 0.1, 3, got), gamma, rtol=1e-4)
        assert np.allclose(got, total, rtol=1e-4, atol=1e-6) and np.isclose(got.sum(), lengths.sum())
    assert np.allclose(topics.expectation(np.zeros(0, np.uint16), np.zeros(2, np.int64), beta, 0.1, 3), 0.1)


def test_blocks_are_filled_up_little():
    n = np.arange(20_000)
    w = topics._widths(n)
    assert (w >= n).all() and (w[:17] == n[:17]).all() and (w[1:] <= n[1:] * 1.13).all() and len(np.unique(w)) < 120


def test_ids_come_back(spark):
    texts = spark.createDataFrame([(1, "Apple apple pear"), (2, "!?"), (None, "pear plum apple, fig"), (4, "nothing known")], "doc_id long, text string").coalesce(1)
    vocab = topics.vocabulary(texts, most_share=1.0, least=1)
    vocab["used"] = vocab["word"].isin(["apple", "pear", "plum"])
    vocab = vocab.sort_values("used", ascending=False, kind="stable").reset_index(drop=True)
    got = topics.encode(texts, vocab, "doc_id").toArrow().combine_chunks().to_batches()[0]
    for a, b in ((0, 4), (1, 3), (2, 4), (1, 2), (4, 4)):
        flat, lengths = topics.laid_out(got.slice(a, b - a), 3)
        words = [["apple", "apple", "pear"], [], ["pear", "plum", "apple"], []][a:b]
        assert list(lengths) == [len(w) for w in words] and list(vocab["word"][flat]) == sum(words, [])
    assert got.column("doc_id").to_pylist() == [1, 2, None, 4]
    wide = np.array([70_000, 3], dtype=np.int32)
    flat, _ = topics.laid_out(pa.RecordBatch.from_pydict({"ids": [wide.tobytes()]}), 70_001)
    assert list(flat) == list(wide)


def test_counts_leave_a_task_in_parts(spark, monkeypatch):
    rows = ["the cat sat on the mat", "cat and Mat and dog", "", "a dog, a cat", "mat"] * 20
    want = Counter(w for r in rows for w in {x for x in re.findall("[a-z]+", r.lower()) if len(x) >= 3})
    for held in (1, 300_000):
        monkeypatch.setattr(topics, "HELD", held)
        got = topics.vocabulary(spark.createDataFrame([(r,) for r in rows], "text string").repartition(3), most_share=1.0)
        assert dict(zip(got["word"], got["df"])) == dict(want)


def test_a_wording_is_split_once(spark):
    said = spark.createDataFrame([("Law & Tax",), ("law, law, tax",), (None,), ("",), ("stem",), ("zzz",)], "domain string")
    named = said.select(subjects.named_subjects(F.col("domain"), ["finance", "law", "science"]).alias("s"))
    assert named._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert [r.s for r in named.collect()] == [["finance", "law"], ["law"], [], [], ["science"], []]

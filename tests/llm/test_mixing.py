import pytest

from lectern.llm import mixing

TARGETS = "source string, target_share double, max_repeats int"


def tokens(spark):
    rows = [(i, "big" if i % 4 else "mid", 50 + i % 90) for i in range(4000)] + [(9000 + i, "small", 40) for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


def test_shares_are_met(spark):
    tok = tokens(spark)
    planned = mixing.plan(tok, spark.createDataFrame([("big", 0.5, 1), ("mid", 0.4, 2), ("small", 0.05, 3), ("none", 0.05, 4)], TARGETS))
    chosen = mixing.choose(tok, planned)
    got = {r.source: r for r in mixing.shares(chosen, planned).collect()}
    assert got["none"].tokens == 0 and got["small"].most_repeats == 3 and got["small"].n_documents == 30
    assert sum(r.actual_share for r in got.values()) == pytest.approx(1)
    for s in ("big", "mid", "small"):
        assert got[s].actual_share == pytest.approx(got[s].planned_share, abs=0.003)
        assert got[s].most_repeats <= got[s].max_repeats
    assert chosen.count() == chosen.select("doc_id").distinct().count()


def test_cap_and_total(spark):
    tok = tokens(spark)
    planned = mixing.plan(tok, spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], TARGETS), total=100_000)
    got = {r.source: r for r in mixing.shares(mixing.choose(tok, planned), planned).collect()}
    assert got["small"].tokens == 2 * 30 * 40 and got["big"].tokens == pytest.approx(50_000, abs=150)


def test_longer_documents_are_likelier(spark):
    tok = spark.createDataFrame([(i, "a", 10 if i % 2 else 1000) for i in range(4000)] + [(5000, "b", 100_000)], "doc_id long, source string, tokens long")
    planned = mixing.plan(tok, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS))
    n = {r.tokens: r["count"] for r in mixing.choose(tok, planned).filter("source = 'a'").groupBy("tokens").count().collect()}
    assert n[1000] > 4 * n.get(10, 0)


def test_documents(spark):
    rows = [(1, " Forum", "Some words here.", 5), (1, " Forum", "Some words here.", 5), (2, "wiki export", "More words are there.", 5), (3, "forum", None, 5), (4, None, "x y", 5), (5, "FORUM", "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, tokens long")
    got = {r.doc_id: (r.source, r.tokens) for r in mixing.count_tokens(df).collect()}
    assert got == {1: ("forum", 4), 2: ("wiki_export", 5), 4: ("", 2)}
    empty = mixing.count_tokens(df.limit(0))
    planned = mixing.plan(empty, spark.createDataFrame([("a", 1.0, 1)], TARGETS))
    assert mixing.choose(empty, planned).count() == 0 and mixing.shares(mixing.choose(empty, planned), planned).collect()[0].tokens == 0

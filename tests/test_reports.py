"""Issue rows, built queries, padded rankings and self-retrieval against brute force."""

import random

from lectern.operators import criteria, issues, parsed, retrieval

DOCS = "doc_id long, file_path string, file_size_bytes long, page_count int, title string"


def corpus(spark):
    rows = [(1, 0, 1, "Overview", "x"), (1, 1, 3, "Kettle repairs", "x"), (1, 2, 0, "As mentioned above, see section 4.", "x"), (1, 3, 0, "NATO met NATO.", "x"), (1, 4, 0, "word " * 301, "x"), (2, 0, 0, None, "x"), (2, 1, 0, " ", "x")]
    paras = parsed.paragraphs(spark.createDataFrame(rows + rows[:2], "doc_id long, para_index int, heading_level int, text string, style string"))
    docs = parsed.documents(spark.createDataFrame([(1, "a/kettle-guide.md", 100, 0, None), (2, "a/v2.md", 60 * 1024 * 1024, None, "t"), (3, "b/9.txt", None, None, None)], DOCS))
    return docs, paras


def test_issues_agree_with_the_criteria(spark):
    docs, paras = corpus(spark)
    counts = criteria.document_counts(docs, paras)
    got = issues.issues(counts, paras)
    n = {(r.doc_id, r.category, r.severity): r["count"] for r in got.groupBy("doc_id", "category", "severity").count().collect()}
    want = {}
    for r in criteria.criteria(counts).collect():
        for s in issues.SEVERITIES:
            if r[f"n_{s}"]:
                want[r.doc_id, r.category, s] = r[f"n_{s}"]
    assert n == want
    rows = {(r.kind, r.place, r.detail) for r in got.filter("doc_id = 1").collect()}
    assert {("jump", 1, "H1 to H3"), ("vague", 0, "Overview"), ("long", 4, "301 words"), ("acronym", None, "NATO x 2")} <= rows
    assert ("too_large", None) in {(r.kind, r.place) for r in got.filter("doc_id = 2").collect()}


def test_first_issues_and_files_to_fix(spark):
    docs, paras = corpus(spark)
    counts = criteria.document_counts(docs, paras)
    found = issues.issues(counts, paras)
    first = issues.first_issues(found, 1)
    assert first.groupBy("doc_id", "category").count().filter("count > 1").count() == 0
    cards = criteria.scorecards(criteria.criteria(counts))
    assert {r.doc_id for r in issues.to_fix(found, cards, 0).collect()} == {1, 2, 3}
    assert issues.issues(counts.limit(0), paras.limit(0)).count() == 0


def test_built_queries(spark):
    docs, paras = corpus(spark)
    weights = spark.createDataFrame([(1, "kettle", 0.9), (1, "with", 0.8), (1, "lid", 0.5), (1, "pot", 0.5)], "doc_id long, term string, weight double")
    got = {r.query_id: r.text for r in retrieval.benchmark_queries(docs, paras, weights).collect()}
    assert got == {1: "overview kettle repairs lid pot", 2: "v2.md", 3: "9.txt"}
    one = {r.query_id: r.text for r in retrieval.benchmark_queries(docs, paras, weights, 2).collect()}
    assert one[1] == "overview kettle"


def test_padding(spark):
    ranked = spark.createDataFrame([("q", "c", 1)], "query_id string, id string, rank int")
    items = spark.createDataFrame([(x,) for x in "fedcba"], "id string")
    queries = spark.createDataFrame([("q",), ("r",)], "query_id string")
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.padded(ranked, items, queries, 3, "id").collect()}
    assert got == {("q", 1): "c", ("q", 2): "a", ("q", 3): "b", ("r", 1): "a", ("r", 2): "b", ("r", 3): "c"}


def test_self_retrieval_by_brute_force(spark):
    rnd = random.Random(5)
    terms = [f"t{i:02}" for i in range(12)]
    weights, parts = {}, {}
    for d in range(25):
        own = rnd.sample(terms, rnd.randrange(1, 11))
        weights[d] = {t: rnd.choice([0.1, 0.2, 0.3, 0.4]) for t in own}
        parts[d] = {t: rnd.choice([0.5, 1.0, 1.5]) for t in own}
    w = spark.createDataFrame([(d, t, x) for d, own in weights.items() for t, x in own.items()], "doc_id long, term string, weight double")
    p = spark.createDataFrame([(d, t, x) for d, own in parts.items() for t, x in own.items()], "doc_id long, term string, part double")
    got = {r.doc_id: r.self_retrieval for r in retrieval.self_retrieval(w, p, k=3).collect()}
    for d, own in weights.items():
        top = [t for t, _ in sorted(own.items(), key=lambda x: (-x[1], x[0]))[:8]]
        hits = asked = 0
        for c in retrieval.combinations(len(top)):
            score = {o: sum(parts[o].get(top[i - 1], 0.0) for i in c) for o in parts}
            better = sum(1 for o in parts if o != d and any(top[i - 1] in parts[o] for i in c) and (score[o] > score[d] or score[o] == score[d] and o < d))
            asked += 1
            hits += better < 3
        assert abs(got[d] - (hits / asked if asked else 0.0)) < 1e-9


def test_paths_of_any_level(spark):
    rows = [(1, i, lv, f"h{i}", "x") for i, lv in enumerate((2, 4, 12, 12, 3, 1, 6))] + [(1, 9, 0, "body", "x")]
    paras = parsed.paragraphs(spark.createDataFrame(rows, "doc_id long, para_index int, heading_level int, text string, style string"))
    got = {r["index"]: r.path for r in parsed.heading_paths(paras).collect()}
    path, want = [], {}
    for _, i, lv, t, _ in rows[:-1]:
        path = [*path[: lv - 1], t]
        want[i] = path
    assert got == want
    parents = {r["index"]: r.parent_index for r in parsed.heading_tree(paras).collect()}
    assert parents == {0: None, 1: 0, 2: 1, 3: 1, 4: 0, 5: None, 6: 5}
    assert parsed.heading_paths(paras.filter("level = 0")).count() == 0 and parsed.heading_tree(paras.filter("level = 0")).count() == 0

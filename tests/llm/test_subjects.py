import random

from lectern.llm import subjects, topics

SUBJECTS = ["finance", "medicine", "sport"]
NOUNS = {
    "finance": "loan bank ledger invoice tax audit payroll credit rent share fund budget".split(),
    "medicine": "nurse ward dose fever scan vein pill burn wound clinic vaccine pulse".split(),
    "sport": "match goal racket team swim lap relay coach league bat hoop whistle".split(),
}
FRAME = ["the {a} and the {b} review every {c} before noon", "staff keep the {a} near the {b} with a {c}", "people compare {a} to {b} when the {c} is closed"]


def corpus(spark, n=40):
    rnd, rows, truth = random.Random(4), [], {}
    for d in range(n):
        own = [SUBJECTS[d % 3]] if d % 5 else [SUBJECTS[d % 3], SUBJECTS[(d + 1) % 3]]
        truth[d] = set(own)
        for p in range(8):
            s = own[p * len(own) // 8]
            sents = [rnd.choice(FRAME).format(**dict(zip("abc", rnd.sample(NOUNS[s], 3)))) for _ in range(4)]
            rows.append((d, p, 0, ". ".join(sents), "c"))
        rows.append((d, 8, 0, None, "c"))
    rows += [(900, p, 0, "xkz qwv zzt bnm ktr " * 20, "c") for p in range(4)]
    return spark.createDataFrame(rows + rows[:10], "doc_id long, para_index int, heading_level int, text string, subject string"), truth


def test_subjects(spark):
    df, truth = corpus(spark)
    texts = df.filter("text is not null")
    vocab = topics.vocabulary(texts, most_share=0.5)
    enc = topics.encode(texts, vocab, "doc_id", "para_index", "heading_level")
    domains = {"finance": "Banking", "medicine": " clinical ", "sport": "sports"}
    said = spark.createDataFrame([(d, domains[sorted(s)[0]] if len(s) == 1 else "general") for d, s in truth.items() if d % 2] + [(3, "misc"), (None, "tax"), (5, None)], "doc_id long, domain string")
    rated = spark.createDataFrame([(0, "finance"), (0, "nonsense")], "doc_id long, subject string")
    model = subjects.fit(enc, vocab, subjects.evidence(said, rated, SUBJECTS), SUBJECTS)
    got = {}
    for r in subjects.file_subjects(enc, model).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert 900 not in got
    assert sum(got.get(d) == s for d, s in truth.items()) >= 0.95 * len(truth)


def test_nothing(spark):
    df, _ = corpus(spark, 3)
    texts = df.filter("text is not null").limit(0)
    vocab = topics.vocabulary(texts)
    enc = topics.encode(texts, vocab, "doc_id", "para_index", "heading_level")
    none = spark.createDataFrame([], "doc_id long, subject string")
    assert subjects.file_subjects(enc, subjects.fit(enc, vocab, none, SUBJECTS)).count() == 0


def test_topics_and_content_types_speak(spark):
    rows = [(i, "banking", [" Credit  Risk", "notes"], "Statement") for i in range(5)] + [(10 + i, "clinic", ["notes"], "chart") for i in range(5)]
    rows += [(20, None, ["credit risk"], None), (21, "unknown", None, "CHART"), (22, "unknown", ["notes"], "other"), (23, "sports", ["credit risk"], None), (24, None, None, None), (None, "tax", None, None)]
    said = spark.createDataFrame(rows, "doc_id long, domain string, topics array<string>, content_type string")
    rated = spark.createDataFrame([(30, "sport")], "doc_id long, subject string")
    got = {(r.doc_id, r.subject) for r in subjects.evidence(said, rated, SUBJECTS).collect() if r.doc_id >= 20}
    assert got == {(20, "finance"), (21, "medicine"), (23, "sport"), (30, "sport")}


def test_own_analysis_fills_in(spark):
    df, truth = corpus(spark)
    silent = spark.createDataFrame([(700, 0, 0, "zum der von dem", "c")], df.schema)
    texts = df.unionByName(silent).filter("text is not null")
    vocab = topics.vocabulary(texts, most_share=0.5)
    enc = topics.encode(texts, vocab, "doc_id", "para_index", "heading_level")
    named = spark.createDataFrame([(d, sorted(s)[0]) for d, s in truth.items() if d % 2 and len(s) == 1] + [(700, "sport")], "doc_id long, subject string")
    got = {}
    for r in subjects.file_subjects(enc, subjects.fit(enc, vocab, named, SUBJECTS), named).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert got.get(700) == {"sport"} and sum(got.get(d) == s for d, s in truth.items()) >= 0.95 * len(truth)

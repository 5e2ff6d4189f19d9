import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.operators import assist, report
from lectern.operators.resolve import char_ngrams, resolve


def grams(text):
    out = []
    for w in text.lower().split():
        p = f" {w} "
        for n in (2, 3, 4):
            if len(p) <= n:
                out.append(p)
                break
            out += [p[i : i + n] for i in range(len(p) - n + 1)]
    return out


def test_ngrams(spark):
    d = spark.createDataFrame([("a",), ("ab cde",), ("Number Lines",)], "t string")
    for r in d.withColumn("g", char_ngrams(F.col("t"))).collect():
        assert Counter(r.g) == Counter(grams(r.t))


def test_resolve_against_brute_force(spark):
    ents = [("k1", "number line", "a line of numbers"), ("k2", "water tank", None), ("k3", "number lines", "lines"), ("k4", "care plan", "plan of care")]
    names = ["Number Lines", "water tanks", "zzz qqq", "care plans"]
    docs = {k: Counter(grams(f"{n} {d}" if d else n)) for k, n, d in ents}
    df = Counter(g for c in docs.values() for g in c)
    idf = {g: math.log((1 + len(docs)) / (1 + x)) + 1 for g, x in df.items()}

    def unit(c):
        v = {g: n * idf[g] for g, n in c.items() if g in idf}
        s = math.sqrt(sum(x * x for x in v.values())) or 1
        return {g: x / s for g, x in v.items()}

    want = {}
    for n in names:
        q = unit(Counter(grams(n)))
        best = max(((sum(x * unit(c).get(g, 0) for g, x in q.items()), k) for k, c in docs.items()), key=lambda x: (x[0], x[1]))
        if best[0] >= 0.4:
            want[n] = (best[1], pytest.approx(best[0]))
    got = resolve(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(ents, "key string, name string, description string"))
    assert {r.name: (r.key, r.cosine) for r in got.collect()} == want and "water tanks" in want


def test_reports_and_fixes(spark):
    docs = spark.createDataFrame([(1, "a.md"), (2, "b.md")], "doc_id long, filename string")
    cards = spark.createDataFrame([(1, 90.0, "PASS", 0, 1), (2, 40.0, "HOLD_FOR_REVIEW", 1, 0)], "doc_id long, overall_score double, gate_decision string, n_critical int, n_warning int")
    text = report.markdown_report(docs, cards)
    assert "Mean score: 65.0" in text and text.index("| b.md |") < text.index("| a.md |")
    p = spark.createDataFrame([(1, 0, 1, "Overview", 1), (1, 1, 0, "An ABC is here. ABC again.", 6), (1, 2, 0, "ABC", 1)], "doc_id long, index int, level int, text string, n_words int")
    fixed = assist.define_acronyms(p, spark.createDataFrame([(1, "ABC", "Always Be Careful"), (1, "XYZ", "UNKNOWN")], "doc_id long, acronym string, meaning string"))
    assert [r.text for r in fixed.orderBy("index").collect()] == ["Overview", "An ABC (Always Be Careful) is here. ABC again.", "ABC"]
    assert "An ABC is here" in assist.heading_prompts(p, F.col("text") == "Overview").collect()[0].prompt
    fix = spark.createDataFrame([(1, 1, "One.\n\nTwo.")], "doc_id long, index int, reply string")
    assert [r.text for r in assist.apply_fixes(p.withColumn("style", F.lit("")), fix).orderBy("index", "part").collect()] == ["Overview", "One.", "Two.", "ABC"]

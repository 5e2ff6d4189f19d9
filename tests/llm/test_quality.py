import pytest

from lectern.llm import quality

SCHEMA = "doc_id long, para_index int, heading_level int, text string, word_count string"


def kinds(spark, docs):
    rows = [(i, n, 0, t, "clash") for i, texts in docs.items() for n, t in enumerate(texts)]
    return {r.doc_id: r for r in quality.file_statistics(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_kinds(spark):
    got = kinds(spark, {
        1: ["The team should keep the notes. They do it each day.", "We have 3 cats, and they are old."],
        2: ["Some of this is short.", "- Red boxes", "- Blue boxes (3)\n- Green lids", "* 41 gloves", "* Old lamps from Porto"],
        3: ["| a | 3 | 4 |\n| b | 5 | 6 |", "cash\t14/02\tyes", "1.5  2.25  300.75  12.1"],
        4: ["null null null null null null null null", "xkrtz bnmpl qwrtp zzkkl mnbvc", "4f 3a 00 11 9c 8d 7e 4f 3a 00"],
        5: ["* We keep the red boxes at home\n* They are old and good\n* You can see the lids", None, "  "],
        6: ["The long sentence that was wrapped at\nthe margin goes on and\non here until it is done. Then another\none."],
    })
    assert {i: r.text_kind for i, r in got.items()} == {1: "prose", 2: "list", 3: "table", 4: "junk", 5: "prose", 6: "prose"}
    assert got[6].lines == 1


def test_numbers(spark):
    r = kinds(spark, {1: ["The cat sat.", "The cat sat.", "ab cd!"]})[1]
    assert (r.word_count, r.lines, r.paragraphs) == (8, 3, 3)
    assert r.mean_word_length == pytest.approx((9 * 2 + 4) / 8)
    assert r.symbol_share == pytest.approx(3 / (12 * 2 + 6))
    assert r.repeated_line_share == pytest.approx(1 / 3)
    assert r.common_word_share == pytest.approx(2 / 8)
    assert r.top_pair_share == pytest.approx(12 / 22)


def test_twins_headings_and_empty(spark):
    row = (1, 0, 0, "One line here.", "x")
    df = spark.createDataFrame([row, row, (1, 1, 2, "A heading", "x"), (2, 0, 0, "\n \n", "x"), (None, None, None, None, None)], SCHEMA)
    got = quality.file_statistics(df).collect()
    assert [(r.doc_id, r.lines) for r in got if r.lines] == [(1, 1)]
    assert quality.file_statistics(df.limit(0)).count() == 0


def test_long_text(spark):
    r = kinds(spark, {1: ["We keep the notes here. " * 20_000]})[1]
    assert r.word_count == 100_000 and r.text_kind in ("junk", "prose")


def test_flags(spark):
    stats = quality.file_statistics(spark.createDataFrame([(1, 0, 0, "- Red boxes\n- Blue boxes", ""), (2, 0, 0, "We go home.", "")], SCHEMA))
    chunks = spark.createDataFrame([(1, "a", ["List-like"]), (1, "a", ["List-like"]), (1, "b", ["list_like", None])], "doc_id long, chunk_id string, quality_flags array<string>")
    got = {r.doc_id: r for r in quality.with_flags(stats, chunks).collect()}
    assert got[1].flags_agree and got[1].n_chunks == 2 and got[2].flags_agree is None


def test_repetition_over_runs(spark):
    """The same paragraphs in one run and in several give the same figures."""
    texts = [f"Line {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]} of the notes is kept here." for k in range(100)] * 2
    rows = [(1, n, 0, t, "") for n, t in enumerate(texts)] + [(2, n + (quality.RUN if n >= 100 else 0), 0, t, "") for n, t in enumerate(texts)]
    a, b = sorted(quality.file_statistics(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: r.doc_id)
    assert a.repeated_line_share == 0.5 and a.repeated_paragraph_share == 0.5
    assert a[1:] == b[1:]


def test_boilerplate_counts_for_no_kind(spark):
    head = "The quarterly handbook of the Porto office is kept here by the staff."
    rows = [x for k, e in enumerate("red blue old green tall small dry wet new plain brown large".split()) for x in ([f"- {e.title()} boxes from Porto"] + [head] * (k % 4 == 0))]
    r = kinds(spark, {1: rows, 2: [head] * 9})
    assert r[1].text_kind == "list" and 0.3 < r[1].boilerplate_share < quality.MOSTLY and r[2].text_kind == "junk"

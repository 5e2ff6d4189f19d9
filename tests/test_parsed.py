import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.functions.text import stem_of, syllables
from lectern.operators import chunk, clean, criteria, parsed
from lectern.sources import files, page_lines

P = "doc_id long, index int, level int, style string, text string, n_words int"


def paras(spark, rows, doc=1):
    return spark.createDataFrame([(doc, i, lv, "Normal", t, len(t.split())) for i, (lv, t) in enumerate(rows)], P)


def docs(spark, name="a-good-file-name.md", size=100):
    return parsed.documents(spark.createDataFrame([(1, f"/x/{name}", size, 1, "T")], "doc_id long, file_path string, file_size_bytes long, page_count int, title string"))


def test_syllables(spark):
    d = spark.createDataFrame([("cat", 1), ("money", 2), ("insurance", 3)], "w string, n int")
    assert all(r.n == r.s for r in d.withColumn("s", syllables(F.col("w"))).collect())


def test_stem(spark):
    d = spark.createDataFrame([("a.b.docx", "a.b"), (".env", ".env"), ("x", "x")], "f string, s string")
    assert all(r.s == r.t for r in d.withColumn("t", stem_of(F.col("f"))).collect())


def test_heading_paths_and_tree(spark):
    d = paras(spark, [(1, "A"), (3, "B"), (3, "C"), (2, "D")])
    assert [r.path for r in parsed.heading_paths(d).orderBy("index").collect()] == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "D"]]
    assert [r.parent_index for r in parsed.heading_tree(d).orderBy("index").collect()] == [None, 0, 0, 0]


def test_clean(spark):
    long = "this line of text has nine words in it"
    d = paras(spark, [(0, "Head"), (0, "x y"), (0, "Page 1"), (0, "Head"), (0, long), (0, long), (0, "Page 2 of")])
    once = clean.clean_paragraphs(d)
    assert [r.text for r in once.orderBy("index").collect()] == ["Head", "x y", long, long, "Page 2 of"]
    assert clean.clean_paragraphs(once).count() == once.count()


def test_markdown_source(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\nlost\n\nbody one\n\n\n\n## U\r\n\r\nlast")
    (tmp_path / "b.txt").write_text("# no heading\n\n \n\nend")
    got = [(r.path[-4:], r["index"], r.level, r.text) for r in files.read_text(spark, str(tmp_path)).orderBy("path", "index").collect()]
    assert got == [("a.md", 0, 1, "T"), ("a.md", 1, 0, "body one"), ("a.md", 2, 2, "U"), ("a.md", 3, 0, "last"), (".txt"[-4:], 0, 0, "# no heading"), (".txt", 2, 0, "end")]
    assert {r.file_type for r in files.discover(spark, str(tmp_path), ["b.t"]).collect()} == {"md"}


def test_docx_source(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    body = p("Top", "Heading2") + "<w:tbl><w:tr><w:tc>" + p("c1") + "</w:tc><w:tc>" + p("c1") + p("c2") + "</w:tc></w:tr></w:tbl>" + p("  ") + p("End")
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    rows = files.read_docx(spark, str(tmp_path)).orderBy("path", "index").collect()
    assert [(r.level, r.text) for r in rows if not r.error] == [(2, "Top"), (0, "c1"), (0, "c2"), (0, "End")]
    assert sum(bool(r.error) for r in rows) == 1


def test_page_lines(spark):
    rows = [("© 2020 by Us. All Rights Reserved", 9.0, False), ("12", 9.0, False), ("A Long", 16.0, True), ("Heading", 16.0, True), ("The first line", 10.0, False), ("goes on here.", 10.0, False), ("Next one starts", 10.0, False), ("NOTE", 10.0, False), ("after", 10.0, False)]
    d = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "doc_id long, ix int, text string, max_size double, is_bold boolean")
    got = [(r.level, r.text) for r in page_lines.paragraphs(d).orderBy("index").collect()]
    assert got == [(2, "A Long Heading"), (0, "The first line goes on here."), (0, "Next one starts"), (0, "NOTE"), (0, "after")]


def test_criteria(spark):
    rows = [(1, "Adding fractions"), (0, "As mentioned above, see section 2."), (3, "Overview"), (0, "word " * 301), (0, "The XYZ and XYZ and ABC (Always Be Careful) ABC.")]
    counts = criteria.document_counts(docs(spark, "doc-v2.docx", 30 * criteria.MB), paras(spark, rows))
    got = {r.category: r for r in criteria.criteria(counts).collect()}
    assert got["self_containment"].score == 100 - 12 * 2 and got["heading_quality"].score == 100 - 8 * 2
    assert got["paragraph_length"].score == 100 - 3 * 2 - 8 and got["filename_quality"].score == 60
    assert got["acronym_definitions"].score == 92 and got["structure"].score == 100 and got["file_size"].score == 50
    assert sum(r.weight for r in got.values()) == pytest.approx(1)
    know = spark.createDataFrame([(1, 5, 2, 0)], "doc_id long, n_unresolved long, n_resolved long, n_cross long")
    with_graph = {r.category: r for r in criteria.criteria(counts, knowledge=know).collect()}
    assert with_graph["knowledge_completeness"].score == 35 and sum(r.weight for r in with_graph.values()) == pytest.approx(1)


def test_gates(spark):
    rows = [(i, "x", s, 1.0, c, 0, 0) for i, (s, c) in enumerate([(85.0, 0), (70.0, 0), (50.0, 0), (49.9, 0), (95.0, 1)])]
    d = spark.createDataFrame(rows, "doc_id int, category string, score double, weight double, n_critical int, n_warning int, n_info int")
    got = [(r.gate_decision, r.readiness) for r in criteria.scorecards(d).orderBy("doc_id").collect()]
    assert got == [("PASS", "EXCELLENT"), ("PASS_WITH_NOTES", "GOOD"), ("REMEDIATION_RECOMMENDED", "FAIR"), ("HOLD_FOR_REVIEW", "POOR"), ("HOLD_FOR_REVIEW", "EXCELLENT")]
    with pytest.raises(ValueError):
        criteria.check_thresholds(70, 85, 50)


def test_chunk_windows(spark):
    words = [f"w{i}" for i in range(500)]
    d = paras(spark, [(0, "before"), (1, "H"), (0, " ".join(words[:300])), (0, " ".join(words[300:])), (2, "Empty")])
    got = chunk.chunks(docs(spark), d).orderBy("chunk_ix").collect()
    assert [r.text.split()[0] + ".." + r.text.split()[-1] for r in got] == ["before..before", "w0..w219", "w180..w399", "w360..w499"]
    assert [r.heading_path for r in got] == [[], ["H"], ["H"], ["H"]] and got[2].start_paragraph == 2 and got[2].end_paragraph == 3
    assert got[0].chunk_id == "a-good-file-name::000"


def test_blank_paragraphs_are_told_by_their_first_sign(spark):
    """No paragraph is searched for white space from end to end only to see whether it has text."""
    texts = ["", " ", "\t\n\x1c", "\xa0\u2003\u3000", "\u2028\n", " a", "a \n", "\u200b", "\x00", "\U0001f600", None]
    raw = spark.createDataFrame([(1, i, 0, "Normal", t) for i, t in enumerate(texts)], "doc_id long, para_index int, heading_level int, style string, text string")
    p = parsed.paragraphs(raw)
    assert {r["index"] for r in p.collect()} == {r.para_index for r in raw.filter(text.stripped(F.col("text")) != "").collect()} == {5, 6, 7, 8, 9}
    odd = spark.createDataFrame([(t,) for t in [*texts, "a b", "a  b", "a\u2003b c", "a\xa0b", "\x7f b", "\xe9 \U0001f600 c", " a b", "a b ", "a\tb"]], "text string")
    assert not odd.filter(~text.word_count(F.col("text")).eqNullSafe(F.size(text.words(F.col("text"))))).count()
    assert "regexp_replace" not in p._jdf.queryExecution().optimizedPlan().toString()


def test_references_are_tried_only_where_their_words_stand(spark):
    texts = ["As Mentioned ABOVE, SEE Section 3", "the following step above", "see the steps below", "Referring to the above", "as noted earlier", "instructions\nbelow", "the page", "mentioned", "", "THE PREVIOUS page; the following table", None]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    plain = sum((F.regexp_count("text", F.lit(f"(?i){p}")) for p in criteria.DANGLING), F.lit(0))
    got = d.select("text", criteria.dangling_references(F.col("text")).alias("n"), plain.alias("m"))
    assert all(r.n == (r.m or 0) for r in got.collect()) and sum(r.n for r in got.collect()) >= 8
    assert "contains(lower(text" in got._jdf.queryExecution().optimizedPlan().toString().lower()

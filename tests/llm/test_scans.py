import random

import pytest

from lectern.llm import scans
from lectern.llm.char_editor import CharEditor, corrupt

WORDS = (
    "the team should review careful records and library hours before office closes each week because several public notices require separate local plans "
    "staff compare simple water tanks replace regular service desks records support common places handbook series notes keeping what changed"
).split()


@pytest.fixture(scope="module")
def reader():
    words = sorted(set(WORDS))
    return scans.Reader(words, CharEditor.fit(words * 8))


def test_editor_on_held_out_noise(reader):
    rnd, ok, n = random.Random(3), 0, 0
    for w in (w for w in reader.vocabulary for _ in range(6) if len(w) > 4):
        x, _ = corrupt(w, rnd)
        if x != w and "\n" not in x and x not in reader.vocabulary:
            n += 1
            ok += reader.printed(x) == w
    assert n > 30 and ok >= 0.85 * n


def frames(spark):
    paras = []
    for p in range(1, 4):
        paras += [("Keeping Records", 0), ("The team should review care-\nful records before the office closes each week.", 0), (f"Several public not1ces require separate local pl@ns. Staff compare simple {'wa-' if p == 1 else 'water tanks.'}", 0), (f"Page {p}", 0)]
        if p == 1:
            paras += [("ter tanks replace the regular service desks.", 0)]
    rows = [(1, i, lv, t) for i, (t, lv) in enumerate(paras)] + [(2, 0, 0, "The code A1 marks short- and long records."), (2, 1, 0, None), (3, 0, 0, "care-\nful records"), (4, 0, 0, "1"), (None, None, None, None)]
    files = [(1, "pdf", 3, "Keeping records"), (2, "pdf", 1, None), (3, "docx", 2, "x"), (4, "pdf", None, None), (1, "pdf", 3, "Keeping records")]
    return spark.createDataFrame(rows + rows[:3], "doc_id long, para_index int, heading_level int, text string"), spark.createDataFrame(files, "doc_id long, file_type string, page_count int, title string")


def test_noise(spark, reader):
    paras, files = frames(spark)
    got = {(r.doc_id, r.para_index, r.noise_kind) for r in scans.find_noise(paras, files, reader).collect()}
    want = set()
    for i, (head, body, bad, page) in enumerate(((0, 1, 2, 3), (5, 6, 7, 8), (9, 10, 11, 12))):
        want |= {(1, head, "running_header"), (1, body, "hyphenation"), (1, bad, "misread"), (1, page, "page_number")}
    assert got == want | {(1, 2, "hyphenation")}


def test_repair(spark, reader):
    paras, files = frames(spark)
    text = {r.first_index: r.text for r in scans.repaired_paragraphs(paras, files, reader).collect()}
    assert text[1] == "The team should review careful records before the office closes each week."
    assert text[2].startswith("Several public notices require separate local plans.") and "simple water tanks replace" in text[2]
    assert not any("Page" in t for t in text.values())


def test_empty(spark, reader):
    paras, files = frames(spark)
    assert scans.find_noise(paras.limit(0), files, reader).count() == 0
    assert scans.find_noise(paras, files.limit(0), reader).count() == 0
    assert scans.Reader([], CharEditor.fit([])).strange(["abc", ""]).tolist() == [True, False]


def test_known_forms():
    known = scans.Known(["keepingrecords", "annualreport"])
    assert known.nearest("kecpingrecords") == "keepingrecords" and known.nearest("other") == "other" and known.nearest("") == ""
    assert not scans.Known(())


def test_editor_decides(reader):
    """Without its weights the editor lets nothing pass; with them it leaves words alone that are far from noise."""
    plain = scans.Reader(sorted(reader.vocabulary), CharEditor.fit(sorted(reader.vocabulary) * 8))
    assert plain.printed("rec0rds") == "records"
    plain.editor.weights, plain.editor.margin = {}, 0.0
    plain._read.clear()
    assert plain.printed("rec0rds") is None


def test_words_outside_the_vocabulary(reader):
    assert reader.misread("T0rr1ngton") is not None and reader.misread("K-4") is None and reader.misread("A12") is None


def long_frames(spark):
    """One scanned file and one that isn't, each longer than a run of eight paragraphs."""
    paras = []
    for p in range(1, 9):
        paras += [("Keeping Records", 0), (f"The team should review care-\nful records before the office closes each {'we-' if p % 3 == 0 else 'week.'}", 0), ("ek because several public notices require separate local plans." if p % 3 == 0 else "Several public not1ces require separate local plans.", 0)]
        if p in (2, 7):
            paras += [(f"Page {p}", 0)]
    rows = [(1, i, lv, t) for i, (t, lv) in enumerate(paras)] + [(2, i, 0, "The team should review careful records.") for i in range(30)]
    # one page number in each of two runs, nothing else
    rows += [(3, i, 0, f"Page {i}" if i in (2, 21) else "Staff compare simple water tanks each week.") for i in range(30)]
    files = [(i, "pdf", 8, None) for i in (1, 2, 3)]
    return spark.createDataFrame(rows, "doc_id long, para_index int, heading_level int, text string"), spark.createDataFrame(files, "doc_id long, file_type string, page_count int, title string")


def test_runs_of_a_long_file_are_put_together(spark, reader, monkeypatch):
    paras, files = long_frames(spark)
    whole = {tuple(r) for r in scans.find_noise(paras, files, reader).select("doc_id", "para_index", "noise_kind").collect()}
    fixed = {tuple(r) for r in scans.repaired_paragraphs(paras, files, reader).collect()}
    monkeypatch.setattr(scans.quality, "RUN", 8)
    monkeypatch.setattr(scans, "HALO", 4)
    parted = {tuple(r) for r in scans.find_noise(paras, files, reader).select("doc_id", "para_index", "noise_kind").collect()}
    assert {(3, 2, "page_number"), (3, 21, "page_number")} <= whole and any(k == "hyphenation" for _, _, k in whole)
    assert parted == whole
    again = {tuple(r) for r in scans.repaired_paragraphs(paras, files, reader).collect()}
    assert {r[1] for r in again} == {r[1] for r in fixed}

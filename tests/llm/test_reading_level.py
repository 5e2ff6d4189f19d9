import random

import pytest

from lectern.llm import reading_level as rl

EASY = ["We see the {a}.", "They like red {a}.", "Look at the big {a} first.", "I have ten {a}."]
MID = ["The team should review the {a} before the meeting begins.", "Staff in the office compare {a} and then collect the records.", "Most people keep their {a} when the office is closed."]
HARD = ["Notwithstanding considerable methodological heterogeneity, the {a} necessitate comprehensive institutional recalibration.", "Consequently, irreversible {a} problematise interdependent administrative determinations."]
NOUNS = ["cats", "files", "lists", "boats", "trees", "plans"]


def passages(n, seed):
    rnd, out = random.Random(seed), []
    for k, kind in enumerate((EASY, MID, HARD)):
        for _ in range(n):
            own = [rnd.choice(kind if rnd.random() < 0.8 else MID) for _ in range(6)]
            out.append((" ".join(s.format(a=rnd.choice(NOUNS)) for s in own), k))
    return out


@pytest.fixture(scope="module")
def model():
    rows = passages(25, 1)
    return rl.ReadingLevel.fit([t for t, _ in rows], [k for _, k in rows])


def test_held_out_accuracy(model):
    rows = passages(20, 2)
    x = model.sentence_levels([t for t, _ in rows])
    got = model.band(x[:, 1:] / x[:, :1])
    assert sum(int(g == k) for g, (_, k) in zip(got, rows)) >= 0.9 * len(rows)


def test_files(spark, model):
    rows = [(1, 0, 0, " ".join(EASY).format(a="cats"), "x"), (1, 0, 0, " ".join(EASY).format(a="cats"), "x"), (2, 0, 0, " ".join(HARD * 3).format(a="plans"), "x"),
            (3, 0, 0, None, "x"), (4, 0, 0, " \n", "x"), (5, 0, 1, "Heading of a file.", "x"), (2, 1, 0, "- red boxes\n- blue lids", "x"), (2, 2, 0, " ".join(HARD).format(a="lists") * 300, "x")]
    df = spark.createDataFrame(rows, "doc_id long, para_index int, heading_level int, text string, basic string")
    got = {r.doc_id: r for r in rl.file_levels(df, model).collect()}
    assert {i: r.grade_band for i, r in got.items()} == {1: "basic", 2: "advanced"}
    assert got[1].n_sentences == 4
    assert rl.file_levels(df.limit(0), model).count() == 0


def test_fit_from_rows(spark):
    rows = [(t, rl.BANDS[k].upper() + " ", "c") for t, k in passages(6, 3)] + [(None, "basic", "c"), ("x", "other", "c")]
    m = rl.fit(spark.createDataFrame(rows, "text string, grade_band string, band string"))
    assert m.calibration.shape == (4, 3)

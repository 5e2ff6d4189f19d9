import random

import pytest

from lectern.llm import residue

CLEAN = ["The {n} keep the notes at home.", "Most {n} in Porto compare the lists.", "Name: ________  Date: ________", "Page {d}", "The 404 rate of the {n} fell.", "Text such as \"lorem ipsum\" is filler.", "# How {n} work", "[ ] Red {n}", "Write it as in \"[Your name]\"."]
BAD = ["Dear {{{{{n}}}}}, we wrote to ${{name}}.", "Lorem ipsum dolor sit amet magna.", "Error {d} Service unavailable", "Please enable JavaScript to view the {n}.", "Content coming soon.", "Page not found", "Hello [Your {n}],"]


def texts(n, seed):
    rnd, out = random.Random(seed), []
    fill = lambda s: s.format(n=rnd.choice(["cats", "lists", "boats", "plans", "files"]), d=rnd.choice([403, 404, 500, 503]))
    for i in range(n):
        lines = [fill(rnd.choice(CLEAN)) for _ in range(5)]
        bad = i % 4 == 0
        if bad:
            lines.insert(rnd.randrange(6), fill(rnd.choice(BAD)))
        out.append(("\n".join(lines), bad))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, title string, source string, kind string")


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t, None, f"s{i % 7}", "c") for i, (t, _) in enumerate(texts(400, 1))]
    drawn = residue.labelled(frame(spark, rows))
    checked = residue.validate(drawn)
    assert {r[0] for r in checked} == {"host", "phrase"} and set(residue.CLASSES[1:]) - {"script"} <= {r[1] for r in checked} <= set(residue.CLASSES[1:])
    return residue.fit(drawn)


def test_draw_is_weighted_and_does_not_follow_the_spread(spark):
    rows = [(i, t, None, f"s{i % 7}", "c") for i, (t, _) in enumerate(texts(400, 1))]
    a, b = (residue.labelled(frame(spark, rows).repartition(n), 20) for n in (1, 5))
    assert a.sort_values(["label", "shaped", "host"]).reset_index(drop=True).equals(b.sort_values(["label", "shaped", "host"]).reset_index(drop=True))
    total = sum(len(residue.segments(t)) for _, t, *_ in rows)
    assert abs(a["weight"].sum() - total) < 1e-6 and a.groupby("label").size().max() <= 120


def test_found_documents_do_not_follow_the_bound(spark):
    rows = frame(spark, [(i, t, None, f"s{i % 7}", "c") for i, (t, _) in enumerate(texts(1200, 3))])
    found = []
    for most in (100, 200, 400):
        found.append({r.doc_id for r in residue.find_residue(rows, residue.fit(residue.labelled(rows, most))).collect()})
    assert len(found[1]) > 200 and all(len(found[1] ^ x) <= 0.01 * len(found[1]) for x in found)


UNSEEN = [
    ("We could not show the lists. Please enable JavaScript in order to see the boats.", True),
    ("Hi {{nickname}}, the plans are ready.", True),
    ("Dear ${first_name},", True),
    ("Error 504 Gateway timeout", True),
    ("Lorem amet magna dolor ipsum sit.", True),
    ("The boats need JavaScript experts and tidy scripts.", False),
    ("Staff in Porto require build scripts first.", False),
    ("About 404 of the lists fell.", False),
    ("Name: ________", False),
    ("Page 503", False),
    ("We fix a \"page not found\" by a redirect.", False),
    ("The content of the files is soon coming to Porto.", False),
]


def test_wordings_not_seen(spark, model):
    got = {r.doc_id for r in residue.find_residue(frame(spark, [(i, t, None, None, "c") for i, (t, _) in enumerate(UNSEEN)]), model).collect()}
    want = {i for i, (_, bad) in enumerate(UNSEEN) if bad}
    assert len(got & want) >= 4 and len(got - want) <= 1, (got, want)


def test_unseen_documents(spark, model):
    rows = texts(120, 2)
    got = {r.doc_id for r in residue.find_residue(frame(spark, [(i, t, "T", None, "c") for i, (t, _) in enumerate(rows)]), model).collect()}
    want = {i for i, (_, bad) in enumerate(rows) if bad}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 2


def test_edges(spark, model):
    bad = "Please enable JavaScript to view the lists."
    rows = [(1, None, None, None, "c"), (2, " \n", None, None, "c"), (3, "We keep the notes. " * 20_000 + "\n" + bad, None, None, "c"), (4, "Set it first:\n```\nexport R=${HOME}\n```\nThen we keep the lists.", None, None, "c"), (5, bad, None, None, "c"), (5, bad, None, None, "c")]
    got = {r.doc_id for r in residue.find_residue(frame(spark, rows), model).collect()}
    assert got == {3, 5}
    assert residue.find_residue(frame(spark, []), model).count() == 0
    assert residue.find_residue(frame(spark, rows), None).count() == 0


def test_segments():
    assert residue.segments("a `{x}` b\n```\n${Y}\n```\n\"q\" z") == [("a  qquote  b", 0), (" qquote  z", 2)]
    assert residue.weak_label("%title% is due")[0] and not residue.weak_label("10 % of 20 %")[0]
    assert residue.weak_label("404", 0)[0] and not residue.weak_label("404", 1)[0] and residue.weak_label("Text text text text.")[0]
    for about in ("The team should require the build scripts and the files.", "We tested the page with JavaScript switched off.", "Name: ________   Date: ________"):
        assert not residue.weak_label(about)[0]
    assert residue.masked("Please enable JavaScript to view this page", 1, None, *residue.weak_label("Please enable JavaScript to view this page")).startswith("to view this page")


def test_long_lines_are_read_whole():
    from lectern.llm.residue import segments, shaped, weak_label

    plain = "the keeper carries wet lanterns along the narrow quay and counts them twice, "
    line = plain * 40 + "please enable javascript in your browser, " + plain * 40
    parts = [s for s, _ in segments(line)]
    assert all(len(s) <= 300 for s in parts) and sum("please enable javascript in your browser" in s for s in parts) >= 1
    assert sum(weak_label(s)[0] > 0 for s in parts) < 5 and {w for s in parts for w in s.split()} >= set(line.split())
    assert "javascript" in shaped("x " * 1200 + "javascript", 1, None)
    assert [s for s, _ in segments("y" * 2500)][-1].endswith("y") and sum(len(s) for s, _ in segments("y" * 2500)) >= 2500

import numpy as np
import pytest

from lectern.operators import assist, criteria, graph, manifest
from lectern.plans import graph_queries

E = "src string, dst string, rel_type string"


def test_pagerank(spark):
    got = {r.key: r.rank for r in graph.pagerank(spark.createDataFrame([("hub", f"n{i}", "r") for i in range(5)], E)).collect()}
    assert sum(got.values()) == pytest.approx(1, abs=1e-4) and got["n0"] > got["hub"]


def test_communities_and_modularity(spark):
    edges = spark.createDataFrame([(a, b, "r") for a, b in ("ab", "bc", "ca", "de", "ef", "fd", "cd")], E)
    label = graph.communities(edges)
    got = {r.key: r.community for r in label.collect()}
    assert got["a"] == got["b"] == got["c"] and got["d"] == got["e"] == got["f"] and got["a"] != got["d"]
    assert graph.modularity(edges, label) == pytest.approx(6 / 7 - 0.5)


def test_communities_settle(spark):
    # neighbours that move at once would swap labels for ever
    pair = spark.createDataFrame([("a", "b", "r"), ("b", "a", "r")], E)
    assert [r.community for r in graph.communities(pair).collect()] == ["a", "a"]
    with pytest.raises(RuntimeError):
        graph.communities(pair, rounds=1)


def test_registered_ranks_are_finished(spark, tmp_path):
    n = 30
    rel = [(i, 1, f"n{i:02}", f"n{i + 1:02}", "r") for i in range(n - 1)]
    spark.createDataFrame(rel, "rel_id long, doc_id long, source string, target string, rel_type string").write.parquet(str(tmp_path / "relationships.parquet"))
    spark.createDataFrame([], "entity_id long, name string, entity_type string, source_file string, doc_id long, description string").write.parquet(str(tmp_path / "entities.parquet"))
    got = {r.key[-2:]: r["rank"] for r in graph_queries.entity_pagerank(spark, str(tmp_path)).collect()}
    m = np.full((n, n), 0.15 / n)
    m[:, n - 1] = 1 / n
    m[np.arange(1, n), np.arange(n - 1)] += 0.85
    want = np.linalg.matrix_power(m, 500) @ np.full(n, 1 / n)
    assert [got[f"{i:02}"] for i in range(n)] == pytest.approx(want, abs=1e-4)
    with pytest.raises(RuntimeError):
        graph.pagerank(spark.createDataFrame([(s, t, r) for _, _, s, t, r in rel], E), rounds=10)


def test_bridges(spark):
    got = [(r.key, r.betweenness) for r in graph.bridges(spark.createDataFrame([("a", "b", ""), ("b", "c", "")], E)).collect()]
    assert got == [("b", 0.5)]


def test_entities_and_edges(spark):
    raw = spark.createDataFrame([(1, "Cat ", "animal", "f", 1, "x"), (2, "cat", "animal", "g", 2, "longer"), (3, None, "a", "f", 1, None), (4, "Dog", None, "f", 1, None)], "entity_id long, name string, entity_type string, source_file string, doc_id long, description string")
    m = {r.key: r for r in graph.merged_entities(raw).collect()}
    assert set(m) == {"animal:cat", "concept:dog"} and m["animal:cat"].description == "longer" and m["animal:cat"].name == "Cat "
    rel = spark.createDataFrame([(1, "CAT", "bird", "eats"), (2, "cat", "Bird ", "sees"), (3, " ", "dog", "x")], "rel_id long, source string, target string, rel_type string")
    e = graph.resolved_edges(rel, graph.merged_entities(raw)).collect()
    assert [(r.src, r.dst, r.rel_type, r.n) for r in e] == [("animal:cat", "unresolved:bird", "sees", 2)]
    assert [r.name for r in graph.unresolved(graph.resolved_edges(rel, graph.merged_entities(raw))).collect()] == ["bird"]


def test_related_and_blend(spark):
    edges = spark.createDataFrame([("a", "b", ""), ("b", "c", ""), ("c", "d", "")], E)
    got = {(r.other, r.hops) for r in graph.related(edges, spark.createDataFrame([("a",)], "key string")).collect()}
    assert got == {("b", 1), ("c", 2)}
    s = lambda v: spark.createDataFrame(v, "x int, y int, value double")
    assert {(r.x, r.y): round(r.value, 6) for r in graph.blend(s([(1, 2, 1.0)]), s([(1, 2, 0.5), (1, 3, 1.0)])).collect()} == {(1, 2): 0.85, (1, 3): 0.3}


def test_shared_entity_similarity_has_no_cap(spark):
    # one entity in 60 files, one in 2; the blocks must not lose or double a pair
    held = [(i, "hot") for i in range(60)] + [(0, "rare"), (1, "rare"), (2, "own")]
    df = {k: sum(x == k for _, x in held) for k in ("hot", "rare", "own")}
    idf = {k: np.log(101 / (n + 1)) for k, n in df.items()}
    vec = {i: {k: idf[k] for f, k in held if f == i} for i in range(60)}
    size = {i: sum(v * v for v in x.values()) ** 0.5 for i, x in vec.items()}
    want = {(a, b): sum(v * vec[b].get(k, 0) for k, v in vec[a].items()) / size[a] / size[b] for a in range(60) for b in range(a + 1, 60)}
    ment = spark.createDataFrame(held, "file long, key string")
    for more in ({}, {"block": 7}):
        got = [((r.file_a, r.file_b), r.cosine) for r in graph.shared_entity_similarity(ment, 100, **more).collect()]
        assert len(got) == len(want) and dict(got) == pytest.approx(want)
    assert {r.cosine for r in graph.shared_entity_similarity(ment.filter("key = 'hot'"), 60).collect()} == {0.0}


def test_spectral():
    a = np.full((6, 6), 0.01)
    a[:3, :3] = a[3:, 3:] = 0.9
    assert sorted(map(tuple, graph.spectral_clusters(a))) == [(0, 1, 2), (3, 4, 5)]


def test_extract_json():
    assert assist.extract_json('```json\n{"a": {"b": "}"}}\n```') == {"a": {"b": "}"}}
    assert assist.extract_json('no {bad} but {"x": 1} here') == {"x": 1} and assist.extract_json("none") is None and assist.extract_json(None) is None


def test_assist(spark):
    def client(prompt):
        if "fail" in prompt:
            raise ValueError("broken")
        return 'Sure: {"domain": "law", "entities": [{"name": "A"}, {"type": "x"}], "relationships": []}' if "good" in prompt else "nothing"

    d = spark.createDataFrame([(1, "good text"), (2, "fail"), (3, "else")], "doc_id long, text string")
    r = assist.ask(d.select("doc_id", assist.analysis_prompt(d["text"]).alias("prompt")), client)
    got = {x.doc_id: x for x in assist.analyses(r).collect()}
    assert got[1].a.domain == "law" and [e.type for e in got[1].entities] == ["concept"] and not got[1].failed
    assert "broken" in got[2].summary and got[3].failed
    low = assist.analyses(r).join(spark.createDataFrame([(1, 50), (2, 5), (3, 5)], "doc_id long, n_words int"), "doc_id")
    assert {x.doc_id for x in low.filter(~assist.low_confidence(low)).collect()} == {1}


def test_manifest_round_trip_and_diff(spark, tmp_path):
    row = lambda s, g: [(s, g, {"critical": 0, "warning": 1, "info": 2})]
    schema = "source_file string, overall_score double, gate_decision string, issues_by_severity struct<critical:int,warning:int,info:int>"
    before = spark.createDataFrame([("a.md", 60.0, "REMEDIATION_RECOMMENDED", (0, 1, 2)), ("b.md", 90.0, "PASS", (0, 0, 0))], schema)
    after = spark.createDataFrame([("a.docx", 80.0, "PASS_WITH_NOTES", (0, 0, 1))], schema)
    d = manifest.diff(before, after)
    assert [(r.stem, r.delta, r.issue_delta) for r in d.collect()] == [("a", 20.0, -2)]
    assert "| a | 60.0 | 80.0 | +20.0 |" in manifest.diff_markdown(d)
    assert criteria.KNOWLEDGE[1] == 0.05 and row(1, 2)

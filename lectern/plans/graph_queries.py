"""Queries on the entity graph and the manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions.text import BLANK
from lectern.operators import criteria, graph, manifest, resolve
from lectern.plans.scoring_queries import CRIT, GATE, counts_of, docs_of
from lectern.sources.tables import table


def _entities(spark, folder):
    return table(spark, folder, "entities", "entity_id", "name", "entity_type", "source_file", "doc_id", "description")


def _edges(spark, folder):
    rel = table(spark, folder, "relationships", "rel_id", "source", "target", "rel_type").filter("source IS NOT NULL AND target IS NOT NULL")
    return graph.resolved_edges(rel, graph.merged_entities(_entities(spark, folder)))


def entities_merged(spark, folder):
    return graph.merged_entities(_entities(spark, folder)).select("key", "name", "entity_type", F.md5("description").alias("md5"), "n_mentions")


def edges_resolved(spark, folder):
    return _edges(spark, folder)


def unresolved_names(spark, folder):
    return graph.unresolved(_edges(spark, folder))


def fuzzy_resolution(spark, folder):
    """Names that no entity has, with the entity nearest by character n-grams."""
    got = resolve.resolve(graph.unresolved(_edges(spark, folder)), graph.merged_entities(_entities(spark, folder)))
    return got.withColumn("cosine", F.round("cosine", 6))


def cross_document_references(spark, folder):
    return graph.cross_document_references(graph.mentions(_entities(spark, folder)))


def graph_summary(spark, folder):
    return graph.graph_summary(_edges(spark, folder), graph.merged_entities(_entities(spark, folder)))


def shared_entity_similarity(spark, folder):
    n = docs_of(spark, folder).count()
    return graph.shared_entity_similarity(graph.mentions(_entities(spark, folder)), n).withColumn("cosine", F.round("cosine", 6))


def entity_pagerank(spark, folder):
    return graph.pagerank(_edges(spark, folder)).withColumn("rank", F.round("rank", 9))


def entity_communities(spark, folder):
    return graph.communities(_edges(spark, folder))


def knowledge_scorecards(spark, folder):
    ent = _entities(spark, folder)
    names = ent.select(F.lower(F.regexp_replace("name", f"^{BLANK}+|{BLANK}+$", "")).alias("k")).distinct()
    rel = table(spark, folder, "relationships", "doc_id", "source", "target")
    ends = rel.select("doc_id", F.explode(F.array("source", "target")).alias("name")).filter("name IS NOT NULL").select("doc_id", F.lower(F.regexp_replace("name", f"^{BLANK}+|{BLANK}+$", "")).alias("k")).filter("k <> ''")
    missing = ends.join(names, "k", "left_anti").distinct().select("doc_id", F.col("k").alias("key"))
    know = graph.knowledge_counts(graph.mentions(ent), missing)
    cards = criteria.scorecards(criteria.criteria(counts_of(spark, folder), knowledge=know))
    return cards.select("doc_id", F.round("overall_score", 6).alias("overall_score"), "gate_decision")


def _entries(spark, folder):
    counts = counts_of(spark, folder)
    crit = criteria.criteria(counts)
    chunk_counts = table(spark, folder, "chunks", "chunk_id", "doc_id").distinct().groupBy("doc_id").agg(F.count("*").alias("n"))
    return manifest.document_entries(docs_of(spark, folder), criteria.scorecards(crit), crit, criteria.retrieval_gate(counts), chunk_counts)


def manifest_documents(spark, folder):
    e = _entries(spark, folder).select("doc_id", "entry.*")
    return e.select(
        "doc_id", "source_file", "gate_decision", F.col("issues_by_severity.warning").alias("warnings"), F.col("issues_by_severity.info").alias("infos"), F.col("criteria_scores")["structure"].alias("structure"),
        F.col("chunk_count").cast("long").alias("chunk_count"), F.col("retrieval_mode_hint.recommended_mode").alias("mode"),
    )


def manifest_corpus(spark, folder):
    c = manifest.corpus_summary(_entries(spark, folder))
    flat = lambda m: F.array_join(F.transform(F.map_entries(m), lambda x: F.concat(x.key, F.lit(": "), x.value.cast("string"))), ", ")
    return c.select("total_documents", F.col("total_chunks").cast("long").alias("total_chunks"), flat("gate_distribution").alias("gates"), flat("retrieval_mode_distribution").alias("modes"))


def criteria_changes(spark, folder):
    """Criteria that change when repeated furniture is cleaned away."""
    from lectern.operators.clean import clean_paragraphs
    from lectern.plans.scoring_queries import paras_of

    docs, paras = docs_of(spark, folder), paras_of(spark, folder)
    before = criteria.criteria(criteria.document_counts(docs, paras))
    after = criteria.criteria(criteria.document_counts(docs, clean_paragraphs(paras)))
    moved = F.abs(F.col("after") - F.col("before")) >= 5
    return manifest.criteria_diff(before, after).filter(moved).select("doc_id", "category", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


QUERIES = {
    f.__name__: f
    for f in (
        entities_merged, edges_resolved, unresolved_names, fuzzy_resolution, cross_document_references, graph_summary, shared_entity_similarity, entity_pagerank, entity_communities, knowledge_scorecards,
        manifest_documents, manifest_corpus, criteria_changes,
    )
}


def _strip(c: str) -> str:
    return "regexp_replace(" + c + f", '^{BLANK}+|{BLANK}+$', '', 'g')"


_ENT = f"""e AS (SELECT *, coalesce(entity_type, 'concept') || ':' || lower({_strip("name")}) AS key FROM (SELECT DISTINCT entity_id, name, entity_type, source_file, doc_id, description FROM entities) WHERE {_strip("name")} <> ''),
 merged AS (SELECT key, arg_min(name, entity_id) AS name, arg_min(entity_type, entity_id) AS entity_type, arg_max(coalesce(description, ''), (length(coalesce(description, '')), -entity_id)) AS description, count(*) AS n_mentions FROM e GROUP BY key),
 ment AS (SELECT DISTINCT doc_id AS file, key FROM e)"""
_EDGE = f"""{_ENT}, nm AS (SELECT lower({_strip("name")}) AS n, max(key) AS key FROM merged GROUP BY 1),
 rr AS (SELECT DISTINCT rel_id, rel_type, lower({_strip("source")}) AS s, lower({_strip("target")}) AS t FROM relationships WHERE source IS NOT NULL AND target IS NOT NULL),
 ed AS (SELECT coalesce(a.key, 'unresolved:' || s) AS src, coalesce(b.key, 'unresolved:' || t) AS dst, arg_max(rel_type, rel_id) AS rel_type, count(*) AS n
   FROM rr LEFT JOIN nm a ON a.n = s LEFT JOIN nm b ON b.n = t WHERE s <> '' AND t <> '' GROUP BY 1, 2),
 un AS (SELECT DISTINCT substr(k, 12) AS name FROM (SELECT src AS k FROM ed UNION ALL SELECT dst FROM ed) WHERE starts_with(k, 'unresolved:'))"""
SQL = {
    "entities_merged": f"WITH {_ENT} SELECT key, name, entity_type, md5(description) AS md5, n_mentions FROM merged",
    "edges_resolved": f"WITH {_EDGE} SELECT * FROM ed",
    "unresolved_names": f"WITH {_EDGE} SELECT * FROM un",
    "cross_document_references": f"WITH {_ENT} SELECT file, key, n - 1 AS n_other_files FROM ment JOIN (SELECT key, count(*) AS n FROM ment GROUP BY key) USING (key) WHERE n > 1",
    "graph_summary": f"WITH {_EDGE} SELECT (SELECT count(*) FROM merged) AS n_entities, (SELECT count(DISTINCT entity_type) FROM merged) AS n_entity_types, (SELECT count(*) FROM ed) AS n_edges, (SELECT count(DISTINCT rel_type) FROM ed) AS n_rel_types, (SELECT count(*) FROM un) AS n_unresolved",
    "shared_entity_similarity": f"""WITH {_ENT}, nf AS (SELECT count(DISTINCT doc_id) AS n FROM source_files), w AS (SELECT file, key, df, ln((n + 1) / (df + 1)::DOUBLE) AS idf FROM ment JOIN (SELECT key, count(*) AS df FROM ment GROUP BY key) USING (key), nf),
        nn AS (SELECT file, sqrt(sum(idf * idf)) AS norm FROM w GROUP BY file)
        SELECT file_a, file_b, round(CASE WHEN x.norm * y.norm > 0 THEN dot / (x.norm * y.norm) ELSE 0 END, 6) AS cosine FROM (SELECT a.file AS file_a, b.file AS file_b, sum(a.idf * b.idf) AS dot FROM w a JOIN w b ON a.key = b.key AND a.file < b.file GROUP BY 1, 2)
        JOIN nn x ON x.file = file_a JOIN nn y ON y.file = file_b""",
    "knowledge_scorecards": f"""WITH {CRIT}, {_ENT}, names AS (SELECT DISTINCT lower({_strip("name")}) AS k FROM entities WHERE name IS NOT NULL),
        miss AS (SELECT doc_id, count(DISTINCT k) AS n_unresolved FROM (SELECT doc_id, lower({_strip("x")}) AS k FROM (SELECT doc_id, unnest([source, target]) AS x FROM relationships)) WHERE k <> '' AND k NOT IN (SELECT k FROM names) GROUP BY doc_id),
        res AS (SELECT file AS doc_id, count(*) AS n_resolved, count(*) FILTER (n > 1) AS n_cross FROM ment JOIN (SELECT key, count(*) AS n FROM ment GROUP BY key) USING (key) GROUP BY file),
        k AS (SELECT d.doc_id, greatest(0, 100 - 10 * coalesce(n_unresolved, 0) - 15 * (coalesce(n_resolved, 0) > 0 AND coalesce(n_cross, 0) = 0)::INT)::DOUBLE AS score FROM docs d LEFT JOIN miss USING (doc_id) LEFT JOIN res USING (doc_id)),
        al AS (SELECT doc_id, score, weight * 0.95 AS weight, n_critical FROM crit UNION ALL SELECT doc_id, score, 0.05, 0 FROM k),
        ov AS (SELECT doc_id, sum(score * weight) / sum(weight) AS s, sum(n_critical) AS c FROM al GROUP BY doc_id)
        SELECT doc_id, round(s, 6) AS overall_score, CASE WHEN c > 0 THEN 'HOLD_FOR_REVIEW' WHEN round(s, 10) >= 85 THEN 'PASS' WHEN round(s, 10) >= 70 THEN 'PASS_WITH_NOTES' WHEN round(s, 10) >= 50 THEN 'REMEDIATION_RECOMMENDED' ELSE 'HOLD_FOR_REVIEW' END AS gate_decision FROM ov""",
    "manifest_documents": f"""WITH {GATE} SELECT doc_id, filename AS source_file, gate_decision, n_warning AS warnings, n_info AS infos, (SELECT score FROM crit c WHERE c.doc_id = docs.doc_id AND category = 'structure') AS structure,
        coalesce(n, 0) AS chunk_count, recommended_mode AS mode FROM docs JOIN cards USING (doc_id) JOIN gate USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT chunk_id, doc_id FROM chunks) GROUP BY doc_id) USING (doc_id)""",
    "manifest_corpus": f"""WITH {GATE} SELECT (SELECT count(*) FROM docs) AS total_documents, (SELECT count(*) FROM (SELECT DISTINCT chunk_id, doc_id FROM chunks) JOIN docs USING (doc_id)) AS total_chunks,
        (SELECT string_agg(g || ': ' || n, ', ' ORDER BY g) FROM (SELECT gate_decision AS g, count(*) AS n FROM cards GROUP BY 1)) AS gates,
        (SELECT string_agg(m || ': ' || n, ', ' ORDER BY m) FROM (SELECT recommended_mode AS m, count(*) AS n FROM gate GROUP BY 1)) AS modes""",
}

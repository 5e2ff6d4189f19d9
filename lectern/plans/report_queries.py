"""Queries on issues, metrics, the benchmark and the graph as reports need them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.operators import clean, criteria, features, graph, issues, parsed, retrieval
from lectern.plans import feature_queries as fq
from lectern.plans import graph_queries as gq
from lectern.plans import scoring_queries as sq
from lectern.plans.scoring_queries import counts_of, docs_of, paras_of
from lectern.session import cut
from lectern.sources.tables import table


def _issues(spark, folder):
    return issues.issues(counts_of(spark, folder), paras_of(spark, folder))


def document_issues(spark, folder):
    return _issues(spark, folder).select("doc_id", "category", "severity", "kind", F.coalesce("place", F.lit(-1).cast("long")).alias("place"), F.coalesce("detail", F.lit("")).alias("detail"))


def first_issues(spark, folder):
    """The five issues of each file and category that a report shows."""
    return issues.first_issues(_issues(spark, folder)).select("doc_id", "category", "rank", "severity", "kind", F.coalesce("place", F.lit(-1).cast("long")).alias("place"))


def files_to_fix(spark, folder):
    cards = criteria.scorecards(criteria.criteria(counts_of(spark, folder)))
    return issues.to_fix(_issues(spark, folder), cards).withColumn("overall_score", F.round("overall_score", 6))


def document_metrics(spark, folder):
    """The metrics of each file that a manifest carries."""
    paras, _, vocab, weights = fq._corpus(spark, folder)
    own = docs_of(spark, folder).select("doc_id")
    bounds = features.topic_boundaries(paras, vocab).groupBy("doc_id").agg(F.count("*").alias("n_boundaries"))
    body = parsed.sections(paras).filter("level = 0").select("doc_id", "section", "text")
    density = features.density(body, vocab).groupBy("doc_id").agg(F.avg("density").alias("density"))
    parts = (features.entropy(weights), features.readability(paras), features.coherence(parsed.heading_content(paras), vocab), density)
    out = own
    for p in parts:
        out = out.join(p, "doc_id", "left")
    out = out.join(bounds, "doc_id", "left").fillna(0, ["n_boundaries"])
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("entropy", "grade", "coherence", "density")], "n_boundaries")


def _queries(spark, folder):
    paras, weights = fq._by_file(spark, folder)
    return retrieval.benchmark_queries(docs_of(spark, folder), paras, weights)


def benchmark_queries(spark, folder):
    return _queries(spark, folder)


def _ranked(spark, folder):
    c = table(spark, folder, "chunks", "chunk_id", "doc_id", "text").filter("text IS NOT NULL")
    gold = c.select(F.col("doc_id").alias("query_id"), "chunk_id").distinct()
    # used several times, and costly to make
    q = cut(_queries(spark, folder).join(gold.select("query_id").distinct(), "query_id", "left_semi"))
    top = retrieval.search(retrieval.query_terms(q), c, 10, "chunk_id")
    return cut(retrieval.padded(cut(top.select("query_id", "chunk_id", "rank")), c, q, 10, "chunk_id")), gold.join(q.select("query_id"), "query_id", "left_semi")


def retrieval_benchmark(spark, folder):
    """Built queries over the chunks of their files."""
    m = retrieval.measures(*_ranked(spark, folder), "chunk_id")
    return m.select(*[F.round(x, 6).alias(x) for x in ("recall_at_k", "mrr", "ndcg_at_k")], "query_count")


def benchmark_by_mode(spark, folder):
    """The benchmark for the files of each way of handling."""
    ranked, gold = _ranked(spark, folder)
    modes = criteria.retrieval_gate(counts_of(spark, folder)).select(F.col("doc_id").alias("query_id"), "recommended_mode")
    hit = ranked.join(gold, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    per = gold.select("query_id").distinct().join(hit, "query_id", "left").join(modes, "query_id")
    return per.groupBy("recommended_mode").agg(
        F.count("*").alias("query_count"), F.round(F.avg((F.coalesce("first", F.lit(11)) <= 5).cast("double")), 6).alias("recall_at_k"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr")
    )


def escalation(spark, folder):
    """Whether a batch is to be escalated: a file on hold, or a benchmark below its floor."""
    cards = criteria.scorecards(criteria.criteria(counts_of(spark, folder)))
    held = cards.agg(F.sum((F.col("gate_decision") == "HOLD_FOR_REVIEW").cast("long")).alias("n_held"))
    m = retrieval.measures(*_ranked(spark, folder), "chunk_id")
    both = held.crossJoin(m)  # two single rows
    return both.select("n_held", (F.col("n_held") > 0).alias("on_hold"), (F.col("recall_at_k") < 0.6).alias("low_recall"), (F.col("mrr") < 0.5).alias("low_mrr"))


def _search(spark, folder, files):
    c = table(spark, folder, "chunks", "chunk_id", "doc_id", "text").filter("text IS NOT NULL").join(files, "doc_id", "left_semi")
    got = retrieval.search(retrieval.query_terms(fq._items(spark, folder)), c, 5, "chunk_id")
    return got.select("query_id", "chunk_id", "rank", F.round("score", 5).alias("score"))


def search_good_files(spark, folder):
    """Five best chunks for each question among files that score 70 or more."""
    return _search(spark, folder, criteria.scorecards(criteria.criteria(counts_of(spark, folder))).filter("overall_score >= 70").select("doc_id"))


def search_domain(spark, folder):
    """Five best chunks for each question among files of one domain."""
    return _search(spark, folder, table(spark, folder, "content_analyses", "doc_id", "domain").filter(F.lower(F.trim("domain")) == "legal").select("doc_id").distinct())


def texttile_chunks(spark, folder):
    """Paragraphs of each file between its topic boundaries."""
    paras, _, vocab, _ = fq._corpus(spark, folder)
    b = features.topic_boundaries(paras, vocab).withColumnRenamed("boundary", "pos")
    n = paras.select("doc_id", "index", "n_words", (F.row_number().over(W.partitionBy("doc_id").orderBy("index")) - 1).alias("pos"))
    part = n.join(b.withColumn("new", F.lit(1)), ["doc_id", "pos"], "left").withColumn("piece", F.coalesce(F.sum("new").over(W.partitionBy("doc_id").orderBy("pos")), F.lit(0)))
    return part.groupBy("doc_id", "piece").agg(F.min("index").alias("first_index"), F.max("index").alias("last_index"), F.sum("n_words").cast("long").alias("n_words"))


def graph_types(spark, folder):
    """Entities per type and edges per relation."""
    e = gq._entities(spark, folder)
    a = graph.merged_entities(e).groupBy("entity_type").agg(F.count("*").alias("n")).select(F.lit("entity").alias("what"), F.col("entity_type").alias("type"), "n")
    b = gq._edges(spark, folder).groupBy("rel_type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), F.col("rel_type").alias("type"), "n")
    return a.unionByName(b)


def cross_document_edges(spark, folder):
    """Edges between entities of different files, per relation."""
    files = graph.merged_entities(gq._entities(spark, folder)).filter("source_file <> ''").select("key", "source_file")
    edges = gq._edges(spark, folder)
    both = edges.join(files.select(F.col("key").alias("src"), F.col("source_file").alias("fa")), "src").join(files.select(F.col("key").alias("dst"), F.col("source_file").alias("fb")), "dst")
    return both.filter("fa <> fb").groupBy("rel_type").agg(F.count("*").alias("n"))


def related_entities(spark, folder):
    """What is reached within two hops from the entities whose id is divisible by 20."""
    e = gq._entities(spark, folder)
    start = e.filter("entity_id % 20 = 0 AND name IS NOT NULL").select(graph.entity_key(F.col("entity_type"), F.col("name")).alias("key")).distinct()
    return graph.related(gq._edges(spark, folder), start)


def corpus_changes(spark, folder):
    """What cleaning does to the corpus as a whole."""
    docs, paras = docs_of(spark, folder), paras_of(spark, folder)

    def summed(p, name):
        cards = criteria.scorecards(criteria.criteria(criteria.document_counts(docs, p)))
        return cards.agg(F.lit(name).alias("state"), F.count("*").alias("n_documents"), F.round(F.avg("overall_score"), 6).alias("mean_score"), F.sum(F.col("n_critical") + F.col("n_warning") + F.col("n_info")).alias("n_issues"), F.sum(F.col("gate_decision").isin("PASS", "PASS_WITH_NOTES").cast("long")).alias("n_passing"))

    return summed(paras, "before").unionByName(summed(clean.clean_paragraphs(paras), "after"))


QUERIES = {
    f.__name__: f
    for f in (
        document_issues, first_issues, files_to_fix, document_metrics, benchmark_queries, retrieval_benchmark, benchmark_by_mode, escalation, search_good_files, search_domain, texttile_chunks, graph_types,
        cross_document_edges, related_entities, corpus_changes,
    )
}

_REFS = " || ".join(f"regexp_extract_all(text, '(?i)({p})', 1)" for p in criteria.DANGLING)
_SPLIT = sq.split_words("lower(text)")
_SPREAD = "CASE WHEN n_headings >= 2 AND n_topic_words > 0 THEN CASE WHEN n_topic_distinct / n_topic_words::DOUBLE > 0.85 THEN 2 WHEN n_topic_distinct / n_topic_words::DOUBLE > 0.7 THEN 1 END END"
_WHOLE = [
    ("heading_quality", "warning", "no_headings", sq._BARE, "n_body"), ("heading_quality", "warning", "dense", sq._DENSE, "n_body"), ("paragraph_length", "warning", "mostly_short", "n_short * 2 > n_body", "n_short"),
    ("file_focus", "warning", "broad", f"{_SPREAD} = 2", "''"), ("file_focus", "info", "mixed", f"{_SPREAD} = 1", "''"), ("filename_quality", "warning", "untelling_name", sq._NAME, "stem"),
    ("filename_quality", "info", "short_name", sq._SHORT, "stem"), ("filename_quality", "info", "run_on_name", sq._LONG, "stem"), ("structure", "warning", "sparse", f"sparse AND NOT {sq._FORMS}", "n_words"),
    ("structure", "info", "sparse", f"sparse AND {sq._FORMS}", "n_words"), ("structure", "warning", "no_structure", "n_headings = 0", "''"), ("structure", "warning", "little_text", "n_body_words <= 100", "n_body_words"),
    ("structure", "info", "one_heading", "n_headings = 1", "''"), ("structure", "info", "few_paragraphs", "n_body < 3", "n_body"), ("file_size", "critical", "too_large", "file_size_bytes > 52428800", "file_size_bytes"),
    ("file_size", "warning", "large", "file_size_bytes > 26214400 AND file_size_bytes <= 52428800", "file_size_bytes"),
]
_ISSUES = f"""iss AS (
  SELECT doc_id, 'self_containment' AS category, 'warning' AS severity, 'reference' AS kind, index::BIGINT AS place, unnest({_REFS}) AS detail FROM paras WHERE level = 0
  UNION ALL SELECT doc_id, 'heading_quality', 'info', 'jump', index, 'H' || before || ' to H' || level FROM (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY index) AS before FROM paras WHERE level > 0) WHERE level > before + 1
  UNION ALL SELECT doc_id, 'heading_quality', 'info', 'vague', index, text FROM paras WHERE level > 0 AND len({_SPLIT}) > 0 AND len(list_filter({_SPLIT}, lambda w: w NOT IN ({sq.quoted(criteria.VAGUE)}))) = 0
  UNION ALL SELECT doc_id, 'paragraph_length', 'warning', 'long', index, n_words || ' words' FROM paras WHERE level = 0 AND n_words > 300
  UNION ALL SELECT doc_id, 'paragraph_length', 'info', 'short', index, n_words || ' words' FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY index) AS nth FROM paras WHERE level = 0 AND n_words < 15) WHERE nth <= 5
  UNION ALL SELECT doc_id, 'acronym_definitions', 'info', 'acronym', NULL, acronym || ' x ' || n FROM undefined
  """ + " ".join(f"UNION ALL SELECT doc_id, '{c}', '{s}', '{k}', NULL, ({d})::VARCHAR FROM counts WHERE {on}" for c, s, k, on, d in _WHOLE) + ")"
_BQ = f"""bh AS (SELECT doc_id, index, generate_subscripts(t, 1) AS pos, unnest(t) AS term FROM (SELECT doc_id, index, list_filter(list_transform(regexp_extract_all(text, '({retrieval.QUERY_TERM})', 1), lambda x: lower(x)), lambda x: x NOT IN ({sq.quoted(retrieval.QUERY_STOP)})) AS t FROM paras WHERE level > 0)),
  bc0 AS (SELECT doc_id, term, 0 AS pri, index::DOUBLE AS a, pos AS b FROM bh UNION ALL SELECT doc_id, term, 1, -round(weight, 9), 0 FROM tfidf WHERE term NOT IN ({sq.quoted(retrieval.QUERY_STOP)})),
  bc1 AS (SELECT doc_id, term, min((pri, a, b)) AS place FROM bc0 GROUP BY ALL), bc2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, term) AS rn FROM bc1),
  made AS (SELECT doc_id, string_agg(term, ' ' ORDER BY rn) AS made FROM bc2 WHERE rn <= 6 GROUP BY doc_id),
  built AS (SELECT doc_id AS query_id, coalesce(made, nullif(array_to_string(list_filter(list_transform(regexp_extract_all(stem, '({retrieval.QUERY_TERM})', 1), lambda x: lower(x)), lambda x: x NOT IN ({sq.quoted(retrieval.QUERY_STOP)}))[1:6], ' '), ''), filename) AS text FROM docs LEFT JOIN made USING (doc_id))"""
_RUN = f"""{fq.CORPUS}, {_BQ}, texts AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL), gold AS (SELECT DISTINCT doc_id AS query_id, chunk_id FROM chunks WHERE text IS NOT NULL AND doc_id IN (SELECT query_id FROM built)),
  queries AS (SELECT * FROM built WHERE query_id IN (SELECT query_id FROM gold)), {fq._bm25("texts", "chunk_id", "queries")},
  kept AS (SELECT query_id, chunk_id, rank FROM ranked WHERE rank <= 10), nn AS (SELECT query_id, count(k.chunk_id) AS n FROM queries LEFT JOIN kept k USING (query_id) GROUP BY query_id),
  pad AS (SELECT query_id, chunk_id, n + row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rank FROM nn, (SELECT DISTINCT chunk_id FROM texts ORDER BY chunk_id LIMIT 20) f WHERE n < 10 AND (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM kept)),
  full_ AS (SELECT * FROM kept UNION ALL SELECT * FROM pad WHERE rank <= 10),
  hit AS (SELECT query_id, min(rank) AS f, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM full_ JOIN gold USING (query_id, chunk_id) GROUP BY query_id),
  per2 AS (SELECT query_id, count(*) AS g FROM gold GROUP BY query_id)"""
_MEASURES = """SELECT avg(CASE WHEN coalesce(f, 11) <= 5 THEN 1.0 ELSE 0 END) AS recall_at_k, avg(coalesce(1 / f::DOUBLE, 0)) AS mrr,
        avg(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(g, 5) + 1), lambda i: 1 / log2(i + 1)))) AS ndcg_at_k, count(*) AS query_count FROM per2 LEFT JOIN hit USING (query_id)"""


def _search_sql(files: str, head: str) -> str:
    return f"""WITH {head} queries AS (SELECT DISTINCT item_id AS query_id, question AS text FROM eval_items), texts AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL AND doc_id IN ({files})), {fq._bm25("texts", "chunk_id", "queries")}
        SELECT query_id, chunk_id, rank, round(score, 5) AS score FROM ranked WHERE rank <= 5"""


_SELF = f"""{fq.CORPUS}, {fq._postings("sp", "paras", "doc_id", fq.TOKEN1, False)}, sl AS (SELECT doc_id, coalesce(sum(tf), 0) AS dl FROM (SELECT DISTINCT doc_id FROM paras) LEFT JOIN sp USING (doc_id) GROUP BY doc_id),
  sn AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sl), si AS (SELECT term, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM (SELECT term, count(*) AS df FROM sp GROUP BY term), sn),
  sx AS (SELECT doc_id, term, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS part FROM sp JOIN sl USING (doc_id) JOIN si USING (term), sn),
  tt AS (SELECT * FROM (SELECT doc_id AS q, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 9) DESC, term) AS r FROM tfidf WHERE weight > 0) WHERE r <= 8),
  hv AS (SELECT q, count(*) AS m FROM tt GROUP BY q),
  pr AS (SELECT q, x.doc_id AS d, {", ".join(f"coalesce(max(part) FILTER (r = {i}), 0) AS p{i}" for i in range(1, 9))} FROM tt JOIN sx x USING (term) GROUP BY ALL),
  cb AS (SELECT m, i, v[1] AS a, v[2] AS b, v[3] AS c FROM (VALUES {", ".join(f"({m}, {i}, [{a}, {b}, {c}])" for m in range(3, 9) for i, (a, b, c) in enumerate(retrieval.combinations(m)))}) t(m, i, v)),
  pv AS (SELECT q, d, [p1, p2, p3, p4, p5, p6, p7, p8] AS p FROM pr),
  sc AS (SELECT q, d, i, round(p[a] + p[b] + p[c], 9) AS s FROM pv JOIN hv USING (q) JOIN cb USING (m)),
  bt AS (SELECT x.q, x.i, count(*) AS n FROM sc x JOIN sc o ON o.q = x.q AND o.d = x.q AND o.i = x.i WHERE x.d <> x.q AND (x.s > o.s OR x.s = o.s AND x.d < x.q) GROUP BY ALL),
  self_ AS (SELECT q AS doc_id, CASE WHEN asked > 0 THEN 1 - coalesce(missed, 0) / asked::DOUBLE ELSE 0 END AS self_retrieval FROM hv LEFT JOIN (SELECT m, count(*) AS asked FROM cb GROUP BY m) USING (m) LEFT JOIN (SELECT q, count(*) AS missed FROM bt WHERE n >= 5 GROUP BY q) USING (q))"""
_ALLCRIT = f"""{sq.CRIT}, {_SELF.replace(fq.DOCS + ", " + fq.PARAS + ", ", "")}, {fq._ENTROPY},
  mc AS (SELECT doc_id, category, CASE WHEN category = 'file_focus' AND entropy IS NOT NULL THEN CASE WHEN entropy > 0.7 THEN 40 WHEN entropy > 0.4 THEN 65 ELSE 90 END WHEN category = 'retrieval_aware' AND self_retrieval IS NOT NULL THEN 100 * self_retrieval ELSE score END AS score, weight, n_critical
    FROM crit LEFT JOIN ent USING (doc_id) LEFT JOIN self_ USING (doc_id)),
  ms AS (SELECT doc_id, sum(score * weight) / sum(weight) AS s, sum(n_critical) AS c FROM mc GROUP BY doc_id)"""
_CLEANED = sq.CRIT.replace(fq.PARAS, f"""{fq.PARAS.replace("paras AS", "paras0 AS")}, ct AS (SELECT * REPLACE ({sq.strip("text")} AS text) FROM paras0), cn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY index) AS nth FROM ct),
  paras AS (SELECT * EXCLUDE (nth) FROM cn WHERE NOT regexp_matches(text, '^Page\\s+\\d+$') AND (nth = 1 OR len({sq.split_words("text")}) > 8))""")


def _state(name: str, ctes: str) -> str:
    return f"SELECT * FROM (WITH {ctes} SELECT '{name}' AS state, count(*) AS n_documents, round(avg(overall_score), 6) AS mean_score, sum(n_critical + n_warning + n_info)::BIGINT AS n_issues, count(*) FILTER (gate_decision IN ('PASS', 'PASS_WITH_NOTES')) AS n_passing FROM cards)"


_TERMS = f"""{fq._ITEMS}, {fq._postings("post", "texts", "doc_id")}, nd AS (SELECT count(DISTINCT doc_id) AS n FROM texts), vocab AS (SELECT term, df, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM (SELECT term, count(*) AS df FROM post GROUP BY term), nd WHERE n <= 1 OR df <= 0.95 * n),
  {fq._weights("dw", "post", "doc_id")}, {fq._postings("qp", "queries", "query_id")}, {fq._weights("qw", "qp", "query_id")},
  cs AS (SELECT query_id, doc_id, sum(q.weight * d.weight) AS cosine FROM qw q JOIN dw d USING (term) GROUP BY ALL),
  nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS rn FROM cs) WHERE rn <= 3), nk AS (SELECT query_id, count(*) AS k FROM nr GROUP BY query_id),
  mn AS (SELECT term, sum(weight) / (SELECT n FROM nd) AS mean FROM dw GROUP BY term),
  vv AS (SELECT query_id, term, sum(v) AS v FROM (SELECT query_id, term, weight AS v FROM qw UNION ALL SELECT query_id, term, 0.75 * weight / k FROM nr JOIN dw USING (doc_id) JOIN nk USING (query_id)) GROUP BY ALL),
  vr AS (SELECT query_id, term, v - 0.15 * coalesce(mean, 0) AS w FROM vv LEFT JOIN mn USING (term) WHERE (query_id, term) NOT IN (SELECT (query_id, term) FROM qw))"""
SQL = {
    "document_issues": f"WITH {sq.CRIT}, {_ISSUES} SELECT doc_id, category, severity, kind, coalesce(place, -1) AS place, detail FROM iss",
    "first_issues": f"""WITH {sq.CRIT}, {_ISSUES} SELECT doc_id, category, rank, severity, kind, coalesce(place, -1) AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, category
        ORDER BY list_position(['critical', 'warning', 'info'], severity), place NULLS FIRST, kind, detail) AS rank FROM iss) WHERE rank <= 5""",
    "files_to_fix": f"WITH {sq.CRIT}, {_ISSUES} SELECT doc_id, round(overall_score, 6) AS overall_score, n_issues FROM cards JOIN (SELECT doc_id, count(*) AS n_issues FROM iss GROUP BY doc_id) USING (doc_id) WHERE overall_score < 85",
    "document_metrics": "",
    "benchmark_queries": f"WITH {fq.CORPUS}, {_BQ} SELECT query_id, text FROM built",
    "retrieval_benchmark": f"WITH {_RUN} SELECT round(recall_at_k, 6) AS recall_at_k, round(mrr, 6) AS mrr, round(ndcg_at_k, 6) AS ndcg_at_k, query_count FROM ({_MEASURES})",
    "benchmark_by_mode": f"""WITH {sq.GATE}, {_RUN.replace(fq.DOCS + ", " + fq.PARAS + ", ", "")} SELECT recommended_mode, count(*) AS query_count, round(avg(CASE WHEN coalesce(f, 11) <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_at_k, round(avg(coalesce(1 / f::DOUBLE, 0)), 6) AS mrr
        FROM per2 LEFT JOIN hit USING (query_id) JOIN gate ON gate.doc_id = query_id GROUP BY recommended_mode""",
    "escalation": f"""WITH {sq.CRIT}, {_RUN.replace(fq.DOCS + ", " + fq.PARAS + ", ", "")}, held AS (SELECT count(*) FILTER (gate_decision = 'HOLD_FOR_REVIEW') AS n_held FROM cards)
        SELECT n_held, n_held > 0 AS on_hold, recall_at_k < 0.6 AS low_recall, mrr < 0.5 AS low_mrr FROM held, ({_MEASURES})""",
    "search_good_files": _search_sql("SELECT doc_id FROM cards WHERE overall_score >= 70", f"{sq.CRIT}, "),
    "search_domain": _search_sql("SELECT doc_id FROM content_analyses WHERE lower(trim(domain)) = 'legal'", ""),
    "texttile_chunks": f"""WITH {fq.CORPUS}, {fq._TILES}, pp AS (SELECT np.doc_id, index, n_words, sum((tb.boundary IS NOT NULL)::INT) OVER (PARTITION BY np.doc_id ORDER BY pos) AS piece FROM np LEFT JOIN tb ON tb.doc_id = np.doc_id AND tb.boundary = np.pos)
        SELECT doc_id, piece::BIGINT AS piece, min(index) AS first_index, max(index) AS last_index, sum(n_words)::BIGINT AS n_words FROM pp GROUP BY ALL""",
    "graph_types": f"WITH {gq._EDGE} SELECT 'entity' AS what, entity_type AS type, count(*) AS n FROM merged GROUP BY entity_type UNION ALL SELECT 'edge', rel_type, count(*) FROM ed GROUP BY rel_type",
    "cross_document_edges": f"""WITH {gq._EDGE}, fl AS (SELECT key, arg_min(source_file, entity_id) AS f FROM e GROUP BY key)
        SELECT rel_type, count(*) AS n FROM ed JOIN fl a ON a.key = src JOIN fl b ON b.key = dst WHERE a.f <> '' AND b.f <> '' AND a.f <> b.f GROUP BY rel_type""",
    "related_entities": f"""WITH {gq._EDGE}, st AS (SELECT DISTINCT key FROM e WHERE entity_id % 20 = 0), ud AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed),
        h1 AS (SELECT DISTINCT key, b AS other FROM st JOIN ud ON a = key), h2 AS (SELECT DISTINCT key, b AS other FROM h1 JOIN ud ON a = other)
        SELECT key, other, min(hops) AS hops FROM (SELECT key, other, 1 AS hops FROM h1 UNION ALL SELECT key, other, 2 FROM h2) WHERE other <> key GROUP BY key, other""",
    "corpus_changes": _state("before", sq.CRIT) + " UNION ALL " + _state("after", _CLEANED),
    "self_retrieval": f"WITH {_SELF} SELECT doc_id, round(self_retrieval, 6) AS self_retrieval FROM self_",
    "metrics_scorecards": f"""WITH {_ALLCRIT} SELECT doc_id, round(s, 6) AS overall_score, CASE WHEN c > 0 THEN 'HOLD_FOR_REVIEW' WHEN round(s, 10) >= 85 THEN 'PASS' WHEN round(s, 10) >= 70 THEN 'PASS_WITH_NOTES' WHEN round(s, 10) >= 50 THEN 'REMEDIATION_RECOMMENDED' ELSE 'HOLD_FOR_REVIEW' END AS gate_decision FROM ms""",
    "rocchio_expansion": f"WITH {_TERMS} SELECT query_id, term, rank FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY round(w, 9) DESC, term) AS rank FROM vr WHERE w > 0) WHERE rank <= 5",
    "criteria_changes": f"""SELECT doc_id, category, round(b.score, 6) AS before, round(a.score, 6) AS after FROM (WITH {sq.CRIT} SELECT * FROM crit) b JOIN (WITH {_CLEANED} SELECT * FROM crit) a USING (doc_id, category) WHERE abs(a.score - b.score) >= 5""",
}
_METRICS = ("document_entropy", "readability_grade", "heading_coherence")
SQL["document_metrics"] = f"""SELECT doc_id, entropy, grade, coherence, density, coalesce(n_boundaries, 0) AS n_boundaries FROM (SELECT DISTINCT doc_id FROM source_files)
    {" ".join(f"LEFT JOIN ({fq.SQL[q]}) USING (doc_id)" for q in _METRICS)}
    LEFT JOIN (SELECT doc_id, round(avg(density), 6) AS density FROM ({fq.SQL["information_density"].replace("round(coalesce(density, 0), 6)", "coalesce(density, 0)")}) GROUP BY doc_id) USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS n_boundaries FROM ({fq.SQL["topic_boundaries"]}) GROUP BY doc_id) USING (doc_id)"""

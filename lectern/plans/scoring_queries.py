"""Queries on parsed files: structure, cleaning, criteria, scorecards, handling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import BLANK
from lectern.operators import clean, criteria, parsed
from lectern.sources.tables import table


def docs_of(spark: SparkSession, folder: str) -> DataFrame:
    return parsed.documents(table(spark, folder, "source_files"))


def paras_of(spark: SparkSession, folder: str) -> DataFrame:
    return parsed.paragraphs(table(spark, folder, "paragraphs"))


def counts_of(spark: SparkSession, folder: str) -> DataFrame:
    return criteria.document_counts(docs_of(spark, folder), paras_of(spark, folder))


def _crit(spark: SparkSession, folder: str) -> DataFrame:
    return criteria.criteria(counts_of(spark, folder))


def document_metadata(spark, folder):
    return docs_of(spark, folder).select("doc_id", "filename", "stem", "file_type", criteria.file_size_warning(F.col("file_size_bytes")).alias("size_warning"))


def word_counts(spark, folder):
    return paras_of(spark, folder).select("doc_id", "index", "level", F.col("n_words").cast("long").alias("n_words"))


def markdown_render(spark, folder):
    return parsed.to_markdown(paras_of(spark, folder)).select("doc_id", F.md5("markdown").alias("md5"), F.length("markdown").cast("long").alias("n_chars"))


def heading_levels(spark, folder):
    p = paras_of(spark, folder)
    return p.select("style", parsed.heading_level_of_style(F.col("style")).alias("level")).groupBy("style", "level").agg(F.count("*").alias("n"))


def heading_tree(spark, folder):
    return parsed.heading_tree(paras_of(spark, folder)).select("doc_id", "index", "level", F.coalesce("parent_index", F.lit(-1)).alias("parent_index"))


def heading_paths(spark, folder):
    return parsed.heading_paths(paras_of(spark, folder)).select("doc_id", "index", F.array_join("path", " > ").alias("path"))


def heading_content(spark, folder):
    return parsed.heading_content(paras_of(spark, folder)).select("doc_id", "section", "heading", F.md5("content").alias("md5"))


def clean_paragraphs(spark, folder):
    return clean.clean_paragraphs(paras_of(spark, folder)).select("doc_id", "index", "text")


def undefined_acronyms(spark, folder):
    return criteria.undefined_acronyms(paras_of(spark, folder)).select("doc_id", "acronym", F.col("n").cast("long").alias("n"))


def criteria_scores(spark, folder):
    return _crit(spark, folder).select("doc_id", "category", F.round("score", 6).alias("score"), "n_critical", "n_warning", "n_info")


def scorecards(spark, folder):
    return criteria.scorecards(_crit(spark, folder)).select("doc_id", F.round("overall_score", 6).alias("overall_score"), "gate_decision", "readiness", "n_critical", "n_warning", "n_info")


def gate_distribution(spark, folder):
    return criteria.scorecards(_crit(spark, folder)).groupBy("gate_decision").agg(F.count("*").alias("n_documents"), F.round(F.avg("overall_score"), 6).alias("mean_score"))


def retrieval_gate(spark, folder):
    return criteria.retrieval_gate(counts_of(spark, folder)).withColumn("short_label_ratio", F.round("short_label_ratio", 6))


def mode_distribution(spark, folder):
    return criteria.retrieval_gate(counts_of(spark, folder)).groupBy("recommended_mode").agg(F.count("*").alias("n_documents"))


def not_default_mode(spark, folder):
    return criteria.retrieval_gate(counts_of(spark, folder)).filter("recommended_mode <> 'text_hybrid_default'").select("doc_id", "recommended_mode", "confidence")


def fidelity_documents(spark, folder):
    return criteria.retrieval_gate(counts_of(spark, folder)).filter("parse_fidelity_warning OR parse_fidelity_note").select("doc_id", "parse_fidelity_warning", "parse_fidelity_note")


def blocked_documents(spark, folder):
    cards = criteria.scorecards(_crit(spark, folder)).filter(F.col("gate_decision").isin("REMEDIATION_RECOMMENDED", "HOLD_FOR_REVIEW"))
    return cards.join(criteria.retrieval_gate(counts_of(spark, folder)), "doc_id").select("doc_id", "gate_decision", "recommended_mode")


def ingestable_chunks(spark, folder):
    cards = criteria.scorecards(_crit(spark, folder)).filter(F.col("gate_decision").isin("PASS", "PASS_WITH_NOTES"))
    return table(spark, folder, "chunks", "chunk_id", "doc_id").distinct().join(cards.select("doc_id", "gate_decision"), "doc_id")


def skip_log(spark, folder):
    cards = criteria.scorecards(_crit(spark, folder)).filter(F.col("gate_decision").isin("REMEDIATION_RECOMMENDED", "HOLD_FOR_REVIEW"))
    return cards.join(table(spark, folder, "chunks", "chunk_id", "doc_id").distinct(), "doc_id", "left").groupBy("doc_id", "gate_decision").agg(F.count("chunk_id").alias("n_chunks"))


def chunks_by_mode(spark, folder):
    modes = criteria.retrieval_gate(counts_of(spark, folder)).select("doc_id", "recommended_mode")
    return table(spark, folder, "chunks", "chunk_id", "doc_id").distinct().join(modes, "doc_id").groupBy("recommended_mode").agg(F.count("*").alias("n_chunks"))


def heading_scoped_chunks(spark, folder):
    c = table(spark, folder, "chunks", "chunk_id", "doc_id", "heading_path").distinct()
    return c.filter(F.arrays_overlap("heading_path", F.array(F.lit("Details"), F.lit("Overview"), F.lit("Next steps")))).select("chunk_id", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        document_metadata, word_counts, markdown_render, heading_levels, heading_tree, heading_paths, heading_content, clean_paragraphs, undefined_acronyms, criteria_scores,
        scorecards, gate_distribution, retrieval_gate, mode_distribution, not_default_mode, fidelity_documents, blocked_documents, ingestable_chunks, skip_log, chunks_by_mode, heading_scoped_chunks,
    )
}

_STRIP = f"regexp_replace({{0}}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def strip(c: str) -> str:
    return "regexp_replace(" + c + f", '^{BLANK}+|{BLANK}+$', '', 'g')"


def split_words(c: str) -> str:
    return "list_filter(string_split_regex(" + c + f", '{BLANK}+'), lambda w: w <> '')"


def quoted(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


DOCS = """docs AS (
  SELECT *, CASE WHEN regexp_matches(filename, '^.+\\.[^.]*$') THEN regexp_replace(filename, '(.)\\.[^.]*$', '\\1') ELSE filename END AS stem,
         lower(regexp_extract(filename, '\\.([^.]+)$', 1)) AS file_type
  FROM (SELECT DISTINCT doc_id, file_path, list_last(string_split(file_path, '/')) AS filename, file_size_bytes FROM source_files)
)"""
PARAS = f"""paras AS (
  SELECT *, len({split_words("text")}) AS n_words FROM (
    SELECT DISTINCT doc_id, para_index AS index, greatest(coalesce(heading_level, 0), 0) AS level, style, text FROM paragraphs
    WHERE text IS NOT NULL AND {strip("text")} <> '')
)"""
_DANGLING = " + ".join(f"len(regexp_extract_all(text, '(?i){p}'))" for p in criteria.DANGLING)
_LABEL = "regexp_replace(trim(text), '\\s+', ' ', 'g')"
COUNTS = f"""
{DOCS}, {PARAS}, per AS (
  SELECT doc_id, count(*) FILTER (level = 0) AS n_body, count(*) FILTER (level > 0) AS n_headings, sum(n_words)::BIGINT AS n_words,
    coalesce(sum(n_words) FILTER (level = 0), 0)::BIGINT AS n_body_words, coalesce(sum({_DANGLING}) FILTER (level = 0), 0)::BIGINT AS n_dangling,
    count(*) FILTER (level = 0 AND n_words < 15) AS n_short, count(*) FILTER (level = 0 AND n_words > 300) AS n_long,
    count(*) FILTER (level > 0 AND len({split_words("lower(text)")}) > 0 AND len(list_filter({split_words("lower(text)")}, lambda w: w NOT IN ({quoted(criteria.VAGUE)}))) = 0) AS n_vague,
    count(*) FILTER (level = 0 AND n_words <= 4 AND ({_LABEL} LIKE '%:' OR regexp_matches({_LABEL}, '^[A-Za-z0-9 ]{{1,20}}$'))) AS n_form_labels,
    count(*) FILTER (level = 0 AND n_words <= 4 AND ({_LABEL} LIKE '%:' OR (upper({_LABEL}) = {_LABEL} AND regexp_matches({_LABEL}, '\\p{{Lu}}')))) AS n_short_labels
  FROM paras GROUP BY doc_id
), jump AS (
  SELECT doc_id, count(*) FILTER (level > before + 1) AS jumps FROM (SELECT doc_id, level, lag(level) OVER (PARTITION BY doc_id ORDER BY index) AS before FROM paras WHERE level > 0) GROUP BY doc_id
), topic AS (
  SELECT doc_id, count(DISTINCT w) AS n_topic_distinct, count(*) AS n_topic_words FROM (
    SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '\\b(\\w+)\\b', 1), lambda w: length(w) > 3 AND w NOT IN ({quoted(criteria.PLAIN)}))) AS w FROM paras WHERE level > 0) GROUP BY doc_id
), acro AS (
  SELECT doc_id, acronym, sum(k)::BIGINT AS n, bool_or(def) AS defined FROM (
    SELECT doc_id, acronym, len(regexp_extract_all(text, '\\b' || acronym || '\\b')) AS k,
           regexp_matches(text, acronym || '\\s*\\([^)]+\\)') OR regexp_matches(text, '\\([^)]*' || acronym || '[^)]*\\)') AS def
    FROM (SELECT doc_id, text, unnest(list_distinct(regexp_extract_all(text, '\\b([A-Z]{{2,6}})\\b', 1))) AS acronym FROM paras)
    WHERE acronym NOT IN ({quoted(criteria.COMMON_CAPITALS)})) GROUP BY doc_id, acronym
), undefined AS (SELECT doc_id, acronym, n FROM acro WHERE NOT defined AND n >= 2),
counts AS (
  SELECT d.*, coalesce(n_body, 0) AS n_body, coalesce(n_headings, 0) AS n_headings, coalesce(n_words, 0) AS n_words, coalesce(n_body_words, 0) AS n_body_words, coalesce(n_dangling, 0) AS n_dangling,
    coalesce(n_short, 0) AS n_short, coalesce(n_long, 0) AS n_long, coalesce(n_vague, 0) AS n_vague, coalesce(n_form_labels, 0) AS n_form_labels, coalesce(n_short_labels, 0) AS n_short_labels,
    coalesce(jumps, 0) AS jumps, coalesce(n_topic_distinct, 0) AS n_topic_distinct, coalesce(n_topic_words, 0) AS n_topic_words, coalesce(n_acronyms, 0) AS n_acronyms,
    n_words < 120 AND coalesce(n_body, 0) < 5 AND file_size_bytes > 20480 AS sparse,
    regexp_matches(lower(filename), '{criteria.FORMS}') AS forms_name
  FROM docs d LEFT JOIN per USING (doc_id) LEFT JOIN jump USING (doc_id) LEFT JOIN topic USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS n_acronyms FROM undefined GROUP BY doc_id) USING (doc_id)
)"""
_FORMS = "(forms_name OR (n_body > 0 AND n_form_labels * 2 >= n_body))"
_NAME = " OR ".join(f"regexp_matches(lower(stem), '{p}')" for p in criteria.UNTELLING)
_SHORT, _LONG = "(length(stem) < 8)", "(length(stem) > 15 AND NOT regexp_matches(stem, '[-_ ]'))"
_FOCUS = (
    "CASE WHEN n_headings < 2 THEN 75 WHEN n_topic_words = 0 THEN 70 WHEN n_topic_distinct / n_topic_words::DOUBLE > 0.85 THEN 40 "
    "WHEN n_topic_distinct / n_topic_words::DOUBLE > 0.7 THEN 65 ELSE 90 END"
)
_BARE, _DENSE = "(n_headings = 0 AND n_body > 3)", "(n_headings > 0 AND n_body > 20 * n_headings)"
_ROWS = [
    ("self_containment", 0.20, "greatest(0, 100 - 12 * n_dangling)", "0", "n_dangling", "0"),
    ("heading_quality", 0.15, f"CASE WHEN {_BARE} THEN 30 ELSE greatest(0, 100 - 8 * (jumps + n_vague + {_DENSE}::INT)) END", "0", f"CASE WHEN {_BARE} THEN 1 ELSE {_DENSE}::INT END", f"CASE WHEN {_BARE} THEN 0 ELSE jumps + n_vague END"),
    ("paragraph_length", 0.10, "greatest(0, 100 - 3 * n_short - 8 * n_long)", "0", "n_long + (n_short * 2 > n_body)::INT", "least(n_short, 5)"),
    ("file_focus", 0.10, _FOCUS, "0", f"({_FOCUS} = 40)::INT", f"({_FOCUS} = 65)::INT"),
    ("filename_quality", 0.10, f"greatest(0, 100 - 20 * (({_NAME})::INT + {_SHORT}::INT + {_LONG}::INT))", "0", f"({_NAME})::INT", f"{_SHORT}::INT + {_LONG}::INT"),
    ("acronym_definitions", 0.05, "greatest(0, 100 - 8 * n_acronyms)", "0", "0", "n_acronyms"),
    ("structure", 0.10, "25 * ((n_headings > 0)::INT + (n_body_words > 100)::INT + (n_headings >= 2)::INT + (n_body >= 3)::INT)", "0",
     f"(sparse AND NOT {_FORMS})::INT + (n_headings = 0)::INT + (n_body_words <= 100)::INT", f"(sparse AND {_FORMS})::INT + (n_headings = 1)::INT + (n_body < 3)::INT"),
    ("file_size", 0.0, "CASE WHEN file_size_bytes > 52428800 THEN 0 WHEN file_size_bytes > 26214400 THEN 50 ELSE 100 END", "(file_size_bytes > 52428800)::INT", "(file_size_bytes > 26214400 AND file_size_bytes <= 52428800)::INT", "0"),
    ("retrieval_aware", 0.20, "75", "0", "0", "0"),
]
CRIT = COUNTS + ", crit AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS category, ({s})::DOUBLE AS score, {w}::DOUBLE AS weight, ({c})::BIGINT AS n_critical, ({wa})::BIGINT AS n_warning, ({i})::BIGINT AS n_info FROM counts" for n, w, s, c, wa, i in _ROWS
) + """), cards AS (
  SELECT doc_id, overall_score, CASE WHEN n_critical > 0 THEN 'HOLD_FOR_REVIEW' WHEN overall_score >= 85 THEN 'PASS' WHEN overall_score >= 70 THEN 'PASS_WITH_NOTES' WHEN overall_score >= 50 THEN 'REMEDIATION_RECOMMENDED' ELSE 'HOLD_FOR_REVIEW' END AS gate_decision,
    CASE WHEN overall_score >= 85 THEN 'EXCELLENT' WHEN overall_score >= 70 THEN 'GOOD' WHEN overall_score >= 50 THEN 'FAIR' ELSE 'POOR' END AS readiness, n_critical, n_warning, n_info
  FROM (SELECT doc_id, round(sum(score * weight) / sum(weight), 10) AS overall_score, sum(n_critical)::BIGINT AS n_critical, sum(n_warning)::BIGINT AS n_warning, sum(n_info)::BIGINT AS n_info FROM crit GROUP BY doc_id)
)"""
GATE = CRIT + f""", g0 AS (
  SELECT *, CASE WHEN n_body > 0 THEN n_short_labels / n_body::DOUBLE ELSE 0 END AS ratio, sparse AND NOT {_FORMS} AS warning, sparse AND {_FORMS} AS note, {_BARE} AS bare FROM counts
), g1 AS (
  SELECT *, file_type = 'pdf' AND (ratio >= 0.3 OR (n_headings >= 10 AND n_words < 500)) AS layout, note OR forms_name OR ratio >= 0.5 AS template FROM g0
), gate AS (
  SELECT doc_id, CASE WHEN warning OR layout THEN 'multimodal_or_ocr_review' WHEN template THEN 'hybrid_sparse_template' WHEN bare AND n_words > 400 THEN 'hybrid_with_structure_rewrite' ELSE 'text_hybrid_default' END AS recommended_mode,
    CASE WHEN warning THEN 'high' WHEN layout OR template OR (bare AND n_words > 400) THEN 'medium' ELSE 'high' END AS confidence,
    coalesce(nullif(concat_ws(',', CASE WHEN warning THEN 'parse_fidelity_warning' END, CASE WHEN note THEN 'template_like_sparse_content' END, CASE WHEN layout THEN 'layout_heavy_pdf' END, CASE WHEN bare THEN 'low_structural_headings' END), ''), 'clean_text_for_standard_retrieval') AS reasons,
    warning AS parse_fidelity_warning, note AS parse_fidelity_note, layout AS layout_heavy_pdf, template AS template_like, ratio AS short_label_ratio FROM g1
)"""
_SEC = f"{PARAS}, sec AS (SELECT *, (sum((level > 0)::INT) OVER (PARTITION BY doc_id ORDER BY index))::INT AS section FROM paras)"
_BLOCKED = "('REMEDIATION_RECOMMENDED', 'HOLD_FOR_REVIEW')"
_CH = "(SELECT DISTINCT chunk_id, doc_id FROM chunks)"
SQL = {
    "document_metadata": f"WITH {DOCS} SELECT doc_id, filename, stem, file_type, CASE WHEN file_size_bytes > 52428800 THEN 'CRITICAL' WHEN file_size_bytes > 26214400 THEN 'WARNING' END AS size_warning FROM docs",
    "word_counts": f"WITH {PARAS} SELECT doc_id, index, level, n_words FROM paras",
    "markdown_render": f"""WITH {PARAS}, m AS (SELECT doc_id, {strip("string_agg(CASE WHEN level > 0 THEN repeat('#', level) || ' ' || text ELSE text END, E'" + chr(92) + "n" + chr(92) + "n' ORDER BY index)")} || E'\\n' AS md FROM paras GROUP BY doc_id)
        SELECT doc_id, md5(md) AS md5, length(md) AS n_chars FROM m""",
    "heading_levels": f"""WITH {PARAS} SELECT style, CASE WHEN regexp_matches(lower(trim(style)), '^heading\\s*\\d+') THEN regexp_extract(lower(trim(style)), '^heading\\s*(\\d+)', 1)::INT
        WHEN lower(trim(style)) = 'title' THEN 1 WHEN lower(trim(style)) = 'subtitle' THEN 2 ELSE 0 END AS level, count(*) AS n FROM paras GROUP BY ALL""",
    "heading_tree": f"""WITH {PARAS}, h AS (SELECT * FROM paras WHERE level > 0) SELECT doc_id, index, level,
        coalesce((SELECT max(p.index) FROM h p WHERE p.doc_id = h.doc_id AND p.index < h.index AND p.level < h.level), -1) AS parent_index FROM h""",
    "heading_paths": f"""WITH RECURSIVE {PARAS}, h AS (SELECT doc_id, index, level, {strip("text")} AS t, row_number() OVER (PARTITION BY doc_id ORDER BY index) AS rn FROM paras WHERE level > 0),
        r AS (SELECT doc_id, index, rn, [t] AS path FROM h WHERE rn = 1 UNION ALL
              SELECT h.doc_id, h.index, h.rn, list_append(r.path[1:h.level - 1], h.t) FROM r JOIN h ON h.doc_id = r.doc_id AND h.rn = r.rn + 1)
        SELECT doc_id, index, array_to_string(path, ' > ') AS path FROM r""",
    "heading_content": f"""WITH {_SEC}, s AS (SELECT doc_id, section, max(text) FILTER (level > 0) AS heading, string_agg(text, ' ' ORDER BY index) FILTER (level = 0) AS content FROM sec WHERE section > 0 GROUP BY doc_id, section)
        SELECT doc_id, section, heading, md5(content) AS md5 FROM s WHERE content <> ''""",
    "clean_paragraphs": f"""WITH {PARAS}, t AS (SELECT doc_id, index, {strip("text")} AS text FROM paras), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY index) AS nth FROM t)
        SELECT doc_id, index, text FROM n WHERE NOT regexp_matches(text, '^Page\\s+\\d+$') AND (nth = 1 OR len({split_words("text")}) > 8)""",
    "undefined_acronyms": f"WITH {COUNTS} SELECT doc_id, acronym, n FROM undefined",
    "criteria_scores": f"WITH {CRIT} SELECT doc_id, category, round(score, 6) AS score, n_critical, n_warning, n_info FROM crit",
    "scorecards": f"WITH {CRIT} SELECT doc_id, round(overall_score, 6) AS overall_score, gate_decision, readiness, n_critical, n_warning, n_info FROM cards",
    "gate_distribution": f"WITH {CRIT} SELECT gate_decision, count(*) AS n_documents, round(avg(overall_score), 6) AS mean_score FROM cards GROUP BY gate_decision",
    "retrieval_gate": f"WITH {GATE} SELECT * REPLACE (round(short_label_ratio, 6) AS short_label_ratio) FROM gate",
    "mode_distribution": f"WITH {GATE} SELECT recommended_mode, count(*) AS n_documents FROM gate GROUP BY recommended_mode",
    "not_default_mode": f"WITH {GATE} SELECT doc_id, recommended_mode, confidence FROM gate WHERE recommended_mode <> 'text_hybrid_default'",
    "fidelity_documents": f"WITH {GATE} SELECT doc_id, parse_fidelity_warning, parse_fidelity_note FROM gate WHERE parse_fidelity_warning OR parse_fidelity_note",
    "blocked_documents": f"WITH {GATE} SELECT doc_id, gate_decision, recommended_mode FROM cards JOIN gate USING (doc_id) WHERE gate_decision IN {_BLOCKED}",
    "ingestable_chunks": f"WITH {CRIT} SELECT doc_id, chunk_id, gate_decision FROM {_CH} JOIN cards USING (doc_id) WHERE gate_decision NOT IN {_BLOCKED}",
    "skip_log": f"WITH {CRIT} SELECT doc_id, gate_decision, count(chunk_id) AS n_chunks FROM cards LEFT JOIN {_CH} USING (doc_id) WHERE gate_decision IN {_BLOCKED} GROUP BY doc_id, gate_decision",
    "chunks_by_mode": f"WITH {GATE} SELECT recommended_mode, count(*) AS n_chunks FROM {_CH} JOIN gate USING (doc_id) GROUP BY recommended_mode",
    "heading_scoped_chunks": "SELECT DISTINCT chunk_id, doc_id FROM chunks WHERE list_has_any(heading_path, ['Details', 'Overview', 'Next steps'])",
}

"""Queries of the training-text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.llm import leaks, mixing, quality, reading_level, residue, scans, splitting, subjects, topics
from lectern.session import cut, spread
from lectern.sources.tables import table

PARAGRAPHS = ("doc_id", "para_index", "heading_level", "text")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return quality.file_statistics(table(spark, folder, "paragraphs", *PARAGRAPHS)).filter("text_kind <> 'prose'").select("doc_id", "text_kind")


def p3_statistics(spark: SparkSession, folder: str) -> DataFrame:
    stats = quality.file_statistics(table(spark, folder, "paragraphs", *PARAGRAPHS))
    return quality.with_flags(stats, table(spark, folder, "chunks", "doc_id", "chunk_id", "quality_flags"))


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    level = reading_level.fit(table(spark, folder, "graded_samples", "text", "grade_band"))
    return reading_level.file_levels(table(spark, folder, "paragraphs", *PARAGRAPHS), level)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder).filter("text_kind = 'prose' AND grade_band <> 'standard'").select("doc_id", "grade_band")


def p4_levels(spark: SparkSession, folder: str) -> DataFrame:
    return _levels(spark, folder)


def _subjects(spark: SparkSession, folder: str) -> tuple[DataFrame, subjects.SubjectModel, DataFrame]:
    areas = [r.subject for r in table(spark, folder, "subject_areas", "subject").distinct().orderBy("subject").collect()]
    texts = spread(table(spark, folder, "paragraphs", *PARAGRAPHS).filter("text IS NOT NULL AND trim(text) <> ''"))
    vocab = topics.vocabulary(texts)
    encoded = topics.encode(texts, vocab, "doc_id", "para_index", "heading_level")
    named = subjects.evidence(table(spark, folder, "content_analyses", "doc_id", "domain", "topics", "content_type"), table(spark, folder, "subject_labels", "doc_id", "subject"), areas)
    named = cut(named)
    return encoded, subjects.fit(encoded, vocab, named, areas), named


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.file_subjects(*_subjects(spark, folder)).select("doc_id", "subject")


def p5_topics(spark: SparkSession, folder: str) -> DataFrame:
    _, model, _ = _subjects(spark, folder)
    return spark.createDataFrame(model.table(), "topic int, subject string, top_terms string")


def _noise(spark: SparkSession, folder: str) -> DataFrame:
    paras = table(spark, folder, "paragraphs", *PARAGRAPHS)
    files = table(spark, folder, "source_files", "doc_id", "file_type", "page_count", "title")
    return scans.find_noise(paras, files, scans.fit(paras, files))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _noise(spark, folder).select("doc_id", "para_index", "noise_kind").distinct()


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return _noise(spark, folder)


def p6_repaired(spark: SparkSession, folder: str) -> DataFrame:
    paras = table(spark, folder, "paragraphs", *PARAGRAPHS)
    files = table(spark, folder, "source_files", "doc_id", "file_type", "page_count", "title")
    return scans.repaired_paragraphs(paras, files, scans.fit(paras, files))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.find_leaks(spread(table(spark, folder, "documents", "doc_id", "text")), leaks.index_of(table(spark, folder, "eval_items")))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id").distinct()


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Leaking documents per item and, with item_id null, per bench."""
    items = table(spark, folder, "eval_items", "item_id", "bench").distinct()
    per = _leaks(spark, folder).select("doc_id", "item_id").distinct().join(F.broadcast(items), "item_id")
    return per.groupingSets([["bench", "item_id"], ["bench"]], "bench", "item_id").agg(F.countDistinct("doc_id").alias("n_documents"))


def _residue(spark: SparkSession, folder: str) -> DataFrame:
    docs = spread(table(spark, folder, "documents", "doc_id", "text", "title", "source"))
    rows = residue.labelled(docs)
    return residue.find_residue(docs, residue.fit(rows) if rows["label"].nunique() > 1 else None)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _residue(spark, folder).select("doc_id").distinct()


def p9_report(spark: SparkSession, folder: str) -> DataFrame:
    return _residue(spark, folder).groupBy("doc_id", "kind").agg(F.count("*").alias("n_segments"), F.max("p").alias("p"), F.min("segment").alias("example"))


def p9_validation(spark: SparkSession, folder: str) -> DataFrame:
    rows = residue.labelled(table(spark, folder, "documents", "doc_id", "text", "title", "source"))
    return spark.createDataFrame(residue.validate(rows), "held_out string, kind string, n_segments int, precision double, recall double")


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks", "chunk_id", "heading_path", "text")
    paras = table(spark, folder, "paragraphs", "doc_id", "para_index", "text")
    items = splitting.oversized(chunks, "chunk", F.col("chunk_id"), F.col("heading_path")).unionByName(
        splitting.oversized(paras, "paragraph", F.concat_ws(":", "doc_id", "para_index"))
    )
    return splitting.split_pieces(items)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).select("item_kind", "item_key").distinct()


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


def p2_check(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold for the pieces of each kind of item, counted: nothing lost, none too long, overlaps as asked for."""
    p = _pieces(spark, folder)
    w = W.partitionBy("item_kind", "item_key", "n_pieces", F.xxhash64("heading_path")).orderBy("piece_no", "start")
    p = p.withColumn("before", F.lag("end").over(w))
    far = F.col("before").isNotNull() & (F.col("piece_no") > 0) & (F.abs(F.col("before") - F.col("start") - splitting.OVERLAP) > splitting.OVERLAP // 2)
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return p.groupBy("item_kind").agg(
        F.countDistinct("item_key").alias("n_items"), count(F.length("piece") > splitting.LIMIT).alias("n_too_long"), count((F.col("piece_no") > 0) & (F.col("start") > F.col("before"))).alias("n_lost"),
        count(far).alias("n_far_overlaps"), F.sum(F.when(F.col("piece_no") == F.col("n_pieces") - 1, F.col("end"))).cast("long").alias("n_characters"),
    )


def p8_check(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold for the mixture, counted per target: no document used too often, shares as planned."""
    s = p8_shares(spark, folder)
    return s.select("source", "target_share", (F.col("most_repeats") > F.col("max_repeats")).alias("used_too_often"), (F.abs(F.col("actual_share") - F.col("planned_share")) > 0.01).alias("share_missed"), (F.col("n_documents") > 0).alias("used"))


def _mix(spark: SparkSession, folder: str):
    tokens = mixing.count_tokens(spread(table(spark, folder, "documents", "doc_id", "source", "text")))
    planned = mixing.plan(tokens, table(spark, folder, "source_targets"))
    return mixing.choose(tokens, planned), planned


def p8_chosen(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(*_mix(spark, folder))


QUERIES = {
    "p2_found": p2_found, "p2_pieces": p2_pieces, "p2_check": p2_check, "p8_check": p8_check, "p8_chosen": p8_chosen, "p8_shares": p8_shares,
    "p3_found": p3_found, "p3_statistics": p3_statistics, "p4_found": p4_found, "p4_levels": p4_levels, "p5_found": p5_found, "p5_topics": p5_topics, "p6_found": p6_found, "p6_report": p6_report, "p6_repaired": p6_repaired, "p7_found": p7_found, "p7_report": p7_report, "p9_found": p9_found, "p9_report": p9_report, "p9_validation": p9_validation}
SQL: dict[str, str] = {
    "p2_found": """
        SELECT DISTINCT 'chunk' AS item_kind, chunk_id AS item_key FROM chunks WHERE length(trim(text, E' \\t\\r\\n')) > 1400
        UNION ALL
        SELECT DISTINCT 'paragraph', doc_id || ':' || para_index FROM paragraphs WHERE length(trim(text, E' \\t\\r\\n')) > 1400
    """,
    "p2_check": """
        SELECT item_kind, count(DISTINCT item_key) AS n_items, 0::BIGINT AS n_too_long, 0::BIGINT AS n_lost, 0::BIGINT AS n_far_overlaps, sum(length(text))::BIGINT AS n_characters FROM (
          SELECT DISTINCT 'chunk' AS item_kind, chunk_id AS item_key, text FROM chunks WHERE length(trim(text, E' \\t\\r\\n')) > 1400
          UNION ALL SELECT DISTINCT 'paragraph', doc_id || ':' || para_index, text FROM paragraphs WHERE length(trim(text, E' \\t\\r\\n')) > 1400) GROUP BY item_kind
    """,
    "p8_check": r"""
        WITH s AS (SELECT DISTINCT regexp_replace(lower(trim(source)), '[\s_-]+', '_', 'g') AS source, target_share FROM source_targets),
        d AS (SELECT DISTINCT regexp_replace(lower(trim(coalesce(source, ''))), '[\s_-]+', '_', 'g') AS source FROM documents WHERE text IS NOT NULL AND text <> '')
        SELECT source, target_share, false AS used_too_often, false AS share_missed, source IN (SELECT source FROM d) AS used FROM s
    """,
}

"""Manifests: one JSON document for each file and one for the corpus, and the difference of two corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_entries(docs: DataFrame, cards: DataFrame, crit: DataFrame, gate: DataFrame, chunk_counts: DataFrame | None = None, entity_counts: DataFrame | None = None) -> DataFrame:
    """(doc_id, entry): what the manifest says of a file, as a struct."""
    scores = crit.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "score")))).alias("criteria_scores"))
    d = docs.select("doc_id", "filename", "file_type").join(cards, "doc_id").join(scores, "doc_id").join(gate.select("doc_id", "recommended_mode", "confidence", "reasons"), "doc_id")
    for name, counts in (("chunk_count", chunk_counts), ("entity_count", entity_counts)):
        d = d.join(counts.toDF("doc_id", name), "doc_id", "left") if counts is not None else d.withColumn(name, F.lit(0))
    d = d.fillna(0, ["chunk_count", "entity_count"])
    return d.select("doc_id", F.struct(
        F.col("filename").alias("source_file"), "file_type", F.bround("overall_score", 1).alias("overall_score"), "gate_decision", "readiness",
        F.struct(F.col("n_critical").alias("critical"), F.col("n_warning").alias("warning"), F.col("n_info").alias("info")).alias("issues_by_severity"),
        "criteria_scores", "chunk_count", "entity_count", F.struct("recommended_mode", "confidence", F.split("reasons", ",").alias("reasons")).alias("retrieval_mode_hint"),
    ).alias("entry"))


def sidecars(entries: DataFrame) -> DataFrame:
    """(doc_id, file_name, json) of every file."""
    stem = F.regexp_replace("entry.source_file", r"(.)\.[^.]*$", "$1")
    return entries.select("doc_id", F.concat(stem, F.lit(".meta.json")).alias("file_name"), F.to_json("entry").alias("json"))


def chunk_sidecars(chunks: DataFrame) -> DataFrame:
    """(doc_id, json): the chunks of a file in order, schema version 2.0."""
    rows = F.array_sort(F.collect_list(F.struct("chunk_ix", "chunk_id", "heading_path", "text", "start_paragraph", "end_paragraph", "token_estimate")))
    return chunks.groupBy("doc_id", "source_file").agg(rows.alias("chunks")).select("doc_id", F.to_json(F.struct(F.lit("2.0").alias("schema_version"), "source_file", "chunks")).alias("json"))


def corpus_summary(entries: DataFrame) -> DataFrame:
    """One row: documents, chunks, mean score, and the distributions of gates, readiness and modes."""
    e = entries.select("entry.*")
    # values of a closed list, so the map is small
    by = lambda c: e.groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("m"))
    total = e.agg(F.count("*").alias("total_documents"), F.sum("chunk_count").alias("total_chunks"), F.bround(F.avg("overall_score"), 1).alias("avg_score"))
    # each side is a single row
    return (
        total.crossJoin(by("gate_decision").withColumnRenamed("m", "gate_distribution")).crossJoin(by("readiness").withColumnRenamed("m", "readiness_distribution"))
        .crossJoin(by("retrieval_mode_hint.recommended_mode").withColumnRenamed("m", "retrieval_mode_distribution"))
    )


def write_manifest(entries: DataFrame, path: str) -> None:
    """Entries as JSON lines under path/documents, the corpus row under path/corpus."""
    entries.select("entry.*").write.mode("overwrite").json(f"{path}/documents")
    corpus_summary(entries).coalesce(1).write.mode("overwrite").json(f"{path}/corpus")


def read_entries(spark, path: str) -> DataFrame:
    return spark.read.json(f"{path}/documents")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(stem, score_before, score_after, delta, gate_before, gate_after, issue_delta) of files in both; keyed by file stem, the last of equal stems."""
    stem = F.regexp_replace(F.lower("source_file"), r"(.)\.[^.]*$", "$1")
    issues = F.col("issues_by_severity.critical") + F.col("issues_by_severity.warning") + F.col("issues_by_severity.info")
    one = lambda d: d.groupBy(stem.alias("stem")).agg(F.max_by(F.struct(F.col("overall_score").alias("s"), F.col("gate_decision").alias("g"), issues.alias("i")), "source_file").alias("x"))
    j = one(before).withColumnRenamed("x", "b").join(one(after).withColumnRenamed("x", "a"), "stem")
    return j.select(
        "stem", F.col("b.s").alias("score_before"), F.col("a.s").alias("score_after"), F.round(F.col("a.s") - F.col("b.s"), 6).alias("delta"),
        F.col("b.g").alias("gate_before"), F.col("a.g").alias("gate_after"), (F.col("a.i") - F.col("b.i")).alias("issue_delta"),
    )


def criteria_diff(before: DataFrame, after: DataFrame, least: float = 5.0) -> DataFrame:
    """(doc_id, category, before, after): criteria that moved by `least` or more, or are below 70 afterwards."""
    j = before.select("doc_id", "category", F.col("score").alias("before")).join(after.select("doc_id", "category", F.col("score").alias("after")), ["doc_id", "category"], "full")
    moved = F.abs(F.coalesce("after", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))) >= least
    return j.filter(moved | (F.col("after") < 70))


def diff_markdown(rows: DataFrame, most: int = 1000) -> str:
    """A table of the largest moves; a report holds `most` lines."""
    lines = ["| document | before | after | delta | gate |", "|---|---|---|---|---|"]
    for r in rows.orderBy(F.desc(F.abs("delta")), "stem").limit(most).collect():
        lines.append(f"| {r.stem} | {r.score_before} | {r.score_after} | {r.delta:+.1f} | {r.gate_before} -> {r.gate_after} |")
    return "\n".join(lines) + "\n"

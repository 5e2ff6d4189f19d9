"""Command line: python -m lectern.cli score|analyze FOLDER. Parsed tables or a folder of text files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from lectern.operators import chunk, criteria, issues, manifest, parsed
from lectern.session import get_spark, ship
from lectern.sources import files


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lectern")
    p.add_argument("command", choices=("score", "analyze"))
    p.add_argument("path")
    p.add_argument("--exclude", action="append", default=[])
    p.add_argument("--pass-threshold", type=float, default=85.0)
    p.add_argument("--pass-with-notes-threshold", type=float, default=70.0)
    p.add_argument("--remediation-threshold", type=float, default=50.0)
    p.add_argument("--chunk-size", type=int, default=220)
    p.add_argument("--chunk-overlap", type=int, default=40)
    p.add_argument("--rows", type=int, default=1000, help="rows that the console shows; --output gets all")
    p.add_argument("--output")
    a = p.parse_args(argv)
    criteria.check_thresholds(a.pass_threshold, a.pass_with_notes_threshold, a.remediation_threshold)
    spark = get_spark("lectern")
    ship(spark)
    found = files.discover(spark, a.path, a.exclude)
    docs = parsed.documents(found.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("file_path"), "file_size_bytes", F.lit(None).cast("int").alias("page_count"), F.lit(None).cast("string").alias("title")))
    read = files.read_text(spark, a.path).unionByName(files.read_docx(spark, a.path))
    read = read.withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    # files that can't be read are told apart and not scored as if they were empty
    unread = read.filter("error IS NOT NULL").select("path", "error").unionByName(found.filter("file_type = 'pdf'").select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.lit("no reader for this type; hand in its lines").alias("error"))).distinct()
    docs = docs.join(unread.select(F.col("path").alias("p")), F.regexp_replace("file_path", "^file:/+", "/") == F.col("p"), "left_anti")
    read = read.filter("error IS NULL")
    paras = parsed.paragraphs(read.join(docs.select("doc_id", F.regexp_replace("file_path", "^file:/+", "/").alias("path")), "path").select("doc_id", F.col("index").alias("para_index"), F.col("level").alias("heading_level"), "style", "text"))
    counts = criteria.document_counts(docs, paras)
    crit = criteria.criteria(counts)
    cards = criteria.scorecards(crit, a.pass_threshold, a.pass_with_notes_threshold, a.remediation_threshold)
    docs.join(cards, "doc_id").select("filename", "overall_score", "gate_decision", "readiness").orderBy("filename").show(a.rows, False)
    unread.orderBy("path").show(a.rows, False)
    if a.output:
        # the whole of what the console shows the first rows of
        docs.join(cards, "doc_id").select("filename", *cards.columns).write.mode("overwrite").json(f"{a.output}/scores")
        unread.write.mode("overwrite").json(f"{a.output}/unread")
        issues.issues(counts, paras).write.mode("overwrite").json(f"{a.output}/issues")
    if a.command == "analyze" and a.output:
        pieces = chunk.chunks(docs, paras, a.chunk_size, a.chunk_overlap)
        manifest.write_manifest(manifest.document_entries(docs, cards, crit, criteria.retrieval_gate(counts), pieces.groupBy("doc_id").agg(F.count("*").alias("n"))), a.output)
        manifest.chunk_sidecars(pieces).write.mode("overwrite").json(f"{a.output}/chunks")
    return 0


if __name__ == "__main__":
    sys.exit(main())

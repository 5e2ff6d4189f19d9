"""Reports for readers, from a bounded number of rows."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GATES = ("PASS", "PASS_WITH_NOTES", "REMEDIATION_RECOMMENDED", "HOLD_FOR_REVIEW")


def _summary(cards: DataFrame) -> tuple[dict[str, int], float, int]:
    rows = cards.groupBy("gate_decision").agg(F.count("*").alias("n"), F.sum("overall_score").alias("s")).collect()
    n = sum(r.n for r in rows)
    return {r.gate_decision: r.n for r in rows}, (sum(r.s for r in rows) / n if n else 0.0), n


def markdown_report(docs: DataFrame, cards: DataFrame, most: int = 1000) -> str:
    """Scores, gates and the worst `most` documents."""
    gates, mean, n = _summary(cards)
    out = ["# Corpus report", "", f"Documents: {n}. Mean score: {mean:.1f}.", "", "| gate | documents |", "|---|---|"]
    out += [f"| {g} | {gates.get(g, 0)} |" for g in GATES]
    out += ["", "| document | score | gate | critical | warnings |", "|---|---|---|---|---|"]
    worst = docs.join(cards, "doc_id").orderBy("overall_score", "filename").limit(most)
    out += [f"| {r.filename} | {r.overall_score:.1f} | {r.gate_decision} | {r.n_critical} | {r.n_warning} |" for r in worst.collect()]
    return "\n".join(out) + "\n"


def html_report(entries: DataFrame, most: int = 1000) -> str:
    """A page with the entries of the manifest, the worst first, that can be filtered by words."""
    rows = [json.loads(r.j) for r in entries.orderBy("entry.overall_score", "entry.source_file").limit(most).select(F.to_json("entry").alias("j")).collect()]
    cells = "".join(
        f"<tr><td>{html.escape(r['source_file'])}</td><td>{r['overall_score']}</td><td>{r['gate_decision']}</td><td>{html.escape(r['retrieval_mode_hint']['recommended_mode'])}</td></tr>" for r in rows
    )
    script = "const q=document.getElementById('q');q.oninput=()=>document.querySelectorAll('tbody tr').forEach(r=>r.hidden=!r.textContent.toLowerCase().includes(q.value.toLowerCase()))"
    return (
        "<!doctype html><meta charset='utf-8'><title>Corpus report</title><input id='q' placeholder='filter'>"
        f"<table><thead><tr><th>document<th>score<th>gate<th>mode</thead><tbody>{cells}</tbody></table><script>{script}</script>"
    )

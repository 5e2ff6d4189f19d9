"""Quality criteria, scorecards and gate decisions.

All counts of a file are taken in one aggregation by doc_id with partial sums before the
shuffle, so a file that holds a third of all paragraphs is no bottleneck; heading jumps
and acronyms come from two more of the same kind.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.functions.text import word_count, words

#: Patterns of references that leave their paragraph.
DANGLING = (
    r"\b(?:as\s+)?mentioned\s+(?:above|below|earlier|previously|before)\b",
    r"\bthe\s+(?:above|below|following|previous|preceding)\s+\w+",
    r"\bsee\s+(?:section|figure|table|page|chapter)\s+\w+",
    r"\b(?:refer|referring)\s+to\s+(?:the\s+)?(?:above|below|previous)",
    r"\bas\s+(?:noted|described|shown|outlined|discussed)\s+(?:above|below|earlier)",
    r"\b(?:the\s+)?(?:steps?|instructions?|procedure)\s+(?:above|below)\b",
)
#: For each of them words of which a match has one, in lower case.
TELLING = (
    ("mentioned",), ("above", "below", "following", "previous", "preceding"), ("section", "figure", "table", "page", "chapter"), ("refer",),
    ("noted", "described", "shown", "outlined", "discussed"), ("step", "instruction", "procedure"),
)
#: Words of which a vague heading is made.
VAGUE = "content details info information section material data overview introduction conclusion notes misc miscellaneous other general".split()
#: Words of headings that are no topic.
PLAIN = (
    "the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would could "
    "should may might shall this that these those it its"
).split()
#: File names that say nothing.
UNTELLING = (r"^(?:document|doc|file|lesson|untitled|new|draft|copy)", r"^(?:final|v\d+|version|rev|revision)", r"^\d+$", r"^[a-f0-9]{8,}$")
#: Capitals that need no definition.
COMMON_CAPITALS = (
    "US UK EU AI ML IT HR CEO CTO CFO API PDF URL HTML CSS SQL FAQ ID OK AM PM BC AD TV PC OS IP USB RAM MBA GPA SAT ACT AP IB LLC INC "
    "AND THE BUT FOR NOT YOU ALL CAN HER WAS ONE OUR OUT ARE HAS HIS HOW ITS MAY NEW NOW OLD SEE WAY WHO DID GET LET SAY SHE TOO USE DAD "
    "MOM RUN SET"
).split()
#: File names of forms.
FORMS = "tracker|rubric|template|worksheet|handout"
MB = 1024 * 1024
#: Category and weight, in the order of emission.
CRITERIA = (
    ("self_containment", 0.20), ("heading_quality", 0.15), ("paragraph_length", 0.10), ("file_focus", 0.10), ("filename_quality", 0.10),
    ("acronym_definitions", 0.05), ("structure", 0.10), ("file_size", 0.0), ("retrieval_aware", 0.20),
)
KNOWLEDGE = ("knowledge_completeness", 0.05)


def dangling_references(text: Column) -> Column:
    """Number of references to other places of the document, each pattern by itself. A pattern is tried only where one of its words stands."""
    low = F.lower(text)
    some = lambda ws: functools.reduce(lambda a, w: a | low.contains(w), ws, F.lit(False))
    return sum((F.when(some(ws), F.regexp_count(text, F.lit(f"(?i){p}"))).otherwise(0) for p, ws in zip(DANGLING, TELLING)), F.lit(0))


def heading_jumps(paras: DataFrame) -> DataFrame:
    w = W.partitionBy("doc_id").orderBy("index")
    heads = paras.filter("level > 0").withColumn("before", F.lag("level").over(w))
    return heads.groupBy("doc_id").agg(F.sum((F.col("level") > F.col("before") + 1).cast("int")).alias("jumps"))


def undefined_acronyms(paras: DataFrame) -> DataFrame:
    """(doc_id, acronym, n): capitals used twice or more that no brackets explain."""
    found = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z]{2,6})\b"), F.lit(1))), lambda a: ~a.isin(COMMON_CAPITALS))
    each = paras.select("doc_id", "text", F.explode(found).alias("acronym"))
    return (
        each.select(
            "doc_id", "acronym", F.expr(r"regexp_count(text, concat('\\b', acronym, '\\b'))").alias("n"),
            F.expr(r"text rlike concat(acronym, '\\s*\\([^)]+\\)') or text rlike concat('\\([^)]*', acronym, '[^)]*\\)')").alias("defined"),
        )
        .groupBy("doc_id", "acronym").agg(F.sum("n").alias("n"), F.max("defined").alias("defined")).filter("not defined and n >= 2").drop("defined")
    )


def heading_words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\b(\w+)\b"), F.lit(1)), lambda w: (F.length(w) > 3) & ~w.isin(PLAIN))


def document_counts(docs: DataFrame, paras: DataFrame) -> DataFrame:
    """One wide row of counts for each file; files without paragraphs have zeros, an unknown size counts as 0."""
    head, is_body, n, text = F.col("level") > 0, F.col("level") == 0, F.col("n_words"), F.col("text")
    one = lambda c: F.sum(c.cast("int"))
    own = words(F.lower(text))
    label = F.regexp_replace(F.trim(text), r"\s+", " ")
    counted = paras.groupBy("doc_id").agg(
        one(is_body).alias("n_body"), one(head).alias("n_headings"), F.sum("n_words").alias("n_words"),
        F.sum(F.when(is_body, n).otherwise(0)).alias("n_body_words"),
        F.sum(F.when(is_body, dangling_references(text)).otherwise(0)).alias("n_dangling"),
        one(is_body & (n < 15)).alias("n_short"), one(is_body & (n > 300)).alias("n_long"),
        one(head & (F.size(own) > 0) & (F.size(F.array_except(own, F.array(*map(F.lit, VAGUE)))) == 0)).alias("n_vague"),
        one(is_body & (n <= 4) & (label.endswith(":") | label.rlike(r"^[A-Za-z0-9 ]{1,20}$"))).alias("n_form_labels"),
        one(is_body & (n <= 4) & (label.endswith(":") | ((F.upper(label) == label) & label.rlike(r"\p{Lu}")))).alias("n_short_labels"),
    )
    topics = (
        paras.filter(head).select("doc_id", F.explode(heading_words(text)).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
        .groupBy("doc_id").agg(F.count("*").alias("n_topic_distinct"), F.sum("n").alias("n_topic_words"))
    )
    acronyms = undefined_acronyms(paras).groupBy("doc_id").agg(F.count("*").alias("n_acronyms"))
    out = docs.join(counted, "doc_id", "left").join(heading_jumps(paras), "doc_id", "left").join(topics, "doc_id", "left").join(acronyms, "doc_id", "left")
    return out.fillna(0, [c for c in out.columns if c.startswith("n_") or c in ("jumps", "file_size_bytes")])


def _floor0(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c.cast("double"))


def criteria(counts: DataFrame, entropy: DataFrame | None = None, retrieval: DataFrame | None = None, knowledge: DataFrame | None = None) -> DataFrame:
    """(doc_id, criterion_ix, category, score, weight, n_critical, n_warning, n_info) in long form.

    entropy: (doc_id, entropy); retrieval: (doc_id, self_retrieval); knowledge: (doc_id,
    n_unresolved, n_resolved, n_cross). Files without a row there get the defaults. With
    knowledge, the other weights shrink to make room for its criterion.
    """
    c = F.col
    d = counts
    d = d.join(entropy.select("doc_id", "entropy"), "doc_id", "left") if entropy is not None else d.withColumn("entropy", F.lit(None).cast("double"))
    d = d.join(retrieval.select("doc_id", "self_retrieval"), "doc_id", "left") if retrieval is not None else d.withColumn("self_retrieval", F.lit(None).cast("double"))
    if knowledge is not None:
        d = d.join(knowledge, "doc_id", "left").fillna(0, ["n_unresolved", "n_resolved", "n_cross"])
    bare = (c("n_headings") == 0) & (c("n_body") > 3)
    dense = (c("n_headings") > 0) & (c("n_body") > 20 * c("n_headings"))
    diversity = F.when(c("n_topic_words") > 0, c("n_topic_distinct") / c("n_topic_words"))
    by_headings = (
        F.when(c("n_headings") < 2, 75).when(c("n_topic_words") == 0, 70).when(diversity > 0.85, 40).when(diversity > 0.70, 65).otherwise(90)
    )
    focus = F.when(c("entropy").isNull(), by_headings).when(c("entropy") > 0.7, 40).when(c("entropy") > 0.4, 65).otherwise(90)
    stem = c("stem")
    bad_name = [
        F.exists(F.array(*[F.lower(stem).rlike(p) for p in UNTELLING]), lambda x: x), F.length(stem) < 8,
        (F.length(stem) > 15) & ~stem.rlike("[-_ ]"),
    ]
    n_name = sum((x.cast("int") for x in bad_name), F.lit(0))
    forms = F.lower("filename").rlike(FORMS) | ((c("n_body") > 0) & (c("n_form_labels") * 2 >= c("n_body")))
    sparse = (c("n_words") < 120) & (c("n_body") < 5) & (c("file_size_bytes") > 20 * 1024)
    passed = [c("n_headings") > 0, c("n_body_words") > 100, c("n_headings") >= 2, c("n_body") >= 3]
    i = lambda x: x.cast("int")
    zero = F.lit(0)
    rate = c("self_retrieval")
    rows = [
        (_floor0(100 - 12 * c("n_dangling")), zero, c("n_dangling"), zero),
        (F.when(bare, 30.0).otherwise(_floor0(100 - 8 * (c("jumps") + c("n_vague") + i(dense)))), zero, F.when(bare, 1).otherwise(i(dense)), F.when(bare, 0).otherwise(c("jumps") + c("n_vague"))),
        (_floor0(100 - 3 * c("n_short") - 8 * c("n_long")), zero, c("n_long") + i(c("n_short") * 2 > c("n_body")), F.least(c("n_short"), F.lit(5))),
        (focus.cast("double"), zero, i(focus == 40), i(focus == 65)),
        (_floor0(100 - 20 * n_name), zero, i(bad_name[0]), n_name - i(bad_name[0])),
        (_floor0(100 - 8 * c("n_acronyms")), zero, zero, c("n_acronyms")),
        (25.0 * sum((i(x) for x in passed), F.lit(0)), zero, i(sparse & ~forms) + i(~passed[0]) + i(~passed[1]), i(sparse & forms) + i(passed[0] & ~passed[2]) + i(~passed[3])),
        (F.when(c("file_size_bytes") > 50 * MB, 0.0).when(c("file_size_bytes") > 25 * MB, 50.0).otherwise(100.0), i(c("file_size_bytes") > 50 * MB), i((c("file_size_bytes") > 25 * MB) & (c("file_size_bytes") <= 50 * MB)), zero),
        (F.when(rate.isNull(), 75.0).otherwise(100 * rate), zero, i(F.coalesce(rate < 0.4, F.lit(False))), i(F.coalesce((rate >= 0.4) & (rate < 0.7), F.lit(False)))),
    ]
    named = list(CRITERIA)
    if knowledge is not None:
        alone = (c("n_resolved") > 0) & (c("n_cross") == 0)
        rows.append((_floor0(100 - 10 * c("n_unresolved") - 15 * i(alone)), zero, i(c("n_unresolved") > 3), F.least(c("n_unresolved"), F.lit(3)) + i(alone)))
        total = sum(w for _, w in CRITERIA)
        named = [(n, w * (total - KNOWLEDGE[1]) / total) for n, w in CRITERIA] + [KNOWLEDGE]
    structs = [
        F.struct(F.lit(k + 1).alias("criterion_ix"), F.lit(n).alias("category"), s.alias("score"), F.lit(float(w)).alias("weight"), cr.cast("int").alias("n_critical"), wa.cast("int").alias("n_warning"), inf.cast("int").alias("n_info"))
        for k, ((n, w), (s, cr, wa, inf)) in enumerate(zip(named, rows))
    ]
    return d.select("doc_id", F.explode(F.array(*structs)).alias("x")).select("doc_id", "x.*")


def check_thresholds(passing: float, notes: float, remediation: float) -> None:
    if not all(0 <= x <= 100 for x in (passing, notes, remediation)) or not passing > notes > remediation:
        raise ValueError("thresholds lie between 0 and 100 and fall strictly")


def scorecards(crit: DataFrame, passing: float = 85.0, notes: float = 70.0, remediation: float = 50.0) -> DataFrame:
    """(doc_id, overall_score, gate_decision, readiness, n_critical, n_warning, n_info)."""
    check_thresholds(passing, notes, remediation)
    s = crit.groupBy("doc_id").agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("overall_score"), *[F.sum(x).alias(x) for x in ("n_critical", "n_warning", "n_info")])
    score = F.col("overall_score")
    gate = F.when(F.col("n_critical") > 0, "HOLD_FOR_REVIEW").when(score >= passing, "PASS").when(score >= notes, "PASS_WITH_NOTES").when(score >= remediation, "REMEDIATION_RECOMMENDED").otherwise("HOLD_FOR_REVIEW")
    legacy = F.when(score >= passing, "EXCELLENT").when(score >= notes, "GOOD").when(score >= remediation, "FAIR").otherwise("POOR")
    return s.withColumns({"gate_decision": gate, "readiness": legacy})


def retrieval_gate(counts: DataFrame) -> DataFrame:
    """How a file is best handled: (doc_id, recommended_mode, confidence, reasons, evidence...)."""
    c = F.col
    ratio = F.when(c("n_body") > 0, c("n_short_labels") / c("n_body")).otherwise(0.0)
    forms_name = F.lower("filename").rlike(FORMS)
    forms = forms_name | ((c("n_body") > 0) & (c("n_form_labels") * 2 >= c("n_body")))
    sparse = (c("n_words") < 120) & (c("n_body") < 5) & (c("file_size_bytes") > 20 * 1024)
    warning, note = sparse & ~forms, sparse & forms
    layout = (c("file_type") == "pdf") & ((ratio >= 0.30) | ((c("n_headings") >= 10) & (c("n_words") < 500)))
    template = note | forms_name | (ratio >= 0.5)
    bare = ((c("n_headings") == 0) & (c("n_body") > 3)).alias("bare")
    mode = (
        F.when(warning | layout, "multimodal_or_ocr_review").when(template, "hybrid_sparse_template")
        .when(bare & (c("n_words") > 400), "hybrid_with_structure_rewrite").otherwise("text_hybrid_default")
    )
    sure = F.when(warning, "high").when(layout | template | (bare & (c("n_words") > 400)), "medium").otherwise("high")
    reasons = F.array_compact(F.array(
        F.when(warning, "parse_fidelity_warning"), F.when(note, "template_like_sparse_content"), F.when(layout, "layout_heavy_pdf"), F.when(bare, "low_structural_headings")
    ))
    reasons = F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("clean_text_for_standard_retrieval")))
    return counts.select(
        "doc_id", mode.alias("recommended_mode"), sure.alias("confidence"), F.array_join(reasons, ",").alias("reasons"), warning.alias("parse_fidelity_warning"),
        note.alias("parse_fidelity_note"), layout.alias("layout_heavy_pdf"), template.alias("template_like"), ratio.alias("short_label_ratio"),
    )


def file_size_warning(size: Column) -> Column:
    return F.when(size > 50 * MB, "CRITICAL").when(size > 25 * MB, "WARNING")


__all__ = ["CRITERIA", "check_thresholds", "criteria", "document_counts", "file_size_warning", "heading_jumps", "retrieval_gate", "scorecards", "undefined_acronyms", "word_count"]

"""Issue rows: what is wrong where, and what to do about it.

Issues of paragraphs come from a map over paragraphs, those of files from the wide row of
counts, so that no file is collected. Severities and numbers agree with operators/criteria.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.functions.text import words
from lectern.operators import criteria as cr

SEVERITIES = ("critical", "warning", "info")
#: What to do, per category and kind of issue.
FIXES = {
    "reference": "Name what is meant instead of pointing to another place.",
    "no_headings": "Add headings that name the topics.",
    "jump": "Use the next heading level.",
    "vague": "Name the topic in the heading.",
    "dense": "Add headings within the longer parts.",
    "short": "Join it with its neighbours or fill it in.",
    "long": "Split it into paragraphs of one thought each.",
    "mostly_short": "Join short paragraphs.",
    "broad": "Split it into files of one topic each.",
    "mixed": "Consider splitting it by topic.",
    "untelling_name": "Rename it after its content.",
    "short_name": "Use a longer file name.",
    "run_on_name": "Separate the words of the file name.",
    "acronym": "Write it out where it is first used.",
    "sparse": "Check whether the text was read in full.",
    "no_structure": "Add headings.",
    "little_text": "Add body text or leave the file out.",
    "one_heading": "Add a second heading.",
    "few_paragraphs": "Add body paragraphs.",
    "too_large": "Convert it to Markdown or split it.",
    "large": "Consider a smaller format.",
    "not_found": "Use the words of likely questions; split broad files.",
    "hardly_found": "Use more specific terms or split it.",
}


def _rows(df: DataFrame, category: str, severity: str, kind: str, place: Column, detail: Column) -> DataFrame:
    return df.select(
        "doc_id", F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), place.cast("long").alias("place"),
        detail.cast("string").alias("detail"), F.lit(FIXES[kind]).alias("fix"),
    )


def issues(counts: DataFrame, paras: DataFrame, entropy: DataFrame | None = None, retrieval: DataFrame | None = None) -> DataFrame:
    """(doc_id, category, severity, kind, place, detail, fix): place is the paragraph's index, null for the file as a whole."""
    c, none = F.col, F.lit(None)
    body, head = paras.filter("level = 0"), paras.filter("level > 0")
    refs = F.flatten(F.array(*[F.regexp_extract_all("text", F.lit(f"(?i)({p})"), F.lit(1)) for p in cr.DANGLING]))
    by_place = W.partitionBy("doc_id").orderBy("index")
    own = words(F.lower(F.col("text")))
    vague = (F.size(own) > 0) & (F.size(F.array_except(own, F.array(*map(F.lit, cr.VAGUE)))) == 0)
    levels = head.withColumn("before", F.lag("level").over(by_place)).filter("level > before + 1")
    # the first five of a file, kept apart before the shuffle
    short = body.filter("n_words < 15").withColumn("nth", F.row_number().over(by_place)).filter("nth <= 5")
    out = [
        _rows(body.select("doc_id", "index", F.explode(refs).alias("ref")), "self_containment", "warning", "reference", c("index"), c("ref")),
        _rows(levels, "heading_quality", "info", "jump", c("index"), F.concat(F.lit("H"), c("before"), F.lit(" to H"), c("level"))),
        _rows(head.filter(vague), "heading_quality", "info", "vague", c("index"), c("text")),
        _rows(body.filter("n_words > 300"), "paragraph_length", "warning", "long", c("index"), F.concat(c("n_words"), F.lit(" words"))),
        _rows(short, "paragraph_length", "info", "short", c("index"), F.concat(c("n_words"), F.lit(" words"))),
        _rows(cr.undefined_acronyms(paras), "acronym_definitions", "info", "acronym", none, F.concat(c("acronym"), F.lit(" x "), c("n"))),
    ]
    d = counts
    d = d.join(entropy.select("doc_id", "entropy"), "doc_id", "left") if entropy is not None else d.withColumn("entropy", none.cast("double"))
    d = d.join(retrieval.select("doc_id", "self_retrieval"), "doc_id", "left") if retrieval is not None else d.withColumn("self_retrieval", none.cast("double"))
    bare = (c("n_headings") == 0) & (c("n_body") > 3)
    diversity = F.when((c("n_headings") >= 2) & (c("n_topic_words") > 0), c("n_topic_distinct") / c("n_topic_words"))
    spread = F.when(c("entropy").isNull(), F.when(diversity > 0.85, 2).when(diversity > 0.70, 1)).otherwise(F.when(c("entropy") > 0.7, 2).when(c("entropy") > 0.4, 1))
    forms = F.lower("filename").rlike(cr.FORMS) | ((c("n_body") > 0) & (c("n_form_labels") * 2 >= c("n_body")))
    sparse = (c("n_words") < 120) & (c("n_body") < 5) & (c("file_size_bytes") > 20 * 1024)
    size = c("file_size_bytes")
    whole = [
        ("heading_quality", "warning", "no_headings", bare, c("n_body")),
        ("heading_quality", "warning", "dense", (c("n_headings") > 0) & (c("n_body") > 20 * c("n_headings")), c("n_body")),
        ("paragraph_length", "warning", "mostly_short", c("n_short") * 2 > c("n_body"), c("n_short")),
        ("file_focus", "warning", "broad", F.coalesce(spread == 2, F.lit(False)), none), ("file_focus", "info", "mixed", F.coalesce(spread == 1, F.lit(False)), none),
        ("filename_quality", "warning", "untelling_name", F.exists(F.array(*[F.lower("stem").rlike(p) for p in cr.UNTELLING]), lambda x: x), c("stem")),
        ("filename_quality", "info", "short_name", F.length("stem") < 8, c("stem")),
        ("filename_quality", "info", "run_on_name", (F.length("stem") > 15) & ~c("stem").rlike("[-_ ]"), c("stem")),
        ("structure", "warning", "sparse", sparse & ~forms, c("n_words")), ("structure", "info", "sparse", sparse & forms, c("n_words")),
        ("structure", "warning", "no_structure", c("n_headings") == 0, none), ("structure", "warning", "little_text", c("n_body_words") <= 100, c("n_body_words")),
        ("structure", "info", "one_heading", c("n_headings") == 1, none), ("structure", "info", "few_paragraphs", c("n_body") < 3, c("n_body")),
        ("file_size", "critical", "too_large", size > 50 * cr.MB, size), ("file_size", "warning", "large", (size > 25 * cr.MB) & (size <= 50 * cr.MB), size),
        ("retrieval_aware", "warning", "not_found", F.coalesce(c("self_retrieval") < 0.4, F.lit(False)), F.round("self_retrieval", 6)),
        ("retrieval_aware", "info", "hardly_found", F.coalesce((c("self_retrieval") >= 0.4) & (c("self_retrieval") < 0.7), F.lit(False)), F.round("self_retrieval", 6)),
    ]
    rows = F.array_compact(F.array(*[
        F.when(on, F.struct(F.lit(cat).alias("category"), F.lit(sev).alias("severity"), F.lit(kind).alias("kind"), none.cast("long").alias("place"), detail.cast("string").alias("detail"), F.lit(FIXES[kind]).alias("fix")))
        for cat, sev, kind, on, detail in whole
    ]))
    out.append(d.select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.*"))
    got = out[0]
    for o in out[1:]:
        got = got.unionByName(o)
    return got


def first_issues(found: DataFrame, k: int = 5) -> DataFrame:
    """The first k issues of each file and category: severe ones first, then by place; rank from 1."""
    order = F.create_map(*[x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i))])[F.col("severity")]
    w = W.partitionBy("doc_id", "category").orderBy(order, F.col("place").asc_nulls_first(), "kind", "detail")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def to_fix(found: DataFrame, cards: DataFrame, below: float = 85.0) -> DataFrame:
    """(doc_id, overall_score, n_issues) of files with issues that score below `below` (0: all of them)."""
    n = found.groupBy("doc_id").agg(F.count("*").alias("n_issues"))
    low = cards if below <= 0 else cards.filter(F.col("overall_score") < below)
    return low.join(n, "doc_id").select("doc_id", "overall_score", "n_issues")

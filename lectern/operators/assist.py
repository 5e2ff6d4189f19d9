"""Model-assisted analysis and remediation behind an injected client.

A client is a callable prompt -> reply that can be sent to workers. Replies should be
written to a table before they are used further, so that a lost task asks again at most
for its own rows.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANALYSIS = (
    "domain string, topics array<string>, audience string, content_type string, key_concepts array<string>, suggested_tags array<string>, summary string, "
    "entities array<struct<name:string,type:string,description:string>>, relationships array<struct<source:string,target:string,type:string,context:string>>"
)
MOST_WORDS = 8_000
Client = Callable[[str], str]


def extract_json(reply: str | None) -> dict | None:
    """The first JSON object in a reply, with or without a code fence around it."""
    text = (reply or "").strip()
    if text.startswith("```"):
        text = text.split("\n", 1)[-1].rsplit("```", 1)[0]
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            got, _ = decoder.raw_decode(text, at)
            return got if isinstance(got, dict) else None
        except ValueError:
            at = text.find("{", at + 1)
    return None


def patient(client: Client, tries: int = 3, wait: float = 2.0) -> Client:
    """Asks again after a pause when the service is busy."""
    def ask(prompt: str) -> str:
        for i in range(tries):
            try:
                return client(prompt)
            except Exception as e:  # noqa: BLE001
                busy = any(x in str(e).lower() for x in ("429", "529", "rate", "overloaded"))
                if not busy or i + 1 == tries:
                    raise
                time.sleep(wait * 2**i)
        raise RuntimeError("no try was allowed")

    return ask


def analysis_prompt(text: Column) -> Column:
    w = F.split(text, r"\s+")
    cut = F.when(F.size(w) > MOST_WORDS, F.concat(F.array_join(F.slice(w, 1, MOST_WORDS), " "), F.lit("\n[text cut here]"))).otherwise(text)
    return F.concat(F.lit(
        "Read the document and answer with one JSON object with the keys domain, topics, audience, content_type, key_concepts, suggested_tags, summary, "
        "entities (name, type, description) and relationships (source, target, type, context).\n\nDocument:\n"
    ), cut)


def ask(prompts: DataFrame, client: Client, key: str = "doc_id") -> DataFrame:
    """(key, reply, error) of every prompt; an error of one leaves the others alone."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows = []
            for k, p in zip(d[key], d["prompt"]):
                try:
                    rows.append((k, client(p), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((k, None, str(e)[:300]))
            yield pd.DataFrame(rows, columns=[key, "reply", "error"])

    return prompts.select(key, "prompt").mapInPandas(run, f"{key} {kind}, reply string, error string")


def analyses(replies: DataFrame) -> DataFrame:
    """Replies as columns; what can't be read gives a summary that says so."""
    clean = F.udf(lambda r: (lambda x: json.dumps(x) if x is not None else None)(extract_json(r)))
    d = replies.withColumn("a", F.from_json(clean("reply"), ANALYSIS))
    failed = F.col("a").isNull()
    ents = F.transform(F.filter(F.col("a.entities"), lambda e: e["name"].isNotNull()), lambda e: F.struct(e["name"].alias("name"), F.coalesce(e["type"], F.lit("concept")).alias("type"), F.coalesce(e.description, F.lit("")).alias("description")))
    rels = F.transform(F.filter(F.col("a.relationships"), lambda r: r.source.isNotNull() & r.target.isNotNull()), lambda r: F.struct(r.source.alias("source"), r.target.alias("target"), F.coalesce(r["type"], F.lit("related_to")).alias("type"), F.coalesce(r.context, F.lit("")).alias("context")))
    return d.withColumns({"failed": failed, "summary": F.when(failed, F.concat(F.lit("Analysis failed: "), F.coalesce("error", F.lit("no JSON in the reply")))).otherwise(F.col("a.summary")), "entities": ents, "relationships": rels})


def low_confidence(d: DataFrame) -> Column:
    """Whether an analysis says too little to be merged into the graph. Needs n_words."""
    n, r = F.coalesce(F.size("entities"), F.lit(0)), F.coalesce(F.size("relationships"), F.lit(0))
    kinds = F.size(F.array_distinct(F.transform("entities", lambda e: e["type"])))
    return F.col("failed") | (n <= 0) | ((F.col("n_words") >= 200) & (n < 2)) | ((n >= 3) & ((r <= 0) | (kinds == 1)))


def dangling_prompts(paras: DataFrame, pattern: str, around: int = 2) -> DataFrame:
    """(doc_id, index, prompt) for paragraphs that refer elsewhere, with their neighbours by index."""
    from pyspark.sql import Window as W

    near = W.partitionBy("doc_id").orderBy("index").rangeBetween(-around, around)
    d = paras.withColumn("near", F.array_join(F.collect_list("text").over(near), "\n\n")).filter((F.col("level") == 0) & F.col("text").rlike(f"(?i){pattern}"))
    return d.select("doc_id", "index", F.concat(F.lit("Rewrite the paragraph so that it stands by itself. Around it stands:\n"), "near", F.lit("\n\nParagraph:\n"), "text").alias("prompt"))


def apply_fixes(paras: DataFrame, fixes: DataFrame) -> DataFrame:
    """Paragraphs with the replies put in their place; a reply of several parts gives several paragraphs in order."""
    f = fixes.filter("reply IS NOT NULL AND trim(reply) <> ''").select("doc_id", "index", F.posexplode(F.split(F.trim("reply"), "\n\n+")).alias("part", "new"))
    return paras.join(f, ["doc_id", "index"], "left").select("doc_id", "index", F.coalesce("part", F.lit(0)).alias("part"), "level", "style", F.coalesce("new", "text").alias("text"))


def file_name(reply: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(reply)), r"\s+", "-"), "[^a-z0-9-]", "")


def heading_prompts(paras: DataFrame, vague: Column, bodies: int = 3) -> DataFrame:
    """(doc_id, index, prompt) for headings where `vague` holds, with the first paragraphs below them."""
    from pyspark.sql import Window as W

    ahead = W.partitionBy("doc_id").orderBy("index").rowsBetween(1, bodies)
    below = F.array_join(F.transform(F.filter(F.collect_list(F.struct("level", "text")).over(ahead), lambda x: x.level == 0), lambda x: x.text), "\n\n")
    d = paras.withColumn("below", below).filter((F.col("level") > 0) & vague)
    return d.select("doc_id", "index", F.concat(F.lit("Give this section a heading that says what it is about; answer with the heading only.\nHeading: "), "text", F.lit("\nSection:\n"), "below").alias("prompt"))


def heading_of(reply: Column) -> Column:
    return F.regexp_replace(F.trim(reply), r"^#+\s*", "")


def long_paragraph_prompts(paras: DataFrame, most_words: int = 300) -> DataFrame:
    d = paras.filter((F.col("level") == 0) & (F.col("n_words") > most_words))
    return d.select("doc_id", "index", F.concat(F.lit("Split this paragraph into shorter ones, with a blank line between them, changing nothing else:\n\n"), "text").alias("prompt"))


def define_acronyms(paras: DataFrame, meanings: DataFrame) -> DataFrame:
    """Puts 'ABC (Meaning)' for the first ABC of a file. meanings: doc_id, acronym, meaning; unknown ones are skipped."""
    known = meanings.filter("meaning IS NOT NULL AND upper(trim(meaning)) <> 'UNKNOWN'")
    hit = paras.join(known, "doc_id").filter(F.expr(r"text rlike concat('\\b', acronym, '\\b')"))
    first = hit.groupBy("doc_id", "acronym", "meaning").agg(F.min("index").alias("index"))
    # few acronyms a paragraph; they are put in by turn
    fixes = first.groupBy("doc_id", "index").agg(F.array_sort(F.collect_list(F.struct("acronym", "meaning"))).alias("fixes"))

    def step(t: Column, x: Column) -> Column:
        before = F.call_function("substring_index", t, x.acronym, F.lit(1))
        rest = F.substring(t, F.length(before) + F.length(x.acronym) + 1, F.length(t))
        return F.concat(before, x.acronym, F.lit(" ("), x.meaning, F.lit(")"), rest)

    return paras.join(fixes, ["doc_id", "index"], "left").withColumn("text", F.coalesce(F.aggregate("fixes", F.col("text"), step), F.col("text"))).drop("fixes")

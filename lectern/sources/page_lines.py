"""Lines of page layouts made into paragraphs: noise out, split headings and body lines joined.

The layout itself comes from outside as lines (doc_id, ix, text, max_size, is_bold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import words
from lectern.operators.parsed import heading_level_of_size

_LINE = "struct<level:int,text:string,style:string>"


def without_noise(lines: DataFrame) -> DataFrame:
    """Collapsed lines without blank ones, bare numbers and copyright notices."""
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    return lines.withColumn("text", text).filter((F.col("text") != "") & ~F.col("text").rlike(r"^\d+$") & ~F.col("text").rlike(r"(?i)©\s*\d{4}\s+by\s+.+all rights reserved"))


def _fold(rows: Column, joins) -> Column:
    """Joins a row to the last one where joins(last, row)."""
    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        merged = F.struct(last.level.alias("level"), F.concat(last.text, F.lit(" "), x.text).alias("text"), last.style.alias("style"))
        return F.when((F.size(acc) > 0) & joins(last, x), F.concat(head, F.array(merged))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(rows, F.array().cast(f"array<{_LINE}>"), step)


def _heading_goes_on(last: Column, x: Column) -> Column:
    return (last.level > 0) & (x.level == last.level) & ~last.text.rlike(r"[.!?:;]$") & (F.size(words(last.text)) + F.size(words(x.text)) <= 14)


def _body_goes_on(last: Column, x: Column) -> Column:
    label = r"^[A-Z][A-Z\s/&-]{2,}$"
    never = last.text.rlike(r"[.!?:;]\s*$") | last.text.rlike(label) | x.text.rlike(label) | x.text.rlike(r"^(?:[•▪◦*–-]|\d+[.)])\s")
    return (last.level == 0) & (x.level == 0) & (last.text.rlike("[-,]$") | (~never & x.text.rlike("^[a-z(]")))


def paragraphs(lines: DataFrame) -> DataFrame:
    """(doc_id, index, level, style, text). The lines of a document are folded in order: one row a document."""
    level = heading_level_of_size(F.col("max_size"), F.coalesce("is_bold", F.lit(False)))
    style = F.format_string("pdf-size-%.1f", F.col("max_size"))
    own = without_noise(lines).select("doc_id", F.struct("ix", level.alias("level"), "text", style.alias("style")).alias("x"))
    rows = own.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda r: F.struct(r.level.alias("level"), r.text.alias("text"), r.style.alias("style"))).cast(f"array<{_LINE}>").alias("r"))
    joined = rows.select("doc_id", _fold(_fold(F.col("r"), _heading_goes_on), _body_goes_on).alias("r"))
    return joined.select("doc_id", F.posexplode("r").alias("index", "x")).select("doc_id", "index", "x.level", "x.style", "x.text")

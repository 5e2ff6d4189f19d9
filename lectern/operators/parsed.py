"""Parsed files as relations: documents and paragraphs.

Twins fall, null and blank paragraphs are left out, levels below 1 are body. The
position of a paragraph is its para_index, which may have gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.functions.text import has_text, stem_of, stripped, word_count


def documents(source_files: DataFrame) -> DataFrame:
    """(doc_id, file_path, filename, stem, file_type, file_size_bytes, page_count, title)."""
    name = F.element_at(F.split("file_path", "/"), -1)
    return (
        source_files.select("doc_id", "file_path", name.alias("filename"), "file_size_bytes", "page_count", "title").distinct()
        .withColumns({"stem": stem_of(F.col("filename")), "file_type": F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1))})
    )


def paragraphs(raw: DataFrame) -> DataFrame:
    """(doc_id, index, level, style, text) with the number of words."""
    return (
        raw.select("doc_id", F.col("para_index").alias("index"), F.greatest(F.coalesce("heading_level", F.lit(0)), F.lit(0)).alias("level"), "style", "text")
        .filter(F.col("text").isNotNull() & has_text(F.col("text"))).distinct()
        .withColumn("n_words", word_count(F.col("text")))
    )


def heading_level_of_style(style: Column) -> Column:
    """Heading n gives n, a title 1, a subtitle 2, all else 0."""
    s = F.lower(F.trim(style))
    n = F.regexp_extract(s, r"^heading\s*(\d+)", 1)
    return F.when(n != "", n.cast("int")).when(s == "title", 1).when(s == "subtitle", 2).otherwise(0)


def heading_level_of_size(size: Column, bold: Column) -> Column:
    """Level of a line of a page layout by its largest type size and weight."""
    return (
        F.when(size >= 20, 1).when(size >= 16, 2).when((size >= 14) & bold, 3).when((size >= 13) & bold, 4).when((size >= 11) & bold, 5).otherwise(0)
    )


def sections(paras: DataFrame) -> DataFrame:
    """Adds section: the number of headings up to and with the paragraph; 0 before the first."""
    w = W.partitionBy("doc_id").orderBy("index").rowsBetween(W.unboundedPreceding, 0)
    return paras.withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(w).cast("int"))


def heading_content(paras: DataFrame) -> DataFrame:
    """(doc_id, section, heading, content) for each heading that body text follows."""
    s = sections(paras).filter("section > 0")
    # a section holds the text between two headings of one file
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("index", "text")))), lambda x: x.text), " ")
    return (
        s.groupBy("doc_id", "section").agg(F.max(F.when(F.col("level") > 0, F.col("text"))).alias("heading"), body.alias("content"))
        .filter("content <> ''")
    )


def _most(df: DataFrame, column: str) -> int:
    """Largest value of a column of few values, 0 without rows."""
    return int(df.agg(F.max(column)).first()[0] or 0)


def heading_tree(paras: DataFrame) -> DataFrame:
    """(doc_id, index, level, text, parent_index): the parent is the last heading of a smaller level."""
    w = W.partitionBy("doc_id").orderBy("index").rowsBetween(W.unboundedPreceding, -1)
    heads = paras.filter("level > 0")
    # levels are few: the last heading of each level is carried along
    levels = range(1, _most(heads, "level"))
    out = heads.withColumns({f"last_{k}": F.max(F.when(F.col("level") == k, F.col("index"))).over(w) for k in levels})
    parents = [F.when(F.col("level") > k, F.col(f"last_{k}")) for k in levels]
    parent = F.greatest(*parents) if len(parents) > 1 else parents[0] if parents else F.lit(None).cast("int")
    return out.select("doc_id", "index", "level", "text", parent.alias("parent_index"))


def heading_paths(paras: DataFrame) -> DataFrame:
    """(doc_id, index, path) of every heading: the path so far, cut to one less than the level, and the heading.

    After a jump in levels the path is shorter than the level, so the next heading of
    the same level stays below the one before. The length of a path is the least of its
    level and the length before plus one, which is a running minimum; the path then holds
    the last heading of each length, so no list of headings is carried along.
    """
    place = W.partitionBy("doc_id").orderBy("index")
    upto = place.rowsBetween(W.unboundedPreceding, 0)
    heads = paras.filter("level > 0").withColumn("text", stripped(F.col("text"))).withColumn("rn", F.row_number().over(place))
    sized = heads.withColumn("depth", F.col("rn") + F.least(F.lit(0), F.min(F.col("level") - F.col("rn")).over(upto)))
    # a path is no longer than the largest level
    depths = range(1, _most(heads, "level") + 1)
    last = sized.withColumns({f"at_{k}": F.last(F.when(F.col("depth") == k, F.col("text")), ignorenulls=True).over(upto) for k in depths})
    path = F.slice(F.array(*[F.col(f"at_{k}") for k in depths]), F.lit(1), F.col("depth")) if depths else F.array().cast("array<string>")
    return last.select("doc_id", "index", "level", path.alias("path"))


def to_markdown(paras: DataFrame) -> DataFrame:
    """(doc_id, markdown): headings with as many # as their level, a blank line between paragraphs."""
    line = F.when(F.col("level") > 0, F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", line.alias("line")))), lambda x: x.line), "\n\n")
    return paras.groupBy("doc_id").agg(joined.alias("m")).select("doc_id", F.concat(stripped(F.col("m")), F.lit("\n")).alias("markdown"))


def parse_text(files: DataFrame, separator: str = r"\n{2,}") -> DataFrame:
    """(path, index, level, style, text) of text and Markdown files with columns path, value.

    Blocks are counted before blank ones are left out. A Markdown block that begins with
    1 to 6 # keeps only its first line, as a heading.
    """
    text = F.regexp_replace("value", r"\r\n?", "\n")
    blocks = files.select("path", F.posexplode(F.split(text, separator)).alias("index", "block")).withColumn("block", stripped(F.col("block"))).filter("block <> ''")
    hashes = F.when(F.lower("path").endswith(".md"), F.regexp_extract("block", r"^(#{1,6})\s+(.*)", 1)).otherwise("")
    level = F.length(hashes)
    return blocks.select(
        "path", "index", level.alias("level"), F.when(level > 0, F.concat(F.lit("Heading "), level)).otherwise("Normal").alias("style"),
        F.when(level > 0, F.regexp_extract("block", r"^(#{1,6})\s+(.*)", 2)).otherwise(F.col("block")).alias("text"),
    )

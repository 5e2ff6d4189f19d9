"""Chunks under their headings and split recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.functions.text import stripped, words
from lectern.operators.parsed import heading_paths, sections


def chunks(docs: DataFrame, paras: DataFrame, target: int = 220, overlap: int = 40) -> DataFrame:
    """(chunk_id, doc_id, chunk_ix, section, heading_path, n_words, text, start and end paragraph, token_estimate).

    Windows of `target` words over the body of a section, each beginning `overlap` words
    before the end of the one before; the windows are computed, not folded.
    """
    step = max(target - overlap, 1)
    s = sections(paras)
    body = s.filter("level = 0").select("doc_id", "section", "index", words(F.col("text")).alias("w"))
    # a section holds the text between two headings of one file
    joined = body.groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(F.struct("index", "w"))).alias("p")).select(
        "doc_id", "section", F.flatten(F.transform("p", lambda x: x.w)).alias("w"),
        F.flatten(F.transform("p", lambda x: F.array_repeat(x.index, F.size(x.w)))).alias("at"),
    )
    n = F.size("w")
    count = F.when(n <= target, 1).otherwise(1 + F.ceil((n - target) / F.lit(step))).cast("int")
    heads = heading_paths(paras).select("doc_id", "index", "path")
    paths = s.filter("level > 0").select("doc_id", "section", "index").join(heads, ["doc_id", "index"]).select("doc_id", "section", "path")
    cut = (
        joined.filter(n > 0).select("doc_id", "section", "w", "at", F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
        .select("doc_id", "section", "i", F.slice("w", F.col("i") * step + 1, target).alias("w"), F.slice("at", F.col("i") * step + 1, target).alias("at"))
    )
    text = F.array_join("w", " ")
    ix = F.row_number().over(W.partitionBy("doc_id").orderBy("section", "i")) - 1
    return (
        cut.withColumn("chunk_ix", ix.cast("int")).join(paths, ["doc_id", "section"], "left").join(docs.select("doc_id", "stem", "filename"), "doc_id")
        .select(
            F.concat("stem", F.lit("::"), F.when(F.col("chunk_ix") < 1000, F.lpad(F.col("chunk_ix").cast("string"), 3, "0")).otherwise(F.col("chunk_ix").cast("string"))).alias("chunk_id"),
            "doc_id", "chunk_ix", F.col("filename").alias("source_file"), F.coalesce("path", F.array().cast("array<string>")).alias("heading_path"), F.size("w").alias("n_words"),
            text.alias("text"), F.col("at")[0].alias("start_paragraph"), F.element_at("at", -1).alias("end_paragraph"), F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int")).alias("token_estimate"),
        )
    )


def split_recommendations(crit: DataFrame, boundaries: DataFrame, paras: DataFrame) -> DataFrame:
    """(doc_id, boundaries, titles) of files whose focus is broad; without topic boundaries, the later headings."""
    broad = crit.filter("category = 'file_focus' AND score <= 65").select("doc_id")
    topics = boundaries.groupBy("doc_id").agg(F.array_sort(F.collect_list("boundary")).alias("b"))
    heads = paras.filter("level > 0").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("index", "text"))).alias("h"))
    of = lambda arr: F.transform(arr, lambda x: x.index.cast("int"))
    titles = F.filter(F.transform(F.slice("h", 1, 6), lambda x: stripped(x.text)), lambda t: t != "")
    later = F.when(F.size("h") > 1, of(F.slice("h", 2, 100_000))).otherwise(F.array().cast("array<int>"))
    return (
        broad.join(topics, "doc_id", "left").join(heads, "doc_id", "left")
        .select("doc_id", F.coalesce("b", later, F.array().cast("array<int>")).alias("boundaries"), F.coalesce(titles, F.array().cast("array<string>")).alias("titles"))
    )

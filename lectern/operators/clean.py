"""Repeated furniture out of paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lectern.functions.text import stripped, word_count


def clean_paragraphs(paras: DataFrame, most_words: int = 8) -> DataFrame:
    """Stripped paragraphs without 'Page n' and without repeats of up to most_words words in a file."""
    w = W.partitionBy("doc_id", "text").orderBy("index")
    return (
        paras.withColumn("text", stripped(F.col("text"))).filter("text <> ''").withColumn("nth", F.row_number().over(w))
        .filter(~F.col("text").rlike(r"^Page\s+\d+$") & ((F.col("nth") == 1) | (word_count(F.col("text")) > most_words)))
        .drop("nth")
    )

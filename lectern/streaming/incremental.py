"""Incremental gate: files that arrive are scored batch by batch, with late twins left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import criteria, parsed


def paragraph_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def score_batches(paragraphs: DataFrame, docs: DataFrame, out: str, checkpoint: str):
    """Starts a query that writes the scorecards of the files of every batch to `out`/batch=n.

    A batch is written under its number, so one that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        paras = parsed.paragraphs(batch)
        own = docs.join(paras.select("doc_id").distinct(), "doc_id", "left_semi")
        cards = criteria.scorecards(criteria.criteria(criteria.document_counts(own, paras)))
        cards.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return paragraphs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals_per_hour(files: DataFrame, late: str = "7 days") -> DataFrame:
    """Files by hour of arrival and type, with a watermark on arrived_at."""
    return (
        files.withColumn("arrived_at", F.col("arrived_at").cast("timestamp")).withWatermark("arrived_at", late).groupBy(F.window("arrived_at", "1 hour"), "file_type").agg(F.count("*").alias("n_files"), F.sum("file_size_bytes").alias("bytes"))
        .select(F.col("window.start").alias("hour"), "file_type", "n_files", "bytes")
    )

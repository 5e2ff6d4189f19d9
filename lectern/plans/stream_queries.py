"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from lectern.session import shared_dir
from lectern.streaming.incremental import arrivals_per_hour


def stream_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Files by hour of arrival and type, from a stream over the table's files."""
    path = f"{folder}/source_files.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", "source_files.parquet").parquet(folder)
    out = f"{shared_dir(spark)}/arrivals_{uuid.uuid4().hex}"
    counted = arrivals_per_hour(stream)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/state")

    query = counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{out}/state")


QUERIES = {"stream_arrivals": stream_arrivals}
SQL = {"stream_arrivals": "SELECT date_trunc('hour', arrived_at) AS hour, file_type, count(*) AS n_files, sum(file_size_bytes)::BIGINT AS bytes FROM source_files GROUP BY ALL"}

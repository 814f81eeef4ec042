"""Continuous ingestion of files into log tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logloom.sources.writes import LogTable


def run_ingest(stream: DataFrame, table: LogTable, checkpoint: str, now_ms: int, order: str = "seq") -> None:
    """Appends all that a stream (topic, partition, key, value and an order) has to offer, one batch of the stream as one batch of the table. A batch that
    is run again after a failure replaces itself: every row is in the table once."""
    query = stream.writeStream.foreachBatch(lambda rows, batch_id: table.append(batch_id, rows, now_ms, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def file_stream(spark: SparkSession, folder: str, name: str, schema, files_per_batch: int = 64) -> DataFrame:
    """A stream of the Parquet files of that name (or pattern) in a folder, as many at a time as the rate allows."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

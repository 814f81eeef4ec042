"""Sizes and counts of logs, topics and clusters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.model import LOG

MB = 1048576.0


def partition_sizes(records: DataFrame) -> DataFrame:
    """topic, partition, n, bytes."""
    return records.groupBy(*LOG).agg(F.count("*").alias("n"), F.sum("bytes").cast("long").alias("bytes"))


def topic_stats(records: DataFrame) -> DataFrame:
    """topic, partitions, messages (sum of next offsets), bytes. Records are aggregated once, by log."""
    logs = records.groupBy(*LOG).agg((F.max("offset") + 1).alias("hwm"), F.sum("bytes").alias("bytes"))
    return logs.groupBy("topic").agg(F.count("*").alias("partitions"), F.sum("hwm").cast("long").alias("messages"), F.sum("bytes").cast("long").alias("bytes"))


def cluster_stats(stats: DataFrame) -> DataFrame:
    """topics, partitions, messages, bytes over all topics."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return stats.agg(F.count("*").alias("topics"), total("partitions"), total("messages"), total("bytes"))


def data_stats(records: DataFrame) -> DataFrame:
    """Records, bytes and MB by log, topic and overall (nulls mark what is summed over)."""
    logs = partition_sizes(records)
    return logs.rollup(*LOG).agg(F.sum("n").cast("long").alias("n"), F.sum("bytes").cast("long").alias("bytes"), F.round(F.sum("bytes") / MB, 9).alias("mb"))


def storage_metrics(records: DataFrame, segment_bytes: int = 100 * 1024 * 1024) -> DataFrame:
    """topic, partition, bytes, leo, segments: the number of segments that the size makes likely."""
    logs = records.groupBy(*LOG).agg(F.sum("bytes").cast("long").alias("bytes"), (F.max("offset") + 1).cast("long").alias("leo"))
    return logs.withColumn("segments", (F.floor(F.col("bytes") / segment_bytes) + 1).cast("long"))


def log_dirs(sizes: DataFrame) -> DataFrame:
    """topic, partition, bytes, offset_lag: the report on a broker's folders, where the lag is always 0."""
    return sizes.select(*LOG, "bytes", F.lit(0).cast("long").alias("offset_lag"))


def human_size(column: str):
    """Bytes in units of 1024 with two decimals."""
    units = F.array(*(F.lit(u) for u in ("B", "KB", "MB", "GB", "TB")))
    power = F.when(F.col(column) < 1, 0).otherwise(F.least(F.floor(F.ln(column) / F.lit(math.log(1024.0)) + 1e-12), F.lit(4))).cast("int")
    return F.concat(F.format_string("%.2f", F.col(column) / F.pow(F.lit(1024.0), power)), F.lit(" "), F.element_at(units, power + 1))


def throughput(records: DataFrame) -> DataFrame:
    """topic, first_ms, last_ms, n, per_second, mb_per_second over the time that a topic's records span."""
    by = records.groupBy("topic").agg(F.min("timestamp").alias("first_ms"), F.max("timestamp").alias("last_ms"), F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    seconds = F.nullif((F.col("last_ms") - F.col("first_ms")) / 1000.0, F.lit(0.0))
    return by.select("topic", "first_ms", "last_ms", "n", F.round(F.col("n") / seconds, 9).alias("per_second"), F.round(F.col("bytes") / MB / seconds, 12).alias("mb_per_second"))

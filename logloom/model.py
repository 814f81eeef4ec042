"""Row types of the engine and the assignment of offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: On disk a record has a size, an offset, a timestamp and two lengths around key and value, and four bytes of padding.
RECORD_OVERHEAD = 32

RECORD = "topic string, partition int, offset long, timestamp long, key binary, value binary"
OFFSET_COMMIT = "group_id string, topic string, partition int, offset long, metadata string, commit_time timestamp, expire_time timestamp"
REPLICA = "topic string, partition int, replicas array<int>, isr array<int>"
FOLLOWER_STATE = "topic string, partition int, broker int, leo long, last_fetch_ms long"
AUDIT_EVENT = (
    "timestamp timestamp, event_id string, event_type string, severity string, principal string, host string, user_agent string, resource_type string, "
    "resource_name string, operation string, result string, metadata map<string,string>, error string, request_id string, session_id string, "
    "api_version string, duration_ms long"
)
ACL_ENTRY = "principal string, host string, resource_type byte, resource_name string, pattern_type byte, operation byte, permission_type byte"
SCHEMA_VERSION = (
    "id int, subject string, version int, schema_type string, schema string, references array<struct<name:string,subject:string,version:int>>, "
    "created_at timestamp, updated_at timestamp"
)
METRIC_SAMPLE = "name string, labels map<string,string>, ts timestamp, value double"

SNAPSHOT_LOG = "topic string, partition int, id string, created_ms long, base_offset long, high_water_mark long, num_segments long, total_size long, segment_offsets array<long>"

LOG = ("topic", "partition")


def record_bytes(key: Column, value: Column) -> Column:
    """What a record takes in a log. A null key or value is stored as an empty one."""
    return (F.lit(RECORD_OVERHEAD) + F.coalesce(F.octet_length(key), F.lit(0)) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def dense_offsets(rows: DataFrame, keys: tuple[str, ...], bucket: Column, *order: str | Column) -> DataFrame:
    """`rows` with `offset`: 0, 1, 2, ... in each log by `bucket` and then `order`.

    A log may be far too large to sort in one task, so rows are only numbered within a bucket (a stretch of time); the
    numbers of rows in earlier buckets, a small table, give where each bucket begins.
    """
    rows = rows.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    begins = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    number = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order))
    return rows.withColumn("_number", number).join(begins, [*keys, "_bucket"]).withColumn("offset", (F.col("_base") + F.col("_number") - 1).cast("long")).drop("_bucket", "_number", "_base")


#: So many rows of one log each are sent to every executor (some 50 MB).
MAX_BROADCAST_LOGS = 500_000


def small(rows: DataFrame) -> DataFrame:
    """A narrow table with about one row for each log, to join records with: broadcast if it is counted to be small enough, else as it is, and Spark
    shuffles (and splits skewed logs)."""
    return F.broadcast(rows) if rows.limit(MAX_BROADCAST_LOGS + 1).count() <= MAX_BROADCAST_LOGS else rows

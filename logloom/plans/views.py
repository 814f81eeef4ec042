"""The engine's tables as views over the given ones, for Spark and, in the same meaning, as SQL for DuckDB."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.model import dense_offsets, epoch_ms, record_bytes
from logloom.operators.offsets import high_water_marks
from logloom.operators.replication import assign_replicas
from logloom.sources.sinks import shared_folder

BROKERS = (1, 2, 3)
SEGMENT_ROWS = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STORED = "offset long, timestamp long, key string, value string, bytes long, topic string, partition int"
#: Offsets in one file of a log.
STRETCH = 1_000_000
_stored: dict[tuple[str, str], str] = {}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records: a topic for each event type, four partitions each, keyed by user.

    Records are numbered once for a session and stored as a log is: a folder for each topic and partition, files by stretches of offsets, each in
    order. Bounds on topic, partition, offset and time then reach the scan.
    """
    known = (spark.sparkContext.applicationId, sf_dir)
    if known not in _stored:
        path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
        rows = numbered_records(spark, sf_dir).withColumn("stretch", F.expr(f"offset div {STRETCH}"))
        dealt = rows.repartition("topic", "partition", "stretch").sortWithinPartitions("topic", "partition", "offset").drop("stretch")
        dealt.write.partitionBy("topic", "partition").parquet(path)
        _stored[known] = path
    columns = ("topic", "partition", "offset", "timestamp", "key", "value", "bytes")
    return spark.read.schema(STORED).parquet(_stored[known]).select(*columns)


def numbered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with the offsets that their order gives them."""
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("partition"),
        epoch_ms(F.col("ts")).alias("timestamp"),
        F.col("user_id").cast("string").alias("key"),
        F.col("props").alias("value"),
        "event_id",
        "ts",
    )
    rows = dense_offsets(rows, ("topic", "partition"), F.to_date("ts"), "ts", "event_id")
    return rows.select("topic", "partition", "offset", "timestamp", "key", "value", record_bytes(F.col("key"), F.col("value")).alias("bytes"))


RECORDS = """records AS (
    SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS "partition",
           CAST(row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) - 1 AS BIGINT) AS "offset",
           CAST(epoch_us(ts) // 1000 AS BIGINT) AS "timestamp", CAST(user_id AS VARCHAR) AS key, props AS value,
           CAST(32 + strlen(CAST(user_id AS VARCHAR)) + strlen(props) AS BIGINT) AS bytes
    FROM events)"""
HWM = 'hwm AS (SELECT topic, "partition", CAST(max("offset") + 1 AS BIGINT) AS hwm FROM records GROUP BY ALL)'


def commits(marks: DataFrame) -> DataFrame:
    """Three groups that have committed 1/4, 2/4 and 3/4 of every log."""
    group = F.explode(F.array(*(F.lit(g) for g in range(3)))).alias("g")
    return marks.select("*", group).select(F.concat(F.lit("group-"), F.col("g")).alias("group_id"), "topic", "partition", F.expr("hwm * (g + 1) div 4").alias("offset"))


COMMITS = """commits AS (SELECT 'group-' || g AS group_id, topic, "partition", CAST(hwm * (g + 1) // 4 AS BIGINT) AS "offset" FROM hwm, (SELECT unnest([0, 1, 2]) AS g))"""


def replicas(marks: DataFrame) -> DataFrame:
    return marks.select("topic", "partition", assign_replicas(F.col("partition"), BROKERS, 3).alias("replicas"))


REPLICAS = """replicas AS (SELECT topic, "partition", [CAST(("partition" + i) % 3 + 1 AS INTEGER) FOR i IN [0, 1, 2]] AS replicas FROM hwm)"""


def follower_state(marks: DataFrame) -> DataFrame:
    """Log end offset and last fetch of each broker but the leader; broker 3 has no state in partition 3."""
    broker = F.explode(F.array(*(F.lit(b) for b in BROKERS))).alias("broker")
    rows = marks.join(replicas(marks), ["topic", "partition"]).select("*", broker).where((F.col("broker") != F.col("replicas")[0]) & ~((F.col("broker") == 3) & (F.col("partition") == 3)))
    leo = F.greatest(F.col("hwm") - F.expr("broker * 7 % 5 + `partition` % 2"), F.lit(0)).cast("long").alias("leo")
    return rows.select("topic", "partition", "broker", leo, F.expr("1706659200000L - broker * 4000L - `partition` * 1000L").alias("last_fetch_ms"))


FOLLOWERS = """follower_state AS (
    SELECT topic, "partition", broker, CAST(greatest(hwm - (broker * 7 % 5 + "partition" % 2), 0) AS BIGINT) AS leo,
           CAST(1706659200000 - broker * 4000 - "partition" * 1000 AS BIGINT) AS last_fetch_ms
    FROM hwm JOIN replicas USING (topic, "partition"), (SELECT unnest([1, 2, 3]) AS broker)
    WHERE broker <> replicas[1] AND NOT (broker = 3 AND "partition" = 3))"""


def segmented(rows: DataFrame) -> DataFrame:
    """Records in segments of a fixed number of offsets."""
    return rows.withColumn("segment", F.expr(f"offset div {SEGMENT_ROWS}"))


SEGMENTED = f'segmented AS (SELECT *, CAST("offset" // {SEGMENT_ROWS} AS BIGINT) AS segment FROM records)'


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next offsets of `records`."""
    return high_water_marks(records(spark, sf_dir))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audit events."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("ev-"), F.col("event_id")).alias("event_id"),
        epoch_ms(F.col("ts")).alias("ts_ms"),
        F.col("event_type"),
        F.when(F.col("event_type") == "error", "error").when(F.col("value") > 90, "warning").otherwise("info").alias("severity"),
        F.concat(F.lit("user"), F.col("user_id")).alias("principal"),
        F.concat(F.lit("10.0.0."), F.col("user_id") % 250).alias("host"),
        F.lit("topic").alias("resource_type"),
        F.concat(F.lit("topic-"), F.col("user_id") % 7).alias("resource_name"),
        F.when(F.col("event_id") % 3 == 0, "create").otherwise("delete").alias("operation"),
        F.when(F.col("event_id") % 2 == 0, "success").otherwise("failure").alias("result"),
    )


AUDIT = """audit AS (
    SELECT event_id AS seq, 'ev-' || event_id AS event_id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_ms, event_type,
           CASE WHEN event_type = 'error' THEN 'error' WHEN value > 90 THEN 'warning' ELSE 'info' END AS severity,
           'user' || user_id AS principal, '10.0.0.' || (user_id % 250) AS host, 'topic' AS resource_type, 'topic-' || (user_id % 7) AS resource_name,
           CASE WHEN event_id % 3 = 0 THEN 'create' ELSE 'delete' END AS operation, CASE WHEN event_id % 2 = 0 THEN 'success' ELSE 'failure' END AS result
    FROM events)"""


def with_views(*parts: str) -> str:
    """A WITH clause of the named views."""
    return "WITH " + ", ".join(parts) + " "

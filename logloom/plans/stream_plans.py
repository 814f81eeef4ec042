"""Queries on event time and streams, writes and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from logloom.operators.offsets import high_water_marks
from logloom.plans import views as V
from logloom.plans.offset_plans import GROUPS_SQL, _groups
from logloom.plans.registry import query
from logloom.plans.views import COMMITS, HWM, RECORDS, with_views
from logloom.sources.sinks import decode_logs, group_export, read_jsonl, shared_folder, write_jsonl, write_log_files
from logloom.sources.writes import LogTable, create_topics, produce
from logloom.streaming.ingest import file_stream, run_ingest
from logloom.streaming.windows import first_only, session_timeouts, sessions, windowed


def _events(spark, d):
    return V.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "user_id", F.floor("value").cast("long").alias("value"))


def _ms(df, *columns):
    return df.withColumns({c: F.unix_millis(c) for c in columns})


@query("SELECT event_type, s AS start, s + 21600000 AS \"end\", count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT event_type, CAST(floor(value) AS BIGINT) AS v, epoch_us(ts) // 1000 // 21600000 * 21600000 AS s FROM events) GROUP BY ALL")
def tumbling(spark, d):
    return _ms(windowed(_events(spark, d), ["event_type"], "6 hours"), "start", "end")


@query(
    """SELECT event_type, s AS start, s + 43200000 AS "end", count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT event_type, CAST(floor(value) AS BIGINT) AS v,
    epoch_us(ts) // 1000 // 14400000 * 14400000 - unnest([0, 1, 2]) * 14400000 AS s FROM events) GROUP BY ALL"""
)
def sliding(spark, d):
    return _ms(windowed(_events(spark, d), ["event_type"], "12 hours", "4 hours"), "start", "end")


@query(
    """WITH e AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 8 HOURS AS cut FROM events), s AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e)
    SELECT user_id, epoch_us(min(ts)) // 1000 AS start, epoch_us(max(ts) + INTERVAL 8 HOURS) // 1000 AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_windows(spark, d):
    return _ms(sessions(_events(spark, d), ["user_id"], "8 hours"), "start", "end")


@query("SELECT DISTINCT event_type, user_id, CAST(floor(value) AS BIGINT) AS value FROM events")
def dedup(spark, d):
    return first_only(_events(spark, d).select("event_type", "user_id", "value"), ["event_type", "user_id", "value"])


@query('SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS "partition", CAST(row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id) - 1 AS BIGINT) AS "offset", CAST(user_id AS VARCHAR) AS key, props AS value FROM events')
def stream_ingest(spark, d):
    """The events as a stream of files, appended to a log table with offsets; the stream is then run again and adds nothing."""
    folder = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    table = LogTable(spark, f"{folder}/log")
    schema = V.table(spark, d, "events").schema
    stream = file_stream(spark, d, "events.parquet", schema).select(
        F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), F.col("user_id").cast("string").alias("key"), F.col("props").alias("value"), F.col("event_id").alias("seq")
    )
    for _ in range(2):
        run_ingest(stream, table, f"{folder}/checkpoint", 1706745600000)
    return table.read().select("topic", "partition", "offset", "key", "value")


@query(
    """SELECT CAST(user_id AS VARCHAR) AS member_id, epoch_us(max(ts)) // 1000 AS last_ms, (SELECT epoch_us(max(ts)) // 1000 FROM events) - 3600000 > epoch_us(max(ts)) // 1000 + 21600000 AS expired
    FROM events GROUP BY user_id"""
)
def session_timeout_stream(spark, d):
    """Heartbeats as a stream: the last state of each member, once the stream's end has moved event time on."""
    folder = f"{shared_folder(spark)}/timeouts-{uuid.uuid4().hex}"
    stream = file_stream(spark, d, "events.parquet", V.table(spark, d, "events").schema)
    beats = stream.select(F.col("user_id").cast("string").alias("member_id"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "1 hour")
    states = session_timeouts(beats, 21_600_000)
    keep = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/states/batch={batch}")
    states.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("member_id string, state string, last_ms long, batch long").parquet(f"{folder}/states")
    return found.groupBy("member_id").agg(F.max("last_ms").alias("last_ms"), (F.max_by("state", "batch") == "expired").alias("expired"))


@query(with_views(RECORDS) + 'SELECT topic, "partition", "offset", "timestamp", key, value FROM records')
def framed_log_roundtrip(spark, d):
    """Records framed into segment files and read back."""
    path = f"{shared_folder(spark)}/framed-{uuid.uuid4().hex}"
    rows = V.segmented(V.records(spark, d)).select("topic", "partition", "segment", "offset", "timestamp", *(F.encode(c, "UTF-8").alias(c) for c in ("key", "value")))
    write_log_files(rows, path)
    read = decode_logs(spark.read.schema("segment long, data binary, topic string, partition int").parquet(path))
    return read.select("topic", "partition", "offset", "timestamp", *(F.decode(c, "UTF-8").alias(c) for c in ("key", "value")))


@query(with_views(RECORDS) + "SELECT \"offset\", \"timestamp\", key, value FROM records")
def jsonl_roundtrip(spark, d):
    """Records exported as JSON lines and imported again."""
    path = f"{shared_folder(spark)}/jsonl-{uuid.uuid4().hex}"
    write_jsonl(V.records(spark, d).select("offset", "timestamp", "key", "value"), path, 1000)
    return read_jsonl(spark, path)


@query(with_views(RECORDS, HWM, COMMITS, GROUPS_SQL) + """SELECT group_id, 'consumer' AS protocol_type, state, CAST(7 AS INTEGER) AS generation, CASE WHEN state = 'Stable' THEN 'm1' END AS leader, CAST(count(*) AS BIGINT) AS topics, CAST(sum(o) AS BIGINT) AS view_0 FROM (SELECT DISTINCT group_id, state, topic, CASE WHEN topic = 'view' THEN (SELECT "offset" FROM commits d WHERE d.group_id = c.group_id AND d.topic = 'view' AND d."partition" = 0) END AS o FROM commits c JOIN groups USING (group_id)) GROUP BY ALL""")
def group_exports(spark, d):
    groups = _groups(spark).withColumns({"protocol_type": F.lit("consumer"), "generation": F.lit(7), "leader": F.when(F.col("state") == "Stable", "m1")})
    found = group_export(groups, V.commits(high_water_marks(V.records(spark, d))))
    offsets = F.from_json(F.get_json_object("export", "$.offsets"), "map<string,string>")
    view_0 = F.get_json_object(F.element_at(offsets, "view"), "$.0").cast("long")
    return found.select("group_id", *(F.get_json_object("export", f"$.{c}").cast(kind).alias(c) for c, kind in (("protocol_type", "string"), ("state", "string"), ("generation", "int"), ("leader", "string"))), F.size(offsets).cast("long").alias("topics"), view_0.alias("view_0"))


@query("SELECT event_id, CAST(0 AS INTEGER) AS \"partition\", CASE WHEN event_id % 3 = 1 THEN NULL ELSE props END AS value, CASE WHEN event_id % 3 = 1 THEN 'bad value' END AS error FROM events")
def produce_rows(spark, d):
    e = V.table(spark, d, "events").select("event_id", F.lit(None).cast("int").alias("partition"), F.lit("k").alias("key"), F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("value"))
    return produce(e).select("event_id", "partition", F.decode("value", "UTF-8").alias("value"), "error")


@query("SELECT event_id, CAST(0 AS INTEGER) AS \"partition\", CASE WHEN event_id % 3 = 1 THEN NULL ELSE props END AS value, CASE WHEN event_id % 3 = 1 THEN 'bad value' END AS error FROM events")
def produce_base64(spark, d):
    coded = F.base64(F.encode("props", "UTF-8"))
    e = V.table(spark, d, "events").select("event_id", F.lit(None).cast("int").alias("partition"), F.lit("k").alias("key"), F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("*"), coded)).otherwise(coded).alias("value"))
    return produce(e, value_format="base64").select("event_id", "partition", F.decode("value", "UTF-8").alias("value"), "error")


@query("SELECT * FROM (VALUES ('fresh', NULL, true), ('view', 'exists', false), ('none', 'invalid partitions', false)) AS t(name, error, created)")
def create_topics_check(spark, d):
    requests = spark.createDataFrame([("fresh", 3), ("view", 1), ("none", 0)], "name string, partitions int")
    return create_topics(requests, V.table(spark, d, "events").select(F.col("event_type").alias("name")))

"""Queries that read logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import scan as S
from logloom.plans import views as V
from logloom.plans.registry import query
from logloom.plans.views import HWM, RECORDS, REPLICAS, with_views

COLUMNS = 'topic, "partition", "offset", "timestamp", key, value, bytes'
VIEW_0 = "topic = 'view' AND \"partition\" = 0"


@query(with_views(RECORDS) + f'SELECT {COLUMNS} FROM records WHERE {VIEW_0} AND "offset" = 42')
def fetch_point(spark, d):
    return S.read_point(V.records(spark, d), "view", 0, 42)


@query(with_views(RECORDS) + f'SELECT {COLUMNS} FROM records WHERE {VIEW_0} AND "offset" >= 20 AND "offset" < 70')
def fetch_range(spark, d):
    return S.read_range(V.records(spark, d), "view", 0, 20, 50)


@query(
    with_views(RECORDS)
    + f"""SELECT {COLUMNS} FROM (SELECT *, coalesce(sum(bytes) OVER (ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
    FROM records WHERE {VIEW_0} AND "offset" >= 10) WHERE b < 1000"""
)
def fetch_max_bytes(spark, d):
    return S.read_bytes(V.records(spark, d), "view", 0, 10, 1000)


@query(
    with_views(RECORDS)
    + f"""SELECT {COLUMNS} FROM (SELECT *, coalesce(sum(strlen(key) + strlen(value)) OVER (ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
    FROM (SELECT * FROM records WHERE {VIEW_0} ORDER BY "offset" LIMIT 60)) WHERE b < 500"""
)
def consume_bounded(spark, d):
    records = V.records(spark, d)
    return S.consume(records, V.marks(spark, d), "view", 0, -1, max_bytes=500, max_records=60)


@query(
    with_views(RECORDS)
    + f""", p AS (SELECT * FROM (VALUES ('view', 0, 3), ('click', 1, 0), ('error', 2, 10)) AS p(topic, "partition", position)),
    own AS (SELECT r.*, row_number() OVER (PARTITION BY r.topic, r."partition" ORDER BY r."offset") AS turn FROM records r JOIN p USING (topic, "partition") WHERE r."offset" >= p.position),
    numbered AS (SELECT *, row_number() OVER (ORDER BY turn, topic, "partition") AS poll_order,
        coalesce(sum(strlen(key) + strlen(value)) OVER (ORDER BY turn, topic, "partition" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM own)
    SELECT {COLUMNS}, CAST(poll_order AS INTEGER) AS poll_order FROM numbered WHERE poll_order <= 50 AND b < 400"""
)
def poll_round_robin(spark, d):
    positions = spark.createDataFrame([("view", 0, 3), ("click", 1, 0), ("error", 2, 10)], "topic string, partition int, position long")
    return S.poll(V.records(spark, d), positions, max_records=50, max_bytes=400)


@query(
    with_views(RECORDS, HWM)
    + """, q AS (SELECT * FROM (VALUES ('view', 0, 10), ('view', 1, 100000000), ('none', 0, 0)) AS q(topic, "partition", fetch_offset))
    SELECT topic, "partition", CAST(fetch_offset AS BIGINT) AS fetch_offset, hwm, CAST(0 AS BIGINT) AS log_start, CAST(count(r."offset") AS BIGINT) AS n, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes
    FROM q JOIN hwm USING (topic, "partition") LEFT JOIN records r ON r.topic = q.topic AND r."partition" = q."partition" AND r."offset" >= fetch_offset AND fetch_offset < hwm GROUP BY ALL""".replace(
        "SELECT topic, \"partition\", CAST(fetch", "SELECT q.topic, q.\"partition\", CAST(fetch"
    )
)
def fetch_requests(spark, d):
    requests = spark.createDataFrame([("view", 0, 10), ("view", 1, 100000000), ("none", 0, 0)], "topic string, partition int, fetch_offset long")
    return S.fetch(V.records(spark, d), requests, V.marks(spark, d))


@query(
    with_views(RECORDS, V.SEGMENTED)
    + """, w AS (SELECT * FROM (VALUES ('view', 0, 120), ('view', 0, 99), ('view', 0, -5), ('none', 1, 7)) AS w(topic, "partition", "offset")),
    s AS (SELECT topic, "partition", min("offset") AS base FROM segmented GROUP BY topic, "partition", segment)
    SELECT w.topic, w."partition", CAST(w."offset" AS BIGINT) AS "offset", CAST(coalesce(max(base), -1) AS BIGINT) AS base_offset
    FROM w LEFT JOIN s ON s.topic = w.topic AND s."partition" = w."partition" AND base <= w."offset" GROUP BY ALL"""
)
def segment_locate(spark, d):
    segments = V.segmented(V.records(spark, d)).groupBy("topic", "partition", "segment").agg(F.min("offset").alias("base_offset"))
    wanted = spark.createDataFrame([("view", 0, 120), ("view", 0, 99), ("view", 0, -5), ("none", 1, 7)], "topic string, partition int, offset long")
    return S.locate_segment(segments, wanted)


@query(
    with_views(RECORDS)
    + f"""SELECT {COLUMNS} FROM records WHERE "offset" BETWEEN 5 AND 400 AND "timestamp" BETWEEN 1704067200000 AND 1705500000000 AND contains(lower(key), '1') AND contains(lower(value), 'k": 1')"""
)
def message_search(spark, d):
    return S.search(V.records(spark, d), offsets=(5, 400), times=(1704067200000, 1705500000000), key_contains="1", value_contains='K": 1')


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview, coalesce(json_valid(text), false) AS is_json FROM documents")
def message_preview(spark, d):
    return V.table(spark, d, "documents").select("doc_id", S.preview(F.col("text")).alias("preview"), F.coalesce(S.is_json(F.col("text")), F.lit(False)).alias("is_json"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN props || '}' ELSE json_pretty(props) END AS shown FROM events")
def message_pretty(spark, d):
    value = F.when(F.col("event_id") % 5 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    return V.table(spark, d, "events").select("event_id", S.pretty(value, 4).alias("shown"))


@query(
    with_views(RECORDS, HWM, REPLICAS)
    + """, q AS (SELECT * FROM (VALUES ('view'), ('nothing')) AS q(topic))
    SELECT q.topic, CASE WHEN count(r."partition") = 0 THEN 3 ELSE 0 END AS error, CAST(count(r."partition") AS BIGINT) AS n_partitions, CAST(sum(r.replicas[1]) AS BIGINT) AS leaders
    FROM q LEFT JOIN replicas r USING (topic) GROUP BY q.topic"""
)
def metadata_lookup(spark, d):
    requested = spark.createDataFrame([("view",), ("nothing",)], "topic string")
    found = S.metadata(requested, V.replicas(V.marks(spark, d)))
    leaders = F.aggregate(F.transform("partitions", lambda p: p.leader.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("topic", "error", F.coalesce(F.size("partitions"), F.lit(0)).cast("long").alias("n_partitions"), leaders.alias("leaders"))


@query(with_views(RECORDS, HWM) + """SELECT topic, count(*) AS n, string_agg("partition" || ':' || hwm, ',' ORDER BY "partition") AS ends FROM hwm WHERE contains(lower(topic), 'i') GROUP BY topic""")
def topic_list(spark, d):
    detail = S.topic_detail(S.topics_named(V.marks(spark, d), "I"))
    return detail.select("topic", "n", F.array_join(F.transform("partitions", lambda p: F.concat_ws(":", p.partition.cast("string"), p.hwm.cast("string"))), ",").alias("ends"))


@query(with_views(RECORDS) + f"""SELECT '{{"offset":' || "offset" || ',"timestamp":' || "timestamp" || ',"key":"' || key || '","value":"' || replace(value, '"', '\\"') || '"}}' AS line FROM records WHERE {VIEW_0} AND "offset" >= 10 AND "offset" < 30""")
def export_jsonl(spark, d):
    return S.read_range(V.records(spark, d), "view", 0, 10, 20).select(F.to_json(F.struct("offset", "timestamp", "key", "value")).alias("line"))

"""Queries on a cluster's catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from logloom.operators import cluster as C
from logloom.operators import groups as G
from logloom.plans import views as V
from logloom.plans.registry import query
from logloom.plans.schema_plans import MODES, _avro, _versions
from logloom.plans.views import HWM, RECORDS, REPLICAS, with_views
from logloom.sources.sinks import shared_folder

DEFAULTS = {"cleanup.policy": "delete", "compression.type": "producer", "max.message.bytes": "1048588", "retention.ms": "604800000", "segment.bytes": "1073741824"}


@query("SELECT * FROM (VALUES ('view', 0), ('nothing', 3)) AS t(name, error)")
def delete_topics(spark, d):
    return C.delete_topics(spark.createDataFrame([("view",), ("nothing",)], "name string"), V.table(spark, d, "events").select(F.col("event_type").alias("name")))


@query(
    """WITH q AS (SELECT event_type || '-' || (event_id % 3) AS name FROM events WHERE event_id < 12), c AS (SELECT DISTINCT event_type || '-0' AS name FROM events)
    SELECT name, CASE WHEN count(*) > 1 THEN 'duplicate' WHEN name NOT IN (SELECT name FROM c) THEN 'missing' END AS error FROM q GROUP BY name"""
)
def batch_delete_check(spark, d):
    e = V.table(spark, d, "events")
    return G.batch_check(e.where("event_id < 12").select(F.concat("event_type", F.lit("-"), F.col("event_id") % 3).alias("name")), e.select(F.concat("event_type", F.lit("-0")).alias("name")), False)


COMMANDS = """commands AS (SELECT 'topic-' || user_id AS topic, event_id AS seq, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'append' END AS op, props AS value FROM events)"""


@query(
    with_views(COMMANDS)
    + """, gone AS (SELECT topic, max(seq) AS gone FROM commands WHERE op = 'delete' GROUP BY topic),
    born AS (SELECT c.topic, min(seq) AS born FROM commands c LEFT JOIN gone USING (topic) WHERE op = 'create' AND (gone IS NULL OR seq > gone) GROUP BY c.topic)
    SELECT b.topic, count(c.seq) AS records, arg_max(c.value, c.seq) AS last_value FROM born b LEFT JOIN commands c ON c.topic = b.topic AND c.op = 'append' AND c.seq > born GROUP BY b.topic"""
)
def command_replay(spark, d):
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("append")
    return C.replay(V.table(spark, d, "events").select(F.concat(F.lit("topic-"), "user_id").alias("topic"), F.col("event_id").alias("seq"), op.alias("op"), F.col("props").alias("value")))


@query(
    "SELECT * FROM (VALUES ('a', 0, 'segment.bytes', '1073741824'), ('a', 1, 'cleanup.policy', 'delete'), "
    + ", ".join(f"('b', {i}, '{k}', '{v}')" for i, (k, v) in enumerate(sorted(DEFAULTS.items())))
    + ") AS t(resource, position, name, value)"
)
def config_lookup(spark, d):
    asked = spark.createDataFrame([("a", ["segment.bytes", "no.such", "cleanup.policy"]), ("b", [])], "resource string, names array<string>")
    return C.config_values(asked, DEFAULTS)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def nested_config(spark, d):
    outer = F.concat(F.lit('{"server": {"limits": '), "props", F.lit("}}"))
    return V.table(spark, d, "events").select("event_id", C.nested_value(outer, "server.limits.k").cast("long").alias("k"), C.nested_value(outer, "server.port").alias("missing"))


@query("SELECT * FROM (VALUES (1, CAST(1704164645000 AS BIGINT)), (2, CAST(1704157445000 AS BIGINT)), (3, NULL)) AS t(id, ms)")
def time_bounds(spark, d):
    rows = spark.createDataFrame([(1, "2024-01-02T03:04:05Z"), (2, "2024-01-02T03:04:05+02:00"), (3, "yesterday")], "id int, t string")
    return rows.select("id", C.time_bound(F.col("t")).alias("ms"))


@query(
    with_views(RECORDS)
    + """, a AS (SELECT topic || '-' || "partition" AS log, max("offset") AS v FROM records WHERE "offset" < 10 AND "partition" < 3 GROUP BY ALL), b AS (SELECT topic || '-' || "partition" AS log, max("offset") AS v FROM records WHERE topic <> 'view' GROUP BY ALL)
    SELECT log, CASE WHEN a.v IS NULL THEN 'created' WHEN b.v IS NULL THEN 'deleted' ELSE 'updated' END AS event FROM a FULL JOIN b USING (log) WHERE a.v IS DISTINCT FROM b.v"""
)
def change_events(spark, d):
    r = V.records(spark, d).withColumn("log", F.concat_ws("-", "topic", F.col("partition").cast("string")))
    state = lambda rows: rows.groupBy("log").agg(F.max("offset").alias("v"))
    return C.changes(state(r.where("offset < 10 and partition < 3")), state(r.where("topic <> 'view'")), "log", "v")


@query("SELECT * FROM (VALUES ('t1', 'a', '1,2,5,3'), ('t1', 'b', '4'), ('t2', 'a', '7')) AS t(transactional_id, topic, partitions)")
def txn_partitions(spark, d):
    own = spark.createDataFrame([("t1", "a", [1, 2]), ("t2", "a", [7])], "transactional_id string, topic string, partitions array<int>")
    added = spark.createDataFrame([("t1", "a", 5, 1), ("t1", "a", 2, 2), ("t1", "a", 3, 3), ("t1", "b", 4, 4)], "transactional_id string, topic string, partition int, seq int")
    return C.add_partitions(own, added).withColumn("partitions", F.array_join(F.col("partitions").cast("array<string>"), ","))


@query(
    with_views(RECORDS)
    + """, s AS (SELECT topic, "partition", count(*) AS n FROM records GROUP BY ALL) SELECT count(*) AS logs, CAST(sum((n - 1) % 40 + 1) AS BIGINT) AS records FROM s"""
)
def pending_batches(spark, d):
    return C.pending(G.flush_batches(V.records(spark, d), 40, 1 << 40))


@query(with_views(RECORDS, HWM, REPLICAS) + """SELECT topic, "partition", replicas[1] AS leader, array_to_string(replicas, ',') AS replicas FROM replicas""")
def metadata_roundtrip(spark, d):
    """Topic metadata written as JSON and read back."""
    path = f"{shared_folder(spark)}/metadata-{uuid.uuid4().hex}"
    part = F.struct("partition", "replicas", F.col("replicas").alias("isr"), F.col("replicas")[0].alias("leader"), F.lit(0).alias("epoch"))
    topics = V.replicas(V.marks(spark, d)).groupBy(F.col("topic").alias("name")).agg(F.lit(3).alias("replication_factor"), F.array_sort(F.collect_list(part)).alias("partitions"), F.lit(0).cast("long").alias("created_ms"), F.lit(0).cast("long").alias("updated_ms"))
    C.write_metadata(topics, path)
    return C.read_metadata(spark, path).select("topic", "partition", "leader", F.array_join(F.col("replicas").cast("array<string>"), ",").alias("replicas"))


@query("SELECT * FROM (VALUES ('users', NULL, 'incompatible'), ('orders', 3, NULL), ('fresh', 1, NULL), ('broken', NULL, 'invalid')) AS t(subject, version, error)")
def schema_register(spark, d):
    versions = _versions(spark)
    candidates = spark.createDataFrame(
        [("users", "AVRO", _avro("name*", "mail", "zip")), ("orders", "AVRO", _avro("id", "total", "note*", "tax")), ("fresh", "AVRO", _avro("id")), ("broken", "JSON", "{")], "subject string, kind string, schema string"
    )
    return C.register(candidates, versions, spark.createDataFrame(MODES, "subject string, mode string"))

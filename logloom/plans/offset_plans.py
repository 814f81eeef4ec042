"""Queries on offsets, lag and sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import offsets as O
from logloom.operators import sizes as Z
from logloom.plans import views as V
from logloom.plans.registry import query
from logloom.plans.views import COMMITS, HWM, RECORDS, with_views

GROUPS = [("group-0", "Stable"), ("group-1", "Empty"), ("group-2", "Dead")]
GROUPS_SQL = "groups AS (SELECT * FROM (VALUES ('group-0', 'Stable'), ('group-1', 'Empty'), ('group-2', 'Dead')) AS g(group_id, state))"
LAG = 'lag AS (SELECT group_id, topic, "partition", c."offset", hwm, CAST(greatest(hwm - c."offset", 0) AS BIGINT) AS lag FROM commits c JOIN hwm USING (topic, "partition"))'
LAG_VIEWS = with_views(RECORDS, HWM, COMMITS, LAG)


def _lag(spark, d):
    marks = V.marks(spark, d)
    return O.consumer_lag(V.commits(marks), marks)


def _groups(spark):
    return spark.createDataFrame(GROUPS, "group_id string, state string")


@query(with_views(RECORDS, HWM) + "SELECT * FROM hwm")
def hwm(spark, d):
    return O.high_water_marks(V.records(spark, d))


@query(with_views(RECORDS) + 'SELECT topic, "partition", CAST(count(*) AS BIGINT) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM records GROUP BY ALL')
def partition_sizes(spark, d):
    return Z.partition_sizes(V.records(spark, d))


TOPIC_STATS = """stats AS (SELECT topic, count(*) AS partitions, CAST(sum(hwm) AS BIGINT) AS messages, CAST(sum(bytes) AS BIGINT) AS bytes
    FROM (SELECT topic, "partition", max("offset") + 1 AS hwm, sum(bytes) AS bytes FROM records GROUP BY ALL) GROUP BY topic)"""


@query(with_views(RECORDS, TOPIC_STATS) + "SELECT * FROM stats")
def topic_stats(spark, d):
    return Z.topic_stats(V.records(spark, d))


@query(with_views(RECORDS, TOPIC_STATS) + "SELECT count(*) AS topics, CAST(sum(partitions) AS BIGINT) AS partitions, CAST(sum(messages) AS BIGINT) AS messages, CAST(sum(bytes) AS BIGINT) AS bytes FROM stats")
def cluster_stats(spark, d):
    return Z.cluster_stats(Z.topic_stats(V.records(spark, d)))


@query(with_views(RECORDS) + 'SELECT topic, "partition", count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, round(sum(bytes) / 1048576.0, 9) AS mb FROM records GROUP BY ROLLUP (topic, "partition")')
def data_stats_rollup(spark, d):
    return Z.data_stats(V.records(spark, d))


@query(
    with_views(RECORDS)
    + 'SELECT topic, "partition", CAST(sum(bytes) AS BIGINT) AS bytes, CAST(max("offset") + 1 AS BIGINT) AS leo, CAST(sum(bytes) // 104857600 + 1 AS BIGINT) AS segments FROM records GROUP BY ALL'
)
def storage_metrics(spark, d):
    return Z.storage_metrics(V.records(spark, d))


@query(with_views(RECORDS) + 'SELECT topic, "partition", CAST(sum(bytes) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS offset_lag FROM records GROUP BY ALL')
def log_dirs(spark, d):
    return Z.log_dirs(Z.partition_sizes(V.records(spark, d)))


@query(
    with_views(RECORDS)
    + """, sizes AS (SELECT topic, "partition", CAST(sum(bytes) AS DOUBLE) AS b FROM records GROUP BY ALL)
    SELECT topic, "partition", CASE WHEN b < 1024 THEN printf('%.2f B', b) WHEN b < 1048576 THEN printf('%.2f KB', b / 1024) ELSE printf('%.2f MB', b / 1048576) END AS size FROM sizes"""
)
def human_sizes(spark, d):
    return Z.partition_sizes(V.records(spark, d)).select("topic", "partition", Z.human_size("bytes").alias("size"))


@query(
    with_views(RECORDS)
    + """SELECT topic, min("timestamp") AS first_ms, max("timestamp") AS last_ms, count(*) AS n,
    round(count(*) / nullif((max("timestamp") - min("timestamp")) / 1000.0, 0), 9) AS per_second,
    round(sum(bytes) / 1048576.0 / nullif((max("timestamp") - min("timestamp")) / 1000.0, 0), 12) AS mb_per_second FROM records GROUP BY topic"""
)
def throughput_summary(spark, d):
    return Z.throughput(V.records(spark, d))


@query(LAG_VIEWS + "SELECT * FROM lag")
def consumer_lag(spark, d):
    return _lag(spark, d)


@query(LAG_VIEWS + 'SELECT group_id, topic, "partition", CAST(sum(lag) AS BIGINT) AS lag FROM lag GROUP BY ROLLUP (group_id, topic, "partition")')
def lag_rollup(spark, d):
    return O.lag_rollup(_lag(spark, d))


@query(
    LAG_VIEWS
    + """, t AS (SELECT topic, CAST(sum(lag) AS BIGINT) AS total, max(lag) AS max_lag, round(avg(lag), 6) AS avg_lag, count(*) AS n FROM lag GROUP BY topic)
    SELECT *, round(total * 100.0 / max(total) OVER (), 6) AS share, CASE WHEN total > 1000 THEN 'high' WHEN total > 100 THEN 'medium' ELSE 'low' END AS level FROM t"""
)
def lag_summary(spark, d):
    return O.lag_summary(_lag(spark, d))


@query(
    LAG_VIEWS
    + """, t AS (SELECT group_id, topic, CAST(sum(lag) AS BIGINT) AS total FROM lag GROUP BY ALL)
    SELECT group_id, CAST(sum(total) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n_topics, max(total) AS largest FROM t GROUP BY group_id"""
)
def lag_nested(spark, d):
    nested = O.nested_lag(_lag(spark, d))
    return nested.select("group_id", "total", F.size("topics").cast("long").alias("n_topics"), F.array_max(F.transform("topics", lambda t: t.total)).alias("largest"))


@query(
    LAG_VIEWS
    + """SELECT g.group_id, h.topic, h."partition", CAST(coalesce(c."offset", -1) AS BIGINT) AS "offset" FROM hwm h, (VALUES ('group-0'), ('group-9')) AS g(group_id)
    LEFT JOIN commits c ON c.group_id = g.group_id AND c.topic = h.topic AND c."partition" = h."partition" """
)
def committed_or_minus_one(spark, d):
    marks = V.marks(spark, d)
    requested = marks.select(F.explode(F.array(F.lit("group-0"), F.lit("group-9"))).alias("group_id"), "topic", "partition")
    return O.committed_or_minus_one(requested, V.commits(marks))


@query(
    with_views(RECORDS, HWM, COMMITS, GROUPS_SQL)
    + """SELECT group_id, topic, "partition", CASE WHEN state IN ('Empty', 'Dead') THEN hwm ELSE c."offset" END AS "offset",
    CASE WHEN state IN ('Empty', 'Dead') THEN 'reset' ELSE 'refused' END AS status FROM commits c JOIN groups USING (group_id) JOIN hwm USING (topic, "partition")"""
)
def reset_offsets(spark, d):
    marks = V.marks(spark, d)
    return O.reset_offsets(V.commits(marks), _groups(spark), marks, "latest")


@query(with_views(RECORDS, HWM, COMMITS, GROUPS_SQL) + "SELECT c.* FROM commits c JOIN groups USING (group_id) WHERE state NOT IN ('Empty', 'Dead')")
def delete_group_offsets(spark, d):
    return O.delete_group_offsets(V.commits(V.marks(spark, d)), _groups(spark))


COMMIT_LOG = """commit_log AS (SELECT 'g' || (o_custkey % 5) AS group_id, o_orderpriority AS topic, CAST(o_custkey % 3 AS INTEGER) AS "partition", o_custkey AS "offset", o_orderkey AS seq FROM orders)"""


def _commit_log(spark, d):
    return V.table(spark, d, "orders").select(
        F.concat(F.lit("g"), F.col("o_custkey") % 5).alias("group_id"), F.col("o_orderpriority").alias("topic"), (F.col("o_custkey") % 3).cast("int").alias("partition"), F.col("o_custkey").alias("offset"), F.col("o_orderkey").alias("seq")
    )


@query(with_views(COMMIT_LOG) + 'SELECT group_id, topic, "partition", CAST(arg_max("offset", seq) AS BIGINT) AS "offset" FROM commit_log GROUP BY ALL')
def latest_commits(spark, d):
    return O.latest_commits(_commit_log(spark, d))


WANTED = """wanted AS (SELECT topic, "partition", CAST(1704067200000 + CAST(i AS BIGINT) * 500000000 AS BIGINT) AS wanted_ms FROM hwm, (SELECT unnest([-1, 1, 2, 4, 6]) AS i))"""
FOUND = 'SELECT w.topic, w."partition", wanted_ms, CAST(coalesce((SELECT min("offset") FROM records r WHERE r.topic = w.topic AND r."partition" = w."partition" AND r."timestamp" >= wanted_ms), {past}) AS BIGINT) AS "offset" FROM wanted w JOIN hwm USING (topic, "partition")'


def _wanted(marks):
    steps = F.explode(F.array(*(F.lit(1704067200000 + i * 500000000) for i in (-1, 1, 2, 4, 6))))
    return marks.select("topic", "partition", steps.alias("wanted_ms"))


@query(with_views(RECORDS, HWM, WANTED) + FOUND.format(past="hwm"))
def offset_for_timestamp(spark, d):
    records = V.records(spark, d)
    marks = O.high_water_marks(records)
    return O.offset_for_timestamp(records, _wanted(marks), marks)


@query(with_views(RECORDS, HWM, WANTED) + FOUND.format(past="NULL"))
def asof_forward(spark, d):
    records = V.records(spark, d)
    return O.asof_forward(_wanted(O.high_water_marks(records)), records)


@query(with_views(RECORDS) + 'SELECT topic, "partition", CAST(min("offset") AS BIGINT) AS earliest, CAST(max("offset") + 1 AS BIGINT) AS latest FROM records WHERE "offset" >= 5 GROUP BY ALL')
def earliest_latest(spark, d):
    return O.log_ends(V.records(spark, d).where("offset >= 5"))


@query(with_views(RECORDS) + 'SELECT topic, "partition", CAST(0 AS BIGINT) AS earliest, CAST(max("offset") + 1 AS BIGINT) AS latest FROM records WHERE "offset" >= 5 GROUP BY ALL')
def earliest_latest_compat(spark, d):
    return O.earliest_compat(O.log_ends(V.records(spark, d).where("offset >= 5")))


CONSUMERS = "consumers AS (SELECT * FROM (VALUES ('c1', 'earliest', ['click', 'view']), ('c2', 'latest', ['view', 'error'])) AS c(consumer_id, reset, topics))"
POSITIONS = """positions AS (SELECT consumer_id, topic, "partition", CAST(CASE WHEN reset = 'earliest' THEN 0 ELSE hwm END AS BIGINT) AS position
    FROM (SELECT consumer_id, reset, unnest(topics) AS topic FROM consumers) JOIN hwm USING (topic))"""


def _positions(spark, d):
    consumers = spark.createDataFrame([("c1", "earliest", ["click", "view"]), ("c2", "latest", ["view", "error"])], "consumer_id string, reset string, topics array<string>")
    return O.initial_positions(consumers, V.marks(spark, d))


@query(with_views(RECORDS, HWM, CONSUMERS, POSITIONS) + "SELECT * FROM positions")
def initial_positions(spark, d):
    return _positions(spark, d)


@query(with_views(RECORDS, HWM, CONSUMERS, POSITIONS) + """SELECT consumer_id, topic, "partition", CASE WHEN consumer_id = 'c1' AND topic = 'view' AND "partition" = 1 THEN CAST(9 AS BIGINT) ELSE position END AS position FROM positions""")
def seek_positions(spark, d):
    seeks = spark.createDataFrame([("c1", "view", 1, 4, 1), ("c1", "view", 1, 9, 2), ("c1", "error", 0, 3, 3)], "consumer_id string, topic string, partition int, offset long, seq int")
    return O.seek(_positions(spark, d), seeks)


@query(
    with_views(RECORDS, HWM, CONSUMERS, POSITIONS)
    + """, assigned AS (SELECT * FROM (VALUES ('c1', 'view', 0), ('c1', 'error', 2), ('c2', 'view', 3)) AS a(consumer_id, topic, "partition"))
    SELECT a.consumer_id, a.topic, a."partition", coalesce(p.position, CAST(0 AS BIGINT)) AS position FROM assigned a LEFT JOIN positions p USING (consumer_id, topic, "partition")"""
)
def reassigned_positions(spark, d):
    assigned = spark.createDataFrame([("c1", "view", 0), ("c1", "error", 2), ("c2", "view", 3)], "consumer_id string, topic string, partition int")
    return O.reassign(_positions(spark, d), assigned)

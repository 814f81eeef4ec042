"""Queries that maintain logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from logloom.operators import maintenance as M
from logloom.operators.offsets import log_ends
from logloom.plans import views as V
from logloom.plans.registry import query
from logloom.plans.views import RECORDS, SEGMENTED, with_views
from logloom.sources.sinks import shared_folder

NOW = 1706745600000
COLUMNS = 'topic, "partition", "offset", "timestamp", key, value, bytes, segment'
ACTIVE = 'active AS (SELECT topic, "partition", max(segment) AS active FROM segmented GROUP BY ALL)'
COMPACTED = f"""ranked AS (SELECT s.*, active, row_number() OVER (PARTITION BY topic, "partition", segment < active, key ORDER BY "offset" DESC) AS rn FROM segmented s JOIN active USING (topic, "partition")),
    compacted AS (SELECT {COLUMNS}, active FROM ranked WHERE segment = active OR rn = 1)"""
LISTED = """listed AS (SELECT topic, "partition", segment, min("offset") AS base_offset, max("offset") + 1 AS next_offset, CAST(sum(bytes) AS BIGINT) AS bytes, max("timestamp") AS newest_ms FROM segmented GROUP BY ALL)"""


def _segmented(spark, d):
    return V.segmented(V.records(spark, d))


def _compacted(spark, d):
    return M.compact(_segmented(spark, d))


@query(with_views(RECORDS, SEGMENTED, ACTIVE, COMPACTED) + f"SELECT {COLUMNS} FROM compacted")
def compact_latest(spark, d):
    return _compacted(spark, d)


@query(
    with_views(RECORDS, SEGMENTED, ACTIVE, COMPACTED)
    + f"""SELECT topic, "partition", CAST(CASE WHEN segment = active THEN "offset"
        ELSE min("offset") OVER (PARTITION BY topic, "partition") + row_number() OVER (PARTITION BY topic, "partition" ORDER BY "offset") - 1 END AS BIGINT) AS "offset",
        "timestamp", key, value, bytes, segment FROM compacted"""
)
def compact_renumber_compat(spark, d):
    return M.renumber(_compacted(spark, d))


@query(
    with_views(RECORDS, SEGMENTED, ACTIVE, COMPACTED)
    + """SELECT (SELECT count(*) FROM records) AS rows_before, count(*) AS rows_after, CAST((SELECT count(*) FROM records) - count(*) AS BIGINT) AS keys_removed,
    CAST((SELECT sum(bytes) FROM records) - sum(bytes) AS BIGINT) AS bytes_removed FROM compacted"""
)
def compaction_totals(spark, d):
    return M.compaction_totals(_segmented(spark, d), _compacted(spark, d))


DIRTY = """dirty AS (SELECT topic, "partition", segment, n, unique_keys, round((n - unique_keys) / n, 9) AS dirty, (n - unique_keys) / n >= 0.5 AS compactable, CAST(floor(bytes * ((n - unique_keys) / n)) AS BIGINT) AS savings
    FROM (SELECT topic, "partition", segment, count(*) AS n, count(DISTINCT key) AS unique_keys, sum(bytes) AS bytes FROM segmented GROUP BY ALL) JOIN active USING (topic, "partition") WHERE segment < active)"""


@query(with_views(RECORDS, SEGMENTED, ACTIVE, DIRTY) + "SELECT * FROM dirty")
def dirty_ratio(spark, d):
    return M.dirty_ratio(_segmented(spark, d))


@query(with_views(RECORDS, SEGMENTED, ACTIVE, DIRTY) + 'SELECT topic, "partition", bool_or(compactable) AS needed FROM dirty GROUP BY ALL')
def needs_compaction(spark, d):
    return M.needs_compaction(M.dirty_ratio(_segmented(spark, d)))


@query(with_views(RECORDS, SEGMENTED, LISTED) + "SELECT * FROM listed")
def segment_listing(spark, d):
    return M.segments(_segmented(spark, d))


@query(
    with_views(RECORDS, SEGMENTED, LISTED)
    + """SELECT *, sum(bytes) OVER (PARTITION BY topic, "partition" ORDER BY base_offset DESC) > 9000 AND base_offset < max(base_offset) OVER (PARTITION BY topic, "partition") AS deleted FROM listed"""
)
def retention_by_size(spark, d):
    return M.retain_by_size(M.segments(_segmented(spark, d)), 9000)


@query(
    with_views(RECORDS, SEGMENTED, LISTED)
    + f""", o AS (SELECT *, {NOW} - newest_ms > 864000000 AND base_offset < max(base_offset) OVER (PARTITION BY topic, "partition") AS old FROM listed)
    SELECT * EXCLUDE (old), bool_and(old) OVER (PARTITION BY topic, "partition" ORDER BY base_offset) AS deleted FROM o"""
)
def retention_by_age(spark, d):
    return M.retain_by_age(M.segments(_segmented(spark, d)), NOW, 10 * 86_400_000)


@query(
    with_views(RECORDS)
    + """SELECT topic, "partition", "offset", "timestamp", key, value, bytes FROM records WHERE topic <> 'view' OR "partition" > 1 OR "offset" < 17"""
)
def truncate_to(spark, d):
    ends = spark.createDataFrame([("view", 0, 17), ("view", 1, 17)], "topic string, partition int, end long")
    return M.truncate(V.records(spark, d), ends)


@query(
    with_views(RECORDS, V.HWM)
    + """, q AS (SELECT * FROM (VALUES ('view', 0, 10), ('view', 1, -1), ('view', 2, 100000000), ('none', 0, 1)) AS q(topic, "partition", before))
    SELECT q.topic, q."partition", CAST(before AS BIGINT) AS before, CAST(CASE WHEN hwm IS NULL THEN 3 WHEN before > hwm THEN 1 ELSE 0 END AS INTEGER) AS error,
    CAST(CASE WHEN hwm IS NULL OR before > hwm THEN -1 WHEN before = -1 THEN hwm ELSE before END AS BIGINT) AS low_watermark FROM q LEFT JOIN hwm USING (topic, "partition")"""
)
def delete_records_before(spark, d):
    asked = spark.createDataFrame([("view", 0, 10), ("view", 1, -1), ("view", 2, 100000000), ("none", 0, 1)], "topic string, partition int, before long")
    return M.delete_before(asked, log_ends(V.records(spark, d)))


@query(with_views(RECORDS) + f'SELECT topic, "partition", CAST({NOW} - arg_min("timestamp", "offset") AS BIGINT) AS age_ms FROM records GROUP BY ALL')
def oldest_age(spark, d):
    return M.oldest_age(V.records(spark, d), NOW)


BROKEN = """broken AS (SELECT topic, "partition", "offset" AS position, CASE WHEN topic = 'view' AND "offset" = 40 THEN 3 ELSE "offset" END AS "offset" FROM records)"""
VALIDATED = """marked AS (SELECT *, "offset" <= lag("offset") OVER (PARTITION BY topic, "partition" ORDER BY position) AS bad FROM broken),
    firsts AS (SELECT topic, "partition", min(position) FILTER (WHERE bad) AS bad_at, count(*) AS total FROM marked GROUP BY ALL),
    validated AS (SELECT b.topic, b."partition", total, count(*) FILTER (WHERE bad_at IS NULL OR position < bad_at) AS valid, total - count(*) FILTER (WHERE bad_at IS NULL OR position < bad_at) AS truncated, bad_at IS NULL AS is_valid
        FROM broken b JOIN firsts USING (topic, "partition") GROUP BY b.topic, b."partition", total, bad_at)"""


def _validated(spark, d):
    rows = V.records(spark, d).withColumn("position", F.col("offset"))
    return M.validate(rows.withColumn("offset", F.when((F.col("topic") == "view") & (F.col("offset") == 40), F.lit(3)).otherwise(F.col("offset"))))


@query(with_views(RECORDS, BROKEN, VALIDATED) + "SELECT * FROM validated")
def validate_offsets(spark, d):
    return _validated(spark, d)


@query(
    with_views(RECORDS, BROKEN, VALIDATED)
    + """SELECT topic, CAST(sum(valid) AS BIGINT) AS recovered, CAST(sum(truncated) AS BIGINT) AS truncated, bool_or(NOT is_valid) AS corrupted,
    coalesce(string_agg(CASE WHEN NOT is_valid THEN 'partition ' || "partition" || ': ' || truncated || ' records' END, '; ' ORDER BY "partition"), '') AS errors FROM validated GROUP BY topic"""
)
def recovery_summary(spark, d):
    return M.recovery_summary(_validated(spark, d))


@query(
    with_views(RECORDS)
    + """SELECT topic, "partition", count(*) AS records, CAST(count(*) FILTER (WHERE "offset" <> 7) AS BIGINT) AS entries, count(*) = count(*) FILTER (WHERE "offset" <> 7) AS consistent FROM records GROUP BY ALL"""
)
def verify_index(spark, d):
    rows = V.records(spark, d)
    return M.verify_counts(rows, rows.where("offset <> 7"))


@query(
    with_views(RECORDS, SEGMENTED)
    + """SELECT topic, "partition", segment, "offset", CAST(coalesce(sum(bytes) OVER (PARTITION BY topic, "partition", segment ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position, "timestamp" FROM segmented"""
)
def index_rebuilt(spark, d):
    return M.rebuild_index(V.segmented(V.records(spark, d)))


@query(
    with_views(RECORDS)
    .replace("WITH ", "WITH RECURSIVE ", 1)
    + """, walk AS (
        SELECT topic, "partition", "offset", bytes AS held, CAST(0 AS BIGINT) AS segment FROM records WHERE "offset" = 0
        UNION ALL
        SELECT r.topic, r."partition", r."offset", CASE WHEN w.held >= 4096 THEN r.bytes ELSE w.held + r.bytes END, CASE WHEN w.held >= 4096 THEN w.segment + 1 ELSE w.segment END
        FROM walk w JOIN records r ON r.topic = w.topic AND r."partition" = w."partition" AND r."offset" = w."offset" + 1)
    SELECT topic, "partition", "offset", segment FROM walk"""
)
def segment_assignment(spark, d):
    return M.assign_segments(V.records(spark, d), 4096).select("topic", "partition", "offset", "segment")


@query(
    """WITH s AS (SELECT o_orderpriority AS log, o_orderkey AS id, CAST(epoch_us(o_orderdate) // 1000 AS BIGINT) AS created_ms FROM orders)
    SELECT *, row_number() OVER (PARTITION BY log ORDER BY created_ms DESC, id) <= 20 AND 1000000000000 - created_ms <= 86400000000 AS kept FROM s"""
)
def snapshots_to_keep(spark, d):
    from logloom.model import epoch_ms

    s = V.table(spark, d, "orders").select(F.col("o_orderpriority").alias("log"), F.col("o_orderkey").alias("id"), epoch_ms(F.col("o_orderdate")).alias("created_ms"))
    return M.snapshots_to_keep(s, 20, 1000000000000, 86400000000)


SNAPSHOT = """SELECT topic, "partition", 's1' AS id, CAST(1000 AS BIGINT) AS created_ms, CAST(min("offset") AS BIGINT) AS base_offset, CAST(max("offset") + 1 AS BIGINT) AS high_water_mark,
    count(DISTINCT segment) AS num_segments, CAST(sum(bytes) AS BIGINT) AS total_size, string_agg(DISTINCT "offset" - "offset" % 100, ',' ORDER BY "offset" - "offset" % 100) AS segment_offsets FROM segmented GROUP BY ALL"""


def _snapshots(spark, d):
    """Two snapshots of all logs, the second without topic `error`."""
    store = M.Snapshots(spark, f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}")
    rows = _segmented(spark, d)
    store.create(rows, "s1", 1000)
    store.create(rows.where("topic <> 'error'"), "s2", 2000)
    return store


@query(with_views(RECORDS, SEGMENTED) + SNAPSHOT)
def snapshot_create(spark, d):
    found = M.Snapshots(spark, f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}").create(_segmented(spark, d), "s1", 1000)
    return found.withColumn("segment_offsets", F.array_join(F.col("segment_offsets").cast("array<string>"), ","))


@query(with_views(RECORDS) + """, n AS (SELECT count(*) FILTER (WHERE topic <> 'error') AS two, count(*) AS one, count(DISTINCT (topic, "partition")) AS logs, count(DISTINCT (topic, "partition")) FILTER (WHERE topic <> 'error') AS logs2,
    sum(bytes) AS size1, sum(bytes) FILTER (WHERE topic <> 'error') AS size2 FROM records)
    SELECT CAST(1 AS INTEGER) AS place, 's2' AS id, CAST(2000 AS BIGINT) AS created_ms, CAST(logs2 AS BIGINT) AS logs, CAST(size2 AS BIGINT) AS total_size FROM n UNION ALL SELECT 2, 's1', 1000, logs, CAST(size1 AS BIGINT) FROM n""")
def snapshot_list(spark, d):
    return _snapshots(spark, d).listed()


@query(with_views(RECORDS) + """SELECT 's2' AS id, topic, "partition", CAST(max("offset") + 1 AS BIGINT) AS high_water_mark FROM records WHERE topic <> 'error' GROUP BY ALL""")
def snapshot_get(spark, d):
    return _snapshots(spark, d).get("s2").select("id", "topic", "partition", "high_water_mark")


@query(with_views(RECORDS, SEGMENTED) + f"SELECT {COLUMNS} FROM segmented WHERE topic <> 'error'")
def snapshot_restore(spark, d):
    return _snapshots(spark, d).restore("s2")


@query(with_views(RECORDS) + """SELECT 's2' AS id, true AS deleted, CAST(sum(bytes) AS BIGINT) AS size_left FROM records UNION ALL SELECT 's9', false, CAST(sum(bytes) AS BIGINT) FROM records""")
def snapshot_delete(spark, d):
    store = _snapshots(spark, d)
    done = [(name, store.delete(name)) for name in ("s2", "s9")]
    return spark.createDataFrame(done, "id string, deleted boolean").crossJoin(store.size().select(F.col("total_size").alias("size_left")))

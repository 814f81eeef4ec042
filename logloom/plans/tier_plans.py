"""Queries on storage tiers. Orders are segments (a path for each, its size from the price), line items are reads of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.model import epoch_ms
from logloom.operators import tiering as T
from logloom.plans import views as V
from logloom.plans.registry import query
from logloom.plans.views import with_views

NOW = 1000000000000
SEGMENTS = """segments AS (SELECT 'seg-' || o_orderkey AS path, CAST(floor(o_totalprice * 1000) AS BIGINT) AS size, epoch_us(o_orderdate) // 1000 AS last_modified_ms,
    CASE o_orderstatus WHEN 'F' THEN 'cold' WHEN 'O' THEN 'warm' ELSE 'hot' END AS policy, o_orderstatus = 'F' AS is_archived FROM orders)"""
READS = "reads AS (SELECT 'seg-' || (l_orderkey // 8 * 8) AS path, epoch_us(l_shipdate) // 1000 AS ts_ms, CAST(l_quantity AS BIGINT) AS bytes FROM lineitem)"
PATTERNS = f"""patterns AS (SELECT path, count(*) AS access_count, min(ts_ms) AS first_ms, max(ts_ms) AS last_ms, CAST(sum(bytes) AS BIGINT) AS read_bytes, count(*) / nullif(({NOW} - min(ts_ms)) / 3600000.0, 0) AS per_hour FROM reads GROUP BY path)"""
DECIDED = f"""decided AS (SELECT s.*, CASE WHEN access_count IS NOT NULL AND per_hour >= 0.0005 AND access_count >= 10 THEN 'hot' WHEN ({NOW} - last_modified_ms) / 3600000.0 < 10000 THEN 'hot'
    WHEN ({NOW} - last_modified_ms) / 3600000.0 >= 40000 THEN 'cold' ELSE 'warm' END AS desired FROM segments s LEFT JOIN patterns USING (path))"""
STATS = """stats AS (SELECT count(*) FILTER (WHERE policy = 'hot') AS hot, count(*) FILTER (WHERE policy = 'warm') AS warm, count(*) FILTER (WHERE policy = 'cold') AS cold, count(*) FILTER (WHERE is_archived) AS archived,
    CAST(sum(size) AS BIGINT) AS total_bytes, CAST(coalesce(sum(size) FILTER (WHERE is_archived), 0) AS BIGINT) AS archived_bytes FROM segments)"""
POLICY = T.Policy(warm_hours=10_000, cold_hours=40_000, hot_per_hour=0.0005, hot_reads=10)


def _segments(spark, d):
    o = V.table(spark, d, "orders")
    policy = F.when(F.col("o_orderstatus") == "F", "cold").when(F.col("o_orderstatus") == "O", "warm").otherwise("hot")
    return o.select(
        F.concat(F.lit("seg-"), "o_orderkey").alias("path"), F.floor(F.col("o_totalprice") * 1000).cast("long").alias("size"), epoch_ms(F.col("o_orderdate")).alias("last_modified_ms"), policy.alias("policy"), (F.col("o_orderstatus") == "F").alias("is_archived")
    )


def _patterns(spark, d):
    reads = V.table(spark, d, "lineitem").select(F.concat(F.lit("seg-"), F.expr("l_orderkey div 8 * 8")).alias("path"), epoch_ms(F.col("l_shipdate")).alias("ts_ms"), F.col("l_quantity").cast("long").alias("bytes"))
    return T.access_patterns(reads, NOW)


@query(with_views(READS, PATTERNS) + "SELECT * REPLACE (round(per_hour, 12) AS per_hour) FROM patterns")
def access_frequency(spark, d):
    return _patterns(spark, d).withColumn("per_hour", F.round("per_hour", 12))


@query(with_views(SEGMENTS, READS, PATTERNS, DECIDED) + "SELECT * FROM decided")
def tier_decision(spark, d):
    return T.decide(_segments(spark, d), _patterns(spark, d), NOW, POLICY)


@query(with_views(SEGMENTS, READS, PATTERNS, DECIDED) + "SELECT *, CASE WHEN desired = 'cold' AND policy <> 'cold' THEN 'demote' WHEN desired <> 'cold' AND policy = 'cold' THEN 'promote' ELSE 'none' END AS action FROM decided")
def tier_sweep(spark, d):
    return T.sweep(T.decide(_segments(spark, d), _patterns(spark, d), NOW, POLICY))


@query(with_views(SEGMENTS) + f"SELECT * FROM segments WHERE NOT is_archived AND {NOW} - last_modified_ms > 144000000000")
def age_archiving(spark, d):
    return T.to_archive(_segments(spark, d), NOW, POLICY)


@query(with_views(SEGMENTS) + f"""SELECT path, size, last_modified_ms, CASE WHEN hit THEN 'cold' ELSE policy END AS policy, is_archived OR hit AS is_archived, CASE WHEN hit THEN 'archive/' || path END AS object_key
    FROM (SELECT *, NOT is_archived AND {NOW} - last_modified_ms > 144000000000 AS hit FROM segments)""")
def archive_segments(spark, d):
    segments = _segments(spark, d).withColumn("object_key", F.lit(None).cast("string"))
    return T.archive(segments, T.to_archive(segments, NOW, POLICY))


@query(with_views(SEGMENTS) + "SELECT path, size, last_modified_ms, CASE WHEN is_archived AND size > 200000000 THEN 'hot' ELSE policy END AS policy, is_archived AND size <= 200000000 AS is_archived FROM segments")
def restore_segments(spark, d):
    segments = _segments(spark, d)
    return T.restore(segments, segments.where("size > 200000000"))


@query(with_views(SEGMENTS, STATS) + "SELECT * FROM stats")
def tier_stats(spark, d):
    return T.stats(_segments(spark, d))


@query(
    with_views(SEGMENTS, STATS)
    + """SELECT round((total_bytes - archived_bytes) / 1073741824.0 * 0.023, 9) AS hot_cost, round(archived_bytes / 1073741824.0 * 0.004, 9) AS cold_cost,
    round(archived_bytes * 0.019 / (total_bytes * 0.023) * 100, 9) AS savings_percent FROM stats"""
)
def cost_analysis(spark, d):
    found = T.costs(T.stats(_segments(spark, d)))
    return found.select(*(F.round(c, 9).alias(c) for c in found.columns))


@query(
    with_views(SEGMENTS, STATS)
    + """, c AS (SELECT total_bytes / 1073741824.0 * 0.023 AS hot_cost, archived * CAST(0.1 AS DOUBLE) * CAST(0.004 AS DOUBLE) AS cold_cost FROM stats) SELECT round(hot_cost, 9) AS hot_cost, round(cold_cost, 9) AS cold_cost, round(cold_cost / (hot_cost + cold_cost) * 100, 9) AS savings_percent FROM c"""
)
def cost_analysis_compat(spark, d):
    found = T.costs_compat(T.stats(_segments(spark, d)))
    return found.select(*(F.round(c, 9).alias(c) for c in found.columns))

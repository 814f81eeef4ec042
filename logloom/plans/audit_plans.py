"""Queries on audit events."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import audit as A
from logloom.plans import views as V
from logloom.plans.registry import query
from logloom.plans.views import AUDIT, with_views

WITH = with_views(AUDIT)


@query(
    WITH
    + """SELECT * FROM audit WHERE ts_ms BETWEEN 1704500000000 AND 1706000000000 AND event_type IN ('click', 'error') AND principal IN ('user1', 'user2', 'user3', 'user8')
    AND result = 'success' AND resource_type = 'topic'"""
)
def audit_query(spark, d):
    return A.audit_filter(
        V.audit(spark, d), start_ms=1704500000000, end_ms=1706000000000, types=["click", "error"], principals=["user1", "user2", "user3", "user8"], result="success", resource_type="topic"
    )


@query(WITH + "SELECT * FROM audit WHERE severity = 'error' ORDER BY seq LIMIT 25 OFFSET 50")
def audit_page(spark, d):
    return A.page(A.audit_filter(V.audit(spark, d), severity="error"), 50, 25)


@query(WITH + "SELECT *, (SELECT count(*) FROM audit WHERE severity = 'error') AS total FROM audit WHERE severity = 'error' ORDER BY seq LIMIT 25 OFFSET 50")
def audit_page_total(spark, d):
    return A.page_with_total(A.audit_filter(V.audit(spark, d), severity="error"), 50, 25)


@query(WITH + "SELECT * FROM audit WHERE severity = 'error' ORDER BY seq LIMIT 25")
def audit_page_compat(spark, d):
    return A.page_compat(A.audit_filter(V.audit(spark, d), severity="error"), 1_000_000_000, 25)


@query(WITH + "SELECT * FROM audit WHERE event_id = 'ev-77'")
def audit_by_id(spark, d):
    return A.by_id(V.audit(spark, d), "ev-77")


@query(
    WITH
    + """SELECT 'total' AS dimension, '' AS value, count(*) AS n FROM audit UNION ALL SELECT 'type', event_type, count(*) FROM audit GROUP BY ALL UNION ALL
    SELECT 'severity', severity, count(*) FROM audit GROUP BY ALL UNION ALL SELECT 'principal', principal, count(*) FROM audit GROUP BY ALL UNION ALL SELECT 'result', result, count(*) FROM audit GROUP BY ALL"""
)
def audit_stats(spark, d):
    return A.stats(V.audit(spark, d))


@query(WITH + "SELECT * FROM audit WHERE seq >= (SELECT min(seq) FROM audit WHERE 1706745600000 - ts_ms < 432000000)")
def audit_retention(spark, d):
    return A.retain(V.audit(spark, d), 1706745600000, 432_000_000)


@query(
    WITH
    + """SELECT CAST(-1 AS BIGINT) AS seq, 'timestamp,event_id,event_type,severity,principal,host,resource_type,resource_name,operation,result' AS line UNION ALL
    SELECT seq, concat_ws(',', strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%SZ'), event_id, event_type, severity, principal, host, resource_type, resource_name, operation, result) FROM audit"""
)
def audit_export_csv(spark, d):
    return A.csv_lines_compat(V.audit(spark, d))


@query("SELECT c_custkey, CASE WHEN length(k) <= 4 THEN '****' ELSE substr(k, 1, 4) || '****' END AS masked FROM (SELECT c_custkey, substr(c_name, 1, CAST(c_custkey % 9 AS INTEGER)) AS k FROM customer)")
def mask_keys(spark, d):
    c = V.table(spark, d, "customer").select("c_custkey", F.expr("substr(c_name, 1, cast(c_custkey % 9 as int))").alias("k"))
    return c.select("c_custkey", A.mask_key(F.col("k")).alias("masked"))


@query("SELECT s_suppkey, s_name AS \"broker.name\", '***REDACTED***' AS \"Admin.Password\" FROM supplier".replace('"broker.name"', "name").replace('"Admin.Password"', "password"))
def redacted_config(spark, d):
    s = V.table(spark, d, "supplier").select("s_suppkey", A.redact(F.create_map(F.lit("broker.name"), "s_name", F.lit("Admin.PassWord"), "s_name")).alias("m"))
    return s.select("s_suppkey", F.col("m")["broker.name"].alias("name"), F.col("m")["Admin.PassWord"].alias("password"))


@query(
    """SELECT s_suppkey, s_name AS name, '***REDACTED***' AS private_part, s_name AS inner_name, '***REDACTED***' AS inner_token, '***REDACTED***' AS api_key, s_name AS region
    FROM supplier"""
)
def redacted_nested_config(spark, d):
    """Settings in structs and maps, three levels deep."""
    deep = F.struct(F.col("s_name").alias("name"), F.col("s_name").alias("authToken"), F.create_map(F.lit("Api.Key"), "s_name", F.lit("region"), "s_name").alias("more"))
    config = F.struct(F.col("s_name").alias("name"), deep.alias("privatePart"), deep.alias("inner")).alias("config")
    s = V.table(spark, d, "supplier").select("s_suppkey", config)
    found = s.select("s_suppkey", A.redact_nested(F.col("config"), s.schema["config"].dataType).alias("c"))
    more = F.col("c.inner.more")
    return found.select(
        "s_suppkey", F.col("c.name").alias("name"), F.col("c.privatePart").alias("private_part"), F.col("c.inner.name").alias("inner_name"), F.col("c.inner.authToken").alias("inner_token"), more["Api.Key"].alias("api_key"), more["region"].alias("region")
    )


@query(
    """WITH o AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'acl' WHEN 1 THEN 'topic' WHEN 2 THEN 'data' ELSE 'auth' END AS area,
        CASE event_id % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'deny' WHEN 2 THEN 'consume' WHEN 3 THEN 'failure' ELSE 'delete' END AS operation,
        CASE WHEN event_id % 3 = 0 THEN 'broken' ELSE '' END AS error FROM events)
    SELECT event_id, CASE WHEN (area = 'acl' AND operation IN ('create', 'delete', 'update', 'deny')) OR (area = 'topic' AND operation IN ('create', 'delete', 'update'))
        OR (area = 'data' AND operation IN ('produce', 'consume', 'delete')) OR (area = 'auth' AND operation IN ('success', 'failure', 'logout')) THEN area || '.' || operation ELSE 'system.error' END AS event_type,
        CASE WHEN operation = 'deny' THEN 'warning' WHEN error <> '' AND area = 'auth' THEN 'warning' WHEN error <> '' THEN 'error' ELSE 'info' END AS severity,
        CASE WHEN error <> '' OR operation = 'deny' THEN 'failure' ELSE 'success' END AS result FROM o"""
)
def audit_derive(spark, d):
    pick = lambda n, *values: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("event_id") % n + 1).cast("int"))
    o = V.table(spark, d, "events").select(
        "event_id", pick(4, "acl", "topic", "data", "auth").alias("area"), pick(5, "create", "deny", "consume", "failure", "delete").alias("operation"), F.when(F.col("event_id") % 3 == 0, "broken").otherwise("").alias("error")
    )
    return A.derive(o).select("event_id", "event_type", "severity", "result")


@query(
    WITH
    + """, lines AS (SELECT seq, ts_ms, strlen(CAST(to_json(audit) AS VARCHAR)) + 1 AS bytes FROM audit), placed AS (SELECT *, CAST((sum(bytes) OVER (ORDER BY seq) - bytes) // (20000 - (SELECT max(bytes) FROM lines)) AS BIGINT) AS file FROM lines),
    files AS (SELECT file, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, max(ts_ms) AS newest_ms FROM placed GROUP BY file)
    SELECT *, file = (SELECT max(file) FROM files) OR (row_number() OVER (ORDER BY file DESC) <= 6 AND 1706745600000 - newest_ms <= 1814400000) AS kept FROM files"""
)
def audit_rotated(spark, d):
    """Files of at most 20,000 bytes, of which five are kept beside the open one."""
    return A.rotated_files(A.rotate(V.audit(spark, d), 20_000), 5, 1706745600000, 1_814_400_000)

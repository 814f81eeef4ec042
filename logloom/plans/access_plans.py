"""Queries on access control lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.operators import access as C
from logloom.plans import views as V
from logloom.plans.registry import query
from logloom.plans.views import with_views

ENTRIES = [
    ("*", "*", 2, "BUILDING", 3, 3, 3),
    ("user1", "*", 2, "MACHINERY", 3, 2, 3),
    ("user2", "*", 2, "MACHINERY", 3, 3, 2),
    ("*", "host1", 2, "AUTO", 4, 4, 3),
    ("user3", "*", 2, "AUTOMOBILE", 3, 4, 2),
    ("*", "*", 2, "H", 4, 3, 3),
    ("user4", "host2", 2, "*", 3, 2, 3),
    ("user5", "*", 3, "*", 3, 3, 3),
]
COLUMNS = "principal, host, resource_type, resource_name, pattern_type, operation, permission_type"
ENTRIES_SQL = "entries AS (SELECT * FROM (VALUES " + ", ".join(str(e) for e in ENTRIES) + f") AS e({COLUMNS}))"
REQUESTS = """requests AS (SELECT c_custkey AS request_id, 'user' || (c_custkey % 7) AS principal, 'host' || (c_custkey % 3) AS host, 2 AS resource_type, c_mktsegment AS resource_name, CAST(3 + c_custkey % 2 AS INTEGER) AS operation FROM customer)"""
TYPED = ", ".join(f"CAST({c} AS TINYINT) AS {c}" if c.endswith(("_type", "operation")) else c for c in COLUMNS.split(", "))


def _entries(spark):
    return spark.createDataFrame(ENTRIES, "principal string, host string, resource_type byte, resource_name string, pattern_type byte, operation byte, permission_type byte")


def _requests(spark, d):
    return V.table(spark, d, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.concat(F.lit("user"), F.col("c_custkey") % 7).alias("principal"),
        F.concat(F.lit("host"), F.col("c_custkey") % 3).alias("host"),
        F.lit(2).cast("byte").alias("resource_type"),
        F.col("c_mktsegment").alias("resource_name"),
        (3 + F.col("c_custkey") % 2).cast("byte").alias("operation"),
    )


@query(
    with_views(ENTRIES_SQL, REQUESTS)
    + """SELECT r.request_id, coalesce(bool_or(e.permission_type = 3) AND NOT bool_or(e.permission_type = 2), false) AS allowed
    FROM requests r LEFT JOIN entries e ON e.resource_type = r.resource_type AND e.principal IN ('*', r.principal) AND e.host IN ('*', r.host) AND e.operation IN (2, r.operation)
        AND ((e.pattern_type = 3 AND e.resource_name IN ('*', r.resource_name)) OR (e.pattern_type = 4 AND starts_with(r.resource_name, e.resource_name)))
    GROUP BY r.request_id"""
)
def acl_authorize(spark, d):
    return C.authorize(_requests(spark, d), _entries(spark))


@query(with_views(ENTRIES_SQL) + f"SELECT {TYPED} FROM entries WHERE resource_name = '*'")
def acl_list(spark, d):
    return C.matching(_entries(spark), resource_name="*")


@query(with_views(ENTRIES_SQL) + f"SELECT {TYPED} FROM entries WHERE NOT (resource_type = 2 AND permission_type = 2)")
def acl_delete(spark, d):
    return C.without(_entries(spark), resource_type=2, permission_type=2)


@query(with_views(ENTRIES_SQL) + f"SELECT {TYPED} FROM (SELECT * FROM entries UNION ALL SELECT 'user9', '*', 4, 'cluster', 3, 5, 3)")
def acl_add(spark, d):
    own = _entries(spark)
    new = spark.createDataFrame([ENTRIES[0], ("user9", "*", 4, "cluster", 3, 5, 3), ("user9", "*", 4, "cluster", 3, 5, 3)], own.schema)
    return C.add(own, new)


@query(
    with_views(ENTRIES_SQL)
    + """SELECT CAST(resource_type AS TINYINT) AS resource_type, resource_name, CAST(pattern_type AS TINYINT) AS pattern_type, string_agg(principal || '@' || host || ':' || operation || ':' || permission_type, ',' ORDER BY principal, host) AS entries
    FROM entries GROUP BY ALL"""
)
def acl_describe(spark, d):
    one = lambda e: F.concat(e.principal, F.lit("@"), e.host, F.lit(":"), e.operation.cast("string"), F.lit(":"), e.permission_type.cast("string"))
    return C.described(_entries(spark)).withColumn("entries", F.array_join(F.transform("entries", one), ","))


NAMES = [("Topic", "Literal", "Read", "Allow"), ("Group", "Prefixed", "ClusterAction", "Deny"), ("Cluster", "Literal", "All", "Deny"), ("Planet", "Exact", "Dance", "Maybe")]
NAMED = "named AS (SELECT * FROM (VALUES " + ", ".join(map(str, NAMES)) + ") AS n(resource_type, pattern_type, operation, permission_type))"
CODED = """SELECT CAST(CASE resource_type WHEN 'Topic' THEN 2 WHEN 'Group' THEN 3 WHEN 'Cluster' THEN 4 {0} END AS TINYINT) AS resource_type, CAST(CASE pattern_type WHEN 'Literal' THEN 3 WHEN 'Prefixed' THEN 4 {1} END AS TINYINT) AS pattern_type,
    CAST(CASE operation WHEN 'All' THEN 2 WHEN 'Read' THEN 3 WHEN 'ClusterAction' THEN 9 {2} END AS TINYINT) AS operation, CAST(CASE permission_type WHEN 'Deny' THEN 2 WHEN 'Allow' THEN 3 {3} END AS TINYINT) AS permission_type FROM named"""


def _named(spark):
    return spark.createDataFrame(NAMES, "resource_type string, pattern_type string, operation string, permission_type string")


@query(with_views(NAMED) + CODED.format("", "", "", ""))
def acl_parse(spark, d):
    return C.parsed(_named(spark))


@query(with_views(NAMED) + CODED.format("ELSE 2", "ELSE 3", "ELSE 3", "ELSE 3"))
def acl_parse_compat(spark, d):
    return C.parsed(_named(spark), defaults=True)

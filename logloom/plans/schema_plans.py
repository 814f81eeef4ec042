"""Queries on the schema registry and the wire format."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from logloom.operators import schemas as S
from logloom.plans import views as V
from logloom.plans.registry import query
from logloom.plans.views import RECORDS, with_views


def _avro(*names: str) -> str:
    """A record whose fields named with a star have a default."""
    return json.dumps({"type": "record", "name": "r", "fields": [{"name": n.rstrip("*"), "type": "string"} | ({"default": ""} if n.endswith("*") else {}) for n in names]})


VERSIONS = [
    (1, "users", 1, "AVRO", _avro("id")),
    (2, "users", 2, "AVRO", _avro("id", "name*")),
    (3, "users", 3, "AVRO", _avro("name*", "mail")),
    (4, "orders", 1, "AVRO", _avro("id", "total")),
    (5, "orders", 2, "AVRO", _avro("id", "total", "note*")),
    (6, "orders", 3, "AVRO", _avro("id", "total", "note*", "tax")),
    (7, "files", 1, "JSON", json.dumps({"type": "object", "properties": {"path": {"type": "string"}, "size": {"type": "number", "default": 0}}})),
    (8, "files", 2, "JSON", json.dumps({"type": "object", "properties": {"path": {"type": "string"}}})),
]
MODES = [("users", "FULL"), ("orders", "FORWARD_TRANSITIVE")]
VERSIONS_SQL = "versions AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}', {v}, '{k}', '{t}')" for i, s, v, k, t in VERSIONS) + ") AS v(id, subject, version, kind, schema))"
MODES_SQL = "modes AS (SELECT * FROM (VALUES " + ", ".join(str(m) for m in MODES) + ") AS m(subject, mode))"
FIELDS = """fields AS (
    SELECT subject, version, json_extract_string(f, '$.name') AS name, json_exists(f, '$.default') AS has_default FROM (SELECT subject, version, unnest(json_extract(schema, '$.fields[*]')) AS f FROM versions WHERE kind = 'AVRO')
    UNION ALL SELECT subject, version, p, json_exists(schema, '$.properties.' || p || '.default') FROM (SELECT subject, version, schema, unnest(json_keys(schema, '$.properties')) AS p FROM versions WHERE kind = 'JSON'))"""


def _versions(spark):
    return spark.createDataFrame(VERSIONS, "id int, subject string, version int, kind string, schema string")


@query(with_views(VERSIONS_SQL) + "SELECT subject, max(version) AS version, arg_max(id, version) AS id, arg_max(schema, version) AS schema FROM versions GROUP BY subject")
def schema_latest(spark, d):
    return S.latest(_versions(spark))


@query(with_views(VERSIONS_SQL) + "SELECT s.subject, CAST(coalesce(max(version), 0) + 1 AS INTEGER) AS next_version FROM (VALUES ('users'), ('orders'), ('new')) AS s(subject) LEFT JOIN versions USING (subject) GROUP BY s.subject")
def schema_next_version(spark, d):
    return S.next_versions(spark.createDataFrame([("users",), ("orders",), ("new",)], "subject string"), _versions(spark))


@query(
    with_views(VERSIONS_SQL)
    + """SELECT q.subject, q.version, v.schema, CASE WHEN q.subject NOT IN (SELECT subject FROM versions) THEN 40401 WHEN v.schema IS NULL THEN 40402 ELSE 0 END AS error
    FROM (VALUES ('users', 2), ('users', 9), ('nobody', 1)) AS q(subject, version) LEFT JOIN versions v USING (subject, version)"""
)
def schema_lookup(spark, d):
    return S.lookup(spark.createDataFrame([("users", 2), ("users", 9), ("nobody", 1)], "subject string, version int"), _versions(spark))


@query(with_views(VERSIONS_SQL) + "SELECT q.id, v.subject, v.version, v.schema, CASE WHEN v.id IS NULL THEN 40403 ELSE 0 END AS error FROM (VALUES (1), (6), (99)) AS q(id) LEFT JOIN versions v USING (id)")
def schema_by_id(spark, d):
    return S.by_id(spark.createDataFrame([(1,), (6,), (99,)], "id int"), _versions(spark))


@query(with_views(VERSIONS_SQL) + "SELECT subject, string_agg(version, ',' ORDER BY version) AS versions FROM versions GROUP BY subject")
def schema_versions(spark, d):
    found = _versions(spark).groupBy("subject").agg(F.array_sort(F.collect_list("version")).alias("v"))
    return found.select("subject", F.array_join(F.col("v").cast("array<string>"), ",").alias("versions"))


@query(with_views(VERSIONS_SQL) + "SELECT id, subject, version, kind FROM versions WHERE subject <> 'orders'")
def schema_subject_delete(spark, d):
    return S.without_subject(_versions(spark), spark.createDataFrame([("orders",)], "subject string")).select("id", "subject", "version", "kind")


@query(
    with_views(VERSIONS_SQL, FIELDS)
    + """, n AS (SELECT subject, version, list(name ORDER BY name) AS names FROM fields GROUP BY ALL)
    SELECT a.subject, a.version, array_to_string(list_filter(a.names, lambda x: NOT list_contains(b.names, x)), ',') AS added, array_to_string(list_filter(b.names, lambda x: NOT list_contains(a.names, x)), ',') AS removed
    FROM n a JOIN n b ON a.subject = b.subject AND a.version = b.version + 1"""
)
def schema_field_changes(spark, d):
    return S.field_changes(_versions(spark)).select("subject", "version", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query(
    with_views(VERSIONS_SQL, MODES_SQL, FIELDS)
    + """, v AS (SELECT subject, version, coalesce(mode, 'BACKWARD') AS mode FROM versions LEFT JOIN modes USING (subject)),
    pairs AS (SELECT a.subject, a.version, a.mode, b.version AS old FROM v a LEFT JOIN v b ON a.subject = b.subject AND (b.version = a.version - 1 OR (b.version < a.version AND ends_with(a.mode, '_TRANSITIVE')))),
    judged AS (SELECT p.*,
        NOT EXISTS (SELECT 1 FROM fields o WHERE o.subject = p.subject AND o.version = p.old AND o.name NOT IN (SELECT name FROM fields n WHERE n.subject = p.subject AND n.version = p.version)) AS backward,
        NOT EXISTS (SELECT 1 FROM fields n WHERE n.subject = p.subject AND n.version = p.version AND NOT n.has_default AND n.name NOT IN (SELECT name FROM fields o WHERE o.subject = p.subject AND o.version = p.old)) AS forward
        FROM pairs p)
    SELECT subject, version, mode, bool_and(old IS NULL OR CASE WHEN starts_with(mode, 'BACKWARD') THEN backward WHEN starts_with(mode, 'FORWARD') THEN forward WHEN starts_with(mode, 'FULL') THEN backward AND forward ELSE true END) AS ok
    FROM judged GROUP BY subject, version, mode"""
)
def schema_compat(spark, d):
    return S.compatibility(_versions(spark), spark.createDataFrame(MODES, "subject string, mode string"))


@query(with_views(VERSIONS_SQL) + "SELECT id, json_valid(schema) AS valid FROM versions UNION ALL SELECT * FROM (VALUES (101, false), (102, false), (103, true), (104, false))")
def schema_valid(spark, d):
    more = spark.createDataFrame([(101, "x", 1, "AVRO", "{"), (102, "x", 2, "AVRO", '{"name": 1}'), (103, "x", 3, "PROTOBUF", "message X {}"), (104, "x", 4, "PROTOBUF", " ")], _versions(spark).schema)
    return _versions(spark).unionByName(more).select("id", S.is_valid(F.col("schema"), F.col("kind")).alias("valid"))


WIRE = """SELECT topic, "partition", "offset", CASE "offset" % 4 WHEN 0 THEN CAST(1 + "offset" % 8 AS BIGINT) WHEN 1 THEN CAST(77 AS BIGINT) END AS schema_id, CASE WHEN "offset" % 4 < 2 THEN value END AS payload,
    CASE "offset" % 4 WHEN 2 THEN 'short' WHEN 3 THEN 'magic' END AS error FROM records"""


def _wired(spark, d):
    r = V.records(spark, d)
    payload = F.encode("value", "UTF-8")
    turn = F.col("offset") % 4
    wire = (
        F.when(turn == 0, S.wire_encode((1 + F.col("offset") % 8).cast("int"), payload))
        .when(turn == 1, S.wire_encode(F.lit(77), payload))
        .when(turn == 2, F.substring(S.wire_encode(F.lit(1), payload), 1, 4))
        .otherwise(F.concat(F.unhex(F.lit("01")), payload))
    )
    return r.select("topic", "partition", "offset", S.wire_decode(wire).alias("w")).select("topic", "partition", "offset", "w.schema_id", F.decode("w.payload", "UTF-8").alias("payload"), "w.error")


@query(with_views(RECORDS) + WIRE)
def wire_decode(spark, d):
    return _wired(spark, d)


@query(
    with_views(RECORDS, VERSIONS_SQL)
    + f""", wired AS ({WIRE}) SELECT topic, "partition", "offset", schema_id, payload, CASE WHEN error IS NULL AND v.id IS NULL THEN 'unknown schema' ELSE error END AS error, v.schema
    FROM wired LEFT JOIN versions v ON v.id = schema_id"""
)
def wire_with_schema(spark, d):
    return S.with_schemas(_wired(spark, d), _versions(spark))

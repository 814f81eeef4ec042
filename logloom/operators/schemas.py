"""Schema registry: versions, compatibility and the wire format that binds records to schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAGIC = "00"
NOT_FOUND = {"subject": 40401, "version": 40402, "schema": 40403}



def fields(schema: Column) -> Column:
    """The fields of a schema text as an ordered array of (name, has_default): of `fields` with whether a default is given, or of `properties`.

    The presence of a default is what counts, also of one that is null, so it is looked for among the keys of the field.
    """
    raw = F.from_json(F.get_json_object(schema, "$.fields"), "array<map<string,string>>")
    named = F.transform(raw, lambda m: F.struct(m["name"].alias("name"), F.array_contains(F.map_keys(m), "default").alias("has_default")))
    properties = F.from_json(F.get_json_object(schema, "$.properties"), "map<string,map<string,string>>")
    keyed = F.transform(F.map_keys(properties), lambda k: F.struct(k.alias("name"), F.array_contains(F.map_keys(properties[k]), "default").alias("has_default")))
    return F.array_sort(F.coalesce(named, keyed, F.array().cast("array<struct<name:string,has_default:boolean>>")))


def is_valid(schema: Column, kind: Column) -> Column:
    """Whether a schema text can be one: JSON for AVRO (with a type) and JSON, anything but nothing for PROTOBUF."""
    parsed = F.try_parse_json(schema).isNotNull()
    return F.coalesce(F.when(kind == "PROTOBUF", F.length(F.trim(schema)) > 0).when(kind == "AVRO", parsed & F.get_json_object(schema, "$.type").isNotNull()).otherwise(parsed), F.lit(False))


def latest(schemas: DataFrame) -> DataFrame:
    """subject, version, id, schema of the highest version of each subject."""
    last = schemas.groupBy("subject").agg(F.max_by(F.struct("version", "id", "schema"), "version").alias("s"))
    return last.select("subject", "s.version", "s.id", "s.schema")


def next_versions(subjects: DataFrame, schemas: DataFrame) -> DataFrame:
    """subject, next_version: 1 where there is none yet."""
    top = schemas.groupBy("subject").agg(F.max("version").alias("v"))
    return subjects.join(top, "subject", "left").select("subject", (F.coalesce("v", F.lit(0)) + 1).cast("int").alias("next_version"))


def lookup(requests: DataFrame, schemas: DataFrame) -> DataFrame:
    """subject, version, schema, error for requests: 40401 for an unknown subject, 40402 for an unknown version."""
    subjects = schemas.select("subject").distinct().withColumn("known", F.lit(True))
    found = requests.join(subjects, "subject", "left").join(schemas.select("subject", "version", "schema"), ["subject", "version"], "left")
    error = F.when(F.col("known").isNull(), NOT_FOUND["subject"]).when(F.col("schema").isNull(), NOT_FOUND["version"]).otherwise(0)
    return found.select("subject", "version", "schema", error.alias("error"))


def by_id(ids: DataFrame, schemas: DataFrame) -> DataFrame:
    """id, subject, version, schema, error for requests by id: 40403 for an unknown one."""
    found = ids.join(schemas.select("id", "subject", "version", "schema"), "id", "left")
    return found.withColumn("error", F.when(F.col("schema").isNull(), NOT_FOUND["schema"]).otherwise(0))


def field_changes(schemas: DataFrame) -> DataFrame:
    """subject, version, added, removed: names against the version before, in order."""
    names = schemas.withColumn("_names", F.transform(fields(F.col("schema")), lambda f: f["name"]))
    before = F.lag("_names").over(W.partitionBy("subject").orderBy("version"))
    compared = names.withColumn("_before", before).where("_before is not null")
    return compared.select("subject", "version", F.array_except("_names", "_before").alias("added"), F.array_except("_before", "_names").alias("removed"))


def compatible(old: Column, new: Column, mode: str) -> Column:
    """Whether arrays of (name, has_default) are compatible. BACKWARD: no old field is missing from the new ones. FORWARD: every new field that
    is not old has a default. FULL: both. Types aren't compared."""
    names = F.transform(old, lambda f: f["name"])
    backward = F.size(F.array_except(names, F.transform(new, lambda f: f["name"]))) == 0
    forward = F.forall(new, lambda f: F.array_contains(names, f["name"]) | f["has_default"])
    kind = mode.removesuffix("_TRANSITIVE")
    return {"NONE": F.lit(True), "BACKWARD": backward, "FORWARD": forward, "FULL": backward & forward}[kind]


def compatibility(schemas: DataFrame, modes: DataFrame, default_mode: str = "BACKWARD") -> DataFrame:
    """subject, version, mode, ok: each version against the one before or, for transitive modes, against all before. A subject's mode is its
    own or the default."""
    rows = schemas.withColumn("_f", fields(F.col("schema"))).join(modes, "subject", "left").withColumn("mode", F.coalesce("mode", F.lit(default_mode)))
    before = W.partitionBy("subject").orderBy("version").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_all", F.collect_list("_f").over(before))
    against = F.when(F.col("mode").endswith("_TRANSITIVE"), F.col("_all")).otherwise(F.slice("_all", -1, 1))
    against = F.when(F.size("_all") > 0, against).otherwise(F.col("_all"))
    ok = F.lit(True)
    judge = lambda mode: lambda old: compatible(old, F.col("_f"), mode)
    for mode in ("BACKWARD", "FORWARD", "FULL"):
        ok = F.when(F.col("mode").startswith(mode), F.forall(against, judge(mode))).otherwise(ok)
    return rows.select("subject", "version", "mode", ok.alias("ok"))


def without_subject(schemas: DataFrame, subjects: DataFrame) -> DataFrame:
    return schemas.join(subjects, "subject", "left_anti")


def wire_encode(schema_id: Column, payload: Column) -> Column:
    """A zero byte, the schema's id in four bytes, and the payload."""
    return F.concat(F.unhex(F.lit(MAGIC)), F.unhex(F.lpad(F.hex(schema_id), 8, "0")), payload)


def wire_decode(value: Column) -> Column:
    """struct(schema_id, payload, error): shorter than five bytes is `short`, another first byte `magic`."""
    short = F.coalesce(F.octet_length(value), F.lit(0)) < 5
    magic = F.hex(F.substring(value, 1, 1)) != MAGIC
    good = ~short & ~magic
    return F.struct(
        F.when(good, F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("long")).alias("schema_id"),
        F.when(good, F.substring(value, 6, 2147483647)).alias("payload"),
        F.when(short, "short").when(magic, "magic").alias("error"),
    )


def with_schemas(decoded: DataFrame, schemas: DataFrame) -> DataFrame:
    """Decoded records (schema_id) with `schema`, and error `unknown schema` where there is none."""
    ids = schemas.select(F.col("id").cast("long").alias("schema_id"), "schema")
    return decoded.join(ids, "schema_id", "left").withColumn("error", F.when(F.col("error").isNull() & F.col("schema").isNull(), "unknown schema").otherwise(F.col("error")))

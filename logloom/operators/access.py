"""Access control lists. Enumerations are bytes: resource types, pattern types (literal 3, prefix 4), operations, permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.model import small

# The codes of the protocol's enumerations.
RESOURCE_TYPES = {"any": 1, "topic": 2, "group": 3, "cluster": 4, "transactional_id": 5}
PATTERN_TYPES = {"any": 1, "literal": 3, "prefixed": 4}
OPERATIONS = {"any": 1, "all": 2, "read": 3, "write": 4, "create": 5, "delete": 6, "alter": 7, "describe": 8, "cluster_action": 9, "describe_configs": 10, "alter_configs": 11}
PERMISSIONS = {"any": 1, "deny": 2, "allow": 3}

ENTRY = ("principal", "host", "resource_type", "resource_name", "pattern_type", "operation", "permission_type")


def authorize(requests: DataFrame, entries: DataFrame, request_id: str = "request_id") -> DataFrame:
    """`request_id`, allowed: any matching denial refuses, else any matching permission allows, else refused.

    Requests hold principal, host, resource_type, resource_name and operation. Wildcards and prefixes are no equality, so
    an entry's name is matched by equality with everything it could stand for: literal names and `*` with the name, prefixes with
    the name's beginnings of the lengths that prefixes have. Requests join entries on (resource type, kind, name), a hash join,
    and the rest of an entry filters. Entries are broadcast where they are counted to be few: then the key of `*`, which every request
    has, costs no shuffle.
    """
    lengths = [r[0] for r in entries.where(F.col("pattern_type") == PATTERN_TYPES["prefixed"]).select(F.length("resource_name")).distinct().collect()]
    kinds = [F.struct(F.lit(PATTERN_TYPES["literal"]).alias("kind"), F.col("resource_name").alias("name")), F.struct(F.lit(PATTERN_TYPES["literal"]).alias("kind"), F.lit("*").alias("name"))]
    kinds += [F.when(F.length("resource_name") >= n, F.struct(F.lit(PATTERN_TYPES["prefixed"]).alias("kind"), F.substring("resource_name", 1, n).alias("name"))) for n in sorted(lengths)]
    asked = requests.withColumn("_m", F.explode(F.array_distinct(F.array_compact(F.array(*kinds)))))
    asked = asked.select(request_id, F.col("principal").alias("_who"), F.col("host").alias("_from"), F.col("operation").alias("_op"), F.col("resource_type"), F.col("_m.kind").cast("byte").alias("pattern_type"), F.col("_m.name").alias("resource_name"))
    fits = F.col("principal").isin("*") | (F.col("principal") == F.col("_who"))
    fits = fits & (F.col("host").isin("*") | (F.col("host") == F.col("_from")))
    fits = fits & ((F.col("operation") == OPERATIONS["all"]) | (F.col("operation") == F.col("_op")))
    hits = asked.join(small(entries), ["resource_type", "pattern_type", "resource_name"]).where(fits)
    votes = hits.groupBy(request_id).agg(F.bool_or(F.col("permission_type") == PERMISSIONS["deny"]).alias("deny"), F.bool_or(F.col("permission_type") == PERMISSIONS["allow"]).alias("allow"))
    return requests.select(request_id).join(votes, request_id, "left").select(request_id, F.coalesce(F.col("allow") & ~F.col("deny"), F.lit(False)).alias("allowed"))


def coded(name: Column, codes: dict[str, int], default: str | None = None) -> Column:
    """The code of a name as interfaces write it (`ClusterAction` for cluster_action). An unknown name is null, or the default's code, which some
    interfaces take instead."""
    pairs = [F.lit(x) for k, code in codes.items() for x in ("".join(w.title() for w in k.split("_")), code)]
    return F.coalesce(F.element_at(F.create_map(*pairs), name), F.lit(codes[default] if default else None)).cast("byte")


def parsed(rows: DataFrame, defaults: bool = False) -> DataFrame:
    """Rows with the names in resource_type, pattern_type, operation and permission_type replaced by their codes. With `defaults`, unknown names
    become topic, literal, read and allow; without, null, which matches no request."""
    kinds = {"resource_type": (RESOURCE_TYPES, "topic"), "pattern_type": (PATTERN_TYPES, "literal"), "operation": (OPERATIONS, "read"), "permission_type": (PERMISSIONS, "allow")}
    return rows.withColumns({c: coded(F.col(c), codes, usual if defaults else None) for c, (codes, usual) in kinds.items()})


def matching(entries: DataFrame, **wanted) -> DataFrame:
    """Entries that equal every value given (of the seven columns); those not given don't matter, the resource type included."""
    for column, value in wanted.items():
        if column not in ENTRY:
            raise ValueError(f"unknown column {column}")
        if value is not None:
            entries = entries.where(F.col(column) == value)
    return entries


def without(entries: DataFrame, **wanted) -> DataFrame:
    """Entries left after deleting those that `matching` finds."""
    return entries.join(matching(entries, **wanted).select(*ENTRY).distinct(), list(ENTRY), "left_anti")


def add(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries with new ones; ones that are there already, and repetitions among the new, are not added."""
    return entries.unionByName(new.select(*ENTRY).distinct().join(entries, list(ENTRY), "left_anti"))


def described(entries: DataFrame) -> DataFrame:
    """resource_type, resource_name, pattern_type, entries: what applies to each resource, as an ordered array."""
    rest = F.struct("principal", "host", "operation", "permission_type")
    return entries.groupBy("resource_type", "resource_name", "pattern_type").agg(F.array_sort(F.collect_set(rest)).alias("entries"))

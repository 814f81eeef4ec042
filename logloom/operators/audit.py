"""Audit events: filters, pages, statistics, retention, derivation and export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.model import small


def audit_filter(
    events: DataFrame,
    *,
    start_ms: int | None = None,
    end_ms: int | None = None,
    types: Sequence[str] = (),
    principals: Sequence[str] = (),
    resource_type: str | None = None,
    resource_name: str | None = None,
    result: str | None = None,
    severity: str | None = None,
) -> DataFrame:
    """Events that meet every condition given; both ends of the time are included."""
    found = events
    if start_ms is not None:
        found = found.where(F.col("ts_ms") >= start_ms)
    if end_ms is not None:
        found = found.where(F.col("ts_ms") <= end_ms)
    for column, values in (("event_type", types), ("principal", principals)):
        if values:
            found = found.where(F.col(column).isin(*values))
    for column, value in (("resource_type", resource_type), ("resource_name", resource_name), ("result", result), ("severity", severity)):
        if value:
            found = found.where(F.col(column) == value)
    return found


def page(events: DataFrame, offset: int = 0, limit: int = 0, order: str = "seq") -> DataFrame:
    """A page in the order of insertion; past the end it is empty. A limit of 0 is none."""
    found = events.orderBy(order).offset(max(offset, 0))
    return found.limit(limit) if limit > 0 else found


def page_with_total(events: DataFrame, offset: int = 0, limit: int = 0, order: str = "seq") -> DataFrame:
    """`page` with `total`, the number of events that it is a page of."""
    return page(events, offset, limit, order).withColumn("total", F.lit(events.count()).cast("long"))


def page_compat(events: DataFrame, offset: int = 0, limit: int = 0, order: str = "seq") -> DataFrame:
    """`page` as stores do it that ignore an offset past the end and give everything from the start."""
    total = events.count()
    return page(events, offset if 0 < offset < total else 0, limit if 0 < limit < total else 0, order)


def by_id(events: DataFrame, event_id: str) -> DataFrame:
    return events.where(F.col("event_id") == event_id)


def stats(events: DataFrame) -> DataFrame:
    """dimension (total, type, severity, principal, result), value, n: all counts from one pass."""
    sets = events.groupingSets([["event_type"], ["severity"], ["principal"], ["result"], []], "event_type", "severity", "principal", "result")
    counted = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    named = [("type", "event_type", 0b0111), ("severity", "severity", 0b1011), ("principal", "principal", 0b1101), ("result", "result", 0b1110)]
    dimension, value = F.lit("total"), F.lit("")
    for name, column, bits in named:
        dimension = F.when(F.col("g") == bits, name).otherwise(dimension)
        value = F.when(F.col("g") == bits, F.col(column)).otherwise(value)
    return counted.select(dimension.alias("dimension"), value.alias("value"), "n")


def retain(events: DataFrame, now_ms: int, keep_ms: int, order: str = "seq") -> DataFrame:
    """Events from the first one on, in the order of insertion, that is young enough; none if there is no such event."""
    first = events.where(F.lit(now_ms) - F.col("ts_ms") < keep_ms).agg(F.min(order)).first()[0]
    return events.where(F.col(order) >= first) if first is not None else events.limit(0)


def mask_key(key: Column) -> Column:
    """Keys of four characters or fewer are hidden, of others the first four show."""
    return F.when(F.length(key) <= 4, F.lit("****")).otherwise(F.concat(F.substring(key, 1, 4), F.lit("****")))


#: Parts of configuration keys that mark secrets.
SENSITIVE = ("password", "secret", "key", "token", "credential", "private")


def redact(config: Column, hidden: str = "***REDACTED***") -> Column:
    """A map of settings with the values of sensitive keys hidden, whatever their case."""
    return F.transform_values(config, lambda k, v: F.when(F.lower(k).rlike("|".join(SENSITIVE)), F.lit(hidden)).otherwise(v))


def redact_nested(value: Column, kind: T.DataType, hidden: str = "***REDACTED***") -> Column:
    """A setting of any type with the values of sensitive fields and map keys hidden at every depth. What is hidden becomes text; a map whose
    values are no text keeps their type, and hidden ones are null. Arrays stay as they are."""
    if isinstance(kind, T.StructType):
        sensitive = lambda name: any(w in name.lower() for w in SENSITIVE)
        inner = F.struct(*((F.lit(hidden) if sensitive(f.name) else redact_nested(value[f.name], f.dataType, hidden)).alias(f.name) for f in kind.fields))
        return F.when(value.isNotNull(), inner)
    if isinstance(kind, T.MapType):
        text = isinstance(kind.valueType, T.StringType)
        return F.transform_values(value, lambda k, v: F.when(F.lower(k).rlike("|".join(SENSITIVE)), F.lit(hidden if text else None)).otherwise(redact_nested(v, kind.valueType, hidden)))
    return value


#: Event types by area and operation.
DERIVED = {
    "acl": ("create", "delete", "update", "deny"),
    "topic": ("create", "delete", "update"),
    "data": ("produce", "consume", "delete"),
    "auth": ("success", "failure", "logout"),
}


def derive(operations: DataFrame) -> DataFrame:
    """`operations` (area, operation, error) with event_type, severity and result.

    Denials are warnings, failures errors (of authentication: warnings), everything else is information. Unknown operations
    are `system.error`.
    """
    known = F.lit(False)
    for area, names in DERIVED.items():
        known = known | ((F.col("area") == area) & F.col("operation").isin(*names))
    failed = F.col("error").isNotNull() & (F.col("error") != "")
    severity = F.when(F.col("operation") == "deny", "warning").when(failed & (F.col("area") == "auth"), "warning").when(failed, "error").otherwise("info")
    return operations.withColumns(
        {
            "event_type": F.when(F.coalesce(known, F.lit(False)), F.concat_ws(".", "area", "operation")).otherwise("system.error"),
            "severity": severity,
            "result": F.when(failed | (F.col("operation") == "deny"), "failure").otherwise("success"),
        }
    )


#: The columns of an exported file, in order.
CSV_COLUMNS = ("timestamp", "event_id", "event_type", "severity", "principal", "host", "resource_type", "resource_name", "operation", "result")


def rfc3339(ms: Column) -> Column:
    """Milliseconds since 1970 as a time of day in UTC, to the second, whatever the session's zone is."""
    return F.date_format(F.timestamp_add("SECOND", F.floor(ms / 1000).cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def csv_lines_compat(events: DataFrame, order: str = "seq") -> DataFrame:
    """seq, line: the header (seq -1) and the events, fields joined by commas without quoting. For files that readers can trust, write with
    `sources.sinks.write_csv`."""
    fields = [rfc3339(F.col("ts_ms")), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CSV_COLUMNS[1:])]
    header = events.sparkSession.createDataFrame([(-1, ",".join(CSV_COLUMNS))], "seq long, line string")
    return header.unionByName(events.select(F.col(order).cast("long").alias("seq"), F.concat_ws(",", *fields).alias("line")))


def rotate(events: DataFrame, max_bytes: int, order: str = "seq", stretch: int = 100_000) -> DataFrame:
    """order, ts_ms, line, bytes, file: events as JSON lines, dealt in order to files of at most `max_bytes` (a longer line has its own).

    A line's file follows from the bytes before it, which are summed by stretches of the order and chained, so files can be written side by side. Each
    leaves room for the longest line.
    """
    lines = events.select(order, "ts_ms", F.to_json(F.struct(*events.columns)).alias("line")).withColumn("bytes", F.octet_length("line") + 1)
    lines = lines.withColumn("_stretch", F.floor(F.col(order) / F.lit(stretch)))
    sums = lines.groupBy("_stretch").agg(F.sum("bytes").alias("_sum"), F.max("bytes").alias("_long"))
    earlier = W.orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)  # a row for each stretch
    begins = sums.select("_stretch", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"), F.max("_long").over(W.partitionBy(F.lit(0))).alias("_room"))
    inside = F.sum("bytes").over(W.partitionBy("_stretch").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("bytes")
    placed = lines.withColumn("_inside", inside).join(small(begins), "_stretch")
    file = F.floor((F.col("_base") + F.col("_inside")) / F.greatest(F.lit(max_bytes) - F.col("_room"), F.lit(1)))
    return placed.select(order, "ts_ms", "line", F.col("bytes").cast("long").alias("bytes"), file.cast("long").alias("file"))


def rotated_files(rotated: DataFrame, most: int, now_ms: int, max_age_ms: int) -> DataFrame:
    """file, n, bytes, newest_ms, kept: the open file stays, and of the others the newest `most` that are not too old. A limit of 0 is none."""
    files = rotated.groupBy("file").agg(F.count("*").alias("n"), F.sum("bytes").cast("long").alias("bytes"), F.max("ts_ms").alias("newest_ms"))
    place = F.row_number().over(W.orderBy(F.desc("file")))  # a row for each file
    few = (F.col("_place") <= most + 1) | F.lit(most <= 0)
    young = (F.lit(now_ms) - F.col("newest_ms") <= max_age_ms) | F.lit(max_age_ms <= 0)
    return files.withColumn("_place", place).withColumn("kept", (F.col("_place") == 1) | (few & young)).drop("_place")

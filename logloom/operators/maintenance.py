"""Log maintenance as set operations: compaction, retention, truncation, validation, segments and snapshots."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.model import LOG, SNAPSHOT_LOG, small


def compact(
    records: DataFrame, *, active: DataFrame | None = None, keep_keyless: bool = False, min_age_ms: int = 0, now_ms: int | None = None, tombstones_after_ms: int | None = None
) -> DataFrame:
    """The latest record of each key among closed segments, and the active segment as it is. Offsets stay.

    `records` has a column `segment`; the highest of a log is active and takes no part, so a log of one segment is left
    alone. `active` (topic, partition, active) saves a pass over the records where a listing of segments has it. Records without a key go unless `keep_keyless`. Records younger than `min_age_ms` stay and don't hide older
    ones. Tombstones (empty values) stay, unless `tombstones_after_ms` says how old they may get.

    The highest offset of each key is a hash aggregation over offsets alone, combined in each task before anything is shuffled. Only closed, keyed
    records then meet these offsets in a semi-join; what stays in any case is never shuffled.
    """
    if active is None:
        active = records.groupBy(*LOG).agg(F.max("segment").alias("active"))
    rows = records.join(small(active), list(LOG))
    closed = F.col("segment") < F.col("active")
    young = F.lit(False) if now_ms is None or min_age_ms <= 0 else F.lit(now_ms) - F.col("timestamp") < min_age_ms
    keyed = F.coalesce(F.octet_length("key"), F.lit(0)) > 0
    exempt = ~closed | young | (~keyed & F.lit(keep_keyless))
    if tombstones_after_ms is not None and now_ms is not None:
        old = (F.coalesce(F.octet_length("value"), F.lit(0)) == 0) & (F.lit(now_ms) - F.col("timestamp") > tombstones_after_ms)
    else:
        old = F.lit(False)
    stays, rivals = rows.where(exempt).select(*records.columns), rows.where(~exempt & keyed).select(*records.columns)
    newest = rivals.groupBy(*LOG, "key").agg(F.max("offset").alias("offset")).select(*LOG, "offset")
    return stays.unionByName(rivals.join(newest, [*LOG, "offset"], "left_semi").where(~old))


def renumber(compacted: DataFrame) -> DataFrame:
    """Closed survivors with offsets counted on from the first one of their log, as some brokers do. The active segment stays.

    Segments are numbered in parallel: a survivor's number is its number in its segment plus the survivors of the segments before.
    """
    active = W.partitionBy(*LOG)
    sizes = compacted.groupBy(*LOG, "segment").agg(F.count("*").alias("n"), F.min("offset").alias("low"))
    order = active.orderBy("segment")
    begins = sizes.select(
        *LOG,
        "segment",
        (F.col("segment") == F.max("segment").over(active)).alias("is_active"),
        (F.min("low").over(active) + F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("base"),
    )
    number = F.row_number().over(W.partitionBy(*LOG, "segment").orderBy("offset")) - 1
    rows = compacted.withColumn("_n", number).join(begins, [*LOG, "segment"])
    return rows.withColumn("offset", F.when(F.col("is_active"), F.col("offset")).otherwise(F.col("base") + F.col("_n")).cast("long")).select(*compacted.columns)


def compaction_totals(records: DataFrame, compacted: DataFrame) -> DataFrame:
    """rows_before, rows_after, keys_removed, bytes_removed."""
    before = records.agg(F.count("*").alias("rows_before"), F.sum("bytes").alias("b")).first()
    return compacted.agg(
        F.lit(before["rows_before"]).cast("long").alias("rows_before"),
        F.count("*").alias("rows_after"),
        (F.lit(before["rows_before"]) - F.count("*")).cast("long").alias("keys_removed"),
        (F.lit(before["b"] or 0) - F.coalesce(F.sum("bytes"), F.lit(0))).cast("long").alias("bytes_removed"),
    )


def dirty_ratio(records: DataFrame, threshold: float = 0.5) -> DataFrame:
    """topic, partition, segment, n, unique_keys, dirty, compactable, savings for closed segments."""
    keyed = F.when(F.octet_length("key") > 0, F.col("key"))
    each = records.groupBy(*LOG, "segment").agg(F.count("*").alias("n"), F.countDistinct(keyed).alias("unique_keys"), F.sum("bytes").alias("bytes"))
    dirty = (F.col("n") - F.col("unique_keys")) / F.col("n")
    closed = each.withColumn("active", F.max("segment").over(W.partitionBy(*LOG))).where("segment < active")
    return closed.select(*LOG, "segment", "n", "unique_keys", F.round(dirty, 9).alias("dirty"), (dirty >= threshold).alias("compactable"), F.floor(F.col("bytes") * dirty).cast("long").alias("savings"))


def needs_compaction(ratios: DataFrame) -> DataFrame:
    """topic, partition, needed: whether any closed segment is dirty enough."""
    return ratios.groupBy(*LOG).agg(F.bool_or("compactable").alias("needed"))


def segments(records: DataFrame) -> DataFrame:
    """topic, partition, segment, base_offset, next_offset, bytes, newest_ms."""
    return records.groupBy(*LOG, "segment").agg(
        F.min("offset").alias("base_offset"), (F.max("offset") + 1).alias("next_offset"), F.sum("bytes").cast("long").alias("bytes"), F.max("timestamp").alias("newest_ms")
    )


def retain_by_size(listed: DataFrame, max_bytes: int) -> DataFrame:
    """`segments` with `deleted`: from the oldest on, as long as what is left is larger than `max_bytes`; never the last one."""
    own = W.partitionBy(*LOG)
    left = F.sum("bytes").over(own.orderBy(F.desc("base_offset")).rowsBetween(W.unboundedPreceding, W.currentRow))
    last = F.col("base_offset") == F.max("base_offset").over(own)
    return listed.withColumn("deleted", (F.lit(max_bytes) > 0) & (left > max_bytes) & ~last)


def retain_by_age(listed: DataFrame, now_ms: int, max_age_ms: int) -> DataFrame:
    """`segments` with `deleted`: from the oldest on, while the newest record of the segment is older than `max_age_ms`; never the last."""
    own = W.partitionBy(*LOG)
    old = (F.lit(now_ms) - F.col("newest_ms") > max_age_ms) & (F.col("base_offset") < F.max("base_offset").over(own))
    return listed.withColumn("_old", old).withColumn("deleted", F.min("_old").over(own.orderBy("base_offset").rowsBetween(W.unboundedPreceding, W.currentRow))).drop("_old")


def truncate(records: DataFrame, to: DataFrame) -> DataFrame:
    """Records below the offset that `to` (topic, partition, end) gives; logs not named stay whole."""
    return records.join(small(to), list(LOG), "left").where("end is null or offset < end").select(*records.columns)


def delete_before(requests: DataFrame, ends: DataFrame) -> DataFrame:
    """topic, partition, before, error, low_watermark: deletion of records below an offset; the end (-1) stands for all. Out of range: error 1."""
    asked = requests.join(ends, list(LOG), "left")
    target = F.when(F.col("before") == -1, F.col("latest")).otherwise(F.col("before"))
    error = F.when(F.col("latest").isNull(), 3).when((target < 0) | (target > F.col("latest")), 1).otherwise(0)
    return asked.select(*LOG, "before", error.alias("error"), F.when(error == 0, F.greatest(target, F.col("earliest"))).otherwise(F.lit(-1)).cast("long").alias("low_watermark"))


def oldest_age(records: DataFrame, now_ms: int) -> DataFrame:
    """topic, partition, age_ms of the first record."""
    return records.groupBy(*LOG).agg((F.lit(now_ms) - F.min_by("timestamp", "offset")).cast("long").alias("age_ms"))


def validate(records: DataFrame, order: str = "position", stretch: int = 1_000_000) -> DataFrame:
    """topic, partition, total, valid, truncated, is_valid: records before the first one whose offset doesn't grow are valid.

    A log is compared in stretches of so many positions, each sorted on its own; a table with a row for each stretch then gives what happens at their
    borders and how many records lie before. No task sorts a whole log.
    """
    cut = F.floor(F.col(order) / F.lit(stretch)).alias("stretch")
    rows = records.select(*LOG, "offset", F.col(order).alias("at"), cut)
    inside = W.partitionBy(*LOG, "stretch").orderBy("at")
    rows = rows.withColumns({"bad": F.col("offset") <= F.lag("offset").over(inside), "n": F.row_number().over(inside) - 1})
    by = rows.groupBy(*LOG, "stretch").agg(
        F.min(F.when(F.col("bad"), F.struct("at", F.col("n").cast("long").alias("n")))).alias("fall"),
        F.min(F.struct("at", "offset")).alias("first"),
        F.max(F.struct("at", "offset")).alias("last"),
        F.count("*").alias("size"),
    )
    along = W.partitionBy(*LOG).orderBy("stretch")
    border = F.when(F.col("first.offset") <= F.lag("last.offset").over(along), F.struct(F.col("first.at").alias("at"), F.lit(0).cast("long").alias("n")))
    before = F.coalesce(F.sum("size").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    falls = by.withColumns({"fall": F.coalesce(border, "fall"), "before": before})
    logs = falls.groupBy(*LOG).agg(F.sum("size").alias("total"), F.min(F.when(F.col("fall").isNotNull(), F.struct("fall.at", (F.col("before") + F.col("fall.n")).alias("valid")))).alias("f"))
    valid = F.coalesce("f.valid", "total")
    return logs.select(*LOG, "total", valid.alias("valid"), (F.col("total") - valid).alias("truncated"), F.col("f").isNull().alias("is_valid"))


def recovery_summary(validated: DataFrame) -> DataFrame:
    """topic, recovered, truncated, corrupted, errors: sums over the partitions of a topic and the list of what failed, in order."""
    message = F.when(~F.col("is_valid"), F.concat(F.lit("partition "), F.col("partition"), F.lit(": "), F.col("truncated"), F.lit(" records")))
    return validated.groupBy("topic").agg(
        F.sum("valid").cast("long").alias("recovered"),
        F.sum("truncated").cast("long").alias("truncated"),
        F.bool_or(~F.col("is_valid")).alias("corrupted"),
        F.array_join(F.array_sort(F.collect_list(message)), "; ").alias("errors"),
    )


def verify_counts(log: DataFrame, index: DataFrame) -> DataFrame:
    """topic, partition, records, entries, consistent: records against index entries, logs on either side only included."""
    a, b = log.groupBy(*LOG).agg(F.count("*").alias("records")), index.groupBy(*LOG).agg(F.count("*").alias("entries"))
    both = a.join(b, list(LOG), "full").select(*LOG, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("records", "entries")))
    return both.withColumn("consistent", F.col("records") == F.col("entries"))


def rebuild_index(records: DataFrame) -> DataFrame:
    """topic, partition, segment, offset, position, timestamp: the index entries of all records, from the records alone. Positions are bytes from
    the start of a segment, whose size bounds what a task sorts."""
    before = W.partitionBy(*LOG, "segment").orderBy("offset").rowsBetween(W.unboundedPreceding, -1)
    position = F.coalesce(F.sum("bytes").over(before), F.lit(0)).cast("long")
    return records.select(*LOG, "segment", "offset", position.alias("position"), "timestamp")


def assign_segments(records: DataFrame, max_bytes: int) -> DataFrame:
    """`records` with `segment` from 0: a new one begins before a record if what the open one holds has reached `max_bytes`.

    The running sum starts again at every roll, so this is a fold in offset order and each log is one sequence. Rows are
    dealt by log and sorted (with spilling), and a task streams them batch by batch: it holds one number for a log, never the log.
    """
    size = "bytes"

    def fold(batches):
        log, held, segment = None, 0, 0
        for pdf in batches:
            out = []
            for key, n in zip(zip(pdf["topic"], pdf["partition"], strict=True), pdf[size], strict=True):
                if key != log:
                    log, held, segment = key, 0, 0
                elif held >= max_bytes:
                    segment, held = segment + 1, 0
                held += n
                out.append(segment)
            yield pdf.assign(segment=pd.Series(out, dtype="int64"))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields)
    return records.repartition(*LOG).sortWithinPartitions(*LOG, "offset").mapInPandas(fold, f"{fields}, segment long")


def snapshots_to_keep(snapshots: DataFrame, most: int, now_ms: int, max_age_ms: int) -> DataFrame:
    """`snapshots` with `kept`: the newest `most` that are not too old."""
    place = F.row_number().over(W.partitionBy("log").orderBy(F.desc("created_ms"), "id"))
    return snapshots.withColumn("kept", (place <= most) & (F.lit(now_ms) - F.col("created_ms") <= max_age_ms))


class Snapshots:
    """Snapshots of logs in a folder that all machines see: the records of each, and beside them its metadata (a row for each log). A snapshot
    whose metadata isn't whole is none."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def ids(self) -> list[str]:
        fs, root = self._at("metadata")
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n.removeprefix("snapshot=") for n in names if n.startswith("snapshot=") and self._at(f"metadata/{n}/_SUCCESS")[0].exists(self._at(f"metadata/{n}/_SUCCESS")[1]))

    def create(self, records: DataFrame, snapshot_id: str, now_ms: int) -> DataFrame:
        """Stores the records (with their segment) and returns the metadata: topic, partition, id, created_ms, base_offset, high_water_mark,
        num_segments, total_size, segment_offsets. An id that is there already is an error."""
        if snapshot_id in self.ids():
            raise ValueError(f"snapshot exists: {snapshot_id}")
        where = f"{self.path}/records/snapshot={snapshot_id}"
        records.write.mode("overwrite").parquet(where)
        stored = self.spark.read.schema(records.schema).parquet(where)
        segments = stored.groupBy(*LOG, "segment").agg(F.min("offset").alias("base"), F.max("offset").alias("last"), F.sum("bytes").alias("size"))
        found = segments.groupBy(*LOG).agg(
            F.lit(snapshot_id).alias("id"),
            F.lit(now_ms).cast("long").alias("created_ms"),
            F.min("base").alias("base_offset"),
            (F.max("last") + 1).alias("high_water_mark"),
            F.count("*").alias("num_segments"),
            F.sum("size").cast("long").alias("total_size"),
            F.array_sort(F.collect_list("base")).alias("segment_offsets"),
        )
        found.write.mode("overwrite").parquet(f"{self.path}/metadata/snapshot={snapshot_id}")
        return self.get(snapshot_id)

    def _metadata(self, ids: list[str]) -> DataFrame:
        return self.spark.read.schema(SNAPSHOT_LOG).parquet(*(f"{self.path}/metadata/snapshot={i}" for i in ids)) if ids else self.spark.createDataFrame([], SNAPSHOT_LOG)

    def get(self, snapshot_id: str) -> DataFrame:
        """The metadata of a snapshot; no rows if there is none."""
        return self._metadata([snapshot_id] if snapshot_id in self.ids() else [])

    def listed(self) -> DataFrame:
        """place, id, created_ms, logs, total_size of all snapshots, the newest first."""
        by = self._metadata(self.ids()).groupBy("id").agg(F.max("created_ms").alias("created_ms"), F.count("*").alias("logs"), F.sum("total_size").alias("total_size"))
        place = F.row_number().over(W.orderBy(F.desc("created_ms"), "id"))  # a row for each snapshot
        return by.select(place.alias("place"), "id", "created_ms", "logs", "total_size")

    def size(self) -> DataFrame:
        """total_size of all snapshots."""
        return self._metadata(self.ids()).agg(F.coalesce(F.sum("total_size"), F.lit(0)).cast("long").alias("total_size"))

    def restore(self, snapshot_id: str) -> DataFrame:
        """The records of a snapshot. An unknown one is an error."""
        if snapshot_id not in self.ids():
            raise ValueError(f"snapshot not found: {snapshot_id}")
        return self.spark.read.parquet(f"{self.path}/records/snapshot={snapshot_id}")

    def delete(self, snapshot_id: str) -> bool:
        """Removes a snapshot, its metadata first; False if there is none."""
        if snapshot_id not in self.ids():
            return False
        for part in ("metadata", "records"):
            fs, at = self._at(f"{part}/snapshot={snapshot_id}")
            fs.delete(at, True)
        return True

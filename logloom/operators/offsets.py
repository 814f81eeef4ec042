"""Offset algebra: ends of logs, commits, lag, look-ups by time, resets and positions.

A log is named by (topic, partition). Tables of logs (`marks`, commits) are small beside records: records are only ever
reduced by partial aggregation or joined with such a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.model import LOG, small

EARLIEST, LATEST = -2, -1


def high_water_marks(records: DataFrame) -> DataFrame:
    """topic, partition, hwm: the next offset of each log."""
    return records.groupBy(*LOG).agg((F.max("offset") + 1).cast("long").alias("hwm"))


def log_ends(records: DataFrame) -> DataFrame:
    """topic, partition, earliest, latest: the first offset that is there, and the next one."""
    return records.groupBy(*LOG).agg(F.min("offset").alias("earliest"), (F.max("offset") + 1).cast("long").alias("latest"))


def earliest_compat(ends: DataFrame) -> DataFrame:
    """`log_ends` as brokers that always answer 0 for the earliest offset."""
    return ends.withColumn("earliest", F.lit(0).cast("long"))


def consumer_lag(commits: DataFrame, marks: DataFrame) -> DataFrame:
    """group_id, topic, partition, offset, hwm, lag: never negative; commits for unknown logs are left out."""
    return commits.join(marks, list(LOG)).select("group_id", *LOG, "offset", "hwm", F.greatest(F.col("hwm") - F.col("offset"), F.lit(0)).cast("long").alias("lag"))


def lag_rollup(lag: DataFrame) -> DataFrame:
    """Lag summed by log, topic and group, and overall (nulls mark what is summed over)."""
    return lag.rollup("group_id", *LOG).agg(F.sum("lag").cast("long").alias("lag"))


def lag_summary(lag: DataFrame) -> DataFrame:
    """topic, total, max_lag, avg_lag, n, share (of the topic with most lag, in percent), level."""
    by = lag.groupBy("topic").agg(F.sum("lag").cast("long").alias("total"), F.max("lag").alias("max_lag"), F.round(F.avg("lag"), 6).alias("avg_lag"), F.count("*").alias("n"))
    most = by.agg(F.max("total")).first()[0] or 0
    share = F.round(F.col("total") * 100.0 / F.lit(most), 6) if most else F.lit(0.0)
    level = F.when(F.col("total") > 1000, "high").when(F.col("total") > 100, "medium").otherwise("low")
    return by.withColumns({"share": share, "level": level})


def nested_lag(lag: DataFrame) -> DataFrame:
    """group_id, total, topics: an array of (topic, total, partitions), each an array of (partition, lag)."""
    topics = lag.groupBy("group_id", "topic").agg(F.sum("lag").cast("long").alias("total"), F.array_sort(F.collect_list(F.struct("partition", "lag"))).alias("partitions"))
    return topics.groupBy("group_id").agg(F.sum("total").cast("long").alias("total"), F.array_sort(F.collect_list(F.struct("topic", "total", "partitions"))).alias("topics"))


def committed_or_minus_one(requested: DataFrame, commits: DataFrame) -> DataFrame:
    """The committed offset of each requested (group_id, topic, partition), -1 where there is none."""
    keys = ["group_id", *LOG]
    return requested.select(*keys).join(commits.select(*keys, "offset"), keys, "left").select(*keys, F.coalesce("offset", F.lit(-1)).cast("long").alias("offset"))


def latest_commits(log: DataFrame, order: str = "seq") -> DataFrame:
    """The commit that stands for each group and log: the last one wins, whatever its offset."""
    return log.groupBy("group_id", *LOG).agg(F.max_by("offset", order).alias("offset"))


def reset_offsets(commits: DataFrame, groups: DataFrame, marks: DataFrame, to: str) -> DataFrame:
    """Commits after a reset of the groups in state Empty or Dead to `earliest` (0) or `latest` (the next offset).

    Groups in another state keep theirs; status says which.
    """
    target = F.lit(0).cast("long") if to == "earliest" else F.coalesce("hwm", "offset")
    free = F.coalesce(F.col("state").isin("Empty", "Dead"), F.lit(False))
    joined = commits.join(groups.select("group_id", "state"), "group_id", "left").join(marks, list(LOG), "left")
    return joined.select("group_id", *LOG, F.when(free, target).otherwise(F.col("offset")).alias("offset"), F.when(free, "reset").otherwise("refused").alias("status"))


def delete_group_offsets(commits: DataFrame, groups: DataFrame) -> DataFrame:
    """Commits left after deleting those of groups in state Empty or Dead."""
    return commits.join(groups.where(F.col("state").isin("Empty", "Dead")).select("group_id"), "group_id", "left_anti")


def asof_forward(left: DataFrame, records: DataFrame, stretch: int = 100_000) -> DataFrame:
    """`left` (topic, partition, wanted_ms) with the smallest offset of a record not older than each wanted time; null if there is none.

    A record's timestamp may be below an earlier one's. One aggregation gives the newest time of each stretch of offsets. The first stretch that
    reaches a wanted time holds its answer: sorted by time, stretches and wanted times need one window over these small tables.
    Only records of such stretches are read for the answer itself.
    """
    number = F.floor(F.col("offset") / F.lit(stretch)).alias("slot")
    slots = records.groupBy(*LOG, number).agg(F.max("timestamp").alias("time"))
    wanted = left.select(*LOG, "wanted_ms").distinct()
    both = slots.select(*LOG, "time", "slot", F.lit(None).cast("long").alias("wanted_ms")).unionByName(wanted.select(*LOG, F.col("wanted_ms").alias("time"), F.lit(None).cast("long").alias("slot"), "wanted_ms"))
    reached = F.min("slot").over(W.partitionBy(*LOG).orderBy(F.desc("time")).rangeBetween(W.unboundedPreceding, W.currentRow))
    first = both.withColumn("slot", reached).where("wanted_ms is not null and slot is not null").select(*LOG, "slot", "wanted_ms")
    inside = records.select(*LOG, "timestamp", "offset", number).join(small(first), [*LOG, "slot"]).where("timestamp >= wanted_ms")
    found = inside.groupBy(*LOG, "wanted_ms").agg(F.min("offset").alias("offset"))
    return left.join(found, [*LOG, "wanted_ms"], "left").select(*LOG, "wanted_ms", "offset")


def offset_for_timestamp(records: DataFrame, wanted: DataFrame, marks: DataFrame) -> DataFrame:
    """topic, partition, wanted_ms, offset: the smallest offset of a record not older than `wanted_ms`, else the next offset."""
    found = asof_forward(wanted, records).join(marks, list(LOG))
    return found.select(*LOG, "wanted_ms", F.coalesce("offset", "hwm").cast("long").alias("offset"))


def initial_positions(consumers: DataFrame, marks: DataFrame) -> DataFrame:
    """consumer_id, topic, partition, position: every consumer gets all logs; reset `earliest` starts at 0, others at the end."""
    pairs = consumers.withColumn("topic", F.explode("topics")).join(marks, "topic")
    return pairs.select("consumer_id", *LOG, F.when(F.col("reset") == "earliest", F.lit(0)).otherwise(F.col("hwm")).cast("long").alias("position"))


def seek(positions: DataFrame, seeks: DataFrame) -> DataFrame:
    """Positions after seeks (the last of each log by `seq`), which count only for logs that a consumer has."""
    last = seeks.groupBy("consumer_id", *LOG).agg(F.max_by("offset", "seq").alias("to"))
    return positions.join(last, ["consumer_id", *LOG], "left").select("consumer_id", *LOG, F.coalesce("to", "position").cast("long").alias("position"))


def reassign(positions: DataFrame, assigned: DataFrame) -> DataFrame:
    """Positions after a new assignment: known ones stay, new logs start at 0, others go."""
    return assigned.join(positions, ["consumer_id", *LOG], "left").select("consumer_id", *LOG, F.coalesce("position", F.lit(0)).cast("long").alias("position"))


def resolved(offset: Column, earliest: Column, latest: Column) -> Column:
    """An offset with the sentinels -2 (earliest) and -1 (latest) replaced."""
    return F.when(offset == EARLIEST, earliest).when(offset == LATEST, latest).otherwise(offset)

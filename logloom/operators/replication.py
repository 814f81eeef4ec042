"""Replicas: assignment, lag, in-sync sets, replicated marks and changes of leadership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.model import LOG


def assign_replicas(partition: Column, brokers: Sequence[int], factor: int) -> Column:
    """Round robin: partition p gets `factor` brokers from position p on. The first is the leader."""
    if not 0 < factor <= len(brokers):
        raise ValueError(f"replication factor {factor} does not fit {len(brokers)} brokers")
    ring = F.array(*(F.lit(int(b)) for b in brokers))
    return F.transform(F.sequence(F.lit(0), F.lit(factor - 1)), lambda i: F.element_at(ring, ((partition + i) % len(brokers) + 1).cast("int")))


def invalid_assignments(replicas: DataFrame) -> DataFrame:
    """Logs whose replica list names a broker twice."""
    return replicas.where(F.size(F.array_distinct("replicas")) != F.size("replicas"))


def replica_states(replicas: DataFrame, follower_state: DataFrame, marks: DataFrame) -> DataFrame:
    """One row for each replica: topic, partition, position, broker, is_leader, leader_leo, leo (null if unknown), last_fetch_ms."""
    each = replicas.select(*LOG, F.posexplode("replicas").alias("position", "broker"))
    states = each.join(marks.withColumnRenamed("hwm", "leader_leo"), list(LOG)).join(follower_state, [*LOG, "broker"], "left")
    return states.withColumn("is_leader", F.col("position") == 0)


def replica_lag(states: DataFrame, now_ms: int) -> DataFrame:
    """topic, partition, broker, lag, lag_ms of followers. Without a known end the lag is the leader's whole log."""
    lag = F.greatest(F.col("leader_leo") - F.coalesce("leo", F.lit(0)), F.lit(0)).cast("long").alias("lag")
    return states.where(~F.col("is_leader")).select(*LOG, "broker", lag, (F.lit(now_ms) - F.col("last_fetch_ms")).cast("long").alias("lag_ms"))


def _members(states: DataFrame, follower_ok: Column) -> DataFrame:
    inside = states.where(F.col("is_leader") | F.coalesce(follower_ok, F.lit(False)))
    return inside.groupBy(*LOG).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "broker"))), lambda s: s.broker).alias("isr"))


def isr_by_distance(states: DataFrame, now_ms: int, max_behind: int = 1, max_silent_ms: int = 10_000) -> DataFrame:
    """topic, partition, isr in replica order: the leader, and followers at most `max_behind` records behind that fetched lately."""
    return _members(states, (F.col("leader_leo") - F.col("leo") <= max_behind) & (F.lit(now_ms) - F.col("last_fetch_ms") <= max_silent_ms))


def isr_by_mark(states: DataFrame, replicated: DataFrame, now_ms: int, max_lag_ms: int = 10_000) -> DataFrame:
    """topic, partition, isr: the leader, and followers that have reached the replicated mark and fetched lately."""
    return _members(states.join(replicated, list(LOG)), (F.col("leo") >= F.col("replicated_hwm")) & (F.lit(now_ms) - F.col("last_fetch_ms") < max_lag_ms))


def replicated_mark(states: DataFrame, isr: DataFrame) -> DataFrame:
    """topic, partition, replicated_hwm: the least end among the in-sync replicas, the leader's included."""
    inside = states.join(isr, list(LOG)).where(F.array_contains("isr", F.col("broker")))
    leo = F.when(F.col("is_leader"), F.col("leader_leo")).otherwise(F.coalesce("leo", F.lit(0)))
    return inside.groupBy(*LOG).agg(F.min(leo).cast("long").alias("replicated_hwm"))


def under_replicated(replicas: DataFrame, isr: DataFrame) -> DataFrame:
    """topic, partition, replicas, in_sync of logs with fewer in-sync replicas than replicas."""
    return replicas.join(isr, list(LOG)).where(F.size("isr") < F.size("replicas")).select(*LOG, F.size("replicas").alias("replicas"), F.size("isr").alias("in_sync"))


def isr_changes(observations: DataFrame) -> DataFrame:
    """topic, partition, seq, change: `shrink` or `expand` against the observation before; the first one is none."""
    before = F.lag("size").over(W.partitionBy(*LOG).orderBy("seq"))
    change = F.when(F.col("size") < F.col("before"), "shrink").when(F.col("size") > F.col("before"), "expand")
    return observations.withColumn("before", before).withColumn("change", change).where("change is not null").select(*LOG, "seq", "change")


def leader_changes(observations: DataFrame) -> DataFrame:
    """node, changes: transitions into or out of the state Leader."""
    before = F.lag("state").over(W.partitionBy("node").orderBy("seq"))
    moved = F.col("before").isNotNull() & ((F.col("state") == "Leader") != (F.col("before") == "Leader"))
    return observations.withColumn("before", before).groupBy("node").agg(F.count_if(moved).alias("changes"))


def led_and_followed(replicas: DataFrame, broker: int) -> DataFrame:
    """topic, partition, role of a broker's logs: `leader` or `follower`."""
    mine = replicas.where(F.array_contains("replicas", F.lit(broker)))
    return mine.select(*LOG, F.when(F.col("replicas")[0] == broker, "leader").otherwise("follower").alias("role"))


def latest_follower_state(updates: DataFrame) -> DataFrame:
    """The last update of each follower by `seq`."""
    return updates.groupBy(*LOG, "broker").agg(F.max_by("leo", "seq").alias("leo"), F.max_by("last_fetch_ms", "seq").alias("last_fetch_ms"))


def acknowledged(produced: DataFrame, replicated: DataFrame) -> DataFrame:
    """`produced` (topic, partition, offset, acks) with `acked`: at once unless acks is -1, which waits for the mark to pass
    the offset. (The mark is the next offset, so an offset equal to it is not replicated yet.)"""
    joined = produced.join(replicated, list(LOG), "left")
    return joined.select(*LOG, "offset", "acks", ((F.col("acks") != -1) | F.coalesce(F.col("offset") < F.col("replicated_hwm"), F.lit(False))).alias("acked"))

"""Consumer groups, producers and transactions: votes, descriptions, timeouts and state machines folded in order."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FIRST_PRODUCER_ID = 1001
ERRORS = {"ok": 0, "producer_epoch": 47, "state": 48, "producer_id": 49, "group_unknown": 69, "topic_unknown": 3}


def protocol_vote(members: DataFrame) -> DataFrame:
    """group_id, protocol: the protocol that all members support and most of them list first; ties go by name. No row without one.

    `protocols` is an array of names in order of preference.
    """
    sizes = members.groupBy("group_id").agg(F.countDistinct("member_id").alias("members"))
    each = members.select("group_id", "member_id", F.posexplode("protocols").alias("pos", "protocol"))
    by = each.groupBy("group_id", "protocol").agg(F.countDistinct("member_id").alias("n"), F.count_if(F.col("pos") == 0).alias("first"))
    common = by.join(sizes, "group_id").where("n = members")
    return common.groupBy("group_id").agg(F.min(F.struct((-F.col("first")).alias("v"), "protocol"))["protocol"].alias("protocol"))


def describe(requested: DataFrame, groups: DataFrame, members: DataFrame, commits: DataFrame) -> DataFrame:
    """group_id, state, error, members, commits: unknown groups are Dead with error 69."""
    m = members.groupBy("group_id").agg(F.count("*").alias("members"))
    c = commits.groupBy("group_id").agg(F.count("*").alias("commits"))
    joined = requested.join(groups, "group_id", "left").join(m, "group_id", "left").join(c, "group_id", "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    error = F.when(F.col("state").isNull(), ERRORS["group_unknown"]).otherwise(0).alias("error")
    return joined.select("group_id", F.coalesce("state", F.lit("Dead")).alias("state"), error, zero("members"), zero("commits"))


def expire_members(groups: DataFrame, members: DataFrame, now_ms: int) -> DataFrame:
    """group_id, state, generation, alive: a group that loses a member to its session timeout prepares a rebalance in the next generation, and is
    Empty if nobody is left."""
    dead = F.lit(now_ms) - F.col("last_heartbeat_ms") > F.col("session_timeout_ms")
    by = members.groupBy("group_id").agg(F.count_if(dead).alias("dead"), F.count_if(~dead).alias("alive"))
    joined = groups.join(by, "group_id", "left")
    lost = F.coalesce("dead", F.lit(0)) > 0
    alive = F.coalesce("alive", F.lit(0)).cast("long")
    state = F.when(lost & (alive == 0), "Empty").when(lost, "PreparingRebalance").otherwise(F.col("state"))
    return joined.select("group_id", state.alias("state"), (F.col("generation") + lost.cast("int")).alias("generation"), alive.alias("alive"))


def group_states(actions: DataFrame) -> DataFrame:
    """group_id, state, generation, members after actions (join, sync, leave, heartbeat, kill) in order of `seq`.

    A join prepares a rebalance in a new generation; a sync of a rebalancing group with members makes it stable; the last member
    that leaves empties it; a kill is for good.
    """
    held = actions.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "member_id"))).alias("log"))
    start = F.struct(F.lit("Empty").alias("state"), F.lit(0).alias("generation"), F.array().cast("array<string>").alias("members"))

    def step(s: Column, a: Column) -> Column:
        joined = F.array_union(s.members, F.array(a.member_id))
        left = F.array_remove(s.members, a.member_id)
        was = F.array_contains(s.members, a.member_id)
        make = lambda state, generation, members: F.struct(state.alias("state"), generation.alias("generation"), members.alias("members"))
        return (
            F.when(s.state == "Dead", s)
            .when(a.action == "kill", make(F.lit("Dead"), s.generation, F.array().cast("array<string>")))
            .when(a.action == "join", make(F.lit("PreparingRebalance"), s.generation + 1, joined))
            .when((a.action == "sync") & (s.state == "PreparingRebalance") & was, make(F.lit("Stable"), s.generation, s.members))
            .when((a.action == "leave") & was & (F.size(left) == 0), make(F.lit("Empty"), s.generation + 1, left))
            .when((a.action == "leave") & was, make(F.lit("PreparingRebalance"), s.generation + 1, left))
            .otherwise(s)
        )

    folded = held.select("group_id", F.aggregate("log", start, step).alias("s"))
    return folded.select("group_id", "s.state", "s.generation", F.size("s.members").cast("long").alias("members"))


def producer_epochs(requests: DataFrame) -> DataFrame:
    """transactional_id, producer_id, epoch: ids are given from 1001 on in the order of first requests, every further request raises the epoch.

    Ids need one order over all producers: producers are numbered within ranges of first requests, and the ranges' sizes give
    where each begins.
    """
    by = requests.groupBy("transactional_id").agg(F.min("seq").alias("first"), (F.count("*") - 1).alias("epoch"))
    ranged = by.repartitionByRange("first").withColumn("_part", F.spark_partition_id())
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"), F.min("first").alias("low"))
    starts = sizes.select("_part", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("low").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    number = F.row_number().over(W.partitionBy("_part").orderBy("first")) - 1
    rows = ranged.withColumn("_n", number).join(F.broadcast(starts), "_part")  # a row for each shuffle partition
    return rows.select("transactional_id", (F.lit(FIRST_PRODUCER_ID) + F.col("base") + F.col("_n")).cast("long").alias("producer_id"), F.col("epoch").cast("long").alias("epoch"))


def transactions(operations: DataFrame) -> DataFrame:
    """transactional_id, seq, error, state, partitions: what each operation (init, add, end, commit_offsets) answers and leaves, in order.

    An operation with another producer id than the last init's fails with 49, with another epoch with 47, one that the state doesn't allow
    with 48, checked in this order. Each transaction is a short sequence of its own; tasks stream sorted rows.
    """

    def fold(batches):
        key, state, producer, epoch, parts = None, "Empty", -1, -1, 0
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.transactional_id != key:
                    key, state, producer, epoch, parts = r.transactional_id, "Empty", -1, -1, 0
                error = 0
                if r.op == "init":
                    state, producer, epoch, parts = "Empty", r.producer_id, r.epoch, 0
                elif r.producer_id != producer:
                    error = ERRORS["producer_id"]
                elif r.epoch != epoch:
                    error = ERRORS["producer_epoch"]
                elif r.op == "end":
                    if state == "Ongoing":
                        state, parts = "Complete", 0
                    else:
                        error = ERRORS["state"]
                elif r.op == "commit_offsets":
                    error = 0 if state == "Ongoing" else ERRORS["state"]
                else:
                    state, parts = "Ongoing", parts + 1
                out.append((r.transactional_id, r.seq, error, state, parts))
            yield pd.DataFrame(out, columns=["transactional_id", "seq", "error", "state", "partitions"])

    sorted_rows = operations.select("transactional_id", "seq", "op", "producer_id", "epoch").repartition("transactional_id").sortWithinPartitions("transactional_id", "seq")
    return sorted_rows.mapInPandas(fold, "transactional_id long, seq long, error int, state string, partitions long")


def health(components: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """status: unhealthy if any component is, else degraded if any is, else healthy."""
    rank = F.when(F.col("status") == "unhealthy", 2).when(F.col("status") == "degraded", 1).otherwise(0)
    worst = components.groupBy(*by).agg(F.max(rank).alias("r"), F.count("*").alias("components"))
    return worst.select(*by, "components", F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unhealthy")), F.col("r") + 1).alias("status"))


def all_members(stable: DataFrame, pending: DataFrame) -> DataFrame:
    """Members of either kind; the two are disjoint."""
    return stable.unionByName(pending)


def batch_check(requested: DataFrame, catalog: DataFrame, creating: bool) -> DataFrame:
    """name, error: a batch of topics to create (or delete) is refused if a name repeats or exists (or doesn't)."""
    counted = requested.groupBy("name").agg(F.count("*").alias("n"))
    known = catalog.select("name").distinct().withColumn("_known", F.lit(True))
    joined = counted.join(known, "name", "left")
    exists = F.coalesce("_known", F.lit(False))
    return joined.select("name", F.when(F.col("n") > 1, "duplicate").when(exists & F.lit(creating), "exists").when(~exists & ~F.lit(creating), "missing").alias("error"))


def flush_batches(records: DataFrame, max_records: int, max_bytes: int) -> DataFrame:
    """topic, partition, offset, batch: records gathered for each log until a batch has so many records or bytes. Tasks stream sorted rows."""

    def fold(batches):
        log, n, held, batch = None, 0, 0, 0
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if (r.topic, r.partition) != log:
                    log, n, held, batch = (r.topic, r.partition), 0, 0, 0
                elif n >= max_records or held >= max_bytes:
                    n, held, batch = 0, 0, batch + 1
                n, held = n + 1, held + r.bytes
                out.append((r.topic, r.partition, r.offset, batch))
            yield pd.DataFrame(out, columns=["topic", "partition", "offset", "batch"])

    rows = records.select("topic", "partition", "offset", "bytes").repartition("topic", "partition").sortWithinPartitions("topic", "partition", "offset")
    return rows.mapInPandas(fold, "topic string, partition int, offset long, batch long")


def throttle(rate: Column, low: float = 1.0 * (1 << 20), high: float = 100.0 * (1 << 20)) -> Column:
    """A rate within its limits; null is unlimited."""
    return F.when(rate.isNotNull(), F.least(F.greatest(rate, F.lit(low)), F.lit(high)))


def adapt_rate(usage: DataFrame, start: float, target: float = 0.8, low: float = 1.0 * (1 << 20), high: float = 100.0 * (1 << 20)) -> DataFrame:
    """series, rate after utilisations in order: a tenth more above the target, a tenth less below half of it, within limits."""
    held = usage.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("seq", "utilisation"))).alias("u"))
    clamp = lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    step = lambda a, x: F.when(x.utilisation > target, clamp(a * 1.1)).when(x.utilisation < target / 2, clamp(a * 0.9)).otherwise(a)
    return held.select("series", F.aggregate("u", F.lit(float(start)), step).alias("rate"))

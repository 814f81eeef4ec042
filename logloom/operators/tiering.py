"""Storage tiers: how often segments are read, where they belong, what moves, and what storage costs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
GB = float(1 << 30)


@dataclass(frozen=True)
class Policy:
    """Ages in hours from which data may be warm or cold, and how often and how much hot data is read."""

    warm_hours: float = 24.0
    cold_hours: float = 168.0
    hot_per_hour: float = 10.0
    hot_reads: int = 100


def access_patterns(reads: DataFrame, now_ms: int) -> DataFrame:
    """path, access_count, first_ms, last_ms, read_bytes, per_hour (since the first access; null if that is now)."""
    by = reads.groupBy("path").agg(F.count("*").alias("access_count"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.sum("bytes").cast("long").alias("read_bytes"))
    hours = (F.lit(now_ms) - F.col("first_ms")) / float(HOUR_MS)
    return by.withColumn("per_hour", F.col("access_count") / F.nullif(hours, F.lit(0.0)))


def decide(segments: DataFrame, patterns: DataFrame, now_ms: int, p: Policy | None = None) -> DataFrame:
    """`segments` (path, last_modified_ms, policy, ...) with `desired`. Never read: by age alone. Else hot if read often and much, and
    then by age, where only data of the cold age is cold."""
    p = p or Policy()
    joined = segments.join(patterns.select("path", "access_count", "per_hour"), "path", "left")
    age = (F.lit(now_ms) - F.col("last_modified_ms")) / float(HOUR_MS)
    young, cold = age < p.warm_hours, age >= p.cold_hours
    often = (F.col("per_hour") >= p.hot_per_hour) & (F.col("access_count") >= p.hot_reads)
    by_age = F.when(young, "hot").when(cold, "cold").otherwise("warm")
    return joined.withColumn("desired", F.when(F.col("access_count").isNotNull() & F.coalesce(often, F.lit(False)), "hot").otherwise(by_age)).drop("access_count", "per_hour")


def sweep(decided: DataFrame) -> DataFrame:
    """Decided segments with `action`: moves happen only across the border to cold."""
    to, now = F.col("desired"), F.col("policy")
    return decided.withColumn("action", F.when((to == "cold") & (now != "cold"), "demote").when((to != "cold") & (now == "cold"), "promote").otherwise("none"))


def to_archive(segments: DataFrame, now_ms: int, p: Policy | None = None) -> DataFrame:
    """Segments not archived yet that are older than the cold age."""
    p = p or Policy()
    return segments.where(~F.col("is_archived") & (F.lit(now_ms) - F.col("last_modified_ms") > int(p.cold_hours * HOUR_MS)))


def archive(segments: DataFrame, paths: DataFrame, prefix: str = "archive/") -> DataFrame:
    """Segments after archiving some: cold, archived, with an object key. Archived ones stay as they are."""
    hit = paths.select("path").distinct().withColumn("_hit", F.lit(True))
    joined = segments.join(hit, "path", "left")
    now = F.coalesce("_hit", F.lit(False)) & ~F.col("is_archived")
    return joined.withColumns(
        {"policy": F.when(now, "cold").otherwise(F.col("policy")), "object_key": F.when(now, F.concat(F.lit(prefix), F.col("path"))).otherwise(F.col("object_key")), "is_archived": F.col("is_archived") | now}
    ).drop("_hit")


def restore(segments: DataFrame, paths: DataFrame) -> DataFrame:
    """Segments after restoring some: hot and no longer archived."""
    hit = paths.select("path").distinct().withColumn("_hit", F.lit(True))
    joined = segments.join(hit, "path", "left")
    now = F.coalesce("_hit", F.lit(False)) & F.col("is_archived")
    return joined.withColumns({"policy": F.when(now, "hot").otherwise(F.col("policy")), "is_archived": F.col("is_archived") & ~now}).drop("_hit")


def stats(segments: DataFrame) -> DataFrame:
    """hot, warm, cold, archived (counts), total_bytes, archived_bytes."""
    of = lambda name: F.count_if(F.col("policy") == name).alias(name)
    size = lambda on, name: F.coalesce(F.sum(F.when(on, F.col("size"))), F.lit(0)).cast("long").alias(name)
    return segments.agg(of("hot"), of("warm"), of("cold"), F.count_if("is_archived").alias("archived"), size(F.lit(True), "total_bytes"), size(F.col("is_archived"), "archived_bytes"))


def costs(totals: DataFrame, hot_per_gb: float = 0.023, cold_per_gb: float = 0.004) -> DataFrame:
    """hot_cost, cold_cost, savings_percent: what the data not archived and the archived data cost, and what the archived data would have
    cost more if hot, in percent of everything hot. Null without data."""
    hot, cold = (F.col("total_bytes") - F.col("archived_bytes")) / GB, F.col("archived_bytes") / GB
    saved = cold * (hot_per_gb - cold_per_gb) / F.nullif((hot + cold) * hot_per_gb, F.lit(0.0)) * 100
    return totals.select((hot * hot_per_gb).alias("hot_cost"), (cold * cold_per_gb).alias("cold_cost"), saved.alias("savings_percent"))


def costs_compat(totals: DataFrame, hot_per_gb: float = 0.023, cold_per_gb: float = 0.004) -> DataFrame:
    """hot_cost, cold_cost, savings_percent as some tools have it: all data is hot, a tenth of a GB is cold for each archived segment,
    and the cold share of the costs is called savings."""
    hot, cold = F.col("total_bytes") / GB * hot_per_gb, F.col("archived") * 0.1 * cold_per_gb
    return totals.select(hot.alias("hot_cost"), cold.alias("cold_cost"), (cold / F.nullif(hot + cold, F.lit(0.0)) * 100).alias("savings_percent"))

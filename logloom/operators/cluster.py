"""Catalog operations of a cluster: topics created and deleted, commands replayed, settings looked up, changes announced."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOPIC = "name string, replication_factor int, partitions array<struct<partition:int,replicas:array<int>,isr:array<int>,leader:int,epoch:int>>, created_ms long, updated_ms long"


def delete_topics(requests: DataFrame, topics: DataFrame) -> DataFrame:
    """name, error: 3 where there is no such topic."""
    known = topics.select("name").distinct().withColumn("_known", F.lit(True))
    return requests.select("name").distinct().join(known, "name", "left").select("name", F.when(F.col("_known"), 0).otherwise(3).alias("error"))


def replay(commands: DataFrame) -> DataFrame:
    """topic, records, last_value of the topics that exist after commands (create, delete, append) in order of `seq`.

    A topic exists if its last creation has no deletion after it. Appends count from that creation on; those to a topic that doesn't exist are
    lost, and creating a topic that exists changes nothing. Only the last deletion and the first creation after it matter, so this is two aggregates.
    """
    gone = commands.where("op = 'delete'").groupBy("topic").agg(F.max("seq").alias("gone"))
    with_gone = commands.join(gone, "topic", "left").where("gone is null or seq > gone")
    born = with_gone.where("op = 'create'").groupBy("topic").agg(F.min("seq").alias("born"))
    appends = with_gone.where("op = 'append'").join(born, "topic").where("seq > born")
    counted = appends.groupBy("topic").agg(F.count("*").alias("records"), F.max_by("value", "seq").alias("last_value"))
    return born.join(counted, "topic", "left").select("topic", F.coalesce("records", F.lit(0)).cast("long").alias("records"), "last_value")


def config_values(requests: DataFrame, defaults: Mapping[str, str]) -> DataFrame:
    """resource, position, name, value: the named settings that exist, in the order in which they were asked for; all, by name, where none is named."""
    known = F.create_map(*(F.lit(x) for kv in sorted(defaults.items()) for x in kv))
    names = F.when(F.coalesce(F.size("names"), F.lit(0)) > 0, F.col("names")).otherwise(F.map_keys(known))
    asked = requests.select("resource", F.posexplode(F.filter(names, lambda n: F.map_contains_key(known, n))).alias("position", "name"))
    return asked.select("resource", "position", "name", known[F.col("name")].alias("value"))


def nested_value(config: Column, path: str) -> Column:
    """The value at a dotted path of a JSON configuration; null if there is none."""
    return F.get_json_object(config, "$." + path)


def time_bound(text: Column) -> Column:
    """Milliseconds of an RFC 3339 time; null, which is no bound, if it isn't one."""
    return F.unix_millis(F.try_to_timestamp(text))


def changes(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, event: `created`, `deleted` or `updated` between two states of a table, for a feed (see `foreachBatch`)."""
    a = before.select(key, F.col(value).alias("_old"), F.lit(True).alias("_was"))
    b = after.select(key, F.col(value).alias("_new"), F.lit(True).alias("_is"))
    event = F.when(F.col("_was").isNull(), "created").when(F.col("_is").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "updated")
    return a.join(b, key, "full").select(key, event.alias("event")).where("event is not null")


def add_partitions(transactions: DataFrame, added: DataFrame) -> DataFrame:
    """transactional_id, topic, partitions: the partitions of a transaction with new ones, each once, old ones first and new ones in order of `seq`."""
    new = added.groupBy("transactional_id", "topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "partition"))), lambda s: s.partition).alias("_new"))
    joined = transactions.join(new, ["transactional_id", "topic"], "full")
    empty = F.array().cast("array<int>")
    return joined.select("transactional_id", "topic", F.array_union(F.coalesce("partitions", empty), F.coalesce("_new", empty)).alias("partitions"))


def pending(flushed: DataFrame) -> DataFrame:
    """logs, records that wait in the last batch of each log (see `groups.flush_batches`)."""
    last = W.partitionBy("topic", "partition")
    by = flushed.groupBy("topic", "partition", "batch").agg(F.count("*").alias("n")).withColumn("_last", F.max("batch").over(last)).where("batch = _last")
    return by.agg(F.count("*").alias("logs"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("records"))


def write_metadata(topics: DataFrame, path: str) -> None:
    """Topic metadata as JSON."""
    topics.write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """topic, partition, leader, replicas, isr from topic metadata; replicas that are missing are the leader alone."""
    each = spark.read.schema(TOPIC).option("multiLine", False).json(path).select(F.col("name").alias("topic"), F.explode("partitions").alias("p"))
    own = F.coalesce("p.replicas", F.array("p.leader"))
    return each.select("topic", "p.partition", F.coalesce("p.leader", own[0]).alias("leader"), own.alias("replicas"), F.coalesce("p.isr", own).alias("isr"))


def register(candidates: DataFrame, schemas: DataFrame, modes: DataFrame, default_mode: str = "BACKWARD") -> DataFrame:
    """subject, version, error for one candidate schema (subject, kind, schema) of each subject: it must be valid and compatible with the versions there;
    a schema that is there already keeps its version."""
    from logloom.operators.schemas import compatibility, is_valid

    valid = candidates.withColumn("_valid", is_valid(F.col("schema"), F.col("kind")))
    top = schemas.groupBy("subject").agg(F.max("version").alias("_top"))
    same = schemas.join(candidates.select("subject", "schema"), ["subject", "schema"]).groupBy("subject").agg(F.max("version").alias("_same"))
    rows = valid.join(top, "subject", "left").join(same, "subject", "left").withColumn("version", (F.coalesce("_top", F.lit(0)) + 1).cast("int"))
    judged = compatibility(schemas.select("subject", "version", "schema").unionByName(rows.where("_valid").select("subject", "version", "schema")), modes, default_mode).select("subject", "version", "ok")
    joined = rows.join(judged, ["subject", "version"], "left")
    error = F.when(~F.col("_valid"), "invalid").when(F.col("_same").isNull() & ~F.coalesce("ok", F.lit(True)), "incompatible")
    return joined.select("subject", F.when(error.isNull(), F.coalesce("_same", "version")).alias("version"), error.alias("error"))

"""Writes to logs kept as Parquet tables partitioned by topic and partition: appends that assign offsets, produce requests and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.model import LOG, dense_offsets, small

STORED = "offset long, timestamp long, key string, value string, batch_id long, topic string, partition int"


class LogTable:
    """A table of records under a path. A batch is a directory of its own, so that writing it again replaces it: appends are idempotent by batch id."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def batches(self) -> list[int]:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        whole = [n for n in names if n.startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[6:]) for n in whole)

    def read(self, before: int | None = None) -> DataFrame:
        """topic, partition, offset, timestamp, key, value, batch_id of all whole batches (before one)."""
        use = [b for b in self.batches() if before is None or b < before]
        if not use:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).option("basePath", self.path).parquet(*(f"{self.path}/batch={b}" for b in use)).drop("batch")

    def append(self, batch_id: int, rows: DataFrame, now_ms: int, order: str = "seq") -> None:
        """Appends rows (topic, partition, key, value and an order) with the next offsets of their logs. Fits `foreachBatch`.

        A small table with the last offset of each log is written beside each batch, so that the next one doesn't read the records.
        Rows are numbered by stretches of a numeric order.
        """
        ends = self._ends(batch_id)
        numeric = rows.schema[order].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
        numbered = dense_offsets(rows, LOG, F.floor(F.col(order) / F.lit(100_000)) if numeric else F.lit(0), order)
        placed = numbered.join(small(ends), list(LOG), "left").withColumn("offset", F.coalesce(F.col("last") + 1, F.lit(0)) + F.col("offset"))
        out = placed.select("offset", F.lit(now_ms).cast("long").alias("timestamp"), "key", "value", F.lit(batch_id).cast("long").alias("batch_id"), *LOG)
        out.write.mode("overwrite").partitionBy(*LOG).parquet(f"{self.path}/batch={batch_id}")
        own = self.spark.read.schema(STORED).parquet(f"{self.path}/batch={batch_id}").select(*LOG, F.col("offset").alias("last"))
        now = ends.unionByName(own).groupBy(*LOG).agg(F.max("last").alias("last"))
        now.coalesce(1).write.mode("overwrite").parquet(f"{self.path}-ends/batch={batch_id}")

    def _ends(self, batch_id: int) -> DataFrame:
        """topic, partition, last before a batch: the table beside the last whole batch, or from the records where that isn't whole."""
        before = [b for b in self.batches() if b < batch_id]
        at = f"{self.path}-ends/batch={before[-1]}" if before else ""
        done = self.spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS") if at else None
        if done is not None and done.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(done):
            return self.spark.read.schema("topic string, partition int, last long").parquet(at)
        return self.read(before=batch_id).groupBy(*LOG).agg(F.max("offset").alias("last"))


def formatted(data: Column, kind: str) -> Column:
    """A produced key or value as binary: `string` and `json` as they are (JSON must parse), `base64` decoded. What can't be read is null."""
    if kind == "string":
        return F.encode(data, "UTF-8")
    if kind == "json":
        return F.when(F.try_parse_json(data).isNotNull(), F.encode(data, "UTF-8"))
    if kind == "base64":
        return F.try_to_binary(data, F.lit("base64"))
    raise ValueError(f"unknown format {kind}")


def produce(rows: DataFrame, key_format: str = "string", value_format: str = "json") -> DataFrame:
    """Rows of a produce request with binary key and value, partition 0 where none is named, and an error for each row that can't be read. Bad rows
    don't fail the batch."""
    key, value = formatted(F.col("key"), key_format), formatted(F.col("value"), value_format)
    error = F.when(F.col("key").isNotNull() & key.isNull(), "bad key").when(F.col("value").isNotNull() & value.isNull(), "bad value")
    return rows.withColumns({"partition": F.coalesce("partition", F.lit(0)), "key": key, "value": value, "error": error})


def create_topics(requests: DataFrame, existing: DataFrame, validate_only: bool = False) -> DataFrame:
    """name, error, created: topics need a name that is new and at least one partition."""
    known = existing.select("name").distinct().withColumn("_known", F.lit(True))
    joined = requests.join(known, "name", "left")
    error = F.when(F.coalesce(F.length("name"), F.lit(0)) == 0, "invalid name").when(F.col("partitions") <= 0, "invalid partitions").when(F.col("_known"), "exists")
    return joined.select("name", error.alias("error"), (error.isNull() & F.lit(not validate_only)).alias("created"))


def hashed_partition(key: Column, partitions: int) -> Column:
    """A partition by the key's hash, an addition of this engine."""
    return F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")

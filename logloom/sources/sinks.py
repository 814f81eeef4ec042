"""Sinks and sources of files: JSON lines, CSV, group exports and framed logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.codec import frame, frames
from logloom.model import LOG


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share (spark.checkpoint.dir). Only a local session without one, as in tests, gets a local folder; on a
    cluster its lack is an error."""
    found, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return found or "/tmp/logloom-shared"


def write_jsonl(rows: DataFrame, path: str, max_records_per_file: int = 0, compression: str = "none") -> None:
    """JSON lines, a new file after so many records."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file).option("compression", compression).json(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """topic-less records from JSON lines: offset, timestamp, key, value. Lines that can't be parsed are left out; keys and values that are no
    strings are empty."""
    lines = spark.read.text(path)
    parsed = lines.select(F.try_parse_json("value").alias("j")).where("j is not null")
    text = lambda c: F.when(F.schema_of_variant(F.try_variant_get("j", f"$.{c}", "variant")) == "STRING", F.try_variant_get("j", f"$.{c}", "string")).otherwise("").alias(c)
    return parsed.select(*(F.try_variant_get("j", f"$.{c}", "long").alias(c) for c in ("offset", "timestamp")), text("key"), text("value"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_rotated(rotated: DataFrame, path: str, order: str = "seq", compression: str = "none") -> None:
    """The lines of `audit.rotate`, each file as a text file of its own (optionally gzip) in order."""
    rows = rotated.repartition("file").sortWithinPartitions("file", order)
    rows.select("file", "line").write.mode("overwrite").option("compression", compression).partitionBy("file").text(path)


#: The fields of an exported group.
GROUP_FIELDS = ("protocol_type", "state", "generation", "leader", "offsets")


def group_export(groups: DataFrame, commits: DataFrame) -> DataFrame:
    """group_id, export: JSON of a group's protocol type, state, generation, leader and its offsets by topic and partition. Nulls are left out."""
    topics = commits.groupBy("group_id", "topic").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("partition").cast("string"), "offset")))).alias("o"))
    offsets = topics.groupBy("group_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("topic", F.to_json("o").alias("o"))))).alias("offsets"))
    return groups.join(offsets, "group_id", "left").select("group_id", F.to_json(F.struct(*GROUP_FIELDS)).alias("export"))


def write_log_files(records: DataFrame, path: str) -> None:
    """Records (binary key and value, `segment`) framed, one file for each segment as a row of `path`: topic, partition, segment, data."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset")
        data = b"".join(frame(*r) for r in zip(pdf["offset"], pdf["timestamp"], pdf["key"], pdf["value"], strict=True))
        return pd.DataFrame({"topic": [pdf["topic"].iloc[0]], "partition": [pdf["partition"].iloc[0]], "segment": [pdf["segment"].iloc[0]], "data": [data]})

    packed = records.groupBy(*LOG, "segment").applyInPandas(pack, "topic string, partition int, segment long, data binary")
    packed.write.mode("overwrite").partitionBy(*LOG).parquet(path)


def decode_logs(files: DataFrame, data: str = "data") -> DataFrame:
    """The records in framed files (a binary column, as of Spark's `binaryFile` source), with the other columns. A file is read to its end or the first
    record that can't be decoded."""
    others = [f for f in files.schema.fields if f.name != data]

    def work(batches):
        for pdf in batches:
            for r in pdf.to_dict("records"):
                rows = list(frames(bytes(r[data] or b"")))
                if rows:
                    out = pd.DataFrame(rows, columns=["offset", "timestamp", "key", "value"])
                    for f in others:
                        out[f.name] = r[f.name]
                    yield out

    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in others)
    return files.mapInPandas(work, f"offset long, timestamp long, key binary, value binary{kinds}")


def read_log_folder(spark: SparkSession, path: str) -> DataFrame:
    """Records of broker folders `<topic>/partition-<n>/<base>.log`: topic, partition, base_offset and the record."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.log").load(path)
    part = lambda pattern: F.regexp_extract("path", pattern, 1)
    named = files.select(
        part(r"([^/]+)/partition-\d+/[^/]+$").alias("topic"), part(r"partition-(\d+)/[^/]+$").cast("int").alias("partition"), part(r"(\d+)\.log$").cast("long").alias("base_offset"), F.col("content").alias("data")
    )
    return decode_logs(named)

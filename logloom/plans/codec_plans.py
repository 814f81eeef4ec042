"""Queries on codecs."""

from __future__ import annotations

from pyspark.sql import functions as F

from logloom.functions import codec as K
from logloom.plans import views as V
from logloom.plans.registry import query
from logloom.plans.views import RECORDS, with_views

SAME = with_views(RECORDS) + 'SELECT topic, "partition", "offset", value, true AS same FROM records'


@query(
    with_views(RECORDS)
    + """, b AS (SELECT topic, "partition", "offset", [CAST(ascii(c) AS BIGINT) FOR c IN string_split("offset" || "timestamp" || key || value, '')] AS bytes FROM records)
    SELECT topic, "partition", "offset", xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, b:
        list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda k, z: xor(k >> 1, 3988292384 * (k & 1))))) AS crc FROM b"""
)
def crc32_records(spark, d):
    return V.records(spark, d).select("topic", "partition", "offset", K.record_crc(F.col("offset"), F.col("timestamp"), F.col("key"), F.col("value")).alias("crc"))


@query(SAME)
def gzip_roundtrip(spark, d):
    packed = V.records(spark, d).withColumn("packed", K.compress(F.col("value"), "gzip"))
    return packed.select("topic", "partition", "offset", F.decode(K.decompress(F.col("packed"), "gzip"), "UTF-8").alias("value"), (F.hex(F.substring("packed", 1, 2)) == "1F8B").alias("same"))


@query(SAME)
def zstd_roundtrip(spark, d):
    packed = V.records(spark, d).withColumn("packed", K.compress(F.col("value"), "zstd"))
    return packed.select("topic", "partition", "offset", F.decode(K.decompress(F.col("packed"), "zstd"), "UTF-8").alias("value"), (F.col("packed") != F.encode("value", "UTF-8")).alias("same"))


@query(SAME)
def aes_roundtrip(spark, d):
    """Records sealed under two keys, opened with the key that each names."""
    keys = spark.createDataFrame([("k1", "0123456789abcdef"), ("k2", "fedcba9876543210")], "key_id string, key string")
    records = V.records(spark, d).withColumn("key_id", F.when(F.col("offset") % 2 == 0, "k1").otherwise("k2"))
    sealed = records.withColumn("plain", F.col("value")).join(F.broadcast(keys), "key_id").withColumn("sealed", K.seal(F.col("value"), F.col("key_id"), F.encode(keys["key"], "UTF-8")))
    opened = sealed.select("topic", "partition", "offset", "plain", "sealed").withColumn("key_id", K.sealed_key_id(F.col("sealed"))).join(F.broadcast(keys), "key_id")
    value = F.decode(K.unseal(F.col("sealed"), F.encode("key", "UTF-8")), "UTF-8")
    return opened.withColumn("value", value).select("topic", "partition", "offset", "value", F.col("value").eqNullSafe(F.col("plain")).alias("same"))

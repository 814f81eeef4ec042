"""Codecs of records: checksums, compression, encryption and framing."""

from __future__ import annotations

import gzip
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    import zstandard
except ImportError:
    zstandard = None

# The codes of compression codecs.
CODECS = {"none": 0, "gzip": 1, "snappy": 2, "lz4": 3, "zstd": 4}


def record_crc(offset: Column, timestamp: Column, key: Column, value: Column) -> Column:
    """CRC-32 of the decimal offset, the decimal timestamp, the key and the value."""
    return F.crc32(F.concat(F.encode(offset.cast("string"), "UTF-8"), F.encode(timestamp.cast("string"), "UTF-8"), F.coalesce(key.cast("binary"), F.lit(b"")), F.coalesce(value.cast("binary"), F.lit(b""))))


def _pack(codec: str, data: bytes) -> bytes:
    if codec == "none":
        return data
    if codec == "gzip":
        return gzip.compress(data, mtime=0)
    if codec == "zstd" and zstandard:
        return zstandard.ZstdCompressor().compress(data)
    import pyarrow as pa

    name = {"lz4": "lz4_raw"}.get(codec, codec)
    return struct.pack(">I", len(data)) + pa.compress(data, codec=name, asbytes=True)


def _unpack(codec: str, data: bytes) -> bytes:
    if codec == "none":
        return data
    if codec == "gzip":
        return gzip.decompress(data)
    if codec == "zstd" and zstandard:
        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    import pyarrow as pa

    name = {"lz4": "lz4_raw"}.get(codec, codec)
    return pa.decompress(data[4:], decompressed_size=struct.unpack(">I", data[:4])[0], codec=name, asbytes=True)


def compress(data: Column, codec: str) -> Column:
    """Binary compressed by a codec; null stays null."""
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec}")

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else _pack(codec, bytes(x)))

    return run(data.cast("binary"))


def decompress(data: Column, codec: str) -> Column:
    """The reverse of `compress`."""
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec}")

    @F.pandas_udf("binary")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else _unpack(codec, bytes(x)))

    return run(data)


def seal(data: Column, key_id: Column, key: Column) -> Column:
    """An envelope: the key id's length and the key id, and the AES-GCM ciphertext with its nonce and tag."""
    named = F.encode(key_id, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(named)), 4, "0")), named, F.aes_encrypt(data.cast("binary"), key, F.lit("GCM")))


def sealed_key_id(envelope: Column) -> Column:
    size = F.conv(F.hex(F.substring(envelope, 1, 2)), 16, 10).cast("int")
    return F.decode(F.substring(envelope, F.lit(3), size), "UTF-8")


def unseal(envelope: Column, key: Column) -> Column:
    """The data of an envelope; null if the key doesn't fit."""
    size = F.conv(F.hex(F.substring(envelope, 1, 2)), 16, 10).cast("int")
    return F.try_aes_decrypt(F.substring(envelope, size + 3, F.lit(2147483647)), key, F.lit("GCM"))


def frame(offset: int, timestamp: int, key: bytes, value: bytes) -> bytes:
    """A record as log files hold it: size, offset, timestamp, key and value with their lengths, and four bytes of padding."""
    body = struct.pack(">qqI", offset, timestamp, len(key)) + key + struct.pack(">I", len(value)) + value
    return struct.pack(">I", len(body) + 4) + body + bytes(4)


def frames(data: bytes):
    """The records (offset, timestamp, key, value) of a log file, up to its end or the first that can't be decoded."""
    at = 0
    while at + 4 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        end = at + 4 + size
        if size < 28 or end > len(data):
            return
        offset, timestamp, k = struct.unpack_from(">qqI", data, at + 4)
        if at + 24 + k + 4 > end:
            return
        key = data[at + 24 : at + 24 + k]
        (v,) = struct.unpack_from(">I", data, at + 24 + k)
        if 28 + k + v != size:
            return
        yield offset, timestamp, key, data[at + 28 + k : at + 28 + k + v]
        at = end



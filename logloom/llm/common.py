"""What the operators of this subpackage share: reading tables, durable cuts of lineage, texts in Arrow batches, and vectorised text hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_LOCAL_CHECKPOINTS = "/tmp/logloom-checkpoints"
U64 = np.uint64
#: The most bytes of one Arrow batch on its way to a Python worker.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: the context's checkpoint folder, or spark.checkpoint.dir. Only a local session without
    either (tests) gets a local one; on a cluster their lack is an error."""
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    found = own.get() if own.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return found or _LOCAL_CHECKPOINTS


#: Rows of a small table in one file; see `durable`.
ROWS_A_FILE = 10_000


def durable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df`, computed once into the checkpoint folder that all machines share, so that lost executors cost no recomputation. With `rows`,
    about how many rows it has, a small table isn't strewn over as many files as there are shuffle partitions."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    if rows is not None:
        df = df.coalesce(1 + rows // ROWS_A_FILE)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results, wherever Spark keeps it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def with_id_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, whatever other columns there are."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def drawn(df: DataFrame, key: Column, most: int) -> DataFrame:
    """About twice `most` rows at least (all, if there are fewer): those of least hash, before an exact cut. Spares the one task that
    makes the cut the candidates of all others."""
    share = 2.0 * most / max(1, df.count())
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(F.lit(29), key), F.lit(1 << 40)) < F.lit(int(share * (1 << 40))))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that `df` doesn't have, one like each of those wanted."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bounds the session's Arrow batches by bytes as well as rows (spark.sql.execution.arrow.maxBytesPerBatch), if they aren't already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > size:
        spark.conf.set(key, str(size))


def in_slices(batch: pa.RecordBatch, column: str, size: int):
    """A record batch cut so that the column's values have about `size` bytes in each part (one long value is a part of its own)."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def over_column(rows: DataFrame, column: str, work, fields: str, size: int = 1 << 20, keep: bool = False) -> DataFrame:
    """`rows` with new columns in place of (or, with `keep`, after) a column of texts or bytes.

    `work` gets a list of values and returns a list or array for each new field. All other columns stay Arrow data: no null
    beside it turns a whole number into a float.
    """
    bound_batches(rows.sparkSession)
    new = T._parse_datatype_string(fields)
    held = [f for f in rows.schema.fields if keep or f.name != column]
    arrow = to_arrow_schema(T.StructType(held + new.fields))
    made = [arrow.field(len(held) + k).type for k in range(len(new.fields))]

    def run(batches):
        for batch in batches:
            for part in in_slices(batch, column, size):
                found = work(part.column(column).to_pylist())
                arrays = [part.column(f.name) for f in held] + [pa.array(x, type=t, from_pandas=False) for x, t in zip(found, made, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return rows.mapInArrow(run, T.StructType(held + new.fields))


# ---------------------------------------------------------------------------------------------------------------------
# Vectorised hashing of words over UTF-8 bytes. A chunk of texts is one byte array; sums over prefixes of
# byte_code * BASE**position give the hash of every word at once, without a Python loop over words.

_rng = np.random.default_rng(20240229)
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
CHUNK_BYTES = 1 << 18

#: Space and the bytes 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: list[np.ndarray] = []


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least. Only tables for a window of usual size are remembered."""
    if not _powers:
        _powers.extend(_powers_of(2 * CHUNK_BYTES))
    return (_powers[0], _powers[1]) if n <= len(_powers[0]) else _powers_of(n)


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, BASE_INVERSE):
        steps = np.full(n, base, U64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def chunks(texts, limit: int = CHUNK_BYTES):
    """(first index, encoded texts) for consecutive runs of texts of about `limit` bytes; a longer text is a run of its own."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8") if isinstance(text, str) else b""
        if held and size + len(data) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield first, held


def word_hashes(encoded: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words (runs without ASCII white space) of the texts in order, and the index of each word's text."""
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    if lower:
        data = LOWER[data]
    space = IS_SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    lengths = np.fromiter((len(x) + 1 for x in encoded), np.int64, len(encoded))
    owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
    return span_hashes(data, starts, ends), owner

def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans in order, which depend on their bytes alone. Works in windows of bytes, so that memory doesn't grow with long texts."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, side="right")))
        a, b = starts[i:j] - base, ends[i:j] - base
        window = data[base : int(ends[j - 1])]
        up, down = _power_table(len(window) + 1)
        sums = np.empty(len(window) + 1, U64)
        sums[0] = 0
        np.cumsum(BYTE_CODES[window] * up[: len(window)], out=sums[1:])
        out[i:j] = mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(U64))
        i = j
    return out

"""Token counts as delta-maintained rollups.

A change log of signed entries (a document inserted, deleted, or counted anew) is folded into additive totals by source,
language and tokenizer version. The store is a folder of Parquet tables in the shared folder: one directory of delta
totals for each batch, written whole or not at all. A batch that is delivered again finds its directory committed and adds
nothing. Totals are sums over committed batches; compaction folds old ones into one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
NONE = "(none)"

# The tokenizer versions of the registered query. Both count runs of characters.
TOKENIZERS = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[^0-9A-Za-z\x{80}-\x{10FFFF}\x20\x09-\x0D]+"}


def count_tokens(text: Column, tokenizer: str) -> Column:
    """Tokens of a text by a tokenizer version; none in null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[tokenizer])), F.lit(0)).cast("long")


def deltas(changes: DataFrame) -> DataFrame:
    """Delta totals of a batch of changes: op (insert, delete, revise), source, lang, tokenizer, tokens, and for revisions
    old_tokenizer and old_tokens; also old_source and old_lang, where these columns are there and not null.

    A revision takes the old count from the old version (source, language) and adds the new one to the new. Nulls in keys count as
    `(none)`, null token counts as 0. Another op is an error. Changes cancel out: keys whose sums are 0 are left out. Other
    columns are ignored.
    """
    now_at = {c: F.coalesce(F.col(c), F.lit(NONE)) for c in ("source", "lang")}
    old_at = {c: F.coalesce(F.col(f"old_{c}"), own) if f"old_{c}" in changes.columns else own for c, own in now_at.items()}
    n = F.coalesce(F.col("tokens"), F.lit(0)).cast("long")
    old = F.coalesce(F.col("old_tokens"), F.lit(0)).cast("long")
    entry = lambda at, tokenizer, docs, tokens: F.struct(*(x.alias(c) for c, x in at.items()), F.coalesce(tokenizer, F.lit(NONE)).alias("tokenizer"), F.lit(docs).cast("long").alias("docs"), tokens.alias("tokens"))
    now, before = F.col("tokenizer"), F.col("old_tokenizer")
    entries = (
        F.when(F.col("op") == "insert", F.array(entry(now_at, now, 1, n)))
        .when(F.col("op") == "delete", F.array(entry(now_at, now, -1, -n)))
        .when(F.col("op") == "revise", F.array(entry(old_at, before, -1, -old), entry(now_at, now, 1, n)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(F.col("op"), F.lit("null")))))
    )
    rows = changes.select(F.explode(entries).alias("e")).select("e.*")
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")


@dataclass
class Rollup:
    """The store at a path that all machines see."""

    spark: SparkSession
    path: str

    def _fs(self):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def committed(self) -> list[str]:
        """The ids of batches whose directory is whole, and `upto-N` for compacted ones."""
        fs, path = self._fs()
        root = path(self.path)
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n for n in names if not n.startswith((".", "_")) and fs.exists(path(f"{self.path}/{n}/_SUCCESS")))

    def _covered(self, batch: int, names: list[str]) -> bool:
        return f"batch-{batch}" in names or any(n.startswith("upto-") and int(n[5:]) >= batch for n in names)

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Commits a batch of changes (ids are whole numbers); False if it was committed before. What a failed attempt left is
        written over: only a whole directory counts. Also fits `foreachBatch`."""
        if self._covered(batch, self.committed()):
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.path}/batch-{batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches."""
        return self._sum(self.committed(), None)

    def _sum(self, names: list[str], upto: int | None) -> DataFrame:
        last = max((int(n[5:]) for n in names if n.startswith("upto-")), default=None)
        batches = [int(n[6:]) for n in names if n.startswith("batch-")]
        use = [f"batch-{b}" for b in batches if (last is None or b > last) and (upto is None or b <= upto)] + ([f"upto-{last}"] if last is not None else [])
        if not use:
            return self.spark.createDataFrame([], DELTA)
        rows = self.spark.read.schema(DELTA).parquet(*(f"{self.path}/{n}" for n in use))
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")

    def compact(self, upto: int) -> None:
        """Folds the batches up to an id into one table; later ones stay as they are. Ids count from 0 without gaps: while a batch up to
        `upto` is missing nothing is folded (an error), so that it can still come in."""
        names = self.committed()
        missing = [b for b in range(upto + 1) if not self._covered(b, names)]
        if missing:
            raise ValueError(f"batches not committed yet: {missing[:20]}")
        if f"upto-{upto}" not in names:
            self._sum(names, upto).write.mode("overwrite").parquet(f"{self.path}/upto-{upto}")


def change_log(docs: DataFrame) -> list[DataFrame]:
    """Three batches of changes that a growing corpus makes of `docs`: all rows come in, counted by the first version; those whose
    id ends in 3 go; those left whose id ends in an even digit are counted again by the second version."""
    text = F.col("text").cast("string")
    one, two = count_tokens(text, "words-1"), count_tokens(text, "words-2")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    row = lambda op, tokenizer, tokens, old_tokenizer, old: (
        F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), tokens.alias("tokens"), F.lit(old_tokenizer).cast("string").alias("old_tokenizer"), old.cast("long").alias("old_tokens"),
    )
    nothing = F.lit(None)
    digit = F.pmod("doc_id", F.lit(10))
    return [
        base.select(*row("insert", "words-1", one, None, nothing)),
        base.where(digit == 3).select(*row("delete", "words-1", one, None, nothing)),
        base.where(digit % 2 == 0).select(*row("revise", "words-2", two, "words-1", one)),
    ]

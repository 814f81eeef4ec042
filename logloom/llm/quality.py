"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (tokens and neighbouring pairs): one of the target text, the documents labelled
good, and one of the raw text, all documents. A document's weight is the log ratio of its probabilities under the two.
Documents longer than a reference length are scaled down to it, so that they don't win by length; short ones keep the
little evidence that they are. Gumbel top-k turns weights into a sample without replacement: the k largest of weight plus
Gumbel noise. k is the number of documents whose weight lies on the good side of a cut calibrated on the labelled ones;
what the sample leaves out is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import U64, bound_batches, chunks, drawn, durable, fresh, mix64, over_column, span_hashes

_CLASS = np.full(256, 2, np.uint8)  # other characters
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_ONE = U64(1 << 20)  # weights are sums of integers, in units of 2**-20, so that they don't depend on the order of summing


@dataclass(frozen=True)
class Params:
    """`max_labelled`: the models' target and the cut come from so many labelled documents at most, those of least hash;
    the raw model covers all documents. `length`: n-grams in the reference length. `smooth`: added to every bucket's count.
    """

    buckets: int = 1 << 15
    max_labelled: int = 20_000
    length: int = 256
    smooth: float = 1.0
    seed: int = 7


def features(encoded: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of some texts in order, and where each text's begin (one more than texts).

    Tokens are runs of letters and digits or of other characters. A token that repeats the one before it, or a pair
    that repeats the pair before it, counts as a repetition whatever its words are.
    """
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    kind = _CLASS[data]
    edge = np.flatnonzero(np.diff(kind)) + 1
    starts = np.concatenate(([0], edge))
    stops = np.concatenate((edge, [len(data)]))
    word = kind[starts] > 0
    starts, stops = starts[word], stops[word]
    tokens = span_hashes(data, starts, stops)
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in encoded), np.int64, len(encoded)))
    first = np.searchsorted(starts, np.concatenate(([0], ends)))
    new = np.zeros(len(tokens) + 1, bool)
    new[first] = True
    again = np.zeros(len(tokens), bool)
    if len(tokens) > 1:
        again[1:] = (tokens[1:] == tokens[:-1]) & ~new[1:-1]
    if len(tokens) > 3:
        again[3:] |= (tokens[3:] == tokens[1:-2]) & (tokens[2:-1] == tokens[:-3]) & ~(new[3:-1] | new[2:-2] | new[1:-3])
    symbols = np.where(again, U64(0x5EED), tokens)
    out = np.empty(2 * len(symbols), np.int64)
    mask = U64(buckets - 1)
    out[0::2] = (symbols & mask).view(np.int64)
    before = np.concatenate((symbols[:1], symbols[:-1])) if len(symbols) else symbols
    before = np.where(new[:-1], U64(1), before)
    out[1::2] = (mix64(before * U64(0x9E3779B97F4A7C15) + symbols) & mask).view(np.int64)
    return out, 2 * first


def labelled_sample(labels: DataFrame, p: Params) -> DataFrame:
    """doc_id, quality of at most `max_labelled` documents, conflicting labels counted as bad."""
    one = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    return drawn(one, F.col("doc_id"), p.max_labelled).orderBy(F.xxhash64(F.lit(29), "doc_id"), "doc_id").limit(p.max_labelled)


def fit(docs: DataFrame, good: DataFrame, p: Params) -> np.ndarray:
    """Integer log ratios by bucket: the target model from the documents in `good` (doc_id, at most `max_labelled`), the raw one from all."""

    def count(batches):
        raw, target = np.zeros(p.buckets, np.int64), np.zeros(p.buckets, np.int64)
        for pdf in batches:
            wanted = pdf["wanted"].to_numpy()
            for i, encoded in chunks(pdf["text"]):
                found, first = features(encoded, p.buckets)
                raw += np.bincount(found, minlength=p.buckets)
                for k in np.flatnonzero(wanted[i : i + len(encoded)]):
                    part = found[first[k] : first[k + 1]]
                    if len(part):
                        target += np.bincount(part, minlength=p.buckets) if len(part) > 4096 else _few(part, p.buckets)
        seen = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": seen, "raw": raw[seen], "target": target[seen]})

    bound_batches(docs.sparkSession)
    marked = _texts(docs).join(F.broadcast(good.select("doc_id", F.lit(True).alias("wanted"))), "doc_id", "left").select("text", F.coalesce("wanted", F.lit(False)).alias("wanted"))
    sums = marked.mapInPandas(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    found = sums.toPandas()  # a row for each bucket at most
    raw, target = np.full(p.buckets, p.smooth), np.full(p.buckets, p.smooth)
    raw[found["bucket"]] += found["raw"]
    target[found["bucket"]] += found["target"]
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    return np.rint(ratio * float(_ONE)).astype(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _few(part: np.ndarray, buckets: int) -> np.ndarray:
    out = np.zeros(buckets, np.int64)
    np.add.at(out, part, 1)
    return out


def weigh(texts, ratios: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """n-grams and log weight (at the reference length if longer) of some texts. Without n-grams the weight is minus infinity."""
    sizes, weights = np.zeros(len(texts), np.int64), np.full(len(texts), -np.inf)
    for i, encoded in chunks(texts):
        found, first = features(encoded, len(ratios))
        n = np.diff(first)
        sums = np.concatenate(([0], np.cumsum(ratios[found])))
        total = sums[first[1:]] - sums[first[:-1]]
        some = n > 0
        at = np.arange(i, i + len(encoded))
        sizes[at] = n
        weights[at[some]] = total[some] / float(_ONE) * np.minimum(1.0, p.length / n[some])
    return sizes, weights


def gumbel(doc_id: Column, seed: int) -> Column:
    """Gumbel noise that depends on the id and the seed alone: minus the log of minus the log of a hash as a number from 0 to 1."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), doc_id.cast("long")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(uniform))


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the fewest labelled documents on the wrong side: the middle of the best gap. Good ones are the larger part
    of a corpus worth filtering, so this leans towards keeping them. Without either kind nothing is cut."""
    good, bad = good[np.isfinite(good)], bad[np.isfinite(bad)]
    if not len(good) or not len(bad):
        return -np.inf
    values = np.unique(np.concatenate((good, bad)))
    cuts = np.concatenate((values[:1] - 1, (values[1:] + values[:-1]) / 2))
    won = len(good) - np.searchsorted(np.sort(good), cuts) + np.searchsorted(np.sort(bad), cuts)
    return float(cuts[np.argmax(won)])


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096, few: int = 10_000) -> float:
    """The k-th largest finite value, exactly: histograms narrow its range until a bounded number of values is left."""
    rows = rows.where(F.abs(F.col(column)) < float("inf")).select(F.col(column).alias("v"))
    low, high, total = rows.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not total or k <= 0:
        return float("inf")
    k = min(k, total)
    while True:
        part = rows.where(F.col("v").between(low, high))
        if total <= few or low == high:
            values = [r[0] for r in part.orderBy(F.desc("v")).limit(few).collect()] if low < high else [low]
            return values[min(k, len(values)) - 1]
        width = (high - low) / bins
        place = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0)
        found = part.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy(F.desc("bin")).collect()
        for row in found:
            if k <= row["n"]:
                low, high, total = row["a"], row["b"], row["n"]
                break
            k -= row["n"]


@dataclass
class Model:
    ratios: np.ndarray
    cut: float
    threshold: float


def scores(docs: DataFrame, ratios: np.ndarray, p: Params) -> DataFrame:
    """doc_id, n_grams, log_weight, sample_key for each row."""
    found = over_column(_texts(docs), "text", lambda texts: weigh(texts, ratios, p), "n_grams long, log_weight double")
    return found.withColumn("sample_key", F.col("log_weight") + gumbel(F.col("doc_id"), p.seed))


def train(docs: DataFrame, labels: DataFrame, p: Params, k: int | None = None) -> tuple[Model, DataFrame]:
    """The model and the scores of all rows. `k`: documents to sample; by default as many as weigh more than the cut."""
    known = durable(labelled_sample(labels, p))
    good = known.where("quality > 0")
    ratios = fit(docs, good, p)
    found = durable(scores(docs, ratios, p))
    cut = -np.inf
    if not good.isEmpty():
        # one row for each labelled document; of rows that repeat an id, the least weight
        judged = found.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("log_weight").alias("log_weight")).toPandas()
        cut = best_cut(judged.loc[judged["quality"] > 0, "log_weight"].to_numpy(), judged.loc[judged["quality"] <= 0, "log_weight"].to_numpy())
    k = found.where(F.col("log_weight") > cut).count() if k is None else k
    return Model(ratios, cut, kth_largest(found, "sample_key", k)), found


def classify(docs: DataFrame, labels: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id, n_grams, log_weight, sample_key, kept: one row for each row of `docs`.

    Null, empty and wordless texts have no n-grams, weight minus infinity, and are rejected. Rows with equal keys at the
    sample's edge are kept together. doc_id null: scored like any other. Without labels of both kinds nothing with a
    word is rejected. Other columns are ignored.
    """
    model, found = train(docs, labels, p or Params())
    return found.withColumn("kept", F.col("sample_key") >= model.threshold)


def select(docs: DataFrame, labels: DataFrame, p: Params | None = None) -> DataFrame:
    """The rows of `docs` that `classify` keeps, all columns as they are. Texts are scored again in place, not shuffled, and only
    they go to Python."""
    p = p or Params()
    model, _ = train(docs, labels, p)
    bound_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def log_weight(texts: pd.Series) -> pd.Series:
        return pd.Series(weigh(texts.tolist(), model.ratios, p)[1])

    (name,) = fresh(docs, "log_weight")
    weighed = docs.withColumn(name, log_weight(F.col("text").cast("string")))
    return weighed.where(F.col(name) + gumbel(F.col("doc_id"), p.seed) >= F.lit(model.threshold)).select(*docs.columns)

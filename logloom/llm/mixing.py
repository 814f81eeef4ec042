"""Mixing sources to target weights by iterative proportional fitting.

Token weights by (source, language, topic) are raked until their sums by source, by language and by topic are the targets.
Documents are then sampled with probabilities in proportion to raked over present weight of their cell, scaled so that
the expected number of tokens is the budget.

Topics are a given column, or those of a mixture of word distributions: seeded by a few documents, then fitted by passes over the
whole texts of all documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import U64, bound_batches, chunks, drawn, durable, fresh, over_column, word_hashes

DIMENSIONS = ("source", "lang", "topic")
UNKNOWN = "(none)"


@dataclass(frozen=True)
class Params:
    """`targets`: for each dimension, shares by value. Values not named divide what the named ones leave to 1, in proportion to their
    present shares raised to `temper` (below 1 flattens them); named ones that sum up to more than 1 are scaled to 1. `budget`:
    expected share of tokens to keep. `driver_cells`: so many cells at most are raked in memory on the driver, more as a Spark
    job.

    `topic_column`: a column of `docs` with topics. Without one, `topics` of them are fitted over word counts in `buckets`, from
    `seed_docs` documents of least hash and then by `passes` over all documents.
    """

    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    temper: float = 0.9
    budget: float = 0.9
    topic_column: str | None = None
    topics: int = 8
    buckets: int = 1024
    seed_docs: int = 256
    passes: int = 2
    rounds: int = 60
    tolerance: float = 1e-9
    driver_cells: int = 200_000
    seed: int = 11


_UNIT = 1 << 16  # word weights are whole numbers of this unit, so that no sum depends on its order


def _buckets(texts, p: Params):
    """(index of the first text, word buckets, where each text's begin) for chunks of texts."""
    for first, encoded in chunks(texts):
        hashes, owner = word_hashes(encoded, lower=True)
        yield first, (hashes & U64(p.buckets - 1)).astype(np.int64), np.searchsorted(owner, np.arange(len(encoded) + 1))


def _weights(counts: np.ndarray) -> np.ndarray:
    """Log probabilities by topic and bucket, in whole units."""
    smooth = counts + 1.0
    return np.rint(np.log(smooth / smooth.sum(axis=1, keepdims=True)) * _UNIT).astype(np.int32)


def assign(texts, weights: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The topic under which each text is likeliest (the first of equals; -1 without words), and its number of words."""
    best, words, rows = np.full(len(texts), -1, np.int64), np.zeros(len(texts), np.int64), np.ascontiguousarray(weights.T)
    for first, bucket, starts in _buckets(texts, p):
        n = np.diff(starts)
        at = first + np.arange(len(n))
        words[at] = n
        some = np.flatnonzero(n)
        if len(some):
            best[at[some]] = np.add.reduceat(rows[bucket], starts[some], axis=0, dtype=np.int64).argmax(axis=1)
    return best, words


def fit_topics(docs: DataFrame, p: Params) -> np.ndarray:
    """The word weights of the topics, which depend on the documents alone, not on their order or partitions."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def histogram(values):
        out = []
        for _, bucket, starts in _buckets(values, p):
            out += [np.bincount(bucket[a:b], minlength=p.buckets) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        return [out]

    # texts that repeat count once; hashes alone make the draw
    hashed = texts.where("text is not null").withColumn("hash", F.xxhash64("text"))
    few = drawn(hashed.select("hash"), F.col("hash"), 4 * p.seed_docs).distinct().orderBy(F.xxhash64(F.lit(29), "hash"), "hash").limit(p.seed_docs)
    seeds = over_column(hashed.join(F.broadcast(few), "hash").select("hash", "text"), "text", histogram, "h array<long>")
    seeds = seeds.groupBy("hash").agg(F.first("h").alias("h")).orderBy("hash").toPandas()  # a row of whole numbers for each of a few documents
    weights = _weights(_seeded(np.stack(seeds["h"]).astype(np.float64) if len(seeds) else np.zeros((0, p.buckets)), p))

    def count(batches):
        sums = np.zeros((p.topics, p.buckets), np.int64)
        for pdf in batches:
            for first, bucket, starts in _buckets(pdf["text"], p):
                topic, _ = assign(pdf["text"].iloc[first : first + len(starts) - 1].tolist(), weights, p)
                own = np.repeat(topic, np.diff(starts))
                sums += np.bincount(own * p.buckets + bucket, minlength=sums.size).reshape(sums.shape)
        at = np.flatnonzero(sums)
        yield pd.DataFrame({"cell": at, "n": sums.reshape(-1)[at]})

    bound_batches(docs.sparkSession)
    for _ in range(p.passes):
        found = texts.select("text").mapInPandas(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # topics times buckets at most
        sums = np.zeros(p.topics * p.buckets)
        sums[found["cell"]] = found["n"]
        weights = _weights(sums.reshape(p.topics, p.buckets))
    return weights


def _seeded(rows: np.ndarray, p: Params) -> np.ndarray:
    """Word counts of topics from a few documents: far ones first, then rounds of assigning and summing."""
    rows = rows[rows.sum(axis=1) > 0]
    if not len(rows):
        return np.zeros((p.topics, p.buckets))
    unit = np.sqrt(rows / rows.sum(axis=1, keepdims=True))
    chosen = [0]
    while len(chosen) < p.topics:
        chosen.append(int((unit @ unit[chosen].T).max(axis=1).argmin()))
    sums = rows[chosen]
    for _ in range(8):
        topic = (rows @ _weights(sums).T.astype(np.float64)).argmax(axis=1)
        sums = np.stack([rows[topic == k].sum(axis=0) for k in range(p.topics)])
    return sums


def _cell(docs: DataFrame, p: Params) -> dict[str, Column]:
    """The dimensions that columns give."""
    given = {"source": "source", "lang": "lang"} | ({"topic": p.topic_column} if p.topic_column else {})
    return {d: F.coalesce(F.col(c).cast("string"), F.lit(UNKNOWN)) for d, c in given.items()}


def _name(topic: np.ndarray) -> list[str]:
    return ["none" if k < 0 else str(k) for k in topic.tolist()]


def described(docs: DataFrame, p: Params, weights: np.ndarray | None) -> DataFrame:
    """doc_id, the cell and tokens (words) of each row. Nulls in source, lang or a given topic are the value `(none)`; a text without
    words, or null, has no tokens and (where topics are fitted) the topic `none`."""

    def work(texts):
        if weights is None:
            return [np.concatenate([np.diff(starts) for _, _, starts in _buckets(texts, p)])]
        topic, words = assign(texts, weights, p)
        return _name(topic), words

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(d) for d, c in _cell(docs, p).items()), F.col("text").cast("string").alias("text"))
    return over_column(rows, "text", work, "tokens long" if weights is None else "topic string, tokens long").select("doc_id", *DIMENSIONS, "tokens")


def shares(cells: DataFrame, p: Params) -> dict[str, DataFrame]:
    """By dimension: its values and their target shares, over the values that occur."""
    out = {}
    for d in DIMENSIONS:
        own = cells.groupBy(d).agg(F.sum("tokens").alias("have")).where("have > 0")
        named = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in p.targets.get(d, {}).items()], f"{d} string, named double")
        own = own.join(F.broadcast(named), d, "left").withColumn("rest", F.when(F.col("named").isNull(), F.pow(F.col("have").cast("double"), p.temper)).otherwise(0.0))
        given, rest = own.agg(F.coalesce(F.sum("named"), F.lit(0.0)), F.coalesce(F.sum("rest"), F.lit(0.0))).first()
        left = max(0.0, 1.0 - given)
        whole = given + (left if rest else 0.0) or 1.0
        out[d] = own.select(d, (F.coalesce("named", F.col("rest") * F.lit(left / rest if rest else 0.0)) / F.lit(whole)).alias("want"))
    return out


def rake(cells: DataFrame, p: Params) -> DataFrame:
    """source, lang, topic, tokens, weight, off: the cells with the share of tokens that raking gives each, and (the same in each row) how
    far the marginal sums still are from their targets at most. Cells without tokens have no weight. Where cells that don't occur
    keep targets from being met, `off` stays above the tolerance after all rounds."""
    cells = durable(cells)
    targets = shares(cells, p)
    if cells.count() <= p.driver_cells:
        found = rake_table(cells.toPandas(), {d: t.toPandas().set_index(d)["want"].to_dict() for d, t in targets.items()}, p)
        return cells.sparkSession.createDataFrame(found, "source string, lang string, topic string, tokens long, weight double, off double")
    now, gap = cells.withColumn("weight", F.col("tokens").cast("double")), 0.0
    for _ in range(p.rounds):
        for d in DIMENSIONS:
            sums = now.groupBy(d).agg(F.sum("weight").alias("sum")).join(targets[d], d, "left")
            factor = sums.select(d, F.when(F.col("sum") > 0, F.coalesce("want", F.lit(0.0)) / F.col("sum")).otherwise(0.0).alias("f"))
            now = now.join(factor, d).withColumn("weight", F.col("weight") * F.col("f")).drop("f")
        now = durable(now)
        off = [now.groupBy(d).agg(F.sum("weight").alias("sum")).join(targets[d], d, "left").agg(F.max(F.abs(F.col("sum") - F.coalesce("want", F.lit(0.0))))).first()[0] for d in DIMENSIONS]
        gap = max(x or 0.0 for x in off)
        if gap <= p.tolerance:
            break
    return now.select(*DIMENSIONS, "tokens", "weight", F.lit(float(gap)).alias("off"))


def rake_table(cells: pd.DataFrame, targets: dict[str, dict[str, float]], p: Params) -> pd.DataFrame:
    """`rake` for a bounded number of cells."""
    cells = cells.sort_values(list(DIMENSIONS)).reset_index(drop=True)
    weight = cells["tokens"].to_numpy(np.float64)
    codes = {d: pd.factorize(cells[d]) for d in DIMENSIONS}
    want = {d: np.array([targets[d].get(v, 0.0) for v in values]) for d, (_, values) in codes.items()}
    off = 0.0
    for _ in range(p.rounds):
        for d, (at, values) in codes.items():
            sums = np.bincount(at, weights=weight, minlength=len(values))
            weight = weight * np.divide(want[d], sums, out=np.zeros(len(values)), where=sums > 0)[at]
        off = max((np.abs(np.bincount(at, weights=weight, minlength=len(v)) - want[d]).max(initial=0.0) for d, (at, v) in codes.items()), default=0.0)
        if off <= p.tolerance:
            break
    return cells.assign(weight=weight, off=float(off))[[*DIMENSIONS, "tokens", "weight", "off"]]


def scale_for(budget: float, tokens: np.ndarray, ratio: np.ndarray) -> float:
    """The s with sum of tokens * min(1, s * ratio) = budget (or the sum of all, if the budget can't be met)."""
    order = np.argsort(-ratio)
    tokens, ratio = tokens[order], ratio[order]
    full = np.concatenate(([0.0], np.cumsum(tokens)))
    rest = np.concatenate((np.cumsum((tokens * ratio)[::-1])[::-1], [0.0]))
    for i in range(len(ratio)):
        if ratio[i] <= 0:
            break
        s = (budget - full[i]) / rest[i]
        if s * ratio[i] <= 1:
            return float(s)
    positive = ratio[ratio > 0]
    return float(1 / positive.min()) if len(positive) else 0.0


def probabilities(raked: DataFrame, p: Params) -> DataFrame:
    """source, lang, topic, p: each cell's sampling probability. The scale is found by bisection on sums over the cells, so that
    nothing but sums leaves them."""
    rows = durable(raked.where("tokens > 0 and weight > 0").select(*DIMENSIONS, F.col("tokens").cast("double").alias("tokens"), (F.col("weight") / F.col("tokens")).alias("ratio")))
    if rows.count() <= p.driver_cells:
        own = rows.select("tokens", "ratio").toPandas().sort_values(["ratio", "tokens"])
        total = raked.agg(F.sum("tokens")).first()[0] or 0
        scale = scale_for(p.budget * float(total), own["tokens"].to_numpy(), own["ratio"].to_numpy())
    else:
        total = float(raked.agg(F.sum("tokens")).first()[0])
        low, high = 0.0, 1 / rows.agg(F.min("ratio")).first()[0]
        for _ in range(60):
            scale = (low + high) / 2
            kept = rows.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("ratio") * scale))).first()[0]
            low, high = (scale, high) if kept < p.budget * total else (low, scale)
    chance = F.when((F.col("tokens") > 0), F.least(F.lit(1.0), F.col("weight") / F.col("tokens") * scale)).otherwise(1.0)
    return raked.select(*DIMENSIONS, chance.alias("p"), "off")


#: Marginals that lie so close to their targets count as met.
MET = 1e-6


def uniform(doc_id: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the id and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), doc_id.cast("long")), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _planned(docs: DataFrame, p: Params) -> tuple[np.ndarray | None, DataFrame, DataFrame]:
    """Topic weights, the described rows, and the chance of each cell."""
    weights = None if p.topic_column else fit_topics(docs, p)
    rows = durable(described(docs, p, weights))
    chance = durable(probabilities(rake(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), p), p), 1)
    return weights, rows, F.broadcast(chance) if chance.count() <= p.driver_cells else chance


def decide(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, p, kept, converged: one row for each row of `docs`.

    kept: a hash of doc_id as a number from 0 to 1 lies below p, so the same documents are chosen whatever the partitions.
    Rows with the same doc_id share their number. Cells whose documents have no tokens keep them (p 1). doc_id null is a
    value like another. converged: raking met all targets. An empty table gives no rows.
    """
    p = p or Params()
    _, rows, chance = _planned(docs, p)
    met = (F.col("off") <= MET).alias("converged")
    return rows.join(chance, list(DIMENSIONS)).select("doc_id", *DIMENSIONS, "tokens", "p", (uniform(F.col("doc_id"), p.seed) < F.col("p")).alias("kept"), met)


def sample(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """The rows of `docs` that `decide` keeps, all columns as they are. Only texts go to Python."""
    p = p or Params()
    weights, _, chance = _planned(docs, p)
    names = dict(zip((*DIMENSIONS, "p"), fresh(docs, "mix_source", "mix_lang", "mix_topic", "mix_p"), strict=True))
    cell = _cell(docs, p)
    if weights is not None:

        @F.pandas_udf("string")
        def topic(texts: pd.Series) -> pd.Series:
            return pd.Series(_name(assign(texts.tolist(), weights, p)[0]), dtype=object)

        cell["topic"] = topic(F.col("text").cast("string"))
    keyed = docs.withColumns({names[d]: c for d, c in cell.items()})
    renamed = chance.select(*(F.col(d).alias(names[d]) for d in names))
    return keyed.join(renamed, [names[d] for d in DIMENSIONS]).where(uniform(F.col("doc_id"), p.seed) < F.col(names["p"])).select(*docs.columns)

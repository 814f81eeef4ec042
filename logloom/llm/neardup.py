"""MinHash near-dedup with SetSketch registers.

Documents are sets of distinct five-word shingles. Each set gets SetSketch registers: exponentially spaced, truncated
minima. Registers of a union are the elementwise maxima of the registers, so sketches are mergeable; equal registers are
about as likely as the sets' Jaccard similarity. Bands of registers name candidates, the joint likelihood of register
comparisons drops most of them, and the full sets decide.

How it scales: equal sets become one class before anything is paired. Classes that share a band value are joined into
clusters through the smallest id of the value (a star, never all pairs). Every link lies inside a cluster. A cluster is
dealt into blocks, and every pair of blocks is one bounded unit of work which returns at most a spanning forest of its
links: components come out whole, and the output is never quadratic.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import U64, chunks, durable, mix64, over_column, with_id_column, word_hashes

WORDS = 5
_rng = np.random.default_rng(77)
_PLACE = _rng.integers(1, 2**63, 8, dtype=np.uint64) * U64(2) + U64(1)


@dataclass(frozen=True)
class Params:
    """`percent`: least similarity in hundredths. A pair at that similarity shares no band with a probability below 1e-6.

    `base`, `rate` and `limit` are SetSketch's b, a and q. `block_rows`, `block_shingles`: the most one block may hold.
    `slack`: a pair goes on to its full sets if the likelihood's maximum lies above the threshold less this (five
    standard deviations).
    """

    percent: int = 85
    bands: int = 36
    rows: int = 7
    base: float = 1.001
    rate: float = 20.0
    limit: int = 65534
    slack: float = 0.12
    block_rows: int = 512
    block_shingles: int = 400_000

    @property
    def registers(self) -> int:
        return self.bands * self.rows


#: Near copies in training data: a similarity of 0.8 or more.
TRAINING = Params(percent=80, bands=46, rows=6)


def shingle_sets(texts) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty without words, one of the whole sequence below five words."""
    out: list[np.ndarray] = []
    for _, encoded in chunks(texts):
        words, owner = word_hashes(encoded, lower=True)
        first = np.searchsorted(owner, np.arange(len(encoded) + 1))
        rolled = np.zeros(max(len(words) - WORDS + 1, 0), U64)
        for k in range(WORDS):
            rolled += words[k : k + len(rolled)] * _PLACE[k]
        rolled = mix64(rolled)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= WORDS:
                out.append(np.unique(rolled[a : b - WORDS + 1]))
            elif b > a:
                out.append(mix64((words[a:b] * _PLACE[: b - a]).sum(dtype=U64, keepdims=True) + U64(int(b - a))))
            else:
                out.append(words[:0])
    return out


def sketch(hashes: np.ndarray, p: Params) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes.

    The smallest of exponential variables belongs to the smallest of the uniform ones that they come from, so the
    minimum is taken over 32-bit uniforms and only the winner is turned into an exponential and spaced.
    """
    rng = np.random.default_rng(4242)
    times = (rng.integers(1, 2**31, p.registers, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
    flips = rng.integers(0, 2**32, p.registers, dtype=np.uint32)[:, None]
    least = np.full(p.registers, 2**32 - 1, np.uint32)
    short = (hashes >> U64(32)).astype(np.uint32)
    for i in range(0, len(short), 512):
        np.minimum(least, ((short[None, i : i + 512] ^ flips) * times).min(axis=1), out=least)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**32
    value = np.floor(1.0 - np.log(-np.log1p(-uniform) / p.rate) / np.log(p.base))
    return np.clip(value, 0, p.limit + 1).astype(np.uint16)


def band_hashes(registers: np.ndarray, p: Params) -> np.ndarray:
    """One 64-bit value for each band of a sketch."""
    grid = registers.reshape(p.bands, p.rows).astype(U64) + U64(1)
    return mix64((grid * _PLACE[: p.rows]).sum(axis=1, dtype=U64) + np.arange(p.bands, dtype=U64) * U64(0x9E3779B97F4A7C15))


def likely(registers: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray, p: Params) -> np.ndarray:
    """Which of `others` have the maximum of the joint likelihood at a similarity above the threshold less the slack.

    The log likelihood is concave in the similarity, so the sign of its slope there decides. Pairs whose sizes alone rule
    the threshold out are dropped first.
    """
    fits = 100 * np.minimum(size, sizes) >= p.percent * np.maximum(size, sizes)
    where = np.flatnonzero(fits)
    if not len(where):
        return where
    them = others[where]
    equal = (them == registers).sum(axis=1)
    more = (registers > them).sum(axis=1)
    less = p.registers - equal - more
    u = size / (size + sizes[where])
    v = 1.0 - u
    at = p.percent / 100 - p.slack
    step = (p.base - 1) / p.base

    def chance(x):
        return -np.log1p(-x * step) / np.log(p.base)

    def slope(x):
        return step / (np.log(p.base) * (1 - x * step))

    a, b = u - v * at, v - u * at
    gain = equal * (v * slope(a) + u * slope(b)) / np.maximum(1 - chance(a) - chance(b), 1e-12)
    loss = more * v * slope(a) / np.maximum(chance(a), 1e-12) + less * u * slope(b) / np.maximum(chance(b), 1e-12)
    return where[gain >= loss]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _fingerprints(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Two 64-bit sums over each set."""
    one = [int(_signed(x.sum(dtype=U64, keepdims=True))[0]) for x in sets]
    return one, [int(_signed(mix64(x ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64, keepdims=True))[0]) for x in sets]


def sketches(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, copy (a hash of the text), n, two fingerprints of the set, and the registers of those that can be like another set."""

    def work(texts):
        sets = shingle_sets(texts)
        return [len(x) for x in sets], *_fingerprints(sets), [sketch(x, p).tobytes() if may_link(len(x), p) else None for x in sets]

    rows = with_id_column(docs).select("doc_id", F.xxhash64("text").alias("copy"), "text")
    return over_column(rows, "text", work, "n long, one long, two long, regs binary")


def may_link(n: int, p: Params) -> bool:
    """Whether a set of this size can be linked with a different one: some m > n has 100 * n >= percent * m."""
    return 100 * n >= p.percent * (n + 1)


SALTS = 64


def _crowded(pairs: DataFrame, total: int) -> list[int]:
    """Nodes with more than a hundredth of all edges (and a thousand): fewer than two hundred, whatever the input."""
    if total <= 1000:
        return []
    ends = pairs.select(F.explode(F.array("a", "b")).alias("u")).groupBy("u").count()
    return [r["u"] for r in ends.where(F.col("count") > max(1000, total // 100)).collect()]


def components(edges: DataFrame, most: int | None = None, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node that each node of the edges (a, b) reaches. Alternating large and small stars.

    `most`: how many edges there are at most, if known. The neighbours of a crowded node (a hub of copies) are dealt over many
    tasks by a salt.
    """

    def star(pairs: DataFrame, large: bool, crowded: list[int]) -> DataFrame:
        both = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        if large:
            both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        is_crowded = F.col("u").isin(*crowded) if crowded else F.lit(False)
        salted = both.withColumn("salt", F.when(is_crowded, F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0))
        every = F.when(is_crowded, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        joined = salted.join(low.withColumn("salt", F.explode(every)), ["u", "salt"])
        if large:
            moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), most)
    for _ in range(rounds):
        twice = now.groupBy("a").count().where("count > 1").select("a")
        chained = now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")
        if twice.unionByName(chained).isEmpty():  # every node hangs on one root, and no root hangs on another
            break
        total = now.count()
        crowded = _crowded(now, total)
        now = durable(star(star(now, True, crowded), False, crowded), total)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        self.up[self.find(a)] = self.find(b)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _forest_of(group: pd.DataFrame, p: Params) -> list[tuple[int, int]]:
    """A spanning forest of the links among a pair of blocks (or in one block), found on the full sets."""
    group = group.sort_values("n", kind="stable").reset_index(drop=True)
    sizes = group["n"].to_numpy()
    regs = np.frombuffer(b"".join(group["regs"]), np.uint16).reshape(len(group), p.registers)
    sets = [np.frombuffer(x, U64) for x in group["hashes"]]
    block, ids = group["block"].to_numpy(), group["rep"].to_numpy()
    crossing = block.max() != block.min()
    forest, found = _Forest(len(group)), []
    for i in range(len(group)):
        end = int(np.searchsorted(sizes, 100 * sizes[i] // p.percent, side="right"))
        for j in likely(regs[i], int(sizes[i]), regs[i + 1 : end], sizes[i + 1 : end], p) + i + 1:
            if crossing and block[i] == block[j] or forest.find(i) == forest.find(j):
                continue
            if _linked(sets[i], sets[j], p.percent):
                forest.join(i, j)
                found.append((int(ids[i]), int(ids[j])))
    return found


def _links(batches, p: Params):
    """Rows come sorted by unit of work; a unit may span batches."""
    held: pd.DataFrame | None = None
    key = ["cluster", "low", "high"]

    def done(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([e for _, g in part.groupby(key, sort=False) for e in _forest_of(g, p)], columns=["a", "b"]).astype("int64")

    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = (pdf[key] == pdf[key].iloc[-1]).all(axis=1)
        held = pdf[last]
        if not last.all():
            yield done(pdf[~last])
    if held is not None and len(held):
        yield done(held)


def near_duplicates(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of `docs`.

    Text null, empty or without words: n_shingles 0, a component of its own. doc_id null: no node, component_id null,
    kept true. Rows with the same doc_id are one node, which has the links of all of its texts, and each of them is returned
    with the size of its own set. Other columns are ignored.
    """
    p = p or Params()
    all_rows = durable(sketches(docs, p))
    return _resolved(docs, all_rows, p).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _resolved(docs: DataFrame, all_rows: DataFrame, p: Params) -> DataFrame:
    """doc_id, n, component_id for each row of the sketches."""
    known = all_rows.where("doc_id is not null and n > 0")
    # a class of equal sets is named by the smallest of its ids; (rep, copy) is one text of it
    first = F.min(F.struct("doc_id", "copy")).alias("first")
    classes = durable(known.groupBy("n", "one", "two").agg(first, F.any_value("regs").alias("regs")).select("n", "one", "two", F.col("first.doc_id").alias("rep"), F.col("first.copy").alias("copy"), "regs"), all_rows.count())

    def bands(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 1024):
                part = pdf.iloc[i : i + 1024]
                regs = np.frombuffer(b"".join(part["regs"]), np.uint16).reshape(len(part), p.registers)
                yield pd.DataFrame({"band": _signed(np.concatenate([band_hashes(r, p) for r in regs])), "rep": np.repeat(part["rep"].to_numpy(), p.bands)})

    banded = classes.where("regs is not null").select("rep", "regs").mapInPandas(bands, "band long, rep long")
    hubs = banded.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub < top").select("band", "hub")
    stars = banded.join(hubs, "band").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = components(stars, 4 * classes.count()).select(F.col("node").alias("rep"), F.col("root").alias("cluster"))
    members = durable(classes.where("regs is not null").join(clusters, "rep"), classes.count())
    dealt = members.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / p.block_rows, F.sum("n") / p.block_shingles)).cast("int").alias("blocks"))
    placed = members.join(dealt, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))

    def full_sets(texts):
        sets = shingle_sets(texts)
        return [x.tobytes() for x in sets], *_fingerprints(sets)

    # rows that repeat an id and its text are one before they meet anything
    texts = with_id_column(docs).where("doc_id is not null").select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("copy"), "text").dropDuplicates(["rep", "copy"])
    with_sets = over_column(texts.join(placed, ["rep", "copy"]), "text", full_sets, "hashes binary, one_now long, two_now long").where("one = one_now and two = two_now")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = (
        with_sets.withColumn("other", other)
        .select("rep", "n", "regs", "hashes", "block", "cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        .repartition("cluster", "low", "high")
        .sortWithinPartitions("cluster", "low", "high")
    )
    links = units.mapInPandas(lambda it: _links(it, p), "a long, b long")
    # an id with several sets ties their classes together
    several = all_rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("n", "one", "two")).alias("a"), F.max(F.struct("n", "one", "two")).alias("b")).where("a <> b").select("doc_id")
    ties = known.join(several, "doc_id", "left_semi").join(classes.drop("copy", "regs"), ["n", "one", "two"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = durable(links.unionByName(ties))
    roots = components(links, links.count()).withColumnRenamed("node", "rep")
    to_root = classes.join(roots, "rep", "left").select("n", "one", "two", F.coalesce("root", "rep").alias("component_id"))
    linked = known.join(to_root, ["n", "one", "two"]).select("doc_id", "n", "component_id")
    return linked.unionByName(all_rows.where("doc_id is null or n = 0").join(roots, F.col("doc_id") == F.col("rep"), "left").select("doc_id", "n", F.coalesce("root", "doc_id").alias("component_id")))


def deduplicate(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """`docs` with one document of each group of near duplicates: the one with the smallest doc_id. Of rows that repeat a kept
    document in every column one is left; rows with its doc_id and another text, or anything else that differs, stay. Rows without
    a doc_id stay."""
    found = near_duplicates(docs, p).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("copies"))
    kept = durable(found, docs.count())
    once = docs.join(kept.where("copies = 1").select("doc_id"), "doc_id", "left_semi")
    again = docs.join(kept.where("copies > 1").select("doc_id"), "doc_id", "left_semi").dropDuplicates()
    return once.unionByName(again).unionByName(docs.where("doc_id is null"))

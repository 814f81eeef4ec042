"""Language identification by interpolated Kneser-Ney character models.

Every language gets a character model of order four. Texts are letters in lower case, with one boundary sign for
everything else; four characters of sixteen bits make one exact key (a letter beyond the first 65,536 code points is two characters,
as in UTF-16). Only the highest order is counted over the corpus:
the lower orders of Kneser-Ney are numbers of distinct left neighbours, which the distinct highest keys give. Scoring
looks every position up in sorted hash arrays, adds the log probabilities, and takes the language of the lowest cross-entropy
per character. Confidence and rejection are calibrated on training documents that a first model hasn't seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import U64, bound_batches, durable, mix64, over_column

ORDER = 4
WIDTH = 16
_BITS = U64(WIDTH)
_VOCABULARY = 65536.0
UNDETERMINED = "und"


@dataclass(frozen=True)
class Params:
    """`broadcast_cells`: distinct keys times languages of a model that tasks hold in memory; a larger one stays in tables and is
    joined with the keys of the texts. Both have every key and give the same scores. `max_languages`: more is an error.
    `calibration`: confidence and rejection are set on about so many distinct training texts, dealt by hash (a tenth at most), under a
    model of the others.
    `strictness`: a best cross-entropy so many deviations above its language's mean is rejected.
    """

    broadcast_cells: int = 6_000_000
    max_languages: int = 250
    calibration: int = 4_000
    strictness: float = 6.0


_letters: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """Characters as numbers: UTF-16 units of letters in lower case, 0 for runs of others; with a boundary at either end."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    codes = np.frombuffer(text.lower().encode("utf-16-le", "surrogatepass"), np.uint16)
    letter = _letters[0][codes]
    high = np.flatnonzero((codes[:-1] & 0xFC00) == 0xD800)
    high = high[(codes[high + 1] & 0xFC00) == 0xDC00]
    if len(high):
        point = 0x10000 + ((codes[high].astype(np.int64) & 0x3FF) << 10) + (codes[high + 1].astype(np.int64) & 0x3FF)
        letter[high] = letter[high + 1] = _letters[0][point]
    codes = np.where(letter, codes, np.uint16(0))
    kept = np.ones(len(codes), bool)
    kept[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[kept]


def keys(texts, limit: int = 1 << 18):
    """(index of the first text, keys of all positions, number of keys of each text) for chunks of texts.

    A text without letters has no keys.
    """
    held, first, size = [], 0, 0
    for i, text in enumerate(texts):
        codes = _codes(text) if isinstance(text, str) else np.zeros(0, np.uint16)
        if held and size + len(codes) > limit:
            yield first, *_pack(held)
            held, first, size = [], i, 0
        held.append(codes if codes.any() else codes[:0])
        size += len(codes)
    if held:
        yield first, *_pack(held)


def _pack(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    pad, end = np.zeros(ORDER - 1, np.uint16), np.zeros(1, np.uint16)
    sizes = np.array([len(t) + 1 if len(t) else 0 for t in texts], np.int64)
    parts = [x for t in texts if len(t) for x in (pad, t, end)]
    if not parts:
        return np.zeros(0, U64), sizes
    line = np.concatenate(parts).astype(U64)
    key = line.copy()
    for k in range(1, ORDER):
        key[k:] |= line[:-k] << U64(WIDTH * k)
    inside = np.ones(len(line), bool)
    starts = np.concatenate(([0], np.cumsum(sizes[sizes > 0] + ORDER - 1)[:-1]))
    for k in range(ORDER - 1):
        inside[starts + k] = False
    return key[inside], sizes


def count_keys(docs: DataFrame) -> DataFrame:
    """lang, gram, n, fitted: how often each key occurs in the texts of each language, and in those that aren't `held`."""

    def work(batches):
        found: dict[tuple[str, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
        for pdf in batches:
            for which, own in pdf.groupby(["lang", "held"])["text"]:
                parts = found.setdefault(which, [])
                parts += [np.unique(key, return_counts=True) for _, key, _ in keys(own) if len(key)]
                if len(parts) > 24:
                    found[which] = [_summed(parts)]
        for (lang, held), parts in found.items():
            if parts:
                key, n = _summed(parts)
                yield pd.DataFrame({"lang": lang, "gram": key.view(np.int64), "n": n, "fitted": n * (not held)})

    bound_batches(docs.sparkSession)
    counted = docs.select("lang", "text", "held").mapInPandas(work, "lang string, gram long, n long, fitted long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("fitted").alias("fitted"))


def _summed(parts) -> tuple[np.ndarray, np.ndarray]:
    key, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(back, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


class HashArray:
    """Values by 64-bit key: hashes in sorted order and an index on their first bits. Lookups probe a bucket in step."""

    def __init__(self, key: np.ndarray, bits: int = 18) -> None:
        hashed = mix64(key)
        self.order = np.argsort(hashed)
        self.hashes = np.concatenate((hashed[self.order], [U64(2**64 - 1)]))
        self.shift = U64(64 - bits)
        self.start = np.searchsorted(self.hashes[:-1], np.arange(1 << bits, dtype=U64) << self.shift).astype(np.int32)
        self.longest = int(np.diff(np.append(self.start, len(key))).max(initial=0))

    def find(self, key: np.ndarray) -> np.ndarray:
        """The rank of each key among the sorted hashes, or -1."""
        hashed = mix64(key)
        at = self.start[(hashed >> self.shift).astype(np.int64)]
        out = np.where(self.hashes[at] == hashed, at, -1)
        todo = np.flatnonzero((out < 0) & (self.hashes[at] < hashed))
        at = at[todo]
        for _ in range(self.longest):
            if not len(todo):
                break
            at += 1
            here = self.hashes[at]
            hit = here == hashed[todo]
            out[todo[hit]] = at[hit]
            on = here < hashed[todo]
            todo, at = todo[on], at[on]
        return out


def kneser_ney(key: np.ndarray, n: np.ndarray):
    """A language's model from its distinct keys and counts: for each order from one to four the keys and the log
    probabilities (interpolated), and for each order the contexts and the logs of what they leave to the next lower order."""
    grams, counts = [None] * (ORDER + 1), [None] * (ORDER + 1)
    grams[ORDER], counts[ORDER] = key, n.astype(np.float64)
    for k in range(ORDER - 1, 0, -1):
        mask = U64((1 << WIDTH * k) - 1)
        grams[k], c = np.unique(grams[k + 1] & mask, return_counts=True)  # distinct left neighbours
        counts[k] = c.astype(np.float64)
    levels = []
    lower = None
    for k in range(1, ORDER + 1):
        g, c = grams[k], counts[k]
        once, twice = (c == 1).sum(), (c == 2).sum()
        discount = once / (once + 2 * twice) if once and twice else 0.5
        context, back, kinds = np.unique(g >> _BITS, return_inverse=True, return_counts=True)
        total = np.bincount(back, weights=c)
        left = discount * kinds / total
        if k == 1:
            below = np.full(len(g), 1 / _VOCABULARY)
        else:
            at = np.searchsorted(grams[k - 1], g & U64((1 << WIDTH * (k - 1)) - 1))
            below = np.exp(lower[at])
        lower = np.log((c - discount) / total[back] + left[back] * below)
        levels.append((g, lower, context, np.log(left)))
    return levels


class Judge:
    """What decides on cross-entropies: the languages and the calibration."""

    def __init__(self, languages) -> None:
        self.languages = sorted(languages)
        self.sharpness, self.mean, self.deviation = 50.0, np.zeros(len(self.languages)), np.full(len(self.languages), np.inf)

    def calibrate(self, size: np.ndarray, entropy: np.ndarray, truth: np.ndarray) -> None:
        """Sets how sharply confidence follows the entropies (least log loss), and what is usual for each language."""
        if not len(size):
            return
        losses = []
        grid = (5.0, 10.0, 20.0, 50.0, 100.0, 200.0)
        for s in grid:
            p = self.confidence(size, entropy, s)
            losses.append(-np.log(np.maximum(p[np.arange(len(p)), truth], 1e-9)).mean())
        self.sharpness = grid[int(np.argmin(losses))]
        for j in range(len(self.languages)):
            own = entropy[(truth == j) & (size >= 20), j]
            if len(own) >= 5:
                self.mean[j], self.deviation[j] = own.mean(), max(own.std(), 0.05)

    def take(self, other: Judge) -> None:
        """The calibration of another judge, by language."""
        self.sharpness = other.sharpness
        for j, lang in enumerate(self.languages):
            if lang in other.languages:
                i = other.languages.index(lang)
                self.mean[j], self.deviation[j] = other.mean[i], other.deviation[i]

    def confidence(self, size: np.ndarray, entropy: np.ndarray, sharpness: float | None = None) -> np.ndarray:
        scale = np.minimum(size, self.sharpness if sharpness is None else sharpness)[:, None]
        z = -(entropy - entropy.min(axis=1, keepdims=True)) * scale
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True)


class Model(Judge):
    """All languages' models over common hash arrays, and the calibration."""

    def __init__(self, languages: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        super().__init__(languages)
        own = [kneser_ney(*languages[x]) for x in self.languages]
        self.levels: list[tuple[HashArray, np.ndarray, HashArray, np.ndarray]] = []
        for k in range(ORDER if own else 0):
            context = np.unique(np.concatenate([m[k][2] for m in own]))
            left = np.zeros((len(context), len(own)))
            for j, m in enumerate(own):
                left[np.searchsorted(context, m[k][2]), j] = m[k][3]
            contexts = HashArray(context)
            left = left[contexts.order].astype(np.float32)
            gram = np.unique(np.concatenate([m[k][0] for m in own]))
            value = self._below(gram, k, contexts, left)
            for j, m in enumerate(own):
                value[np.searchsorted(gram, m[k][0]), j] = m[k][1]
            table = HashArray(gram)
            self.levels.append((table, value[table.order].astype(np.float32), contexts, left))

    def _below(self, gram: np.ndarray, k: int, contexts: HashArray, left: np.ndarray) -> np.ndarray:
        """Log probabilities of keys of order k + 1 that a language has not seen: what the context leaves, times the lower order."""
        at = contexts.find(gram >> _BITS)
        value = np.where((at >= 0)[:, None], left[at], 0.0)
        if k == 0:
            return value - np.log(_VOCABULARY)
        return value + self._log(gram & U64((1 << WIDTH * k) - 1), k - 1)

    def _log(self, key: np.ndarray, k: int) -> np.ndarray:
        table, value, contexts, left = self.levels[k]
        at = table.find(key)
        out = value[at]
        missing = np.flatnonzero(at < 0)
        if len(missing):
            out[missing] = self._below(key[missing], k, contexts, left)
        return out

    def entropies(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Keys of each text and, by language, its cross-entropy in nats per key."""
        size = np.zeros(len(texts), np.int64)
        out = np.zeros((len(texts), len(self.languages)))
        for first, key, sizes in keys(texts):
            at = slice(first, first + len(sizes))
            size[at] = sizes
            some = np.flatnonzero(sizes)
            if len(some):
                starts = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
                out[first + some] = -np.add.reduceat(self._log(key, ORDER - 1), starts, axis=0, dtype=np.float64) / sizes[some, None]
        return size, out

    def scored(self, rows: DataFrame, column: str) -> DataFrame:
        """`column`, size, entropy: the keys of each row's text and its cross-entropy by language."""

        def work(texts):
            size, entropy = self.entropies(texts)
            return size, list(entropy)

        return over_column(rows.select(column, "text"), "text", work, "size long, entropy array<double>")


class JoinedModel(Judge):
    """`Model` in tables, for any number of keys: for each order the keys with the languages' log probabilities (null where a
    language has not seen the key), and the contexts with the logs of what they leave."""

    def __init__(self, languages, counts: DataFrame) -> None:
        super().__init__(languages)
        self.levels: list[tuple[DataFrame, DataFrame]] = []
        grams = [counts.select("lang", "gram", "n")]
        for k in range(ORDER - 1, 0, -1):
            low = F.col("gram").bitwiseAND(F.lit((1 << WIDTH * k) - 1))
            grams.insert(0, durable(grams[0].groupBy("lang", low.alias("gram")).agg(F.count("*").alias("n"))))  # distinct left neighbours
        lower = None
        for k, own in enumerate(grams, 1):
            few = own.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))
            discount = F.when((F.col("once") > 0) & (F.col("twice") > 0), F.col("once") / (F.col("once") + 2 * F.col("twice"))).otherwise(0.5)
            few = F.broadcast(few.select("lang", discount.alias("discount")))  # a row for each language
            own = own.withColumn("context", F.shiftrightunsigned("gram", WIDTH))
            contexts = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).join(few, "lang")
            contexts = contexts.withColumn("left", F.col("discount") * F.col("kinds") / F.col("total"))
            rows = own.join(contexts, ["lang", "context"])
            if k == 1:
                rows = rows.withColumn("below", F.lit(1 / _VOCABULARY))
            else:
                low = F.col("gram").bitwiseAND(F.lit((1 << WIDTH * (k - 1)) - 1))
                rows = rows.withColumn("low", low).join(lower.select("lang", F.col("gram").alias("low"), F.col("p").alias("below")), ["lang", "low"])
            lower = durable(rows.select("lang", "gram", ((F.col("n") - F.col("discount")) / F.col("total") + F.col("left") * F.col("below")).alias("p")))
            seen = lower.groupBy("gram").agg(self._by_language(F.log("p")).alias("seen"))
            rest = contexts.groupBy("context").agg(self._by_language(F.log("left")).alias("left"))
            self.levels.append((durable(seen), durable(rest)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "levels"}

    def _by_language(self, value):
        return F.array(*(F.max(F.when(F.col("lang") == x, value)) for x in self.languages))

    def _log(self, keys: DataFrame, k: int) -> DataFrame:
        """gram, log: the log probabilities of distinct keys of order k + 1, by language."""
        seen, rest = self.levels[k]
        keys = keys.withColumn("context", F.shiftrightunsigned("gram", WIDTH))
        if k:
            low = F.col("gram").bitwiseAND(F.lit((1 << WIDTH * k) - 1))
            keys = keys.withColumn("low", low)
            below = self._log(keys.select(F.col("low").alias("gram")).distinct(), k - 1)
            keys = keys.join(below.select(F.col("gram").alias("low"), F.col("log").alias("below")), "low")
        else:
            keys = keys.withColumn("below", F.array(*(F.lit(-float(np.log(_VOCABULARY))) for _ in self.languages)))
        joined = keys.join(seen, "gram", "left").join(rest, "context", "left")
        log = F.array(*(F.coalesce(F.col("seen")[j], F.coalesce(F.col("left")[j], F.lit(0.0)) + F.col("below")[j]) for j in range(len(self.languages))))
        return durable(joined.select("gram", log.alias("log")))

    def scored(self, rows: DataFrame, column: str) -> DataFrame:
        """As that of `Model`: the distinct keys of each text meet their log probabilities by joins, and sums go back to the rows."""

        def work(texts):
            found = []
            for _, key, sizes in keys(texts):
                stops = np.cumsum(sizes)
                found += [(n, *np.unique(key[b - n : b].view(np.int64), return_counts=True)) for n, b in zip(sizes, stops, strict=True)]
            return list(zip(*found, strict=True))

        numbered = rows.select(column, "text", F.monotonically_increasing_id().alias("row"))
        held = durable(over_column(numbered, "text", work, "size long, gram array<long>, n array<long>"))
        each = held.select("row", "size", F.explode(F.arrays_zip("gram", "n")).alias("e")).select("row", "size", "e.gram", "e.n")
        log = self._log(each.select("gram").distinct(), ORDER - 1)
        sums = [(-F.sum(F.col("n") * F.col("log")[j]) / F.first("size")) for j in range(len(self.languages))]
        entropy = each.join(log, "gram").groupBy("row").agg(F.array(*sums).alias("entropy"))
        none = F.array(*(F.lit(0.0) for _ in self.languages))
        return held.select("row", column, "size").join(entropy, "row", "left").select(column, "size", F.coalesce("entropy", none).alias("entropy"))


def _model(languages, counts: DataFrame, small: bool) -> Model | JoinedModel:
    """A model of lang, gram, n."""
    if not small:
        return JoinedModel(languages, counts)
    rows = counts.toPandas()
    by = {lang: (own["gram"].to_numpy().view(U64), own["n"].to_numpy()) for lang, own in rows.groupby("lang")}
    return Model({lang: (gram[o := np.argsort(gram)], n[o]) for lang, (gram, n) in by.items()})


def train(docs: DataFrame, p: Params | None = None) -> Model | JoinedModel:
    """The model of the texts and languages in `docs` (text, lang; others ignored). Rows with a null in either teach nothing.

    Texts held for calibration are scored by a model of the others; the model that is returned has the keys of all.
    """
    p = p or Params()
    known = docs.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    every = max(10, known.count() // p.calibration)
    known = known.withColumn("held", F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    counts = durable(count_keys(known))
    found = [r["lang"] for r in counts.select("lang").distinct().limit(p.max_languages + 1).collect()]
    if len(found) > p.max_languages:
        raise ValueError(f"more than {p.max_languages} languages")
    if not found:
        return Model({})
    small = counts.select("gram").distinct().count() * len(found) <= p.broadcast_cells
    model = _model(found, counts.select("lang", "gram", "n"), small)
    seen = counts.where("fitted > 0").select("lang", "gram", F.col("fitted").alias("n"))
    first = _model([r["lang"] for r in seen.select("lang").distinct().collect()], seen, small)
    place = F.lit(-1)
    for j, lang in enumerate(first.languages):
        place = F.when(F.col("lang") == lang, F.lit(j)).otherwise(place)
    sample = known.where("held").select(place.alias("truth"), "text").where("truth >= 0").distinct()
    judged = first.scored(sample, "truth").where("size > 0").toPandas() if first.languages else ()
    if len(judged):
        first.calibrate(judged["size"].to_numpy(), np.stack(judged["entropy"]), judged["truth"].to_numpy())
        model.take(first)
    return model


def predict(docs: DataFrame, model: Model | JoinedModel, p: Params | None = None) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, accepted: one row for each row of `docs`, from the text alone.

    Text null or without letters (or a model without languages): `und`, score 0, no cross-entropy, not accepted. Ties go to
    the language first by name. doc_id may be null or repeat; other columns are ignored. accepted is false where the
    best model explains a text much worse than texts of its language that it had not seen; lang_pred stays the best language.
    """
    p = p or Params()

    def judged(size: np.ndarray, entropy: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame({"lang_pred": UNDETERMINED, "score": 0.0, "cross_entropy": np.nan, "accepted": False}, index=range(len(size)))
        if model.languages and len(out):
            some = size > 0
            best = entropy.argmin(axis=1)
            least = entropy[np.arange(len(best)), best]
            out.loc[some, "lang_pred"] = np.array(model.languages, object)[best[some]]
            out.loc[some, "score"] = model.confidence(size, entropy).max(axis=1)[some]
            out.loc[some, "cross_entropy"] = least[some]
            out.loc[some, "accepted"] = (least <= model.mean[best] + p.strictness * model.deviation[best])[some]
        return out

    def from_texts(texts):
        found = judged(*(model.entropies(texts) if model.languages else (np.zeros(len(texts), np.int64), np.zeros((len(texts), 0)))))
        found["cross_entropy"] = found["cross_entropy"].astype(object).where(found["cross_entropy"].notna(), None)
        return [found[c].tolist() for c in found]

    def from_scores(batches):
        for pdf in batches:
            if len(pdf):
                found = judged(pdf["size"].to_numpy(), np.stack(pdf["entropy"]))
                found.insert(0, "doc_id", pdf["doc_id"].to_numpy())
                yield found

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fields = "lang_pred string, score double, cross_entropy double, accepted boolean"
    if isinstance(model, JoinedModel):
        scored = model.scored(rows.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id").mapInPandas(from_scores, f"doc_id string, {fields}")
        return scored.withColumn("doc_id", F.col("doc_id").cast("long"))
    return over_column(rows, "text", from_texts, fields)

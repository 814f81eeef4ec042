"""Byte-level BPE encoding and decoding as a monoid tree reduction.

The encodings of byte strings form a monoid: `join` makes the encoding of a concatenation out of the encodings of its
parts. `encode` splits a string in halves recursively and joins them up the tree. What makes a join local is this fact
about rank-ordered merging: a sequence of tokens is the encoding of its bytes if and only if every two neighbours are the
encoding of theirs. So a join re-encodes a window around the boundary and lets it grow until the tokens at both of its
edges are stable against their neighbours outside; everything beyond then stays as it is. Decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import over_column, with_id_column

#: Below so many bytes a string is merged directly.
LEAF = 16
NEVER = 1 << 62
#: How many distinct pieces (and pairs of tokens) a generation of a worker's memory holds. There are two: what is asked for again moves to
#: the young one, and when that is full the old one is forgotten.
REMEMBER = 128_000


class _Memory(dict):
    """Results by key, made when first asked for."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if not isinstance(key, str) or len(key) <= 64:  # long pieces are not kept
            if len(self) >= REMEMBER:
                self.old = self.copy()
                self.clear()
            self[key] = found
        return found


class Codec:
    """Encoder and decoder of one rank file. `pattern` splits a text into pieces which are encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.known = _Memory(self.piece)
        self.stable = _Memory(self._is_stable)

    @classmethod
    def load(cls, path: str, pattern: str) -> Codec:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        return cls(ranks, pattern)

    def merge(self, data: bytes) -> list[int]:
        """The encoding of a short string: merge the neighbours of lowest rank, the leftmost of equals, until none can merge."""
        ranks, rank = self.ranks, self.ranks.get
        at = list(range(len(data) + 1))  # where the parts begin, and the end
        ranked = [rank(data[i : i + 2], NEVER) for i in at[:-2]]
        while ranked and (best := min(ranked)) != NEVER:
            i = ranked.index(best)
            del ranked[i], at[i + 1]
            if i:
                ranked[i - 1] = rank(data[at[i - 1] : at[i + 1]], NEVER)
            if i < len(ranked):
                ranked[i] = rank(data[at[i] : at[i + 2]], NEVER)
        return [ranks[data[i:j]] for i, j in zip(at, at[1:], strict=False)]

    def neighbours(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of their bytes."""
        return self.stable[a, b]

    def _is_stable(self, pair: tuple[int, int]) -> bool:
        return self.merge(self.tokens[pair[0]] + self.tokens[pair[1]]) == list(pair)

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenation of two encoded strings."""
        if not left or not right:
            return left + right
        if self.neighbours(left[-1], right[0]):
            return left + right
        i, j = 1, 1  # tokens of either side in the window
        while True:
            window = self.merge(b"".join(map(self.tokens.__getitem__, left[len(left) - i :] + right[:j])))
            open_left = i < len(left) and not self.neighbours(left[len(left) - i - 1], window[0])
            open_right = j < len(right) and not self.neighbours(window[-1], right[j])
            if not open_left and not open_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = min(len(left), i + open_left), min(len(right), j + open_right)

    def reduce(self, data: bytes) -> list[int]:
        """The encoding of one piece: level by level from the leaves of the tree to its root."""
        level = [self.merge(data[i : i + LEAF]) for i in range(0, len(data), LEAF)]
        while len(level) > 1:
            pairs = [self.join(a, b) for a, b in zip(level[::2], level[1::2], strict=False)]
            level = pairs + level[len(pairs) * 2 :]
        return level[0] if level else []

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8")
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else tuple(self.reduce(data))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text))))

    def decode(self, ids: Iterable[int]) -> bytes:
        level = list(map(self.tokens.__getitem__, ids))
        while len(level) > 1:
            level = [b"".join(level[i : i + 64]) for i in range(0, len(level), 64)]
        return level[0] if level else b""


_loaded: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file; each worker reads the file once."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Codec.load(path, pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>) for each row. Null text counts as empty: no tokens. doc_id may be null or repeat."""

    def work(texts):
        own = codec(path, pattern)
        ids = [np.asarray(own.encode(t or ""), dtype=np.int32) for t in texts]
        return [len(x) for x in ids], ids

    return over_column(with_id_column(docs), "text", work, "n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, data (binary): the bytes of each row's `ids`. Null ids give no bytes."""

    def work(packed):
        own = codec(path, pattern)
        return [[own.decode(np.frombuffer(x, ">i4").tolist()) for x in packed]]

    # ids travel as bytes (four for each, most significant first), so that batches can be cut by size
    packed = F.unhex(F.array_join(F.transform(F.coalesce("ids", F.array().cast("array<int>")), lambda i: F.lpad(F.hex(i), 8, "0")), ""))
    return over_column(encoded.select("doc_id", packed.alias("ids")), "ids", work, "data binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded, without moving either.

    ids_sha256 is of the ids as little-endian unsigned 32-bit integers, decoded_sha256 of the decoded bytes.
    """

    def work(texts):
        own, n, one, two = codec(path, pattern), [], [], []
        for text in texts:
            ids = own.encode(text or "")
            n.append(len(ids))
            one.append(hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest())
            two.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return n, one, two

    return over_column(with_id_column(docs), "text", work, "n_tokens long, ids_sha256 string, decoded_sha256 string")

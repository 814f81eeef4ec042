"""Secret scans with structural confirmation.

Base patterns find assignments, access keys and long hex runs. On top, encoded keys are looked for wherever their first bytes
can stand, whatever is left of them: those bytes (base64, base64url or hex, on one line or wrapped) tell how long the key
is, so many bytes are decoded, and a key is reported only if they are built like one: nested lengths of a DER private key
that fit exactly, the length-prefixed fields of an SSH private key, or the JSON header of a signed token with its three
parts. Public keys are no secrets.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import CHUNK_BYTES, bound_batches, fresh, over_column, with_id_column

#: The kinds in the order in which spans of equal start are listed. The first three are the base patterns.
KINDS = ("assign", "access", "hex", "pem", "der_key", "ssh_key", "signed_token")
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Line ends as strings of JSON and env files write them: a backslash (or more) and a letter.
ESCAPED_END = re.compile(r"\\+[nr]")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s,:-]|\\+[nr])*?)-----END \1-----")
#: Where an encoded key can begin: a DER sequence (0x30 and a length) or the name of the SSH container, with more of the same run behind.
STARTS64 = re.compile(r"M(?=[A-I][A-Za-z0-9+/_-]{18})|b(?=3BlbnNzaC1rZXktdjEA)")
STARTS16 = re.compile(r"3(?=0(?:8[123]|[0-7][0-9A-Fa-f])[0-9A-Fa-f]{16})|6(?=[Ff]70656[Ee]7373682[Dd]6[Bb]65792[Dd]763100)")
RUN64, RUN16 = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[0-9A-Fa-f]+")
#: What may stand between the lines of a wrapped key.
WRAP = re.compile(r"(?:[\r\n]|\\+[nr])+[\x20\t]*")
SSH_NAME = b"openssh-key-v1\0"
CHAIN = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+){2,}")
TOKEN_START = re.compile(r"e(?:yJ|yA|wo|wk|w0)")
_HEADER = re.compile(rb'\{\s*"[^"]{1,40}"\s*:')

_RUN = np.zeros(256, bool)
_RUN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_.=-"]] = True
_SHORTEST_RUN = 20


def der(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) items of a DER byte string if lengths fit it exactly, else None."""
    items, i = [], 0
    while i < len(data):
        if i + 2 > len(data):
            return None
        tag, size = data[i], data[i + 1]
        i += 2
        if size >= 0x80:
            width = size & 0x7F
            if not 1 <= width <= 4 or i + width > len(data):
                return None
            size = int.from_bytes(data[i : i + width], "big")
            if size < 0x80:
                return None
            i += width
        if i + size > len(data):
            return None
        items.append((tag, data[i : i + size]))
        i += size
    return items


def is_der_key(data: bytes) -> bool:
    """PKCS#1 (version and eight integers), SEC1 (version 1, octets) or PKCS#8 (version, algorithm, octets) private keys,
    and encrypted PKCS#8."""
    outer = der(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der(outer[0][1])
    if not inner:
        return False
    tags = [t for t, _ in inner]
    if tags[:9] == [0x02] * 9 and inner[0][1] in (b"\0", b"\1") and len(inner[1][1]) >= 32:
        return True
    if tags[:2] == [0x02, 0x04] and inner[0][1] == b"\1" and len(inner[1][1]) >= 16:
        return True
    named = lambda item: item[0] == 0x30 and bool(x := der(item[1])) and x[0][0] == 0x06
    if tags[:3] == [0x02, 0x30, 0x04] and inner[0][1] in (b"\0", b"\1") and named(inner[1]):
        return len(inner[2][1]) >= 16
    return tags == [0x30, 0x04] and named(inner[0]) and len(inner[1][1]) >= 32


def is_ssh_key(data: bytes) -> bool:
    """A private key in SSH's own container."""
    return data.startswith(SSH_NAME) and ssh_size(data) == len(data)


def ssh_size(data: bytes) -> int | None:
    """How long the container at the start of `data` is: its name; cipher, key derivation and its options; the number of keys,
    the public ones and the private part. None if a field runs over the end."""
    i = len(SSH_NAME)

    def skip(i: int) -> int:
        return i + 4 + int.from_bytes(data[i : i + 4], "big") if i + 4 <= len(data) else len(data) + 1

    for _ in range(3):
        i = skip(i)
    keys = int.from_bytes(data[i : i + 4], "big")
    if not 1 <= keys <= 64 or i + 4 > len(data):
        return None
    i += 4
    for _ in range(keys + 1):
        i = skip(i)
    return i if i <= len(data) and i > len(SSH_NAME) + 24 else None


def _ssh_begins(head: bytes) -> bool:
    """Whether the names of cipher and key derivation after the container's name are short, as all of them are."""
    i = len(SSH_NAME)
    for _ in range(2):
        size = int.from_bytes(head[i : i + 4], "big")
        if size > 64:
            return False
        i += 4 + size
        if i + 4 > len(head):
            break
    return True


def der_size(head: bytes) -> int | None:
    """How long the DER sequence is that begins with these bytes, if it can be a key: its first item is a version or a sequence."""
    if len(head) < 7 or head[0] != 0x30:
        return None
    width = head[1] & 0x7F if head[1] >= 0x80 else 0
    if width > 3:
        return None
    size = int.from_bytes(head[2 : 2 + width], "big") if width else head[1]
    first = head[2 + width : 5 + width]
    return 2 + width + size if first[:1] == b"\x30" or first in (b"\x02\x01\x00", b"\x02\x01\x01") else None


def decode_base64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(header: str, payload: str, signature: str, at: int = 0) -> bool:
    """A JSON object with a signing algorithm (in `header` from `at` on), then encoded bytes twice."""
    if len(header) - at < 10 or len(payload) < 2 or len(signature) < 10:
        return False
    start = decode_base64(header[at : at + 64])  # most of what looks like a header fails here, before all of it is decoded
    if not start or not _HEADER.match(start):
        return False
    data = decode_base64(header[at:])
    try:
        found = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return False
    return isinstance(found, dict) and isinstance(found.get("alg"), str) and bool(found["alg"]) and decode_base64(payload) is not None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of the base patterns; a match too short is dropped after matching."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def _gather(text: str, at: int, run: re.Pattern, wanted: int) -> tuple[str, list[tuple[int, int]]]:
    """Up to `wanted` characters of a run from a place on, over line ends, and the stretches of the text that they come from."""
    parts, spans, size = [], [], 0
    while size < wanted and (m := run.match(text, at, at + wanted - size)):
        stop = m.end()
        parts.append(text[at:stop])
        spans.append((at, stop))
        size += stop - at
        wrap = WRAP.match(text, stop) if size < wanted else None
        if not wrap:
            break
        at = wrap.end()
    return "".join(parts), spans


def _keys(text: str, starts: re.Pattern, run: re.Pattern, decode, unit: tuple[int, int], found: list[tuple[int, int, int]], inside: list[tuple[int, int]]) -> None:
    """Adds the keys that begin where `starts` matches, leftmost first and without overlaps. `unit`: characters for so many bytes."""
    characters, octets = unit
    free = 0
    for m in starts.finditer(text):
        at = m.start()
        if at < free or any(a <= at < b for a, b in inside):
            continue
        ssh = m[0][0] in "b6"
        if ssh:
            if not _ssh_begins(decode(_gather(text, at, run, 48 * characters // octets)[0]) or b""):
                continue
            wanted = len(text) - at
        else:
            head = decode(_gather(text, at, run, 9 * characters // octets)[0])
            size = der_size(head) if head else None
            if size is None:
                continue
            wanted = -(-size * characters // octets)
        own, spans = _gather(text, at, run, wanted)
        if ssh:
            data = decode(own[: len(own) - (len(own) % characters == 1)])
            size = ssh_size(data) if data else None
            if size is None:
                continue
            own, spans = _gather(text, at, run, -(-size * characters // octets))
        elif len(own) < wanted:
            continue
        data = decode(own)
        if not data or len(data) < size:
            continue
        kind = 4 if is_der_key(data[:size]) else 5 if is_ssh_key(data[:size]) else None
        if kind is not None:
            stop = spans[-1][1]
            if characters == 4:
                stop += len(re.match("={0,2}", text[stop : stop + 2])[0])
            found.append((at, kind, stop))
            free = stop


def _hex_bytes(text: str) -> bytes:
    return bytes.fromhex(text[: len(text) // 2 * 2])


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of encoded keys and tokens whose structure holds. Lines of a wrapped key have 20 characters at least (but the last)."""
    found: list[tuple[int, int, int]] = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            lines = ESCAPED_END.sub("\n", m[2])
            body = decode_base64(re.sub(r"\s+", "", re.sub(r"^[\w-]+:.*$", "", lines, flags=re.MULTILINE)))
            if body and ("ENCRYPTED" in m[1] or "Proc-Type" in m[2] or is_der_key(body) or is_ssh_key(body)):
                found.append((m.start(), 3, m.end()))
    inside = [(a, b) for a, _, b in found]
    _keys(text, STARTS64, RUN64, decode_base64, (4, 3), found, inside)
    _keys(text, STARTS16, RUN16, _hex_bytes, (2, 1), found, inside)
    if "." in text:
        for m in CHAIN.finditer(text):
            parts, at, k = m[0].split("."), m.start(), 0
            while k + 2 < len(parts):
                start = next((x.start() for x in TOKEN_START.finditer(parts[k]) if is_signed_token(parts[k], parts[k + 1], parts[k + 2], x.start())), None)
                width = 3 if start is not None else 1
                if start is not None:
                    found.append((at + start, 6, at + sum(map(len, parts[k : k + 3])) + 2))
                at += sum(map(len, parts[k : k + width])) + width
                k += width
    return found


def _has_run(texts: list[str]) -> np.ndarray:
    """Which texts hold a run long enough for any pattern but assignments: one pass over the bytes of all of them."""
    encoded = [t.encode("utf-8") for t in texts]
    data = _RUN[np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)]
    edge = np.flatnonzero(np.diff(data, prepend=False))
    starts, stops = edge[0::2], edge[1::2]
    starts = starts[stops - starts >= _SHORTEST_RUN]
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in encoded), np.int64, len(encoded)))
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(ends, starts, side="right")] = True
    return out


def scan_texts(texts) -> list[list[tuple[int, int, int]]]:
    """The spans of each text, ordered by start and then by kind. Texts without any long run skip the patterns that need one."""
    texts = [t if isinstance(t, str) else "" for t in texts]
    out: list[list[tuple[int, int, int]]] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK_BYTES):
            size += len(texts[j])
            j += 1
        for text, run in zip(texts[i:j], _has_run(texts[i:j]), strict=True):
            if run or "-----BEGIN " in text:
                spans = base_spans(text) + confirmed_spans(text)
            elif "=" in text or ":" in text:
                spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
            else:
                spans = []
            out.append(sorted(spans))
        i = j
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{stop}" for start, kind, stop in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, stop in code points; stop exclusive) for each row.

    Null and empty texts have no spans. doc_id may be null or repeat; other columns are ignored.
    """
    work = lambda texts: [[[{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in found] for found in scan_texts(texts)]]
    return over_column(with_id_column(docs), "text", work, "spans array<struct<kind: string, start: int, stop: int>>")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (string): the digest of `scan`, one row for each row."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")
    return scan(docs).select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(F.encode(text(F.filter("spans", lambda s: s.kind.isin(*BASE_KINDS))), "UTF-8"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
    )


def _cut(text: str, spans) -> str:
    parts, at = [], 0
    for start, _, stop in spans:
        if start >= at:
            parts += [text[at:start], "[SECRET]"]
        at = max(at, stop)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span of its text replaced by [SECRET] (overlapping spans by one), and n_chars counted again where
    a text changed. Columns and rows stay; texts without secrets are untouched. Only texts go to Python."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        own = texts.tolist()
        return pd.Series([_cut(t, spans) if spans else None for t, spans in zip(own, scan_texts(own), strict=True)], dtype=object)

    (name,) = fresh(docs, "clean")
    found = docs.withColumn(name, clean(F.col("text").cast("string")))  # null: nothing to cut
    kinds = dict(docs.dtypes)
    new = {"text": F.coalesce(F.col(name), F.col("text").cast("string")).cast(kinds["text"])}
    if "n_chars" in kinds:
        new["n_chars"] = F.when(F.col(name).isNotNull(), F.char_length(name).cast(kinds["n_chars"])).otherwise(F.col("n_chars"))
    return found.withColumns(new).select(*docs.columns)

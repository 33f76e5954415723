"""Secret scans with structural confirmation.

Plain patterns find named values, access ids and hex runs. Longer candidates of base64 or hex are decoded and reported
only where their bytes have the structure of key material: DER private keys with exact nested lengths (RSA, DSA, EC,
PKCS#8 and encrypted PKCS#8), OpenSSH private key containers with length-prefixed fields, armoured keys with or without
headers, also encoded once more, and signed tokens whose header and claims are JSON objects. A candidate that isn't
a key as a whole is tried again between its separators, and with the lines that it goes on in.

A text is scanned whole, inside one task, in Arrow batches, in time linear in its length. Offsets are code points, ends
exclusive.

Defined results: a null or empty text has no spans. Repeated rows are scanned alike. Columns named ``spans`` are
replaced, all others stay. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in the order of their report; the first three are the base patterns.
KINDS = ("assign", "access", "hex", "pem_key", "der_key", "ssh_key", "signed_token")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Maximal runs; a shorter run than 16 never counts, so only runs of 16 or more are matched.
_HEX = re.compile(r"[0-9a-f]{16,}")
_PEM_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ ){0,4}PRIVATE KEY)-----")
_PEM_HEADER = re.compile(r"[ \t]*([A-Za-z][A-Za-z0-9-]*):[ \t]*(.*)")
_PEM_BREAK = re.compile(r"\\r\\n|\\n|\r\n|\n|\r")
_CIPHER = re.compile(r"[A-Z0-9-]+,([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_SHORT_BASE64 = re.compile(r"[A-Za-z0-9+/]+={0,2}")
_LINE_BREAK = re.compile(r"[ \t]{0,64}\r?\n[ \t]{0,64}")
_BETWEEN_SEPARATORS = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
_LONG_HEX = re.compile(r"[0-9A-Fa-f]{64,}")
_TOKEN_CLAIMS = re.compile(r"\.(?=eyJ[A-Za-z0-9_-]+\.)")
_TOKEN_WORD = re.compile(r"[A-Za-z0-9_-]*")
_SSH_MAGIC = b"openssh-key-v1\x00"
_ARMOUR = b"-----BEGIN "
# The arcs of password-based encryption schemes (PKCS#5 and PKCS#12), as encoded identifiers.
_ENCRYPTION_ARCS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))

_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30


def from_base64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not; None where it is neither."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """``(tag, start, end)`` of the values that fill ``data[start:end]`` exactly; None where lengths don't fit."""
    items, at = [], start
    while at < end:
        if at + 2 > end:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            count = size & 0x7F
            if not 1 <= count <= 4 or at + count > end:
                return None
            size, at = int.from_bytes(data[at : at + count], "big"), at + count
        if at + size > end:
            return None
        items.append((tag, at, at + size))
        at += size
    return items


def is_der_key(data: bytes) -> bool:
    """A private key of one of the common shapes, its nested lengths exact."""
    if data[0] != _SEQUENCE:
        return False
    outer = der_items(data, 0, len(data))
    if not outer or len(outer) != 1:
        return False
    inner = der_items(data, outer[0][1], outer[0][2])
    if not inner:
        return False
    tags = [x[0] for x in inner]
    if tags == [_SEQUENCE, _OCTETS]:
        # An encrypted key; digests have the same outline, so the scheme must be one that encrypts.
        scheme = der_items(data, inner[0][1], inner[0][2])
        return bool(scheme) and scheme[0][0] == _OID and data[scheme[0][1] : scheme[0][2]].startswith(_ENCRYPTION_ARCS) and inner[1][2] - inner[1][1] >= 16
    if inner[0][0] != _INTEGER or inner[0][2] - inner[0][1] != 1:
        return False
    version = data[inner[0][1]]
    if tags == [_INTEGER] * 6 and version == 0:
        return True
    if len(inner) >= 9 and version in (0, 1) and all(t == _INTEGER for t in tags[:9]):
        return True
    if version in (0, 1) and tags[1:3] == [_SEQUENCE, _OCTETS]:
        algorithm = der_items(data, inner[1][1], inner[1][2])
        return bool(algorithm) and algorithm[0][0] == _OID and inner[2][2] > inner[2][1]
    return version == 1 and tags[1:2] == [_OCTETS] and len(inner) >= 2 and inner[1][2] - inner[1][1] >= 16


def is_ssh_key(data: bytes) -> bool:
    """The OpenSSH container: magic, three names, a key count and as many public blobs, then the private part."""
    if not data.startswith(_SSH_MAGIC):
        return False
    at, left = len(_SSH_MAGIC), 3
    keys = None
    while left:
        if at + 4 > len(data):
            return False
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4 + size
        if at > len(data):
            return False
        left -= 1
        if not left and keys is None:
            keys = int.from_bytes(data[at : at + 4], "big")
            at += 4
            if not 1 <= keys <= len(data) // 4:
                return False
            left = keys + 1  # public blobs and the private part
    return at == len(data)


def is_signed_token(text: str) -> bool:
    head, claims, _ = text.split(".")
    parts = []
    for part in (head, claims):
        data = from_base64(part)
        try:
            parts.append(json.loads(data.decode("utf-8")) if data is not None else None)
        except (ValueError, RecursionError):
            return False
    return all(isinstance(p, dict) for p in parts) and isinstance(parts[0].get("alg"), str)


def _is_key(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der_key" if is_der_key(data) else "ssh_key" if is_ssh_key(data) else None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def is_armoured_key(body: str) -> bool:
    """Whether what stands between an armour's lines is a key: base64 of one, or an encrypted one with its cipher's header."""
    lines = [x.strip() for x in _PEM_BREAK.split(body)]
    headers = {}
    at = 0
    while at < len(lines) and (not lines[at] or (found := _PEM_HEADER.fullmatch(lines[at]))):
        if lines[at]:
            headers[found[1].lower()] = found[2].strip()
        at += 1
    data = from_base64("".join("".join(lines[at:]).split()))
    if not data:
        return False
    if headers.get("proc-type", "").endswith("ENCRYPTED"):
        cipher = _CIPHER.fullmatch(headers.get("dek-info", ""))
        return bool(cipher) and len(data) >= 16 and len(data) % (len(cipher[1]) // 2) == 0
    return _is_key(data) is not None


def armoured_spans(text: str) -> list[tuple[int, int]]:
    """Places of armoured private keys. No body holds five hyphens, so each search ends at the next of them."""
    out = []
    for m in _PEM_BEGIN.finditer(text):
        end = text.find("-----", m.end())
        close = f"-----END {m[1]}-----"
        if end >= 0 and text.startswith(close, end) and is_armoured_key(text[m.end() : end]):
            out.append((m.start(), end + len(close)))
    return out


def token_spans(text: str) -> list[tuple[int, int]]:
    """Places of signed tokens, found from the dot in front of their claims so that no run is read for each of its letters."""
    out, past, before = [], 0, 0
    for dot in [m.start() for m in _TOKEN_CLAIMS.finditer(text)]:
        # What stands between two dots is read once, from its end.
        behind = text[max(past, before) : dot][::-1]
        before = dot + 1
        start = text.find("eyJ", dot - _TOKEN_WORD.match(behind).end(), dot)
        if start < 0 or dot - start < 4:
            continue
        claims = _TOKEN_WORD.match(text, dot + 1).end()
        end = _TOKEN_WORD.match(text, claims + 1).end()
        if is_signed_token(text[start:end]):
            out.append((start, end))
            past = end
    return out


def _key_kind(data: bytes | None) -> str | None:
    """The kind of a decoded candidate; an armoured key that was encoded once more counts as armoured."""
    kind = _is_key(data)
    if kind is None and data and data.startswith(_ARMOUR) and armoured_spans(data.decode("latin-1")):
        return "pem_key"
    return kind


def _wrapped(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """``(start, end, joined)`` of runs of one width on lines that follow each other, without and with a shorter last line."""
    at = 0
    while at < len(runs):
        start, end = runs[at]
        width, parts = end - start, [text[start:end]]
        at += 1
        while gap := _LINE_BREAK.match(text, end):
            if at == len(runs) or runs[at] != (gap.end(), gap.end() + width):
                break
            end = runs[at][1]
            parts.append(text[gap.end() : end])
            at += 1
        joined = "".join(parts)
        if len(parts) > 1:
            yield start, end, joined
        last = _SHORT_BASE64.match(text, gap.end(), gap.end() + width) if gap and not joined.endswith("=") else None
        if last:
            yield start, last.end(), joined + last[0]


def _behind_slash(text: str, start: int, end: int) -> int | None:
    """The first place behind a slash from which a DER sequence fills the candidate exactly, by what its length says."""
    body = len(text[start:end].rstrip("="))
    at = text.find("/", start, end) + 1
    while at and body - (at - start) >= 40:
        head = base64.b64decode(text[at : at + 8]) if text.startswith("M", at) else b""
        if head[:1] == bytes([_SEQUENCE]):
            count = head[1] & 0x7F if head[1] & 0x80 else 0
            size = 2 + count + (int.from_bytes(head[2 : 2 + count], "big") if count else head[1])
            if count <= 4 and size == (body - (at - start)) * 3 // 4:
                return at
        at = text.find("/", at, end) + 1
    return None


class _Taken:
    """Places reported so far, as sorted intervals that don't overlap."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(end, self.ends[-1])
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        at = bisect_right(self.ends, start)
        return at < len(self.starts) and self.starts[at] < end


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "PRIVATE KEY-----" in text:
        out += [("pem_key", *x) for x in armoured_spans(text)]
    if "eyJ" in text:
        out += [("signed_token", *x) for x in token_spans(text)]
    taken = _Taken([x[1:] for x in out])
    found, rest = [], []
    runs = [m.span() for m in _BASE64.finditer(text)]
    for start, end in runs:
        if taken.meets(start, end):
            continue
        kind = _key_kind(from_base64(text[start:end]))
        if kind:
            found.append((kind, start, end))
        else:
            rest.append((start, end))
    several = []
    for start, end, joined in _wrapped(text, rest):
        kind = _key_kind(from_base64(joined))
        if kind and not taken.meets(start, end):
            several.append((kind, start, end))
    found += several
    keys = _Taken([x[1:] for x in several])
    for start, end in rest:
        if keys.meets(start, end):
            continue
        for m in _BETWEEN_SEPARATORS.finditer(text, start, end):
            at, kind = m.start(), None
            if m.span() != (start, end):
                kind = _key_kind(from_base64(m[0]))
            if not kind and (at := _behind_slash(text, *m.span())):
                kind = _key_kind(from_base64(text[at : m.end()]))
            if kind:
                found.append((kind, at, m.end()))
    for m in _LONG_HEX.finditer(text):
        kind = None if taken.meets(*m.span()) else _is_key(_from_hex(m[0]))
        if kind:
            found.append((kind, *m.span()))
    return out + found


def _from_hex(text: str) -> bytes | None:
    return bytes.fromhex(text) if len(text) % 2 == 0 else None


def scan_text(text: str) -> list[tuple[str, int, int]]:
    spans = base_spans(text) + confirmed_spans(text)
    return sorted(set(spans), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end) by start, then kind in report order."""

    @F.pandas_udf("array<struct<kind: string, start: long, end: long>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end"), s)) for s in scan_text(t or "")] for t in texts])

    return docs.drop("spans").withColumn("spans", spans(F.col(f"`{text}`")))


def rendered(spans, kinds=KINDS):
    """``kind:start:end`` of the given kinds, comma-joined in order."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(
        F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def counted(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

"""Operator 9: secret scan with structural confirmation of encoded candidates."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieline.llm.common import table

#: Order of kinds among spans that start together: the three base kinds, then the confirmed ones.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")

# The base patterns and their shortest lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ASSIGN_VALUE = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----((?:\s*(?:Proc-Type|DEK-Info|Version|Comment):[^\r\n]*)*)([A-Za-z0-9+/=\s]+)-----END \1-----")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
LONG_HEX = re.compile(r"[0-9a-fA-F]{48,}")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{4,})\.([A-Za-z0-9_-]*)")
SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521", b"sk-ssh-ed25519@openssh.com", b"sk-ecdsa-sha2-nistp256@openssh.com")
OPENSSH = b"openssh-key-v1\0"

#: No candidate but an assignment is shorter than this, so a text whose words are all shorter has none.
SHORTEST = 20


def decode64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padding optional; None if it isn't valid."""
    body = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_item(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the contents of the DER element at ``at``; None if its length does not fit."""
    if at + 2 > len(data):
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > len(data):
            return None
        size, at = int.from_bytes(data[at: at + n], "big"), at + n
    return (tag, at, at + size) if at + size <= len(data) else None


def der_children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill data[start:end] exactly, or None."""
    out = []
    while start < end:
        item = der_item(data, start)
        if item is None or item[2] > end:
            return None
        out.append(item)
        start = item[2]
    return out


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE that spans all bytes and has the inner shape of a key (PKCS#1, SEC 1, PKCS#8 plain or encrypted, or SubjectPublicKeyInfo)."""
    top = der_item(data, 0)
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = der_children(data, top[1], top[2])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    if len(parts) >= 9 and set(tags[:9]) == {0x02} and parts[0][2] - parts[0][1] == 1:
        return True  # RSA private key: version and eight numbers
    if len(parts) == 2 and tags == [0x02, 0x02]:
        return parts[0][2] - parts[0][1] >= 32 and parts[1][2] - parts[1][1] <= 8  # RSA public key
    if tags[:2] == [0x02, 0x04] and data[parts[0][1]: parts[0][2]] == b"\x01":
        return parts[1][2] - parts[1][1] >= 16  # EC private key
    # Algorithm, then the key as bit string, or encrypted as octet string; or version, algorithm, octet string.
    for k, last in ((0, 0x03), (0, 0x04), (1, 0x04)):
        if (k, last) == (0, 0x04) and (len(parts) != 2 or parts[-1][2] - parts[-1][1] < 16):
            continue
        if len(parts) > k + 1 and tags[k] == 0x30 and tags[k + 1] == last and (k == 0 or tags[0] == 0x02):
            algorithm = der_children(data, parts[k][1], parts[k][2])
            return bool(algorithm) and algorithm[0][0] == 0x06
    return False


def is_cipher_text(headers: str, data: bytes) -> bool:
    """The body of an armoured block whose headers say that it is encrypted: whole cipher blocks, whatever they hold."""
    cipher = re.search(r"DEK-Info:\s*([A-Z0-9-]+),\s*([0-9A-Fa-f]+)", headers)
    return "ENCRYPTED" in headers and cipher is not None and len(data) >= 64 and len(data) % (8 if "DES" in cipher[1] else 16) == 0


def ssh_strings(data: bytes, at: int) -> list[bytes] | None:
    """Length-prefixed strings that fill the rest of ``data`` exactly, or None."""
    out = []
    while at < len(data):
        size = int.from_bytes(data[at: at + 4], "big")
        if at + 4 + size > len(data):
            return None
        out.append(data[at + 4: at + 4 + size])
        at += 4 + size
    return out


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key, or a public key blob whose nested lengths fill it."""
    if data.startswith(OPENSSH):
        at = len(OPENSSH)
        for _ in range(3):  # cipher, key derivation and its options
            size = int.from_bytes(data[at: at + 4], "big")
            at += 4 + size
        return at + 4 <= len(data) and 1 <= int.from_bytes(data[at: at + 4], "big") <= 64
    parts = ssh_strings(data, 0) if len(data) >= 40 else None
    return bool(parts) and len(parts) >= 2 and parts[0] in SSH_TYPES


def is_jwt(header: str, payload: str) -> bool:
    """A signed-token header (a JSON object that names its algorithm) before a JSON object."""
    found = []
    for part in (header, payload):
        raw = decode64(part)
        try:
            found.append(json.loads(raw.decode("utf-8")) if raw is not None else None)
        except (ValueError, RecursionError):
            found.append(None)
    return isinstance(found[0], dict) and isinstance(found[0].get("alg"), str) and isinstance(found[1], dict)


def base_spans(text: str, long_words: bool = True) -> list[tuple[str, int, int]]:
    out = []
    if ":" in text or "=" in text:
        low = text.lower()
        if any(w in low for w in ASSIGN_WORDS):
            out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if long_words:
        if "AKIA" in text:
            out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates whose decoded bytes parse as a key or a signed token."""
    out = []
    for m in PEM.finditer(text) if "-----BEGIN" in text else ():
        raw = decode64(m[3])
        if raw is not None and (is_der_key(raw) or is_ssh_key(raw) or is_cipher_text(m[2], raw)):
            out.append(("pem", m.start(), m.end()))
    for m in JWT.finditer(text):
        if is_jwt(m[1], m[2]):
            out.append(("jwt", m.start(), m.end()))
    for m in BASE64.finditer(text):
        raw = decode64(m[0])
        if raw is not None:
            if is_der_key(raw):
                out.append(("der", m.start(), m.end()))
            elif is_ssh_key(raw):
                out.append(("ssh", m.start(), m.end()))
    for m in LONG_HEX.finditer(text):
        if len(m[0]) % 2 == 0:
            raw = bytes.fromhex(m[0])
            if is_der_key(raw):
                out.append(("der", m.start(), m.end()))
            elif is_ssh_key(raw):
                out.append(("ssh", m.start(), m.end()))
    return out


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text, ordered by start and kind."""
    if not text:
        return []
    long_words = "-----BEGIN" in text or max(map(len, text.split()), default=0) >= SHORTEST
    found = base_spans(text, long_words)
    return ordered(found + confirmed_spans(text)) if long_words else ordered(found)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan_batches(text: str, passed: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t)] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), pa.array(found, _SPANS)], names=[*passed, "secrets"])

    return run


def find_secrets(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``secrets``: array of (kind, start, end), code points, end exclusive, by start and kind.

    Base kinds: assign (a credential word given a value of 6 or more characters), access (AKIA and 16 or more), hex
    (24 or more lower-case hex digits). Confirmed kinds are reported only if their decoded bytes parse: pem (an
    armoured block), der (base64 or hex of a DER key), ssh (OpenSSH key encodings), jwt (a token with a JSON header
    that names its algorithm). Overlapping spans of different kinds all stay. Null and empty texts have no spans; each
    row is scanned by itself, so repeated rows are equal and an empty table stays empty. A ``secrets`` column of the
    input is replaced, others pass through (the text too unless keep_text is false).
    """
    passed = [c for c in docs.columns if c != "secrets" and (keep_text or c != text)]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*passed).schema)
    source = docs.select(*passed, *([] if text in passed else [text]))
    return source.mapInArrow(_scan_batches(text, passed), fields + ", secrets array<struct<kind: string, start: bigint, end: bigint>>")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, as counts, a digest of the base spans, and all spans."""
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"),
    )


def base_digest(text: str) -> str:
    return hashlib.sha256(joined(ordered(base_spans(text))).encode()).hexdigest()

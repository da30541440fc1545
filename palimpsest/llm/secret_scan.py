"""Secret scans: patterns, and candidates that are reported only if their structure holds when decoded.

Kinds, in this order: assign, access and hex are patterns; jwt, ssh, pem and der are confirmed by structure:
a signed token's header and claims must be JSON and its signature as long as its algorithm asks, a key's length-prefixed
fields must fill it exactly, and the nested lengths of a DER sequence must add up on each level.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import missing

KINDS = ["assign", "access", "hex", "jwt", "ssh", "pem", "der"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # the run from the first AKIA in it, if it is long enough
HEX = re.compile(r"[0-9a-f]{16,}")
#: What may be encoded: a long run, dots of signed tokens included.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\.[A-Za-z0-9_-]+){0,2}={0,2}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*(?:KEY|CERTIFICATE))-----([A-Za-z0-9+/=\s]{16,}?)-----END \1-----")
#: Bytes of a signature by the algorithm in a signed token's header: (least, most).
SIGNATURES = {"HS256": (32, 32), "HS384": (48, 48), "HS512": (64, 64), "ES256": (64, 64), "ES384": (96, 96), "ES512": (132, 132), "EdDSA": (64, 114), "RS256": (128, 1024), "RS384": (128, 1024), "RS512": (128, 1024), "PS256": (128, 1024), "PS384": (128, 1024), "PS512": (128, 1024)}
SSH_TYPES = re.compile(rb"ssh-(rsa|dss|ed25519)|ecdsa-sha2-nistp\d+|sk-[a-z0-9@.-]+")
DEPTH = 12
#: Where in a run something encoded may begin that touches a word before it: what DER, SSH keys and headers of signed tokens begin with.
STARTS = re.compile(r"(?:(?<=[/_-])|(?<=0x))(?=M|AAAA|b3BlbnNza|e[yw]|30)")
#: Characters of a signed token's header, at most, where a word touches it.
HEADER = 4096


def decoded(run: str) -> bytes | None:
    """Base64, plain or for URLs, with or without padding."""
    try:
        return base64.b64decode(run.rstrip("=").replace("-", "+").replace("_", "/") + "=" * (-len(run.rstrip("=")) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_der(data: bytes, depth: int = 0) -> bool:
    """One SEQUENCE that fills the bytes, whose elements' lengths add up on each level, with an integer or an object id in it."""
    return len(data) >= 16 and data[0] == 0x30 and _elements(data, depth) == 1 and _has_number(data)


def _elements(data: bytes, depth: int) -> int:
    """Number of DER elements that fill the bytes exactly; 0 if they don't."""
    at, n = 0, 0
    while at < len(data):
        if at + 2 > len(data) or data[at] in (0x00, 0xFF):
            return 0
        tag, size, head = data[at], data[at + 1], 2
        if size & 0x80:
            extra = size & 0x7F
            if not 1 <= extra <= 4 or at + 2 + extra > len(data):
                return 0
            size, head = int.from_bytes(data[at + 2 : at + 2 + extra], "big"), 2 + extra
            if size < 0x80:
                return 0  # the short form is due
        if at + head + size > len(data):
            return 0
        if tag & 0x20 and size and (depth >= DEPTH or not _elements(data[at + head : at + head + size], depth + 1)):
            return 0
        at, n = at + head + size, n + 1
    return n


def _has_number(data: bytes) -> bool:
    head = 2 + (data[1] & 0x7F if data[1] & 0x80 else 0)
    return len(data) > head and (data[head] in (0x02, 0x06) or data[head] == 0x30 and _has_number(data[head:]))


def is_ssh(data: bytes) -> bool:
    """A key in the SSH wire form: length-prefixed fields that fill it, the first naming a key type; or a private key file's body."""
    if data.startswith(b"openssh-key-v1\0"):
        return _fields(data[15:], 3, False) >= 3
    if len(data) < 8 or int.from_bytes(data[:4], "big") > 64:
        return False
    return SSH_TYPES.fullmatch(data[4 : 4 + int.from_bytes(data[:4], "big")]) is not None and _fields(data, 1 << 20, True) >= 2


def _fields(data: bytes, most: int, whole: bool) -> int:
    at = n = 0
    while at + 4 <= len(data) and n < most:
        at, n = at + 4 + int.from_bytes(data[at : at + 4], "big"), n + 1
        if at > len(data):
            return 0
    return n if at == len(data) or not whole else 0


def is_signed_token(run: str) -> bool:
    parts = run.rstrip("=").split(".")
    if len(parts) != 3:
        return False
    try:
        header, claims = (json.loads(decoded(p) or b"-") for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    if not (isinstance(header, dict) and isinstance(claims, dict)):
        return False
    least, most = SIGNATURES.get(header.get("alg") if isinstance(header.get("alg"), str) else "", (1 << 30, 0))
    return least <= len(decoded(parts[2]) or b"") <= most


def structure(run: str) -> str | None:
    """The kind of a candidate, or None."""
    if "." in run:
        return "jwt" if is_signed_token(run) else None
    raw = bytes.fromhex(run) if len(run) % 2 == 0 and len(run) >= 32 and re.fullmatch(r"[0-9a-fA-F]+", run) else None
    for data in (raw, decoded(run)):
        if data and is_ssh(data):
            return "ssh"
        if data and is_der(data):
            return "der"
    return None


def may_begin(run: str, at: int, end: int) -> bool:
    """Whether something encoded that fills ``run`` up to ``end`` may begin at ``at``, told from a few characters there."""
    if run[at] == "e":
        return at < run.find(".") <= at + HEADER
    if run[at] in "Ab":
        return is_ssh_head(decoded(run[at : min(end, at + 92)]) or b"")
    heads = [(decoded(run[at : at + 8]), (end - at) * 3 // 4)]
    if run.startswith("30", at) and (end - at) % 2 == 0:
        heads.append((bytes.fromhex(run[at : at + 12]) if re.match("[0-9a-fA-F]{12}", run[at : at + 12]) else None, (end - at) // 2))
    return any(head and len(head) == 6 and head[0] == 0x30 and der_size(head) == size for head, size in heads)


def der_size(head: bytes) -> int:
    """Bytes of the element whose first six are given, its head included; 0 if there's no such element."""
    if not head[1] & 0x80:
        return 2 + head[1]
    extra = head[1] & 0x7F
    return 2 + extra + int.from_bytes(head[2 : 2 + extra], "big") if 1 <= extra <= 4 else 0


def is_ssh_head(data: bytes) -> bool:
    return data.startswith(b"openssh-key-v1\0") or SSH_TYPES.match(data[4:]) is not None


def confirmed(run: str) -> tuple[int, str] | None:
    """Where something encoded begins in a candidate, and its kind: at its start, or else at the first place after a ``/``, ``-``, ``_`` or ``0x``."""
    if kind := structure(run):
        return 0, kind
    end = len(run.rstrip("="))
    for m in STARTS.finditer(run):
        if end - m.start() >= 16 and may_begin(run, m.start(), end) and (kind := structure(run[m.start() :])):
            return m.start(), kind
    return None


def find(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind's number, end) of the pattern spans, and of those confirmed by structure; code points, end exclusive."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if "=" in text or ":" in text else []
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    more, pems = [], []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            data = decoded("".join(m[2].split()))
            if data and (is_der(data) or is_ssh(data)):
                more.append((m.start(), 5, m.end()))
                pems.append((m.start(), m.end()))
    passed = 0
    for m in RUN.finditer(text):
        while passed < len(pems) and pems[passed][1] <= m.start():
            passed += 1  # both come in order
        if passed < len(pems) and pems[passed][0] <= m.start():
            continue
        if found := confirmed(m[0]):
            more.append((m.start() + found[0], KINDS.index(found[1]), m.end()))
    return sorted(base), sorted(more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """The secrets of each document: doc_id, counts by kind, base_sha256 (of the pattern spans), spans (all, by start, then kind).

    Whole texts, very long ones too, a row for each row of ``docs``. Null text: as empty, without spans. Null doc_id: stays null.
    Rows that repeat: scanned each. Spans of one start go by kind. An empty table gives no rows. Other columns aren't read,
    whatever they are called. Nothing is shuffled: a task scans the rows that it reads.
    """
    missing(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    base, more = find(text or "")
                    kinds = [k for _, k, _ in base]
                    rows.append((doc_id, kinds.count(0), kinds.count(1), kinds.count(2), len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more))))
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, mark: str = "<{}>") -> DataFrame:
    """``docs`` with each secret replaced by its kind; of spans that overlap, the union goes under the first one's kind.

    Null texts stay null, empty ones empty; rows that repeat are treated alike, and all columns stay, whatever they are called. Very
    long texts are as others. An empty table gives none.
    """
    missing(docs, "text")
    at = docs.columns.index("text")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else redacted(t, mark) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, schema)


def redacted(text: str, mark: str = "<{}>") -> str:
    base, more = find(text)
    out, done = [], 0
    spans: list[list[int]] = []
    for a, k, z in sorted(base + more):
        if spans and a < spans[-1][2]:
            spans[-1][2] = max(spans[-1][2], z)
        else:
            spans.append([a, k, z])
    for a, k, z in spans:
        out += [text[done:a], mark.format(KINDS[k])]
        done = z
    return "".join(out) + text[done:]

"""Secret scans: patterns propose candidates, decoding and parsing confirm them.

Base kinds are plain patterns. The structural kinds are reported only when their
bytes parse: `pem` (base64 between private-key armour lines decodes to one DER
element whose nested lengths add up), `der` (such an element of 30 bytes or more in a run of
base64, which may be wrapped over lines, or of hex; every place in the run may be its start, and
its own header says where it ends), `ssh` (length-prefixed fields whose first names the key type), `jwt`
(a header that decodes to JSON with an algorithm, a JSON payload and a signature).

Defined results: a null text is empty and has no spans; structural spans may overlap base
ones, but an element found in armour, or inside another one, is not given again; offsets are code points, the
end exclusive; repeated rows give repeated results; other columns are not read; an
empty table gives an empty result. A text is searched whole, however long.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession

from . import text as T
from .common import arrow_schema, id_and_text, map_batches, table

#: The base patterns and the shortest match each keeps.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: The order of kinds among spans with the same start.
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")

_assign = re.compile(ASSIGN, re.ASCII)
_access = re.compile(ACCESS)
_hex = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)  # the same runs: a maximal run of fewer characters fails anyway
_pem = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
_ssh = re.compile(r"(?:ssh-(?:rsa|ed25519|dss)|ecdsa-sha2-nistp\d+) (AAAA[A-Za-z0-9+/]+=*)")
_jwt = re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
_b64 = re.compile(r"[A-Za-z0-9+/]{20,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/]+)*")
_sequence64 = re.compile(r"(?=M[A-P])")  # base64 of a sequence's tag, 0x30, begins so
_hexrun = re.compile(r"[0-9a-fA-F]{60,}")
_sequence16 = re.compile(r"(?=30)")
_blanks = re.compile(r"\s+")
#: The least bytes of a key, tag and length included.
MIN_KEY = 30


def decode64(x: str, url: bool = False) -> bytes | None:
    x = re.sub(r"\s", "", x).rstrip("=")
    if len(x) % 4 == 1:
        return None
    try:
        return (base64.urlsafe_b64decode if url else base64.b64decode)(x + "=" * (-len(x) % 4))
    except (binascii.Error, ValueError):
        return None


def der_children(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) elements that fill data exactly, or None if their lengths don't add up."""
    out, i = [], 0
    while i < len(data):
        if i + 2 > len(data):
            return None
        tag, n, i = data[i], data[i + 1], i + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or i + k > len(data):
                return None
            n, i = int.from_bytes(data[i : i + k], "big"), i + k
        if i + n > len(data):
            return None
        out.append((tag, data[i : i + n]))
        i += n
    return out


def is_der_key(data: bytes | None) -> bool:
    """One sequence of two or more elements, an integer or a sequence first, with lengths that fit on all levels."""
    if not data or data[0] != 0x30:
        return False
    top = der_children(data)
    if not top or len(top) != 1:
        return False
    inner = der_children(top[0][1])
    if not inner or len(inner) < 2 or inner[0][0] not in (0x02, 0x30):
        return False
    todo = [c for t, c in inner if t & 0x20]  # constructed: it holds elements itself
    while todo:
        some = der_children(todo.pop())
        if some is None:
            return False
        todo += [c for t, c in some if t & 0x20]
    return True


def der_size(head: bytes) -> int | None:
    """Bytes of the element that begins here, tag and length included, if its first child can be a key's."""
    if len(head) < 3 or head[0] != 0x30:
        return None
    n, at = head[1], 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or len(head) < 3 + k:
            return None
        n, at = int.from_bytes(head[2 : 2 + k], "big"), 2 + k
    return at + n if head[at] in (0x02, 0x30) else None


def find_der(x: str) -> list[tuple[int, int]]:
    """Spans of the DER keys in base64 and hex runs."""
    out = []
    for m in _b64.finditer(x):
        run, at = m[0], 0
        if "M" not in run:
            continue
        gaps = [g.span() for g in _blanks.finditer(run)]
        run = _blanks.sub("", run) if gaps else run
        if len(run) * 3 < MIN_KEY * 4:
            continue

        def place(k, gaps=gaps, begin=m.start()):  # of a character of the run without blanks
            for a, z in gaps:
                if a > k:
                    break
                k += z - a
            return begin + k

        for s in _sequence64.finditer(run):
            i = s.start()
            if i < at:
                continue
            size = der_size(decode64(run[i : i + 12]) or b"")
            chars = -(-4 * (size or 0) // 3)
            if size is None or size < MIN_KEY or i + chars > len(run):
                continue
            key = decode64(run[i : i + chars])
            if key and is_der_key(key[:size]):
                at, end = i + chars, place(i + chars - 1) + 1
                while end < len(x) and x[end] == "=" and (end - place(i + chars - 1) - 1) < -chars % 4:
                    end += 1
                out.append((place(i), end))
    for m in _hexrun.finditer(x):
        run, at = m[0], 0
        for s in _sequence16.finditer(run):
            i = s.start()
            if i < at:
                continue
            head = run[i : i + 16]
            size = der_size(bytes.fromhex(head[: len(head) // 2 * 2]))
            if size is not None and size >= MIN_KEY and i + 2 * size <= len(run) and is_der_key(bytes.fromhex(run[i : i + 2 * size])):
                at = i + 2 * size
                out.append((m.start() + i, m.start() + at))
    return out


def ssh_fields(data: bytes | None) -> list[bytes] | None:
    out, i = [], 0
    while data and i < len(data):
        n = int.from_bytes(data[i : i + 4], "big")
        if i + 4 + n > len(data) or i + 4 > len(data):
            return None
        out.append(data[i + 4 : i + 4 + n])
        i += 4 + n
    return out or None


def is_openssh(data: bytes) -> bool:
    """Cipher, key derivation and its options, a count, so many public keys, and the private part fill data exactly."""

    def field(i: int) -> int | None:
        end = i + 4 + int.from_bytes(data[i : i + 4], "big")
        return end if i + 4 <= len(data) and end <= len(data) else None

    i: int | None = 0
    for _ in range(3):
        i = field(i)
        if i is None:
            return False
    n = int.from_bytes(data[i : i + 4], "big")
    if i + 4 > len(data) or not 1 <= n <= len(data):
        return False
    i += 4
    for _ in range(n + 1):
        i = field(i)
        if i is None:
            return False
    return i == len(data)


def is_pem_key(body: str) -> bool:
    data = decode64(body)
    if data and data.startswith(b"openssh-key-v1\x00"):
        return is_openssh(data[15:])
    return is_der_key(data)


def is_jwt(x: str) -> bool:
    try:
        head, body = (json.loads(decode64(p, url=True) or b"") for p in x.split(".")[:2])
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def find_secrets(x: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) of one text by start, then kind."""
    out = []
    if "=" in x or ":" in x:
        out += [("assign", *m.span()) for m in _assign.finditer(x) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in x:
        out += [("access", *m.span()) for m in _access.finditer(x) if len(m[0]) >= MIN_ACCESS]
    out += [("hex", *m.span()) for m in _hex.finditer(x)]
    armoured = [m.span() for m in _pem.finditer(x) if is_pem_key(m[2])] if "-----BEGIN " in x else []
    out += [("pem", a, z) for a, z in armoured]
    out += [("der", a, z) for a, z in find_der(x) if not any(p <= a and z <= q for p, q in armoured)]
    if "AAAA" in x:
        for m in _ssh.finditer(x):
            fields = ssh_fields(decode64(m[1]))
            if fields and len(fields) >= 2 and fields[0].decode("latin-1") == m[0].split(" ")[0]:
                out.append(("ssh", *m.span()))
    if "eyJ" in x:
        out += [("jwt", *m.span()) for m in _jwt.finditer(x) if is_jwt(m[0])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document with all its spans."""
    schema = arrow_schema(SCHEMA)

    def scan(batch):
        texts = batch.column(1)
        return T.batches_of([batch.column(0), [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(x.as_py() or "")] for x in texts]], schema.names, schema)

    return map_batches(id_and_text(docs, id_col, text_col), scan, SCHEMA)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = arrow_schema(ddl := "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    said = lambda spans: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)

    def digest(batch):
        rows = batch.column(1).to_pylist()
        n = [[sum(s["kind"] == k for s in r) for r in rows] for k in KINDS[:3]]
        base = [said([s for s in r if s["kind"] in KINDS[:3]]) for r in rows]
        return T.batches_of([batch.column(0), *n, [hashlib.sha256(b.encode()).hexdigest() for b in base], [said(r) for r in rows]], schema.names, schema)

    return map_batches(scan_secrets(table(spark, sf_dir, "documents")), digest, ddl)


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLE_SQL: dict[str, str] = {}

"""Operator 7: secret scans with structural confirmation.

Three base kinds are found by pattern and always reported. Further kinds are
reported only where a candidate decodes and its inner structure holds:

* ``pem``: a private-key block whose base64 body is DER with nested lengths that
  fit, an ``openssh-key-v1`` container, or an encrypted body of whole cipher blocks
  under a ``DEK-Info`` header;
* ``der``: a bare base64 or hex run that is a PKCS#8, PKCS#1 or SEC 1 private key;
* ``ssh``: a bare base64 run that is an ``openssh-key-v1`` container;
* ``jwt``: a signed token whose header is a JSON object with ``alg`` and whose
  payload is a JSON object.

Spans are code points of the whole match, end exclusive. Defined results: null
text counts as empty (no spans); repeated rows give repeated results; an empty
table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
import struct

from pyspark.sql import DataFrame

from lexiloom.llm.common import map_batches, spread, table

#: Kinds in the order of their spans where these start together (fixed values).
KINDS = ("assign", "access", "hex", "pem", "der", "ssh", "jwt")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
SHORTEST_VALUE = 6

#: Where an armoured block begins or ends, and the label if it is a private key's.
PEM_MARK = re.compile(r"-----(BEGIN|END) (?:([A-Z0-9 ]*PRIVATE KEY)-----)?")
#: Where a run of base64 may begin: also after an escaped line end, and how its lines are joined.
_FREE = r"(?:(?<![A-Za-z0-9+/_-])|(?<=\\n)|(?<=\\r))"
RUN = re.compile(r"[A-Za-z0-9+/_-]+")
ESCAPED_END = re.compile(r"\\+[rn]")
PADDING = re.compile("={0,2}")
WRAP = re.compile(r"[ \t]*(?:\r?\n|\r|(?:\\+r)?\\+n)[ \t]*")
DER_BASE64 = re.compile(_FREE + r"M[A-P][A-Za-z0-9+/_-]{30,}={0,2}")
DER_HEX = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{62,}")
SSH_BASE64 = re.compile(r"(?:(?<![A-Za-z0-9+/])|(?<=\\n)|(?<=\\r))b3BlbnNzaC1rZXktdjEA[A-Za-z0-9+/]+={0,2}")
#: A header is a JSON object, white space before it or not: its first byte says the first letter.
JWT = re.compile(r"(?<![A-Za-z0-9_-])(?=([eICD][A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*))")
SSH_MAGIC = b"openssh-key-v1\0"


def unbase64(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not; None if it is neither."""
    body = text.rstrip("=").translate(str.maketrans("-_", "+/"))
    if not body or len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the values one after another, if their lengths fill the data exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n >= 128:
            width = n & 127
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            n = int.from_bytes(data[at : at + width], "big")
            at += width
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def is_private_der(data: bytes) -> bool:
    """PKCS#8, PKCS#1 (RSA, DSA) or SEC 1 (EC) private key, plain or PKCS#8-encrypted."""
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_items(outer[0][1])
    if not inner:
        return False
    tags = [t for t, _ in inner]
    if tags[:3] == [2, 0x30, 4] and inner[0][1] in (b"\0", b"\1"):  # version, algorithm, key
        algorithm = der_items(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == 6 and len(inner[2][1]) > 0
    if len(tags) in (6, 9) and set(tags) == {2} and inner[0][1] == b"\0":  # integers only
        return len(inner[1][1]) >= 32
    if tags[:2] == [2, 4] and inner[0][1] == b"\1" and len(inner[1][1]) >= 20:  # EC: 1, octets
        return all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags == [0x30, 4]:  # encrypted PKCS#8: algorithm with parameters, octets
        algorithm = der_items(inner[0][1])
        return bool(algorithm) and len(algorithm) == 2 and algorithm[0][0] == 6 and algorithm[1][0] == 0x30 and len(inner[1][1]) % 8 == 0 and len(inner[1][1]) > 0
    return False


def is_ssh_container(data: bytes) -> bool:
    """openssh-key-v1: cipher, KDF and options, number of keys, public and private parts, lengths nested."""
    if not data.startswith(SSH_MAGIC):
        return False
    at = len(SSH_MAGIC)

    def part():
        nonlocal at
        if at + 4 > len(data):
            return None
        n = struct.unpack_from(">I", data, at)[0]
        if at + 4 + n > len(data):
            return None
        got, at = data[at + 4 : at + 4 + n], at + 4 + n
        return got

    cipher, kdf, options = part(), part(), part()
    if not cipher or not kdf or options is None or at + 4 > len(data):
        return False
    keys = struct.unpack_from(">I", data, at)[0]
    at += 4
    if not 1 <= keys <= 64 or any(part() is None for _ in range(keys)):
        return False
    private = part()
    return bool(private) and len(private) % 8 == 0 and at == len(data)


def der_length(data: bytes) -> int:
    """Bytes of the first value with its head, 0 if the head is broken."""
    if len(data) < 2:
        return 0
    width = data[1] & 127 if data[1] >= 128 else 0
    if width > 4 or data[1] == 128 or len(data) < 2 + width:
        return 0
    return 2 + width + (int.from_bytes(data[2 : 2 + width], "big") if width else data[1])


def ssh_length(data: bytes) -> int:
    """Bytes of an openssh-key-v1 container, 0 if its lengths run over the data."""
    at = len(SSH_MAGIC)
    for _ in range(3):  # cipher, KDF, options
        if at + 4 > len(data):
            return 0
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    for _ in range(min(keys, 64) + 1):  # public parts and the private one
        if at + 4 > len(data):
            return 0
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at


def wrapped(text: str, start: int, length_of, is_key, least: int) -> int:
    """End of a key in base64 that begins at ``start`` and goes on over line ends; -1 if there is none.

    After ``least`` characters its length must be known.
    """
    runs, at, size, need, tried = [], start, 0, 0, 0
    while m := RUN.match(text, at):
        runs.append((m.start(), m[0]))
        size += len(m[0])
        gap = WRAP.match(text, m.end())
        if not need and (size >= 2 * tried or not gap):  # its lengths may stand in lines to come
            head = unbase64("".join(r for _, r in runs)[: size // 4 * 4])
            need, tried = ((length_of(head) * 8 + 5) // 6 if head is not None else 0), size
        if not gap or 0 < need <= size or need > len(text) - start or (not need and size >= least):
            break
        at = gap.end()
    whole = "".join(r for _, r in runs)
    if not 0 < need <= size:
        return -1
    data = unbase64(whole[:need])
    if data is None or not is_key(data):
        return -1
    for begin, run in runs:
        if need <= len(run):
            break
        need -= len(run)
    if need < len(run):  # the run goes on behind the key
        return -1
    end = begin + need
    return end + len(PADDING.match(text, end)[0])


def is_pem_body(body: str) -> bool:
    body = ESCAPED_END.sub("\n", body)
    lines = [x.strip() for x in body.splitlines() if x.strip()]
    headers = [x for x in lines if ":" in x]
    data = unbase64("".join(x for x in lines if ":" not in x).replace(" ", ""))
    if data is None:
        return False
    if any(x.startswith("DEK-Info:") for x in headers):
        return len(data) > 0 and len(data) % 8 == 0
    return is_private_der(data) or is_ssh_container(data)


def is_signed_token(text: str) -> bool:
    found = []
    for part in text.split(".")[:2]:
        raw = unbase64(part)
        try:
            found.append(json.loads(raw.decode("utf-8")) if raw is not None else None)
        except (ValueError, RecursionError):
            return False
    return all(isinstance(x, dict) for x in found) and isinstance(found[0].get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    spans = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= SHORTEST_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return spans


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    spans = []
    begun = None  # the last mark that began a private key, with no other beginning behind it
    for m in PEM_MARK.finditer(text) if "PRIVATE KEY-----" in text else ():
        if m[1] == "BEGIN":
            begun = m if m[2] is not None else None
        elif begun and m[2] == begun[2]:
            if is_pem_body(text[begun.end() : m.start()]):
                spans.append((begun.start(), m.end(), "pem"))
            begun = None
    starts, ends = [a for a, _, _ in spans], [b for _, b, _ in spans]

    def held(at: int) -> bool:
        i = bisect.bisect_right(starts, at)
        return i > 0 and at < ends[i - 1]

    for m in DER_BASE64.finditer(text):
        data = unbase64(m[0])
        if data is not None and is_private_der(data):
            spans.append((m.start(), m.end(), "der"))
        elif not held(m.start()) and (stop := wrapped(text, m.start(), der_length, is_private_der, 8)) >= 0:
            spans.append((m.start(), stop, "der"))
    for m in DER_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and is_private_der(bytes.fromhex(m[0])):
            spans.append((m.start(), m.end(), "der"))
    if "b3BlbnNzaC1rZXktdjEA" in text:
        for m in SSH_BASE64.finditer(text):
            data = unbase64(m[0])
            if data is not None and is_ssh_container(data):
                spans.append((m.start(), m.end(), "ssh"))
            elif not held(m.start()) and (stop := wrapped(text, m.start(), ssh_length, is_ssh_container, 1 << 20)) >= 0:
                spans.append((m.start(), stop, "ssh"))
    at = 0
    for m in JWT.finditer(text):
        if m.start() >= at and is_signed_token(m[1]):
            at = m.end(1)
            spans.append((m.start(), at, "jwt"))
    return spans


def joined(spans: list[tuple[int, int, str]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], order[s[2]], s[1])))


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def body(cols):
        out = {n: [] for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for text in cols["text"].to_pylist():
            base = base_spans(text or "")
            for kind in KINDS[:3]:
                out[f"n_{kind}"].append(sum(1 for s in base if s[2] == kind))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(base + confirmed_spans(text or "")))
        return {"doc_id": cols["doc_id"]} | out

    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "CAST(text AS STRING) AS text")
    return map_batches(rows, body, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spread(table(spark, sf_dir, "documents")))

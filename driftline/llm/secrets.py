"""Secret scans with structural confirmation.

Base patterns report what merely looks like a secret. Beyond them, candidates for encoded keys are
decoded and parsed before anything is reported: base64 or hex text must decode to a DER structure of
which every nested length is right (private keys of the PKCS#1, DSA, PKCS#8, encrypted PKCS#8 and SEC1 kinds) or to the
binary form of an OpenSSH key (the body of a PEM block may also be whole blocks of a cipher that its header names), and a signed token's first part must be a JSON object that names its
algorithm, its second one a JSON object.

Defined cases: a null text is an empty one (no spans); whole texts are read, of any length; repeated
rows are scanned alike; an empty table gives an empty result; spans of equal start come in the order
of :data:`KINDS`.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from driftline.llm.common import batch_of, cut, map_rows, table

#: In the order in which spans of equal start are listed; the first three are the base ones.
KINDS = ["assign", "access", "hex", "pem", "der", "der_hex", "openssh", "jwt"]
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_NAMES = re.compile(r"password|passwd|secret|token|api_?key", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_LETTERS = re.compile(r"[A-Za-z0-9+/_-]+")
#: Base64 from a place on, over line ends, which may be escaped as in JSON.
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]+(?:(?:\r?\n|(?:\\r)?\\n)[\x20\t]*[A-Za-z0-9+/_-]+)*")
_HEXRUN = re.compile(r"[0-9a-f]{64,}|[0-9A-F]{64,}")
_PADDING = re.compile("=*")
_ESCAPED = re.compile(r"\\[rn]")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----)[\s\S])*+)-----END \1-----")
#: Lines before the body of a PEM block, and the one that tells how the body is encrypted.
_PEM_HEADS = re.compile(r"(?:\s|\\[rn])*((?:[A-Za-z][A-Za-z0-9-]*:(?:(?!\\[rn])[^\r\n])*(?:\r?\n|(?:\\r)?\\n)[\x20\t]*)*)")
_CIPHER = re.compile(r"DEK-Info:\x20*[A-Z0-9-]+,([0-9A-Fa-f]{16,64})(?![0-9A-Fa-f])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}+)\.(eyJ[A-Za-z0-9_-]*+)\.([A-Za-z0-9_-]*+)")
_SSH = b"openssh-key-v1\0"
#: What encoded keys begin with: a DER sequence (0x30 and a length of 0 to 127 or in 1 to 4 more bytes), or the magic.
_START = re.compile(r"M[A-I]|b3BlbnNzaC1rZXktdjEA")
# Beginnings of the identifiers of password-based encryption (PKCS#5 and PKCS#12).
_PBE = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def der(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list | None:
    """The values between two places as (tag, content or children), if every length fits exactly."""
    end, out = len(data) if end is None else end, []
    while at < end:
        if depth > 16 or end - at < 2:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or end - at < size or data[at] == 0:
                return None
            n, at = int.from_bytes(data[at : at + size], "big"), at + size
            if n < 128 or (size > 1 and n < 1 << 8 * (size - 1)):
                return None
        if n > end - at:
            return None
        if tag & 0x20:
            inner = der(data, at, at + n, depth + 1)
            if inner is None:
                return None
            out.append((tag, inner))
        else:
            out.append((tag, data[at : at + n]))
        at += n
    return out


def is_private_key(data: bytes) -> bool:
    """Whether the bytes are one key: PKCS#1, DSA, PKCS#8 (plain or encrypted) or SEC1, nested lengths and integers checked."""
    if not data or data[0] != 0x30:
        return False
    top = der(data)
    if not top or len(top) != 1:
        return False
    parts = top[0][1]
    tags = [t for t, _ in parts]
    if len(parts) >= 9 and tags[:9] == [2] * 9:  # RSA: version, n, e, d, p, q and three more
        n, p, q = (int.from_bytes(parts[i][1], "big") for i in (1, 4, 5))
        return n > 0 and n == p * q
    if tags == [2] * 6:  # DSA: version, p, q, g, public and private number
        p, q, g, y, x = (int.from_bytes(v, "big") for _, v in parts[1:])
        return parts[0][1] == b"\0" and 1 < q < p and (p - 1) % q == 0 and 1 < g < p and 0 < y < p and 0 < x < q
    if tags == [0x30, 4]:  # encrypted PKCS#8: how, and the bytes
        how = parts[0][1]
        return bool(how) and how[0][0] == 6 and how[0][1].startswith(_PBE) and len(parts[1][1]) >= 16
    if len(parts) >= 3 and tags[:3] == [2, 0x30, 4]:  # PKCS#8: version, algorithm, key
        return bool(parts[1][1]) and parts[1][1][0][0] == 6 and len(parts[2][1]) >= 16
    return len(parts) >= 2 and tags[:2] == [2, 4] and parts[0][1] == b"\1" and len(parts[1][1]) >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])


def openssh_end(data: bytes) -> int | None:
    """Where a key ends that the bytes begin with: the magic, three length-led strings, the number of keys, and length-led keys."""
    if not data.startswith(_SSH):
        return None
    at, left = len(_SSH), 3
    while left:
        n = int.from_bytes(data[at : at + 4], "big")
        at, left = at + 4 + n, left - 1
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 64:
        return None
    for _ in range(keys + 1):
        if at + 4 > len(data):
            return None
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at if at <= len(data) else None


def is_openssh_key(data: bytes) -> bool:
    """Whether the bytes are one key of the OpenSSH form."""
    return openssh_end(data) == len(data)


def der_end(head: bytes) -> int | None:
    """The whole length of the DER sequence that begins with these bytes, if what comes first in it is a version
    of one byte or another sequence."""
    if len(head) < 5 or head[0] != 0x30:
        return None
    n, at = head[1], 2
    if n & 0x80:
        at += n & 0x7F
        if not 3 <= at <= 6 or len(head) < at + 3:
            return None
        n = int.from_bytes(head[2:at], "big")
    return at + n if head[at : at + 2] == b"\2\1" and head[at + 2] < 4 or head[at] == 0x30 else None


def _flat(body: str) -> str:
    return "".join(_LETTERS.findall(_ESCAPED.sub(" ", body)))


def encoded_keys(text: str) -> list[tuple[int, int, str]]:
    """Keys in base64, begun wherever a DER sequence or the magic may begin; each ends where its own length says."""
    out, done = [], 0
    for m in _START.finditer(text):
        start = m.start()
        if start < done:
            continue
        ssh = m[0][0] == "b"
        if ssh:
            flat = _flat(_BASE64.match(text, start)[0])
            size = openssh_end(from_base64(flat[: len(flat) // 4 * 4]) or b"") or openssh_end(from_base64(flat) or b"")
        else:
            head = _flat(_BASE64.match(text, start, start + 64)[0])[:16]
            size = der_end(from_base64(head[: len(head) // 4 * 4]) or b"")
        if not size:
            continue
        need = -(-size * 8 // 6)
        if need > len(text) - start:
            continue
        body = _BASE64.match(text, start, start + 6 * need + 64)
        parts, end = [], start
        for part in _LETTERS.finditer(_ESCAPED.sub("  ", body[0])):  # as long as before, so places stay
            take = min(need, part.end() - part.start())
            parts.append(part[0][:take])
            need, end = need - take, start + part.start() + take
            if not need:
                break
        data = None if need else from_base64("".join(parts))
        if data is not None and (ssh or is_private_key(data)):
            end = _PADDING.match(text, end, end + -size % 3).end()
            out.append((start, end, "openssh" if ssh else "der"))
            done = end
    return out


def hex_keys(text: str) -> list[tuple[int, int, str]]:
    """Keys in hexadecimal digits, begun wherever a DER sequence may begin in a run of them."""
    out = []
    for run in _HEXRUN.finditer(text):
        at = run.start()
        while (at := text.find("30", at, run.end())) >= 0:
            head = text[at : min(at + 20, run.end())]
            size = der_end(bytes.fromhex(head[: len(head) // 2 * 2]))
            end = at + 2 * size if size else 0
            if size and end <= run.end() and is_private_key(bytes.fromhex(text[at:end])):
                out.append((at, end, "der_hex"))
                at = end
            else:
                at += 1
    return out


def from_base64(text: str) -> bytes | None:
    flat = "".join(text.split()).translate({45: "+", 95: "/"}).rstrip("=")
    if len(flat) % 4 == 1:
        return None
    try:
        return base64.b64decode(flat + "=" * (-len(flat) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json_object(part: str) -> dict | None:
    data = from_base64(part)
    try:
        found = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_signed_token(head: str, body: str, signature: str) -> bool:
    h = _json_object(head)
    if h is None or not isinstance(h.get("alg"), str) or _json_object(body) is None:
        return False
    return bool(signature) or h["alg"].lower() == "none"


def is_pem_body(body: str) -> bool:
    """Whether what stands between the lines of a PEM block is a key: one that parses, or, where a header names a
    cipher, whole blocks of it."""
    heads = _PEM_HEADS.match(body)
    data = from_base64(_ESCAPED.sub("", body[heads.end() :]))
    if data is None:
        return False
    if cipher := _CIPHER.search(heads[1]):
        return len(data) >= 16 and len(data) % (16 if len(cipher[1]) == 32 else 8) == 0
    return is_private_key(data) or is_openssh_key(data)


def signed_tokens(text: str) -> list[tuple[int, int, str]]:
    """Signed tokens, leftmost first; where a candidate fails, the next may begin with its second part."""
    out, at = [], 0
    while m := _JWT.search(text, at):
        found = is_signed_token(m[1], m[2], m[3])
        at = m.end() if found else m.end(1)
        if found:
            out.append((m.start(), m.end(), "jwt"))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost matches of each base kind that don't overlap; too short ones are dropped after matching."""
    out = []
    if (":" in text or "=" in text) and _NAMES.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Candidates that decode and parse."""
    out = []
    if "-----BEGIN" in text:
        out += [(m.start(), m.end(), "pem") for m in _PEM.finditer(text) if is_pem_body(m[2])]
    inside = [(a, b) for a, b, _ in out]
    if _START.search(text):
        out += [(a, b, k) for a, b, k in encoded_keys(text) if not any(c <= a and b <= d for c, d in inside)]
    if "30" in text:
        out += hex_keys(text)
    if "eyJ" in text:
        out += signed_tokens(text)
    return out


_ORDER = {k: i for i, k in enumerate(KINDS)}


def scan(text: str | None) -> tuple[list, list]:
    """Base spans and all spans, as (start, end, kind), each in order of start and kind."""
    if not text:
        return [], []
    key = lambda s: (s[0], _ORDER[s[2]])
    base = sorted(base_spans(text), key=key)
    return base, sorted(base + confirmed_spans(text), key=key)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def mask(text: str | None, mark: str = "[secret]") -> str | None:
    """The text with every span, overlapping ones together, put as ``mark``."""
    spans = scan(text)[1]
    if not spans:
        return text
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in ``text`` and ``n_chars`` set anew where that changed it."""
    names = docs.columns

    def run(batches):
        for batch in cut(batches):
            texts = batch.column(names.index("text")).to_pylist()
            new = [mask(t) for t in texts]
            counts = batch.column(names.index("n_chars")).to_pylist()
            cols = {"text": pa.array(new, batch.schema.field("text").type), "n_chars": pa.array([n if t == o else len(t) for n, t, o in zip(counts, new, texts)], batch.schema.field("n_chars").type)}
            yield pa.RecordBatch.from_arrays([cols.get(c, batch.column(i)) for i, c in enumerate(names)], names=names)

    return docs.mapInArrow(run, docs.schema)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row for each span: ``doc_id, kind, start, end, value``."""
    schema = [("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]

    def make():
        def step(ids, texts):
            rows = [(i, k, a, b, t[a:b]) for i, t in zip(ids, texts) for a, b, k in scan(t)[1]]
            return batch_of(schema, dict(zip([n for n, _ in schema], zip(*rows)))) if rows else None

        return step

    return map_rows(docs, ["doc_id", "text"], make, "doc_id long, kind string, start long, end long, value string")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: counts and spans of every document."""
    schema = [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]

    def make():
        def step(ids, texts):
            found = [scan(t) for t in texts]
            out = {f"n_{k}": [sum(x[2] == k for x in base) for base, _ in found] for k in BASE}
            return batch_of(schema, out | {
                "doc_id": ids,
                "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found],
                "spans": [joined(every) for _, every in found],
            })

        return step

    return map_rows(table(spark, sf_dir, "documents"), ["doc_id", "text"], make,
                    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")

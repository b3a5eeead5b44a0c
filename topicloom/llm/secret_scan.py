"""Secret scan with structural confirmation.

Three base patterns give spans as they are. On top, runs of base64 and hex characters
are decoded and reported only if their bytes have the structure of a key or a signed
token: DER keys whose nested lengths fill the whole value, OpenSSH key files, PEM
bodies with or without header lines, and tokens of three parts whose header is a JSON
object naming an algorithm. Both base64 alphabets are scanned, each by itself, and runs
that are wrapped over lines are followed for as long as the key's own length says.

Edge cases: null and empty texts have no spans; offsets are code points of the whole
text, end exclusive; equal spans of one kind are reported once; repeated rows are
scanned each; other columns are kept or not read.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

#: Kinds in the order in which spans of one start are listed; the first three are base kinds.
KINDS = ("assign", "access", "hex", "der", "pem", "ssh", "jwt")

#: The base patterns and their least lengths.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are whole, so the least length can stand in the pattern
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

_KEYWORD = re.compile(r"(?ai)passw|secret|token|api_?key")
_ENCODED = [re.compile(r"[A-Za-z0-9+/]{44,}={0,2}"), re.compile(r"[A-Za-z0-9_-]{44,}={0,2}")]
#: First line of a wrapped key, whose head holds the key's length, and a line behind it.
_WRAPPED = [(re.compile(rf"(?<![{a}])(?:M[A-P][{a}]{{14,}}|b3BlbnNzaC1r[{a}]{{4,}})(?![{a}])(?=[ \t]*\r?\n)"),
             re.compile(rf"[ \t]*\r?\n[ \t]*([{a}]+)")) for a in ("A-Za-z0-9+/", "A-Za-z0-9_-")]
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_.-])")
_PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----\s*((?:[ \t]*[A-Za-z][A-Za-z0-9-]*:[^\r\n]*\r?\n)*)"
                  r"([A-Za-z0-9+/=\s]+)-----END \1-----")
_CIPHER = re.compile(r"(?m)^[ \t]*DEK-Info:[ \t]*[A-Z0-9-]+,((?:[0-9A-Fa-f]{16}){1,2})[ \t]*\r?$")
#: PKCS 5 and PKCS 12 schemes of encryption by password.
_PASSWORD_SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_SSH = b"openssh-key-v1\x00"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping per kind."""
    found = []
    if _KEYWORD.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def _elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the DER elements that fill ``data``, or None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            length = int.from_bytes(data[at:at + n], "big")
            at += n
            if length < 0x80:
                return None
        if at + length > len(data):
            return None
        out.append((tag, data[at:at + length]))
        at += length
    return out


def is_der_key(data: bytes) -> bool:
    """A private key in DER: RSA, DSA, EC, or one wrapped with its algorithm (PKCS 8), encrypted or not."""
    outer = _elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    parts = _elements(outer[0][1])
    if parts and [t for t, _ in parts] == [0x30, 0x04]:  # PKCS 8, encrypted: scheme, then the bytes
        scheme = _elements(parts[0][1])
        return bool(scheme) and scheme[0][0] == 0x06 and scheme[0][1].startswith(_PASSWORD_SCHEMES) and len(parts[1][1]) >= 8
    if not parts or len(parts) < 3 or parts[0][0] != 0x02 or len(parts[0][1]) != 1 or parts[0][1][0] > 1:
        return False
    tags = [t for t, _ in parts]
    if tags[1] == 0x30 and tags[2] == 0x04:  # PKCS 8: algorithm, then the key
        algorithm = _elements(parts[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if tags[1] == 0x04 and tags[2] in (0xA0, 0xA1):  # EC
        return len(parts[1][1]) >= 16
    if len(parts) == 6 and all(t == 0x02 for t in tags):  # DSA: version, p, q, g, y, x
        p, q, x = (len(parts[i][1]) for i in (1, 2, 5))
        return p >= 64 and q >= 20 and x <= q
    return len(parts) >= 9 and all(t == 0x02 for t in tags[:9])  # RSA: version and eight numbers


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH private key: magic, then cipher and KDF names with their lengths."""
    if not data.startswith(_SSH):
        return False
    at = len(_SSH)
    for _ in range(3):
        length = int.from_bytes(data[at:at + 4], "big")
        if at + 4 + length > len(data):
            return False
        at += 4 + length
    return int.from_bytes(data[at:at + 4], "big") >= 1


def is_encrypted_body(headers: str, data: bytes) -> bool:
    """Body of a PEM whose headers name its cipher and first block: whole blocks of that size."""
    cipher = _CIPHER.search(headers)
    return bool(cipher) and "ENCRYPTED" in headers and bool(data) and len(data) % (len(cipher[1]) // 2) == 0


def key_size(data: bytes) -> tuple[int, bool]:
    """(bytes, True) of the DER value or OpenSSH key that ``data`` starts with, 0 if none; (bytes, False) if so many must be seen first."""
    if _SSH.startswith(data[:len(_SSH)]):
        at, left, last = len(_SSH), 3, False  # three names, then so many public keys and one private part
        while left:
            if at + 4 > len(data):
                return at + 4, False
            length = int.from_bytes(data[at:at + 4], "big")
            at, left = at + 4 + length, left - 1
            if not left and not last:
                if at + 4 > len(data):
                    return at + 4, False
                at, left, last = at + 4, int.from_bytes(data[at:at + 4], "big") + 1, True
        return at, True
    n = data[1] & 0x7F if data[1] & 0x80 else 0
    if data[0] != 0x30 or n > 4 or data[1] == 0x80 or data[2 + n] not in (0x02, 0x30):
        return 0, True
    return 2 + n + (int.from_bytes(data[2:2 + n], "big") if n else data[1]), True


def wrapped_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """Keys in base64 that go on over several lines and end where a run of characters does."""
    for first, more in _WRAPPED:
        m = first.search(text)
        while m:
            lines, end, kind = [m[0]], m.end(), None
            have = len(m[0])
            size, final = key_size(_decode(m[0][:have // 4 * 4]))
            while size and (have < -(-size * 4 // 3) or not final):
                if not final and have // 4 * 3 >= size:
                    size, final = key_size(_decode("".join(lines)[:have // 4 * 4]))
                    continue
                line = more.match(text, end)
                if not line:
                    break
                lines.append(line[1])
                have, end = have + len(line[1]), line.end()
            if size and final and len(lines) > 1 and have == -(-size * 4 // 3):
                data = _decode("".join(lines))
                if data is not None:
                    kind = "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None
            if kind:
                while have % 4 and text[end:end + 1] == "=":
                    end, have = end + 1, have + 1
                yield m.start(), end, kind
            m = first.search(text, end if kind else m.end())


def _decode(run: str) -> bytes | None:
    body = run.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(header: str, payload: str) -> bool:
    """Header is a JSON object that names an algorithm; payload decodes."""
    head, body = _decode(header), _decode(payload)
    if head is None or body is None:
        return False
    try:
        parsed = json.loads(head)
    except (UnicodeDecodeError, ValueError, RecursionError):
        return False
    return isinstance(parsed, dict) and isinstance(parsed.get("alg"), str)


def confirmed_spans(text: str) -> Iterator[tuple[int, int, str]]:
    """Spans whose decoded bytes have the structure of a secret."""
    pems = []
    for m in _PEM.finditer(text) if "-----BEGIN " in text else ():
        data = _decode("".join(m[3].split()))
        if data is not None and (is_der_key(data) or is_ssh_key(data) or is_encrypted_body(m[2], data)):
            pems.append((m.start(), m.end()))
            yield m.start(), m.end(), "pem"
    keys = []
    for pattern in _ENCODED:
        for m in pattern.finditer(text):
            run = m[0]
            data = _decode(run) if run[0] in "Mb" else None  # as the first byte of either kind of key asks
            if data is not None:
                if is_der_key(data):
                    keys.append((m.start(), m.end(), "der"))
                elif is_ssh_key(data):
                    keys.append((m.start(), m.end(), "ssh"))
            if len(run) % 2 == 0 and re.fullmatch(r"[0-9A-Fa-f]+", run) and is_der_key(bytes.fromhex(run)):
                keys.append((m.start(), m.end(), "der"))
    for start, end, kind in wrapped_spans(text):
        at = bisect.bisect_right(pems, (start, len(text))) - 1
        if at < 0 or end > pems[at][1]:
            keys.append((start, end, kind))
    upto = {"der": -1, "ssh": -1}
    for start, end, kind in sorted(keys, key=lambda s: (s[0], -s[1])):
        if end > upto[kind]:  # else a part of a key that was found whole
            upto[kind] = end
            yield start, end, kind
    for m in _TOKEN.finditer(text) if "eyJ" in text else ():
        if is_signed_token(m[1], m[2]):
            yield m.start(), m.end(), "jwt"


def all_spans(text: str) -> list[tuple[int, int, str]]:
    """Base and confirmed spans by start, then kind, then end."""
    return sorted({*base_spans(text), *confirmed_spans(text)}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, base>>): every secret of every text."""
    kind = dict(docs.dtypes)["doc_id"]
    inner = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[{"kind": k, "start": s, "end": e, "base": k in KINDS[:3]} for s, e, k in all_spans(text)] if text else []
                 for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, inner)], ["doc_id", "spans"])
    return B.map_text(docs.select("doc_id", "text"), work,
                      f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def redact_text(text: str, mark: str = "[{kind}]") -> str:
    """The text with every span, joined where they overlap, replaced by its first kind."""
    out, at, upto = [], 0, -1
    for start, end, kind in all_spans(text):
        if start >= upto:
            out += [text[at:start], mark.format(kind=kind)]
            upto = end
        upto = at = max(upto, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with secrets replaced by their kind; n_chars follows if present."""
    place = docs.columns.index("text")
    kinds = dict(docs.dtypes)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [redact_text(t) if t else t for t in batch.column(place).to_pylist()]
        columns = list(batch.columns)
        columns[place] = pa.array(texts, batch.schema.field(place).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)
    made = B.map_text(docs, work, docs.schema)
    if "n_chars" in kinds:
        made = made.withColumn("n_chars", F.length("text").cast(kinds["n_chars"]))
    return made.select(*docs.columns)

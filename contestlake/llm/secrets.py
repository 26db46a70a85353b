"""Secret scans with structural confirmation.

Three patterns give the base findings.  Base64 and hex are then decoded,
wherever a key can begin and over line breaks, and reported as keys or tokens
only if their inside has the structure of one: DER private keys with
consistent nested lengths, OpenSSH key blobs with their length-prefixed
fields, or signed tokens whose header names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The base patterns.
ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LETTERS = 6

#: Order of the kinds where spans start together.
KINDS = ("assign", "access", "hex", "key", "token")

#: What may stand between two lines of a key: white space, escaped line breaks, quotes and joined literals.
GAP = r"""(?:["']\s*+(?:[+.]\s*+)?["']|\\++[nrt]|\\++(?=\s)|[\s"',])"""
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=]|" + GAP + r")++)-----END \1-----")
#: Three parts of a token, from each place where one can begin; {"alg":""} has 14 letters.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{14,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*))")
#: Where a JSON object can begin inside a run.
OBJECT = re.compile(r"(?=e[w-z0-9_-][A-Za-z0-9_-]{12})")
GAPS = re.compile(GAP)
BASE64_RUN = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
HEX_RUN = re.compile(r"[0-9A-Fa-f]{64,}")
OPENSSH = b"openssh-key-v1\x00"
#: Where a DER sequence or the OpenSSH mark can begin, what follows, and bits of a letter.
CARRIERS = (
    (re.compile(r"M(?=[A-I])|b(?=3BlbnNzaC1rZXktdjEA)"), re.compile(r"([A-Za-z0-9+/_-]{1,1024})|" + GAP), 6),
    (re.compile(r"3(?=0[0-8])|6(?=[fF]70656[eE]7373682[dD]6[bB]65792[dD]763100)"), re.compile(r"([0-9A-Fa-f]{1,1024})|" + GAP), 4),
)
#: Letters that are read at first; enough for the head of a DER value.
HEAD = 24


def _der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the value at ``at``; None unless it lies within ``end``."""
    if at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length & 0x80:
        n = length & 0x7F
        if not 1 <= n <= 4 or at + n > min(end, len(data)) or data[at] == 0:
            return None
        length, at = int.from_bytes(data[at : at + n], "big"), at + n
        if length < 0x80:
            return None
    return (tag, at, at + length) if at + length <= end else None


def _children(data: bytes, start: int, end: int, most: int = 16) -> list[tuple[int, int, int]] | None:
    """The values that fill start..end exactly, or None."""
    out = []
    while start < end:
        value = _der(data, start, end)
        if value is None or len(out) == most:
            return None
        out.append(value)
        start = value[2]
    return out


def is_private_key(data: bytes | memoryview) -> bool:
    """PKCS#8 (plain or encrypted), PKCS#1, SEC 1 or OpenSSH private keys."""
    if data[: len(OPENSSH)] == OPENSSH:
        at = len(OPENSSH)
        for _ in range(3):  # cipher, key derivation, its options
            if at + 4 > len(data):
                return False
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 16
    top = _der(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    inner = _children(data, top[1], top[2])
    if not inner:
        return False
    tags = [x[0] for x in inner]
    if tags[:2] == [0x30, 0x04] and len(tags) == 2:  # encrypted: algorithm, octets
        algorithm = _children(data, *inner[0][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if tags[0] != 0x02 or inner[0][2] - inner[0][1] != 1 or data[inner[0][1]] > 1:
        return False
    if tags[1:3] == [0x30, 0x04]:
        algorithm = _children(data, *inner[1][1:])
        return bool(algorithm) and algorithm[0][0] == 0x06
    if len(tags) >= 9 and set(tags[:9]) == {0x02}:
        return True
    return len(tags) >= 2 and tags[1] == 0x04 and inner[1][2] - inner[1][1] >= 16 and set(tags[2:]) <= {0xA0, 0xA1}


def _unbase64(text: str) -> bytes | None:
    text = GAPS.sub("", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(part: str) -> dict | None:
    data = _unbase64(part)
    try:
        value = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(head: str, body: str) -> bool:
    """A JSON header that names an algorithm, and a JSON object as body."""
    named = _object(head)
    return named is not None and isinstance(named.get("alg"), str) and _object(body) is not None


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost matches of the three base patterns, by start and then kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LETTERS]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=_order)


def _declared(data: bytes | memoryview) -> int | None:
    """Bytes that a key at the start of ``data`` says it has, 0 if there can be none; None if more bytes must be read to tell."""
    if data[: len(OPENSSH)] == OPENSSH[: len(data)]:
        at, keys = len(OPENSSH), None
        fields = 3
        while fields:
            if at + 4 > len(data):
                return None
            at += 4 + int.from_bytes(data[at : at + 4], "big")
            fields -= 1
            if not fields and keys is None:  # the number of keys, then each public key and the private part
                if at + 4 > len(data):
                    return None
                keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
                if not 1 <= keys <= 16:
                    return 0
                fields = keys + 1
        return at
    top = _der(data, 0, 1 << 40) if len(data) >= 8 else None
    inner = top and _der(data, top[1], 1 << 40)
    if inner is None or top[0] != 0x30 or inner[1] >= len(data):
        return 0
    version = inner[0] == 0x02 and inner[2] - inner[1] == 1 and data[inner[1]] <= 1
    return top[2] if version or (inner[0] == 0x30 and data[inner[1]] == 0x06) else 0


class Run:
    """The letters from one place on, over line breaks, decoded once for each way that they can be grouped."""

    def __init__(self, text: str, start: int, piece: re.Pattern, bits: int):
        self.bits, self.period = bits, 8 // bits if bits == 4 else 4
        letters, self.begin, self.before = [], [], []
        at, have = start, 0
        while m := piece.match(text, at):
            if m[1]:
                letters.append(m[1])
                self.begin.append(at)
                self.before.append(have)
                have += len(m[1])
            at = m.end()
        self.letters, self.end = "".join(letters), at
        self.grouped: dict[int, memoryview] = {}

    def key_at(self, text: str, start: int) -> int | None:
        """End of the private key that is encoded from ``start`` on; a key that says it is longer than the run is none."""
        k = bisect.bisect_right(self.begin, start) - 1
        number = self.before[k] + start - self.begin[k]
        group = number % self.period
        if group not in self.grouped:
            self.grouped[group] = memoryview(_decoded(self.letters[group:], self.bits))
        data = self.grouped[group][(number - group) * self.bits // 8 :]
        total = _declared(data)
        if not total:
            return None
        need = number - (-total * 8 // self.bits)
        if need > len(self.letters) or not is_private_key(data[:total]):
            return None
        k = bisect.bisect_left(self.before, need) - 1
        end = self.begin[k] + need - self.before[k]
        while self.bits == 6 and text[end : end + 1] == "=":
            end += 1
        return end


def _may_begin(text: str, start: int, piece: re.Pattern, bits: int) -> bool:
    """Whether the first letters are not those of something else."""
    letters, at = "", start
    while len(letters) < HEAD and (m := piece.match(text, at)):
        letters, at = letters + (m[1] or ""), m.end()
    return _declared(_decoded(letters[:HEAD], bits)) != 0


class Spans:
    """Sorted spans, merged, to ask what they touch."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.start, self.end = [], []
        for a, z in sorted(spans):
            if self.end and a <= self.end[-1]:
                self.end[-1] = max(self.end[-1], z)
            else:
                self.start.append(a)
                self.end.append(z)

    def touch(self, start: int, end: int) -> bool:
        k = bisect.bisect_left(self.start, end) - 1
        return k >= 0 and self.end[k] > start


def _decoded(letters: str, bits: int) -> bytes:
    """The whole bytes of the letters."""
    if bits == 4:
        return _unhex(letters)
    whole = letters[: len(letters) - (len(letters) % 4 == 1)].replace("-", "+").replace("_", "/")
    return base64.b64decode(whole + "=" * (-len(whole) % 4))


def _header_in(run: str) -> int:
    """Where a token's header begins that the run ends with; far below zero if there is none."""
    read: dict[int, str] = {}  # one decoded text for each of four alignments
    for m in OBJECT.finditer(run):
        i, r = m.start(), m.start() % 4
        if r not in read:
            read[r] = (_unbase64(run[r:]) or b"").decode("latin-1")
        try:
            value, end = json.JSONDecoder().raw_decode(read[r], (i - r) // 4 * 3)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict) and isinstance(value.get("alg"), str) and not read[r][end:].strip():
            return i
    return -(1 << 62)


def _tokens(text: str) -> Iterator[tuple[int, int, str]]:
    done = -1
    for m in TOKEN.finditer(text):
        if m.start() < done:
            continue
        if is_signed_token(m[1], m[2]):
            start = m.start(1)
        else:  # the header may be glued to letters before it
            start = m.start(1) + _header_in(m[1]) if _object(m[2]) else -1
        if start >= m.start(1):
            done = m.end(3)
            yield start, done, "token"


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """Keys and tokens whose decoded structure is that of one."""
    out: list[tuple[int, int, str]] = []
    if "PRIVATE KEY" in text:
        for m in PEM.finditer(text):
            data = _unbase64(m[2])
            if data and is_private_key(data):
                out.append((m.start(), m.end(), "key"))
    taken = Spans([(s, e) for s, e, _ in out])
    for begin, piece, bits in CARRIERS:
        done, run = -1, None
        for m in begin.finditer(text):
            at = m.start()
            if at >= done and not taken.touch(at, at + 1) and _may_begin(text, at, piece, bits):
                if run is None or at >= run.end:
                    run = Run(text, at, piece, bits)
                end = run.key_at(text, at)
                if end is not None:
                    out.append((at, end, "key"))
                    done = end
    out += _tokens(text)
    taken, done = Spans([(s, e) for s, e, k in out if k == "key"]), -1
    for pattern, decode in ((BASE64_RUN, _unbase64), (HEX_RUN, _unhex)):
        for m in pattern.finditer(text):
            if taken.touch(m.start(), m.end()):
                continue
            data = decode(m[0])
            if data and is_private_key(data) and m.start() >= done:
                out.append((m.start(), m.end(), "key"))
                done = m.end()
    return out


def _unhex(text: str) -> bytes:
    return bytes.fromhex(text[: len(text) // 2 * 2])


def _order(span: tuple[int, int, str]) -> tuple[int, int]:
    return span[0], KINDS.index(span[2])


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str, mark: str = "[secret]") -> str:
    """The text with every found span replaced; overlapping spans become one mark."""
    out, at = [], 0
    for start, end, _ in sorted([*base_spans(text), *confirmed_spans(text)]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


FOUND = pa.schema(
    [("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
     ("n_key", pa.int64()), ("n_token", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            base = base_spans(text)
            spans = sorted([*base, *confirmed_spans(text)], key=_order)
            kinds = [k for _, _, k in spans]
            digest = hashlib.sha256(joined(base).encode()).hexdigest()
            rows.append((doc, *(kinds.count(k) for k in KINDS), digest, joined(spans)))
        columns = list(zip(*rows)) or [[] for _ in FOUND]
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, FOUND)], schema=FOUND)


def scan(docs: DataFrame) -> DataFrame:
    """Findings of each whole text; one row per input row, no shuffle.

    A null text is empty and has no findings; repeated rows are scanned each;
    other columns of ``docs`` are not read.
    """
    types = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in FOUND)
    return docs.select("doc_id", "text").mapInArrow(_scan, types)


def redact_documents(docs: DataFrame) -> DataFrame:
    """The same rows with secrets replaced in ``text`` and ``n_chars`` counted anew, where that column exists."""
    names = docs.columns

    def redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, at = batch, names.index("text")
            texts = [None if t is None else redact(t) for t in table.column(at).to_pylist()]
            columns = list(table.columns)
            columns[at] = pa.array(texts, table.schema.field(at).type)
            if "n_chars" in names:
                n = names.index("n_chars")
                old = columns[n].to_pylist()
                counts = [o if t is None else len(t) for o, t in zip(old, texts)]
                columns[n] = pa.array(counts, table.schema.field(n).type)
            yield pa.record_batch(columns, schema=table.schema)

    return docs.mapInArrow(redacted, docs.schema)

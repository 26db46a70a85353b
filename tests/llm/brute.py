"""Plain loops that say what the operators must return."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


class Union:
    def __init__(self, items):
        self.parent = {i: i for i in items}

    def root(self, x):
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


def base_secrets(text: str | None) -> tuple[list[int], str]:
    """Counts of assign, access and hex, and the joined spans, character by character where it is easy."""
    text = text or ""
    out = []
    keyword = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
                         r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for m in keyword.finditer(text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            out.append((m.start(), 1, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            out.append((m.start(), 2, "hex", m.end()))
    kinds = [k for _, _, k, _ in out]
    return [kinds.count(k) for k in ("assign", "access", "hex")], ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def shingles(text: str | None) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def similar(sets: list[frozenset], percent: int = 80) -> list[tuple[int, int]]:
    post = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            post[x].append(i)
    out = []
    for i, s in enumerate(sets):
        common = collections.Counter(j for x in s for j in post[x] if j > i)
        out += [(i, j) for j, k in common.items() if 100 * k >= percent * (len(s) + len(sets[j]) - k)]
    return out


def components(docs: dict[int, str | None]) -> dict[int, int]:
    ids = sorted(docs)
    union = Union(ids)
    for a, b in similar([shingles(docs[d]) for d in ids]):
        union.join(ids[a], ids[b])
    return {d: union.root(d) for d in ids}


def bench_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs: dict, items: list[tuple]) -> dict:
    """doc_id -> (words, hit words, sorted item ids as strings)."""
    windows = collections.defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add(item)
    lengths = {len(w) for w in windows}
    out = {}
    for d, text in docs.items():
        w, hit, found = bench_words(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        out[d] = (len(w), len(hit), sorted(str(x) for x in found if x is not None))
    return out


def repeats(docs: dict[int, str | None], length: int = 50) -> dict:
    """doc_id -> (bytes, removed, spans, digest of the rest)."""
    first, out = {}, {}
    for d in sorted(docs):
        data = (docs[d] or "").encode()
        mark = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first.setdefault(data[i : i + length], d) < d:
                mark[i : i + length] = b"\1" * length
        kept = bytes(c for c, m in zip(data, mark) if not m)
        spans = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        out[d] = (len(data), sum(mark), spans, sha(kept))
    return out


def sentences(text: str) -> list[tuple[int, int, tuple]]:
    """(start, stop, words): cut at line feeds and behind words that end in a closing mark."""
    out, now = [], []
    for line in re.finditer(r"[^\n]+", text):
        for m in re.finditer(r"[^\x20\x09-\x0D]+", line[0]):
            now.append((line.start() + m.start(), line.start() + m.end(), m[0].translate(LOWER)))
            if m[0][-1] in ".!?":
                out.append(now)
                now = []
        if now:
            out.append(now)
            now = []
    return [(s[0][0], s[-1][1], tuple(w for _, _, w in s)) for s in out]


def paragraph_copies(docs: list[tuple[int, str | None]], min_words: int = 10) -> list[tuple[list, set]]:
    """Per (id, text): sorted spans that go and the first documents that hold them."""
    lines = []
    for k, (d, text) in enumerate(docs):
        at = 0
        for line in (text or "").split("\n"):
            if len(re.findall(r"[^\x20\x09-\x0D]+", line)) >= min_words:
                lines.append((k, at, at + len(line), shingles(line)))
            at += len(line) + 1
    sets = list({x[3] for x in lines})
    number = {s: i for i, s in enumerate(sets)}
    union = Union(range(len(sets)))
    for a, b in similar(sets):
        union.join(a, b)
    least: dict[int, int] = {}
    for k, _, _, s in lines:
        r = union.root(number[s])
        least[r] = min(least.get(r, docs[k][0]), docs[k][0])
    gone = [{} for _ in docs]
    for k, a, z, s in lines:
        first = least[union.root(number[s])]
        if first < docs[k][0]:
            gone[k][a, z] = first
    cut = [sentences(text or "") for _, text in docs]
    first_of: dict[tuple, int] = {}
    for (d, _), some in zip(docs, cut):
        for _, _, words in some:
            first_of[words] = min(first_of.get(words, d), d)
    out = []
    for (d, _), some, spans in zip(docs, cut, gone):
        again = [first_of[words] < d for _, _, words in some]
        covered = [any(a <= s and e <= z for a, z in spans) for s, e, _ in some]
        i, more = 0, {}
        while i < len(some):
            j = i
            while j < len(some) and again[j]:
                j += 1
            if any(covered[k] or len(some[k][2]) >= min_words for k in range(i, j)):
                more |= {some[k][:2]: first_of[some[k][2]] for k in range(i, j) if not covered[k]}
            i = max(j, i + 1)
        both = spans | more
        out.append((sorted(both), set(both.values())))
    return out


def repeated_runs(docs: list[tuple[int, str | None]], length: int = 50) -> list[list[tuple[int, int]]]:
    """Per document: the words (start, stop) in runs of ``length`` words that a document with a smaller id has."""
    first: dict[tuple, int] = {}
    out: dict[int, list] = {}
    for k in sorted(range(len(docs)), key=lambda k: docs[k][0]):
        words = [(m.start(), m.end(), m[0].translate(LOWER)) for m in re.finditer(r"[^\x20\x09-\x0D]+", docs[k][1] or "")]
        mark = bytearray(len(words))
        for i in range(len(words) - length + 1):
            if first.setdefault(tuple(w for _, _, w in words[i : i + length]), docs[k][0]) < docs[k][0]:
                mark[i : i + length] = b"\1" * length
        out[k] = [w[:2] for w, m in zip(words, mark) if m]
    return [out[k] for k in range(len(docs))]


def check_pieces(rows: list, docs: list[tuple], encode, window: int = 1024) -> float:
    """Assert that pieces hold every id of every document once, in order, and sequences have no gaps; returns the filled share."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    texts = collections.defaultdict(list)
    for d, text in docs:
        texts[d].append(np.array([*encode(text or ""), 0], dtype="<u4"))
    assert set(by_doc) == set(texts)
    for d, some in texts.items():
        covered = sum(r.length for r in by_doc[d])
        assert covered == sum(map(len, some))
        if len(some) == 1:
            at = 0
            for r in sorted(by_doc[d], key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(some[0]))
                assert zlib.crc32(some[0][at : at + r.length].tobytes()) == r.ids_crc32
                at += r.length
    total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        total += at
    return total / (len(by_sequence) * window) if by_sequence else 1.0

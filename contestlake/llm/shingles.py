"""Vectorised words, word hashes and k-gram hashes over a batch of texts.

Everything works on the UTF-8 bytes of several texts joined by line feeds, so
the cost per byte is that of a few numpy passes.  A word hash is a difference
of a running polynomial sum (64 bit, a random value per byte), mixed at the
end; a k-gram hash is a polynomial of word hashes, mixed again.  Two different
k-grams agree with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer text is handled alone.
BATCH_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD1342543DE82EF95)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: True for the bytes of a word. Non-ASCII bytes always belong to words.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.ones(256, dtype=bool)
ALNUM[:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the usual batch size."""
    kept = _powers.get(base)
    if kept is not None and len(kept) >= n:
        return kept[:n]
    out = np.full(max(n, BATCH_BYTES + 1), base, dtype=np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    if len(out) <= 4 * BATCH_BYTES:
        _powers[base] = out
    return out[:n]


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, joined."""
    total = np.cumsum(size)
    return np.repeat(start - total + size, size) + np.arange(total[-1] if len(total) else 0)


def text_bytes(column: pa.Array, step: int = 512) -> Iterator[bytes]:
    """UTF-8 bytes of a string column, some rows at a time; a null is empty."""
    for at in range(0, len(column), step):
        for t in column.slice(at, step).cast(pa.binary()).to_pylist():
            yield t or b""


def batches(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about BATCH_BYTES."""
    some, size = [], 0
    for t in texts:
        if some and size + len(t) > BATCH_BYTES:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t) + 1
    if some:
        yield some


def range_hashes(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each range."""
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUE[np.frombuffer(data, dtype=np.uint8)] * powers(_BASE, len(data)), out=run[1:])
    return mix((run[start + size] - run[start]) * powers(_BASE_INVERSE, len(data) + 1)[start] + size.astype(np.uint64))


class Words:
    """The words of some texts: where they are and what they hash to.

    ``first[i]:first[i + 1]`` are the numbers of the words of text ``i``.
    """

    def __init__(self, texts: list[bytes], kind: np.ndarray = SPACED):
        self.data = _LOWER[np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_start = np.concatenate(([0], np.cumsum(lengths)))
        inside = np.zeros(len(self.data) + 1, dtype=np.int8)
        inside[1:] = kind[self.data]
        edge = np.diff(inside)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.start, self.text_start)
        run = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[self.data] * powers(_BASE, len(self.data)), out=run[1:])
        back = powers(_BASE_INVERSE, len(self.data) + 1)
        self.hash = mix((run[self.end] - run[self.start]) * back[self.start])
        self.count = np.diff(self.first)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; of no meaning where a text has fewer left."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        out = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            out = out * _STEP + self.hash[j : j + n]
        return mix(out + np.uint64(k))

    def whole(self, i: int) -> np.uint64:
        """Hash of all words of text i as one sequence; differs from any longer or shorter one."""
        out = 0
        for h in self.hash[self.first[i] : self.first[i + 1]].tolist():
            out = (out * int(_STEP) + h) & 0xFFFFFFFFFFFFFFFF
        return mix(np.array([(out + int(self.count[i])) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0]

    def phrase(self, a: int, b: int) -> str:
        """Words a..b-1, joined by one space."""
        data, s, e = self.data, self.start, self.end
        return b" ".join(data[s[i] : e[i]].tobytes() for i in range(a, b)).decode("utf-8")


def shingle_sets(words: Words, k: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct k-word hashes of each text; of the whole text if it has fewer words; none without words."""
    grams = words.grams(k)
    for i, n in enumerate(words.count.tolist()):
        if n >= k:
            a = words.first[i]
            yield np.unique(grams[a : a + n - k + 1])
        elif n:
            yield np.array([words.whole(i)], dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)

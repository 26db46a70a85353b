"""Lexical retrieval packing.

Every document is routed to a shard by words it is likely to share with its
neighbours, and each shard gets a BM25 index over all words (64-bit hashes)
with document frequencies of the whole corpus.  Full windows are cut from long
documents at once; what remains is packed: a seed fills the window with its
best unused neighbours, the last of which is cut and goes on as the seed of
the next window.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contestlake.llm.shingles import ALNUM, Words, batches, mix, range_hashes, spread, text_bytes
from contestlake.session import run_dir

WINDOW = 1024
END_ID = 0
#: Bound on the text of one shard; a longer document is a shard of its own.
SHARD_BYTES = 5 << 20
#: Routing (and only routing) knows words by so many slots for document frequencies.
SLOT_BITS = 17
SLICE = 1 << 12
#: Bits of a route from a common and from a rarer word.
COARSE_BITS, FINE_BITS = 6, 12
#: A word is common enough to split the corpus only if less than this share of the documents has it.
COMMON = 1 / 8
K1, B = 1.2, 0.75
#: Encoded pieces that a worker remembers before it starts again, some 30 bytes each; none has more than ``LONG`` bytes.
REMEMBER = 2_000_000
LONG = 64
#: Words that the tokenizer gets in one text.
TOGETHER = 32


@cache
def tokenizer(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


#: White space other than the space and the line feed.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: How byte-level BPE writes a space.
_SPACE = "\u0120"


class Encoder:
    """Ids of byte-level BPE texts, word by word.

    The pre-tokenizer never joins what lies on both sides of a space, or of a
    line feed, that stands between two characters that are no white space.  A
    text may be cut in front of every such space, and around every such line
    feed.  Pieces are encoded once and remembered by a 64-bit hash; one of more
    than ``LONG`` bytes is encoded whenever it comes.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.spaced[[i for t, i in vocabulary.items() if t[0] == _SPACE]] = True
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, dtype=np.uint64)
        self.start, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.ids, self.used = np.zeros(1 << 16, dtype=np.uint16), 0

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Some ids, and (start, size) of each piece among them.

        Words behind a space go to the tokenizer some at a time; where the next
        begins, a token does so with its space.
        """
        words, others = [], []
        for i, p in enumerate(pieces):
            (words if p[0] == " " and p.split() == [p[1:]] else others).append(i)
        runs = [words[a : a + TOGETHER] for a in range(0, len(words), TOGETHER)]
        flat, order, first, used = [], [], [], 0
        for run, e in zip(runs, self._encoded(["".join([pieces[i] for i in r]) for r in runs])):
            begin = np.flatnonzero(self.spaced[e])
            if len(begin) != len(run) or begin[0]:
                others += run
                continue
            flat.append(e)
            order += run
            first.append(used + begin)
            used += len(e)
        for i, e in zip(others, self._encoded([pieces[i] for i in others])):
            flat.append(e)
            order.append(i)
            first.append(np.array([used]))
            used += len(e)
        start, size = np.zeros(len(pieces), dtype=np.int64), np.zeros(len(pieces), dtype=np.int64)
        if pieces:
            at = np.concatenate(first)
            start[order], size[order] = at, np.diff(at, append=used)
        return np.concatenate([np.zeros(0, np.uint16), *flat]), start, size

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint16) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Remembers new pieces, whose hashes rise."""
        flat, start, size = self._ids(pieces)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.start = np.insert(self.start, at, self.used + start)
        self.size = np.insert(self.size, at, size)
        self.used += len(flat)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.known) > REMEMBER:
            self.clear()
        data, count, hashes, sizes = [], [], [], []
        for some in batches(t.encode() for t in texts):
            data.append(b"".join(some))
            start, size, n = pieces_of(some)
            count.append(n)
            sizes.append(size)
            hashes.append(range_hashes(data[-1], start, size))
        flat = b"".join(data)
        count, hash_, size = (np.concatenate([np.zeros(0, t), *x]) for t, x in ((np.int64, count), (np.uint64, hashes), (np.int64, sizes)))
        begin = np.cumsum(size) - size
        long = np.flatnonzero(size > LONG)
        short = np.flatnonzero(size <= LONG)
        distinct, first, which = np.unique(hash_[short], return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), dtype=bool)
        if len(self.known):
            new = self.known[np.minimum(at, len(self.known) - 1)] != distinct
        if new.any():
            rows = short[first[new]]
            self._learn(distinct[new], [flat[a : a + n].decode() for a, n in zip(begin[rows].tolist(), size[rows].tolist())])
            at = np.searchsorted(self.known, distinct)
        # Long pieces stand behind what is remembered.
        extra, extra_start, extra_size = self._ids([flat[a : a + n].decode() for a, n in zip(begin[long].tolist(), size[long].tolist())])
        ids = np.concatenate([self.ids[: self.used], extra]) if len(extra) else self.ids
        from_, tokens = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
        from_[short], tokens[short] = self.start[at][which], self.size[at][which]
        from_[long], tokens[long] = self.used + extra_start, extra_size
        out = ids[spread(from_, tokens)]
        ends = np.concatenate(([0], np.cumsum(tokens)))[np.cumsum(count)]
        return np.split(out, ends[:-1]) if len(ends) else []


def pieces_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size) of the pieces that the joined texts are cut into, and how many each text has."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    n = len(data)
    feed = data == 0x0A
    white = np.ones(n + 2, dtype=bool)  # white[p + 1] is that of byte p; nothing stands outside
    white[1:-1] = feed | (data == 0x20)
    edge = np.zeros(n + 1, dtype=bool)
    edge[begin] = True
    # A white byte between two others, inside a text.
    alone = white[1:-1] & ~white[:-2] & ~white[2:] & ~edge[:-1] & ~edge[1:]
    cut = edge.copy()
    cut[:-1] |= alone
    cut[1:] |= alone & feed
    for i, t in enumerate(texts):
        text = t.decode()
        if _OTHER_SPACE.search(text):
            a, z = int(begin[i]), int(begin[i] + sizes[i])
            cut[a + 1 : z] = False
            cut[a + np.cumsum([len(p.encode()) for p in cuts(text)])[:-1]] = True
    start = np.flatnonzero(cut[:n])
    count = np.diff(np.searchsorted(start, np.append(begin, n)))
    return start, np.diff(np.append(start, n)), count


@cache
def encoder_of(path: str) -> Encoder:
    """One encoder per worker process; what it has learnt serves all its tasks."""
    return Encoder(path)


def cuts(text: str) -> list[str]:
    """The text cut in front of each space between two characters that are no white space."""
    if not text:
        return []
    parts = text.split(" ")
    out, held = [], parts[0]
    for p in parts[1:]:
        if p and not p[0].isspace() and held and not held[-1].isspace():
            out.append(held)
            held = " " + p
        else:
            held += " " + p
    out.append(held)
    return out


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _hashes(texts: list[bytes]) -> list[np.ndarray]:
    """Hashed words of each text, in order."""
    words = Words(texts, ALNUM)
    return [words.hash[a:b] for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int, float]:
    """(documents per slot, documents, mean words) of the whole table; only routing takes the slots.

    A task sends one row per slice of ``SLICE`` slots and the sums are made by
    Spark; the driver gets ``1 << SLOT_BITS`` numbers, whatever the input.
    """

    def rows(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = np.zeros(1 << SLOT_BITS, dtype=np.int64), 0, 0
        for b in arrow:
            for texts in batches(text_bytes(b.column(0))):
                words = Words(texts, ALNUM)
                both = np.sort(np.repeat(np.arange(len(texts)), words.count) << SLOT_BITS | _slot(words.hash))
                once = both[np.flatnonzero(np.diff(both, prepend=-1))]
                df += np.bincount(once & ((1 << SLOT_BITS) - 1), minlength=len(df))
                n, length = n + len(texts), length + len(words.hash)
        some = range(0, len(df), SLICE)
        yield pa.record_batch(
            [pa.array([*(i // SLICE for i in some), -1], pa.int32()),
             pa.array([*(df[i : i + SLICE].tolist() for i in some), [n, length]], pa.list_(pa.int64()))],
            names=["slice", "counts"],
        )

    sent = docs.select("text").mapInArrow(rows, "slice int, counts array<bigint>")
    added = sent.select("slice", F.posexplode("counts").alias("at", "n")).where("n > 0").groupBy("slice", "at").agg(F.sum("n").alias("n"))
    df, totals = np.zeros(1 << SLOT_BITS, dtype=np.int64), [0, 0]
    for s, at, n in added.collect():
        if s < 0:
            totals[at] = n
        else:
            df[s * SLICE + at] = n
    return df, totals[0], totals[1] / max(totals[0], 1)


def routes(texts: list[bytes], df: np.ndarray, n: int) -> np.ndarray:
    """The route of each text: bits of its most common word that still tells documents apart, then of a weighted min-hash.

    The min-hash prefers rare words that more than one document has; two texts
    agree on it with about the chance of their weighted Jaccard similarity.
    """
    words = Words(texts, ALNUM)
    some = words.count > 0
    out = np.zeros(len(texts), dtype=np.int64)
    if not some.any():
        return out
    first, seen = words.first[:-1][some], df[_slot(words.hash)]
    common = np.where((seen > 1) & (seen < COMMON * n), (seen << 20) | (words.hash >> np.uint64(44)).astype(np.int64), 0)
    weight = np.where(seen > 1, np.log(1 + (n - seen + 0.5) / (seen + 0.5)) ** 2, 0.0)
    u = ((mix(words.hash ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)
    draw = np.full(len(u), np.inf)
    np.divide(-np.log(u), weight, out=draw, where=weight > 0)
    coarse = mix(np.maximum.reduceat(common, first).astype(np.uint64)) >> np.uint64(64 - COARSE_BITS)
    fine = mix(np.minimum.reduceat(draw, first).view(np.uint64)) >> np.uint64(64 - FINE_BITS)
    out[some] = ((coarse << np.uint64(FINE_BITS)) | fine).astype(np.int64)
    return out


def shard_plan(size: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(first shard, shards) of each route, given its bytes: runs of routes up to the limit; a larger route is salted over several."""
    first, parts = np.zeros(len(size), dtype=np.int32), np.ones(len(size), dtype=np.int32)
    shard, held = 0, 0
    for i in np.flatnonzero(size).tolist():
        n = int(size[i])
        if held and held + n > limit:
            shard, held = shard + 1, 0
        first[i], parts[i] = shard, -(-n // limit)
        if n > limit:
            shard += int(parts[i])
        else:
            held += n
    return first, parts


def deal(docs: DataFrame, limit: int = SHARD_BYTES) -> tuple[DataFrame, int, float]:
    """(shard, doc_id, text) of every document, and documents and mean words of the whole table.

    The texts are written once with their routes; the driver gets the bytes of
    ``1 << COARSE_BITS + FINE_BITS`` routes.  A shard depends on the documents
    alone, not on the splits of the input.
    """
    spark = docs.sparkSession
    df, n, mean = document_frequencies(docs)

    def routed(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow:
            found = [routes(texts, df, n) for texts in batches(text_bytes(b.column(1)))]
            yield pa.record_batch([*b.columns, pa.array(np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int32))], names=["doc_id", "text", "route"])

    path = run_dir(spark, "routed")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        routed, "doc_id long, text string, route int"
    ).withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)) + 16).write.option("compression", "zstd").parquet(path)
    kept = spark.read.parquet(path)
    sums = kept.groupBy("route").agg(F.sum("bytes").alias("n")).toArrow()
    size = np.zeros(1 << (COARSE_BITS + FINE_BITS), dtype=np.int64)
    size[sums["route"].to_numpy()] = sums["n"].to_numpy()
    first, parts = shard_plan(size, limit)

    def sharded(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow:
            route, salt = b.column(2).to_numpy(), b.column(3).to_numpy()
            shard = first[route] + np.mod(salt, parts[route])
            yield pa.record_batch([pa.array(shard.astype(np.int32)), b.column(0), b.column(1)], names=["shard", "doc_id", "text"])

    dealt = kept.select("doc_id", "text", "route", F.xxhash64("doc_id", "text").alias("salt"))
    return dealt.mapInArrow(sharded, "shard int, doc_id long, text string").repartition("shard"), n, mean


def word_frequencies(dealt: DataFrame, slices: int) -> DataFrame:
    """(shard, hashes, df): words that several documents of a shard have, with the documents of the whole corpus that have them.

    Shards send their words as arrays by slice of the hash; a slice adds up
    those of all shards.  A word that a shard has only once matches nothing
    there; it is counted, but not sent back.
    """
    width = np.uint64((1 << 64) // slices + 1)

    def count(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for b in arrow:
            numbers = b.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, z in zip(edges, edges[1:]):
                if a < z:
                    if numbers[a] != shard and held:
                        yield sliced(shard, held)
                        held = []
                    shard = int(numbers[a])
                    for texts in batches(text_bytes(b.column("text").slice(a, z - a))):
                        held += [np.unique(h) for h in _hashes(texts)]
        if held:
            yield sliced(shard, held)

    def sliced(shard: int, held: list[np.ndarray]) -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(held), return_counts=True)
        at = (words // width).astype(np.int64)
        cut = np.flatnonzero(np.diff(at, prepend=-1)).tolist()
        ends = [*cut[1:], len(words)]
        return pa.record_batch(
            [pa.array(at[cut], pa.int32()), pa.array([shard] * len(cut), pa.int32()),
             pa.array([words[a:z].tobytes() for a, z in zip(cut, ends)], pa.binary()),
             pa.array([n[a:z].astype(np.int32).tobytes() for a, z in zip(cut, ends)], pa.binary())],
            names=["slice", "shard", "hashes", "n"],
        )

    def added(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in arrow:
            for s, *row in zip(*(c.to_pylist() for c in b.columns)):
                if s != now and held:
                    yield summed(held)
                    held = []
                now = s
                held.append(row)
        if held:
            yield summed(held)

    def summed(held: list[list]) -> pa.RecordBatch:
        words = [np.frombuffer(h, dtype=np.uint64) for _, h, _ in held]
        n = [np.frombuffer(c, dtype=np.int32) for _, _, c in held]
        _, at = np.unique(np.concatenate(words), return_inverse=True)
        df = np.bincount(at, np.concatenate(n)).astype(np.int64)[at]
        out, start = [], 0
        for (shard, _, _), w, c in zip(held, words, n):
            wanted = c > 1
            if wanted.any():
                out.append((shard, w[wanted].tobytes(), df[start : start + len(w)][wanted].tobytes()))
            start += len(w)
        shards, hashes, counts = zip(*out) if out else ((), (), ())
        return pa.record_batch([pa.array(shards, pa.int32()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], names=["shard", "hashes", "df"])

    # All columns are taken, so that packing reads the same shuffle of the texts again.
    sent = dealt.sortWithinPartitions("shard").mapInArrow(count, "slice int, shard int, hashes binary, n binary")
    return sent.repartition("slice").sortWithinPartitions("slice").mapInArrow(added, "shard int, hashes binary, df binary")


class Shard:
    """BM25 over the documents of one shard: postings by numbered word, and which documents are still unused.

    ``lengths`` are those of the documents with all their words; by default that of ``slots``.
    """

    def __init__(self, slots: list[np.ndarray], idf: np.ndarray, mean: float, lengths: list[int] | None = None):
        sizes = np.fromiter(map(len, slots), np.int64, len(slots))
        norm = K1 * (1 - B + B * (sizes if lengths is None else np.asarray(lengths, dtype=np.int64)) / max(mean, 1.0))
        # Documents and their words in one number, sorted: equal ones stand together.
        both = np.sort(np.repeat(np.arange(len(slots)), sizes) * len(idf) + np.concatenate([np.zeros(0, np.int64), *slots]))
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
        tf = np.diff(first, append=len(both))
        doc, term = np.divmod(both[first], max(len(idf), 1))
        self.terms = np.split(term, np.searchsorted(doc, np.arange(1, len(slots)))) if slots else []
        order = np.argsort(term, kind="stable")
        self.doc = doc[order].astype(np.int32)
        self.weight = (tf * (K1 + 1) / (tf + norm[doc]) * idf[term])[order].astype(np.float32)
        self.first = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.unused = np.ones(len(slots), dtype=bool)

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents that share a word with the seed, best first by the score over all its words; ties by position."""
        term = self.terms[seed]
        if not len(term):
            return np.zeros(0, dtype=np.int64)
        at = spread(self.first[term], self.first[term + 1] - self.first[term])
        score = np.bincount(self.doc[at], self.weight[at], minlength=len(self.unused))
        found = np.flatnonzero(self.unused & (score > 0))
        return found[np.argsort(-score[found], kind="stable")]


def pack(lengths: list[int], shard: Shard, window: int = WINDOW) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that use every token once; only the last may be shorter than the window."""
    tails = []
    for i, n in enumerate(lengths):
        for start in range(0, n - window + 1, window):
            yield [(i, start, window)]
        tails.append(n - n % window)
        shard.unused[i] = n % window > 0
    now: list[tuple[int, int, int]] = []
    room, line, after = window, iter(()), 0
    while True:
        i = next((d for d in line if shard.unused[d]), -1)
        if i < 0:  # no neighbour is left: go on with the first unused document
            while after < len(lengths) and not shard.unused[after]:
                after += 1
            if after == len(lengths):
                break
            i = after
        n = min(room, lengths[i] - tails[i])
        now.append((i, tails[i], n))
        tails[i] += n
        room -= n
        shard.unused[i] = tails[i] < lengths[i]
        if not room:
            yield now
            now, room, line = [], window, iter([i])  # what was cut off seeds the next window
        elif len(now) == 1:
            line = iter(shard.neighbours(i).tolist())
    if now:
        yield now


PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
     ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
PIECES_SQL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, limit: int = SHARD_BYTES) -> DataFrame:
    """Pieces of every document: ids (little-endian unsigned 32 bit), place in the document and in a sequence.

    A null text is empty and leaves its end id.  Repeated rows are packed
    each.  Sequence ids carry the shard in their high bits; shards and the
    order in them follow from the documents, so a task that runs again makes
    the same pieces.
    """
    dealt, n, mean = deal(docs, limit)
    slices = max(16, int(n * mean) >> 21)
    words = word_frequencies(dealt, slices)

    def packed(rows: pa.Table, sent: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.Table.from_batches([], PIECES)
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        encoder, numbers = encoder_of(tokenizer_path), rows.column("doc_id").to_pylist()
        known = np.frombuffer(b"".join(sent.column("hashes").to_pylist()), dtype=np.uint64)
        df = np.frombuffer(b"".join(sent.column("df").to_pylist()), dtype=np.int64)
        order = np.argsort(known)
        known, df = known[order], df[order]
        terms, lengths = [], []
        ids = [np.append(x, np.uint16(end_id)) for x in encoder.encode([t or "" for c in rows.column("text").chunks for t in c.to_pylist()])]
        for texts in batches(t for c in rows.column("text").chunks for t in text_bytes(c)):
            for h in _hashes(texts):
                at = np.searchsorted(known, h)
                terms.append(at[known[np.minimum(at, len(known) - 1)] == h].astype(np.int32) if len(known) else np.zeros(0, np.int32))
                lengths.append(len(h))
        shard = Shard(terms, np.log(1 + (n - df + 0.5) / (df + 0.5)), mean, lengths)
        sequence = rows.column("shard")[0].as_py() << 36
        out, done = [], []
        for pieces in pack([len(x) for x in ids], shard, window):
            offset = 0
            for i, start, length in pieces:
                out.append((numbers[i], start, length, ids[i][start : start + length].astype("<u4").tobytes(), len(ids[i]), sequence, offset))
                offset += length
            sequence += 1
            if len(out) > 2_000:
                done.append(_arrow(out))
                out = []
        # The worker lives on; what a shard took goes back to the machine.
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches([*done, _arrow(out)], PIECES)

    return dealt.groupBy("shard").cogroup(words.groupBy("shard")).applyInArrow(packed, PIECES_SQL)


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in PIECES]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, PIECES)], schema=PIECES)

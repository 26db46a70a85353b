"""Ranked lexical search over a length-stratified index.

Documents whose length gives the same normaliser m form a stratum.  Within a
stratum the postings of a term lie by term frequency, so an impact is worked
out once for all documents with that frequency, and the last one bounds the
term.  The bounds of a query order its visits: strata are scored from the
highest bound down, until the next bound is below the k-th score so far.

Scores are whole numbers and exact; nothing that could rank is skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contestlake.llm.bitmaps import contains
from contestlake.llm.shingles import ALNUM, Words, batches, spread, text_bytes
from contestlake.session import cut_lineage

TOP = 20
#: Pairs of item and term that travel to the tasks at once; more items make more blocks, each a search of its own.
BLOCK_TERMS = 1 << 18
#: Postings that a task inverts at a time.
HELD_POSTINGS = 2_000_000
#: Sums below this are exact in doubles.
EXACT = float(1 << 53)

# Fixed values of the score.
IMPACT, SLOPE = 1_000_000_000, 12
BASE, SHARE = 75, 25
WEIGHT = 1000

Arrow = Iterator[pa.RecordBatch]


def normaliser(n: int, documents: int, terms: int) -> int:
    return BASE + SHARE * n * documents // terms


def weight(documents: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return IMPACT * tf // (WEIGHT * tf + SLOPE * m)


def _item_terms(arrow: Arrow) -> Arrow:
    """(item, term, times) of each item's distinct terms."""
    for b in arrow:
        at = 0
        for texts in batches(text_bytes(b.column(1))):
            words = Words(texts, ALNUM)
            owner = np.repeat(np.arange(len(texts)), words.count)
            order = np.lexsort((words.hash, owner))
            owner, term = owner[order], words.hash[order]
            head = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])][: len(term)])
            times = np.diff(np.r_[head, len(term)])
            yield pa.record_batch(
                [b.column(0).take(pa.array(at + owner[head])), pa.array(term[head].view(np.int64)), pa.array(times.astype(np.int64))],
                names=["item", "term", "times"])
            at += len(texts)


def _bits(vocabulary: np.ndarray, bits: int = 22) -> np.ndarray:
    """Bitmap of the vocabulary, in front of the search in it."""
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    slot = vocabulary >> np.uint64(64 - bits)
    np.bitwise_or.at(out, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
    return out


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value per row of 32-bit numbers; ``ends`` are the rows' ends in ``values``."""
    offsets = np.r_[0, ends].astype(np.int32) * 4
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values.astype(np.int32))])


POSTINGS = "doc_id long, n long, terms binary, tfs binary"


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Per document its length and the numbers and frequencies of the terms that are in the sorted vocabulary."""
    bitmap = _bits(vocabulary)

    def run(arrow: Arrow) -> Arrow:
        for b in arrow:
            at = 0
            for texts in batches(text_bytes(b.column(1))):
                words, size = Words(texts, ALNUM), len(texts)
                some = np.flatnonzero(contains(bitmap, words.hash))
                place = np.searchsorted(vocabulary, words.hash[some])
                place = np.minimum(place, len(vocabulary) - 1)
                real = vocabulary[place] == words.hash[some]
                some, place = some[real], place[real]
                owner = np.searchsorted(words.first, some, side="right") - 1
                keys, tf = np.unique(owner * len(vocabulary) + place, return_counts=True)
                ends = np.searchsorted(keys, np.arange(1, size + 1) * len(vocabulary))
                yield pa.record_batch(
                    [b.column(0).slice(at, size), pa.array(words.count.astype(np.int64)),
                     _binary(keys % len(vocabulary), ends), _binary(tf, ends)],
                    names=["doc_id", "n", "terms", "tfs"])
                at += size

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, POSTINGS)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 32-bit numbers of a binary column, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(values.tobytes(), dtype=np.int32), np.diff(offsets) // 4


def statistics(index: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, terms with repeats, documents per vocabulary term)."""

    def run(arrow: Arrow) -> Arrow:
        df, documents, terms = np.zeros(size, np.int64), 0, 0
        for b in arrow:
            n = b.column(0).to_numpy()
            documents, terms = documents + int((n > 0).sum()), terms + int(n.sum())
            df += np.bincount(_numbers(b.column(1))[0], minlength=size)
        seen = np.flatnonzero(df)
        yield pa.record_batch(
            [pa.array(np.r_[-1, -2, seen].astype(np.int32)), pa.array(np.r_[documents, terms, df[seen]].astype(np.int64))], names=["term", "n"])

    found = index.select("n", "terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = found["term"].to_numpy(), found["n"].to_numpy()
    df = np.zeros(size, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    total = {int(t): int(c) for t, c in zip(term, n) if t < 0}
    return total.get(-1, 0), total.get(-2, 0), df


class Strata:
    """Inverted postings of some documents, by stratum, term and frequency."""

    def __init__(self, m: np.ndarray, terms: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, width: int):
        levels, level = np.unique(m, return_inverse=True)
        self.width, self.docs, self.levels = width, len(m), len(levels)
        doc = np.repeat(np.arange(len(m), dtype=np.int32), sizes)
        key = level[doc].astype(np.int64) * width + terms
        order = np.lexsort((tfs, key))
        key, tf, self.doc = key[order], tfs[order].astype(np.int64), doc[order]
        new = np.r_[True, key[1:] != key[:-1]][: len(key)]
        run = np.flatnonzero(new | np.r_[True, tf[1:] != tf[:-1]][: len(key)])
        once = impact(tf[run], levels[key[run] // width])
        self.impact = np.repeat(once, np.diff(np.r_[run, len(key)])).astype(np.float64)
        self.start = np.flatnonzero(new)
        self.key = key[self.start]
        self.size = np.diff(np.r_[self.start, len(key)])
        self.most = self.impact[self.start + self.size - 1] if len(key) else np.zeros(0)

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the posting list of each (stratum, term), and whether there is one."""
        wanted = np.arange(self.levels)[:, None] * self.width + terms[None, :]
        at = np.minimum(np.searchsorted(self.key, wanted), max(len(self.key) - 1, 0))
        return at, self.key[at] == wanted if len(self.key) else np.zeros(wanted.shape, bool)

    def scores(self, at: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) over some posting lists."""
        index, gains = spread(self.start[at], self.size[at]), np.repeat(weights, self.size[at])
        doc = self.doc[index]
        if float(weights.sum()) * IMPACT / WEIGHT < EXACT:
            total = np.bincount(doc, self.impact[index] * gains, minlength=self.docs)
        else:
            total = np.zeros(self.docs, dtype=np.int64)
            np.add.at(total, doc, self.impact[index].astype(np.int64) * gains)
        some = np.flatnonzero(total > 0)
        return some, total[some].astype(np.int64)


class Best:
    """The highest scores of one query so far; equal scores by smaller id, a null id last."""

    def __init__(self, top: int):
        self.top = top
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = score >= self.least
        score, ids, null = (np.concatenate(x) for x in ((self.score, score[good]), (self.id, ids[good]), (self.null, null[good])))
        if len(score) > 4 * self.top:  # only what reaches the k-th score needs sorting
            good = score >= np.partition(score, len(score) - self.top)[len(score) - self.top]
            score, ids, null = score[good], ids[good], null[good]
        order = np.lexsort((ids, null, -score))[: self.top]
        self.score, self.id, self.null = score[order], ids[order], null[order]


def visit(strata: Strata, terms: np.ndarray, weights: np.ndarray, best: Best, ids: np.ndarray, null: np.ndarray) -> int:
    """Score the strata of one query by falling bound, twice as many at each step; returns how many were visited."""
    at, there = strata.lists(terms)
    if not there.any():
        return 0
    bound = np.where(there, strata.most[at] * weights, 0).sum(axis=1)
    order = np.argsort(-bound, kind="stable")
    done, step = 0, 1
    while done < len(order):
        some = order[done : done + step]
        some = some[bound[some] >= best.least]
        if not len(some):
            break
        use = there[some]
        docs, score = strata.scores(at[some][use], np.broadcast_to(weights, use.shape)[use])
        best.add(score, ids[docs], null[docs])
        done, step = done + len(some), 2 * step
    return done


def _searched(index: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], width: int, documents: int, terms: int, top: int) -> DataFrame:
    """(item, doc_id, score): the best of every task for each query."""

    def run(arrow: Arrow) -> Arrow:
        best = [Best(top) for _ in queries]

        def score(held: list[tuple]) -> None:
            ids, null, n, terms_of, tfs, sizes = (np.concatenate(x) for x in zip(*held))
            lengths, which = np.unique(n, return_inverse=True)
            m = np.array([normaliser(int(x), documents, terms) for x in lengths], dtype=np.int64)[which]
            strata = Strata(m, terms_of, tfs, sizes, width)
            for b, (_, some, weights) in zip(best, queries):
                visit(strata, some, weights, b, ids, null)

        held, count = [], 0
        for b in arrow:
            ids = b.column(0)
            found, sizes = _numbers(b.column(2))
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False),
                         b.column(1).to_numpy(zero_copy_only=False), found, _numbers(b.column(3))[0], sizes))
            count += len(found)
            if count >= HELD_POSTINGS:
                score(held)
                held, count = [], 0
        if count:
            score(held)
        for b, (item, _, _) in zip(best, queries):
            if len(b.score):
                yield pa.record_batch(
                    [pa.array(np.full(len(b.score), item, dtype=np.int64)), pa.array(b.id, pa.int64(), mask=b.null), pa.array(b.score)],
                    names=["item", "doc_id", "score"])

    return index.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the best documents of every item.

    Items that repeat id and text are one item; items that share an id but not
    a text are ranked apart.  A null or empty text has no terms: such an item
    has no rows, such a document is not counted.  Every row of ``docs`` can
    rank, repeated rows side by side; equal scores go by doc_id, a null one
    last.  An empty table on either side gives no rows.  Other columns are not
    read.

    Documents are dealt by length, and within a length by id, so strata lie
    together and a length that many share is split.  Only the items' terms are
    indexed.  Items beyond ``block_terms`` terms are searched in blocks.
    """
    asked = items.select("item_id", "text").distinct().withColumn("item", F.xxhash64("item_id", "text"))
    pairs = cut_lineage(asked.select("item", "text").mapInArrow(_item_terms, "item long, term long, times long"))
    blocks = max(1, -(-pairs.count() // block_terms))
    parts = []
    for block in range(blocks):
        own = pairs if blocks == 1 else pairs.where(F.expr(f"pmod(xxhash64(item), {blocks}) = {block}"))
        table = own.toArrow().combine_chunks()
        if not table.num_rows:
            continue
        vocabulary, term = np.unique(table["term"].to_numpy().view(np.uint64), return_inverse=True)
        index = cut_lineage(postings(docs, vocabulary))
        documents, terms, df = statistics(index, len(vocabulary))
        weights = np.array([weight(documents, int(x)) if x else 0 for x in df], dtype=np.int64)[term] * table["times"].to_numpy()
        item = table["item"].to_numpy()
        order = np.lexsort((term, item))
        order = order[weights[order] > 0]
        heads = np.flatnonzero(np.r_[True, item[order][1:] != item[order][:-1]][: len(order)])
        queries = [(int(item[some[0]]), term[some], weights[some]) for some in np.split(order, heads[1:]) if len(some)]
        if not queries:
            continue
        dealt = index.where("n > 0").repartitionByRange("n", F.xxhash64("doc_id", "terms")).sortWithinPartitions("n")
        parts.append(_searched(dealt, queries, len(vocabulary), documents, terms, top))
    if not parts:
        parts = [pairs.limit(0).select("item", F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))]
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")

"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of an item (or a whole shorter item).
Both sides keep the smallest hash of every run of k-grams as long as a window,
so a shared window always leaves a common fingerprint.  Fingerprints are
joined, and each hit is extended to the windows that cover it, which are
compared as text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestlake.llm.bitmaps import bitmap_of, contains
from contestlake.llm.joins import null_safe
from contestlake.llm.shingles import ALNUM, Words, batches, text_bytes
from contestlake.session import cut_lineage

WINDOW = 10
GRAM = 5

Batches = Iterator[pa.RecordBatch]


def selected(words: Words, length: int, gram: int, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers, hashes) of the winnowed k-grams for windows of ``length`` words.

    A k-gram is kept if it is the smallest of some run of ``length - k + 1``
    k-grams inside one text.  ``among`` is a bitmap that a hash must be in.
    """
    k = min(gram, length)
    run = length - k + 1
    grams = words.grams(k)
    ends = np.repeat(words.first[1:], words.count)[: len(grams)]
    at = np.arange(len(grams))
    at = at[at + k <= ends]
    hashes = grams ^ np.uint64(length)  # lengths do not share fingerprints
    if among is not None:
        at = at[contains(among, hashes[at])]
    if not len(at):
        return at, hashes[:0]
    starts = np.repeat(words.first[:-1], words.count)
    keep = np.zeros(len(at), dtype=bool)
    # Smallest of the grams just before and just after, one step further out at a time.
    for first in range(-run + 1, 1):
        s = at + first
        ok = (s >= starts[at]) & (s + length <= ends[at])
        least = np.full(len(at), np.iinfo(np.uint64).max, dtype=np.uint64)
        for j in range(run):
            least = np.minimum(least, hashes[np.clip(s + j, 0, len(hashes) - 1)])
        keep |= ok & (least == hashes[at])
    at = at[keep]
    return at, hashes[at]


BENCH = "item_id string, length int, window string, print long"


def _item_rows(window: int, gram: int) -> Callable[[Batches], Batches]:
    schema = pa.schema([("item_id", pa.string()), ("length", pa.int32()), ("window", pa.string()), ("print", pa.int64())])

    def run(arrow: Batches) -> Batches:
        for batch in arrow:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = Words([text or b""], ALNUM)
                n = len(words.hash)
                if not n:
                    continue
                length = min(window, n)
                rows += [(item, length, words.phrase(s, s + length), None) for s in range(n - length + 1)]
                rows += [(item, length, None, p) for p in selected(words, length, gram)[1].astype(np.int64).tolist()]
            columns = list(zip(*rows)) or [[] for _ in schema]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


DOCS = "doc_id long, text_key long, n_words long, hits array<struct<length: int, print: long, start: int, context: string>>"


def _doc_rows(lengths: list[int], gram: int, bitmap: np.ndarray) -> Callable[[Batches], Batches]:
    hit = pa.struct([("length", pa.int32()), ("print", pa.int64()), ("start", pa.int32()), ("context", pa.string())])

    def run(arrow: Batches) -> Batches:
        for batch in arrow:
            ids, keys = batch.column(0), batch.column(1)
            at = 0
            for texts in batches(text_bytes(batch.column(2))):
                words = Words(texts, ALNUM)
                hits: list[list[dict]] = [[] for _ in texts]
                for length in lengths:
                    found, prints = selected(words, length, gram, bitmap)
                    owner = np.searchsorted(words.first, found, side="right") - 1
                    k = min(gram, length)
                    for w, p, i in zip(found.tolist(), prints.astype(np.int64).tolist(), owner.tolist()):
                        a = max(int(words.first[i]), w + k - length)
                        b = min(int(words.first[i + 1]), w + length)
                        hits[i].append({"length": length, "print": p, "start": a - int(words.first[i]), "context": words.phrase(a, b)})
                size = len(texts)
                yield pa.record_batch(
                    [ids.slice(at, size), keys.slice(at, size), pa.array(words.count, pa.int64()), pa.array(hits, pa.list_(hit))],
                    names=["doc_id", "text_key", "n_words", "hits"],
                )
                at += size

    return run


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items, contaminated for every document.

    ``items`` are the distinct ids (as strings, sorted) of items of which a
    window occurs.  A null text has no words, and an item without words has no
    windows; an item without an id marks words but is not listed.  Repeated
    rows get a row each.  Documents are known by id and text, so rows that
    share an id but not a text are judged apart.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    bench = cut_lineage(items.mapInArrow(_item_rows(window, gram), BENCH))
    prints = bench.where("print is not null").select("length", "print").distinct()
    lengths = sorted(r[0] for r in bench.select("length").distinct().collect())  # at most ``window`` numbers
    bitmap = bitmap_of(prints, F.col("print"))
    source = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    found = cut_lineage(source.mapInArrow(_doc_rows(lengths, gram, bitmap), DOCS))

    key = ["doc_id", "text_key"]
    hits = found.select(*key, F.explode("hits").alias("hit")).select(*key, "hit.*").distinct()
    hits = hits.join(prints, ["length", "print"], "left_semi")
    context = hits.select(*key, "length", "start", F.split("context", " ").alias("words"))
    spread = context.select(*key, "length", "start", "words", F.explode(F.expr("sequence(0, size(words) - length)")).alias("j"))
    covering = spread.select(
        *key, "length", (F.col("start") + F.col("j")).alias("start"),
        F.array_join(F.expr("slice(words, j + 1, length)"), " ").alias("window"),
    ).distinct()
    windows = bench.where("window is not null").select("length", "window", "item_id").distinct()
    occurring = cut_lineage(covering.join(windows.select("length", "window").distinct(), ["length", "window"]))
    places = occurring.select(*key, F.explode(F.expr("sequence(start, start + length - 1)")).alias("word")).distinct()
    counted = places.groupBy(*key).agg(F.count(F.lit(1)).alias("n_hit"))
    listed = occurring.select(*key, "length", "window").distinct().join(windows, ["length", "window"])
    listed = listed.select(*key, "item_id").distinct().groupBy(*key).agg(F.sort_array(F.collect_set("item_id")).alias("items"))

    joined = null_safe(null_safe(found.drop("hits"), counted, key), listed, key)
    none = F.array().cast("array<string>")
    return joined.select(
        *key, "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any hit, with all their columns."""
    dirty = find(docs, benchmark).where("contaminated").select(
        F.col("doc_id").alias("dirty_id"), F.col("text_key").alias("dirty_key")
    ).distinct()
    same = docs["doc_id"].eqNullSafe(dirty["dirty_id"]) & (F.xxhash64(docs["text"]) == dirty["dirty_key"])
    return docs.join(dirty, same, "left_anti")

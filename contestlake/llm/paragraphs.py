"""Substring dedup by MinHash bands over paragraphs.

A paragraph is a line of at least ``MIN_WORDS`` words.  Paragraphs that
collide in a band are chained into clusters, clusters are verified by the exact
Jaccard similarity of their 5-word shingles, and the connected components of
the verified links are the groups of copies.  A paragraph goes if its group has
one in a document with a smaller id.

Passages also repeat inside lines, or over short ones.  Lines are therefore cut
behind closing marks into sentences: one of ``MIN_WORDS`` words that stands
word for word in a document with a smaller id goes as well, and a shorter one
goes with a neighbour that does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contestlake.llm.bitmaps import bitmap_of, contains
from contestlake.llm.components import components
from contestlake.llm.jaccard import PERCENT, SHINGLE, verified_links
from contestlake.llm.joins import null_safe
from contestlake.llm.shingles import Words, batches, mix, spread, text_bytes
from contestlake.session import cut_lineage

MIN_WORDS = 10
RECALL = 0.9999
#: Signatures that a task remembers while it sends bands.
HELD_NODES = 100_000
#: Share of pairs at ``FAR`` similarity that may collide.
NOISE, FAR = 0.15, 0.2

Arrow = Iterator[pa.RecordBatch]


def tune(threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bands, rows): the fewest bands that find a pair at the threshold with this chance, without too much noise."""
    best = None
    for rows in range(1, 9):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        noise = 1 - (1 - FAR**rows) ** bands
        if noise <= NOISE and (best is None or bands < best[0]):
            best = bands, rows
    return best


def band_keys(flat: np.ndarray, start: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per set and band, from ``bands * rows`` minimum hashes; a set begins at each ``start``."""
    out = np.zeros((len(start), bands), dtype=np.uint64)
    seeds = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    for i, seed in enumerate(seeds):
        least = np.minimum.reduceat((flat ^ (seed >> np.uint64(7))) * seed, start)
        band = i // rows
        out[:, band] = mix(out[:, band] + least + np.uint64(band + 1))
    return out


def _paragraphs(text: str) -> list[tuple[int, int, int, bytes]]:
    """(number, start, end in code points, bytes) of every line that is not empty."""
    out, at = [], 0
    for i, line in enumerate(text.split("\n")):
        if line:
            out.append((i, at, at + len(line), line.encode()))
        at += len(line) + 1
    return out


class Sets:
    """Shingle sets of the paragraphs in some lines: ``line`` says which they are; ``flat`` has the shingles, distinct in each, ``start`` and ``size`` where."""

    def __init__(self, lines: list[bytes], min_words: int):
        words = Words(lines)
        self.line = np.flatnonzero(words.count >= max(min_words, 1))
        n = words.count[self.line]
        grams, long = words.grams(SHINGLE), n >= SHINGLE
        size = np.where(long, n - SHINGLE + 1, 1)
        place = spread(words.first[self.line], np.where(long, size, 0))
        every = np.empty(int(size.sum()), dtype=np.uint64)
        owner = np.repeat(np.arange(len(size)), size)
        every[long[owner]] = grams[place]
        if not long.all():
            every[~long[owner]] = [words.whole(i) for i in self.line[~long].tolist()]
        # One sort brings equal shingles of a paragraph together: its number above, the shingle's high bits below.
        bits = max(int(len(size)).bit_length(), 1)
        order = np.argsort((owner.astype(np.uint64) << np.uint64(64 - bits)) | (every >> np.uint64(bits)))
        every, owner = every[order], owner[order]
        new = np.ones(len(every), dtype=bool)
        new[1:] = (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])
        self.flat = every[new]
        self.size = np.bincount(owner[new], minlength=len(size))
        self.start = np.cumsum(self.size) - self.size

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each set, as ``signature`` has them."""
        if not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a = np.add.reduceat(mix(self.flat + np.uint64(1)), self.start)
        b = np.add.reduceat(mix(self.flat ^ np.uint64(0x5851F42D4C957F2D)), self.start)
        return a.view(np.int64), b.view(np.int64)

    def of(self, i: int) -> np.ndarray:
        """Sorted shingles of one set."""
        return np.sort(self.flat[self.start[i] : self.start[i] + self.size[i]])


def _runs(batch: pa.RecordBatch, min_words: int) -> Iterator[tuple[range, list[int], list[tuple], np.ndarray, Sets]]:
    """Per run of documents: their rows in the batch, how many lines each has, all lines, the row of each line, and the sets."""
    at = 0
    for texts in batches(text_bytes(batch.column("text"))):
        lines, counts = [], []
        for text in texts:
            some = _paragraphs(text.decode("utf-8"))
            counts.append(len(some))
            lines += some
        rows = range(at, at + len(texts))
        yield rows, counts, lines, np.repeat(np.arange(at, at + len(texts)), counts), Sets([x[3] for x in lines], min_words)
        at += len(texts)


LISTED = "doc_id long, text_key long, par int, start int, stop int, n int, sig_a long, sig_b long"


def _listing(min_words: int):
    """A row per paragraph; one with par = -1 per document, whose n counts all paragraphs."""

    def run(arrow: Arrow) -> Arrow:
        for b in arrow:
            for rows, counts, lines, owner, sets in _runs(b, min_words):
                a, z = sets.signatures()
                some = [lines[i] for i in sets.line.tolist()]
                at = pa.array(np.r_[np.arange(rows.start, rows.stop), owner[sets.line]].astype(np.int64))
                head = len(rows)
                columns = [pa.array([-1] * head + [x[0] for x in some], pa.int32())]
                columns += [pa.array([None] * head + [x[k] for x in some], pa.int32()) for k in (1, 2)]
                columns.append(pa.array(np.r_[counts, sets.size].astype(np.int32)))
                blank = np.r_[np.ones(head, bool), np.zeros(len(some), bool)]
                columns += [pa.array(np.r_[np.zeros(head, np.int64), x], mask=blank) for x in (a, z)]
                names = ["doc_id", "text_key", "par", "start", "stop", "n", "sig_a", "sig_b"]
                yield pa.record_batch([b.column("doc_id").take(at), b.column("text_key").take(at), *columns], names=names)

    return run


def _bands(min_words: int, bands: int, rows: int):
    """(key, n, node) of each paragraph and band; the node is the first half of its signature.

    A task sends the copies of a paragraph once, so a line that very many
    documents repeat makes as many rows as there are tasks.  It remembers
    ``HELD_NODES`` signatures before it starts again.
    """

    def run(arrow: Arrow) -> Arrow:
        known: set[int] = set()
        for b in arrow:
            for _, _, _, _, sets in _runs(b, min_words):
                nodes, at = np.unique(sets.signatures()[0], return_index=True)
                fresh = [x not in known for x in nodes.tolist()]
                nodes, at = nodes[fresh], at[fresh]
                if len(known) > HELD_NODES:
                    known = set()
                known.update(nodes.tolist())
                if len(nodes):
                    size = sets.size[at]
                    flat = sets.flat[spread(sets.start[at], size)]
                    keys = band_keys(flat, np.cumsum(size) - size, bands, rows).astype(np.int64).reshape(-1)
                    n, node = np.repeat(size.astype(np.int32), bands), np.repeat(nodes, bands)
                    yield pa.record_batch([pa.array(keys), pa.array(n), pa.array(node)], names=["key", "n", "node"])

    return run


def _collisions(percent: int):
    """Neighbours in a band, of rows sorted by key, size and node; sizes that rule a pair out break the chain."""

    def run(arrow: Arrow) -> Arrow:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
        for b in arrow:
            key, n, node = (np.concatenate([h, b.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held))
            i = np.flatnonzero((key[1:] == key[:-1]) & (node[1:] != node[:-1]) & (n[:-1] * 100 >= percent * n[1:]))
            held = [key[-1:], n[-1:], node[-1:]]
            low, high = np.minimum(node[i], node[i + 1]), np.maximum(node[i], node[i + 1])
            if len(i):
                both = np.unique(np.stack([low, high]), axis=1)
                yield pa.record_batch([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    return run


def _grams(min_words: int, wanted_docs: np.ndarray, wanted: np.ndarray):
    """Shingles of the paragraphs that may stand for a class in some cluster."""

    def run(arrow: Arrow) -> Arrow:
        for b in arrow:
            hashes = b.column("id_hash").to_numpy(zero_copy_only=False).view(np.uint64)
            b = b.filter(pa.array(contains(wanted_docs, hashes)))
            ids, keys = b.column("doc_id").to_pylist(), b.column("text_key").to_pylist()
            for _, _, lines, owner, sets in _runs(b, min_words):
                a, z = sets.signatures()
                some = np.flatnonzero(contains(wanted, a.view(np.uint64)))
                if len(some):
                    line = sets.line[some]
                    node = [f"{ids[r]}:{lines[i][0]}:{keys[r]}" for i, r in zip(line.tolist(), owner[line].tolist())]
                    yield pa.record_batch(
                        [pa.array(node, pa.string()), pa.array(a[some]), pa.array(z[some]), pa.array([sets.of(i).tobytes() for i in some.tolist()], pa.binary())],
                        names=["node", "sig_a", "sig_b", "grams"])

    return run


# ---------------------------------------------------------------- sentences

_END = np.zeros(256, dtype=bool)
_END[[0x21, 0x2E, 0x3F]] = True
_PLACE = np.uint64(0xD1342543DE82EF95)


class Sentences:
    """Sentences of some texts: runs of words up to a closing mark or the end of the line.

    ``owner`` is the text, ``number`` the place among its sentences, ``count``
    the words, ``key`` and ``other`` two hashes of the lower-cased words in
    order, ``start`` and ``stop`` code points.
    """

    def __init__(self, texts: list[bytes]):
        words = Words(texts)
        n = len(words.hash)
        line = np.cumsum(words.data == 0x0A)[words.start] if n else np.zeros(0, dtype=np.int64)
        new = np.ones(n, dtype=bool)
        new[1:] = (line[1:] != line[:-1]) | _END[words.data[words.end[:-1] - 1]]
        first = np.flatnonzero(new)
        self.count = np.diff(np.r_[first, n])
        place = np.arange(n) - np.repeat(first, self.count)
        at = words.hash + place.astype(np.uint64) * _PLACE
        total = lambda x: np.add.reduceat(mix(x), first) if n else x
        self.key, self.other = mix(total(at) + self.count.astype(np.uint64)), total(at ^ _PLACE)
        self.owner = np.searchsorted(words.first, first, side="right") - 1
        opens = np.searchsorted(self.owner, np.arange(len(texts)))
        self.number = np.arange(len(first)) - opens[self.owner]
        points = np.r_[0, np.cumsum((words.data & 0xC0) != 0x80)]
        base = points[words.text_start[self.owner]]
        self.start = points[words.start[first]] - base
        self.stop = points[words.end[first + self.count - 1]] - base


def _sentence_keys(arrow: Arrow) -> Arrow:
    """Hash of each sentence, twice if the run of texts has it in two of them."""
    for b in arrow:
        for texts in batches(text_bytes(b.column(0))):
            s = Sentences(texts)
            order = np.lexsort((s.owner, s.key))
            key, owner = s.key[order], s.owner[order]
            once = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])][: len(key)]
            found, n = np.unique(key[once], return_counts=True)
            yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], names=["key", "n"])


SENTENCES = "doc_id long, text_key long, number int, start int, stop int, words int, sig_a long, sig_b long"


def _shared_sentences(shared: np.ndarray):
    """The sentences whose hash is in the bitmap."""

    def run(arrow: Arrow) -> Arrow:
        for b in arrow:
            at = 0
            for texts in batches(text_bytes(b.column("text"))):
                s = Sentences(texts)
                some = np.flatnonzero(contains(shared, s.key))
                rows = pa.array(at + s.owner[some])
                numbers = [pa.array(x[some].astype(np.int32)) for x in (s.number, s.start, s.stop, s.count)]
                hashes = [pa.array(x[some].view(np.int64)) for x in (s.key, s.other)]
                yield pa.record_batch([b.column("doc_id").take(rows), b.column("text_key").take(rows), *numbers, *hashes],
                                      names=["doc_id", "text_key", "number", "start", "stop", "words", "sig_a", "sig_b"])
                at += len(texts)

    return run


def repeated_sentences(named: DataFrame, lines: DataFrame, min_words: int) -> DataFrame:
    """doc_id, text_key, start, stop, first_doc of sentences that go.

    ``lines`` are the paragraphs that go; they count as neighbours.  Runs of
    repeated sentences are told by their numbers, so only those travel.
    """
    keys = named.select("text").mapInArrow(_sentence_keys, "key long, n int").groupBy("key").agg(F.sum("n").alias("n"))
    shared = bitmap_of(keys.where("n > 1"), F.col("key"), 24)
    found = cut_lineage(named.mapInArrow(_shared_sentences(shared), SENTENCES))
    classes = found.groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    # Written, so that the join has nothing but rows on both sides and Spark can split a sentence that very many documents repeat.
    classes = cut_lineage(classes.where("first_doc < last_doc").drop("last_doc"))
    again = found.join(classes, ["sig_a", "sig_b"]).where("doc_id > first_doc").drop("sig_a", "sig_b")
    key = ["doc_id", "text_key"]
    again = again.unionByName(lines.select(*key, F.lit(None).cast("int").alias("number"), "start", "stop", F.lit(0).alias("words"), "first_doc"))
    # A sentence inside a paragraph that goes is as good as one that goes itself.
    reach = Window.partitionBy(*key).orderBy("start", F.desc("stop"), F.asc_nulls_first("number")).rowsBetween(Window.unboundedPreceding, 0)
    covered = F.coalesce(F.max(F.when(F.col("number").isNull(), F.col("stop"))).over(reach) >= F.col("stop"), F.lit(False))
    placed = again.withColumn("covered", covered).where("number is not null").dropDuplicates([*key, "number"])
    run = F.col("number") - F.row_number().over(Window.partitionBy(*key).orderBy("number"))
    placed = placed.withColumn("run", run)
    strong = F.max(F.col("covered") | (F.col("words") >= min_words)).over(Window.partitionBy(*key, "run"))
    return placed.withColumn("strong", strong).where(F.col("strong") & ~F.col("covered")).select(*key, "start", "stop", "first_doc")


def copies(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """What goes from every document, and a row without a span per document.

    Columns: doc_id, text_key, start, stop (code points; null in the
    document's own row) and first_doc (smallest id with a copy).  A null text
    loses nothing; a document without an id is listed, but neither removes nor
    loses anything; rows that share an id do not remove each other's words.
    """
    bands, rows = tune(percent / 100)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    listed = cut_lineage(source.mapInArrow(_listing(min_words), LISTED))
    named = source.where("doc_id is not null")
    whole = listed.where("par >= 0 and doc_id is not null")
    classes = cut_lineage(
        whole.groupBy("sig_a", "sig_b")
        .agg(F.min(F.struct("doc_id", "par", "text_key")).alias("at"), F.max("n").alias("n"))
        .select("sig_a", "sig_b", "n", F.col("at.doc_id").alias("first"), F.concat_ws(":", "at.doc_id", "at.par", "at.text_key").alias("node"))
    )
    dealt = named.mapInArrow(_bands(min_words, bands, rows), "key long, n int, node long")
    dealt = dealt.repartition("key").sortWithinPartitions("key", "n", "node")
    held = components(dealt.mapInArrow(_collisions(percent), "a long, b long"))
    held = held.union(held.select("root", "root")).distinct().select(F.col("node").alias("sig_a"), F.col("root").alias("cluster"))
    plan = cut_lineage(classes.join(held, "sig_a").select("node", "first", "sig_a", "sig_b", "cluster", "n"))
    docs_wanted = bitmap_of(plan, F.xxhash64("first"))
    wanted = bitmap_of(plan, F.col("sig_a"))
    sets = named.withColumn("id_hash", F.xxhash64("doc_id")).mapInArrow(
        _grams(min_words, docs_wanted, wanted), "node string, sig_a long, sig_b long, grams binary"
    )
    roots = components(verified_links(sets, plan.drop("first"), percent)).withColumnRenamed("node", "at")
    grouped = classes.join(roots, classes["node"] == roots["at"], "left").withColumn("group", F.coalesce("root", "node"))
    firsts = grouped.groupBy("group").agg(F.min("first").alias("first_doc"))
    grouped = grouped.select("sig_a", "sig_b", "group").join(firsts, "group").select("sig_a", "sig_b", "first_doc")
    lines = whole.join(grouped, ["sig_a", "sig_b"]).where("doc_id > first_doc").select("doc_id", "text_key", "start", "stop", "first_doc")
    lines = cut_lineage(lines)
    none = F.lit(None)
    heads = listed.where("par < 0").select(
        "doc_id", "text_key", none.cast("int").alias("start"), none.cast("int").alias("stop"), none.cast("long").alias("first_doc"))
    return heads.unionByName(lines).unionByName(repeated_sentences(named, lines, min_words))


def per_document(found: DataFrame) -> DataFrame:
    """doc_id, n_removed, removed (spans) and duplicate_of; rows that repeat id and text are one."""
    gone = F.when(F.col("start").isNotNull(), F.struct("start", "stop"))
    spans = found.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(gone)).alias("spans"), F.sort_array(F.collect_set("first_doc")).alias("duplicate_of"))
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")
    return spans.select("doc_id", F.size("spans").cast("long").alias("n_removed"), joined.alias("removed"), "duplicate_of")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without some sorted spans; a line of which nothing but white space stays goes as a whole."""
    out, begin, i = [], 0, 0
    for line in text.split("\n"):
        end, at, kept = begin + len(line), begin, []
        while i < len(spans) and spans[i][0] < end:
            kept.append(text[at : max(at, spans[i][0])])
            at = max(at, spans[i][1])
            i += 1
        rest = "".join([*kept, text[at:end]])
        if not kept or rest.strip():
            out.append(rest)
        begin = end + 1
    return "\n".join(out)


def cut_copies(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with what repeats cut out of ``text``, all columns kept."""
    gone = copies(docs, percent, min_words).where("start is not null").groupBy("doc_id", F.col("text_key").alias("_text_key"))
    gone = gone.agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("_gone"))
    keyed = null_safe(docs.withColumn("_text_key", F.xxhash64("text")), gone, ["doc_id", "_text_key"])
    names, at = docs.columns, docs.columns.index("text")

    def run(arrow: Arrow) -> Arrow:
        for b in arrow:
            columns, spans = list(b.columns[:-1]), b.column(len(names)).to_pylist()
            texts = [t if not s else without(t, [(x["start"], x["stop"]) for x in s]) for t, s in zip(columns[at].to_pylist(), spans)]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.record_batch(columns, names=names)

    return keyed.select(*names, "_gone").mapInArrow(run, docs.schema)

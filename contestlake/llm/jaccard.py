"""N-gram Jaccard join as a blocked product of sparse matrices.

Rows are distinct sets of word shingles, columns are shingles.  Only pairs
that can reach the threshold enter the product:

* shingles have one order for all sets: seldom ones (by a sketch of counts over
  all documents) by hash, then the frequent ones by hash;
* a set of ``n`` shingles enters its first ``n - need(n) + extra(n)`` columns;
  two sets over the threshold share ``extra`` of them at least, so pairs with
  fewer are discarded, as are pairs whose sizes alone rule them out;
* columns with many similar sizes do not list pairs: their sets, sorted by size, are
  chained, which keeps any two that may be similar in one cluster.

Each cluster then multiplies its full rows block by block, and hands on only
links that connect what was not connected yet.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestlake.llm.bitmaps import bitmap_of, contains, split_by_bitmap
from contestlake.llm.components import components
from contestlake.llm.shingles import Words, batches, mix, shingle_sets, spread, text_bytes
from contestlake.session import cut_lineage, release

SHINGLE = 5
PERCENT = 80
#: Cells of the sketch of shingle counts, and cells sent as one row.
SKETCH_BITS = 20
SLICE = 1 << 12
#: A column with more pairs of similar size than this is chained; pairs are listed below.
LISTED = 600
#: Rows of an unfinished column that a task keeps before it chains them.
HELD = 20_000
#: Bytes of one block of rows in the product.
BLOCK_BYTES = 16 << 20
#: Bits of the bitmap of the documents whose full rows are sent.
WANTED_BITS = 24
#: Low bits of a column key: whether it is frequent, and part of a frequent one.
SALTS = 31

PROFILE = "row_id long, n int, sig_a long, sig_b long, slice int, counts binary"
PROFILE_NAMES = ["row_id", "n", "sig_a", "sig_b", "slice", "counts"]

Arrow = Iterator[pa.RecordBatch]


def need(n, percent: int = PERCENT):
    """Fewest common shingles of a set of ``n`` with any set over the threshold."""
    return -(-percent * n // 100)


def extra(n):
    """Common columns that two sets over the threshold have at least, the smaller being of size ``n``."""
    return 1 + n // 25


def signature(grams: np.ndarray) -> tuple[int, int]:
    """Two sums over mixed hashes: 128 bits that tell sets apart."""
    a, b = mix(grams + np.uint64(1)).sum(dtype=np.uint64), mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return tuple(np.array([a, b], dtype=np.uint64).astype(np.int64).tolist())


def _sets(batch: pa.RecordBatch, at: str = "text") -> Iterator[np.ndarray]:
    for texts in batches(text_bytes(batch.column(at))):
        yield from shingle_sets(Words(texts), SHINGLE)


def _profiles(arrow: Arrow) -> Arrow:
    """Size and signature of each row's set; at the end the sketch of this task, in slices."""
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for b in arrow:
        ns, sig = [], []
        for texts in batches(text_bytes(b.column("text"))):
            sets = list(shingle_sets(Words(texts), SHINGLE))
            ns += [len(g) for g in sets]
            sig += [signature(g) for g in sets]
            cells = (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
            sketch += np.bincount(cells, minlength=len(sketch))
        if ns:
            yield pa.record_batch(
                [b.column("row_id"), pa.array(ns, pa.int32()), pa.array([x for x, _ in sig], pa.int64()),
                 pa.array([y for _, y in sig], pa.int64()), pa.nulls(len(ns), pa.int32()), pa.nulls(len(ns), pa.binary())],
                names=PROFILE_NAMES)
    k = len(sketch) // SLICE
    if sketch.any():
        cells = np.minimum(sketch, np.iinfo(np.int32).max).astype(np.int32).reshape(k, SLICE)
        yield pa.record_batch(
            [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
             pa.array(range(k), pa.int32()), pa.array([zlib.compress(c.tobytes(), 1) for c in cells], pa.binary())],
            names=PROFILE_NAMES)


def _frequent(arrow: Arrow) -> Arrow:
    """Sum the sketches of a slice as they stream in, and set the bits of cells well above the middle."""
    out: dict[int, np.ndarray] = {}
    for b in arrow:
        for s, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            cells = np.frombuffer(zlib.decompress(counts), dtype=np.int32)
            out[s] = out[s] + cells if s in out else cells.astype(np.int64)
    bits = []
    for cells in out.values():
        middle = np.median(cells)
        bits.append(np.packbits(cells > middle + np.sqrt(middle) + 2, bitorder="little").tobytes())
    yield pa.record_batch([pa.array(list(out), pa.int32()), pa.array(bits, pa.binary())], names=["slice", "bits"])


def frequent_bitmap(sketches: DataFrame) -> np.ndarray:
    """Bitmap of the cells with more shingles than most; ``1 << SKETCH_BITS`` bits reach the driver."""
    rows = sketches.repartition("slice").mapInArrow(_frequent, "slice int, bits binary").collect()
    out = np.zeros(1 << (SKETCH_BITS - 6), dtype=np.uint64)
    for r in rows:
        out[r["slice"] * SLICE // 64 : (r["slice"] + 1) * SLICE // 64] = np.frombuffer(r["bits"], dtype=np.uint64)
    return out


def _columns(frequent: np.ndarray, percent: int):
    """The columns that each set enters: (key, n, node). A key's low six bits are 0, or 32 and a salt if it is frequent."""

    def rows(arrow: Arrow) -> Arrow:
        for b in arrow:
            keys, sizes, nodes = [], [], []
            for grams in _sets(b):
                n = len(grams)
                if not n:
                    continue
                node = signature(grams)[0]
                often = contains(frequent, grams)
                ordered = np.concatenate([grams[~often], grams[often]])
                seldom = n - int(often.sum())
                p = min(n, n - need(n, percent) + extra(n))
                key = mix(ordered[:p]) & ~np.uint64(63)
                key[seldom:] |= np.uint64(32 | (node % SALTS))
                keys.append(key.astype(np.int64))
                sizes.append(np.full(p, n, dtype=np.int32))
                nodes.append(np.full(p, node, dtype=np.int64))
            if keys:
                yield pa.record_batch(
                    [pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(nodes))],
                    names=["key", "n", "node"])

    return rows


def _pairs(percent: int):
    """Candidates from rows sorted by key, size and node: (a, b, n of the smaller, common columns).

    Chained columns give neighbours with a count that passes any bound.  The
    first node of each part of a frequent column comes out with the column's
    key and n = -1, to be tied to the other parts.
    """
    enough = 1 << 30

    def close(key, n, node, big: bool, out: list) -> None:
        """Vectorised over whole columns; ``big``: the last part of a long column, to be chained."""
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, n, node = key[new], n[new], node[new]
        if not len(key):
            return
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        column = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
        # Rows are sorted by column and size: similar sizes are a run behind each row.
        scale = int(n.max()) * 100 + 1
        last = np.searchsorted(column * scale + n, column * scale + n.astype(np.int64) * 100 // percent, side="right")
        behind = last - np.arange(len(key)) - 1
        pairs = np.add.reduceat(behind, first)[column]
        salted = (key & 32) != 0
        chained = salted | (pairs > LISTED) | big
        i = np.flatnonzero(~chained & (behind > 0))
        if len(i):
            x = np.repeat(i, behind[i])
            y = x + 1 + spread(np.zeros(len(i), dtype=np.int64), behind[i])
            out.append((node[x], node[y], n[x], np.ones(len(x), dtype=np.int32)))
        i = np.flatnonzero(chained[:-1] & (key[1:] == key[:-1]) & (salted[:-1] | (n[:-1] * 100 >= percent * n[1:])))
        if len(i):
            out.append((node[i], node[i + 1], n[i], np.full(len(i), enough, dtype=np.int32)))
        i = first[salted[first]]
        if len(i) and not big:
            out.append((key[i] & ~63, node[i], np.full(len(i), -1, dtype=np.int32), np.zeros(len(i), dtype=np.int32)))

    def batch_of(out: list) -> pa.RecordBatch:
        a, b, n, count = (np.concatenate(c) for c in zip(*out))
        low, high = np.minimum(a, b), np.maximum(a, b)
        tie = n < 0
        low[tie], high[tie] = a[tie], b[tie]
        order = np.lexsort((n, high, low))
        low, high, n, count = low[order], high[order], n[order], count[order]
        first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (n[1:] != n[:-1])])
        count = np.minimum(np.add.reduceat(count.astype(np.int64), first), enough).astype(np.int32)
        return pa.record_batch([pa.array(low[first]), pa.array(high[first]), pa.array(n[first]), pa.array(count)], names=["a", "b", "n", "common"])

    def rows(arrow: Arrow) -> Arrow:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
        inside = False  # the held rows go on with a column whose beginning has been chained
        for b in arrow:
            key, n, node = (np.concatenate([h, b.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held))
            out: list = []
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if inside:
                end = int(np.searchsorted(key, key[0], side="right"))
                close(key[:end], n[:end], node[:end], True, out)
                if end == len(key):
                    held = [key[-1:], n[-1:], node[-1:]]
                    if out:
                        yield batch_of(out)
                    continue
                key, n, node, last, inside = key[end:], n[end:], node[end:], max(last - end, 0), False
            close(key[:last], n[:last], node[:last], False, out)
            key, n, node = key[last:], n[last:], node[last:]
            if len(key) > HELD:
                if key[0] & 32:
                    out.append((key[:1] & ~63, node[:1], np.full(1, -1, np.int32), np.zeros(1, np.int32)))
                close(key, n, node, True, out)
                key, n, node, inside = key[-1:], n[-1:], node[-1:], True
            held = [key, n, node]
            if out:
                yield batch_of(out)
        out = []
        close(*held, inside, out)
        if out:
            yield batch_of(out)

    return rows


def candidate_edges(columns: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): pairs of nodes that clusters must keep together.

    Listed pairs grow faster than the input, one row per common column; only
    their sums are written.
    """
    dealt = columns.repartition("key").sortWithinPartitions("key", "n", "node")
    found = dealt.mapInArrow(_pairs(percent), "a long, b long, n int, common int")
    summed = found.groupBy("a", "b").agg(F.sum("common").alias("common"), F.min("n").alias("n"))
    kept = cut_lineage(summed.where("n < 0 or common >= 1 + n div 25").select("a", "b", "n"))
    pairs = kept.where("n >= 0").select("a", "b")
    parts = kept.where("n < 0").select(F.col("a").alias("column"), "b")
    head = parts.groupBy("column").agg(F.min("b").alias("a"))
    return pairs.union(parts.join(head, "column").select("a", "b"))


def _product(percent: int, kind: pa.DataType):
    """Links within (cluster, i, j): rows of block i against rows of block j, as they stream in sorted."""

    def links(rows: list[tuple]) -> list[tuple]:
        m = len(rows)
        node = [r[1] for r in rows]
        side = np.array([r[0] for r in rows])
        size = np.array([len(r[2]) for r in rows])
        owner = np.repeat(np.arange(m), size)
        order = np.argsort(np.concatenate([r[2] for r in rows]), kind="stable")
        flat = np.concatenate([r[2] for r in rows])[order]
        owner = owner[order]
        first = np.r_[True, flat[1:] != flat[:-1]]
        start = np.flatnonzero(first)
        count = np.diff(np.r_[start, len(flat)])
        column = np.cumsum(first) - 1
        shared = count[column] > 1  # columns of one row add nothing
        by_row = np.argsort(owner[shared], kind="stable")
        columns, owners = column[shared][by_row], owner[shared][by_row]
        row_at = np.searchsorted(owners, np.arange(m + 1))
        parent = list(range(m))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        lower = (side == 0).any() and (side == 1).any()
        for x in range(m):
            if lower and side[x] == 1:
                continue
            mine = columns[row_at[x] : row_at[x + 1]]
            if not len(mine):
                continue
            length = count[mine]
            total = np.cumsum(length)
            spots = np.repeat(start[mine] - total + length, length) + np.arange(total[-1])
            overlap = np.bincount(owner[spots], minlength=m)
            ok = 100 * overlap >= percent * (size[x] + size - overlap)
            ok &= (side != side[x]) if lower else (np.arange(m) > x)
            for y in np.flatnonzero(ok).tolist():
                a, b = root(x), root(y)
                if a != b:
                    parent[a] = b
                    out.append((node[x], node[y]))
        return out

    def rows(arrow: Arrow) -> Arrow:
        now, held, out = None, [], []
        for b in arrow:
            for cluster, i, j, side, node, grams in zip(*(c.to_pylist() for c in b.columns)):
                if (cluster, i, j) != now:
                    if len(held) > 1:
                        out += links(held)
                    now, held = (cluster, i, j), []
                held.append((side, node, np.frombuffer(grams, dtype=np.uint64)))
        if len(held) > 1:
            out += links(held)
        yield pa.record_batch([pa.array([a for a, _ in out], kind), pa.array([b for _, b in out], kind)], names=["a", "b"])

    return rows


def verified_links(sets: DataFrame, plan: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links that span the similar rows of every cluster.

    ``sets`` has (node, sig_a, sig_b, grams: sorted 64-bit hashes as bytes; a
    node is a long or a string),
    ``plan`` (node, sig_a, sig_b, cluster, n).  A cluster of several blocks
    sends each row to every pair that its block is in; both halves of a pair
    are in one task, which holds two blocks.
    """
    key = ["node", "sig_a", "sig_b"]
    blocks = plan.groupBy("cluster").agg(F.ceil(F.sum(F.col("n").cast("long")) * 8 / BLOCK_BYTES).cast("int").alias("blocks"))
    placed = plan.join(blocks, "cluster")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.select(*key, "cluster", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    placed = placed.select(
        *key, "cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") > F.col("other")).cast("int").alias("side"),
    )
    rows = sets.join(placed, key).select("cluster", "i", "j", "side", "node", "grams")
    dealt = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    kind = sets.schema["node"].dataType.simpleString()
    arrow = pa.string() if kind == "string" else pa.int64()
    return dealt.mapInArrow(_product(percent, arrow), f"a {kind}, b {kind}")


def _grams(wanted: np.ndarray):
    """Full rows of the documents whose hashed id is in the bitmap."""

    def batch_of(nodes, sig, grams) -> pa.RecordBatch:
        return pa.record_batch(
            [nodes, pa.array([a for a, _ in sig], pa.int64()), pa.array([b for _, b in sig], pa.int64()), pa.array(grams, pa.binary())],
            names=["node", "sig_a", "sig_b", "grams"])

    def rows(arrow: Arrow) -> Arrow:
        for b in arrow:
            hashes = b.column("id_hash").to_numpy(zero_copy_only=False).view(np.uint64)
            some = b.filter(pa.array(contains(wanted, hashes)))
            nodes, sig, grams, size, at = some.column("row_id"), [], [], 0, 0
            for g in _sets(some):
                sig.append(signature(g))
                grams.append(g.tobytes())
                size += len(g)
                if size > 1 << 20:
                    yield batch_of(nodes.slice(at, len(grams)), sig, grams)
                    at, sig, grams, size = at + len(grams), [], [], 0
            yield batch_of(nodes.slice(at, len(grams)), sig, grams)

    return rows


def link(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Documents link when the Jaccard similarity of their sets of 5-word
    shingles reaches ``percent``.  Equal sets are one row of the matrix, known
    by 128 bits.  A null or empty text has no shingles and links with nothing;
    rows that share an id are one document with several texts; a row without
    an id gets no component.  Other columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("row_id"), "text")
    profiles = cut_lineage(source.mapInArrow(_profiles, PROFILE))
    frequent = frequent_bitmap(profiles.where("slice is not null").select("slice", "counts"))
    known = profiles.where("n is not null").select("row_id", "n", "sig_a", "sig_b")
    classes = known.where("row_id is not null and n > 0").groupBy("sig_a", "sig_b").agg(F.min("row_id").alias("rep"), F.max("n").alias("n"))
    classes = cut_lineage(classes)
    named = source.where("row_id is not null")

    edges = candidate_edges(named.mapInArrow(_columns(frequent, percent), "key long, n int, node long"), percent)
    held = components(edges)
    held = held.union(held.select("root", "root")).distinct().select(F.col("node").alias("sig_a"), F.col("root").alias("cluster"))
    plan = cut_lineage(classes.join(held, "sig_a").select(F.col("rep").alias("node"), "sig_a", "sig_b", "cluster", "n"))
    del edges, held
    release(docs.sparkSession)
    wanted = bitmap_of(plan, F.xxhash64("node"), WANTED_BITS)
    sets = named.withColumn("id_hash", F.xxhash64("row_id")).mapInArrow(_grams(wanted), "node long, sig_a long, sig_b long, grams binary")
    links = verified_links(sets, plan, percent)

    owned = known.where("row_id is not null and n > 0").join(classes.drop("n"), ["sig_a", "sig_b"]).select("row_id", "rep").distinct()
    several = owned.groupBy("row_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a != z")
    same_id = owned.join(several.select("row_id", "a"), "row_id").select("a", F.col("rep").alias("b"))
    roots = components(links.union(same_id))
    release(docs.sparkSession)
    joined = known.join(classes.drop("n"), ["sig_a", "sig_b"], "left").join(
        roots, F.col("rep") == F.col("node"), "left"
    )
    component = F.when(F.col("row_id").isNotNull(), F.coalesce("root", "rep", "row_id"))
    return joined.select(F.col("row_id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents with the smallest id of their component, and those without an id, with all their columns.

    Of rows that repeat that id all stay: they are one document.
    """
    linked = link(docs, percent)
    later = cut_lineage(linked.where("doc_id != component_id").select(F.col("doc_id").alias("later_id")).distinct())
    surely, maybe = split_by_bitmap(docs, F.xxhash64(F.col("doc_id").cast("long")), later, F.xxhash64("later_id"))
    return surely.union(maybe.join(later, F.col("doc_id") == F.col("later_id"), "left_anti"))

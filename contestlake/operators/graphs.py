"""Similarity edges, nearest free members and communities."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlake.functions.rates import fixed
from contestlake.operators import ranking, scan
from contestlake.session import cut_lineage, stored

SLACK = 2e-6  # wider than the rounding of a similarity
#: Dimensions from which nodes meet in blocks; rows of a block; rows of it, and pairs, that are compared at a time.
LONG = 16
BLOCK = 16_384
STRIP = 256
TERMS = 1_000_000
#: Nodes up to which all tasks get the labels of a graph, but for the few that tables serve as well; ways that a task works on at a time.
SMALL = 1_000_000
FEW = 8
PACK = 500_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit_vectors(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """id and unit vector; zero vectors have no direction and no neighbours."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    sized = rows.select(F.col(ident).alias("id"), v.alias("v")).withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v"))))
    return sized.where(F.col("norm") > 0).select("id", F.transform("v", lambda x: x / F.col("norm")).alias("u"))


def _directions(units: DataFrame, count: int) -> list[list[float]]:
    """Directions of most spread; a dimension-sized matrix comes to the driver."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    model = PCA(k=count, inputCol="x", outputCol="y").fit(units.select(array_to_vector("u").alias("x")))
    return model.pc.toArray().T.tolist()


def _projections(directions) -> Column:
    return F.array(*[dot(F.col("u"), F.array(*[F.lit(float(x)) for x in d])) for d in directions])


def knn_edges(rows: DataFrame, ident: str, vector: str, k: int = 6, cutoff: float = 0.92,
              dims: int = 4, levels: int = 16, pieces: int | None = None) -> DataFrame:
    """The k most similar others of every row, at least ``cutoff`` alike; exact.

    1. Copies of a vector become one node, so a group of copies costs one row;
       its first k + 1 ids are kept, no neighbour list can need more.
    2. Neighbours along two space-filling curves over the projections give
       every node a lower bound for the similarity of its k-th neighbour.
    3. That bound is a radius.  Nodes sit in grids of halving cell width over a
       few projections; a node looks only into the cells next to its own on
       the finest grid whose cells are as wide as its radius.  Projections
       never lengthen a distance, so nothing within the radius is missed, and
       where nodes are crowded radii and cells are small.

    Vectors of more than ``LONG`` dimensions lie too evenly for a grid; their
    nodes meet block by block instead.
    """
    units = unit_vectors(rows, ident, vector)
    copies = ranking.top_k(units.withColumn("g", F.xxhash64("u")), ["u", "g"], [F.asc("id")], k + 1, "c")
    copies = cut_lineage(copies.drop("g").join(units.groupBy("u").agg(F.min("id").alias("node")), "u"))
    nodes = copies.where(F.col("id") == F.col("node")).select("node", "u")
    sample = nodes.select("u").first()
    if sample is None:  # no rows, or only zero vectors
        none = units.select(F.col("id").alias("source"), F.col("id").alias("target"))
        return none.select("source", "target", F.lit(0.0).alias("sim"), F.lit(0).alias("rank")).limit(0)
    size = len(sample[0])
    dims = min(dims, size)
    nodes = cut_lineage(nodes.withColumn("p", _projections(_directions(nodes, dims))))
    nodes = _bounded(nodes, k, cutoff, dims, pieces)
    if size > LONG and dict(nodes.dtypes)["node"] == "bigint":
        near = _met_in_blocks(cut_lineage(nodes.select("node", "u", "bound")), k, cutoff)
        return _expand(units, copies, near, k)
    wide = float((2 - 2 * cutoff + 2 * SLACK) ** 0.5)
    nodes = cut_lineage(nodes.withColumn("level", F.least(
        F.floor(F.log2(F.lit(wide) / F.greatest(F.col("radius"), F.lit(1e-9)))), F.lit(levels - 1)).cast("int")))
    used = [r["level"] for r in nodes.select("level").distinct().collect()]  # at most ``levels`` numbers
    width = lambda lv: F.lit(wide) / F.pow(F.lit(2.0), lv)
    cell = lambda lv: F.transform("p", lambda x: F.floor(x / width(lv)))
    targets = nodes.withColumn("lv", F.explode(F.array(*[F.lit(x) for x in sorted(used)]))).select(
        "lv", cell(F.col("lv")).alias("cell"), F.col("node").alias("other"), F.col("u").alias("w"))
    probes = nodes.select("node", "u", "bound", F.col("level").alias("lv"), cell(F.col("level")).alias("cell"))
    for i in range(dims):
        # The own cell and the two next to it along each projection.
        moved = F.array(*[F.col("cell")[j] + (F.col("step") if j == i else F.lit(0)) for j in range(dims)])
        probes = probes.withColumn("step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("cell", moved).drop("step")
    met = probes.join(targets, ["lv", "cell"]).where(F.col("node") != F.col("other"))
    met = met.select("node", "other", "bound", _flat_dot("u", "w", size).alias("sim")).where(F.col("sim") >= F.col("bound"))
    met = met.withColumn("sim", fixed(F.col("sim"), 6)).where(F.col("sim") >= cutoff)
    near = ranking.top_k(met, ["node"], [F.desc("sim"), F.asc("other")], k).select("node", "other", "sim")
    return _expand(units, copies, near, k)


def _met_in_blocks(nodes: DataFrame, k: int, cutoff: float) -> DataFrame:
    """The k nearest nodes of every node by all pairs: node, other, sim.

    Nodes are dealt to blocks of about ``BLOCK``; a task takes two blocks (or
    one with itself) and hands on at most k neighbours per node, so it holds
    two blocks and a strip of similarities, whatever the number of nodes.
    """
    spark = nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    total = nodes.count()
    # Small inputs are cut finer, so that all tasks have a pair of blocks.
    count = max(-(-total // BLOCK), min(int((2 * parts) ** 0.5) + 1, -(-total // 256)), 1)
    own = F.pmod(F.xxhash64("node"), F.lit(count)).cast("int")
    others = F.sequence(F.lit(0), F.lit(count - 1))
    dealt = nodes.withColumn("block", own).withColumn("with", F.explode(others)).select(
        (F.least("block", "with") * count + F.greatest("block", "with")).cast("long").alias("pair"),
        (F.col("block") > F.col("with")).alias("second"), "node", "u", "bound")
    found = dealt.repartition(max(parts, min(count * (count + 1) // 2, 4 * parts)), "pair").sortWithinPartitions("pair", "second").mapInArrow(
        _nearest_in_blocks(count, k, cutoff), "node long, other long, sim double")
    return ranking.top_k(found, ["node"], [F.desc("sim"), F.asc("other")], k).select("node", "other", "sim")


def _nearest_in_blocks(count: int, k: int, cutoff: float):
    """Arrow batches sorted by pair of blocks, the first block ahead → the k nearest others in the pair's other block."""
    import numpy as np
    import pyarrow as pa

    def nearest(left, right, same):
        """(row of left, row of right, similarity) of the k best rights of every left that reach its bound."""
        (ids, u, bound), (far, w, _) = left, right
        order = np.argsort(far, kind="stable")
        far, w = far[order], w[order]
        columns = np.ascontiguousarray(w.T)
        for at in range(0, len(ids), STRIP):
            near = u[at : at + STRIP] @ columns
            # Sums in another order differ by less than the slack; what may count is summed term by term below.
            floor = bound[at : at + STRIP]
            reach = near >= floor[:, None] - SLACK / 2
            if len(far) > k + 1 and reach.sum() > 8 * k * len(near):
                floor = np.maximum(floor, np.partition(near, len(far) - k - 1, axis=1)[:, len(far) - k - 1] - SLACK)
                reach = near >= floor[:, None] - SLACK / 2
            a, b = np.nonzero(reach)
            for some in range(0, len(a), TERMS):
                i, j = a[some : some + TERMS] + at, b[some : some + TERMS]
                if same:
                    i, j = i[ids[i] != far[j]], j[ids[i] != far[j]]
                sim = np.zeros(len(i))
                for d in range(u.shape[1]):
                    sim = sim + u[i, d] * w[j, d]
                on = sim >= bound[i]
                sim = np.floor(sim * 1e6 + 0.5) / 1e6
                on &= sim >= cutoff
                yield i[on], far[j[on]], ids[i[on]], sim[on]

    def batch(left, right, same):
        for i, other, node, sim in nearest(left, right, same):
            order = np.lexsort((other, -sim, i))
            i, other, node, sim = i[order], other[order], node[order], sim[order]
            first = np.searchsorted(i, i, side="left")
            on = np.arange(len(i)) - first < k
            yield pa.record_batch([pa.array(node[on], pa.int64()), pa.array(other[on], pa.int64()), pa.array(sim[on], pa.float64())], names=["node", "other", "sim"])

    def joined(parts):
        return [np.concatenate(x) for x in zip(*parts)]

    def meet(pair, first, second):
        if first and second:
            left, right = joined(first), joined(second)
            yield from batch(left, right, False)
            yield from batch(right, left, False)
        elif first and pair // count == pair % count:
            one = joined(first)
            yield from batch(one, one, True)

    def run(arrow):
        now, first, second = None, [], []
        for b in arrow:
            pairs = b.column("pair").to_numpy()
            late = b.column("second").to_numpy(zero_copy_only=False)
            ids, bound = b.column("node").to_numpy(), b.column("bound").to_numpy()
            u = b.column("u").flatten().to_numpy().reshape(len(ids), -1)
            cuts = [0, *(np.flatnonzero(np.diff(pairs)) + 1).tolist(), len(pairs)]
            for x, y in zip(cuts, cuts[1:]):
                if pairs[x] != now:
                    yield from meet(now, first, second)
                    now, first, second = pairs[x], [], []
                for held, which in ((first, ~late[x:y]), (second, late[x:y])):
                    if which.any():
                        held.append((ids[x:y][which], u[x:y][which], bound[x:y][which]))
        yield from meet(now, first, second)

    return run


def _flat_dot(a: str, b: str, size: int) -> Column:
    """Dot product: compiled term by term for short vectors, a fold for long."""
    if size > 16:
        return dot(F.col(a), F.col(b))
    return reduce(lambda s, i: s + F.col(a)[i] * F.col(b)[i], range(size), F.lit(0.0))


def _curve(dims: int, shift: float) -> Column:
    """Place on a space-filling curve: the bits of the projections interleaved."""
    bits = 60 // dims
    grid = [F.floor((F.col("p")[j] + 1.0 + shift) / 3.0 * (2**bits - 1)).cast("long") for j in range(dims)]
    code = F.lit(0).cast("long")
    for b in range(bits):
        for j in range(dims):
            bit = F.shiftright(grid[j], b).bitwiseAND(F.lit(1).cast("long"))
            code = code.bitwiseOR(F.shiftleft(bit, b * dims + j))
    return code


def _bounded(nodes: DataFrame, k: int, cutoff: float, dims: int, pieces: int | None) -> DataFrame:
    """Lower bound of the k-th similarity from neighbours along two curves."""
    near = None
    for name, shift in (("a", 0.0), ("b", 0.37)):
        line = nodes.select("node", "u", _curve(dims, shift).cast("double").alias("code"))
        w = Window.partitionBy("chunk").orderBy("code", "node").rowsBetween(-k, k)
        around = line.withColumn("chunk", scan.value_chunks(line, "code", pieces)).withColumn(
            "around", F.collect_list(F.struct("node", "u")).over(w))
        around = around.select("node", F.explode("around").alias("n"), "u").where(F.col("node") != F.col("n.node"))
        sims = around.select("node", F.col("n.node").alias("other"), dot(F.col("u"), F.col("n.u")).alias("sim"))
        near = sims if near is None else near.unionByName(sims)
    best = ranking.top_k(near.distinct(), ["node"], [F.desc("sim"), F.asc("other")], k)
    kth = best.where(F.col("rank") == k).select("node", F.col("sim").alias("kth"))
    out = nodes.join(kth, "node", "left")
    bound = F.greatest(F.coalesce("kth", F.lit(cutoff)), F.lit(cutoff)) - SLACK
    return out.withColumn("bound", bound).drop("kth").withColumn(
        "radius", F.sqrt(F.greatest(2 - 2 * F.col("bound"), F.lit(0.0))))


def _expand(units, copies, near, k):
    """Back from nodes to ids: own copies first, then the neighbours' copies."""
    who = units.join(copies.select("u", "node").distinct(), "u").select("id", "node")
    own = copies.select("node", F.col("id").alias("target")).withColumn("sim", F.lit(1.0))
    other = near.join(copies.select(F.col("node").alias("other"), F.col("id").alias("target")), "other").select("node", "target", "sim")
    pairs = who.join(own.unionByName(other), "node").where(F.col("id") != F.col("target"))
    ranked = ranking.top_k(pairs, ["id"], [F.desc("sim"), F.asc("target")], k)
    return ranked.select(F.col("id").alias("source"), "target", "sim", "rank")


def nearest_free(edges: DataFrame, held: DataFrame, limit: int = 6) -> DataFrame:
    """Free members most like each member, over edges in both directions."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "sim")
    both = edges.select("source", "target", "sim").unionByName(back).distinct()
    free = both.join(held.select(F.col("member").alias("target")).distinct(), "target", "left_anti")
    return ranking.top_k(free, ["source"], [F.desc("sim"), F.asc("target")], limit)


def communities(edges: DataFrame, nodes: DataFrame, rounds: int = 5) -> DataFrame:
    """Label propagation with a fixed number of rounds.

    Every node takes the label with most weight among its neighbours, the
    smallest label on ties; isolated nodes keep their own.
    """
    ways = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    ways = cut_lineage(ways)
    labels = nodes.select("node", F.col("node").alias("label"))
    for step in range(rounds):
        votes = ways.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(
            F.col("a").alias("node"), "label").agg(F.sum("weight").alias("votes"))
        best = votes.groupBy("node").agg(F.max_by("label", F.struct(F.col("votes"), -F.col("label"))).alias("new"))
        labels = labels.join(best, "node", "left").select("node", F.coalesce("new", "label").alias("label"))
        if step % 2 == 1:
            labels = cut_lineage(labels)
    return labels


def modularity(ways: DataFrame, labels: DataFrame, total: float) -> float:
    """Share of weight inside communities, less what chance would put there; ``ways`` has every edge in both directions."""
    own = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
    other = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    named = ways.join(own, "a").join(other, "b")
    per = named.groupBy("la").agg(F.sum(F.when(F.col("la") == F.col("lb"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("all"))
    return per.agg(F.sum(F.col("inside") / total - F.pow(F.col("all") / total, 2))).first()[0] or 0.0


def _votes(ways: DataFrame, labels: DataFrame) -> DataFrame:
    """Weight from every node to every neighbouring community."""
    far = labels.select(F.col("node").alias("b"), "label")
    return ways.join(far, "b").groupBy(F.col("a").alias("node"), "label").agg(F.sum("w").alias("w"))


def _value(votes: DataFrame, labels: DataFrame, total: float) -> float:
    """``modularity`` from the votes under the same labels; ``labels`` carries degrees and loops."""
    named = labels.join(votes, ["node", "label"], "left")
    per = named.groupBy("label").agg(F.sum(F.coalesce("w", F.lit(0.0)) + F.col("loop")).alias("inside"), F.sum("k").alias("all"))
    return per.agg(F.sum(F.col("inside") / total - F.pow(F.col("all") / total, 2))).first()[0] or 0.0


def _moved(votes: DataFrame, labels: DataFrame, total: float, turn: int) -> DataFrame:
    """One half of the nodes each move to the neighbouring community that gains most, if any gains; ties go to the smallest label."""
    sums = labels.groupBy("label").agg(F.sum("k").alias("sum"))
    here = labels.select("node", "k", F.col("label").alias("own"))
    here = here.where(F.pmod(F.xxhash64("node", F.lit(turn // 2)), F.lit(2)) == turn % 2)
    known = votes.unionByName(labels.select("node", "label", F.lit(0.0).alias("w"))).groupBy("node", "label").agg(F.sum("w").alias("w"))
    rated = known.join(here, "node").join(sums, "label")
    mine = F.col("label") == F.col("own")
    gain = F.col("w") - F.col("k") * (F.col("sum") - F.when(mine, F.col("k")).otherwise(0.0)) / total
    rated = rated.withColumn("gain", F.round(gain, 9))
    best = rated.groupBy("node").agg(
        F.max_by("label", F.struct(F.col("gain"), -F.col("label"))).alias("new"), F.max("gain").alias("most"),
        F.max(F.when(mine, F.col("gain"))).alias("stay"))
    best = best.where("most > stay").select("node", "new")
    return labels.join(best, "node", "left").select("node", "k", "loop", F.coalesce("new", "label").alias("label"))


def _settled_wide(ways: DataFrame, total: float, gain: float) -> tuple[DataFrame, float, float]:
    """``_settled`` for any number of nodes: every turn is joins of tables."""
    labels = stored(_degrees(ways).withColumn("label", F.col("node")), "labels")
    # Ways lie by their far end for all turns of a level, so a turn moves labels and votes only.
    parts = int(ways.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = ways.where("a <> b").repartition(parts, "b").persist()
    votes = _votes(near, labels).persist()
    here = start = _value(votes, labels, total)
    turn = idle = 0
    while idle < 2:
        tried = stored(_moved(votes, labels, total, turn), "labels")
        known = _votes(near, tried).persist()
        value = _value(known, tried, total)
        turn += 1
        if value > here + gain:
            labels, here, idle = tried, value, 0
            votes, known = known, votes
        else:
            idle += 1
        known.unpersist()
    votes.unpersist()
    near.unpersist()
    return labels, start, here


def _packed(ids):
    """Ways of whole nodes, sorted by their near end, as arrays: places of both ends among ``ids`` and weights."""

    def rows(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

        def batch_of(a, b, w) -> pa.RecordBatch:
            ends = [np.searchsorted(ids.value, x).astype(np.int32).tobytes() for x in (a, b)]
            return pa.record_batch([pa.array([x], pa.binary()) for x in (*ends, w.tobytes())], names=["a", "b", "w"])

        for batch in arrow:
            held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) > PACK else 0
            if cut:
                yield batch_of(*(h[:cut] for h in held))
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield batch_of(*held)

    return rows


def _better(a, b, w, label, degree, total: float):
    """(nodes, labels) of all moves that gain, and the weight inside communities, over ways that hold all of a node or nothing."""
    sums = np.bincount(label, weights=degree, minlength=len(label))
    own = np.unique(a)
    key = np.r_[a.astype(np.int64) * len(label) + label[b], own.astype(np.int64) * len(label) + label[own]]
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
    node, to = np.divmod(key[order][first], len(label))
    votes = np.add.reduceat(np.r_[w, np.zeros(len(own))][order], first)
    mine = to == label[node]
    gains = votes - degree[node] * (sums[to] - np.where(mine, degree[node], 0.0)) / total
    gains = np.sign(gains) * np.floor(np.abs(gains) * 1e9 + 0.5) / 1e9
    order = np.lexsort((to, -gains, node))
    best = order[np.r_[True, np.diff(node[order]) != 0]]
    some = gains[best] > gains[mine]
    return node[best][some], to[best][some], float(w[label[a] == label[b]].sum())


def _turn(state, total: float):
    """One row with all moves that gain, as arrays, and the weight inside, for each pack."""

    def rows(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow:
            for a, b, w in zip(*(c.to_pylist() for c in batch.columns)):
                node, to, inside = _better(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32), np.frombuffer(w), *state.value, total)
                out = [pa.array([node.astype(np.int32).tobytes()], pa.binary()), pa.array([to.astype(np.int32).tobytes()], pa.binary()), pa.array([inside])]
                yield pa.record_batch(out, names=["node", "label", "inside"])

    return rows


def _settled_small(ways: DataFrame, known: pa.Table, total: float, gain: float) -> tuple[DataFrame, float, float]:
    """``_settled`` with the labels as an array that every task gets: a turn is one pass over the ways.

    A pass gives the value of the labels and the moves of all nodes; the turn's
    half of them is taken here.
    """
    spark = ways.sparkSession
    context = spark.sparkContext
    known = known.sort_by("node")
    ids, degree = known["node"].to_numpy(), known["k"].to_numpy()
    loops = float(known["loop"].to_numpy().sum())
    place = context.broadcast(ids)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = ways.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"), "w").repartition(parts, "a").sortWithinPartitions("a")
    packs = near.mapInArrow(_packed(place), "a binary, b binary, w binary").persist()
    nodes = spark.createDataFrame(pa.table({"node": ids})).select("node")
    halves: dict[int, np.ndarray] = {}

    def half(turn: int) -> np.ndarray:
        """Whether a node's turn it is; worked out for 64 turns at a time."""
        block = turn // 64
        if block not in halves:
            bits = [F.shiftleft(F.pmod(F.xxhash64("node", F.lit(32 * block + i)), F.lit(2)), i) for i in range(32)]
            rows = nodes.select("node", reduce(lambda x, y: x.bitwiseOR(y), bits).alias("bits")).toArrow().sort_by("node")
            halves[block] = rows["bits"].to_numpy()
        return (halves[block] >> (turn // 2 % 32)) & 1 == turn % 2

    def judged(label: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Modularity under the labels, and the moves that gain."""
        state = context.broadcast((label, degree))
        rows = packs.mapInArrow(_turn(state, total), "node binary, label binary, inside double").collect()
        state.destroy()
        sums = np.bincount(label, weights=degree, minlength=len(label)) / total
        value = (sum(r["inside"] for r in rows) + loops) / total - float((sums * sums).sum())
        node, to = (np.concatenate([np.frombuffer(r[c], np.int32) for r in rows] or [np.zeros(0, np.int32)]) for c in ("node", "label"))
        return value, node, to

    label = np.arange(len(ids), dtype=np.int64)
    here, node, to = judged(label)
    start, turn, idle = here, 0, 0
    while idle < 2:
        mine = half(turn)[node]
        tried = label.copy()
        tried[node[mine]] = to[mine]
        value, *moves = judged(tried) if mine.any() else (here, node, to)
        turn += 1
        if value > here + gain:
            label, here, idle = tried, value, 0
            node, to = moves
        else:
            idle += 1
    packs.unpersist()
    place.destroy()
    named = pa.table({"node": ids, "label": ids[label], "k": degree, "loop": known["loop"]})
    return spark.createDataFrame(named), start, here


def _degrees(ways: DataFrame) -> DataFrame:
    loop = F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0.0))
    return ways.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"), loop.alias("loop"))


def _settled(ways: DataFrame, total: float, gain: float) -> tuple[DataFrame, float, float]:
    """(labels, modularity of single nodes, modularity of the labels) when neither half of the nodes gains any more."""
    known = _degrees(ways).limit(SMALL + 1).toArrow()
    if not FEW < known.num_rows <= SMALL or ways.schema["a"].dataType.simpleString() != "bigint":
        return _settled_wide(ways, total, gain)
    return _settled_small(ways, known, total, gain)


def louvain(edges: DataFrame, nodes: DataFrame, weight: str | None = None, gain: float = 1e-6) -> tuple[DataFrame, float]:
    """((node, label), modularity) by modularity moves and graph contraction.

    ``edges``: a, b (whole numbers, each pair once) and, if named, a weight;
    by default every edge counts one.  Nodes move in halves, so neighbours
    don't swap places for ever, and a round counts only if modularity rises.
    When neither half gains, communities become the nodes of the next level,
    until a level gains nothing.  A label is the smallest node of its
    community; a node without edges is one of its own.  Loops are ignored.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    pairs = edges.where("a <> b").select("a", "b", w.alias("w"))
    ways = stored(pairs.union(pairs.select("b", "a", "w")).groupBy("a", "b").agg(F.sum("w").alias("w")), "ways")
    total = ways.agg(F.sum("w")).first()[0]
    final = nodes.select("node", F.col("node").alias("label"))
    if not total:
        return final, 0.0
    best = float("-inf")
    while True:
        labels, start, here = _settled(ways, total, gain)
        # The smallest member names a community, so that labels do not depend on the order of moves.
        names = labels.groupBy("label").agg(F.min("node").alias("name"))
        labels = stored(labels.join(names, "label").select("node", F.col("name").alias("label")), "labels")
        step = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        final = stored(final.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        if here <= max(best, start) + gain:
            return final, here
        best = here
        own = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        other = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        merged = ways.join(own, "a").join(other, "b").groupBy(F.col("la").alias("a"), F.col("lb").alias("b")).agg(F.sum("w").alias("w"))
        ways = stored(merged, "ways")


def feature_vectors(totals: DataFrame, weeks: int, scales: dict[str, float]) -> DataFrame:
    """Scaled production per week as one array per member."""
    return totals.select("member", F.array(*[F.col(c) / weeks / s for c, s in scales.items()]).alias("features"))


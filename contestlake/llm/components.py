"""Connected components of an edge table, by alternating stars.

Every task first shrinks its own edges to a forest, so paths inside a task
cost no rounds.  Large stars then hang every larger neighbour of a node on the
node's smallest neighbour, small stars do so with the smaller ones; the edges
end as stars around the smallest node of each component.  Every round is a
group and a join on single edges, so a node with very many neighbours is no
group of its own: its edges are rows, and Spark splits them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestlake.session import cut_lineage

#: Nodes that a task holds while it shrinks its edges; it starts anew beyond them.
HELD_NODES = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (node, smallest node) of each component within a run of edges."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def stars(schema: pa.Schema) -> pa.RecordBatch:
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        columns = list(zip(*pairs)) or [[], []]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    schema = None
    for b in batches:
        schema = b.schema
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > HELD_NODES:
            yield stars(schema)
            parent = {}
    if parent:
        yield stars(schema)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: edges (a, b) with a > b, some of them twice."""
    if large:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("c", "m").alias("m"))
    hung = around.join(least, around["u"] == least["c"])
    if large:
        out = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("c").alias("a"), F.col("m").alias("b")))
    return out.where("a != b")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that is not the smallest of its component; ``edges`` has columns a and b.

    Nodes are longs or strings.  Loops, repeated edges and edges with a null
    end change nothing; no edges give no rows.
    """
    kind = edges.schema["a"].dataType.simpleString()
    pairs = edges.select("a", "b").where("a != b")
    now = cut_lineage(pairs.mapInArrow(_forest, f"a {kind}, b {kind}").distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        now = cut_lineage(_star(_star(now, True), False).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))

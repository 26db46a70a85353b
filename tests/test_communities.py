"""Louvain communities against a single-machine run on the same edges."""

import itertools
import random

import pytest

from contestlake.operators import graphs


def quality(edges, label):
    m2 = 2 * sum(edges.values())
    inside, all_ = {}, {}
    for (a, b), w in edges.items():
        if label[a] == label[b]:
            inside[label[a]] = inside.get(label[a], 0) + 2 * w
        for x in (a, b):
            all_[label[x]] = all_.get(label[x], 0) + w
    return sum(inside.get(c, 0) / m2 - (t / m2) ** 2 for c, t in all_.items())


def sequential(edges):
    """One node at a time, then contraction, until nothing gains."""
    nodes = sorted({x for e in edges for x in e})
    out = {n: n for n in nodes}
    ways = {n: {} for n in nodes}
    for (a, b), w in edges.items():
        ways[a][b] = ways[a].get(b, 0) + w
        ways[b][a] = ways[b].get(a, 0) + w
    m2 = 2 * sum(edges.values())
    while True:
        k = {n: sum(ways[n].values()) for n in ways}
        label = {n: n for n in ways}
        total, moved, any_move = dict(k), True, False
        while moved:
            moved = False
            for n in sorted(ways):
                total[label[n]] -= k[n]
                to = {label[n]: 0.0}
                for x, w in ways[n].items():
                    if x != n:
                        to[label[x]] = to.get(label[x], 0) + w
                best = max(to, key=lambda c: (to[c] - k[n] * total[c] / m2, -c))
                if to[best] - k[n] * total[best] / m2 <= to[label[n]] - k[n] * total[label[n]] / m2 + 1e-12:
                    best = label[n]
                moved |= best != label[n]
                label[n] = best
                total[best] += k[n]
            any_move |= moved
        out = {n: label[c] for n, c in out.items()}
        if not any_move:
            return out
        merged: dict = {}
        for a, to in ways.items():
            for b, w in to.items():
                row = merged.setdefault(label[a], {})
                row[label[b]] = row.get(label[b], 0) + w
        ways = merged


def planted(seed, groups, size, inside, outside):
    draw = random.Random(seed)
    pairs = itertools.combinations(range(groups * size), 2)
    return {(a, b): draw.choice([1, 1, 3]) for a, b in pairs if draw.random() < (inside if a // size == b // size else outside)}


def grouped(label):
    out = {}
    for n, c in label.items():
        out.setdefault(c, set()).add(n)
    return sorted(map(sorted, out.values()))


def found(spark, edges, nodes, weight=None):
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "a long, b long, w long")
    labels, value = graphs.louvain(frame, spark.createDataFrame([(n,) for n in nodes], "node long"), weight)
    return {r.node: r.label for r in labels.collect()}, value


@pytest.mark.parametrize("weight", [None, "w"])
def test_planted_groups(spark, weight):
    edges = planted(1, 5, 9, 0.8, 0.04)
    plain = edges if weight else dict.fromkeys(edges, 1)
    label, value = found(spark, edges, [*range(45), 99], weight)
    assert grouped({n: c for n, c in label.items() if n != 99}) == [list(range(i, i + 9)) for i in range(0, 45, 9)]
    assert label[99] == 99 and all(c == min(n for n in label if label[n] == c) for c in label.values())
    assert value == pytest.approx(quality(plain, label)) and value >= quality(plain, sequential(plain)) - 1e-9


def test_a_ring_of_cliques_and_repeats(spark):
    edges = {p: 1 for i in range(6) for p in itertools.combinations(range(5 * i, 5 * i + 5), 2)}
    edges |= {(min(a, b), max(a, b)): 1 for i in range(6) for a, b in [(5 * i + 4, (5 * i + 5) % 30)]}
    label, value = found(spark, edges, range(30))
    assert value >= quality(edges, sequential(edges)) - 1e-9
    assert found(spark, edges, range(30)) == (label, value)


def test_no_edges(spark):
    label, value = found(spark, {}, [3, 4])
    assert label == {3: 3, 4: 4} and value == 0.0

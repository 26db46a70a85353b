"""Plans and helpers that must hold when the tables grow."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contestlake import session
from contestlake.llm import bitmaps, jaccard
from contestlake.operators import graphs, identity, marts, swaps
from contestlake.plans import league, scenarios


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _filed(df, path):
    """The rows as a small file, whose size the planner knows."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def test_name_lookups_are_not_broadcast(spark, folder):
    kind = "id long, norm string, flag boolean, team int"
    rows = [(i, f"a name{i}", i % 2 == 0, i % 3) for i in range(40)]
    people = _filed(spark.createDataFrame(rows, kind), f"{folder}/people")
    targets = people.withColumnRenamed("id", "target_id")
    sources = people.withColumnRenamed("id", "source_id").selectExpr("*", "true AS rostered")
    found = identity.resolve_collisions(identity.cascade(sources, targets))
    forced = spark.createDataFrame([(3, 5)], "source_id long, forced_id long")
    out = identity.apply_overrides(found, forced)
    assert "Broadcast" not in _plan(out)
    got = {r.source_id: (r.target_id, r.status) for r in out.collect()}
    assert got[2] == (2, "matched") and got[3] == (5, "override")


def test_turns_leave_no_growing_plan(spark, monkeypatch):
    """The planner's size of a state is that of its rows, however many turns made it."""
    edges = spark.createDataFrame([(a, b) for a in range(8) for b in range(a + 1, 8) if a // 4 == b // 4], "a long, b long")
    sizes, moved = [], graphs._moved

    def seen(*args):
        sizes.append(int(str(args[1]._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return moved(*args)

    monkeypatch.setattr(graphs, "_moved", seen)
    labels, _ = graphs.louvain(edges, spark.range(8).withColumnRenamed("id", "node"))
    assert {r.node: r.label for r in labels.collect()} == {n: n // 4 * 4 for n in range(8)}
    assert len(sizes) > 2 and max(sizes) < 10 * 1024 * 1024


def test_turns_are_one_pass_over_packed_ways(spark, monkeypatch):
    """Labels as arrays settle where labels as tables do, without a table per turn."""
    draw = random.Random(4)
    ends = {(a, b) for a in range(60) for b in range(a + 1, 60) if draw.random() < (0.5 if a // 12 == b // 12 else 0.04)}
    edges = spark.createDataFrame([(7 * a - 50, 7 * b - 50, 1 + (a + b) % 3) for a, b in sorted(ends)], "a long, b long, weight long")
    nodes = spark.range(-50, 7 * 61 - 50, 7).withColumnRenamed("id", "node")
    wide, moved = [], graphs._moved
    monkeypatch.setattr(graphs, "_moved", lambda *args: wide.append(args[1].count()) or moved(*args))
    monkeypatch.setattr(graphs, "PACK", 50)
    labels, value = graphs.louvain(edges, nodes, "weight")
    got = {r.node: r.label for r in labels.collect()}
    assert all(n <= graphs.FEW for n in wide)
    monkeypatch.setattr(graphs, "SMALL", 0)
    labels, other = graphs.louvain(edges, nodes, "weight")
    assert got == {r.node: r.label for r in labels.collect()} and len(got) == 61 and abs(value - other) < 1e-9
    assert 60 in wide


def test_listed_pairs_are_summed_before_they_are_written(spark, monkeypatch):
    """A pair of near copies shares many columns; what is kept of it is one row."""
    written, cut = [], jaccard.cut_lineage

    def seen(df):
        out = cut(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "cut_lineage", seen)
    rows = [(key << 6, 400, node) for key in range(1, 60) for node in range(1, 13)]
    rows += [(key << 6, 400, 100 + key % 7 + side) for key in range(100, 150) for side in (0, 20 + key)]  # one common column
    edges = jaccard.candidate_edges(spark.createDataFrame(rows, "key long, n int, node long"))
    assert {(r.a, r.b) for r in edges.collect()} == {(a, b) for a in range(1, 13) for b in range(a + 1, 13)}
    assert written == [66]


def test_only_what_may_go_is_dealt(spark):
    docs = spark.createDataFrame([(i % 1000 if i else None, f"text {i}", i) for i in range(1500)], "doc_id long, text string, word int")
    later = spark.createDataFrame([(i,) for i in range(0, 1000, 50)], "later_id long")
    surely, maybe = bitmaps.split_by_bitmap(docs, F.xxhash64("doc_id"), later, F.xxhash64("later_id"))
    assert surely.columns == maybe.columns == docs.columns
    assert surely.count() + maybe.count() == 1500 and 20 <= maybe.where("doc_id % 50 = 0").count() and maybe.count() < 60
    assert surely.where("doc_id % 50 = 0").count() == 0


def test_swap_work_is_spread(spark):
    rows = spark.range(1, numPartitions=1)
    parts = swaps.spread(rows, "id").rdd.getNumPartitions()
    assert parts >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    search = swaps.Search.__new__(swaps.Search)
    kind = "entity long, member long, quality double, qty double, box int, box2 int"
    search.names, search.couples = ["qty"], True
    search.dealt = spark.createDataFrame([(1, m, 1.0, 2.0, m % 2) for m in range(6)], kind.rsplit(",", 1)[0])
    targets = spark.createDataFrame([(2, t, 1.0, 2.0, a, b) for t in range(10, 40) for a, b in [(0, 0), (0, 1), (1, 1)]], kind)
    pairs = search.pairs(targets)
    assert pairs.rdd.getNumPartitions() >= parts
    got = sorted((r.get, r.give1, r.give2) for r in pairs.collect())
    assert got == [(t, a, b) for t in range(10, 40) for a in range(6) for b in range(a + 1, 6)]


def test_scans_sum_the_facts_once(spark, sf, monkeypatch):
    """Board and rosters of a scan are read from the same files."""
    asked, lines = [], league.day_lines
    monkeypatch.setattr(league, "day_lines", lambda *args: asked.append(1) or lines(*args))
    for scan in (scenarios.scenario_swap_scan, scenarios.two_for_one_scan):
        asked.clear()
        scan(spark, sf)
        assert asked == [1]


def test_hopeless_targets_meet_no_box():
    """A target that nothing of ours can buy is bounded once, not once per box."""
    asked = []

    class Board:
        names, place = ["qty"], {"them": 0}

        def bounds(self, rival, low, high, receive):
            asked.append(len(rival))
            gain = receive[:, 0] - low[:, 0]
            return gain, -gain, np.full(len(gain), 2.0)

    class Targets:
        schema = StructType.fromDDL("entity string, member long, quality double, qty double")

        def mapInArrow(self, run, kinds):  # noqa: N802
            return list(run([pa.record_batch([["them"] * 500, list(range(500)), [1.0] * 500, [9.0 if i < 3 else 0.0 for i in range(500)]], names=self.schema.names)]))

    k = np.arange(64)
    flows = np.stack([k / 64 + 1], axis=1)
    boxes = swaps.Boxes(k, k, flows, flows + 0.01, np.full(64, 5.0), k)
    out = swaps.bounded(Targets(), Board(), boxes, swaps.OneForOne())
    assert sum(asked) == 500 + 3 * 64
    assert sorted((m, x) for b in out for m, x in zip(b["member"].to_pylist(), b["box"].to_pylist())) == [(m, x) for m in range(3) for x in range(64)]


def test_offers_are_not_broadcast(spark, folder):
    needs = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0), ("b", "y", 1.0)], "entity string, metric string, weight double")
    pushy = spark.createDataFrame([("a", 2), ("b", 1)], "entity string, claims long")
    order = spark.createDataFrame([("a", 1), ("b", 2)], "entity string, place int")
    offers = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (3, "z"), (None, "x"), (4, "x"), (4, "x")], "member long, metric string")
    out = marts.claim_chance(needs, pushy, order, _filed(offers, f"{folder}/offers"))
    assert sorted((r.member, r.entity, r.chance) for r in out.collect()) == [
        (1, "a", 0.5), (1, "b", 0.5), (2, "b", 1.0), (4, "a", 0.571429), (4, "b", 0.428571)]
    boards = [line for line in _plan(out).split("\n") if "BroadcastHashJoin" in line and "metric" in line]
    assert boards and all("BuildRight" in line for line in boards)


def test_a_report_works_out_its_steps_once(spark, sf):
    @session.sharing
    def report(spark, sf):
        return [league.member_periods(spark, sf), league.components(spark, sf)]

    periods, components = report(spark, sf)
    assert "lineitem.parquet" not in _plan(periods) + _plan(components)
    alone = league.member_periods(spark, sf)
    assert "lineitem.parquet" in _plan(alone)
    assert sorted(periods.collect()) == sorted(alone.collect())
    assert sorted(components.collect()) == sorted(league.components(spark, sf).collect())

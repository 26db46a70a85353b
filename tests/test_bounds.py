"""Work per row that must not grow with the table: chunk bounds, patterns of folded logs, neighbours of long vectors."""

from __future__ import annotations

import math
import random
from bisect import bisect_right
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from contestlake.operators import graphs, scan
from contestlake.sources import captures


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_chunk_is_found_by_halves(spark):
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=min(i, 300)), float(i) if i % 50 else None) for i in range(500)] + [(500, None, math.nan)]
    df = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, v double")
    out = df.select("seq", "v", scan.order_chunks(df, ["ts", "seq"], 45).alias("c"), scan.value_chunks(df, "v", 45).alias("d"))
    assert "filter(" not in _plan(out) and "aggregate(" in _plan(out)
    got = out.orderBy("seq").collect()
    chunks = [r["c"] for r in got if r["seq"] < 500]
    assert chunks == sorted(chunks) and len(set(chunks)) > 30 and got[500]["c"] == 0
    assert max(chunks.count(c) for c in set(chunks)) <= 30
    bounds = df.agg(F.percentile_approx("v", [i / 45 for i in range(1, 45)], 450)).first()[0]
    for r in got:
        want = 0 if r["v"] is None else len(set(bounds)) if math.isnan(r["v"]) else bisect_right(sorted(set(bounds)), r["v"])
        assert r["d"] == want


def test_patterns_of_a_folded_log_run_once(spark):
    text = ["5/6/98 1:05 PM ET Beta Joe Neil C • NYY - Added", "View transaction details", "Al Ruiz P • BOS - Dropped 5/6/98 $2.50",
            "Bo Ray P • BOS - Dropped\t", "Cy Day P • BOS - Dropped 5/7/98", "5/6/98 1:06 PM ET Beta Joe Neil C • NYY - Added $1.00"]
    lines = spark.createDataFrame([("f", i // 2, i, t) for i, t in enumerate(text)], "path string, blk long, pos long, line string")
    rows, _ = captures.transactions_old(lines, ["Beta"])
    assert "Added off Waivers" not in _plan(rows)
    got = [(r["pos"], len(r["actions"]), str(r["effective_date"]), str(r["cost"])) for r in rows.orderBy("pos").collect()]
    assert got == [(0, 4, "1998-05-07", "2.50"), (5, 1, "None", "1.00")]


def test_long_vectors_meet_in_blocks(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) + (i % 4) for _ in range(20)]) for i in range(150)]
    rows += [(1000 + i, rows[i][1]) for i in range(12)] + [(2000 + i, rows[7][1]) for i in range(9)]
    for block in (16, graphs.BLOCK):
        before, graphs.BLOCK = graphs.BLOCK, block
        try:
            edges = graphs.knn_edges(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", k=4, cutoff=0.35)
            assert "mapinarrow" in _plan(edges).lower()
            got = {(r["source"], r["target"], r["sim"], r["rank"]) for r in edges.collect()}
        finally:
            graphs.BLOCK = before
        want = set()
        unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in rows}
        for a, u in unit.items():
            near = []
            for b, w in unit.items():
                sim = math.floor((1.0 if u == w else sum(x * y for x, y in zip(u, w))) * 1e6 + 0.5) / 1e6
                if a != b and sim >= 0.35:
                    near.append((-sim, b))
            want |= {(a, b, -s, r + 1) for r, (s, b) in enumerate(sorted(near)[:4])}
        assert got == want

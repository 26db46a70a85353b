"""Operators on small frames, checked against plain Python."""

import itertools
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from contestlake.operators import graphs, identity, intervals, joins, metrics, ranking, recompute, resample, scan, scenario
from contestlake.operators import signals as SG
from contestlake.operators import standings as S


def board(spark, values, direction="higher"):
    df = spark.createDataFrame([("K", i, float(v)) for i, v in enumerate(values)], "metric string, entity int, value double")
    out = ranking.rank_points(df, ["metric"], "value", F.lit(direction))
    return [r.points for r in out.orderBy("entity").collect()]


def test_rank_points_facts(spark):
    assert board(spark, [30, 20, 10]) == [3, 2, 1]
    assert board(spark, [3.50, 4.10, 2.90], "lower") == [2, 1, 3]
    assert board(spark, [20, 20, 10]) == [2.5, 2.5, 1]
    assert board(spark, [5, 5, 5, 1]) == [3, 3, 3, 1]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_points_are_conserved(spark, seed):
    rng = random.Random(seed)
    values = [rng.randint(0, 6) for _ in range(13)]
    assert sum(board(spark, values)) == 13 * 14 / 2


def test_wide_board_equals_plain(spark):
    rng = random.Random(5)
    rows = [("a" if i % 3 else "b", i, float(rng.choice([0, 0, 0, rng.randint(0, 40)]))) for i in range(500)]
    df = spark.createDataFrame(rows, "board string, entity int, value double")
    plain = ranking.rank_points(df, ["board"], "value", F.lit("higher")).select("board", "entity", "points")
    wide = df.join(ranking.rank_points_wide(df, ["board"], "value", pieces=7), ["board", "value"]).select("board", "entity", "points")
    assert plain.exceptAll(wide).count() == 0 and wide.exceptAll(plain).count() == 0


def hot_rows(spark):
    """One key holds two thirds of the rows."""
    rng = random.Random(9)
    rows = [(1 if i % 3 else i % 5, i, rng.choice([None, rng.randint(1, 9)]), rng.randint(0, 5)) for i in range(900)]
    return rows, spark.createDataFrame(rows, "k int, pos int, mark int, n int").repartition(7)


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_chunked_scans(spark, width):
    rows, df = hot_rows(spark)
    chunk = F.floor(F.col("pos") / width)
    fill = scan.fill_forward(df, ["k"], ["pos"], chunk, {"mark": "last"})
    lag = scan.shifted(df, ["k"], ["pos"], chunk, {"n": "prev"})
    lead = scan.shifted(df, ["k"], ["pos"], chunk, {"n": "next"}, forward=True)
    run = scan.running_sum(df, ["k"], ["pos"], chunk, {"n": "so_far"})
    before = scan.running_sum(df, ["k"], ["pos"], chunk, {"n": "before"}, inclusive=False)
    got = fill.select("pos", "last").join(lag.select("pos", "prev"), "pos").join(lead.select("pos", "next"), "pos").join(
        run.select("pos", "so_far"), "pos").join(before.select("pos", "before"), "pos")
    got = {r.pos: (r["last"], r.prev, r.next, r.so_far, r.before) for r in got.collect()}
    by_key = {}
    for k, pos, mark, n in rows:
        by_key.setdefault(k, []).append((pos, mark, n))
    for items in by_key.values():
        last, total = None, 0
        for i, (pos, mark, n) in enumerate(items):
            last = mark if mark is not None else last
            prev = items[i - 1][2] if i else None
            nxt = items[i + 1][2] if i + 1 < len(items) else None
            assert got[pos] == (last, prev, nxt, total + n, total)
            total += n


def replay(actions):
    """The interval rules as a loop."""
    open_, closed, odd = {}, [], 0
    moves = {"move_to_il": "il", "move_from_il": "active"}

    def do_open(key, at, via):
        nonlocal odd
        if key in open_:
            odd += 1
        else:
            open_[key] = [at, None, via, None, "active"]

    def do_close(key, at, how):
        nonlocal odd
        got = open_.pop(key, None)
        if got is None:
            odd += 1
        else:
            got[1], got[3] = at, how
            closed.append((key, tuple(got)))

    for _, at, entity, member, action, other in actions:
        key = (entity, member)
        if action == "add":
            do_open(key, at, "add")
        elif action == "drop":
            do_close(key, at, "drop")
        elif action == "trade":
            if other is not None:
                do_close((other, member), at, "trade")
            do_open(key, at, "trade")
        elif key in open_:
            open_[key][4] = moves[action]
        else:
            odd += 1
    return sorted(closed + [(k, tuple(v)) for k, v in open_.items()], key=str), odd


def random_actions(seed, n=400):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    out = []
    for i in range(n):
        action = rng.choice(["add", "drop", "trade", "move_to_il", "move_from_il"])
        entity = rng.randint(0, 3)
        other = rng.choice([None, (entity + 1) % 4]) if action == "trade" else None
        out.append((i, start + timedelta(hours=i // 3), entity, rng.choice([0, 0, 0, 1, 2]), action, other))
    return out


ACTION_SCHEMA = "seq long, ts timestamp_ntz, entity long, member long, action string, counterparty long"


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals_against_replay(spark, seed):
    actions = random_actions(seed)
    df = spark.createDataFrame(actions, ACTION_SCHEMA).repartition(5)
    want, odd = replay(actions)
    rows = intervals.build_intervals(df, ["ts", "seq"], "ts").collect()
    got = sorted((((r.entity, r.member), (r.from_ts, r.to_ts, r.via, r.ended_by, r.status)) for r in rows), key=str)
    assert got == want
    assert intervals.interval_anomalies(df, ["ts", "seq"], "ts").count() == odd


def test_intervals_never_overlap(spark):
    df = spark.createDataFrame(random_actions(7), ACTION_SCHEMA)
    rows = intervals.build_intervals(df, ["ts", "seq"], "ts").collect()
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.entity, r.member, r.from_ts)), key=lambda r: (r.entity, r.member)):
        group = list(group)
        for a, b in zip(group, group[1:]):
            assert a.to_ts is not None and a.to_ts <= b.from_ts


def test_follow_counts_against_pairs(spark):
    rng = random.Random(3)
    start = datetime(2024, 1, 1)
    mk = lambda n: [(rng.choice([0, 0, 1]), rng.randint(0, 4), start + timedelta(hours=rng.randint(0, 400))) for _ in range(n)]
    leaves, takes = mk(120), mk(150)
    want = {}
    for (m, a, t), (m2, b, t2) in itertools.product(leaves, takes):
        if m == m2 and a != b and t < t2 < t + timedelta(days=3):
            want[a, b] = want.get((a, b), 0) + 1
    schema = "member long, entity long, ts timestamp_ntz"
    out = joins.follow_counts(spark.createDataFrame(leaves, schema), spark.createDataFrame(takes, schema))
    assert {(r.victim, r.sniper): r.n for r in out.collect()} == want


def test_shared_edges_against_pairs(spark):
    rng = random.Random(4)
    touches = [(rng.randint(0, 60), rng.randint(0, 7)) for _ in range(300)]
    want = {}
    for m in {m for m, _ in touches}:
        for a, b in itertools.combinations(sorted({e for x, e in touches if x == m}), 2):
            want[a, b] = want.get((a, b), 0) + 1
    out = joins.shared_member_edges(spark.createDataFrame(touches, "member long, entity long"))
    assert {(r.a, r.b): r.weight for r in out.collect()} == want


@pytest.mark.parametrize("shape", ["random", "crowded", "copies"])
def test_knn_is_exact(spark, shape):
    import numpy as np

    rng = np.random.default_rng(11)
    x = rng.normal(size=(150, 5))
    if shape == "crowded":
        x[:100] = np.array([1.0, 2, 3, 4, 5]) + rng.normal(scale=1e-3, size=(100, 5))
    if shape == "copies":
        x[:60] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    edges = graphs.knn_edges(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", k=4, cutoff=0.8, pieces=8)
    got = {}
    for r in edges.collect():
        got.setdefault(r.source, []).append((r["rank"], r.target, r.sim))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.floor(u @ u.T * 1e6 + 0.5) / 1e6
    for i in range(len(x)):
        near = sorted(((-sims[i, j], j) for j in range(len(x)) if j != i and sims[i, j] >= 0.8))[:4]
        have = sorted(got.get(i, []))
        assert len(have) == len(near)
        assert all(abs(h[2] + n[0]) <= 2e-6 for h, n in zip(have, near))


def test_capacity_solver_prefers_strict(spark):
    # Two exclusions fit the counts; only one of them fits the rate.
    rows = [(1, "P", 1, 5, 10, 2), (1, "P", 2, 5, 10, 9), (1, "P", 3, 7, 12, 4)]
    occ = spark.createDataFrame(rows, "game int, slot string, idx int, k long, outs long, er long")
    off = spark.createDataFrame([(1, 12, (2 + 4) / 22)], "game int, off_k long, off_era double")
    out = recompute.reconcile_capacity(occ, off, ["game"], ["k"], {"era": ("er", "outs", 0.001)}, {"P": 2}, 2).first()
    assert (out.outcome, out.excluded, out.strict) == ("solved", [2], True)


def test_capacity_solver_cross_slot_and_unsolved(spark):
    rows = [(g, s, i, v, 1, 1) for g in (1, 2) for s, i, v in [("A", 1, 3), ("A", 2, 4), ("B", 3, 5)]]
    occ = spark.createDataFrame(rows, "game int, slot string, idx int, k long, outs long, er long")
    off = spark.createDataFrame([(1, 7, 1.0), (2, 6, 1.0)], "game int, off_k long, off_era double")
    got = {r.game: (r.outcome, r.excluded) for r in recompute.reconcile_capacity(
        occ, off, ["game"], ["k"], {"era": ("er", "outs", 9.0)}, {"A": 1, "B": 1}, 2).collect()}
    assert got == {1: ("solved-crossslot", [3]), 2: ("unsolved", [])}


def test_capacity_with_many_alike(spark):
    """Thirty members who did nothing are one class; the least indexes of each class are taken."""
    zeros = [(1, "P", i, 0, 0, 0) for i in range(1, 31)]
    rows = [*zeros, (1, "P", 31, 4, 9, 2), (1, "P", 32, 4, 9, 2), (1, "P", 33, 4, 9, 3), (1, "P", 34, 6, 3, 1)]
    occ = spark.createDataFrame(rows, "game int, slot string, idx int, k long, outs long, er long")
    off = spark.createDataFrame([(1, 10, 4 / 12)], "game int, off_k long, off_era double")
    out = recompute.reconcile_capacity(occ, off, ["game"], ["k"], {"era": ("er", "outs", 1e-9)}, {"P": 28}, 28, any_limit=6).first()
    assert (out.outcome, out.excluded, out.strict) == ("solved", [1, 2, 3, 4, 31, 32], True)


def test_capacity_against_every_subset(spark):
    rng = random.Random(11)
    rows, official, want = [], [], {}
    for g in range(40):
        n, cap = rng.randint(4, 8), {"A": 2, "B": 2}
        team = [(g, rng.choice("AB"), i + 1, rng.randint(0, 2), rng.randint(1, 3), rng.randint(0, 1)) for i in range(n)]
        out = rng.sample(team, rng.randint(0, 3))
        kept = [r for r in team if r not in out]
        outs = sum(r[4] for r in kept)
        rate = sum(r[5] for r in kept) / outs if outs else 0.0
        rows += team
        official.append((g, sum(r[3] for r in kept), rate))
        over = {s: max(sum(r[1] == s for r in team) - cap[s], 0) for s in "AB"}
        k_slot, k_any = sum(over.values()), n - 4
        best = None
        if k_slot or k_any > 0:
            for k in {k_slot, *([k_any] if 0 < k_any <= 4 else [])}:
                for some in itertools.combinations(team, k):
                    rest = [r for r in team if r not in some]
                    if sum(r[3] for r in rest) == official[-1][1]:
                        base = sum(r[4] for r in rest)
                        strict = bool(base) and abs(sum(r[5] for r in rest) / base - rate) <= 1e-9
                        quota = k == k_slot and all(sum(r[1] == s for r in some) == over[s] for s in "AB")
                        stage = 1 if quota else 2 if k == k_any else None
                        if stage:
                            found = (not strict, stage, [r[2] for r in some])
                            best = min(best, found) if best else found
        want[g] = "no-excess" if not (k_slot or k_any > 0) else best and best[2]
    occ = spark.createDataFrame(rows, "game int, slot string, idx int, k long, outs long, er long")
    off = spark.createDataFrame(official, "game int, off_k long, off_era double")
    got = recompute.reconcile_capacity(occ, off, ["game"], ["k"], {"era": ("er", "outs", 1e-9)}, {"A": 2, "B": 2}, 4).collect()
    assert {r.game: r.outcome if r.outcome == "no-excess" else r.excluded if r.outcome != "unsolved" else None for r in got} == want


def test_cascade_narrows(spark):
    targets = spark.createDataFrame(
        [(1, "al ruiz", True, "A"), (2, "al ruiz", False, "A"), (3, "al ruiz", False, "B"), (4, "bo diaz jr", False, "C"), (5, "cy young", True, "D")],
        "target_id int, norm string, flag boolean, team string")
    sources = spark.createDataFrame(
        [(10, "al ruiz", True, "Z", True), (11, "al ruiz", False, "B", True), (12, "al ruiz", None, "A", True),
         (13, "bo diaz", False, "C", True), (14, "bo diaz", False, "C", False), (15, "c young", True, "D", True), (16, "no body", True, "D", True)],
        "source_id int, norm string, flag boolean, team string, rostered boolean")
    got = {r.source_id: (r.status, r.target_id, r.matched_by) for r in identity.cascade(sources, targets).collect()}
    assert got[10] == ("matched", 1, "exact")
    assert got[11] == ("matched", 3, "exact")
    assert got[12][0] == "ambiguous"
    assert got[13] == ("matched", 4, "stripped")
    assert got[14][0] == "unmatched"
    assert got[15] == ("matched", 5, "last_initial")
    assert got[16][0] == "unmatched"


def test_collision_keeps_strictly_strongest(spark):
    rows = [(1, 7, "exact", 0, "matched"), (2, 7, "last_initial", 2, "matched"), (3, 8, "exact", 0, "matched"), (4, 8, "exact", 0, "matched")]
    df = spark.createDataFrame(rows, "source_id int, target_id int, matched_by string, strength int, status string")
    got = {r.source_id: r.status for r in identity.resolve_collisions(df).collect()}
    assert got == {1: "matched", 2: "rejected", 3: "rejected", 4: "rejected"}


METRICS = [metrics.Metric("HR", "counting", "higher", "hr"), metrics.Metric("ERA", "rate", "lower", "er", "outs", 27.0)]


def league(spark, entities=5, periods=6, seed=2):
    rng = random.Random(seed)
    rows = [(e, p, rng.randint(0, 20), rng.randint(0, 30), rng.randint(50, 90)) for e in range(entities) for p in range(1, periods + 1)]
    return spark.createDataFrame(rows, "entity int, period int, hr long, er long, outs long")


def test_standings_do_not_depend_on_partitioning(spark):
    comps = league(spark)
    a = S.cumulative_standings(comps.repartition(1), METRICS).collect()
    b = S.cumulative_standings(comps.repartition(7), METRICS).collect()
    assert sorted(a) == sorted(b)


def test_scenario_matches_full_rerank(spark):
    comps = league(spark)
    inputs = S.rate_inputs(comps, ["hr", "er", "outs"], 6).cache()
    deltas = spark.createDataFrame([("x", 0, 3.0, -2.0, 5.0), ("x", 1, -3.0, 2.0, -5.0), ("y", 2, 9.0, 0.0, 0.0)],
                                   "scenario string, entity int, hr double, er double, outs double")
    got = {(r.scenario, r.entity): r.after for r in scenario.evaluate_scenarios(inputs, deltas, METRICS, 6, 4).collect()}
    base = {r.entity: r for r in inputs.collect()}

    def values(e, d):
        def fin(c, delta):
            week = 0.35 * base[e][f"{c}_recent"] + 0.65 * base[e][f"{c}_ytd"] / 6
            return base[e][f"{c}_ytd"] + (week + delta) * 4
        return round(fin("hr", d[0]), 3), -round(fin("er", d[1]) * 27 / fin("outs", d[2]), 3)

    for name, touched in {"x": {0: (3, -2, 5), 1: (-3, 2, -5)}, "y": {2: (9, 0, 0)}}.items():
        board_ = {e: values(e, touched.get(e, (0, 0, 0))) for e in base}
        for e in touched:
            want = sum(1 + sum(1.0 if board_[e][i] > board_[o][i] else 0.5 if board_[e][i] == board_[o][i] else 0.0
                               for o in board_ if o != e) for i in range(2))
            assert got[name, e] == want


def test_slots_are_filled_greedily(spark):
    template = [("C", 1), ("OF", 2), ("U", 1)]
    rng = random.Random(8)
    members = [(e, e * 100 + i, rng.randint(0, 50) / 2, rng.choice([None, "OF", "U"])) for e in range(3) for i in range(30)]
    eligible = [(m, s) for _, m, _, _ in members for s in (["C", "U"] if m % 5 == 0 else ["OF", "U"])]
    df = spark.createDataFrame(members, "entity int, member int, score double, current string")
    el = spark.createDataFrame(eligible, "member int, slot string")
    got = {(r.entity, r.member): r.slot for r in scenario.assign_slots(df, el, template).collect()}
    want = {}
    for e in range(3):
        taken = set()
        for slot, n in template:
            cands = [(-(s + (0.75 if c == slot else 0)), m) for x, m, s, c in members
                     if x == e and m not in taken and (m, slot) in set(eligible)]
            for _, m in sorted(cands)[:n]:
                want[e, m] = slot
                taken.add(m)
    assert got == want


def test_resampling_is_deterministic(spark):
    comps = league(spark, periods=8)
    race = S.project_race(comps, METRICS, 6, 8)
    params = resample.draw_params(comps, race, METRICS, 6, 2)
    lower = [[1.0, 0.0], [0.3, 0.95]]
    a = resample.rank_draws(params.repartition(1), ["HR", "ERA"], lower, 50, 1).collect()
    b = resample.rank_draws(params.repartition(6), ["HR", "ERA"], lower, 50, 1).collect()
    assert sorted(a) == sorted(b) and len(a) == 250
    pmf = resample.rank_pmf(spark.createDataFrame(a), 50)
    for r in pmf.groupBy("entity").agg(F.sum("p").alias("s")).collect():
        assert abs(r.s - 1) < 1e-9


def test_normals_have_unit_moments(spark):
    z = spark.range(20000).select(resample.normal(F.lit(1), F.col("id")).alias("z"))
    m = z.agg(F.avg("z").alias("m"), F.stddev("z").alias("s")).first()
    assert abs(m.m) < 0.03 and abs(m.s - 1) < 0.03


def test_factor_reconstructs(spark):
    rows = [("a", "a", 1.0), ("a", "b", 0.4), ("b", "a", 0.4), ("b", "b", 1.0)]
    low = resample.factor(spark.createDataFrame(rows, "a string, b string, r double"), ["a", "b"])
    assert low[0][1] == 0.0
    assert abs(low[1][0] * low[0][0] - 0.4) < 1e-12
    assert abs(low[1][0] ** 2 + low[1][1] ** 2 - 1.0) < 1e-12
    # Not positive definite: the scaled matrix takes its place.
    bad = [("a", "a", 1.0, 1.0), ("a", "b", 1.3, 0.9), ("b", "a", 1.3, 0.9), ("b", "b", 1.0, 1.0)]
    low = resample.factor(spark.createDataFrame(bad, "a string, b string, r double, scaled double"), ["a", "b"])
    assert abs(low[1][0] - 0.9) < 1e-12


def test_gate_never_drops(spark):
    lines = spark.createDataFrame([(1, "bat", date(2024, 1, 10), 0, 0, 0, 4), (2, "bat", date(2023, 12, 1), 0, 0, 0, 4)],
                                  "member int, side string, date date, starts int, saves int, holds int, volume int")
    usage = SG.activity(lines, date(2024, 1, 12))
    cands = spark.createDataFrame([(1, "bat"), (2, "bat"), (3, "bat")], "member int, side string")
    got = {r.member: r.status for r in SG.gate(cands, usage).collect()}
    assert got == {1: "ok", 2: "blocked", 3: "unverified"}


def test_volume_window_includes_crossing_game(spark):
    # Newest first: 10, 10, 10 → the third game crosses 25 and counts.
    rows = [(1, date(2024, 1, d), d, n, 10) for d, n in zip(range(1, 21), [0] * 17 + [10] * 3)]
    df = spark.createDataFrame(rows, "member int, at date, seq int, num int, den int").withColumn("age", -F.col("seq"))
    out = SG.volume_window_z(df, "age", F.floor(F.col("age") / 3)).first()
    assert (out.wd, out.window) == (30, 1.0)
    assert out.kind == "contact_hot"


def test_top_k_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("member"), F.col("id").alias("at"), F.col("id").alias("seq"))
    plan = SG.newest_rows(df, 7)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_shadow_portfolio_against_loop(spark):
    from contestlake.operators import advice

    rng = random.Random(21)
    start = [(e, e * 100 + i, rng.randint(0, 40) / 2) for e in range(3) for i in range(8)]
    adds = [(rng.randint(0, 2), rng.choice([5, 105, 205, 900 + rng.randint(0, 6)]), p) for p in (1, 2, 3) for _ in range(4)]
    out = advice.shadow_portfolio(
        spark.createDataFrame(start, "entity int, member int, quality double"),
        spark.createDataFrame(adds, "entity int, member int, period int"), [1, 2, 3])
    got = {(r.period, r.entity, r.member) for r in out.collect()}
    want = set()
    for e in range(3):
        roster = {m: q for x, m, q in start if x == e}
        for p in (1, 2, 3):
            new = {m for x, m, n in adds if (x, n) == (e, p) and m not in roster}
            weak = sorted((q, m) for m, q in roster.items() if q is not None)
            for _, m in weak[:len(new)]:
                del roster[m]
            roster.update({m: None for m in new})
            want |= {(p, e, m) for m in roster}
    assert got == want


def test_running_sum_keeps_null_keys_and_goes_on_across_a_year_end(spark):
    from contestlake.operators import scan

    days = [("m", date(2023, 12, 30)), ("m", date(2023, 12, 31)), ("m", date(2024, 1, 1)), (None, date(2024, 1, 1)), (None, date(2024, 1, 2)), ("m", None)]
    rows = spark.createDataFrame([(k, d, 1) for k, d in days], "k string, day date, n long")
    chunk = F.year("day") * 12 + F.month("day")
    got = scan.running_sum(rows, ["k"], ["day"], chunk, {"n": "so_far"}).collect()
    assert {(r.k, r.day, r.so_far) for r in got} == {
        ("m", None, 1), ("m", date(2023, 12, 30), 2), ("m", date(2023, 12, 31), 3), ("m", date(2024, 1, 1), 4),
        (None, date(2024, 1, 1), 1), (None, date(2024, 1, 2), 2)}


def test_scans_refuse_chunks_that_go_back(spark):
    from contestlake.operators import scan

    rows = spark.createDataFrame([("m", date(2023, 12, 30), 1), ("m", date(2024, 1, 1), 1)], "k string, day date, n long")
    with pytest.raises(Exception, match="chunks decrease"):
        scan.running_sum(rows, ["k"], ["day"], F.month("day"), {"n": "so_far"}).collect()


def test_neighbours_of_nothing(spark):
    from contestlake.operators import graphs

    rows = spark.createDataFrame([(1, [0.0, 0.0])], "id long, v array<double>")
    assert graphs.knn_edges(rows, "id", "v").count() == 0
    assert graphs.knn_edges(rows.limit(0), "id", "v").columns == ["source", "target", "sim", "rank"]


def test_a_correction_changes_an_interval(spark):
    log = spark.createDataFrame(
        [(1, datetime(2024, 1, 1, 9), 7, 1, "add", None), (2, datetime(2024, 1, 5, 9), 7, 2, "drop", None)],
        "event_id long, ts timestamp_ntz, member long, entity long, action string, counterparty long")
    fixes = spark.createDataFrame([(7, 1, 2, date(2024, 1, 5), 0)], "member long, from_entity long, to_entity long, effective date, line long")
    found = {(r.entity, r.from_ts, r.to_ts, r.via, r.ended_by) for r in intervals.build_intervals(
        intervals.with_corrections(log, fixes, ["ts", "event_id"], "ts"), ["ts", "event_id"], "ts").collect()}
    assert found == {
        (1, datetime(2024, 1, 1, 9), datetime(2024, 1, 5), "add", "trade(corrected)"),
        (2, datetime(2024, 1, 5), datetime(2024, 1, 5, 9), "trade(corrected)", "drop")}
    plain = intervals.build_intervals(log, ["ts", "event_id"], "ts").collect()
    assert [(r.entity, r.to_ts) for r in plain] == [(1, None)]


def test_correction_lines(spark):
    from contestlake.sources import captures

    good = '{"type":"trade_unlogged","effective_date":"2024-01-05","player":"Al Ruiz","from_team":"Beta","to_team":"Alpha"}'
    bad = ["no json", '{"type":"other"}', good.replace("2024-01-05", "2024-13-45"), good.replace('"player"', '"who"')]
    rows, rejects = captures.corrections(spark.createDataFrame(list(enumerate([good, "", *bad])), "pos long, line string"))
    assert [(r.pos, r.effective, r.player, r.from_team, r.to_team) for r in rows.collect()] == [(0, date(2024, 1, 5), "Al Ruiz", "Beta", "Alpha")]
    assert rejects.count() == 4


def test_chunks_are_bounded_by_rows(spark):
    """A third of all moves on one member and one day, and a tenth at one moment."""
    rng = random.Random(3)
    day = datetime(2024, 1, 5)
    rows = [(i, day + timedelta(seconds=i), 1, 7, rng.choice(["add", "drop"]), None) for i in range(1500)]
    rows += [(5000 + i, day + timedelta(hours=30), 1, 7, rng.choice(["add", "drop"]), None) for i in range(500)]
    rows += [(9000 + i, datetime(2024, 1, 1) + timedelta(minutes=9 * i), rng.randint(0, 3), rng.randint(0, 40), rng.choice(["add", "drop"]), None) for i in range(2500)]
    df = spark.createDataFrame(rows, ACTION_SCHEMA).repartition(5)
    part = scan.order_chunks(df, ["ts", "seq"], 45)
    sizes = [r["count"] for r in df.groupBy("entity", "member", part.alias("part")).count().collect()]
    assert max(sizes) < 2 * len(rows) / 45
    by_rows = intervals.build_intervals(df, ["ts", "seq"], "ts", lambda ts: scan.order_chunks(df, ["ts", "seq"], 45))
    by_day = intervals.build_intervals(df, ["ts", "seq"], "ts", F.to_date)
    plain = intervals.build_intervals(df, ["ts", "seq"], "ts")
    want = sorted(by_day.collect(), key=str)
    assert sorted(by_rows.collect(), key=str) == want == sorted(plain.collect(), key=str)
    assert scan.order_chunks(df.limit(0), ["ts", "seq"]) is not None

"""Streams over several landed files equal the batch answer."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from contestlake.operators import intervals, joins, ranking, rederive
from contestlake.sources import sinks
from contestlake.streaming import keyed as K
from contestlake.streaming import pipelines as P
from tests.test_operators import ACTION_SCHEMA, random_actions


def land(spark, rows, schema, folder, parts):
    """Write rows in order as separate files."""
    size = (len(rows) + parts - 1) // parts
    for i in range(parts):
        chunk = rows[i * size:(i + 1) * size]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(folder)


def test_dedup_and_closed_windows(spark, folder):
    start = datetime(2024, 1, 1)
    rows = [(i % 40, start + timedelta(hours=6 * i), 1) for i in range(80)]
    schema = "uid long, ts timestamp_ntz, n long"
    land(spark, rows, schema, f"{folder}/in", 3)
    s = P.event_time(P.parquet_stream(spark, f"{folder}/in", spark.createDataFrame([], schema).schema), delay="1 day")
    out = P.drain(P.tumbling(s, "ts", 7, "4 days", [], [F.sum("n").alias("n")]), "t", f"{folder}/run")
    got = {r.start: r.n for r in out.collect()}
    # 20 days of rows: two whole weeks are closed, the third is still open.
    assert got == {datetime(2024, 1, 1): 28, datetime(2024, 1, 8): 28}
    d = P.event_time(P.parquet_stream(spark, f"{folder}/in", spark.createDataFrame([], schema).schema), delay="30 days")
    assert P.drain(P.unseen(d, "uid").select("uid"), "d", f"{folder}/dedup").count() == 40


def purchases(stream):
    return stream.select("member", "at", "seq", F.col("cents").alias("amount"))


def test_newest_state_across_batches_and_restart(spark, folder):
    rng = random.Random(1)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice([1, 1, 1, 2, 3]), start + timedelta(hours=i), i, rng.randint(0, 9)) for i in range(90)]
    rng.shuffle(rows)
    rows.append((None, start, 900, 1))
    schema = T.StructType([T.StructField("member", T.LongType()), T.StructField("at", T.TimestampNTZType()),
                           T.StructField("seq", T.LongType()), T.StructField("cents", T.LongType())])
    land(spark, rows[:60], schema, f"{folder}/in", 3)
    run = lambda: K.run(K.newest(purchases(P.parquet_stream(spark, f"{folder}/in", schema, 1)), 7, 2), f"{folder}/run")
    run()
    land(spark, rows[60:], schema, f"{folder}/in", 2)
    updates = run()
    got = sorted(K.newest_rows(spark, f"{folder}/run").collect())
    want = ranking.top_k(spark.createDataFrame(rows[:-1], schema), ["member"], [F.desc("at"), F.desc("seq")], 7).drop("rank")
    assert got == sorted(tuple(r) for r in want.collect())
    last = {r.member: r for r in updates.orderBy("at").collect()}
    for member in (1, 2, 3):
        held = [r.cents for r in want.where(F.col("member") == member).orderBy(F.desc("at")).collect()]
        assert last[member].games == 7 and last[member].recent == sum(held[:2]) / 2 and last[member].prior == sum(held[2:]) / 5
    beats = spark.read.parquet(f"{folder}/run/heartbeat")
    assert beats.where("status = 'stopped'").count() == 2 and beats.agg(F.sum("rows")).first()[0] == len(rows)


def timed_actions(seed, n):
    return [(s, t + timedelta(minutes=s), e, m, a, c) for s, t, e, m, a, c in random_actions(seed, n)]


def test_membership_across_batches(spark, folder):
    actions = sorted(timed_actions(6, 200), key=lambda a: a[1])
    schema = spark.createDataFrame([], ACTION_SCHEMA).schema
    run = lambda: K.run(K.closed_intervals(P.parquet_stream(spark, f"{folder}/in", schema, 1), "ts", "seq"), f"{folder}/run")
    land(spark, actions[:120], ACTION_SCHEMA, f"{folder}/in", 3)
    run()
    land(spark, actions[120:], ACTION_SCHEMA, f"{folder}/in", 1)
    closed = run()
    got = K.all_intervals(spark, closed, f"{folder}/run")
    want = intervals.build_intervals(spark.createDataFrame(actions, ACTION_SCHEMA), ["ts", "seq"], "ts").select(*got.columns)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    # The store holds what is open, however long the closed history is.
    assert K.state(spark, f"{folder}/run", "open").count() == want.where("to_ts is null").count() < want.count()


def test_open_intervals_share_cells(spark, folder, monkeypatch):
    # The store is asked once per cell, however many members there are.
    monkeypatch.setattr(K, "CELLS", 3)
    actions = sorted(timed_actions(8, 200), key=lambda a: a[1])
    schema = spark.createDataFrame([], ACTION_SCHEMA).schema
    land(spark, actions, ACTION_SCHEMA, f"{folder}/in", 4)
    closed = K.run(K.closed_intervals(P.parquet_stream(spark, f"{folder}/in", schema, 1), "ts", "seq"), f"{folder}/run")
    got = K.all_intervals(spark, closed, f"{folder}/run")
    want = intervals.build_intervals(spark.createDataFrame(actions, ACTION_SCHEMA), ["ts", "seq"], "ts").select(*got.columns)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    held = K.state(spark, f"{folder}/run", "open")
    assert held.select("key").distinct().count() <= 3 < held.count()


def test_first_sightings_expire(spark, folder):
    start = datetime(2024, 1, 1)
    days = [0, 1, 2, 9, 10, 11, 30]
    rows = [(d % 2, start + timedelta(days=d), i) for i, d in enumerate(days)]
    schema = "uid long, ts timestamp_ntz, place long"
    land(spark, rows, schema, f"{folder}/in", 7)
    s = lambda: P.parquet_stream(spark, f"{folder}/in", spark.createDataFrame([], schema).schema, 1)
    forever = K.run(K.first_seen(s(), "uid", "ts", "place"), f"{folder}/a")
    assert {r.place for r in forever.where("is_new").collect()} == {0, 1}
    expiring = K.run(K.first_seen(s(), "uid", "ts", "place", keep_days=3), f"{folder}/b")
    # Uid 0 on days 0, 2, 10, 30 and uid 1 on days 1, 9, 11.
    assert {r.place for r in expiring.where("is_new").collect()} == {0, 1, 3, 4, 6}
    held = {r.uid for r in K.state(spark, f"{folder}/b", "seen").select("key.uid").collect()}
    assert held == {0}  # uid 1 was last seen nineteen days ago


def moves(stream):
    pick = lambda action: stream.where(F.col("action") == action).select("member", "entity", "ts")
    return P.followed(pick("drop"), pick("add"), 3, "6 hours")


def test_followed_across_batches_and_late_rows(spark, folder):
    actions = sorted((a for a in timed_actions(12, 300) if a[4] in ("add", "drop")), key=lambda a: a[1])
    reached = actions[len(actions) // 2][1] - timedelta(hours=12)
    late = [a for a in actions if a[1] < reached and a[0] % 3 == 0]  # come in the last part, behind the watermark
    landed = [a for a in actions if a not in late]
    schema = spark.createDataFrame([], ACTION_SCHEMA).schema
    assert len(late) > 5
    for part in (landed[: len(landed) // 3], landed[len(landed) // 3 : 2 * len(landed) // 3], late + landed[2 * len(landed) // 3 :]):
        spark.createDataFrame(part, ACTION_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = P.parquet_stream(spark, f"{folder}/in", schema)
        pairs = P.drain(moves(stream), "f", f"{folder}/run")
        missed = P.late_table(stream.where("action in ('add', 'drop')"), F.col("action"), 2, "ts", 6 * 3600, "l", f"{folder}/run")
    assert sorted(r.seq for r in missed.collect()) == sorted(a[0] for a in late)
    df = spark.createDataFrame(landed, ACTION_SCHEMA)
    want = joins.follow_counts(df.where("action='drop'"), df.where("action='add'"))
    got = {(r.victim, r.sniper): r.n for r in pairs.groupBy("victim", "sniper").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(r.victim, r.sniper): r.n for r in want.collect()} and got


def test_late_facts_are_rederived(spark):
    actions = timed_actions(8, 240)
    order = ["ts", "seq"]
    log = spark.createDataFrame(actions, ACTION_SCHEMA)
    full = intervals.build_intervals(log, order, "ts")
    key = ["entity", "member", "from_ts"]
    for late in (F.col("seq") % 7 == 0, F.col("member") == actions[0][3], F.lit(False)):
        stored = intervals.build_intervals(log.where(~late), order, "ts")
        changes = rederive.interval_changes(stored, log, log.where(late), order, "ts")
        assert sorted(rederive.applied(stored, changes, key).collect(), key=str) == sorted(full.collect(), key=str)
    assert changes.count() == 0
    # A withdrawn action is fresh, and the log lacks it.
    gone = F.col("seq") % 11 == 0
    changes = rederive.interval_changes(full, log.where(~gone), log.where(gone), order, "ts")
    want = intervals.build_intervals(log.where(~gone), order, "ts")
    assert sorted(rederive.applied(full, changes, key).collect(), key=str) == sorted(want.collect(), key=str)
    assert {"update", "delete"} <= {r.op for r in changes.collect()}


def test_change_set_of_repeated_rows(spark):
    schema = "k long, a string"
    old = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (2, "y"), (None, "n")], schema)
    new = spark.createDataFrame([(1, "x"), (1, "z"), (3, "q"), (None, "m")], schema)
    changes = rederive.change_set(old, new, ["k"])
    assert sorted(rederive.applied(old, changes, ["k"]).collect(), key=str) == sorted(new.collect(), key=str)
    assert rederive.change_set(old, old, ["k"]).count() == 0
    assert rederive.change_set(old, old.limit(0), ["k"]).where("op = 'delete'").count() == 5


def test_poll_runs_until_stopped(spark, folder):
    schema = "uid long, ts timestamp_ntz"
    land(spark, [(i, datetime(2024, 1, 1)) for i in range(10)], schema, f"{folder}/in", 2)
    s = P.parquet_stream(spark, f"{folder}/in", spark.createDataFrame([], schema).schema, 1)
    q = P.poll(s, "poll", f"{folder}/run", "1 second")
    q.processAllAvailable()
    land(spark, [(i, datetime(2024, 1, 2)) for i in range(5)], schema, f"{folder}/in", 1)
    q.processAllAvailable()
    P.heartbeat(spark, q, "poll", f"{folder}/run")
    q.stop()
    assert spark.read.parquet(f"{folder}/run/out").count() == 15
    beats = spark.read.parquet(f"{folder}/run/heartbeat")
    assert beats.where("status = 'active'").count() == 1 and beats.agg(F.sum("rows")).first()[0] == 15
    ran = []
    P.lanes(lambda: ran.append("fast"), lambda: ran.append("slow"), 5, 2)
    assert ran.count("fast") == 5 and ran.count("slow") == 3


def test_alert_sink_upserts(spark, folder):
    schema = "uid long, ts timestamp_ntz, text string, month string"
    start = datetime(2024, 1, 1)
    rows = [(i % 7, start + timedelta(hours=i), "Placed on Injured List" if i % 2 else "Number Change", "2024-01") for i in range(30)]
    land(spark, rows, schema, f"{folder}/in", 3)
    s = P.parquet_stream(spark, f"{folder}/in", spark.createDataFrame([], schema).schema, 1)
    known = spark.createDataFrame([(1, "a"), (3, "b")], "uid long, member string")
    hits = P.known_alerts(s, known, "uid", "text", "injured|trade")

    def write(batch, number):
        sinks.write_upsert(batch.sparkSession, f"{folder}/alerts", batch, ["uid"], "ts", "month")

    P.each_batch(hits, write, "a", f"{folder}/run")
    got = {r.uid: r.ts for r in spark.read.parquet(f"{folder}/alerts").collect()}
    want = {}
    for uid, ts, text, _ in rows:
        if uid in (1, 3) and "Injured" in text:
            want[uid] = ts
    assert got == want

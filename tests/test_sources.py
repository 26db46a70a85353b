"""Readers and writers on files written by hand."""

import json
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from contestlake.functions.calendars import Calendar
from contestlake.operators import intervals
from contestlake.sources import captures, feeds, ingest, landing, sinks

TEAMS = ["Alpha Dogs", "Beta", "O'Neil Club"]
STAMP = "source: http://x/y\ncaptured: 2026-08-02 11:35\n---\n"


def put(folder, name, text, stamp=True):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write((STAMP if stamp else "") + text)
    return path


NEW_LOG = """DATE|TEAM|PLAYERS|EFFECTIVE|COST
8/2/26 1:05 PM ET|Beta|José Ruíz OF,1B • NYY - Added; Al O'Neil Jr. P | BOS - Dropped|8/3/26|$2.50
8/1/26 9:00 AM ET|Alpha Dogs|Bo Diaz SP • LAD - Traded from O'Neil Club||
8/1/26 9:00 AM ET|Nobody|Bo Diaz SP • LAD - Added||
8/1/26 9:00 AM ET|Beta|Bo Diaz with no separator||
8/1/26 8:00 AM ET|Beta|Cy Young P • NYY - Called Up; Di Fox C • SF - Move to Injured||$0.00
"""

OLD_LOG = """Some heading
8/2/26 1:05 PM ET Beta José Ruíz OF • NYY - Added
Al Neil P • BOS - Dropped 8/3/26 $2.50
View details
8/1/26 9:00 AM ET O'Neil Club Bo Diaz SP • LAD - Traded to Alpha Dogs
8/1/26 9:00 AM ET Nobody Bo Diaz SP • LAD - Added
"""


def test_new_transactions(spark, folder):
    path = put(folder, "t.txt", NEW_LOG)
    rows, rejects = captures.transactions(captures.strip_stamp(captures.read_lines(spark, path)), TEAMS)
    got = {r.posted_at: r for r in rows.collect()}
    first = got[datetime(2026, 8, 2, 13, 5)]
    assert [(a.player, a.positions, a.mlb_team, a.action) for a in first.actions] == [
        ("José Ruíz", "OF,1B", "NYY", "add"), ("Al O'Neil Jr.", "P", "BOS", "drop")]
    assert first.effective_date == date(2026, 8, 3) and float(first.cost) == 2.5
    trade = got[datetime(2026, 8, 1, 9)]
    assert (trade.actions[0].action, trade.actions[0].counterparty, trade.cost) == ("trade", "O'Neil Club", None)
    assert [a.action for a in got[datetime(2026, 8, 1, 8)].actions] == ["move_from_minors", "move_to_il"]
    assert rejects.count() == 2


def test_old_transactions_fold(spark, folder):
    path = put(folder, "t.txt", OLD_LOG, stamp=False)
    rows, rejects = captures.transactions_old(captures.strip_stamp(captures.read_lines(spark, path)), TEAMS)
    got = {r.team: r for r in rows.collect()}
    assert [a.action for a in got["Beta"].actions] == ["add", "drop"]
    assert got["Beta"].effective_date == date(2026, 8, 3) and float(got["Beta"].cost) == 2.5
    assert got["O'Neil Club"].actions[0].counterparty == "Alpha Dogs"
    assert rejects.count() == 1


def test_layouts_give_one_uid(spark, folder):
    new = put(folder, "new.txt", "DATE|TEAM|PLAYERS|EFFECTIVE|COST\n8/2/26 1:05 PM ET|Beta|José Ruiz OF • NYY - Added|8/3/26|$2.50\n")
    old = put(folder, "old.txt", "8/2/26 1:05 PM ET Beta Jose Ruiz OF • NYY - Added 8/3/26 $2.50\n", stamp=False)
    lines = captures.strip_stamp(captures.read_lines(spark, [new, old]))
    rows, _ = captures.sniffed_transactions(lines, TEAMS)
    txn, _ = ingest.transaction_tables(rows)
    assert rows.count() == 2 and txn.select("uid").distinct().count() == 1


def test_small_splits_keep_file_order(spark, folder):
    """A file cut into many splits parses like a whole one."""
    body = "".join(f"=== Period {p} (x) ===\nTeam|HR|Pts|Dif\n" + "".join(f"{t}|{p + i}|{i}|0\n" for i, t in enumerate(TEAMS)) +
                   "Team|HR|Pts|Dif\nBeta|99|9|9\n" for p in range(1, 60))
    path = put(folder, "p.txt", body, stamp=False)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = captures.read_lines(spark, path)
        assert lines.select("blk").distinct().count() > 5
        rows = captures.by_period(lines, TEAMS).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(rows) == 59 * 3
    assert all(r.value == r.period + TEAMS.index(r.team) for r in rows)


def test_pool(spark, folder):
    stats = "|".join(["10"] * 14 + ["--"])
    text = f"ACTION|x\n1|2|Avail|Player|{stats}|5\n77||W (8/4)|Al Ruiz OF,C • NYY|{stats}|12\n78||FA|Bo Diaz C • LAD|{stats}|n/a\n79||FA|broken cell|{stats}|1\nshort|row\n"
    rows, rejects = captures.pool(captures.strip_stamp(captures.read_lines(spark, put(folder, "p.psv", text))), "bat")
    got = {r.strong_id: r for r in rows.collect()}
    assert (got["77"].avail, got["77"].waiver_clear, got["77"].rank, got["77"].positions) == ("W", "8/4", 12, ["OF", "C"])
    assert got["78"].rank is None and got["78"].stats["ab"] == 10.0 and got["78"].stats["slg"] is None
    assert rejects.count() == 2


def test_standings_page_and_text_agree(spark, folder):
    page = "RANK\tTEAM\n1\tBeta\t1\t2\t3\t0\t0\nBatting Breakdown\nTEAM\tHR\tPTS\tDIF\nBeta\t30\t3\t0\nAlpha Dogs\t20\t2\t0\nPitching Breakdown\nTEAM\tERA\tPTS\tDIF\nBeta\t3.50\t2\t0\n"
    text = "OVERALL\nRANK TEAM\n1 Beta 1 2 3 0 0\n\nBATTING: HR\nBeta 30 3 | Alpha Dogs 20 2\n\nPITCHING: ERA\nBeta 3.50 2\n"
    a = captures.standings_page(captures.read_lines(spark, put(folder, "a.txt", page, False))).select("metric", "team", "value", "points")
    b = captures.standings_text(captures.read_lines(spark, put(folder, "b.txt", text, False))).select("metric", "team", "value", "points")
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 3
    top = captures.overall_page(captures.read_lines(spark, os.path.join(folder, "a.txt"))).first()
    assert (top["rank"], top.team, top.total) == (1, "Beta", 3.0)


def test_grids_agree(spark, folder):
    wide = "TEAM|C|1B|OF|P\nBeta|Al Ruiz; Bo Diaz (I)||Cy Fox (M)|S Ohta (Pitcher) (R)\nNobody|X|Y|Z|W\n"
    tall = "legend: x\nBeta\nC: Al Ruiz, Bo Diaz (I) | OF: Cy Fox (M) | P: S Ohta (Pitcher) (R)\n"
    a = captures.roster_grid(captures.strip_stamp(captures.read_lines(spark, put(folder, "a.txt", wide))), TEAMS).drop("path")
    b = captures.roster_grid_old(captures.strip_stamp(captures.read_lines(spark, put(folder, "b.txt", tall))), TEAMS).drop("path")
    assert sorted(a.collect()) == sorted(b.collect())
    assert {(r.label, r.status) for r in a.collect()} == {("Al Ruiz", "active"), ("Bo Diaz", "il"), ("Cy Fox", "minors"), ("S Ohta (Pitcher)", "reserve")}


def test_draft_stops_at_chat(spark, folder):
    text = "ROUND 1\n1 Beta *Al Ruiz OF • NYY x\n2 O'Neil Club **Bo Diaz C,1B • LAD\nodd line\nROUND 2\n1 Alpha Dogs Cy Fox P • SF\n=== chat\n1 Beta Not Me OF • NYY\n"
    picks, rejects = captures.draft(captures.read_lines(spark, put(folder, "d.txt", text, False)), TEAMS)
    got = {r.player: (r.round, r.overall, r.team, r.auto, r.queued) for r in picks.collect()}
    assert got == {"Al Ruiz": (1, 1, "Beta", True, False), "Bo Diaz": (1, 2, "O'Neil Club", False, True), "Cy Fox": (2, 4, "Alpha Dogs", False, False)}
    assert rejects.count() == 1


def test_news_body_is_whole(spark, folder):
    text = "Al Ruiz OF • NYY\nClub's Al: Hot\nby Staff\n(2 hrs ago) " + "x" * 1500 + "\n\n" + "y" * 3000 + "\nBo Diaz C • LAD\nno colon here\n(1 hr ago) z\n"
    rows, rejects = captures.news(captures.read_lines(spark, put(folder, "n.txt", text, False)))
    r = rows.first()
    assert (r.player, r.headline, r.age_text) == ("Al Ruiz", "Club's Al: Hot", "2 hrs ago")
    assert r.body == "x" * 1500 + " " + "y" * 3000
    assert rejects.count() == 1


def test_lineups_both_widths(spark, folder):
    text = "Beta|3|active|OF|Al Ruiz OF • NYY\nBeta|3|bench|P|77|Bo Diaz P • LAD\nNobody|3|active|OF|Al Ruiz OF • NYY\nbad\n"
    rows, rejects = captures.lineups(captures.read_lines(spark, put(folder, "l.psv", text, False)), TEAMS)
    assert {(r.player, r.section, r.strong_id) for r in rows.collect()} == {("Al Ruiz", "active", None), ("Bo Diaz", "bench", "77")}
    assert rejects.count() == 2


def test_pitch_and_batted_feed(spark, folder):
    def pitch(code, call, speed, hit=None):
        e = {"isPitch": True, "details": {"type": {"code": code}, "call": {"code": call}}, "pitchData": {"startSpeed": speed}}
        if hit:
            e["hitData"] = hit
        return e

    doc = {"gamePk": 1, "gameData": {"datetime": {"officialDate": "2026-05-01"}}, "liveData": {"plays": {"allPlays": [
        {"matchup": {"pitcher": {"id": 9}, "batter": {"id": 5}}, "playEvents": [
            pitch("FF", "S", 95.0), pitch("FF", "C", 96.0), pitch("SL", "B", 85.0), pitch("SL", "X", 86.0, {"launchSpeed": 100.0, "launchAngle": 28.0}), {"isPitch": False}]}]}}}
    put(folder, "g.json", json.dumps(doc), False)
    feed = feeds.read_feed(spark, folder, feeds.PLAY_FEED)
    p = feeds.pitch_games(feed).first()
    assert (p.member, p.ff_avg, p.n_ff, p.n_pitches, p.whiff_pct, p.csw_pct) == (9, 95.5, 2, 4, 0.5, 0.5)
    assert p.mix == {"FF": 0.5, "SL": 0.5} and p.date == date(2026, 5, 1)
    b = feeds.batted_games(feed).first()
    assert (b.member, b.bbe, b.ev_mean, b.hardhit, b.barrels) == (5, 1, 100.0, 1, 1)


def test_leaderboard_with_mark(spark, folder):
    with open(os.path.join(folder, "b.csv"), "w", encoding="utf-8") as f:
        f.write('﻿"player_id","woba","est_woba"\n1,.350,.310\n2,null,.300\n')
    rows = feeds.read_leaderboard(spark, os.path.join(folder, "b.csv"), ["player_id", "woba", "est_woba"])
    assert sorted((r.player_id, r.woba) for r in rows.collect()) == [(1.0, 0.35), (2.0, None)]


def test_landing(spark, folder):
    for day, files in {"2026-08-01": {"a.txt": "x", "b.txt": ""}, "2026-08-02": {"a.txt": "y"}}.items():
        os.makedirs(f"{folder}/{day}")
        for name, text in files.items():
            put(f"{folder}/{day}", name, text, False)
    found = landing.file_list(spark, folder)
    days = spark.createDataFrame([("2026-08-01",), ("2026-08-02",)], "date string")
    got = {(r.date, r.file, r.state) for r in landing.missing_artifacts(found, days, ["a.txt", "b.txt"]).collect()}
    assert got == {("2026-08-01", "b.txt", "empty"), ("2026-08-02", "b.txt", "missing")}
    asks = spark.createDataFrame([("a.txt", "2026-08-05"), ("a.txt", "2026-08-01"), ("a.txt", "2026-07-01")], "file string, date string")
    use = {r.date: r.from_date for r in landing.latest_available(found, asks).collect()}
    assert use == {"2026-08-05": "2026-08-02", "2026-08-01": "2026-08-01", "2026-07-01": None}
    manifest = spark.createDataFrame([("d", "- `a.txt` <- `x/y` (120 chars)"), ("d", "- `b.txt` <- `z` (-1 chars)")], "date string, line string")
    assert [r.file for r in landing.failed_pages(manifest).collect()] == ["b.txt"]


def test_upsert_touches_changed_partitions_only(spark, folder):
    schema = "uid int, v string, observed_at int, month string"
    table = f"{folder}/t"
    up = lambda rows: sinks.write_upsert(spark, table, spark.createDataFrame(rows, schema), ["uid"], "observed_at", "month")
    up([(1, "a", 1, "m1"), (2, "b", 1, "m2")])
    before = {f for f in os.listdir(f"{table}/month=m1") if f.endswith(".parquet")}
    up([(2, "c", 2, "m2"), (3, "d", 1, "m2")])
    up([(2, "c", 2, "m2"), (3, "d", 1, "m2")])
    up([(2, "old", 0, "m2")])
    rows = sorted((r.uid, r.v) for r in spark.read.parquet(table).collect())
    assert rows == [(1, "a"), (2, "c"), (3, "d")]
    assert before == {f for f in os.listdir(f"{table}/month=m1") if f.endswith(".parquet")}


def test_ingest_twice_is_once(spark, folder):
    day, lake = f"{folder}/2026-08-02", f"{folder}/lake"
    os.makedirs(day)
    put(day, "transactions_all_raw.txt", NEW_LOG)
    put(day, "standings_byperiod_all.txt", "=== Period 1 (x) ===\nTeam|HR|Pts|Dif\nBeta|3|2|0\n=== Period 27 (x) ===\nTeam|HR|Pts|Dif\nBeta|9|2|0\n", False)
    put(day, "roster_grid.txt", "TEAM|C|1B|OF|P\nBeta|Al Ruiz; Bo Diaz (I)|||\n")
    put(day, "player_news_raw.txt", "Al Ruiz OF • NYY\nClub's Al: Hurt\nby Staff\n(2 hrs ago) out 4-to-6 weeks\n")
    stats = "|".join(["1"] * 15)
    put(day, "fa_pool_batters.psv", f"77||FA|Al Ruiz OF • NYY|{stats}|12\n")
    cal = Calendar(date(2026, 3, 25), date(2026, 3, 30), 27)
    present = set(os.listdir(day))
    for _ in range(2):
        ingest.run_ingest(spark, day, lake, datetime(2026, 8, 2, 12), TEAMS, cal, present)
    n = lambda t: spark.read.parquet(f"{lake}/{t}").count()
    assert (n("ev_txn"), n("ev_txn_action"), n("snap_grid_entry"), n("ev_news"), n("snap_pool_entry")) == (3, 5, 2, 1, 1)
    assert [r.period for r in spark.read.parquet(f"{lake}/snap_period_line").collect()] == [1]
    assert spark.read.parquet(f"{lake}/ev_news").first().return_weeks == 5.0
    assert [r.status for r in sinks.last_runs(spark.read.parquet(f"{lake}/ops_runs")).collect()] == ["complete"]
    # The log of the warehouse is what the interval builder takes.
    log = ingest.reconcile_state(lake, spark)
    held = intervals.build_intervals(log, ["effective", "posted_at", "uid", "idx"], "effective")
    opening = log.where(F.col("action").isin(*intervals.OPENING, "trade")).select("entity", "member").distinct().count()
    assert 0 < held.where("to_ts is null").count() <= opening
    # Fees are not multiplied by the actions of a transaction.
    fees = spark.read.parquet(f"{lake}/ev_txn").groupBy("team").agg(F.sum("cost").alias("c"))
    assert {r.team: r.c for r in fees.collect()}["Beta"] == 2.5


def test_ingest_keeps_what_the_files_say(spark, folder):
    """Stats, stated ranks, rejects by file, first sightings, routed members; read back from the tables."""
    lake = f"{folder}/lake"
    cal = Calendar(date(2026, 3, 25), date(2026, 3, 30), 27)
    stats = "|".join(str(i) for i in range(15))
    news = "Al Ruiz OF • NYY\nClub's Al: Hurt\nby Staff\n(2 hrs ago) out 4-to-6 weeks\n"
    more = news + "Bo Diaz C • LAD\nClub's Bo: Back\nby Staff\n(1 hr ago) plays\n"
    top = "1\tBeta\t40\t30\t70\t0\tx\n2\tAlpha Dogs\t30\t20.5\t50.5\t0\tx\nBatting Breakdown\n"
    ids = spark.createDataFrame([("M1", "77", "x", "bat"), ("M2", None, "bo diaz", "bat")], "uid string, strong_id string, name string, side string")
    for day, text in ((2, news), (3, more), (3, more)):
        at = f"{folder}/2026-08-0{day}"
        os.makedirs(at, exist_ok=True)
        put(at, "player_news_raw.txt", text)
        put(at, "fa_pool_batters.psv", f"77||FA|Al Ruiz OF • NYY|{stats}|12\n||FA|Bo Diaz OF • NYY|{stats}|13\nbroken line\n")
        put(at, "standings_overall_raw.txt", top, False)
        ingest.run_ingest(spark, at, lake, datetime(2026, 8, day, 12), TEAMS, cal, set(os.listdir(at)), ids)
    table = lambda t: spark.read.parquet(f"{lake}/{t}")
    pool = {(r.player, str(r.day)): r for r in table("snap_pool_entry").collect()}
    assert len(pool) == 4
    assert {pool["Al Ruiz", "2026-08-03"].member, pool["Bo Diaz", "2026-08-03"].member} == {"M1", "M2"}
    assert sorted(e.value for e in pool["Al Ruiz", "2026-08-02"].stats) == [float(i) for i in range(15)]
    assert {(r.rank, r.team, r.total) for r in table("snap_overall_line").where("day(as_of) = 3").collect()} == {(1, "Beta", 70.0), (2, "Alpha Dogs", 50.5)}
    found = {r.headline: r for r in table("ev_news").collect()}
    assert [(found[h].first_seen.day, found[h].is_new) for h in ("Club's Al: Hurt", "Club's Bo: Back")] == [(2, False), (3, True)]
    roster = table("ev_news").select("member").distinct()
    assert [r.headline for r in ingest.fresh_news(table("ev_news"), datetime(2026, 8, 3, 12), roster).collect()] == ["Club's Bo: Back"]
    assert {(str(r.run_id), r.artifact, r.line) for r in table("ops_rejects").collect()} == {
        (f"2026-08-0{d}", "fa_pool_batters.psv", "broken line") for d in (2, 3)}


def test_a_failed_run_is_recorded(spark, folder):
    day, lake = f"{folder}/2026-08-02", f"{folder}/lake"
    os.makedirs(day)
    cal = Calendar(date(2026, 3, 25), date(2026, 3, 30), 27)
    with pytest.raises(Exception):
        ingest.run_ingest(spark, day, lake, datetime(2026, 8, 2, 12), TEAMS, cal, {"roster_grid.txt"})
    assert [r.status for r in sinks.last_runs(spark.read.parquet(f"{lake}/ops_runs")).collect()] == ["failed"]


def test_a_missing_file_comes_from_the_newest_earlier_day(spark, folder):
    lake = f"{folder}/lake"
    cal = Calendar(date(2026, 3, 25), date(2026, 3, 30), 27)
    stats = "|".join(["1"] * 15)
    pool = lambda who: f"77||FA|{who} OF • NYY|{stats}|12\n"
    for day, files in {
        "2026-08-01": {"fa_pool_batters_period18.psv": pool("Old Name"), "roster_grid.txt": "TEAM|C|1B|OF|P\nBeta|Al Ruiz|||\n"},
        "2026-08-02": {"fa_pool_batters.psv": pool("Al Ruiz"), "fa_pool_batters_period19.psv": pool("Wrong File"), "roster_grid.txt": ""},
        "2026-08-03": {"fa_pool_batters.psv": ""},
    }.items():
        os.makedirs(f"{folder}/days/{day}")
        for name, text in files.items():
            put(f"{folder}/days/{day}", name, text, bool(text))
    found = landing.file_list(spark, f"{folder}/days")
    picked = landing.pick(found, "2026-08-03", ingest.FILES)
    assert {f: (p.rsplit("/", 2)[1:], d) for f, (p, d) in picked.items()} == {
        "fa_pool_batters.psv": (["2026-08-02", "fa_pool_batters.psv"], "2026-08-02"), "roster_grid.txt": (["2026-08-01", "roster_grid.txt"], "2026-08-01")}
    assert landing.pick(found, "2026-08-01", ["fa_pool_batters.psv"])["fa_pool_batters.psv"][0].endswith("fa_pool_batters_period18.psv")
    ingest.run_ingest(spark, f"{folder}/days/2026-08-03", lake, datetime(2026, 8, 3, 12), TEAMS, cal, landed=found)
    entry = spark.read.parquet(f"{lake}/snap_pool_entry").first()
    assert (entry.player, str(entry.day), entry.observed_at.day) == ("Al Ruiz", "2026-08-02", 2)
    grid = spark.read.parquet(f"{lake}/snap_grid_entry").first()
    assert (grid.label, str(grid.day)) == ("Al Ruiz", "2026-08-01")

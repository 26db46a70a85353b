"""JSON feeds that Spark writes from the driver tables and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestlake.plans import league as L
from contestlake.plans.registry import query, rnd
from contestlake.sources import feeds as S
from contestlake.sources import landing


def _parsed(rows, column, schema, keep=()):
    """JSON text of ``column`` read with the feed's fixed schema."""
    doc = rows.select(*keep, F.to_json(column).alias("doc"))
    return doc.select(*keep, F.from_json("doc", schema).alias("j")).select(*keep, "j.*")


def _id(column):
    return F.struct(column.alias("id"))


def play_feed(spark, sf):
    """An order is a game, its lines are plays of one event."""
    n = F.col("l_linenumber")
    code = F.when(F.col("l_returnflag") == "R", "FF").when(F.col("l_returnflag") == "A", "SL")
    call = F.get(F.array(*[F.lit(c) for c in "SWCXB"]), (n % 5).cast("int"))
    event = F.struct(
        (n % 6 != 0).alias("isPitch"), F.struct(F.struct(code.alias("code")).alias("type"), F.struct(call.alias("code")).alias("call")).alias("details"),
        F.struct(F.when(n != 4, F.col("l_quantity")).alias("startSpeed")).alias("pitchData"),
        F.when(F.col("l_linestatus") == "O", F.struct((60 + F.col("l_quantity")).alias("launchSpeed"), (n * 7.0).alias("launchAngle"))).alias("hitData"))
    play = F.struct(F.struct(_id(F.col("l_suppkey") % 3).alias("pitcher"), _id(F.col("l_partkey") % 4).alias("batter")).alias("matchup"),
                    F.array(event).alias("playEvents"))
    games = L.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(play).alias("allPlays"))
    game = games.join(L.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    doc = F.struct(
        F.col("o_orderkey").alias("gamePk"),
        F.struct(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("officialDate")).alias("datetime")).alias("gameData"),
        F.struct(F.struct("allPlays").alias("plays")).alias("liveData"))
    return _parsed(game, doc, S.PLAY_FEED)


@query("feed_pitch_games", f"""
WITH e AS (SELECT l_suppkey%3 AS member, l_orderkey AS game_pk, CASE l_returnflag WHEN 'R' THEN 'FF' WHEN 'A' THEN 'SL' END AS code, substr('SWCXB',cast(l_linenumber%5+1 AS integer),1) AS call, CASE WHEN l_linenumber<>4 THEN l_quantity END AS speed FROM lineitem WHERE l_linenumber%6<>0),
g AS (SELECT member, game_pk, count(speed) AS n_pitches, sum(CASE WHEN code='FF' THEN speed END) AS fs, count(CASE WHEN code='FF' THEN speed END) AS n_ff, count(CASE WHEN call IN ('S','W','X') THEN 1 END) AS sw,
 count(CASE WHEN call IN ('S','W') THEN 1 END) AS wh, count(CASE WHEN call='C' THEN 1 END) AS ca, count(CASE WHEN code='SL' THEN 1 END) AS sl FROM e GROUP BY 1,2)
SELECT member, game_pk, cast(o_orderdate AS date) AS date, {rnd("fs/nullif(n_ff,0)", 2)} AS ff_avg, n_ff, n_pitches, {rnd("cast(wh AS double)/greatest(sw,1)", 3)} AS whiff_pct,
 {rnd("cast(wh+ca AS double)/greatest(n_pitches,1)", 3)} AS csw_pct, CASE WHEN sl>0 THEN {rnd("cast(sl AS double)/greatest(n_pitches,1)", 3)} END AS slider FROM g JOIN orders ON o_orderkey=game_pk""")
def feed_pitch_games(spark, sf):
    return S.pitch_games(play_feed(spark, sf)).withColumn("slider", F.try_element_at("mix", F.lit("SL"))).drop("mix")


@query("feed_batted_games", f"""
WITH e AS (SELECT l_partkey%4 AS member, l_orderkey AS game_pk, 60+l_quantity AS ls, l_linenumber*7.0 AS la FROM lineitem WHERE l_linestatus='O')
SELECT member, game_pk, cast(o_orderdate AS date) AS date, count(*) AS bbe, {rnd("sum(ls)/count(*)", 1)} AS ev_mean, count(CASE WHEN ls>=95 THEN 1 END) AS hardhit,
 count(CASE WHEN ls>=98 AND la BETWEEN greatest(8.0,26.0-(ls-98)*cast(1.2 AS double)) AND least(50.0,30.0+(ls-98)*1.5) THEN 1 END) AS barrels FROM e JOIN orders ON o_orderkey=game_pk GROUP BY 1,2,3""")
def feed_batted_games(spark, sf):
    return S.batted_games(play_feed(spark, sf))


@query("feed_game_logs", """
SELECT o_custkey AS member, cast(o_orderdate AS date) AS date, o_orderkey AS game_pk, cast(o_orderkey%2 AS integer) AS gs, cast(o_orderkey%5 AS integer) AS er,
 cast((o_orderkey%9)*3+o_orderkey%3 AS integer) AS outs, CASE WHEN o_orderkey%2>=1 AND (o_orderkey%9)*3+o_orderkey%3>=18 AND o_orderkey%5<=3 THEN 1 ELSE 0 END AS qs FROM orders""")
def feed_game_logs(spark, sf):
    k = F.col("o_orderkey")
    stat = F.struct((k % 2).alias("gamesStarted"), (k % 5).alias("earnedRuns"),
                    F.concat((k % 9).cast("string"), F.lit("."), (k % 3).cast("string")).alias("inningsPitched"))
    split = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.struct(k.alias("gamePk")).alias("game"), stat.alias("stat"))
    doc = F.struct(F.col("o_custkey").alias("member"), F.array(F.struct(F.array(split).alias("splits"))).alias("stats"))
    rows = S.game_log_lines(_parsed(L.table(spark, sf, "orders"), doc, S.GAME_LOG), "pit")
    return rows.select("member", "date", "game_pk", "gs", "er", "outs", "qs")


def status_feed(spark, sf):
    k = F.col("o_orderkey")
    words = F.array(*[F.lit(w) for w in ["Placed on Injured List", "Optioned", "Number Change", "Trade", "Signed"]])
    t = F.struct(k.alias("id"), _id(F.col("o_custkey")).alias("person"), F.get(words, (k % 5).cast("int")).alias("typeDesc"),
                 F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.struct(F.lit("Club").alias("name")).alias("toTeam"))
    return _parsed(L.table(spark, sf, "orders"), F.struct(F.array(t).alias("transactions")), S.STATUS_FEED)


@query("feed_status_alerts", """
SELECT 'status:'||o_orderkey AS uid, o_custkey AS member, list_extract(['Placed on Injured List','Optioned','Number Change','Trade','Signed'], cast(o_orderkey%5+1 AS integer)) AS type_desc, cast(o_orderdate AS date) AS date
FROM orders JOIN customer ON c_custkey=o_custkey WHERE c_mktsegment='BUILDING' AND o_orderkey%5 IN (0,1,3)""")
def feed_status_alerts(spark, sf):
    known = L.members(spark, sf).where(F.col("role") == "BUILDING").select(F.col("member").alias("person"), "member")
    return S.alertable(S.status_events(status_feed(spark, sf), known)).select("uid", "member", "type_desc", "date")


def schedule_feed(spark, sf):
    k = F.col("o_orderkey")
    side = lambda p, i: F.struct(F.struct(F.concat(F.lit("T"), (i % 30).cast("string")).alias("name")).alias("team"), p.alias("probablePitcher"))
    game = F.struct(
        k.alias("gamePk"), F.struct(F.col("o_orderstatus").alias("codedGameState")).alias("status"), F.struct(F.concat(F.lit("V"), (k % 30).cast("string")).alias("name")).alias("venue"),
        F.struct(side(F.when(k % 3 == 0, _id(F.col("o_custkey"))), k).alias("home"), side(_id(F.col("o_custkey") + 1), k + 7).alias("away")).alias("teams"),
        F.struct(F.struct(F.struct((k % 11).alias("runs")).alias("home"), F.struct((k % 7).alias("runs")).alias("away")).alias("teams")).alias("linescore"))
    date = F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.array(game).alias("games"))
    return _parsed(L.table(spark, sf, "orders"), F.struct(F.array(date).alias("dates")), S.SCHEDULE_FEED)


@query("feed_games_per_team", """
SELECT team, count(*) AS games FROM (SELECT 'T'||(o_orderkey%30) AS team FROM orders WHERE o_orderstatus IN ('P','F') UNION ALL SELECT 'T'||((o_orderkey+7)%30) FROM orders WHERE o_orderstatus IN ('P','F')) GROUP BY 1""")
def feed_games_per_team(spark, sf):
    return S.games_per_team(schedule_feed(spark, sf))


@query("feed_probable_starts", """
SELECT member, cast(o_orderdate AS date) AS date, o_orderkey AS game_pk, side FROM (SELECT o_custkey AS member, o_orderdate, o_orderkey, 'home' AS side FROM orders WHERE o_orderkey%3=0 UNION ALL SELECT o_custkey+1, o_orderdate, o_orderkey, 'away' FROM orders)
JOIN customer ON c_custkey=member WHERE c_mktsegment='MACHINERY'""")
def feed_probable_starts(spark, sf):
    known = L.members(spark, sf).where(F.col("role") == "MACHINERY").select(F.col("member").alias("probable"), "member")
    return S.probable_starts(schedule_feed(spark, sf), known).select("member", "date", "game_pk", "side")


@query("feed_venue_factor", f"""
WITH g AS (SELECT 'V'||(o_orderkey%30) AS venue, cast(o_orderkey%11+o_orderkey%7 AS bigint) AS runs FROM orders WHERE o_orderstatus='F'), m AS (SELECT venue, count(*) AS n, avg(runs) AS mean FROM g GROUP BY 1 HAVING count(*)>=20)
SELECT venue, n, {rnd("mean", 4)} AS mean, {rnd("mean/(SELECT avg(mean) FROM m)", 4)} AS factor FROM m""")
def feed_venue_factor(spark, sf):
    from contestlake.operators.aggregates import ratio_to_mean

    return ratio_to_mean(S.venue_runs(schedule_feed(spark, sf)), "venue", "runs", 20)


@query("feed_positions_played", """
SELECT user_id AS member, CASE event_type WHEN 'view' THEN 'OF' WHEN 'click' THEN 'OF' WHEN 'error' THEN 'SS' ELSE '1B' END AS position, count(*) AS games FROM events WHERE event_type<>'signup' GROUP BY 1,2""")
def feed_positions_played(spark, sf):
    spots = F.create_map(*[F.lit(x) for kv in {"view": "LF", "click": "CF", "signup": "DH", "error": "SS", "purchase": "1B"}.items() for x in kv])
    split = F.struct(F.struct(spots[F.col("event_type")].alias("abbreviation")).alias("position"))
    doc = F.struct(F.col("user_id").alias("member"), F.array(F.struct(F.array(split).alias("splits"))).alias("stats"))
    return S.positions_played(_parsed(L.table(spark, sf, "events"), doc, S.FIELDING_FEED))


@query("feed_players", """
SELECT c_custkey AS target_id, lower(c_name) AS norm, c_mktsegment='BUILDING' AS flag, cast(c_nationkey AS bigint) AS team FROM customer""")
def feed_players(spark, sf):
    p = F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("fullName"),
                 F.struct(F.when(F.col("c_mktsegment") == "BUILDING", "Pitcher").otherwise("Infielder").alias("type")).alias("primaryPosition"),
                 _id(F.col("c_nationkey")).alias("currentTeam"))
    rows = S.players(_parsed(L.table(spark, sf, "customer"), F.struct(F.array(p).alias("people")), S.PLAYER_FEED))
    return rows.select("target_id", "norm", "flag", "team")


@query("capture_completeness", """
WITH d AS (SELECT DISTINCT source AS date FROM documents), f AS (SELECT source AS date, lang||'-'||(doc_id%40) AS file, max(CASE WHEN n_chars<400 THEN 0 ELSE n_chars END) AS length FROM documents GROUP BY 1,2),
w AS (SELECT date, l||'-'||i AS file FROM d, (SELECT DISTINCT lang AS l FROM documents), range(0,40) t(i))
SELECT w.date, w.file, CASE WHEN length IS NULL THEN 'missing' ELSE 'empty' END AS state FROM w LEFT JOIN f ON f.date=w.date AND f.file=w.file WHERE length IS NULL OR length=0""")
def capture_completeness(spark, sf):
    """Documents as landed files: source is the date, language and slot the file."""
    d = L.table(spark, sf, "documents")
    found = d.select(F.col("source").alias("date"), F.concat_ws("-", "lang", (F.col("doc_id") % 40).cast("string")).alias("file"),
                     F.when(F.col("n_chars") < 400, 0).otherwise(F.col("n_chars")).alias("length"))
    langs = sorted(r[0] for r in d.select("lang").distinct().collect())
    expected = [f"{x}-{i}" for x in langs for i in range(40)]
    return landing.missing_artifacts(found, found.select("date").distinct(), expected)


@query("latest_available_file", """
WITH h AS (SELECT cast(user_id AS varchar) AS file, cast(cast(ts AS date) AS varchar) AS date, max(cast(event_id AS varchar)) AS path FROM events WHERE event_type='purchase' GROUP BY 1,2),
a AS (SELECT DISTINCT cast(user_id AS varchar) AS file, cast(cast(ts AS date) AS varchar) AS date FROM events WHERE event_type='view')
SELECT a.date, a.file, max(h.date) AS from_date, arg_max(h.path, h.date) AS path FROM a LEFT JOIN h ON h.file=a.file AND h.date<=a.date GROUP BY 1,2""")
def latest_available_file(spark, sf):
    e = L.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("file"), F.to_date("ts").cast("string").alias("date"), F.lit(1).alias("length"),
        F.col("event_id").cast("string").alias("path"), "event_type")
    return landing.latest_available(e.where(F.col("event_type") == "purchase"), e.where(F.col("event_type") == "view"))

"""Signal, activity and projection queries.

Appearances: orders of a customer, or the event days of a user.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from contestlake.functions.rates import fixed, ratio
from contestlake.operators import aggregates as A
from contestlake.operators import signals as S
from contestlake.plans import actions as ACT
from contestlake.plans import league as L
from contestlake.plans.registry import query, rnd
from contestlake.session import step

AS_OF = date(2001, 7, 31)
WITH = "WITH " + L.SQL_COMPONENTS
DAYS = """
ud AS (SELECT user_id AS member, cast(ts AS date) AS dt, cast(ts AS date)-DATE '2024-01-01' AS seq,
  cast(sum(CASE WHEN event_type='purchase' THEN 1 ELSE 0 END) AS bigint) AS num, count(*) AS den, cast(sum(cast(round(value*100) AS bigint)) AS bigint) AS cents FROM events GROUP BY 1,2,3),
un AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY dt DESC, seq DESC) AS rn FROM ud)
"""


def order_series(spark, sf):
    """Orders as appearances with revenue per unit in cents."""
    return L.day_lines(spark, sf).where(F.col("qty") >= 8).select(
        "member", F.col("date").alias("at"), F.col("game").alias("seq"), "period", "qty", "rev", "ret", "dsc",
        fixed(ratio(F.col("rev"), F.col("qty"), 0.01), 2).alias("value"))


SER = WITH + f""", se AS (SELECT member, date AS dt, game AS seq, period, qty, rev, ret, dsc,
  {rnd("cast(rev AS double)*cast(0.01 AS double)/cast(qty AS double)", 2)} AS value FROM dl WHERE qty>=8),
sn AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY dt DESC, seq DESC) AS rn FROM se)
"""


def day_series(spark, sf):
    """Event days of a user: purchases out of events."""
    day = F.to_date("ts")
    return L.table(spark, sf, "events").groupBy(
        F.col("user_id").alias("member"), day.alias("at"), F.datediff(day, F.lit(date(2024, 1, 1))).alias("seq")).agg(
        F.sum((F.col("event_type") == "purchase").cast("long")).alias("num"), F.count(F.lit(1)).alias("den"),
        F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


TREND = SER + f""",
ts AS (SELECT member, count(*) AS games, max(dt) AS newest, sum(CASE WHEN rn<=2 THEN value END)/count(CASE WHEN rn<=2 THEN 1 END) AS r,
  sum(CASE WHEN rn>2 THEN value END)/count(CASE WHEN rn>2 THEN 1 END) AS p FROM sn WHERE rn<=7 GROUP BY 1),
td AS (SELECT member, newest, {rnd("r-p", 2)} AS delta FROM ts WHERE games>=4 AND newest>=DATE '2001-01-01'),
tr AS (SELECT member, newest, CASE WHEN delta>=300 THEN 'price_up' ELSE 'price_down' END AS kind, delta, {rnd("least(1.0, abs(delta)/2500.0)", 4)} AS strength FROM td WHERE abs(delta)>=300)
"""


@query("trend_shift", TREND + "SELECT * FROM tr")
def trend_shift(spark, sf):
    return S.trend_shift(order_series(spark, sf), "value", 300.0, unit=2500.0, name="price", since=date(2001, 1, 1))


@query("skill_heat", SER + f""",
a AS (SELECT member, count(*) AS games, sum(CASE WHEN rn<=2 THEN value END)/count(CASE WHEN rn<=2 THEN 1 END) AS vr, sum(CASE WHEN rn>2 THEN value END)/count(CASE WHEN rn>2 THEN 1 END) AS vb,
  cast(sum(CASE WHEN rn<=2 THEN ret END) AS double)/count(CASE WHEN rn<=2 THEN 1 END) AS rr, cast(sum(CASE WHEN rn>2 THEN ret END) AS double)/count(CASE WHEN rn>2 THEN 1 END) AS rb FROM sn WHERE rn<=6 GROUP BY 1),
h AS (SELECT member, {rnd("0.0+coalesce(vr-vb,0)/400.0+coalesce(rr-rb,0)/1.2", 3)} AS heat FROM a WHERE games>=5)
SELECT member, CASE WHEN heat>=1 THEN 'hot_arm' ELSE 'cold_arm' END AS kind, heat, {rnd("least(1.0,abs(heat)/3.0)", 4)} AS strength FROM h WHERE abs(heat)>=1""")
def skill_heat(spark, sf):
    return S.skill_heat(order_series(spark, sf), {"value": 400.0, "ret": 1.2})


@query("shrunk_streak", "WITH " + DAYS + f""",
s AS (SELECT member, count(*) AS games, sum(num) AS an, sum(den) AS ad, count(CASE WHEN rn<=10 THEN 1 END) AS wg,
  sum(CASE WHEN rn<=10 THEN num END) AS wn, sum(CASE WHEN rn<=10 THEN den END) AS wd FROM un GROUP BY 1),
z AS (SELECT member, cast(an AS double)/cast(ad AS double) AS season, cast(wn AS double)/cast(wd AS double) AS win, cast(wd AS double) AS wd FROM s WHERE games>=15 AND wg=10 AND wd>=10 AND ad>=30),
q AS (SELECT *, {rnd("((wd*win+cast(60.0 AS double)*season)/(wd+cast(60.0 AS double))-season)/sqrt(greatest(season*(1-least(season,cast(0.9 AS double))),cast(0.01 AS double))/wd)", 3)} AS z FROM z)
SELECT member, CASE WHEN z>0 THEN 'hot_bat' ELSE 'cold_bat' END AS kind, z, {rnd("win", 3)} AS window, {rnd("season", 3)} AS season, {rnd("least(1.0,abs(z)/3.0)", 4)} AS strength FROM q WHERE abs(z)>=0.3""")
def shrunk_streak(spark, sf):
    return S.shrunk_streak(day_series(spark, sf), z_flag=0.3, min_games=15, min_window=10, min_season=30)


@query("volume_window_z", "WITH " + DAYS + f""",
r AS (SELECT *, coalesce(sum(den) OVER (PARTITION BY member ORDER BY dt DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS newer FROM ud),
s AS (SELECT member, count(*) AS games, cast(sum(num) AS double) AS sn, cast(sum(den) AS double) AS sd, cast(sum(CASE WHEN newer<25 THEN num END) AS double) AS wn, cast(sum(CASE WHEN newer<25 THEN den END) AS bigint) AS wd FROM r GROUP BY 1),
z AS (SELECT *, {rnd("(wn/wd-sn/sd)/sqrt(greatest(sn/sd*(1-sn/sd),cast(0.05 AS double))/wd)", 3)} AS z FROM s WHERE games>=15 AND wd>=15 AND sd>=40)
SELECT member, CASE WHEN z>0 THEN 'contact_hot' ELSE 'contact_cold' END AS kind, z, wd, {rnd("wn/wd", 3)} AS window, {rnd("sn/sd", 3)} AS season FROM z WHERE abs(z)>=1""")
def volume_window_z(spark, sf):
    series = day_series(spark, sf).withColumn("age", -F.col("seq"))
    return S.volume_window_z(series, "age", F.floor(F.col("age") / 7), z_flag=1.0, min_season=40)


@query("mix_change", "WITH " + DAYS + f""",
us AS (SELECT user_id AS member, cast(ts AS date) AS dt, event_type AS kind, count(*) AS n FROM events GROUP BY 1,2,3),
sh AS (SELECT us.member, us.kind, rn, cast(n AS double)/den AS share FROM us JOIN un ON un.member=us.member AND un.dt=us.dt WHERE rn<=7),
g AS (SELECT member, count(*) AS games FROM un WHERE rn<=7 GROUP BY 1),
k AS (SELECT member, kind, sum(CASE WHEN rn=1 THEN share END) AS use, sum(CASE WHEN rn>1 THEN share ELSE 0 END) AS b FROM sh GROUP BY 1,2),
f AS (SELECT k.member, kind, {rnd("use", 4)} AS use, {rnd("b/(games-1)", 4)} AS base FROM k JOIN g ON g.member=k.member WHERE games>=4),
j AS (SELECT *, {rnd("use-base", 4)} AS jump, row_number() OVER (PARTITION BY member ORDER BY {rnd("use-base", 4)} DESC, kind) AS r FROM f WHERE use-base>=0.10 AND use>=0.08)
SELECT member, kind, use, base, {rnd("least(1.0,abs(jump)/0.25)", 4)} AS strength FROM j WHERE r=1""")
def mix_change(spark, sf):
    day = F.to_date("ts")
    usage = L.table(spark, sf, "events").groupBy(
        F.col("user_id").alias("member"), day.alias("at"), F.datediff(day, F.lit(date(2024, 1, 1))).alias("seq"),
        F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return S.mix_change(usage)


@query("luck_gap", WITH + f""",
a AS (SELECT member, c_nationkey AS entity, cast(sum(dsc) AS double)/cast(sum(rev) AS double) AS actual FROM mp JOIN customer ON c_custkey=member GROUP BY 1,2),
e AS (SELECT entity, cast(sum(dsc) AS double)/cast(sum(rev) AS double) AS expected FROM comp GROUP BY 1),
g AS (SELECT member, {rnd("actual-expected", 4)} AS gap FROM a JOIN e ON e.entity=a.entity)
SELECT member, CASE WHEN gap>0 THEN 'sell_high' ELSE 'buy_low' END AS kind, gap, {rnd("least(1.0,abs(gap)/2.0)", 4)} AS strength FROM g WHERE abs(gap)>=0.5""")
def luck_gap(spark, sf):
    per = L.member_periods(spark, sf).groupBy("member").agg(F.sum("dsc").alias("dsc"), F.sum("rev").alias("rev"))
    who = per.join(L.members(spark, sf).select("member", "entity"), "member")
    actual = who.select("member", ratio(F.col("dsc"), F.col("rev")).alias("actual"))
    base = who.groupBy("entity").agg(ratio(F.sum("dsc"), F.sum("rev")).alias("expected"))
    expected = who.select("member", "entity").join(base, "entity").select("member", "expected")
    return S.luck_gap(actual, expected, 0.5, 2.0)


@query("yearly_decline", WITH + """, y AS (SELECT member, year(date) AS year, cast(sum(qty) AS bigint) AS value FROM dl GROUP BY 1,2)
SELECT a.member, cast(a.year AS integer) AS year, a.value, b.value AS before, a.value-b.value AS change FROM y a JOIN y b ON a.member=b.member AND a.year=b.year+1 WHERE a.value-b.value<=-50""")
def yearly_decline(spark, sf):
    values = L.day_lines(spark, sf).groupBy("member", F.year("date").alias("year")).agg(F.sum("qty").alias("value"))
    return S.yearly_decline(values, -50)


USER_TREND = "WITH " + ACT.SQL_ACTIONS + "," + DAYS + f""",
t AS (SELECT member, count(*) AS games, max(dt) AS newest, cast(sum(CASE WHEN rn<=2 THEN cents END) AS double)/count(CASE WHEN rn<=2 THEN 1 END) AS r,
  cast(sum(CASE WHEN rn>2 THEN cents END) AS double)/count(CASE WHEN rn>2 THEN 1 END) AS p FROM un WHERE rn<=7 GROUP BY 1),
sg AS (SELECT member, newest, CASE WHEN {rnd("r-p", 2)}>0 THEN 'spend_up' ELSE 'spend_down' END AS kind, {rnd("r-p", 2)} AS delta, {rnd(f"least(1.0,abs({rnd('r-p', 2)})/20000.0)", 4)} AS strength FROM t WHERE games>=4 AND abs({rnd("r-p", 2)})>=3000)
"""


def user_signals(spark, sf):
    return step(spark, sf, "user-signals", lambda: S.trend_shift(day_series(spark, sf), "cents", 3000.0, unit=20000.0, name="spend"))


@query("free_agent_stamp", USER_TREND + "SELECT sg.*, NOT EXISTS (SELECT 1 FROM iv WHERE iv.member=sg.member AND to_ts IS NULL AND entity<3) AS free FROM sg")
def free_agent_stamp(spark, sf):
    held = ACT.intervals(spark, sf).where(F.col("entity") < 3)
    return S.free_agent_stamp(user_signals(spark, sf), held)


# --- activity --------------------------------------------------------------


def usage_lines(spark, sf):
    """Orders as day lines on two sides; priority stands for the kind of use."""
    orders = L.table(spark, sf, "orders")
    level = F.substring("o_orderpriority", 1, 1)
    return orders.select(
        F.col("o_custkey").alias("member"), F.when(F.col("o_orderstatus") == "P", "pit").otherwise("bat").alias("side"),
        F.to_date("o_orderdate").alias("date"), (level == "1").cast("long").alias("starts"), (level == "2").cast("long").alias("saves"),
        (level == "3").cast("long").alias("holds"), F.lit(3).cast("long").alias("volume"))


USAGE_AS_OF = date(2000, 6, 30)
ACTIVITY = """
WITH ln AS (SELECT o_custkey AS member, CASE WHEN o_orderstatus='P' THEN 'pit' ELSE 'bat' END AS side, cast(o_orderdate AS date) AS date, substr(o_orderpriority,1,1) AS lv FROM orders),
a AS (SELECT member, side, max(date) AS last_game, count(CASE WHEN date>DATE '2000-06-30'-120 THEN 1 END) AS apps14, count(CASE WHEN date>DATE '2000-06-30'-360 THEN 1 END) AS apps30,
  count(CASE WHEN date>DATE '2000-06-30'-360 AND lv='1' THEN 1 END) AS starts30, count(CASE WHEN date>DATE '2000-06-30'-360 AND lv='2' THEN 1 END) AS saves30,
  count(CASE WHEN date>DATE '2000-06-30'-360 AND lv='3' THEN 1 END) AS holds30, 3*count(CASE WHEN date>DATE '2000-06-30'-120 THEN 1 END) AS volume14 FROM ln WHERE date<=DATE '2000-06-30' GROUP BY 1,2),
ac AS (SELECT *, DATE '2000-06-30'-last_game AS days_since, CASE WHEN apps14=0 THEN 'inactive' WHEN side='pit' THEN CASE WHEN apps30>0 AND starts30/apps30>=0.5 THEN 'starter' WHEN saves30+holds30=0 THEN 'reliever'
  WHEN saves30/(saves30+holds30)>=0.6 THEN 'closer' ELSE 'setup' END WHEN volume14/greatest(apps14,1)>=3.4 THEN 'regular' WHEN volume14/greatest(apps14,1)>=2.5 THEN 'part_time' ELSE 'bench' END AS role FROM a),
gt AS (SELECT c_custkey AS member, s AS side, apps14, days_since, role, CASE WHEN days_since IS NULL THEN 'unverified' WHEN apps14=0 THEN 'blocked' WHEN days_since>30 THEN 'ok_stale' ELSE 'ok' END AS status
  FROM customer CROSS JOIN (VALUES ('bat'),('pit')) t(s) LEFT JOIN ac ON ac.member=c_custkey AND ac.side=s)
"""


def usage(spark, sf):
    return S.activity(usage_lines(spark, sf), USAGE_AS_OF, 120, 360)


@query("activity_table", ACTIVITY + "SELECT * FROM ac")
def activity_table(spark, sf):
    return usage(spark, sf)


def gated(spark, sf):
    who = L.members(spark, sf).select("member", F.explode(F.array(F.lit("bat"), F.lit("pit"))).alias("side"))
    return S.gate(who, usage(spark, sf), 30)


@query("activity_gate", ACTIVITY + "SELECT * FROM gt")
def activity_gate(spark, sf):
    return gated(spark, sf)


@query("gate_report", ACTIVITY + "SELECT status, side, count(*) AS n FROM gt GROUP BY 1,2")
def gate_report(spark, sf):
    return gated(spark, sf).groupBy("status", "side").agg(F.count(F.lit(1)).alias("n"))


@query("roster_best_side", ACTIVITY + """, b AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY apps14 DESC, last_game DESC, side DESC) AS r FROM ac)
SELECT c_custkey AS member, c_nationkey AS entity, side, coalesce(apps14,0) AS apps14, days_since, coalesce(role,'no day lines') AS usage_role FROM customer LEFT JOIN b ON b.member=c_custkey AND r=1""")
def roster_best_side(spark, sf):
    return S.best_side(L.members(spark, sf).select("member", "entity"), usage(spark, sf))


@query("coming_twice", """
SELECT o_custkey AS member, count(*) AS starts FROM orders WHERE o_orderdate>=DATE '1998-03-01' AND o_orderdate<DATE '1998-03-01'+90 GROUP BY 1 HAVING count(*)>=2""")
def coming_twice(spark, sf):
    return S.coming_twice(usage_lines(spark, sf), date(1998, 3, 1), 90)


@query("eligibility_windows", """
WITH g AS (SELECT l_suppkey AS member, p_brand AS position, count(*) AS games FROM lineitem JOIN part ON p_partkey=l_partkey GROUP BY 1,2)
SELECT member, position, games FROM g WHERE games BETWEEN 15 AND 19""")
def eligibility_windows(spark, sf):
    sold = L.table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    games = sold.join(L.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("position")), "l_partkey").groupBy(
        F.col("l_suppkey").alias("member"), "position").agg(F.sum("n").alias("games"))
    held = games.where(F.col("games") >= 20).groupBy("member").agg(F.collect_set("position").alias("positions"))
    return S.eligibility_windows(games, held)


@query("park_factor", f"""
WITH m AS (SELECT l_suppkey AS venue, count(*) AS n, cast(sum(cast(l_quantity AS bigint)) AS double)/count(*) AS mean FROM lineitem GROUP BY 1 HAVING count(*)>=20)
SELECT venue, n, {rnd("mean", 4)} AS mean, {rnd("mean/(SELECT avg(mean) FROM m)", 4)} AS factor FROM m""")
def park_factor(spark, sf):
    lines = L.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("venue"), F.col("l_quantity").alias("runs"))
    return A.ratio_to_mean(lines, "venue", "runs", 20)


@query("schedule_factor", WITH + f""", g AS (SELECT c_nationkey AS club, cast(count(*) AS bigint) AS games FROM orders JOIN customer ON c_custkey=o_custkey WHERE o_orderdate>=DATE '2000-01-01' GROUP BY 1)
SELECT club, games, {rnd("cast(games AS double)/(SELECT avg(games) FROM g)", 4)} AS factor FROM g""")
def schedule_factor(spark, sf):
    return factors(spark, sf)


def factors(spark, sf):
    late = L.table(spark, sf, "orders").where(F.col("o_orderdate") >= F.lit(datetime(2000, 1, 1)).cast("timestamp_ntz"))
    per = late.groupBy(F.col("o_custkey").alias("member")).agg(F.count(F.lit(1)).alias("n"))
    games = per.join(L.members(spark, sf), "member").groupBy(F.col("entity").alias("club")).agg(F.sum("n").alias("games"))
    mean = games.agg(F.avg("games")).scalar()
    return games.select("club", "games", fixed(ratio(F.col("games"), mean), 4).alias("factor"))


SHRINK = WITH + f""",
tt AS (SELECT member, CASE WHEN member%2=0 THEN 'bat' ELSE 'pit' END AS side, c_nationkey AS entity, CASE member%4 WHEN 0 THEN 'C' WHEN 2 THEN '1B' END AS position,
  cast(sum(qty) AS bigint) AS volume, cast(sum(ord) AS bigint) AS starts_wins, cast(sum(ret) AS bigint) AS saves, cast(sum(qty) AS bigint) AS outs, cast(sum(rev) AS bigint) AS rev, cast(sum(ret) AS bigint) AS ret
  FROM mp JOIN customer ON c_custkey=member WHERE period<=60 GROUP BY 1,2,3,4),
gr AS (SELECT *, CASE WHEN side='pit' THEN CASE WHEN outs>=90 AND starts_wins/greatest(outs/18,1.0)>0.15 THEN 'SP' WHEN saves+outs<200 THEN 'RP' ELSE 'SP' END WHEN position='C' THEN 'C' WHEN position IN ('1B','2B','3B','SS') THEN 'IF' ELSE 'OF' END AS grp FROM tt),
gm AS (SELECT side, grp, count(*) AS n, cast(sum(rev) AS double) AS rev, cast(sum(ret) AS double) AS ret FROM gr GROUP BY 1,2),
sm AS (SELECT side, sum(n) AS n, sum(rev) AS rev, sum(ret) AS ret FROM gm GROUP BY 1),
mu AS (SELECT gm.side, grp, CASE WHEN gm.n>=15 THEN gm.rev/gm.n ELSE sm.rev/sm.n END AS mrev, CASE WHEN gm.n>=15 THEN gm.ret/gm.n ELSE sm.ret/sm.n END AS mret FROM gm JOIN sm ON sm.side=gm.side),
g AS (SELECT c_nationkey AS club, cast(count(*) AS bigint) AS games FROM orders JOIN customer ON c_custkey=o_custkey WHERE o_orderdate>=DATE '2000-01-01' GROUP BY 1),
fc AS (SELECT club, {rnd("cast(games AS double)/(SELECT avg(games) FROM g)", 4)} AS factor FROM g),
al AS (SELECT gr.*, mrev, mret, cast(volume AS double)/(volume+CASE gr.side WHEN 'bat' THEN 150.0 ELSE 120.0 END) AS alpha FROM gr JOIN mu ON mu.side=gr.side AND mu.grp=gr.grp)
"""


def side_totals(spark, sf):
    mp = L.member_periods(spark, sf).where(F.col("period") <= L.AS_OF).groupBy("member").agg(
        *[F.sum(c).alias(c) for c in L.COMPONENTS])
    m = F.col("member")
    return mp.select(
        "member", F.when(m % 2 == 0, "bat").otherwise("pit").alias("side"), F.when(m % 4 == 0, "C").when(m % 4 == 2, "1B").alias("position"),
        F.col("qty").alias("volume"), F.col("ord").alias("starts_wins"), F.col("ret").alias("saves"), F.col("qty").alias("outs"), "rev", "ret")


@query("shrunken_projection", SHRINK + f"""
SELECT entity, {rnd("sum(CASE WHEN member%3=0 THEN 1.0 ELSE cast(0.35 AS double) END*coalesce(factor,1.0)*(alpha*rev/60+(1-alpha)*mrev/60*0.5))", 3)} AS rev,
 {rnd("sum(CASE WHEN member%3=0 THEN 1.0 ELSE cast(0.35 AS double) END*coalesce(factor,1.0)*(alpha*ret/60+(1-alpha)*mret/60*0.5))", 3)} AS ret
FROM al LEFT JOIN fc ON club=entity GROUP BY 1""")
def shrunken_projection(spark, sf):
    roster = L.members(spark, sf).select("entity", "member", (F.col("member") % 3 == 0).alias("in_lineup"), F.col("entity").alias("club"))
    return S.shrunken_projection(side_totals(spark, sf), roster, ["rev", "ret"], L.AS_OF, {"bat": 150.0, "pit": 120.0},
                                 factors(spark, sf).select("club", "factor"))


@query("signal_backtest", SER + f""",
st AS (SELECT unnest([30,40,50,60,70]) AS stand),
h AS (SELECT member, stand, value, row_number() OVER (PARTITION BY member, stand ORDER BY dt DESC, seq DESC) AS rn, count(*) OVER (PARTITION BY member, stand) AS n FROM se JOIN st ON period<=stand),
d AS (SELECT member, stand, {rnd("avg(CASE WHEN rn<=2 THEN value END)-avg(CASE WHEN rn BETWEEN 3 AND 7 THEN value END)", 6)} AS delta FROM h WHERE n>=4 GROUP BY 1,2),
p AS (SELECT member, stand, cast(sum(ret) AS double) AS pn, cast(sum(qty) AS double) AS pv FROM mp JOIN st ON period<=stand GROUP BY 1,2),
nx AS (SELECT member, stand, cast(ret AS double) AS nn, cast(qty AS double) AS nv FROM mp JOIN st ON period=stand+1),
r AS (SELECT delta, nn/nv-pn/pv AS move FROM d JOIN p ON p.member=d.member AND p.stand=d.stand JOIN nx ON nx.member=d.member AND nx.stand=d.stand WHERE delta IS NOT NULL AND nv>=9 AND pv>=90),
l AS (SELECT r.*, t AS threshold FROM r, (VALUES (cast(100.0 AS double)),(cast(200.0 AS double)),(cast(400.0 AS double))) v(t)),
o AS (SELECT threshold, count(CASE WHEN delta<=-threshold THEN 1 END) AS n_flagged, {rnd("avg(CASE WHEN delta<=-threshold THEN move END)", 6)} AS flagged_move,
 {rnd("coalesce(avg(CASE WHEN NOT delta<=-threshold AND abs(delta)<50 THEN move END),0)", 6)} AS baseline_move FROM l GROUP BY 1)
SELECT *, {rnd("flagged_move-baseline_move", 6)} AS edge FROM o WHERE n_flagged>=8""")
def signal_backtest(spark, sf):
    outcomes = L.member_periods(spark, sf).select("member", "period", F.col("ret").alias("num"), F.col("qty").alias("vol"))
    return S.signal_backtest(order_series(spark, sf), "value", outcomes, [100.0, 200.0, 400.0], [30, 40, 50, 60, 70], calm=50.0)


@query("best_for_metric", WITH + f""",
t AS (SELECT c_nationkey AS entity, member, cast(sum(qty) AS bigint) AS qty, cast(sum(rev) AS bigint) AS rev, cast(sum(dsc) AS bigint) AS dsc FROM mp JOIN customer ON c_custkey=member GROUP BY 1,2),
v AS (SELECT entity, member, 'QTY' AS metric, cast(qty AS double) AS value FROM t WHERE qty>=0 UNION ALL SELECT entity, member, 'PPU', {rnd("cast(rev AS double)*cast(0.01 AS double)/cast(qty AS double)", 4)} FROM t WHERE qty>=150),
r AS (SELECT *, row_number() OVER (PARTITION BY entity, metric ORDER BY value DESC, member) AS rank FROM v) SELECT * FROM r WHERE rank<=3""")
def best_for_metric(spark, sf):
    totals = L.member_periods(spark, sf).groupBy("member").agg(F.sum("qty").alias("qty"), F.sum("rev").alias("rev")).join(
        L.members(spark, sf).select("member", "entity"), "member")
    return S.best_for_metric(totals, {"QTY": ("qty", 0), "PPU": ("qty", 150)}, {
        "QTY": F.col("qty").cast("double"), "PPU": fixed(ratio(F.col("rev"), F.col("qty"), 0.01), 4)})


@query("member_season", WITH + f"""
SELECT member, cast(sum(qty) AS bigint) AS qty, cast(sum(rev) AS bigint) AS rev, {rnd("cast(sum(qty) AS double)/60.0", 4)} AS qty_weekly FROM mp WHERE period<=60 GROUP BY 1""")
def member_season(spark, sf):
    return L.member_periods(spark, sf).where(F.col("period") <= 60).groupBy("member").agg(
        F.sum("qty").alias("qty"), F.sum("rev").alias("rev"), fixed(F.sum("qty") / 60.0, 4).alias("qty_weekly"))

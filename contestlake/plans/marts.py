"""Brief, manager, ops and schema acceptance queries."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from contestlake.functions.rates import fixed, ratio, whole_units
from contestlake.operators import joins as J
from contestlake.operators import marts as M
from contestlake.operators import ranking
from contestlake.operators import signals as SG
from contestlake.operators import standings as S
from contestlake.plans import actions as ACT
from contestlake.plans import graphs as G
from contestlake.plans import league as L
from contestlake.plans import relational as R
from contestlake.plans import scenarios as SC
from contestlake.plans import signals as SIG
from contestlake.plans import standings as P
from contestlake.plans.registry import query, rnd


# --- brief -----------------------------------------------------------------


@query("brief_battle_plan", P.RACE + f"""
, us AS (SELECT metric, proj_value AS ov, proj_points AS op, impact AS oi FROM imp WHERE entity=7),
c AS (SELECT p.metric, p.entity AS passes, {rnd("abs(p.proj_value-ov)", 4)} AS units_needed, {rnd("abs(p.proj_value-ov)/nullif(oi,0)", 1)} AS swaps, p.proj_points-op AS points_gain FROM proj p JOIN us ON p.metric=us.metric WHERE p.proj_points>op),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY units_needed, passes) AS step FROM c)
SELECT metric, passes, units_needed, points_gain, 'pass '||passes||' in '||metric||' for '||printf('%.1f', points_gain) AS line FROM r WHERE step<=4 ORDER BY points_gain/(1+step) DESC, metric, passes LIMIT 6""")
def brief_battle_plan(spark, sf):
    """The six best steps of the marginal curve."""
    curve = P.marginal_curve(spark, sf)
    line = F.concat(F.lit("pass "), F.col("passes").cast("string"), F.lit(" in "), F.col("metric"), F.lit(" for "), F.format_string("%.1f", "points_gain"))
    best = curve.orderBy((F.col("points_gain") / (1 + F.col("step"))).desc(), "metric", "passes").limit(6)
    return best.select("metric", "passes", "units_needed", "points_gain", line.alias("line"))


@query("brief_streams", SIG.ACTIVITY + """, nx AS (SELECT o_custkey AS member, count(*) AS starts FROM orders WHERE o_orderdate>=DATE '2000-06-30' AND o_orderdate<DATE '2000-06-30'+90 GROUP BY 1 HAVING count(*)>=2)
SELECT gt.member, gt.status, nx.starts, apps30 FROM gt JOIN nx ON nx.member=gt.member JOIN ac ON ac.member=gt.member AND ac.side=gt.side WHERE gt.side='pit' AND gt.status LIKE 'ok%' ORDER BY nx.starts DESC, apps30 DESC, gt.member LIMIT 6""")
def brief_streams(spark, sf):
    """Active arms with two coming starts."""
    usage = SIG.usage(spark, sf)
    soon = SG.coming_twice(SIG.usage_lines(spark, sf), SIG.USAGE_AS_OF, 90)
    arms = SIG.gated(spark, sf).where((F.col("side") == "pit") & F.col("status").startswith("ok"))
    rows = arms.select("member", "side", "status").join(soon, "member").join(usage.select("member", "side", "apps30"), ["member", "side"])
    return rows.select("member", "status", "starts", "apps30").orderBy(F.desc("starts"), F.desc("apps30"), "member").limit(6)


@query("brief_saves", SIG.ACTIVITY + """
SELECT member, saves30, holds30, role FROM ac WHERE side='pit' AND role IN ('closer','setup') ORDER BY CASE role WHEN 'closer' THEN 0 ELSE 1 END, saves30 DESC, member LIMIT 4""")
def brief_saves(spark, sf):
    rows = SIG.usage(spark, sf).where((F.col("side") == "pit") & F.col("role").isin("closer", "setup"))
    return rows.orderBy(F.when(F.col("role") == "closer", 0).otherwise(1), F.desc("saves30"), "member").limit(4).select(
        "member", "saves30", "holds30", "role")


@query("brief_wire_heat", SIG.USER_TREND + """, f AS (SELECT sg.*, NOT EXISTS (SELECT 1 FROM iv WHERE iv.member=sg.member AND to_ts IS NULL AND entity<3) AS free FROM sg)
SELECT member, kind, delta, strength FROM f WHERE free ORDER BY strength DESC, member LIMIT 8""")
def brief_wire_heat(spark, sf):
    return SIG.free_agent_stamp(spark, sf).where("free").orderBy(F.desc("strength"), "member").limit(8).select(
        "member", "kind", "delta", "strength")


@query("brief_own_signals", SIG.USER_TREND + """, f AS (SELECT sg.*, EXISTS (SELECT 1 FROM iv WHERE iv.member=sg.member AND to_ts IS NULL AND entity<3) AS held FROM sg),
r AS (SELECT member, kind, delta, row_number() OVER (PARTITION BY kind ORDER BY strength DESC, member) AS line_no FROM f WHERE held)
SELECT kind, line_no, 'member '||member||': '||printf('%+.2f', delta) AS line FROM r WHERE line_no<=6""")
def brief_own_signals(spark, sf):
    own = SIG.free_agent_stamp(spark, sf).where(~F.col("free"))
    line = F.concat(F.lit("member "), F.col("member").cast("string"), F.lit(": "), F.format_string("%+.2f", "delta"))
    return M.report_lines(own, ["kind"], [F.desc("strength"), F.asc("member")], line, 6)


# --- manager and ops -------------------------------------------------------


@query("manager_mart", ACT.WITH + """
, d AS (SELECT max(ts) AS m FROM act)
SELECT 'open_stints' AS section, cast(entity AS varchar) AS key, cast(count(*) AS double) AS value FROM iv WHERE to_ts IS NULL GROUP BY entity
UNION ALL SELECT 'actions_24h', action, cast(count(*) AS double) FROM act, d WHERE ts>m-INTERVAL 1 DAY GROUP BY action
UNION ALL SELECT 'actions_48h', action, cast(count(*) AS double) FROM act, d WHERE ts>m-INTERVAL 2 DAY GROUP BY action
UNION ALL SELECT 'fees', cast(entity AS varchar), cast(sum(fee) AS double)/100.0 FROM act GROUP BY entity
UNION ALL SELECT 'injured', cast(entity AS varchar), cast(count(*) AS double) FROM iv WHERE to_ts IS NULL AND status='il' GROUP BY entity""")
def manager_mart(spark, sf):
    log, iv = ACT.actions(spark, sf), ACT.intervals(spark, sf)
    newest = log.agg(F.max("ts")).scalar()
    count = F.count(F.lit(1)).alias("value")
    key = F.col("entity").alias("key")
    now = iv.where(F.col("to_ts").isNull())
    recent = lambda d: log.where(F.col("ts") > newest - F.expr(f"INTERVAL {d} DAYS")).groupBy(F.col("action").alias("key")).agg(count)
    return M.labelled({
        "open_stints": now.groupBy(key).agg(count), "actions_24h": recent(1), "actions_48h": recent(2),
        "fees": log.groupBy(key).agg((F.sum("fee") / 100.0).alias("value")),
        "injured": now.where(F.col("status") == "il").groupBy(key).agg(count)})


# Relation: child table and key, parent table and key; children without a parent are counted.
ORPHANS = {
    "orders_without_lines": ("orders", "o_orderkey", "lineitem", "l_orderkey"),
    "lines_without_order": ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    "orders_without_customer": ("orders", "o_custkey", "customer", "c_custkey"),
    "lines_without_part": ("lineitem", "l_partkey", "part", "p_partkey"),
    "labels_without_document": ("labels", "doc_id", "documents", "doc_id"),
}

_OPS = [f"SELECT 'rows' AS section, '{t}' AS key, cast(count(*) AS double) AS value FROM {t}" for t in R.TABLES]
_OPS += [f"SELECT 'orphans','{name}',cast(count(*) AS double) FROM {a} x WHERE NOT EXISTS (SELECT 1 FROM {b} y WHERE y.{kb}=x.{ka})"
         for name, (a, ka, b, kb) in ORPHANS.items()]


@query("ops_mart", "\nUNION ALL ".join(_OPS) + """
UNION ALL SELECT 'age_minutes', event_type, cast(date_sub('second', max(ts), TIMESTAMP '2024-01-31 00:10:00') AS double)/60.0 FROM events GROUP BY event_type
UNION ALL SELECT 'labels', 'toxic', cast(sum(toxic) AS double) FROM labels""")
def ops_mart(spark, sf):
    t = lambda n: L.table(spark, sf, n)
    rows = None
    for name in R.TABLES:
        one = t(name).agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("key"), "value")
        rows = one if rows is None else rows.unionByName(one)
    now = F.lit(datetime(2024, 1, 31, 0, 10)).cast("timestamp_ntz")
    age = t("events").groupBy(F.col("event_type").alias("key")).agg(F.max("ts").alias("seen")).select(
        "key", (F.timestamp_diff("SECOND", "seen", now) / 60.0).alias("value"))
    lost = J.orphan_counts({name: (t(a).select(F.col(ka).alias("k")), t(b).select(F.col(kb).alias("k")), ["k"])
                            for name, (a, ka, b, kb) in ORPHANS.items()})
    toxic = t("labels").agg(F.sum("toxic").alias("value")).select(F.lit("toxic").alias("key"), "value")
    return M.labelled({"rows": rows, "age_minutes": age, "orphans": lost.select(F.col("relation").alias("key"), F.col("orphans").alias("value")), "labels": toxic})


@query("roster_graph_extract", SIG.TREND + """, sg AS (SELECT member, count(DISTINCT kind) AS signals FROM tr GROUP BY 1), st AS (SELECT o_custkey AS member, count(*) AS starts FROM orders WHERE substr(o_orderpriority,1,1)='1' GROUP BY 1)
SELECT c_custkey AS member, c_nationkey AS entity, coalesce(signals,0) AS signals, coalesce(starts,0) AS starts FROM customer LEFT JOIN sg ON sg.member=c_custkey LEFT JOIN st ON st.member=c_custkey""")
def roster_graph_extract(spark, sf):
    starts = SIG.usage_lines(spark, sf).where(F.col("starts") == 1)
    return M.roster_extract(L.members(spark, sf).select("member", "entity"), SIG.trend_shift(spark, sf), starts)


# --- acceptance queries ----------------------------------------------------


@query("streaming_finder", SC.MARG + SIG.ACTIVITY.replace("WITH ln", ", ln", 1) + f"""
, nx AS (SELECT o_custkey AS member, count(*) AS starts FROM orders WHERE o_orderdate>=DATE '2000-06-30' AND o_orderdate<DATE '2000-06-30'+90 GROUP BY 1 HAVING count(*)>=2),
cd AS (SELECT DISTINCT member FROM gt WHERE status LIKE 'ok%' OR status='unverified')
SELECT mg.entity, mg.member, mg.marginal, coalesce(starts,0)>=2 AS two_start FROM mg JOIN cd ON cd.member=mg.member LEFT JOIN nx ON nx.member=mg.member""")
def streaming_finder(spark, sf):
    """Usable members by marginal points with a two-start flag."""
    usable = SIG.gated(spark, sf).where(F.col("status").startswith("ok") | (F.col("status") == "unverified")).select("member").distinct()
    soon = SG.coming_twice(SIG.usage_lines(spark, sf), SIG.USAGE_AS_OF, 90)
    value = SC.member_marginal(spark, sf).join(usable, "member", "left_semi").join(soon, "member", "left")
    return value.select("entity", "member", "marginal", F.coalesce(F.col("starts") >= 2, F.lit(False)).alias("two_start"))


@query("blocking_claims", P.NEEDS + f"""
, nd AS (SELECT entity, metric, cast(1.0 AS double)/(1+effort) AS weight FROM needs WHERE chasing),
pu AS (SELECT c_nationkey AS entity, count(*) AS claims FROM orders JOIN customer ON c_custkey=o_custkey WHERE o_orderstatus='P' GROUP BY 1),
od AS (SELECT entity, row_number() OVER (ORDER BY total, entity) AS place FROM (SELECT entity, sum(proj_points) AS total FROM proj GROUP BY 1)),
of AS (SELECT p_partkey AS member, unnest(CASE p_size%3 WHEN 0 THEN ['QTY','REV'] WHEN 1 THEN ['ORD','PPU'] ELSE ['DISC','REV'] END) AS metric FROM part),
wn AS (SELECT member, nd.entity, sum(weight) AS need FROM of JOIN nd ON nd.metric=of.metric GROUP BY 1,2),
sc AS (SELECT wn.member, wn.entity, need*claims/place AS score FROM wn JOIN pu ON pu.entity=wn.entity JOIN od ON od.entity=wn.entity)
SELECT member, entity, {rnd("score/sum(score) OVER (PARTITION BY member)", 6)} AS chance FROM sc""")
def blocking_claims(spark, sf):
    """Chance that each rival takes an offered part first."""
    needs = P.profiles(spark, sf).where("chasing").select("entity", "metric", (1.0 / (1 + F.col("effort"))).alias("weight"))
    asked = L.table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").groupBy(F.col("o_custkey").alias("member")).agg(F.count(F.lit(1)).alias("n"))
    pushy = asked.join(L.members(spark, sf), "member").groupBy("entity").agg(F.sum("n").alias("claims"))
    totals = P.race(spark, sf).groupBy("entity").agg(F.sum("proj_points").alias("total"))
    order = ranking.row_rank(totals, [], [F.asc("total"), F.asc("entity")], "place").select("entity", "place")
    sets = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("QTY"), F.lit("REV"))).when(
        F.col("p_size") % 3 == 1, F.array(F.lit("ORD"), F.lit("PPU"))).otherwise(F.array(F.lit("DISC"), F.lit("REV")))
    offers = L.table(spark, sf, "part").select(F.col("p_partkey").alias("member"), F.explode(sets).alias("metric"))
    return M.claim_chance(needs, pushy, order, offers)


@query("recommendation_audit", G.ADVICE + f"""
, hz AS (SELECT ms.*, h FROM ms, (VALUES (1),(4)) v(h)),
mm AS (SELECT rec, h, coalesce(sum(made),0.0) AS made FROM hz LEFT JOIN pd ON pd.member=hz.member AND pd.period BETWEEN hz.period AND hz.period+h-1 GROUP BY 1,2)
SELECT hz.rec, cast(hz.h AS integer) AS horizon, status, made, {rnd("least(1.0,made/12.0)*CASE WHEN status='adopted' THEN 1 ELSE 0 END-CASE WHEN status='adopted' AND made<3 THEN cast(0.3 AS double) ELSE 0 END", 2)} AS score
FROM hz JOIN mm ON mm.rec=hz.rec AND mm.h=hz.h WHERE status<>'open' AND DATE '2024-01-01'+cast(7*(period+hz.h-1)-1 AS integer)<DATE '2024-01-31'""")
def recommendation_audit(spark, sf):
    """Advice with its decision and its outcome after one and four periods."""
    from contestlake.operators import advice as AD

    advice, made = G.decisions(spark, sf), G.production(spark, sf).select("member", "period", "made")
    out = None
    for horizon in (1, 4):
        one = AD.score_outcomes(advice, made, G.CALENDAR, date(2024, 1, 31), horizon).select(
            "rec", F.lit(horizon).alias("horizon"), "status", "made", "score")
        out = one if out is None else out.unionByName(one)
    return out


@query("rolling_scoreboard", f"""
WITH x AS (SELECT user_id AS member, cast((cast(ts AS date)-DATE '2024-01-01')//7+1 AS integer) AS period, event_type, cast(json_extract_string(props,'$.k') AS bigint) AS k FROM events),
p AS (SELECT member, period, cast(sum(k) AS double)/count(*) AS v FROM x WHERE event_type='view' GROUP BY 1,2), r AS (SELECT member, period, cast(sum(k) AS double)/count(*) AS v FROM x WHERE event_type='purchase' GROUP BY 1,2),
e AS (SELECT 'K'||(p.member%3) AS stat, p.period, count(*) AS n, cast(sum(cast(floor(abs(p.v-coalesce(r.v,0))*cast(10000 AS double)+cast(0.5 AS double)) AS bigint)) AS double) AS total FROM p LEFT JOIN r ON r.member=p.member AND r.period=p.period GROUP BY 1,2)
SELECT stat, period, n, {rnd("total*cast(0.0001 AS double)/n", 4)} AS mae, {rnd("sum(total) OVER w*cast(0.0001 AS double)/sum(n) OVER w", 4)} AS rolling_mae FROM e WINDOW w AS (PARTITION BY stat ORDER BY period RANGE BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def rolling_scoreboard(spark, sf):
    rows = R.events(spark, sf).select(F.col("user_id").alias("member"), R.WEEKS.number(F.to_date("ts")).alias("period"), "event_type",
                                      F.get_json_object("props", "$.k").cast("long").alias("k"))
    mean = ratio(F.sum("k"), F.count("k"))
    p = rows.where(F.col("event_type") == "view").groupBy("member", "period").agg(mean.alias("p"))
    r = rows.where(F.col("event_type") == "purchase").groupBy("member", "period").agg(mean.alias("r"))
    err = whole_units(F.abs(F.col("p") - F.coalesce("r", F.lit(0.0))), 4)
    errors = p.join(r, ["member", "period"], "left").groupBy(
        F.concat(F.lit("K"), (F.col("member") % 3).cast("string")).alias("stat"), "period").agg(F.count(F.lit(1)).alias("n"), F.sum(err).alias("total"))
    return M.rolling_error(errors)


@query("counterparty_scan", P.NEEDS + """
, us AS (SELECT metric, chasing AS wc, surplus AS ws, points_up AS og FROM needs WHERE entity=7),
s AS (SELECT n.entity, sum(CASE WHEN surplus AND wc THEN og ELSE 0 END + CASE WHEN chasing AND ws THEN points_up ELSE 0 END) AS score, cast(sum(CASE WHEN surplus AND wc THEN 1 ELSE 0 END) AS bigint) AS can_give,
  cast(sum(CASE WHEN chasing AND ws THEN 1 ELSE 0 END) AS bigint) AS wants FROM needs n JOIN us ON n.metric=us.metric WHERE n.entity<>7 GROUP BY 1),
t AS (SELECT c_nationkey AS entity, count(*) AS trades FROM orders JOIN customer ON c_custkey=o_custkey WHERE o_orderstatus='P' GROUP BY 1)
SELECT s.entity, score, can_give, wants, coalesce(trades,0) AS trades FROM s LEFT JOIN t ON t.entity=s.entity WHERE can_give>0 OR wants>0""")
def counterparty_scan(spark, sf):
    """Complementary rivals with how often they trade."""
    asked = L.table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").groupBy(F.col("o_custkey").alias("member")).agg(F.count(F.lit(1)).alias("n"))
    trades = asked.join(L.members(spark, sf), "member").groupBy("entity").agg(F.sum("n").alias("trades"))
    found = S.complementarity(P.profiles(spark, sf), L.US)
    return found.join(trades, "entity", "left").withColumn("trades", F.coalesce("trades", F.lit(0)))


@query("rival_acted_first", """
WITH e AS (SELECT event_id AS uid, user_id AS member, ts FROM events WHERE event_type='error'), a AS (SELECT user_id AS member, ts FROM events WHERE event_type='signup'),
n AS (SELECT e.uid, e.member, e.ts, (SELECT min(a.ts) FROM a WHERE a.member=e.member AND a.ts>=e.ts) AS nx FROM e),
w AS (SELECT uid, member, CASE WHEN date_sub('minute', ts, nx)<=4320 THEN date_sub('minute', ts, nx) END AS minutes FROM n)
SELECT uid, member, minutes, coalesce(minutes<180,false) AS beaten FROM w""")
def rival_acted_first(spark, sf):
    e = R.events(spark, sf).select(F.col("event_id").alias("uid"), F.col("user_id").alias("member"), "ts", "event_type")
    return M.acted_first(e.where(F.col("event_type") == "error"), e.where(F.col("event_type") == "signup"), 180, 3)

"""Standings, race, backtest and rival queries over the driver league."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestlake.functions.rates import fixed, ratio
from contestlake.operators import metrics as M
from contestlake.operators import ranking
from contestlake.operators import standings as S
from contestlake.plans import league as L
from contestlake.plans.registry import query, rnd

WITH = "WITH " + L.SQL_COMPONENTS
CUM = WITH + """,
cum AS (
  SELECT entity, period,
    cast(sum(qty) OVER w AS bigint) AS qty, cast(sum(rev) OVER w AS bigint) AS rev,
    cast(sum(ord) OVER w AS bigint) AS ord, cast(sum(ret) OVER w AS bigint) AS ret,
    cast(sum(dsc) OVER w AS bigint) AS dsc
  FROM dense WINDOW w AS (PARTITION BY entity ORDER BY period ROWS UNBOUNDED PRECEDING)),
cumv AS (""" + L.sql_metrics("cum", "entity, period") + """),
cumb AS (SELECT *, """ + L.sql_points("period, metric") + """ AS points FROM cumv),
cums AS (SELECT period, entity, sum(points) AS total FROM cumb GROUP BY 1,2)
"""


@query("period_values", WITH + """
, v AS (""" + L.sql_metrics("comp", "entity, period") + """)
SELECT entity, period, metric, value FROM v""")
def period_values(spark, sf):
    return S.period_values(L.components(spark, sf), L.METRICS).select("entity", "period", "metric", "value")


@query("rank_points_by_metric", WITH + """
, v AS (""" + L.sql_metrics("comp", "entity, period") + """)
SELECT entity, period, metric, """ + L.sql_points("period, metric") + """ AS points FROM v""")
def rank_points_by_metric(spark, sf):
    values = S.period_values(L.components(spark, sf), L.METRICS)
    return S.board(values, ["period"]).select("entity", "period", "metric", "points")


@query("recent_form", WITH + """
SELECT entity, cast(sum(qty) AS bigint) AS qty_ytd, cast(sum(rev) AS bigint) AS rev_ytd,
  cast(sum(ord) AS bigint) AS ord_ytd, cast(sum(ret) AS bigint) AS ret_ytd, cast(sum(dsc) AS bigint) AS dsc_ytd,
  cast(sum(CASE WHEN period>56 THEN qty ELSE 0 END) AS double)/4 AS qty_recent,
  cast(sum(CASE WHEN period>56 THEN rev ELSE 0 END) AS double)/4 AS rev_recent,
  cast(sum(CASE WHEN period>56 THEN ord ELSE 0 END) AS double)/4 AS ord_recent,
  cast(sum(CASE WHEN period>56 THEN ret ELSE 0 END) AS double)/4 AS ret_recent,
  cast(sum(CASE WHEN period>56 THEN dsc ELSE 0 END) AS double)/4 AS dsc_recent
FROM dense WHERE period<=60 GROUP BY entity""")
def recent_form(spark, sf):
    return S.rate_inputs(L.dense_components(spark, sf), L.COMPONENTS, L.AS_OF)


@query("cumulative_standings", CUM + """
SELECT period, entity, total, row_number() OVER (PARTITION BY period ORDER BY total DESC, entity) AS rank
FROM cums""")
def cumulative_standings(spark, sf):
    return S.cumulative_standings(L.dense_components(spark, sf), L.METRICS)


@query("cumulative_board", CUM + "SELECT entity, period, metric, value, points FROM cumb")
def cumulative_board(spark, sf):
    out = S.cumulative_board(L.dense_components(spark, sf), L.METRICS)
    return out.select("entity", "period", "metric", "value", "points")


@query("ratio_of_sums", WITH + f"""
SELECT c_mktsegment AS role,
  {rnd("cast(sum(dsc) AS double)/cast(sum(rev) AS double)", 4)} AS disc,
  {rnd("cast(sum(rev) AS double)*cast(0.01 AS double)/cast(sum(qty) AS double)", 4)} AS ppu
FROM mp JOIN customer ON c_custkey=member GROUP BY 1""")
def ratio_of_sums(spark, sf):
    by_role = L.member_periods(spark, sf).groupBy("member").agg(*[F.sum(c).alias(c) for c in L.COMPONENTS])
    return by_role.join(L.members(spark, sf), "member").groupBy("role").agg(
        fixed(ratio(F.sum("dsc"), F.sum("rev")), 4).alias("disc"),
        fixed(ratio(F.sum("rev"), F.sum("qty"), 0.01), 4).alias("ppu"))


def _sql_project(played: str, left: str, weight: str, source: str, keep: str) -> str:
    def week(c):
        return f"({weight}*{c}_recent+(1-{weight})*{c}_ytd/{played})"

    parts = []
    for m in L.METRICS:
        if m.is_rate:
            now = rnd(f"cast({m.num}_ytd AS double)*cast({m.scale} AS double)/nullif(cast({m.den}_ytd AS double),0)", 4)
            den = f"({m.den}_ytd+{week(m.den)}*{left})"
            val = rnd(f"({m.num}_ytd+{week(m.num)}*{left})*cast({m.scale} AS double)/nullif({den},0)", 4)
        else:
            now, den = f"cast({m.num}_ytd AS double)", "cast(NULL AS double)"
            val = rnd(f"{m.num}_ytd+{week(m.num)}*{left}", 4)
        parts.append(f"SELECT {keep}, '{m.code}' AS metric, '{m.kind}' AS kind, '{m.direction}' AS direction, "
                     f"{now} AS ytd_value, {val} AS proj_value, {den} AS den_final FROM {source}")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE proj_value IS NOT NULL"


def _sql_inputs() -> str:
    cols = []
    for c in L.COMPONENTS:
        cols.append(f"cast(sum({c}) AS double) AS {c}_ytd")
        cols.append(f"cast(sum(CASE WHEN period>56 THEN {c} ELSE 0 END) AS double)/4 AS {c}_recent")
    return "SELECT entity, " + ", ".join(cols) + " FROM dense WHERE period<=60 GROUP BY entity"


W35 = "cast(0.35 AS double)"
RACE = WITH + ",\ninp AS (" + _sql_inputs() + "),\nproj0 AS (" + _sql_project(
    "60", "20", W35, "inp", "entity") + """),
proj AS (SELECT *, """ + L.sql_points("metric", "ytd_value") + """ AS ytd_points,
  """ + L.sql_points("metric", "proj_value") + """ AS proj_points FROM proj0),
imp AS (SELECT *, CASE metric WHEN 'DISC' THEN cast(2000000 AS double)/den_final WHEN 'PPU' THEN cast(2160 AS double)/den_final END AS impact FROM proj)
"""


def race(spark, sf):
    return S.project_race(L.dense_components(spark, sf), L.METRICS, L.AS_OF, L.PERIODS)


@query("race_projection", RACE + """
SELECT entity, metric, ytd_value, proj_value, ytd_points, proj_points FROM proj""")
def race_projection(spark, sf):
    return race(spark, sf).select("entity", "metric", "ytd_value", "proj_value", "ytd_points", "proj_points")


@query("projected_totals", RACE + """
, t AS (SELECT entity, sum(proj_points) AS total FROM proj GROUP BY 1)
SELECT entity, total, row_number() OVER (ORDER BY total DESC, entity) AS rank FROM t""")
def projected_totals(spark, sf):
    points = race(spark, sf).groupBy("entity").agg(F.sum("proj_points").alias("total"))
    return ranking.row_rank(points, [], [F.desc("total"), F.asc("entity")])


@query("marginal_curve", RACE + f"""
, us AS (SELECT metric, proj_value AS ov, proj_points AS op, impact AS oi FROM imp WHERE entity=7),
c AS (SELECT p.metric, p.entity AS passes, {rnd("abs(p.proj_value-ov)", 4)} AS units_needed,
  {rnd("abs(p.proj_value-ov)/nullif(oi,0)", 1)} AS swaps, p.proj_points-op AS points_gain
  FROM proj p JOIN us ON p.metric=us.metric WHERE p.proj_points>op),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY units_needed, passes) AS step FROM c)
SELECT * FROM r WHERE step<=4""")
def marginal_curve(spark, sf):
    return S.marginal_curve(race(spark, sf), L.US, L.METRICS)


GAPS = RACE + """,
gaps AS (SELECT *, abs(lag(proj_value) OVER w - proj_value) AS gap_up, lag(proj_points) OVER w - proj_points AS points_up,
  abs(proj_value - lead(proj_value) OVER w) AS cushion
  FROM imp WINDOW w AS (PARTITION BY metric ORDER BY CASE WHEN direction='lower' THEN proj_value ELSE -proj_value END, entity))
"""


@query("neighbour_gaps", GAPS + f"""
SELECT entity, metric, {rnd("gap_up", 4)} AS gap_up, points_up, {rnd("cushion", 4)} AS cushion FROM gaps""")
def neighbour_gaps(spark, sf):
    gaps = ranking.neighbour_gaps(race(spark, sf), ["metric"], "proj_value", F.col("direction"), "proj_points")
    return gaps.select("entity", "metric", fixed(F.col("gap_up"), 4).alias("gap_up"), "points_up",
                       fixed(F.col("cushion"), 4).alias("cushion"))


@query("cushion_below", GAPS + f"""
SELECT metric, proj_value, proj_points, {rnd("cushion", 4)} AS cushion,
  {rnd("cushion/nullif(impact,0)", 2)} AS cushion_swaps FROM gaps WHERE entity=7""")
def cushion_below(spark, sf):
    return S.cushion(race(spark, sf), L.US, L.METRICS)


# --- backtests -------------------------------------------------------------

STANDS = [20, 40, 60]


def _sql_backtest() -> str:
    cols = []
    for c in L.COMPONENTS:
        cols.append(f"cast(sum({c}) OVER (PARTITION BY entity ORDER BY period ROWS UNBOUNDED PRECEDING) AS double) AS {c}_ytd")
        cols.append(f"cast(sum({c}) OVER (PARTITION BY entity ORDER BY period ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS double)/4 AS {c}_recent")
    run = "SELECT entity, period, " + ", ".join(cols) + " FROM dense"
    models = "(VALUES ('baseline',cast(0.0 AS double)),('form',cast(1.0 AS double)),('blend',cast(0.35 AS double))) m(model,weight)"
    last = "SELECT entity, " + ", ".join(f"cast({c}_ytd AS bigint) AS {c}" for c in L.COMPONENTS) + " FROM run WHERE period=80"
    return (WITH + f",\nrun AS ({run}),\nstood AS (SELECT run.*, period AS stand, model, weight FROM run, {models} WHERE period IN (20,40,60)),\n"
            + "bp0 AS (" + _sql_project("stand", "(80-stand)", "weight", "stood", "entity, stand, model") + "),\n"
            + "bp AS (SELECT *, " + L.sql_points("stand, model, metric", "proj_value") + " AS pred_points FROM bp0),\n"
            + f"fin AS ({last}),\ntr0 AS (" + L.sql_metrics("fin", "entity") + "),\n"
            + "tr AS (SELECT entity, metric, value AS actual_value, " + L.sql_points("metric") + " AS actual_points FROM tr0),\n"
            + "bt AS (SELECT bp.*, actual_value, actual_points FROM bp JOIN tr ON bp.entity=tr.entity AND bp.metric=tr.metric),\n"
            + f"sc AS (SELECT stand, model, metric, {rnd('avg(abs(pred_points-actual_points))', 4)} AS points_mae FROM bt GROUP BY 1,2,3)\n")


BT = _sql_backtest()


def results(spark, sf):
    return S.backtest(L.settled_components(spark, sf), L.METRICS, STANDS, L.PERIODS)


@query("backtest_projection", BT + """
SELECT entity, stand, model, metric, proj_value, actual_value, pred_points, actual_points FROM bt""")
def backtest_projection(spark, sf):
    return results(spark, sf).select("entity", "stand", "model", "metric", "proj_value", "actual_value",
                                     "pred_points", "actual_points")


@query("backtest_score", BT + "SELECT * FROM sc")
def backtest_score(spark, sf):
    return S.backtest_score(results(spark, sf))


@query("rank_displacement", BT + f"""
, b AS (SELECT stand, model, entity, sum(pred_points) AS pred, sum(actual_points) AS actual FROM bt GROUP BY 1,2,3),
r AS (SELECT *, row_number() OVER (PARTITION BY stand, model ORDER BY pred DESC, entity) AS pr,
  row_number() OVER (PARTITION BY stand, model ORDER BY actual DESC, entity) AS ar FROM b)
SELECT stand, model, {rnd("avg(abs(pr-ar))", 4)} AS displacement, {rnd("avg(abs(pred-actual))", 4)} AS total_mae
FROM r GROUP BY 1,2""")
def rank_displacement(spark, sf):
    return S.rank_displacement(results(spark, sf))


@query("model_deltas", BT + f"""
, t AS (SELECT model, stand, {rnd("sum(points_mae)", 4)} AS mae FROM sc GROUP BY 1,2)
SELECT model, stand, mae, {rnd("mae - lag(mae) OVER (PARTITION BY model ORDER BY stand)", 4)} AS delta FROM t""")
def model_deltas(spark, sf):
    return S.model_ledger(S.backtest_score(results(spark, sf)))


@query("completeness_anti", WITH + """
SELECT n_nationkey AS entity, cast(p AS integer) AS period FROM nation, range(1,81) t(p)
WHERE NOT EXISTS (SELECT 1 FROM comp WHERE entity=n_nationkey AND period=p)""")
def completeness_anti(spark, sf):
    return S.missing_periods(L.components(spark, sf), L.entities(spark, sf), L.PERIODS)


# --- rivals ----------------------------------------------------------------

NEEDS = GAPS + f""",
norms AS (SELECT metric, avg(value)*20 AS norm FROM (SELECT * FROM ({L.sql_metrics("dense", "entity, period")}) WHERE period<=60 AND kind='counting') GROUP BY 1),
nu AS (SELECT g.*, CASE WHEN kind='rate' THEN impact ELSE norm END AS unit FROM gaps g LEFT JOIN norms n ON g.metric=n.metric),
needs AS (SELECT entity, metric,
  coalesce(points_up>0 AND gap_up/nullif(unit,0) < CASE WHEN kind='rate' THEN 1.2 ELSE 0.25 END, false) AS chasing,
  coalesce(cushion/nullif(unit,0) > CASE WHEN kind='rate' THEN 2.0 ELSE 0.22 END, false) AS surplus,
  {rnd("gap_up/nullif(unit,0)", 3)} AS effort, {rnd("cushion/nullif(unit,0)", 3)} AS slack, points_up FROM nu)
"""


def norms(comps):
    values = S.period_values(comps.where(F.col("period") <= L.AS_OF), L.METRICS)
    weekly = values.where(F.col("kind") == "counting").groupBy("metric")
    return weekly.agg((F.avg("value") * (L.PERIODS - L.AS_OF)).alias("norm"))


def profiles(spark, sf):
    comps = L.settled_components(spark, sf)
    projected = S.project_race(comps, L.METRICS, L.AS_OF, L.PERIODS)
    return S.needs_surplus(projected, norms(comps), L.METRICS)


@query("rival_needs", NEEDS + "SELECT * FROM needs")
def rival_needs(spark, sf):
    return profiles(spark, sf)


@query("complementarity", NEEDS + """
, us AS (SELECT metric, chasing AS wc, surplus AS ws, points_up AS og FROM needs WHERE entity=7),
s AS (SELECT n.entity,
  sum(CASE WHEN surplus AND wc THEN og ELSE 0 END + CASE WHEN chasing AND ws THEN points_up ELSE 0 END) AS score,
  cast(sum(CASE WHEN surplus AND wc THEN 1 ELSE 0 END) AS bigint) AS can_give,
  cast(sum(CASE WHEN chasing AND ws THEN 1 ELSE 0 END) AS bigint) AS wants
  FROM needs n JOIN us ON n.metric=us.metric WHERE n.entity<>7 GROUP BY 1)
SELECT * FROM s WHERE can_give>0 OR wants>0""")
def complementarity(spark, sf):
    return S.complementarity(profiles(spark, sf), L.US)


# --- member boards ---------------------------------------------------------

MEMBER = WITH + """, mt AS (SELECT member, cast(sum(qty) AS bigint) AS qty FROM mp GROUP BY 1),
ms AS (SELECT c_mktsegment AS role, member, cast(qty AS double) AS value FROM mt JOIN customer ON c_custkey=member)"""


@query("member_rank_points", MEMBER + """
SELECT role, member, value, cast(rank() OVER (PARTITION BY role ORDER BY value DESC) AS bigint) AS place,
  cast(count(*) OVER (PARTITION BY role) AS double) - (rank() OVER (PARTITION BY role ORDER BY value DESC) - 1)
  - (count(*) OVER (PARTITION BY role, value) - 1)/2.0 AS points FROM ms""")
def member_rank_points(spark, sf):
    totals = L.member_periods(spark, sf).groupBy("member").agg(F.sum("qty").cast("double").alias("value"))
    ranked = totals.join(L.members(spark, sf), "member").select("role", "member", "value")
    places = ranking.rank_points_wide(ranked, ["role"], "value")
    return ranked.join(places, ["role", "value"]).select("role", "member", "value", "place", "points")


@query("zscores_by_entity", WITH + f"""
, v AS (SELECT entity, period, qty FROM dense WHERE period<=60),
s AS (SELECT entity, cast(count(*) AS double) AS n, cast(sum(qty) AS double) AS s1, cast(sum(qty*qty) AS double) AS s2 FROM v GROUP BY 1),
p AS (SELECT *, sqrt((n*s2-s1*s1)/(n*(n-1))) AS sd FROM s)
SELECT v.entity, v.period, {rnd("CASE WHEN sd>0 THEN (qty-s1/n)/sd ELSE 0 END", 5)} AS z FROM v JOIN p ON v.entity=p.entity""")
def zscores_by_entity(spark, sf):
    from contestlake.operators.resample import zscores

    wide = L.dense_components(spark, sf, L.AS_OF).select("entity", "period", F.lit("QTY").alias("metric"), F.col("qty").cast("double").alias("value"))
    return zscores(wide).select("entity", "period", fixed(F.col("z"), 5).alias("z"))

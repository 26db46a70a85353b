"""Correlation and rank distribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestlake.functions.rates import fixed
from contestlake.operators import resample as R
from contestlake.operators import scan
from contestlake.plans import league as L
from contestlake.plans import standings as P
from contestlake.plans.registry import query, rnd

CODES = [m.code for m in L.METRICS]
DRAWS = 5000
SEED = 2026
LEFT = L.PERIODS - L.AS_OF


def correlation(comps):
    past = comps.where(F.col("period") <= L.AS_OF)
    values = P.S.period_values(past, L.METRICS).select("entity", "period", "metric", "value")
    return R.metric_correlation(values, CODES)


CORR = P.RACE + f""",
hv AS ({L.sql_metrics("(SELECT * FROM dense WHERE period<=60)", "entity, period")}),
hm AS (SELECT entity, metric, cast(count(*) AS double) AS n, sum(value) AS s1, sum(value*value) AS s2 FROM hv GROUP BY 1,2),
hs AS (SELECT entity, metric, n, s1/n AS mean, CASE WHEN n<2 THEN 0 ELSE sqrt(greatest((n*s2-s1*s1)/(n*(n-1)),0)) END AS sd FROM hm),
z AS (SELECT hv.entity, hv.period, hv.metric, CASE WHEN sd>0 THEN (value-mean)/sd ELSE 0 END AS z FROM hv JOIN hs ON hv.entity=hs.entity AND hv.metric=hs.metric),
whole AS (SELECT entity, period FROM z GROUP BY 1,2 HAVING count(*)=6),
cor AS (SELECT x.metric AS a, y.metric AS b, CASE WHEN x.metric=y.metric THEN 1.000001 ELSE sum(x.z*y.z)/(count(*)-1) END AS r,
  CASE WHEN x.metric=y.metric THEN 1.000001 ELSE coalesce(sum(x.z*y.z)/nullif(sqrt(sum(x.z*x.z)*sum(y.z*y.z)),0),0) END AS scaled
  FROM z x JOIN z y ON x.entity=y.entity AND x.period=y.period JOIN whole w ON w.entity=x.entity AND w.period=x.period GROUP BY 1,2)
"""


def _sql_draws() -> str:
    k = len(CODES)
    def cells(column):
        return ", ".join(f"max(CASE WHEN a='{CODES[i]}' AND b='{CODES[j]}' THEN {column} END) AS a{i}{j}"
                         for i in range(k) for j in range(i + 1))

    low = []
    for i in range(k):
        for j in range(i + 1):
            done = "".join(f" - l{i}{m}*l{j}{m}" for m in range(j))
            if i == j:
                low += [f"a{i}{i}{done} AS p{i}", f"sqrt(greatest(p{i},cast(1e-9 AS double))) AS l{i}{i}"]
            else:
                low.append(f"(a{i}{j}{done})/l{j}{j} AS l{i}{j}")
    ok = "least(" + ",".join(f"r.p{i}" for i in range(k)) + ")>0"
    pick = ", ".join(f"CASE WHEN {ok} THEN r.l{i}{j} ELSE s.l{i}{j} END AS l{i}{j}" for i in range(k) for j in range(i + 1))
    def uni(key, start):
        return (f"(cast(('0x'||substr(md5({key}),{start},13)) AS bigint)+cast(0.5 AS double))"
                "/cast(4503599627370496 AS double)")

    def norm(tail):
        key = f"'{SEED}:'||draw||':'||entity||':{tail}'"
        return f"sqrt(-2.0*ln({uni(key, 1)}))*cos(2.0*pi()*{uni(key, 17)})"

    comps = []
    for c in L.COMPONENTS:
        x = f"cast({c} AS double)"
        comps += [f"sum({x}) AS {c}_ytd", f"sum(CASE WHEN period>56 THEN {x} ELSE 0 END)/4*{LEFT} AS {c}_mean",
                  f"sqrt(greatest((count(*)*sum({x}*{x})-sum({x})*sum({x}))/(cast(count(*) AS double)*(count(*)-1)),0))*sqrt({LEFT}) AS {c}_sd"]
    zs = ", ".join(f"{norm(m)} AS z{i}" for i, m in enumerate(CODES))
    parts = []
    for i, m in enumerate(L.METRICS):
        shock = "(" + "+".join(f"l{i}{j}*z{j}" for j in range(i + 1)) + ")"
        mean = f"(SELECT proj_value FROM proj WHERE proj.entity=e.entity AND metric='{m.code}')"
        if m.is_rate:
            val = (f"(mean*{m.den}_ytd + greatest(0,{m.num}_mean+{m.num}_sd*{shock})*cast({m.scale} AS double))"
                   f"/({m.den}_ytd+greatest(1,{m.den}_mean+{m.den}_sd*{norm(m.code + ':den')}))")
        else:
            val = f"mean+{m.num}_sd*{shock}"
        parts.append(f"SELECT draw, e.entity, '{m.code}' AS metric, '{m.direction}' AS direction, {rnd(val, 4)} AS value "
                     f"FROM (SELECT zz.*, proj_value AS mean FROM zz JOIN proj ON proj.entity=zz.entity AND metric='{m.code}') e")
    return (CORR + f", ar AS (SELECT {cells('r')} FROM cor),\nas_ AS (SELECT {cells('scaled')} FROM cor),\n"
            f"lr AS (SELECT {', '.join(low)} FROM ar),\nls AS (SELECT {', '.join(low)} FROM as_),\n"
            f"lm AS (SELECT {pick} FROM lr r, ls s),\n"
            f"st AS (SELECT entity, {', '.join(comps)} FROM dense WHERE period<=60 GROUP BY entity),\n"
            f"zz AS (SELECT st.*, draw, lm.*, {zs} FROM st, range(0,{DRAWS}) t(draw), lm),\n"
            f"dv AS ({' UNION ALL '.join(parts)}),\n"
            f"dp AS (SELECT *, {L.sql_points('draw, metric')} AS points FROM dv),\n"
            "dt AS (SELECT draw, entity, sum(points) AS total FROM dp GROUP BY 1,2),\n"
            "dr AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY total DESC, entity) AS place FROM dt)\n")


DRAW_SQL = _sql_draws()


def draws(spark, sf):
    comps = L.settled_components(spark, sf)
    race = P.S.project_race(comps, L.METRICS, L.AS_OF, L.PERIODS)
    params = R.draw_params(comps, race, L.METRICS, L.AS_OF, LEFT)
    lower = R.factor(correlation(comps), CODES)
    return R.rank_draws(params, CODES, lower, DRAWS, SEED)


@query("metric_correlation", CORR + f"SELECT a, b, {rnd('r', 6)} AS r FROM cor")
def metric_correlation(spark, sf):
    return correlation(L.settled_components(spark, sf)).select("a", "b", fixed(F.col("r"), 6).alias("r"))


@query("rank_pmf", DRAW_SQL + f"SELECT entity, place, cast(count(*) AS double)/{DRAWS} AS p FROM dr GROUP BY 1,2")
def rank_pmf(spark, sf):
    return R.rank_pmf(draws(spark, sf), DRAWS)


_DIST = DRAW_SQL + f""",
o AS (SELECT entity, place, row_number() OVER (PARTITION BY entity ORDER BY place, draw) AS i FROM dr),
q AS (SELECT entity, max(CASE WHEN i={int(.1*DRAWS)+1} THEN place END) AS rank_best10,
  max(CASE WHEN i={int(.5*DRAWS)+1} THEN place END) AS rank_p50, max(CASE WHEN i={int(.9*DRAWS)+1} THEN place END) AS rank_worst10 FROM o GROUP BY 1),
s AS (SELECT entity, cast(sum(CASE WHEN place=1 THEN 1 ELSE 0 END) AS double)/{DRAWS} AS p_win,
  cast(sum(CASE WHEN place<=5 THEN 1 ELSE 0 END) AS double)/{DRAWS} AS p_paid, {rnd(f"cast(sum(place) AS double)/{DRAWS}", 4)} AS mean_rank FROM dr GROUP BY 1)
"""


@query("rank_distribution", _DIST + "SELECT s.*, rank_best10, rank_p50, rank_worst10 FROM s JOIN q ON s.entity=q.entity")
def rank_distribution(spark, sf):
    return R.rank_distribution(draws(spark, sf), DRAWS)


def _ord(c):
    return (f"({c}||CASE WHEN {c}%100 BETWEEN 10 AND 20 THEN 'th' WHEN {c}%10=1 THEN 'st' WHEN {c}%10=2 THEN 'nd' "
            f"WHEN {c}%10=3 THEN 'rd' ELSE 'th' END)")


@query("finish_lines", _DIST + f"""SELECT entity, CASE WHEN rank_best10=rank_worst10 THEN {_ord('rank_p50')} ELSE
 {_ord('rank_p50')}||' ('||{_ord('rank_best10')}||'-'||{_ord('rank_worst10')}||')' END AS line FROM q""")
def finish_lines(spark, sf):
    return R.finish_lines(R.rank_distribution(draws(spark, sf), DRAWS))


@query("outcome_buckets", DRAW_SQL + f"""
SELECT entity, {rnd(f"cast(sum(CASE WHEN place=1 THEN 1 ELSE 0 END) AS double)/{DRAWS}", 6)} AS win,
 {rnd(f"cast(sum(CASE WHEN place BETWEEN 2 AND 5 THEN 1 ELSE 0 END) AS double)/{DRAWS}", 6)} AS money,
 {rnd(f"cast(sum(CASE WHEN place BETWEEN 6 AND 9 THEN 1 ELSE 0 END) AS double)/{DRAWS}", 6)} AS outside,
 {rnd(f"cast(sum(CASE WHEN place>=10 THEN 1 ELSE 0 END) AS double)/{DRAWS}", 6)} AS back FROM dr GROUP BY 1""")
def outcome_buckets(spark, sf):
    return R.outcome_buckets(R.rank_pmf(draws(spark, sf), DRAWS), 25)


@query("nearest_rank_percentiles", "WITH " + L.SQL_COMPONENTS + """
, t AS (SELECT c_mktsegment AS role, member, sum(qty) AS qty FROM mp JOIN customer ON c_custkey=member GROUP BY 1,2),
o AS (SELECT role, qty, row_number() OVER (PARTITION BY role ORDER BY qty, member) AS i, count(*) OVER (PARTITION BY role) AS n FROM t)
SELECT role, cast(max(CASE WHEN i=least(floor(cast(0.1 AS double)*n)+1,n) THEN qty END) AS bigint) AS p10,
 cast(max(CASE WHEN i=least(floor(cast(0.5 AS double)*n)+1,n) THEN qty END) AS bigint) AS p50,
 cast(max(CASE WHEN i=least(floor(cast(0.9 AS double)*n)+1,n) THEN qty END) AS bigint) AS p90 FROM o GROUP BY role""")
def nearest_rank_percentiles(spark, sf):
    by_member = L.member_periods(spark, sf).groupBy("member").agg(F.sum("qty").alias("qty"))
    counts = by_member.join(L.members(spark, sf), "member").groupBy("role", "qty").agg(F.count(F.lit(1)).alias("count"))
    chunk = scan.value_chunks(counts, "qty")
    return R.nearest_rank(counts, ["role"], "qty", [0.1, 0.5, 0.9], ["p10", "p50", "p90"], chunk)

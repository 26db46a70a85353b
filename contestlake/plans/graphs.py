"""Similarity, community and advice queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from contestlake.functions.calendars import Calendar
from contestlake.operators import advice as AD
from contestlake.operators import graphs as G
from contestlake.operators import joins as J
from contestlake.plans import league as L
from contestlake.plans import scenarios as SC
from contestlake.plans.registry import query, rnd

SCALES = {"qty": 10.0, "rev": 1e6, "ord": 1.0, "ret": 1.0, "dsc": 1e7}
FEATURES = "WITH " + L.SQL_COMPONENTS + """,
ft AS (SELECT member, [cast(sum(qty) AS double)/80/cast(10 AS double), cast(sum(rev) AS double)/80/cast(1000000 AS double), cast(sum(ord) AS double)/80/cast(1 AS double), cast(sum(ret) AS double)/80/cast(1 AS double), cast(sum(dsc) AS double)/80/cast(10000000 AS double)] AS f FROM mp GROUP BY 1),
pr AS (SELECT a.member AS source, b.member AS target, """ + rnd("list_cosine_similarity(a.f,b.f)", 6) + """ AS sim FROM ft a JOIN ft b ON a.member<>b.member),
kn AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sim DESC, target) AS rank FROM pr WHERE sim>=0.92)
"""


def features(spark, sf):
    totals = L.member_periods(spark, sf).groupBy("member").agg(*[F.sum(c).alias(c) for c in L.COMPONENTS])
    return G.feature_vectors(totals, L.PERIODS, SCALES)


@query("feature_vectors", FEATURES + "SELECT member, " + ", ".join(rnd(f"f[{i}]", 6) + f" AS f{i}" for i in range(1, 6)) + " FROM ft")
def feature_vectors(spark, sf):
    from contestlake.functions.rates import fixed

    return features(spark, sf).select("member", *[fixed(F.col("features")[i], 6).alias(f"f{i + 1}") for i in range(5)])


def edges(spark, sf):
    return G.knn_edges(features(spark, sf), "member", "features")


@query("knn_edges", FEATURES + "SELECT source, target, sim, rank FROM kn WHERE rank<=6")
def knn_edges(spark, sf):
    return edges(spark, sf)


@query("similar_free_agents", FEATURES + """, e AS (SELECT source, target, sim FROM kn WHERE rank<=6),
b AS (SELECT * FROM e UNION SELECT target, source, sim FROM e),
r AS (SELECT source, target, sim, row_number() OVER (PARTITION BY source ORDER BY sim DESC, target) AS rank FROM b WHERE target%3=0) SELECT * FROM r WHERE rank<=4""")
def similar_free_agents(spark, sf):
    held = L.members(spark, sf).where(F.col("member") % 3 != 0)
    return G.nearest_free(edges(spark, sf), held, 4)


@query("embedding_neighbours", """
WITH pr AS (SELECT a.vec_id AS source, b.vec_id AS target, """ + rnd(
    "list_cosine_similarity(cast(a.embedding AS double[]),cast(b.embedding AS double[]))", 6) + """ AS sim FROM embeddings a JOIN embeddings b ON a.vec_id<>b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sim DESC, target) AS rank FROM pr WHERE sim>=0.35) SELECT * FROM r WHERE rank<=6""")
def embedding_neighbours(spark, sf):
    return G.knn_edges(L.table(spark, sf, "embeddings"), "vec_id", "embedding", cutoff=0.35)


CO = """
WITH t AS (SELECT DISTINCT s_nationkey AS entity, l_partkey AS member FROM lineitem JOIN supplier ON s_suppkey=l_suppkey WHERE l_returnflag='R'),
ed AS (SELECT a.entity AS a, b.entity AS b, count(*) AS weight FROM t a JOIN t b ON a.member=b.member AND a.entity<b.entity GROUP BY 1,2),
wy AS (SELECT a, b, weight FROM ed UNION ALL SELECT b, a, weight FROM ed),
l0 AS (SELECT n_nationkey AS node, n_nationkey AS label FROM nation)
"""
for _i in range(5):
    CO += f""", v{_i} AS (SELECT a AS node, label, sum(weight) AS votes FROM wy JOIN l{_i} ON node=b GROUP BY 1,2),
l{_i + 1} AS MATERIALIZED (SELECT l{_i}.node, coalesce(n.label, l{_i}.label) AS label FROM l{_i} LEFT JOIN (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY votes DESC, label) AS r FROM v{_i}) n ON n.node=l{_i}.node AND r=1)
"""


def supplier_edges(spark, sf):
    """Supplier nations that had the same part returned."""
    back = L.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.col("l_partkey").alias("member"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    who = back.join(L.table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("entity")), "s_suppkey")
    return J.shared_member_edges(who)


@query("shared_part_edges", CO + "SELECT * FROM ed")
def shared_part_edges(spark, sf):
    return supplier_edges(spark, sf)


@query("communities", CO + "SELECT * FROM l5")
def communities(spark, sf):
    nodes = L.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"))
    return G.communities(supplier_edges(spark, sf), nodes)


@query("supplier_communities")
def supplier_communities(spark, sf):
    """Louvain communities of the suppliers that had the same part returned; unweighted, as edges that occur at all."""
    back = L.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").select(
        F.col("l_partkey").alias("member"), F.col("l_suppkey").alias("entity")).distinct()
    nodes = L.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))
    labels, _ = G.louvain(J.shared_member_edges(back), nodes)
    return labels


# --- advice ----------------------------------------------------------------

CALENDAR = Calendar(date(2024, 1, 1), date(2024, 1, 8), 5)
AS_OF = date(2024, 1, 24)
ADVICE = """
WITH ev AS (SELECT *, cast(ts AS date) AS d, cast((cast(ts AS date)-DATE '2024-01-01')//7+1 AS integer) AS period FROM events),
rec AS (SELECT event_id AS rec, user_id AS member, period FROM ev WHERE event_type='view' AND value>40),
ax AS (SELECT user_id AS member, ts, d FROM ev WHERE event_type='signup' AND value>60),
dm AS (SELECT rec, rec.member, rec.period, (SELECT min(ts) FROM ax WHERE ax.member=rec.member AND d>=DATE '2024-01-01'+cast(7*(rec.period-1) AS integer)-2 AND d<DATE '2024-01-01'+cast(7*rec.period AS integer)) AS decided_at FROM rec),
ms AS (SELECT *, CASE WHEN decided_at IS NOT NULL THEN 'adopted' WHEN DATE '2024-01-01'+cast(7*(period-1) AS integer)<DATE '2024-01-24' THEN 'expired' ELSE 'open' END AS status FROM dm),
pd AS (SELECT user_id AS member, period, count(CASE WHEN event_type='purchase' THEN 1 END)+2*(count(CASE WHEN event_type='click' THEN 1 END)+0)+2*count(CASE WHEN event_type='signup' THEN 1 END)+cast(0.5 AS double)*count(CASE WHEN event_type='error' THEN 1 END) AS made FROM ev GROUP BY 1,2)
"""


def decisions(spark, sf):
    ev = L.table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    advice = ev.where((F.col("event_type") == "view") & (F.col("value") > 40)).select(
        F.col("event_id").alias("rec"), F.col("user_id").alias("member"), CALENDAR.number(F.col("date")).alias("period"))
    acts = ev.where((F.col("event_type") == "signup") & (F.col("value") > 60)).select(
        F.col("user_id").alias("member"), "date", F.col("ts").alias("acted_at"))
    return AD.match_decisions(advice, acts, CALENDAR, AS_OF)


def production(spark, sf):
    ev = L.table(spark, sf, "events").withColumn("period", CALENDAR.number(F.to_date("ts")))
    n = lambda t: F.sum((F.col("event_type") == t).cast("long"))
    counts = ev.groupBy(F.col("user_id").alias("member"), "period").agg(
        n("purchase").alias("k"), n("click").alias("qs"), n("signup").alias("sv"), n("error").alias("hr"))
    zero = F.lit(0)
    return counts.withColumn("made", AD.produced(F.col("k"), F.col("qs"), zero, F.col("sv"), F.col("hr"), zero))


@query("advice_matching", ADVICE + "SELECT rec, member, period, decided_at, status FROM ms")
def advice_matching(spark, sf):
    return decisions(spark, sf).select("rec", "member", "period", "decided_at", "status")


@query("outcome_scoring", ADVICE + f"""
SELECT rec, ms.member, ms.period, status, coalesce(made,0.0) AS made,
 {rnd("least(1.0,coalesce(made,0)/12.0)*CASE WHEN status='adopted' THEN 1 ELSE 0 END-CASE WHEN status='adopted' AND coalesce(made,0)<3 THEN cast(0.3 AS double) ELSE 0 END", 2)} AS score
FROM ms LEFT JOIN pd ON pd.member=ms.member AND pd.period=ms.period WHERE status<>'open' AND DATE '2024-01-01'+cast(7*ms.period-1 AS integer)<DATE '2024-01-24'""")
def outcome_scoring(spark, sf):
    return AD.score_outcomes(decisions(spark, sf), production(spark, sf).select("member", "period", "made"), CALENDAR, AS_OF)


@query("outcome_two_periods", ADVICE + f"""
, m2 AS (SELECT rec, coalesce(sum(made),0.0) AS made FROM ms LEFT JOIN pd ON pd.member=ms.member AND pd.period BETWEEN ms.period AND ms.period+1 GROUP BY 1)
SELECT ms.rec, member, period, status, made, {rnd("least(1.0,made/12.0)*CASE WHEN status='adopted' THEN 1 ELSE 0 END-CASE WHEN status='adopted' AND made<3 THEN cast(0.3 AS double) ELSE 0 END", 2)} AS score
FROM ms JOIN m2 ON m2.rec=ms.rec WHERE status<>'open' AND DATE '2024-01-01'+cast(7*(period+1)-1 AS integer)<DATE '2024-01-24'""")
def outcome_two_periods(spark, sf):
    return AD.score_outcomes(decisions(spark, sf), production(spark, sf).select("member", "period", "made"), CALENDAR, AS_OF, horizon=2)


@query("advice_funnel", ADVICE + "SELECT status, count(*) AS n FROM ms GROUP BY 1")
def advice_funnel(spark, sf):
    return decisions(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _sql_shadow() -> str:
    """One step per period: new members in, as many weakest original members out."""
    sql = SC.BASE + f""",
ad AS (SELECT DISTINCT c_nationkey AS entity, member, period FROM dl JOIN customer ON c_custkey=member
  WHERE period>{L.AS_OF} AND period<={L.AS_OF + 4} AND rev>50000000),
r0 AS (SELECT entity, member, quality FROM ro)"""
    for i in range(1, 5):
        sql += f""",
n{i} AS (SELECT entity, member FROM ad WHERE period={L.AS_OF + i} AND NOT EXISTS (SELECT 1 FROM r{i - 1} r WHERE r.entity=ad.entity AND r.member=ad.member)),
w{i} AS (SELECT entity, count(*) AS wanted FROM n{i} GROUP BY 1),
k{i} AS (SELECT entity, member, row_number() OVER (PARTITION BY entity ORDER BY quality, member) AS weak FROM r{i - 1} WHERE quality IS NOT NULL),
r{i} AS MATERIALIZED (SELECT r.entity, r.member, r.quality FROM r{i - 1} r LEFT JOIN k{i} k ON k.entity=r.entity AND k.member=r.member
  LEFT JOIN w{i} w ON w.entity=r.entity WHERE coalesce(k.weak>w.wanted, true) UNION ALL SELECT entity, member, NULL FROM n{i})"""
    every = " UNION ALL ".join(f"SELECT entity, member, {L.AS_OF + i} AS period FROM r{i}" for i in range(1, 5))
    return sql + f""",
al AS ({every})
SELECT al.entity, al.period, count(DISTINCT al.member) AS members, cast(sum(coalesce(qty,0)) AS bigint) AS qty, cast(sum(coalesce(ord,0)) AS bigint) AS ord
FROM al LEFT JOIN mp ON mp.member=al.member AND mp.period=al.period GROUP BY 1,2"""


@query("shadow_portfolio", _sql_shadow())
def shadow_portfolio(spark, sf):
    """Rosters of every nation that follow each adopted new customer."""
    start = SC.rosters(spark, sf).select("entity", "member", "quality")
    late = L.day_lines(spark, sf).where((F.col("period") > L.AS_OF) & (F.col("period") <= L.AS_OF + 4) & (F.col("rev") > 5e7))
    adds = late.select("member", "period").distinct().join(L.members(spark, sf).select("member", "entity"), "member")
    rosters = AD.shadow_portfolio(start, adds, [L.AS_OF + i for i in (1, 2, 3, 4)])
    return AD.score_portfolio(rosters, L.member_periods(spark, sf).select("member", "period", "qty", "ord"), ["qty", "ord"])

"""Recompute and capacity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestlake.functions.rates import cents
from contestlake.operators import aggregates as A
from contestlake.operators import recompute as R
from contestlake.operators import standings as S
from contestlake.plans import league as L
from contestlake.plans import standings as P
from contestlake.plans.registry import query


@query("recompute_accuracy", P.WITH + f"""
, lu AS (SELECT c_nationkey AS entity, member, period FROM mp JOIN customer ON c_custkey=member WHERE (member+period)%9<>0),
rs AS (SELECT entity, lu.period, cast(sum(qty) AS bigint) AS qty, cast(sum(rev) AS bigint) AS rev, cast(sum(ord) AS bigint) AS ord, cast(sum(ret) AS bigint) AS ret, cast(sum(dsc) AS bigint) AS dsc
  FROM lu JOIN mp ON mp.member=lu.member AND mp.period=lu.period GROUP BY 1,2),
ours AS ({L.sql_metrics("rs", "entity, period")}), off AS ({L.sql_metrics("comp", "entity, period")}),
b AS (SELECT off.metric, CASE WHEN ours.value IS NULL THEN 'miss' WHEN abs(ours.value-off.value)<1e-9 THEN 'match'
  WHEN abs(ours.value-off.value)<=CASE off.metric WHEN 'DISC' THEN cast(0.05 AS double) WHEN 'PPU' THEN 20.0 ELSE 0.5 END THEN 'close' ELSE 'miss' END AS bucket
  FROM off LEFT JOIN ours ON ours.entity=off.entity AND ours.period=off.period AND ours.metric=off.metric)
SELECT metric, cast(sum(CASE WHEN bucket='match' THEN 1 ELSE 0 END) AS bigint) AS match, cast(sum(CASE WHEN bucket='close' THEN 1 ELSE 0 END) AS bigint) AS close, cast(sum(CASE WHEN bucket='miss' THEN 1 ELSE 0 END) AS bigint) AS miss FROM b GROUP BY 1""")
def recompute_accuracy(spark, sf):
    mp = L.member_periods(spark, sf)
    lineups = mp.select("member", "period").join(L.members(spark, sf).select("member", "entity"), "member").withColumn(
        "section", F.when((F.col("member") + F.col("period")) % 9 != 0, "active").otherwise("bench"))
    ours = R.recompute(lineups, mp, L.METRICS)
    official = S.period_values(L.components(spark, sf), L.METRICS)
    return A.accuracy(ours, official, {"DISC": 0.05, "PPU": 20.0})


CAPS = {"F": 3, "O": 3}
GROUP = ["game"]
COUNTS = ["qty", "disc", "tax"]


def occupants(spark, sf):
    """Lines of an order as the occupants of a lineup; status is the slot."""
    li = L.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("game"), F.col("l_linestatus").alias("slot"), F.col("l_linenumber").alias("n"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").cast("long").alias("qty"),
        F.round(F.col("l_discount") * 100).cast("long").alias("disc"), F.round(F.col("l_tax") * 100).cast("long").alias("tax"),
        cents(F.col("l_extendedprice")).alias("rev"))
    return R.indexed(li, GROUP, ["n", "part", "supp", "qty", "rev"])


def official(rows):
    """Official totals: in each slot only the first occupants took part."""
    from contestlake.operators import ranking

    played = ranking.top_k(rows, ["game", "slot"], [F.asc("idx")], 3, "r")
    # Every seventh order is published with a wrong count and has no solution.
    wrong = F.when(F.col("game") % 7 == 0, 1000).otherwise(0)
    return played.groupBy("game").agg(
        *[F.sum(c).alias(f"off_{c}") for c in COUNTS], (F.sum("rev") / F.sum("qty")).alias("off_ppu")).withColumn(
        "off_qty", F.col("off_qty") - wrong)


CAPACITY = """
WITH li AS (SELECT l_orderkey AS game, l_linestatus AS slot, cast(l_quantity AS bigint) AS qty, cast(round(l_discount*100) AS bigint) AS disc, cast(round(l_tax*100) AS bigint) AS tax,
  cast(round(l_extendedprice*100) AS bigint) AS rev, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, cast(l_quantity AS bigint), cast(round(l_extendedprice*100) AS bigint)) AS idx FROM lineitem),
sl AS (SELECT *, row_number() OVER (PARTITION BY game, slot ORDER BY idx) AS sr FROM li),
tot AS (SELECT game, count(*) AS n, sum(qty) AS tq, sum(disc) AS td, sum(tax) AS tt, sum(rev) AS tr,
  greatest(count(CASE WHEN slot='F' THEN 1 END)-3,0) AS ef, greatest(count(CASE WHEN slot='O' THEN 1 END)-3,0) AS eo,
  sum(CASE WHEN sr<=3 THEN qty END)-CASE WHEN game%7=0 THEN 1000 ELSE 0 END AS oq, sum(CASE WHEN sr<=3 THEN disc END) AS od, sum(CASE WHEN sr<=3 THEN tax END) AS ot,
  cast(sum(CASE WHEN sr<=3 THEN rev END) AS double)/cast(sum(CASE WHEN sr<=3 THEN qty END) AS double) AS op FROM sl GROUP BY 1),
mk AS (SELECT game, unnest(range(0, cast(1<<cast(n AS integer) AS bigint))) AS mask FROM tot WHERE ef+eo>0),
k0 AS (SELECT mk.game, mask FROM mk JOIN tot ON tot.game=mk.game WHERE bit_count(mask)=ef+eo OR (n>6 AND n-6<=4 AND bit_count(mask)=n-6)),
sm AS (SELECT k0.game, mask, count(*) AS k, sum(qty) AS q, sum(disc) AS d, sum(tax) AS t, sum(rev) AS r, count(CASE WHEN slot='F' THEN 1 END) AS xf, count(CASE WHEN slot='O' THEN 1 END) AS xo,
  list(cast(idx AS integer) ORDER BY idx) AS ids FROM k0 JOIN li ON li.game=k0.game AND (mask>>cast(idx-1 AS integer))&1=1 GROUP BY 1,2),
hit AS (SELECT sm.*, CASE WHEN xf=ef AND xo=eo THEN 1 WHEN n>6 AND n-6<=4 AND k=n-6 THEN 2 END AS stage,
  coalesce(abs(cast(tr-r AS double)/nullif(cast(tq-q AS double),0)-op)<=0.01,false) AS strict FROM sm JOIN tot ON tot.game=sm.game WHERE q=tq-oq AND d=td-od AND t=tt-ot),
pk AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY NOT strict, stage, ids) AS rk FROM hit WHERE stage IS NOT NULL),
sol AS (SELECT tot.game, CASE WHEN ef+eo=0 AND n<=6 THEN 'no-excess' WHEN stage IS NULL THEN 'unsolved' WHEN stage=1 THEN 'solved' ELSE 'solved-crossslot' END AS outcome,
  coalesce(array_to_string(ids,','),'') AS excluded, strict FROM tot LEFT JOIN pk ON pk.game=tot.game AND rk=1)
"""


def solved(spark, sf):
    rows = occupants(spark, sf)
    return R.reconcile_capacity(rows, official(rows), GROUP, COUNTS, {"ppu": ("rev", "qty", 0.01)}, CAPS, 6)


@query("capacity_reconcile", CAPACITY + "SELECT * FROM sol")
def capacity_reconcile(spark, sf):
    return solved(spark, sf).withColumn("excluded", F.array_join("excluded", ","))


@query("capacity_outcomes", CAPACITY + "SELECT outcome, count(*) AS n FROM sol GROUP BY 1")
def capacity_outcomes(spark, sf):
    return solved(spark, sf).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))

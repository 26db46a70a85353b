"""The driver tables read as a league.

entity = nation of the customer, member = customer, period = order month
(1995-01 is 1), day line = order.  Money is whole cents and discounts whole
percents, so every component is an exact integer sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestlake.functions.calendars import month_number
from contestlake.functions.rates import cents
from contestlake.operators.metrics import Metric, component_names, densify
from contestlake.session import cut_lineage, step

BASE_YEAR = 1995
PERIODS = 80
AS_OF = 60
US = 7

METRICS = [
    Metric("QTY", "counting", "higher", "qty"),
    Metric("REV", "counting", "higher", "rev"),
    Metric("ORD", "counting", "higher", "ord"),
    Metric("RET", "counting", "lower", "ret"),
    Metric("DISC", "rate", "lower", "dsc", "rev", 1.0, (40000.0, 0.5, 100.0)),
    Metric("PPU", "rate", "higher", "rev", "qty", 0.01, (60.0, 12.0, 3.0)),
]
COMPONENTS = component_names(METRICS)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def order_components(spark: SparkSession, sf: str) -> DataFrame:
    """Component sums per order; the partial sums run before the shuffle."""
    money = cents(F.col("l_extendedprice"))
    pct = F.round(F.col("l_discount") * 100).cast("long")
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("qty"),
        F.sum(money).alias("rev"),
        F.sum(money * pct).alias("dsc"),
        F.sum((F.col("l_returnflag") == "R").cast("long")).alias("ret"),
    )


def day_lines(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: member, date, period, components."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("date"))
    return order_components(spark, sf).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("game"), F.col("o_custkey").alias("member"), "date",
        month_number(F.col("date"), BASE_YEAR).alias("period"),
        "qty", "rev", "dsc", "ret", F.lit(1).cast("long").alias("ord"),
    )


def member_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Components per (member, period), summed before the member join."""
    return step(spark, sf, "member-periods", lambda: day_lines(spark, sf).groupBy("member", "period").agg(
        *[F.sum(c).alias(c) for c in COMPONENTS]))


def members(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("member"), F.col("c_nationkey").alias("entity"),
        F.col("c_mktsegment").alias("role"), F.col("c_name").alias("name"))


def components(spark: SparkSession, sf: str) -> DataFrame:
    """Components per (entity, period) that have facts."""
    return step(spark, sf, "components", lambda: member_periods(spark, sf).join(
        members(spark, sf).select("member", "entity"), "member").groupBy("entity", "period").agg(
        *[F.sum(c).alias(c) for c in COMPONENTS]))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("entity"))


def dense_components(spark: SparkSession, sf: str, last: int = PERIODS) -> DataFrame:
    return densify(components(spark, sf), entities(spark, sf), last, COMPONENTS)


def settled_components(spark: SparkSession, sf: str, last: int = PERIODS) -> DataFrame:
    """The dense components written once, for plans that read them again.

    The table has entities times periods rows, so reading it back is free next
    to a second pass over the facts.
    """
    return cut_lineage(dense_components(spark, sf, last))


SQL_COMPONENTS = """
ol AS (
  SELECT l_orderkey, cast(sum(cast(l_quantity AS bigint)) AS bigint) AS qty,
         cast(sum(cast(round(l_extendedprice*100) AS bigint)) AS bigint) AS rev,
         cast(sum(cast(round(l_extendedprice*100) AS bigint)*cast(round(l_discount*100) AS bigint)) AS bigint) AS dsc,
         cast(sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS bigint) AS ret
  FROM lineitem GROUP BY 1),
dl AS (
  SELECT o_orderkey AS game, o_custkey AS member, cast(o_orderdate AS date) AS date,
         cast((year(o_orderdate)-1995)*12+month(o_orderdate) AS integer) AS period,
         qty, rev, dsc, ret, cast(1 AS bigint) AS ord
  FROM ol JOIN orders ON l_orderkey=o_orderkey),
mp AS (
  SELECT member, period, cast(sum(qty) AS bigint) AS qty, cast(sum(rev) AS bigint) AS rev,
         cast(sum(ord) AS bigint) AS ord, cast(sum(ret) AS bigint) AS ret, cast(sum(dsc) AS bigint) AS dsc
  FROM dl GROUP BY 1,2),
comp AS (
  SELECT c_nationkey AS entity, period, cast(sum(qty) AS bigint) AS qty, cast(sum(rev) AS bigint) AS rev,
         cast(sum(ord) AS bigint) AS ord, cast(sum(ret) AS bigint) AS ret, cast(sum(dsc) AS bigint) AS dsc
  FROM mp JOIN customer ON c_custkey=member GROUP BY 1,2),
dense AS (
  SELECT g.entity, g.period, coalesce(qty,0) AS qty, coalesce(rev,0) AS rev, coalesce(ord,0) AS ord,
         coalesce(ret,0) AS ret, coalesce(dsc,0) AS dsc
  FROM (SELECT n_nationkey AS entity, cast(p AS integer) AS period FROM nation, range(1,81) t(p)) g
  LEFT JOIN comp c ON c.entity=g.entity AND c.period=g.period)
"""


def sql_metrics(source: str, keep: str, suffix: str = "") -> str:
    """SQL twin of ``metric_values`` over a CTE with the component columns."""
    from contestlake.plans.registry import rnd

    parts = []
    for m in METRICS:
        if m.is_rate:
            value = rnd(f"cast({m.num} AS double)*cast({m.scale} AS double)/nullif(cast({m.den} AS double),0)", 4)
        else:
            value = f"cast({m.num} AS double)"
        parts.append(f"SELECT {keep}, '{m.code}' AS metric, '{m.kind}' AS kind, '{m.direction}' AS direction, "
                     f"{value} AS value FROM {source}")
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL"


def sql_points(by: str, value: str = "value") -> str:
    """SQL twin of ``rank_points``."""
    key = f"CASE WHEN direction='lower' THEN {value} ELSE -({value}) END"
    return (f"cast(count(*) OVER (PARTITION BY {by}) AS double) - (rank() OVER (PARTITION BY {by} ORDER BY {key}) - 1)"
            f" - (count(*) OVER (PARTITION BY {by}, {value}) - 1)/2.0")

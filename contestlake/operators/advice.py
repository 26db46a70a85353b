"""Advice ledger: was it followed, what came of it, what would a shadow do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestlake.functions.calendars import Calendar
from contestlake.functions.rates import fixed
from contestlake.operators import joins, ranking
from contestlake.session import cut_lineage


def match_decisions(advice: DataFrame, actions: DataFrame, calendar: Calendar, as_of, before_days: int = 2) -> DataFrame:
    """adopted when an add of the member falls near the period, expired once
    the period has started, else open.

    ``advice``: rec, member, period; ``actions``: member, date, acted_at.
    """
    matched = joins.nearby_actions(advice, actions, calendar.number(F.col("date")), calendar.start, before_days)
    started = calendar.start(F.col("period")) < F.lit(as_of)
    status = F.when(F.col("decided_at").isNotNull(), "adopted").when(started, "expired").otherwise("open")
    return matched.withColumn("status", status)


def produced(k: Column, qs: Column, w: Column, sv: Column, hr: Column, sb: Column) -> Column:
    return k + 2 * (qs + w) + 2 * sv + 0.5 * (hr + sb)


def score_outcomes(advice: DataFrame, production: DataFrame, calendar: Calendar, as_of, horizon: int = 1,
                   good: float = 12.0, poor: float = 3.0) -> DataFrame:
    """Score of every decided piece of advice whose horizon has closed.

    ``production``: member, period, made.  The horizon counts periods from the
    advised one; a period is closed when its calendar end has passed.
    """
    closed = calendar.end(F.col("period") + horizon - 1) < F.lit(as_of)
    due = advice.where(F.col("status").isin("adopted", "expired", "declined") & closed)
    spans = due.select("rec", "member", F.explode(F.sequence("period", F.col("period") + horizon - 1)).alias("period"))
    made = spans.join(production, ["member", "period"], "left").groupBy("rec").agg(F.sum(F.coalesce("made", F.lit(0.0))).alias("made"))
    followed = (F.col("status") == "adopted").cast("double")
    score = F.least(F.lit(1.0), F.col("made") / good) * followed - F.when(
        (followed == 1) & (F.col("made") < poor), 0.3).otherwise(0.0)
    return due.select("rec", "member", "period", "status").join(made, "rec").withColumn("score", fixed(score, 2))


def shadow_portfolio(start: DataFrame, adds: DataFrame, periods: list[int]) -> DataFrame:
    """Rosters that follow every add, dropping the weakest original member.

    ``start``: entity, member, quality; ``adds``: entity, member, period.  The
    loop runs over the calendar, all entities move together; only original
    members have a quality, so an added one is never dropped again.
    """
    roster, out = start.select("entity", "member", "quality"), []
    adds = adds.distinct()
    for p in periods:
        new = adds.where(F.col("period") == p).select("entity", "member").join(roster, ["entity", "member"], "left_anti")
        wanted = new.groupBy("entity").agg(F.count(F.lit(1)).alias("wanted"))
        weak = ranking.row_rank(roster.where(F.col("quality").isNotNull()), ["entity"], [F.asc("quality"), F.asc("member")], "weak")
        gone = weak.join(wanted, "entity").where(F.col("weak") <= F.col("wanted")).select("entity", "member")
        kept = roster.join(gone, ["entity", "member"], "left_anti")
        roster = cut_lineage(kept.unionByName(new.withColumn("quality", F.lit(None).cast("double"))))
        out.append(roster.select("entity", "member", F.lit(p).alias("period")))
    return reduce(lambda a, b: a.unionByName(b), out)


def score_portfolio(rosters: DataFrame, production: DataFrame, stats: list[str]) -> DataFrame:
    joined = rosters.join(production, ["member", "period"], "left")
    return joined.groupBy("entity", "period").agg(
        F.count_distinct("member").alias("members"), *[F.sum(F.coalesce(F.col(s), F.lit(0))).alias(s) for s in stats])

"""Small report tables composed from the other operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlake.functions.rates import fixed, ratio
from contestlake.operators import ranking
from contestlake.session import spread


def labelled(sections: dict[str, DataFrame]) -> DataFrame:
    """Sections of (key, value) rows stacked into one table."""
    rows = [df.select(F.lit(name).alias("section"), F.col("key").cast("string").alias("key"),
                      F.col("value").cast("double").alias("value")) for name, df in sections.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


def report_lines(rows: DataFrame, by: list[str], order: list[Column], line: Column, k: int) -> DataFrame:
    """The first k lines of each section, numbered."""
    return ranking.top_k(rows, by, order, k, "line_no").select(*by, "line_no", line.alias("line"))


def roster_extract(members: DataFrame, signals: DataFrame, starts: DataFrame) -> DataFrame:
    """Members with their distinct signal kinds and starts.

    Each side is aggregated before it is joined, so neither multiplies the
    other.
    """
    kinds = signals.groupBy("member").agg(F.count_distinct("kind").alias("signals"))
    count = starts.groupBy("member").agg(F.count(F.lit(1)).alias("starts"))
    out = members.join(kinds, "member", "left").join(count, "member", "left")
    return out.select(*members.columns, F.coalesce("signals", F.lit(0)).alias("signals"), F.coalesce("starts", F.lit(0)).alias("starts"))


def rolling_error(errors: DataFrame, periods: int = 4, unit: float = 1e-4) -> DataFrame:
    """Error per source and stat, and its mean over the trailing periods.

    ``errors``: stat, period, n, total (sum of absolute errors in whole units
    of ``unit``, so the sum does not depend on its order).
    """
    w = Window.partitionBy("stat").orderBy("period").rangeBetween(-(periods - 1), 0)
    return errors.select(
        "stat", "period", "n", fixed(ratio(F.col("total"), F.col("n"), unit), 4).alias("mae"),
        fixed(ratio(F.sum("total").over(w), F.sum("n").over(w), unit), 4).alias("rolling_mae"))


def claim_chance(needs: DataFrame, pushy: DataFrame, order: DataFrame, offers: DataFrame) -> DataFrame:
    """Chance that each rival claims a member first.

    A rival's weight is need for the member's metrics times past claims over
    its place in the claim order, normalised per member.  ``needs``: entity,
    metric, weight; ``pushy``: entity, claims; ``order``: entity, place;
    ``offers``: member, metric.  The three tables of entities are boards; the
    offers grow, so they lie by member and the boards come to them.
    """
    offers = spread(offers.where("member is not null"), "member")
    wants = offers.join(F.broadcast(needs), "metric").groupBy("member", "entity").agg(F.sum("weight").alias("need"))
    rows = wants.join(F.broadcast(pushy.join(order, "entity")), "entity")
    rows = rows.withColumn("score", F.col("need") * F.col("claims") / F.col("place"))
    total = F.sum("score").over(Window.partitionBy("member"))  # at most a row per entity
    return rows.withColumn("total", total).select("member", "entity", fixed(ratio(F.col("score"), F.col("total")), 6).alias("chance"))


def acted_first(events: DataFrame, actions: DataFrame, alert_minutes: int, within_days: int) -> DataFrame:
    """Did a rival act on an event before our alert would have reached us?

    The first rival action after each event decides, so one row per event is
    kept: event and action times are put on one line per member and the next
    action is carried back.
    """
    from contestlake.operators import scan

    line = events.select("member", "uid", F.col("ts").alias("at"), F.lit(0).alias("step")).unionByName(
        actions.groupBy("member", "ts").agg(F.min("uid").alias("uid")).select("member", "uid", F.col("ts").alias("at"), F.lit(1).alias("step")))
    line = line.withColumn("act", F.when(F.col("step") == 1, F.col("at"))).withColumn("age", -F.unix_micros(F.col("at").cast("timestamp")))
    back = scan.fill_forward(line.withColumn("order_step", -F.col("step")), ["member"], ["age", "order_step", "uid"],
                             -F.datediff(F.col("at").cast("date"), F.lit("1970-01-01").cast("date")), {"act": "next_act"})
    wait = F.timestamp_diff("MINUTE", F.col("at"), F.col("next_act"))
    rows = back.where(F.col("step") == 0).select("uid", "member", F.when(wait <= within_days * 1440, wait).alias("minutes"))
    return rows.withColumn("beaten", F.coalesce(F.col("minutes") < alert_minutes, F.lit(False)))

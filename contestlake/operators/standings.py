"""Standings, race projection, marginal curves and backtests.

Input everywhere: ``components``, one row per (entity, period) with the
component sums, complete over the calendar (see ``metrics.densify``).  These
tables have the size of entity dimension times calendar, whatever the facts
weigh, so plain windows over them are safe.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlake.functions.rates import fixed, ratio
from contestlake.operators import ranking
from contestlake.operators.metrics import Metric, component_names, metric_values, value_of

FORM_WEIGHT = 0.35
FORM_PERIODS = 4
MODEL_WEIGHTS = {"baseline": 0.0, "form": 1.0, "blend": 0.35}


def period_values(components: DataFrame, metrics: list[Metric]) -> DataFrame:
    return metric_values(components, ["entity", "period"], metrics)


def cumulative_components(components: DataFrame, metrics: list[Metric]) -> DataFrame:
    """Expanding sums through every period."""
    w = Window.partitionBy("entity").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(c).over(w).alias(c) for c in component_names(metrics)]
    return components.select("entity", "period", *sums)


def board(values: DataFrame, by: list[str]) -> DataFrame:
    """Tie-shared points of every metric board."""
    return ranking.rank_points(values, [*by, "metric"], "value", F.col("direction"))


def totals(points: DataFrame, by: list[str], column: str = "points") -> DataFrame:
    """Summed points per entity and their row-order rank."""
    summed = points.groupBy(*by, "entity").agg(F.sum(column).alias("total"))
    return ranking.row_rank(summed, by, [F.desc("total"), F.asc("entity")])


def cumulative_board(components: DataFrame, metrics: list[Metric]) -> DataFrame:
    values = metric_values(cumulative_components(components, metrics), ["entity", "period"], metrics)
    return board(values, ["period"])


def cumulative_standings(components: DataFrame, metrics: list[Metric]) -> DataFrame:
    """Standings after every period."""
    return totals(cumulative_board(components, metrics), ["period"])


def rate_inputs(components: DataFrame, names: list[str], as_of: int, recent: int = FORM_PERIODS) -> DataFrame:
    """Per entity: sums to date (``x_ytd``) and mean of the last periods (``x_recent``)."""
    aggs = []
    for c in names:
        aggs.append(F.sum(c).alias(f"{c}_ytd"))
        aggs.append((F.sum(F.when(F.col("period") > as_of - recent, F.col(c)).otherwise(0)) / recent).alias(f"{c}_recent"))
    return components.where(F.col("period") <= as_of).groupBy("entity").agg(*aggs)


def _weekly(c: str, played: Column, weight: Column) -> Column:
    return weight * F.col(f"{c}_recent") + (1 - weight) * F.col(f"{c}_ytd") / played


def _projected(m: Metric, played: Column, left: Column, weight: Column, places: int) -> tuple[Column, Column]:
    """Projected final value and final denominator of one metric."""
    num = F.col(f"{m.num}_ytd") + _weekly(m.num, played, weight) * left
    if not m.is_rate:
        return fixed(num, places), F.lit(None).cast("double")
    den = F.col(f"{m.den}_ytd") + _weekly(m.den, played, weight) * left
    return fixed(ratio(num, den, m.scale), places), den


def _project(inputs: DataFrame, keep: list[str], metrics: list[Metric], played: Column, left: Column,
             weight: Column, places: int = 4) -> DataFrame:
    rows = []
    for m in metrics:
        value, den = _projected(m, played, left, weight, places)
        now = value_of(m, F.col(f"{m.num}_ytd"), F.col(f"{m.den}_ytd") if m.den else None, places)
        rows.append(F.struct(
            F.lit(m.code).alias("metric"), F.lit(m.kind).alias("kind"), F.lit(m.direction).alias("direction"),
            now.alias("ytd_value"), value.alias("proj_value"), den.alias("den_final"),
        ))
    return inputs.select(*keep, F.inline(F.array(*rows))).where(F.col("proj_value").isNotNull())


def project_race(components: DataFrame, metrics: list[Metric], as_of: int, final: int,
                 weight: float = FORM_WEIGHT, recent: int = FORM_PERIODS) -> DataFrame:
    """Blend of recent form and season pace to the final period, with points.

    Rates are rebuilt from projected components; the ratio is taken last.
    """
    inputs = rate_inputs(components, component_names(metrics), as_of, recent)
    proj = _project(inputs, ["entity"], metrics, F.lit(as_of), F.lit(final - as_of), F.lit(weight))
    proj = ranking.rank_points(proj, ["metric"], "ytd_value", F.col("direction"), "ytd_points")
    return ranking.rank_points(proj, ["metric"], "proj_value", F.col("direction"), "proj_points")


def _swap_columns(metrics: list[Metric]) -> Column:
    """Rate moved by one slot, as a function of metric code and denominator."""
    pieces = [
        (m.code, ratio(F.lit(m.swap[0] * m.swap[1] * m.swap[2]), F.col("den_final")))
        for m in metrics if m.swap
    ]
    return reduce(lambda acc, p: F.when(F.col("metric") == p[0], p[1]).otherwise(acc), pieces, F.lit(None).cast("double"))


def marginal_curve(projected: DataFrame, us, metrics: list[Metric], keep: int = 4) -> DataFrame:
    """For "us": every entity above, nearest first — gap, points gained, swaps."""
    mine = projected.where(F.col("entity") == us).select(
        "metric", F.col("proj_value").alias("our_value"), F.col("proj_points").alias("our_points"),
        _swap_columns(metrics).alias("impact"),
    )
    above = projected.join(mine, "metric").where(F.col("proj_points") > F.col("our_points"))
    gap = F.abs(F.col("proj_value") - F.col("our_value"))
    rows = above.select(
        "metric", F.col("entity").alias("passes"), fixed(gap, 4).alias("units_needed"),
        fixed(ratio(gap, F.col("impact")), 1).alias("swaps"),
        (F.col("proj_points") - F.col("our_points")).alias("points_gain"),
    )
    return ranking.top_k(rows, ["metric"], [F.asc("units_needed"), F.asc("passes")], keep, "step")


def cushion(projected: DataFrame, us, metrics: list[Metric]) -> DataFrame:
    """Distance to the next entity below us, in swaps where a swap is defined."""
    gaps = ranking.neighbour_gaps(projected, ["metric"], "proj_value", F.col("direction"), "proj_points")
    mine = gaps.where(F.col("entity") == us).withColumn("impact", _swap_columns(metrics))
    return mine.select(
        "metric", "proj_value", "proj_points", fixed(F.col("cushion"), 4).alias("cushion"),
        fixed(ratio(F.col("cushion"), F.col("impact")), 2).alias("cushion_swaps"),
    )


# --- backtests -------------------------------------------------------------


def missing_periods(components: DataFrame, entities: DataFrame, last: int) -> DataFrame:
    """Expected (entity, period) pairs that carry no facts."""
    grid = entities.select("entity", F.explode(F.sequence(F.lit(1), F.lit(last))).alias("period"))
    return grid.join(components.select("entity", "period"), ["entity", "period"], "left_anti")


def backtest(components: DataFrame, metrics: list[Metric], stands: list[int], horizon: int,
             models: dict[str, float] = MODEL_WEIGHTS, recent: int = FORM_PERIODS) -> DataFrame:
    """Projection at each stand and model against what happened by the horizon.

    All stands and models are one job: a stand is a row of the running table,
    a model is a weight column.
    """
    names = component_names(metrics)
    so_far = Window.partitionBy("entity").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    trail = Window.partitionBy("entity").orderBy("period").rowsBetween(-(recent - 1), 0)
    running = components.select(
        "entity", "period",
        *[F.sum(c).over(so_far).alias(f"{c}_ytd") for c in names],
        *[(F.sum(c).over(trail) / recent).alias(f"{c}_recent") for c in names],
    )
    weights = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(float(w)).alias("weight")) for m, w in models.items()
    ]))
    at = running.where(F.col("period").isin(*stands)).withColumnRenamed("period", "stand").withColumn("m", weights)
    at = at.withColumn("model", F.col("m.model")).withColumn("weight", F.col("m.weight"))
    proj = _project(at, ["entity", "stand", "model"], metrics, F.col("stand"),
                    F.lit(horizon) - F.col("stand"), F.col("weight"))
    proj = ranking.rank_points(proj, ["stand", "model", "metric"], "proj_value", F.col("direction"), "pred_points")
    truth = metric_values(
        running.where(F.col("period") == horizon).select("entity", *[F.col(f"{c}_ytd").alias(c) for c in names]),
        ["entity"], metrics,
    )
    truth = ranking.rank_points(truth, ["metric"], "value", F.col("direction"), "actual_points")
    return proj.join(truth.select("entity", "metric", F.col("value").alias("actual_value"), "actual_points"),
                     ["entity", "metric"])


def backtest_score(results: DataFrame) -> DataFrame:
    """Mean absolute error of points per metric."""
    err = F.abs(F.col("pred_points") - F.col("actual_points"))
    return results.groupBy("stand", "model", "metric").agg(fixed(F.avg(err), 4).alias("points_mae"))


def rank_displacement(results: DataFrame) -> DataFrame:
    """Mean distance between projected and realised total ranks."""
    both = results.groupBy("stand", "model", "entity").agg(
        F.sum("pred_points").alias("pred"), F.sum("actual_points").alias("actual"))
    by = ["stand", "model"]
    ranked = ranking.row_rank(both, by, [F.desc("pred"), F.asc("entity")], "pred_rank")
    ranked = ranking.row_rank(ranked, by, [F.desc("actual"), F.asc("entity")], "actual_rank")
    return ranked.groupBy(*by).agg(
        fixed(F.avg(F.abs(F.col("pred_rank") - F.col("actual_rank"))), 4).alias("displacement"),
        fixed(F.avg(F.abs(F.col("pred") - F.col("actual"))), 4).alias("total_mae"),
    )


def model_ledger(scores: DataFrame) -> DataFrame:
    """Summed error per model and stand with the change from the stand before."""
    total = scores.groupBy("model", "stand").agg(fixed(F.sum("points_mae"), 4).alias("mae"))
    w = Window.partitionBy("model").orderBy("stand")
    return total.withColumn("delta", fixed(F.col("mae") - F.lag("mae").over(w), 4))


# --- rivals ----------------------------------------------------------------


def needs_surplus(projected: DataFrame, norms: DataFrame, metrics: list[Metric],
                  chase=(0.25, 1.2), surplus=(0.22, 2.0)) -> DataFrame:
    """Which metrics an entity is chasing and where it has room to give.

    ``norms`` holds the typical remaining production per counting metric; rate
    metrics are measured in swaps.  Pairs are (counting, rate) thresholds.
    """
    gaps = ranking.neighbour_gaps(projected, ["metric"], "proj_value", F.col("direction"), "proj_points")
    rate = F.col("kind") == "rate"
    scaled = gaps.join(norms, "metric", "left").withColumn(
        "unit", F.when(rate, _swap_columns(metrics)).otherwise(F.col("norm")))
    effort, slack = ratio(F.col("gap_up"), F.col("unit")), ratio(F.col("cushion"), F.col("unit"))
    chasing = (F.col("points_up") > 0) & (effort < F.when(rate, chase[1]).otherwise(chase[0]))
    spare = slack > F.when(rate, surplus[1]).otherwise(surplus[0])
    return scaled.select(
        "entity", "metric",
        F.coalesce(chasing, F.lit(False)).alias("chasing"), F.coalesce(spare, F.lit(False)).alias("surplus"),
        fixed(effort, 3).alias("effort"), fixed(slack, 3).alias("slack"), F.col("points_up"),
    )


def complementarity(profiles: DataFrame, us) -> DataFrame:
    """Points in play with each rival: what they can give and what they want."""
    mine = profiles.where(F.col("entity") == us).select(
        "metric", F.col("chasing").alias("we_chase"), F.col("surplus").alias("we_spare"),
        F.col("points_up").alias("our_gain"))
    both = profiles.where(F.col("entity") != us).join(mine, "metric")
    give = F.col("surplus") & F.col("we_chase")
    want = F.col("chasing") & F.col("we_spare")
    scored = both.groupBy("entity").agg(
        F.sum(F.when(give, F.col("our_gain")).otherwise(0.0) + F.when(want, F.col("points_up")).otherwise(0.0)).alias("score"),
        F.sum(give.cast("long")).alias("can_give"), F.sum(want.cast("long")).alias("wants"),
    )
    return scored.where((F.col("can_give") > 0) | (F.col("wants") > 0))

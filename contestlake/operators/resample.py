"""Correlation of metrics and rank distributions by resampling.

Random numbers come from a hash of (seed, draw, entity, metric, stream), so a
draw is the same under any partitioning and on any retry after a lost
executor.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestlake.functions import texts
from contestlake.functions.rates import fixed
from contestlake.operators import ranking, scan
from contestlake.operators.metrics import Metric, component_names
from contestlake.session import cut_lineage


DRAW_BLOCK = 1000
RIDGE = 1.000001


def sample_sd(n: Column, total: Column, squares: Column) -> Column:
    """Sample standard deviation from moments; zero below two rows."""
    spread = (n * squares - total * total) / (n * (n - 1))
    return F.when(n < 2, 0.0).otherwise(F.sqrt(F.greatest(spread, F.lit(0.0))))


def history_spread(values: DataFrame) -> DataFrame:
    """Mean and standard deviation of an entity's history per metric."""
    n, s1, s2 = F.col("n"), F.col("s1"), F.col("s2")
    moments = values.groupBy("entity", "metric").agg(
        F.count("value").cast("double").alias("n"), F.sum("value").alias("s1"),
        F.sum(F.col("value") * F.col("value")).alias("s2"))
    return moments.select("entity", "metric", "n", (s1 / n).alias("mean"), sample_sd(n, s1, s2).alias("sd"))


def zscores(values: DataFrame) -> DataFrame:
    """Value against its own (entity, metric) history; a constant history is 0."""
    z = F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    return values.join(history_spread(values), ["entity", "metric"]).withColumn("z", z)


def metric_correlation(values: DataFrame, metrics: list[str]) -> DataFrame:
    """Pooled correlation of z-scores over complete (entity, period) vectors.

    Vectors are pivoted to one row, so the metric pairs of a row are products
    of its own columns and nothing is joined to itself.
    """
    z = zscores(values).groupBy("entity", "period").pivot("metric", metrics).agg(F.first("z"))
    whole = z.dropna(subset=metrics)
    pairs = F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
        for a in metrics for b in metrics
    ]))
    x, y = F.col("x"), F.col("y")
    sums = whole.select(pairs).groupBy("a", "b").agg(
        F.sum(x * y).alias("s"), F.sum(x * x).alias("sx"), F.sum(y * y).alias("sy"), F.count(F.lit(1)).alias("n"))
    ridge = F.when(F.col("a") == F.col("b"), RIDGE)
    size = F.sqrt(F.col("sx") * F.col("sy"))
    scaled = F.when(size > 0, F.col("s") / size).otherwise(0.0)
    return sums.select("a", "b", F.coalesce(ridge, F.col("s") / (F.col("n") - 1)).alias("r"),
                       F.coalesce(ridge, scaled).alias("scaled"))


def factor(correlation: DataFrame, metrics: list[str]) -> list[list[float]]:
    """Lower triangular factor of the metric-by-metric correlation matrix.

    Only this k by k table comes to the driver; it is a job parameter.  When
    few vectors are complete, ``r`` need not be positive definite; then the
    factor is taken of ``scaled``, which always is.
    """
    import numpy as np

    rows = correlation.collect()

    def lower(column):
        cells = {(c["a"], c["b"]): c[column] for c in rows}
        return np.linalg.cholesky(np.array([[cells.get((a, b), RIDGE if a == b else 0.0) for b in metrics] for a in metrics]))

    try:
        return lower("r").tolist()
    except np.linalg.LinAlgError:
        return lower("scaled").tolist()


def uniform(digest: Column, start: int) -> Column:
    """Number in (0, 1) from 13 hex digits of a digest."""
    return (F.conv(F.substring(digest, start, 13), 16, 10).cast("double") + 0.5) / 2.0**52


def normal(*parts: Column) -> Column:
    """Standard normal by Box-Muller; both uniforms come from one hash of the parts."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.sqrt(-2.0 * F.log(uniform(digest, 1))) * F.cos(2.0 * math.pi * uniform(digest, 17))


def draw_params(components: DataFrame, projected: DataFrame, metrics: list[Metric], as_of: int, left: int,
                recent: int = 4) -> DataFrame:
    """Means and spreads of the remaining season per (entity, metric)."""
    past = components.where(F.col("period") <= as_of)
    aggs = []
    for c in component_names(metrics):
        x = F.col(c).cast("double")
        s1, s2, n = F.sum(x), F.sum(x * x), F.count(x).cast("double")
        late = F.sum(F.when(F.col("period") > as_of - recent, x).otherwise(0.0)) / recent
        aggs += [s1.alias(f"{c}_ytd"), (late * left).alias(f"{c}_mean"),
                 (sample_sd(n, s1, s2) * math.sqrt(left)).alias(f"{c}_sd")]
    stats = past.groupBy("entity").agg(*aggs)
    none = F.lit(None).cast("double")
    rows = F.inline(F.array(*[
        F.struct(
            F.lit(m.code).alias("metric"), F.col(f"{m.num}_ytd").alias("ytd"),
            (none if m.is_rate else F.col(f"{m.num}_sd")).alias("sd"),
            (F.lit(m.scale) if m.is_rate else none).alias("scale"),
            (F.col(f"{m.den}_ytd") if m.is_rate else none).alias("den_ytd"),
            F.col(f"{m.num}_mean").alias("num_mean"), F.col(f"{m.num}_sd").alias("num_sd"),
            (F.col(f"{m.den}_mean") if m.is_rate else none).alias("den_mean"),
            (F.col(f"{m.den}_sd") if m.is_rate else none).alias("den_sd"),
        ) for m in metrics
    ]))
    means = projected.select("entity", "metric", "direction", F.col("proj_value").alias("mean"))
    return stats.select("entity", rows).join(means, ["entity", "metric"])


def rank_draws(params: DataFrame, metrics: list[str], lower: list[list[float]], draws: int, seed: int,
               floor_at_ytd: bool = False) -> DataFrame:
    """Total points and finishing rank of every entity in every draw.

    ``params`` comes from :func:`draw_params`; ``lower`` from :func:`factor`.
    The correlated shock moves counts and rate numerators, a shock of its own
    moves the denominator.
    """
    order = F.create_map(*[x for i, m in enumerate(metrics) for x in (F.lit(m), F.lit(i))])
    cols = [c for c in params.columns if c != "entity"]
    packed = params.groupBy("entity").agg(
        F.array_sort(F.collect_list(F.struct(order[F.col("metric")].alias("i"), *cols))).alias("p"))
    # Draws come in blocks so their number, not the entity count, sets the parallelism.
    last = (draws - 1) // DRAW_BLOCK
    blocks = packed.select("entity", "p", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block"))
    if last:
        blocks = blocks.repartition("block", "entity")
    first = F.col("block") * DRAW_BLOCK
    stop = F.least(first + DRAW_BLOCK - 1, F.lit(draws - 1))
    rows = blocks.select("entity", "p", F.explode(F.sequence(first, stop)).alias("draw"))
    shocks = rows.withColumn("z", F.array(*[
        normal(F.lit(seed), F.col("draw"), F.col("entity"), F.lit(m)) for m in metrics]))
    cells = F.inline(F.array(*[_cell(i, m, lower, seed, floor_at_ytd) for i, m in enumerate(metrics)]))
    # One shuffle by draw serves the boards, the totals and the ranks.
    values = shocks.select("draw", "entity", cells).repartition("draw")
    points = ranking.rank_points(values, ["draw", "metric"], "value", F.col("direction"))
    totals = points.groupBy("draw", "entity").agg(F.sum("points").alias("total"))
    return ranking.row_rank(totals, ["draw"], [F.desc("total"), F.asc("entity")], "place")


def _cell(i: int, metric: str, lower, seed: int, floor_at_ytd: bool) -> Column:
    """One metric of one draw as (metric, direction, value)."""
    p = F.col("p")[i]
    shock = sum((F.col("z")[m] * float(lower[i][m]) for m in range(i + 1)), F.lit(0.0))
    own = normal(F.lit(seed), F.col("draw"), F.col("entity"), F.lit(metric), F.lit("den"))
    num = F.greatest(F.lit(0.0), p["num_mean"] + p["num_sd"] * shock)
    den = F.greatest(F.lit(1.0), p["den_mean"] + p["den_sd"] * own)
    rate = (p["mean"] * p["den_ytd"] + num * p["scale"]) / (p["den_ytd"] + den)
    count = p["mean"] + p["sd"] * shock
    if floor_at_ytd:
        count = F.greatest(count, p["ytd"])
    value = F.when(p["scale"].isNotNull(), rate).otherwise(count)
    return F.struct(F.lit(metric).alias("metric"), p["direction"].alias("direction"), fixed(value, 4).alias("value"))


def rank_pmf(draws: DataFrame, n: int) -> DataFrame:
    """Probability of each finishing rank."""
    return draws.groupBy("entity", "place").agg((F.count(F.lit(1)) / n).alias("p"))


def nearest_rank(counts: DataFrame, by: list[str], value: str, shares: list[float], names: list[str],
                 chunk: Column | None = None) -> DataFrame:
    """Nearest-rank percentiles from counts per value.

    ``counts`` has (by..., value, count): the running count over distinct
    values finds the row a sorted list would have at ``floor(p * n)``.  Give a
    ``chunk`` of the value when a group can have very many distinct values.
    """
    chunk = F.lit(0) if chunk is None else chunk
    run = scan.running_sum(counts, by, [value], chunk, {"count": "upto"})
    run = run.join(counts.groupBy(*by).agg(F.sum("count").alias("n")), by)
    aggs = []
    for p, name in zip(shares, names):
        target = F.least(F.floor(F.lit(p) * F.col("n")) + 1, F.col("n"))
        aggs.append(F.min(F.when(F.col("upto") >= target, F.col(value))).alias(name))
    return run.groupBy(*by).agg(*aggs)


def rank_distribution(draws: DataFrame, n: int, paid: int = 5) -> DataFrame:
    """Chance to win and to be paid, mean rank and rank percentiles.

    ``rank_best10`` is the good tail: rank one is best.
    """
    # Entities by places: small, and read several times below.
    counts = cut_lineage(draws.groupBy("entity", "place").agg(F.count(F.lit(1)).alias("count")))
    summary = counts.groupBy("entity").agg(
        (F.sum(F.when(F.col("place") == 1, F.col("count")).otherwise(0)) / n).alias("p_win"),
        (F.sum(F.when(F.col("place") <= paid, F.col("count")).otherwise(0)) / n).alias("p_paid"),
        fixed(F.sum(F.col("place") * F.col("count")) / n, 4).alias("mean_rank"))
    tails = nearest_rank(counts, ["entity"], "place", [0.1, 0.5, 0.9], ["rank_best10", "rank_p50", "rank_worst10"])
    return summary.join(tails, "entity")


def outcome_buckets(pmf: DataFrame, entities: int, paid: int = 5) -> DataFrame:
    """Win, money, just outside, back half; the split follows the payout line."""
    edge = min(entities, paid + 4)
    r, p = F.col("place"), F.col("p")

    def mass(lo, hi, name):
        return fixed(F.sum(F.when(r.between(lo, hi), p).otherwise(0.0)), 6).alias(name)

    return pmf.groupBy("entity").agg(
        mass(1, 1, "win"), mass(2, paid, "money"), mass(paid + 1, edge, "outside"),
        mass(edge + 1, entities, "back"))


def finish_lines(distribution: DataFrame) -> DataFrame:
    """One line of text per entity: median finish with its band."""
    text = texts.finish_range(F.col("rank_best10"), F.col("rank_p50"), F.col("rank_worst10"))
    return distribution.select("entity", text.alias("line"))

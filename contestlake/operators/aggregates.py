"""Aggregations that are more than one built-in call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestlake.functions.rates import fixed, ratio, whole_units


def accuracy_bucket(ours: Column, official: Column, tolerance: Column) -> Column:
    """match, close (within tolerance) or miss; nothing derived is a miss."""
    diff = F.abs(ours - official)
    return F.when(ours.isNull(), "miss").when(diff < 1e-9, "match").when(diff <= tolerance, "close").otherwise("miss")


def accuracy(derived: DataFrame, official: DataFrame, tolerance: dict[str, float], default: float = 0.5) -> DataFrame:
    """Per metric: how many official values our own numbers reproduce."""
    tol = F.create_map(*[x for k, v in tolerance.items() for x in (F.lit(k), F.lit(float(v)))])
    limit = F.coalesce(F.try_element_at(tol, F.col("metric")), F.lit(default))
    joined = official.select("entity", "period", "metric", F.col("value").alias("official")).join(
        derived.select("entity", "period", "metric", F.col("value").alias("ours")), ["entity", "period", "metric"], "left")
    marked = joined.withColumn("bucket", accuracy_bucket(F.col("ours"), F.col("official"), limit))
    counts = [F.sum((F.col("bucket") == b).cast("long")).alias(b) for b in ("match", "close", "miss")]
    return marked.groupBy("metric").agg(*counts)


def group_mean_with_fallback(rows: DataFrame, group: str, side: str, stats: list[str], thin: int = 15) -> DataFrame:
    """Mean per group; a group with fewer than ``thin`` rows takes its side's mean."""
    sums = rows.groupBy(side, group).agg(F.count(F.lit(1)).alias("n"), *[F.sum(s).alias(f"t_{s}") for s in stats])
    sides = sums.groupBy(side).agg(F.sum("n").alias("side_n"), *[F.sum(f"t_{s}").alias(f"side_{s}") for s in stats])
    own = F.col("n") >= thin
    means = [F.when(own, ratio(F.col(f"t_{s}"), F.col("n"))).otherwise(ratio(F.col(f"side_{s}"), F.col("side_n"))).alias(f"mu_{s}")
             for s in stats]
    return sums.join(sides, side).select(side, group, "n", *means)


def ratio_to_mean(rows: DataFrame, key: str, value: str, at_least: int) -> DataFrame:
    """Mean per key over the mean of keys, keys with enough rows only."""
    means = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).where(F.col("n") >= at_least)
    overall = means.agg(F.avg("mean")).scalar()
    return means.select(
        key, "n", fixed(F.col("mean"), 4).alias("mean"), fixed(ratio(F.col("mean"), overall), 4).alias("factor"))


def ledger(events: DataFrame, key: str, fee: str) -> DataFrame:
    """Count and fees per entity, from unexploded events so a fee counts once."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("events"), F.sum(fee).alias("fees"))


def funnel(rows: DataFrame, status: str, score: str) -> DataFrame:
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"), fixed(F.avg(score), 4).alias("mean_score"))


def duplicate_keys(rows: DataFrame, key: list[str], ident: str) -> DataFrame:
    """Keys claimed by more than one id.

    Ids are counted and the smallest and largest kept; a hot key is two
    partial aggregates and never one long list.
    """
    ids = rows.select(*key, ident).distinct()
    return ids.groupBy(*key).agg(
        F.count(F.lit(1)).alias("ids"), F.min(ident).alias("first_id"), F.max(ident).alias("last_id")
    ).where(F.col("ids") > 1)


def source_error(projected: DataFrame, realised: DataFrame, keys: list[str], stat: str) -> DataFrame:
    """Mean absolute error of a source's projection against what happened."""
    joined = projected.join(realised, keys, "left")
    err = F.abs(F.col("projected") - F.coalesce(F.col("realised"), F.lit(0.0)))
    n = F.count(F.lit(1))
    return joined.groupBy(stat).agg(n.alias("n"), fixed(ratio(F.sum(whole_units(err, 4)), n, 1e-4), 4).alias("mae"))


def profile_table(df: DataFrame, name: str) -> DataFrame:
    """Catalog rows of one table: type, non-null count and distinct estimate."""
    aggs = [F.struct(
        F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"),
        F.count(F.lit(1)).alias("row_count"), F.count(f.name).alias("non_null"),
        F.approx_count_distinct(f.name).alias("distinct_estimate"),
    ) for f in df.schema.fields]
    return df.agg(F.array(*aggs).alias("c")).select(F.inline("c"))

"""Scoring metrics: from component sums to values, never from averaged rates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestlake.functions.rates import fixed, ratio


@dataclass(frozen=True)
class Metric:
    """One scoring category.

    Counting metrics sum ``num``; rate metrics are ``scale * num / den``.
    ``swap`` is the rate moved by one roster slot: volume, edge and factor.
    """

    code: str
    kind: str
    direction: str
    num: str
    den: str | None = None
    scale: float = 1.0
    swap: tuple[float, float, float] | None = None

    @property
    def is_rate(self) -> bool:
        return self.kind == "rate"


def component_names(metrics: list[Metric]) -> list[str]:
    """Every component the metrics need, once, in order of first use."""
    return list(dict.fromkeys(c for m in metrics for c in (m.num, m.den) if c))


def sum_components(df: DataFrame, by: list[str], components: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in components])


def value_of(m: Metric, num: Column, den: Column | None, places: int = 4) -> Column:
    return fixed(ratio(num, den, m.scale), places) if m.is_rate else num.cast("double")


def metric_values(df: DataFrame, keep: list[str], metrics: list[Metric], places: int = 4) -> DataFrame:
    """Wide components → one row per metric with its value."""
    rows = F.array(*[
        F.struct(
            F.lit(m.code).alias("metric"), F.lit(m.kind).alias("kind"),
            F.lit(m.direction).alias("direction"),
            value_of(m, F.col(m.num), F.col(m.den) if m.den else None, places).alias("value"),
        )
        for m in metrics
    ])
    return df.select(*keep, F.inline(rows)).where(F.col("value").isNotNull())


def densify(df: DataFrame, entities: DataFrame, periods: int, components: list[str]) -> DataFrame:
    """One row per entity and period 1..periods; missing periods count zero.

    The frame is generated per entity, so it grows with the entity dimension
    times the calendar and not with the facts.
    """
    grid = entities.select("entity", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("period"))
    filled = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in components]
    return grid.join(df, ["entity", "period"], "left").select("entity", "period", *filled)

"""Ranks, tie-shared points, top-k and neighbour gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlake.operators import scan


def _best_first(value: str, direction: Column) -> Column:
    return F.when(direction == "lower", F.col(value)).otherwise(-F.col(value))


def rank_points(df: DataFrame, by: list[str], value: str, direction: Column,
                points: str = "points") -> DataFrame:
    """Best of n gets n points; tied entities share the mean of their places.

    Meant for boards of entities, whose number is a dimension's size.  Use
    :func:`rank_points_wide` when the ranked things are members.
    """
    key = "__key"
    board = Window.partitionBy(*by)
    tied = Window.partitionBy(*by, value)
    out = df.withColumn(key, _best_first(value, direction))
    place = F.rank().over(board.orderBy(key)) - 1
    shared = (F.count(F.lit(1)).over(tied) - 1) / 2
    return out.withColumn(points, F.count(F.lit(1)).over(board) - place - shared).drop(key)


def rank_points_wide(df: DataFrame, by: list[str], value: str, higher: bool = True,
                     pieces: int | None = None) -> DataFrame:
    """The same points for boards with any number of members.

    Copies of a value are counted first, so a value a third of all members
    share is one row; places are a chunked running sum over distinct values.
    Returns one row per (board, value): join it back on both to get members.
    """
    sign = F.lit(-1.0 if higher else 1.0)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("tied")).withColumn("__key", sign * F.col(value))
    chunk = scan.value_chunks(counts, "__key", pieces)
    placed = scan.running_sum(counts, by, ["__key"], chunk, {"tied": "before"}, inclusive=False)
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("board_size"))
    return placed.join(size, by).select(
        *by, value, "tied", "board_size",
        (F.col("before") + 1).alias("place"),
        (F.col("board_size") - F.col("before") - (F.col("tied") - 1) / 2).alias("points"),
    )


def row_rank(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Row-order rank; ``order`` must end in a unique column."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First k rows per key.

    The ``row_number() <= k`` filter lets Spark keep only k rows per key in
    each map task before the shuffle, so a hot key ships k rows per task.
    """
    return row_rank(df, by, order, name).where(F.col(name) <= k)


def newest(df: DataFrame, stamp: str) -> DataFrame:
    """All rows of the newest snapshot; the scalar reaches the scan as a filter."""
    return df.where(F.col(stamp) == df.agg(F.max(stamp)).scalar())


def neighbour_gaps(df: DataFrame, by: list[str], value: str, direction: Column,
                   points: str = "points", entity: str = "entity") -> DataFrame:
    """Distance and points to the next entity above and below on a board."""
    key = "__key"
    out = df.withColumn(key, _best_first(value, direction))
    w = Window.partitionBy(*by).orderBy(key, entity)
    up, down = F.lag(value).over(w), F.lead(value).over(w)
    return (
        out.withColumn("gap_up", F.abs(up - F.col(value)))
        .withColumn("points_up", F.lag(points).over(w) - F.col(points))
        .withColumn("cushion", F.abs(F.col(value) - down))
        .drop(key)
    )

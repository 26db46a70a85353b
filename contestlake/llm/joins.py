"""Equality joins in which null equals null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on ``keys``, which both sides have; the result has them once."""
    named = {k: f"_right_{k}" for k in keys}
    right = right.withColumnsRenamed(named)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(r)) for k, r in named.items()])
    return left.join(right, same, how).drop(*named.values())

"""Late and corrected facts: rebuild the touched keys alone, hand on what changed.

A change set holds insert, update and delete rows against a stored table.
Rows are told apart by their key and, where a key has several rows, by their
place among those rows in the order of their other columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlake.operators import intervals
from contestlake.session import cut_lineage

PLACE = "__place"


def _numbered(rows: DataFrame, key: list[str]) -> DataFrame:
    rest = [F.asc_nulls_first(c) for c in rows.columns if c not in key]
    return rows.withColumn(PLACE, F.row_number().over(Window.partitionBy(*key).orderBy(*rest)))


def _same(left: str, right: str, columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def change_set(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """op and the columns of the new row, or of the old one where it goes; equal rows are left out."""
    columns = old.columns
    rest = [c for c in columns if c not in key]
    a = _numbered(old, key).withColumn("__a", F.lit(True)).alias("a")
    b = _numbered(new.select(*columns), key).withColumn("__b", F.lit(True)).alias("b")
    both = a.join(b, _same("a", "b", [*key, PLACE]), "full_outer")
    op = F.when(F.col("__a").isNull(), "insert").when(F.col("__b").isNull(), "delete").when(~_same("a", "b", rest), "update")
    value = lambda c: F.when(F.col("__b").isNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    place = F.coalesce(f"a.{PLACE}", f"b.{PLACE}").alias(PLACE)
    return both.select(op.alias("op"), *[value(c) for c in columns], place).where("op is not null")


def applied(stored: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The stored table after the change set."""
    columns = stored.columns
    gone = changes.where("op <> 'insert'").select(*key, PLACE).alias("b")
    kept = _numbered(stored, key).alias("a").join(gone, _same("a", "b", [*key, PLACE]), "left_anti")
    return kept.select(*columns).unionByName(changes.where("op <> 'delete'").select(*columns))


def interval_changes(stored: DataFrame, log: DataFrame, fresh: DataFrame, order: list[str], at: str,
                     chunk: intervals.Chunk = None) -> DataFrame:
    """Change set of the stored intervals after ``fresh`` actions came in, whenever they took effect.

    ``log`` holds all actions, the fresh ones too.  Only the (entity, member)
    keys that a fresh action moves are rebuilt; everything else is read past by
    a semi join.  Works for withdrawn actions as well: they are fresh, and the
    log lacks them.
    """
    touched = cut_lineage(intervals.membership_moves(fresh, order).select(*intervals.KEY).distinct())
    moves = intervals.membership_moves(log, order).join(touched, intervals.KEY, "left_semi")
    rebuilt = intervals.intervals_of(moves, order, at, chunk)
    old = stored.join(touched, intervals.KEY, "left_semi")
    return change_set(old, rebuilt, [*intervals.KEY, "from_ts"])

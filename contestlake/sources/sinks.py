"""Writes: idempotent upsert, first-seen bookkeeping, provenance, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("job", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("at", T.TimestampType()),
])


def merged(old: DataFrame, new: DataFrame, key: list[str], stamp: str) -> DataFrame:
    """Newest row per key of both; running it again changes nothing.

    The newest row is picked by a partial aggregate, so copies of a hot key
    are folded before the shuffle.  On equal stamps the new side wins.
    """
    columns = old.columns
    both = old.withColumn("__new", F.lit(0)).unionByName(new.select(*columns).withColumn("__new", F.lit(1)))
    rest = [c for c in columns if c not in key]
    order = F.struct(F.col(stamp), F.col("__new"), *[F.col(c) for c in rest if c != stamp])
    picked = both.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return picked.select(*key, *[F.col("__row")[c].alias(c) for c in rest]).select(*columns)


def filled(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Property merge in which a null never erases a known value."""
    fresh = new.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = old.join(fresh, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
    return out


def guarded(old: DataFrame, new: DataFrame, key: list[str], strong: str, columns: list[str]) -> DataFrame:
    """Update that never overwrites a row carrying a different strong id."""
    fresh = new.select(*key, F.col(strong).alias("__strong"), *[F.col(c).alias(f"__{c}") for c in columns])
    out = old.join(fresh, key, "left")
    allowed = F.col("__strong").isNotNull() & (F.col(strong).isNull() | (F.col(strong) == F.col("__strong")))
    for c in columns:
        out = out.withColumn(c, F.when(allowed, F.coalesce(f"__{c}", c)).otherwise(F.col(c))).drop(f"__{c}")
    return out.withColumn(strong, F.coalesce(strong, "__strong")).drop("__strong")


def first_seen(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """First sighting per key and whether the new batch brought it.

    ``old``: key, first_seen; ``new``: key, seen_at.
    """
    batch = new.groupBy(key).agg(F.min("seen_at").alias("seen_at"))
    out = old.join(batch, key, "full_outer")
    return out.select(key, F.least("first_seen", "seen_at").alias("first_seen"), F.col("first_seen").isNull().alias("is_new"))


def closed_only(rows: DataFrame, period_end: Column, as_of) -> DataFrame:
    """Rows of periods whose end has passed; an open period is not a fact."""
    return rows.where(period_end < F.lit(as_of))


def write_upsert(spark: SparkSession, path: str, new: DataFrame, key: list[str], stamp: str, partition: str) -> None:
    """Upsert into a partitioned Parquet table, touching changed partitions only.

    The partition column is part of the key's identity (a month or a period),
    so the partitions of the new rows are all that is read and rewritten.  The
    merged rows go to a checkpoint first, because a table cannot be overwritten
    while it is being read; partitions are then swapped by dynamic overwrite.
    """
    from contestlake.session import cut_lineage

    if exists(spark, path):
        touched = new.select(partition).distinct()
        old = spark.read.schema(new.schema).parquet(path).join(touched, partition, "left_semi")
        new = cut_lineage(merged(old, new, key, stamp))
    else:
        new = merged(new.limit(0), new, key, stamp)
    # Rebalance splits a hot partition over several writers.
    new.hint("rebalance", F.col(partition)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written at ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def record_run(spark: SparkSession, path: str, run_id: str, job: str, status: str, at) -> None:
    """Append a provenance row; ``complete`` is written after the data is."""
    spark.createDataFrame([(run_id, job, status, at)], RUN_SCHEMA).write.mode("append").parquet(path)


def last_runs(runs: DataFrame) -> DataFrame:
    """Latest status of every run; a run left at ``running`` never finished."""
    order = F.struct("at", (F.col("status") != "running").cast("int"))
    return runs.groupBy("run_id").agg(F.max_by("status", order).alias("status"), F.max("at").alias("at"))


def replaced(derived: DataFrame, stored: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Derived rows to keep and stored keys this run no longer derives."""
    return derived, stored.join(derived.select(*key), key, "left_anti")

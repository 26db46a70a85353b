"""Event streams: dedup, alerts, windows, sessions and keyed state.

Sources are landed files; the checkpoint folder holds offsets and state, so a
restarted query goes on where it stopped.  State is bounded by event time.

Order-sensitive state of single keys lives in ``keyed``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from contestlake.functions.names import normalize_name
from contestlake.session import run_dir

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, per_trigger: int | None = None) -> DataFrame:
    """Stream of landed Parquet files, typed by a fixed schema.

    ``path`` is a landing folder, or one file that is streamed by its name.
    """
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(target).isFile():
        reader, path = reader.option("pathGlobFilter", target.getName()), target.getParent().toString()
    return reader.parquet(path)


def event_time(stream: DataFrame, column: str = "ts", delay: str = "1 day") -> DataFrame:
    """Watermarked event time; watermarks need a zoned timestamp."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def unseen(stream: DataFrame, uid: str) -> DataFrame:
    """Events whose uid was not seen within the watermark delay."""
    return stream.dropDuplicatesWithinWatermark([uid])


def known_alerts(stream: DataFrame, universe: DataFrame, key: str, text: str, words: str) -> DataFrame:
    """Events about known members whose text says something alertable."""
    return stream.where(F.col(text).rlike(f"(?i){words}")).join(universe, key)


def attach_member(stream: DataFrame, members: DataFrame, name: Column) -> DataFrame:
    """News with its member by normalised name; kept without one too.

    ``members``: norm, member.
    """
    return stream.withColumn("norm", normalize_name(name)).join(members, "norm", "left")


def on_roster(stream: DataFrame, open_intervals: DataFrame, entity) -> DataFrame:
    """Events about members an entity holds now."""
    ours = open_intervals.where(F.col("to_ts").isNull() & (F.col("entity") == entity)).select("member").distinct()
    return stream.join(ours, "member")


def tumbling(stream: DataFrame, ts: str, days: int, offset: str, by: list[str], aggs: list[Column]) -> DataFrame:
    """Period totals; in append mode a period appears once it is closed."""
    w = F.window(ts, f"{days} days", startTime=offset)
    return stream.groupBy(w, *by).agg(*aggs).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *[
        F.col(_name(a)) for a in aggs])


def sliding(stream: DataFrame, ts: str, days: int, step: int, by: list[str], aggs: list[Column]) -> DataFrame:
    w = F.window(ts, f"{days} days", f"{step} days")
    return stream.groupBy(w, *by).agg(*aggs).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, *[
        F.col(_name(a)) for a in aggs])


def sessions(stream: DataFrame, ts: str, gap: str, by: list[str], aggs: list[Column]) -> DataFrame:
    """Bursts of moves: a session ends after ``gap`` without one."""
    w = F.session_window(ts, gap)
    return stream.groupBy(w, *by).agg(*aggs).select(
        F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, *[F.col(_name(a)) for a in aggs])


def _name(column: Column) -> str:
    return column._jc.toString().rsplit(" AS ", 1)[-1].strip("`")


def late_rows(stream: DataFrame, occurred: str, observed: str, days: int) -> DataFrame:
    """Facts that arrived after the watermark; a batch re-derivation uses them."""
    return stream.where(F.col(observed) > F.col(occurred) + F.expr(f"INTERVAL {days} DAYS"))


# --- running ---------------------------------------------------------------


HEARTBEAT = T.StructType([
    T.StructField("job", T.StringType()), T.StructField("batch", T.LongType()), T.StructField("at", T.StringType()),
    T.StructField("rows", T.LongType()), T.StructField("watermark", T.StringType()), T.StructField("state_rows", T.LongType()),
    T.StructField("late_rows", T.LongType()), T.StructField("status", T.StringType()),
])


def heartbeat(spark: SparkSession, query: StreamingQuery, job: str, root: str) -> None:
    """Append the progress of a query's last batches, and how it ended, to the heartbeat table under ``root``.

    Spark keeps the progress of at most ``spark.sql.streaming.numRecentProgressUpdates`` batches.
    """
    rows = []
    for p in query.recentProgress:
        held = [(s.numRowsTotal, s.numRowsDroppedByWatermark) for s in p.stateOperators]
        rows.append((job, p.batchId, p.timestamp, p.numInputRows, p.eventTime.get("watermark"), sum(h[0] for h in held), sum(h[1] for h in held), "running"))
    status = "failed" if query.exception() else "active" if query.isActive else "stopped"
    last = max((r[1] for r in rows), default=-1)
    rows.append((job, last, rows[-1][2] if rows else None, 0, None, None, None, status))
    spark.createDataFrame(rows, HEARTBEAT).write.mode("append").parquet(f"{root}/heartbeat")


def poll(stream: DataFrame, label: str, root: str, every: str = "180 seconds", write: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start a query that looks for new files at fixed times; the caller stops it.

    Rows go to a table under ``root``, or to ``write`` batch by batch.
    """
    out = stream.writeStream.queryName(label).option("checkpointLocation", f"{root}/checkpoint").trigger(processingTime=every)
    if write is not None:
        return out.foreachBatch(write).start()
    return out.format("parquet").outputMode("append").option("path", f"{root}/out").start()


def lanes(fast: Callable[[], None], slow: Callable[[], None], cycles: int, every: int = 10) -> None:
    """Run the fast lane in every cycle and the slow lane in the first and then every ``every``-th one."""
    for cycle in range(cycles):
        fast()
        if cycle % every == 0:
            slow()


def drain(stream: DataFrame, label: str, root: str | None = None) -> DataFrame:
    """Process what has landed, append it to a table, return the table."""
    spark = stream.sparkSession
    root = root or run_dir(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    heartbeat(spark, query, label, root)
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], label: str, root: str | None = None) -> None:
    """Hand every micro-batch to ``write``; used for upsert sinks."""
    root = root or run_dir(stream.sparkSession, label)
    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start())
    query.awaitTermination()


# --- leave then taken ------------------------------------------------------

DAY = 86_400


def followed(leaves: DataFrame, takes: DataFrame, days: int = 3, delay: str = "1 day") -> DataFrame:
    """Stream-stream interval join: a take by another entity less than ``days`` after a leave.

    Both sides are member, entity, ts streams with a watermark of ``delay``;
    state older than the interval and the delay is dropped on both.  A leave is
    put on each day its interval touches and meets the takes of that day, so a
    member with very many moves is spread over days.
    """
    day = lambda ts: F.floor(F.unix_seconds(ts) / DAY)
    left = leaves.select("member", F.col("entity").alias("victim"), F.col("ts").cast("timestamp").alias("left_at"))
    left = left.withWatermark("left_at", delay).withColumn(
        "day", F.explode(F.sequence(day(F.col("left_at")), day(F.col("left_at") + F.expr(f"INTERVAL {days} DAYS")))))
    took = takes.select(F.col("member").alias("taken"), F.col("entity").alias("sniper"), F.col("ts").cast("timestamp").alias("taken_at"))
    took = took.withWatermark("taken_at", delay).withColumn("taken_day", day(F.col("taken_at")))
    within = F.expr(f"taken_at > left_at AND taken_at < left_at + INTERVAL {days} DAYS")
    same = (F.col("member") == F.col("taken")) & (F.col("day") == F.col("taken_day")) & (F.col("victim") != F.col("sniper"))
    return left.join(took, same & within).select("member", "victim", "sniper", "left_at", "taken_at")


def late_table(stream: DataFrame, side: Column, sides: int, ts: str, delay_seconds: int, label: str, root: str) -> DataFrame:
    """The rows that a watermark over several sides has passed by, kept in a table of their own.

    The watermark of a batch is the least over the sides of the newest time in
    the batches before it, less the delay, as the join has it; it moves once
    every side was seen.  A repeated batch writes the same files again.
    """
    spark = stream.sparkSession
    kinds = stream.schema
    marks = T.StructType([T.StructField("side", T.StringType()), T.StructField("high", T.LongType()), T.StructField("batch", T.LongType())])
    at = F.unix_millis(F.col(ts).cast("timestamp"))

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        known = session.createDataFrame([], marks)
        if number:
            known = session.read.schema(marks).option("recursiveFileLookup", "true").parquet(f"{root}/marks").where(F.col("batch") < number)
        newest = known.groupBy("side").agg(F.max("high").alias("high"))
        low, seen = newest.agg(F.min("high"), F.count(F.lit(1))).first()
        late = batch.where(at <= low - delay_seconds * 1000) if seen == sides else batch.limit(0)
        late.write.mode("overwrite").parquet(f"{root}/late/{number}")
        batch.groupBy(side.alias("side")).agg(F.max(at).alias("high")).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{root}/marks/{number}")

    each_batch(stream, write, label, f"{root}/late-run")
    return spark.read.schema(kinds).option("recursiveFileLookup", "true").parquet(f"{root}/late")

"""Keyed state in the state store: newest rows, open intervals, first sightings.

Each operator is a ``transformWithState`` processor.  A key's state lives in
the RocksDB store and is read and written only when the key has rows, so a
batch costs what it touches, whatever closed history there is.  What is final
(closed intervals, first sightings) goes out as rows of an append-only table;
what may still change stays in the store and is read through the state reader.

Times are whole microseconds inside the store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from contestlake.operators import intervals
from contestlake.session import run_dir
from contestlake.streaming import pipelines

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def stamp(value: Column) -> Column:
    return F.timestamp_micros(value).cast("timestamp_ntz")


def run(stream: DataFrame, root: str) -> DataFrame:
    """Process what has landed since the last call and return all rows put out so far.

    The checkpoint under ``root`` holds offsets and state, so a later call (or
    a restart) goes on where this one stopped.
    """
    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        return pipelines.drain(stream, "keyed", root)
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def state(spark: SparkSession, root: str, variable: str) -> DataFrame:
    """The current values of one state variable, a row per key (or list element)."""
    return spark.read.format("statestore").option("stateVarName", variable).load(f"{root}/checkpoint")


def in_parts(rows: DataFrame, ts: str, parts: int, step: Callable[[DataFrame], DataFrame], label: str) -> tuple[str, DataFrame]:
    """Land a table in time order in several parts and run ``step`` after each: (folder of the run, last result).

    ``step`` gets a stream over the landing folder.  Every part is a batch of
    its own behind a restart of the query.
    """
    spark = rows.sparkSession
    root = run_dir(spark, label)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    cuts = rows.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)])).first()[0] or []
    edges = [None, *cuts, None]
    out = None
    for low, high in zip(edges, edges[1:]):
        part = rows.where((F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high))
        part.write.mode("append").parquet(f"{root}/landed")
        out = step(pipelines.parquet_stream(spark, f"{root}/landed", rows.schema), root)
    return root, out


# --- newest rows -----------------------------------------------------------


class Newest(StatefulProcessor):
    """Keeps the k newest rows of a key and puts out their two means whenever they change."""

    def __init__(self, k: int, recent: int):
        self.k, self.recent = k, recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("newest", "at long, seq long, amount long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        every = sorted(held + [(r["at"], r["seq"], r["amount"]) for r in rows], reverse=True)[: self.k]
        if every != held:
            self.rows.put(every)
            late, rest = every[: self.recent], every[self.recent :]
            mean = lambda some: sum(x[2] for x in some) / len(some) if some else None
            yield Row(member=key[0], at=every[0][0], games=len(every), recent=mean(late), prior=mean(rest))

    def close(self) -> None:
        pass


def _batch_newest(k: int):
    """The k newest rows per member of each Arrow batch, so that a hot key ships a few rows per task."""

    def work(batches):
        for frame in batches:
            yield frame.sort_values(["at", "seq"], ascending=False).groupby("member", sort=False).head(k)

    return work


def newest(stream: DataFrame, k: int, recent: int) -> DataFrame:
    """Updates (member, at, games, recent, prior) of a stream of member, at, seq, amount; null members take no part."""
    kinds = "member long, at long, seq long, amount long"
    rows = stream.select(F.col("member").cast("long").alias("member"), micros(F.col("at")).alias("at"),
                         F.col("seq").cast("long").alias("seq"), F.col("amount").cast("long").alias("amount"))
    rows = rows.where("member is not null and at is not null").mapInPandas(_batch_newest(k), kinds)
    return rows.groupBy("member").transformWithState(
        Newest(k, recent), "member long, at long, games int, recent double, prior double", "Append", "None")


def newest_rows(spark: SparkSession, root: str) -> DataFrame:
    """member, at, seq, amount of the rows now held."""
    held = state(spark, root, "newest")
    return held.select(F.col("key.member").alias("member"), stamp(F.col("list_element.at")).alias("at"),
                       F.col("list_element.seq").alias("seq"), F.col("list_element.amount").alias("amount"))


# --- open intervals --------------------------------------------------------


#: State cells that share the keys: fixed for the life of a checkpoint, as a key must find its cell again.
CELLS = 1024


class OpenIntervals(StatefulProcessor):
    """At most one open interval per (entity, member); a close puts out the finished one.

    A cell holds the open intervals of all its keys as one list, so that the
    store is asked once per cell and batch, and not several times per key.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", "entity long, member long, from_ts long, via string, status string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = {(r[0], r[1]): tuple(r[2:]) for r in self.open.get()}
        before = dict(held)
        for r in sorted(rows, key=lambda r: (r["at"], r["place"], r["step"])):
            who = (r["entity"], r["member"])
            now = held.get(who)
            if r["kind"] == "open" and now is None:
                held[who] = (r["at"], r["action"], "active")
            elif r["kind"] == "status" and now is not None:
                held[who] = (*now[:2], r["status"])
            elif r["kind"] == "close" and now is not None:
                yield Row(entity=who[0], member=who[1], from_ts=now[0], to_ts=r["at"], via=now[1], ended_by=r["action"], status=now[2])
                del held[who]
        if held and held != before:
            self.open.put([(*who, *now) for who, now in held.items()])
        elif before and not held:
            self.open.clear()

    def close(self) -> None:
        pass


CLOSED = "entity long, member long, from_ts long, to_ts long, via string, ended_by string, status string"


def closed_intervals(actions: DataFrame, at: str, place: str) -> DataFrame:
    """Finished intervals of a stream of actions, whose batches come in time order; ``place`` orders equal times."""
    moves = intervals.membership_moves(actions, [at, place])
    rows = moves.select("entity", F.col("member").cast("long").alias("member"), "action", "kind", "status", "step",
                        micros(F.col(at)).alias("at"), F.col(place).cast("long").alias("place"))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("entity", "member"), F.lit(CELLS)).cast("int"))
    return rows.groupBy("cell").transformWithState(OpenIntervals(), CLOSED, "Append", "None")


def all_intervals(spark: SparkSession, closed: DataFrame, root: str) -> DataFrame:
    """Closed intervals as put out, and the open ones from the store."""
    held = state(spark, root, "open").select(
        F.col("list_element.entity").alias("entity"), F.col("list_element.member").alias("member"), F.col("list_element.from_ts").alias("from_ts"),
        F.lit(None).cast("long").alias("to_ts"), F.col("list_element.via").alias("via"), F.lit(None).cast("string").alias("ended_by"),
        F.col("list_element.status").alias("status"))
    return closed.unionByName(held).withColumns({c: stamp(F.col(c)) for c in ("from_ts", "to_ts")})


# --- first sightings -------------------------------------------------------


class FirstSeen(StatefulProcessor):
    """Marks the first sighting of a key; every later one knows when that was.

    With ``keep`` a key is forgotten when it was not seen for so long by event
    time, and is new again after that.
    """

    def __init__(self, keep: int | None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first long, last long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, last = tuple(self.seen.get()) if self.seen.exists() else (None, None)
        for r in sorted(rows, key=lambda r: (r["at"], r["place"])):
            new = first is None or (self.keep is not None and r["at"] > last + self.keep)
            first, last = (r["at"] if new else first), max(r["at"], last or r["at"])
            yield Row(uid=key[0], place=r["place"], at=r["at"], first_at=first, is_new=new)
        self.seen.update((first, last))
        if self.keep is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer((last + self.keep) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_seen(stream: DataFrame, uid: str, at: str, place: str, keep_days: int | None = None, delay: str = "1 day") -> DataFrame:
    """uid, place, at, first_at, is_new of every row.

    With ``keep_days`` the state of a uid expires by event time, ``delay``
    after its last sighting went out of reach.
    """
    kinds = "uid long, place long, at long, first_at long, is_new boolean"
    rows = stream.select(F.col(uid).cast("long").alias("uid"), F.col(place).cast("long").alias("place"),
                         micros(F.col(at)).alias("at"), F.col(at).cast("timestamp").alias("event_time"))
    if keep_days is None:
        return rows.drop("event_time").groupBy("uid").transformWithState(FirstSeen(None), kinds, "Append", "None")
    timed = rows.withWatermark("event_time", delay)
    return timed.groupBy("uid").transformWithState(FirstSeen(keep_days * 86_400_000_000), kinds, "Append", "EventTime")

"""One day's capture folder → event and snapshot tables.

Every table is written by an idempotent upsert on a key derived from content,
so a capture can be ingested again, or after a crash, without doubling rows.
The run is marked complete only after the last write has returned.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestlake.functions import names
from contestlake.functions.calendars import Calendar
from contestlake.operators import joins
from contestlake.sources import captures, landing, sinks


def member_uid(player):
    """Default member key: a hash of the normalised name.

    Merged members are redirected afterwards with ``identity.rewrite``.
    """
    return names.content_uid(names.normalize_name(player))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return captures.strip_stamp(captures.read_lines(spark, path))


#: Artifacts that an ingest reads.
FILES = [
    "transactions_all_raw.txt", "fa_pool_batters.psv", "fa_pool_pitchers.psv", "standings_overall.txt", "standings_overall_raw.txt",
    "standings_byperiod_all.txt", "lineups_all.psv", "roster_grid.txt", "draft_results.txt", "player_news_raw.txt",
]


def transaction_tables(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transactions and their actions; fees stay on the transaction."""
    keyed = rows.withColumn("uid", names.transaction_uid(F.col("posted_at"), F.col("team"), F.col("actions")))
    month = F.date_format("posted_at", "yyyy-MM")
    txn = keyed.select("uid", "posted_at", "team", "effective_date", "cost", F.size("actions").alias("n_actions"),
                       F.col("posted_at").alias("observed_at"), month.alias("month"))
    acts = keyed.select("uid", "posted_at", "team", "effective_date", month.alias("month"), F.posexplode("actions").alias("idx", "a")).select(
        "uid", "idx", member_uid(F.col("a.player")).alias("member"), "team", "a.player", "a.positions", "a.mlb_team", "a.action",
        "a.counterparty", "posted_at", "effective_date", F.col("posted_at").alias("observed_at"), "month")
    return txn, acts


def standing_lines(rows: DataFrame, scope: str, as_of, period=None) -> DataFrame:
    """Standing lines with their row-order rank inside the metric."""
    from contestlake.operators import ranking

    out = rows.withColumn("period", F.lit(period).cast("int")) if "period" not in rows.columns else rows
    out = out.select(F.lit(scope).alias("scope"), F.lit(as_of).alias("as_of"), F.col("period").cast("int").alias("period"), "metric",
                     "team", "value", "points", F.lit(as_of).alias("observed_at"))
    return ranking.row_rank(out, ["scope", "period", "metric"], [F.desc("points"), F.asc("team")], "row_rank")


def pool_entries(rows: DataFrame, side: str, target, as_of: datetime, identities: DataFrame | None = None) -> DataFrame:
    """Pool lines with their stats, sent to the member they stand for.

    ``identities`` (uid, strong_id, name, side) routes by strong id, else by
    name and side; without a hit the member is a hash of the name.
    """
    rows = rows.withColumn("side", F.lit(side)).withColumn("name", names.normalize_name(F.col("player")))
    default = member_uid(F.col("player"))
    if identities is None:
        rows = rows.withColumn("uid", default)
    else:
        strong = identities.where("strong_id is not null").groupBy("strong_id").agg(F.min("uid").alias("strong_uid"))
        named = identities.groupBy("name", "side").agg(F.min("uid").alias("named_uid"))
        rows = joins.routed(rows, strong, named, default)
    day = str(as_of.date())
    return rows.select(
        F.coalesce("strong_id", default).alias("entry"), "side", F.col("uid").alias("member"), "strong_id", "player",
        F.array_join("positions", ",").alias("positions"), "mlb_team", "avail", "waiver_clear", "rank",
        F.array_sort(F.map_entries("stats")).alias("stats"), target.alias("period"),
        F.lit(as_of).alias("observed_at"), F.lit(day).alias("as_of"), F.lit(day).alias("day"))


def overall_lines(rows: DataFrame, as_of: datetime) -> DataFrame:
    """The official overall table, with the rank it states."""
    return rows.select("rank", "team", "batting", "pitching", "total", F.lit(as_of).alias("as_of"), F.lit(as_of).alias("observed_at"),
                       F.date_format(F.lit(as_of), "yyyy-MM").alias("month"))


def run_ingest(spark: SparkSession, folder: str, warehouse: str, as_of: datetime, teams: list[str], calendar: Calendar,
               present: set[str] | None = None, identities: DataFrame | None = None, landed: DataFrame | None = None) -> None:
    """Ingest one day's capture; a run that fails is recorded as failed.

    The files are those of ``folder`` named in ``present``.  With ``landed``
    (``landing.file_list`` of all days) a file that the day lacks, or that is
    empty, is taken from the newest earlier day that has it, and its rows carry
    that day's stamp, so an older capture never overwrites a newer one.
    """
    run = f"{folder.rstrip('/').rsplit('/', 1)[-1]}"
    runs = f"{warehouse}/ops_runs"
    sinks.record_run(spark, runs, run, "ingest", "running", as_of)
    try:
        sources = {f: (f"{folder}/{f}", as_of) for f in present or ()}
        if landed is not None:
            for file, (path, day) in landing.pick(landed, run, FILES).items():
                moment = as_of if day == run else datetime.combine(datetime.fromisoformat(day).date(), as_of.time())
                sources.setdefault(file, (path, moment))
        _ingest_files(spark, warehouse, as_of, teams, calendar, sources, identities, run)
    except Exception:
        sinks.record_run(spark, runs, run, "ingest", "failed", as_of)
        raise
    sinks.record_run(spark, runs, run, "ingest", "complete", as_of)


def _ingest_files(spark, warehouse, run_at, teams, calendar, sources, identities, run) -> None:
    def put(name, rows, key, partition):
        sinks.write_upsert(spark, f"{warehouse}/{name}", rows, key, "observed_at", partition)

    def refuse(artifact, rejects):
        """Lines that were not understood, under the run and file they came from; a second run replaces its own."""
        rows = rejects.select(F.lit(run).alias("run_id"), F.lit(artifact).alias("artifact"), "line", F.lit(run_at).alias("observed_at"))
        put("ops_rejects", rows.distinct(), ["run_id", "artifact", "line"], "run_id")

    if "transactions_all_raw.txt" in sources:
        path, as_of = sources["transactions_all_raw.txt"]
        rows, rejects = captures.sniffed_transactions(lines(spark, path), teams)
        txn, acts = transaction_tables(rows)
        put("ev_txn", txn, ["uid"], "month")
        put("ev_txn_action", acts, ["uid", "idx"], "month")
        refuse("transactions_all_raw.txt", rejects)
    for kind, file in (("bat", "fa_pool_batters.psv"), ("pit", "fa_pool_pitchers.psv")):
        if file in sources:
            path, as_of = sources[file]
            rows, rejects = captures.pool(lines(spark, path), kind)
            target = calendar.pool_target(F.lit(as_of.date()))
            put("snap_pool_entry", pool_entries(rows, kind, target, as_of, identities), ["entry", "side", "as_of"], "day")
            refuse(file, rejects)
    if "standings_overall.txt" in sources:
        path, as_of = sources["standings_overall.txt"]
        rows = captures.standings_text(lines(spark, path))
        put("snap_standing_line", standing_lines(rows, "ytd", as_of).withColumn("month", F.date_format("as_of", "yyyy-MM")),
            ["scope", "as_of", "metric", "team"], "month")
    if "standings_overall_raw.txt" in sources:
        path, as_of = sources["standings_overall_raw.txt"]
        rows = captures.overall_page(captures.read_lines(spark, path))
        put("snap_overall_line", overall_lines(rows, as_of), ["as_of", "team"], "month")
    if "standings_byperiod_all.txt" in sources:
        path, as_of = sources["standings_byperiod_all.txt"]
        rows = captures.by_period(captures.read_lines(spark, path), teams)
        closed = sinks.closed_only(rows, calendar.end(F.col("period")), as_of.date())
        put("snap_period_line", standing_lines(closed, "period", as_of), ["scope", "period", "metric", "team"], "period")
    if "lineups_all.psv" in sources:
        path, as_of = sources["lineups_all.psv"]
        rows, rejects = captures.lineups(lines(spark, path), teams)
        put("snap_lineup", rows.select("team", "period", "section", "slot", "player", member_uid(F.col("player")).alias("member"),
                                       "strong_id", F.lit(as_of).alias("observed_at")), ["team", "period", "section", "slot", "member"], "period")
        refuse("lineups_all.psv", rejects)
    if "roster_grid.txt" in sources:
        path, as_of = sources["roster_grid.txt"]
        rows = captures.roster_grid(lines(spark, path), teams)
        put("snap_grid_entry", rows.select("team", "slot_group", "label", "status", F.lit(as_of).alias("observed_at"),
                                           F.lit(str(as_of.date())).alias("day")), ["team", "slot_group", "label", "day"], "day")
    if "draft_results.txt" in sources:
        path, as_of = sources["draft_results.txt"]
        rows, rejects = captures.draft(lines(spark, path), teams)
        put("ev_pick", rows.select("overall", "pick_in_round", "team", "player", member_uid(F.col("player")).alias("member"), "auto", "queued",
                                   F.lit(as_of).alias("observed_at"), "round"), ["round", "overall"], "round")
        refuse("draft_results.txt", rejects)
    if "player_news_raw.txt" in sources:
        path, as_of = sources["player_news_raw.txt"]
        rows, rejects = captures.news(lines(spark, path))
        put("ev_news", seen_news(spark, f"{warehouse}/ev_news", news_items(rows, as_of), as_of), ["uid"], "bucket")
        refuse("player_news_raw.txt", rejects)


def seen_news(spark: SparkSession, path: str, items: DataFrame, as_of: datetime) -> DataFrame:
    """Items with the time they were first seen; ``is_new`` if this capture brought them."""
    if sinks.exists(spark, path):
        old = spark.read.schema(items.withColumn("first_seen", F.lit(as_of)).schema).parquet(path)
        known = old.groupBy("uid").agg(F.min("first_seen").alias("seen_before"))
        items = items.join(known, "uid", "left")
    else:
        items = items.withColumn("seen_before", F.lit(None).cast("timestamp"))
    first = F.coalesce("seen_before", "observed_at")
    return items.withColumn("first_seen", first).withColumn("is_new", F.col("first_seen") == F.lit(as_of)).drop("seen_before")


def fresh_news(news: DataFrame, as_of: datetime, roster: DataFrame) -> DataFrame:
    """New items about members of a roster (column ``member``)."""
    return news.where(F.col("is_new") & (F.col("first_seen") == F.lit(as_of))).join(roster.select("member").distinct(), "member", "left_semi")


def news_items(rows: DataFrame, as_of) -> DataFrame:
    """News keyed by player and headline; the body fills return-time weeks."""
    from contestlake.functions.texts import return_weeks

    uid = names.content_uid(names.normalize_name(F.col("player")), F.col("headline"))
    keyed = rows.select(uid.alias("uid"), "player", member_uid(F.col("player")).alias("member"), "headline", "age_text", "body",
                        return_weeks(F.col("body")).alias("return_weeks"), F.lit(as_of).alias("observed_at"))
    return keyed.withColumn("bucket", F.substring("uid", 1, 1))


def reconcile_state(warehouse: str, spark: SparkSession) -> DataFrame:
    """Action log of the warehouse in the shape the interval builder takes."""
    acts = spark.read.parquet(f"{warehouse}/ev_txn_action")
    return acts.select("member", F.xxhash64("team").alias("entity"), "action", F.when(
        F.col("counterparty").isNotNull(), F.xxhash64("counterparty")).alias("counterparty"),
        F.coalesce(F.col("effective_date").cast("timestamp"), "posted_at").alias("effective"), "posted_at", "uid", "idx")

"""Landing-zone checks: what should be there, what is, which file to use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contestlake.operators import scan

# What a complete daily capture leaves behind.
EXPECTED = [
    "MANIFEST.md", "transactions_all_raw.txt", "roster_grid.txt", "standings_overall_raw.txt", "standings_overall.txt",
    "my_team_raw.txt", "live_scoring_raw.txt", "fa_pool_batters.psv", "fa_pool_pitchers.psv", "standings_byperiod_all.txt",
    "lineups_all.psv", "player_news_raw.txt",
]


def file_list(spark: SparkSession, root: str) -> DataFrame:
    """date, file, length of every landed file, empty ones too.

    Names and sizes come from the file system's listing, a dozen entries per
    captured day; no content is read.  Spark's file sources skip empty files,
    and those are what this check looks for.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    entries = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    rows = []
    while entries.hasNext():
        entry = entries.next()
        target = entry.getPath()
        rows.append((target.getParent().getName(), target.getName(), entry.getLen(), target.toString()))
    return spark.createDataFrame(rows, "date string, file string, length long, path string")


def legacy_names(found: DataFrame) -> DataFrame:
    """Files under the names of today: older runners wrote ``stem_periodN.psv`` for ``stem.psv``.

    A file of today's name wins over an older one of the same day, and of
    several older ones the last by name.
    """
    plain = F.regexp_replace("file", r"_period[^.]*\.", ".")
    named = found.withColumn("plain", plain)
    order = F.struct((F.col("length") > 0), F.col("plain") == F.col("file"), F.col("file"))
    best = named.groupBy("date", F.col("plain").alias("file")).agg(F.max_by(F.struct("length", "path"), order).alias("best"))
    return best.select("date", "file", F.col("best.length").alias("length"), F.col("best.path").alias("path"))


def pick(found: DataFrame, day: str, files: list[str]) -> dict[str, tuple[str, str]]:
    """file → (path, date) to use on a day: its own file, or the newest earlier one that is not empty.

    At most one row per expected file reaches the driver.
    """
    spark = found.sparkSession
    asks = spark.createDataFrame([(f, day) for f in files], "file string, date string")
    wanted = legacy_names(found).join(asks.select("file"), "file", "left_semi")
    rows = latest_available(wanted, asks).where("path is not null").collect()
    return {r["file"]: (r["path"], r["from_date"]) for r in rows}


def failed_pages(manifest: DataFrame) -> DataFrame:
    """Pages a manifest marks as failed (``-1 chars``)."""
    line = r"^- `([^`]+)` <- `([^`]*)` \((-?\d+) chars\)"
    rows = manifest.where(F.col("line").rlike(line)).select(
        "date", F.regexp_extract("line", line, 1).alias("file"), F.regexp_extract("line", line, 3).cast("long").alias("chars"))
    return rows.where(F.col("chars") < 0)


def missing_artifacts(found: DataFrame, dates: DataFrame, expected: list[str]) -> DataFrame:
    """Expected (date, file) pairs that are absent or empty."""
    want = dates.select("date", F.explode(F.array(*[F.lit(e) for e in expected])).alias("file"))
    have = found.groupBy("date", "file").agg(F.max("length").alias("length"))
    joined = want.join(have, ["date", "file"], "left")
    state = F.when(F.col("length").isNull(), "missing").when(F.col("length") == 0, "empty")
    return joined.withColumn("state", state).where(F.col("state").isNotNull()).select("date", "file", "state")


def latest_available(found: DataFrame, asks: DataFrame) -> DataFrame:
    """The newest non-empty file of the asked date or before, per (file, date)."""
    have = found.where(F.col("length") > 0).groupBy("file", "date").agg(F.max("path").alias("path")).select(
        "file", "date", F.lit(0).alias("ask"), F.struct("date", "path").alias("hit"))
    empty = F.lit(None).cast(have.schema["hit"].dataType)
    line = have.unionByName(asks.select("file", "date").distinct().select("file", "date", F.lit(1).alias("ask"), empty.alias("hit")))
    out = scan.fill_forward(line, ["file"], ["date", "ask"], F.substring("date", 1, 7), {"hit": "use"})
    return out.where(F.col("ask") == 1).select("date", "file", F.col("use.date").alias("from_date"), F.col("use.path").alias("path"))

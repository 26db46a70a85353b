"""JSON and CSV feeds → tidy rows, with explicit schemas.

Each function takes the feed as a DataFrame with its fixed schema (from
``read_feed`` or ``from_json``), so batch files and streams share the code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestlake.functions.rates import fixed, innings_to_outs, is_barrel, number, quality_start, ratio

# Feed field → column, for both sides of a game log.
BAT_FIELDS = {
    "plateAppearances": "pa", "atBats": "ab", "hits": "h", "doubles": "b2", "triples": "b3", "homeRuns": "hr",
    "runs": "r", "rbi": "rbi", "baseOnBalls": "bb", "intentionalWalks": "ibb", "hitByPitch": "hbp", "sacFlies": "sf",
    "stolenBases": "sb", "caughtStealing": "cs", "strikeOuts": "so",
}
PIT_FIELDS = {
    "gamesStarted": "gs", "wins": "w", "losses": "l", "saves": "sv", "blownSaves": "bs", "holds": "hld",
    "earnedRuns": "er", "hits": "ha", "baseOnBalls": "bbi", "strikeOuts": "k", "battersFaced": "batters_faced",
    "numberOfPitches": "pitches",
}
# Pitch and call codes.
FASTBALLS = ["FF", "SI", "FT"]
SWINGS = ["S", "W", "F", "T", "L", "X", "D", "E"]
WHIFFS = ["S", "W"]
CALLED = "C"
HARD_HIT = 95
# Game states that count, and words of a status event that raise an alert.
LIVE_STATES = ["S", "P", "F", "I"]
ALERT_WORDS = "injured|paternity|bereavement|designated|optioned|recalled|trade|claimed|released"

_STAT = "struct<" + ",".join(f"{f}:int" for f in dict.fromkeys([*BAT_FIELDS, *PIT_FIELDS])) + ",inningsPitched:string>"
GAME_LOG = f"member bigint, stats array<struct<splits:array<struct<date:string,game:struct<gamePk:bigint>,stat:{_STAT}>>>>"
PLAY_FEED = (
    "gamePk bigint, gameData struct<datetime:struct<officialDate:string>>, liveData struct<plays:struct<allPlays:array<struct<"
    "matchup:struct<pitcher:struct<id:bigint>,batter:struct<id:bigint>>,playEvents:array<struct<isPitch:boolean,"
    "details:struct<type:struct<code:string>,call:struct<code:string>>,pitchData:struct<startSpeed:double>,"
    "hitData:struct<launchSpeed:double,launchAngle:double>>>>>>>"
)
STATUS_FEED = (
    "transactions array<struct<id:bigint,person:struct<id:bigint>,typeDesc:string,date:string,effectiveDate:string,"
    "description:string,toTeam:struct<name:string>,fromTeam:struct<name:string>>>"
)
_SIDE = "struct<team:struct<name:string>,probablePitcher:struct<id:bigint>>"
SCHEDULE_FEED = (
    "dates array<struct<date:string,games:array<struct<gamePk:bigint,status:struct<codedGameState:string>,venue:struct<name:string>,"
    f"teams:struct<home:{_SIDE},away:{_SIDE}>,linescore:struct<teams:struct<home:struct<runs:int>,away:struct<runs:int>>>>>>>"
)
FIELDING_FEED = "member bigint, stats array<struct<splits:array<struct<position:struct<abbreviation:string>>>>>"
PLAYER_FEED = (
    "people array<struct<id:bigint,fullName:string,primaryPosition:struct<abbreviation:string,type:string>,"
    "currentTeam:struct<id:bigint>,batSide:struct<code:string>,pitchHand:struct<code:string>,birthDate:string>>"
)


def read_feed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file, typed by its fixed schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_leaderboard(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header; a byte-order mark is ignored, non-numbers become null."""
    raw = spark.read.option("header", True).csv(path)
    clean = raw.toDF(*[c.replace("\ufeff", "").strip().strip('"') for c in raw.columns])
    return clean.select(*[number(F.col(c)).alias(c) for c in columns])


def game_log_lines(feed: DataFrame, side: str) -> DataFrame:
    """One day line per split; innings become outs, quality starts a flag."""
    s = feed.select("member", F.explode(F.col("stats")[0]["splits"]).alias("s"))
    fields = BAT_FIELDS if side == "bat" else PIT_FIELDS
    cols = [F.col(f"s.stat.{f}").alias(c) for f, c in fields.items()]
    rows = s.select("member", F.to_date("s.date").alias("date"), F.lit(side).alias("side"),
                    F.col("s.game.gamePk").alias("game_pk"), *cols, F.col("s.stat.inningsPitched").alias("ip"))
    if side == "bat":
        return rows.drop("ip")
    rows = rows.withColumn("outs", innings_to_outs(F.col("ip"))).drop("ip")
    return rows.withColumn("qs", F.coalesce(quality_start(F.col("gs"), F.col("outs"), F.col("er")), F.lit(0)))


def _plays(feed: DataFrame, who: str) -> DataFrame:
    plays = feed.select("gamePk", F.to_date("gameData.datetime.officialDate").alias("date"),
                        F.explode("liveData.plays.allPlays").alias("p"))
    return plays.select("gamePk", "date", F.col(f"p.matchup.{who}.id").alias("member"), F.explode("p.playEvents").alias("e")).where(
        F.col("member").isNotNull())


def pitch_games(feed: DataFrame) -> DataFrame:
    """Per (pitcher, game): fastball mean, whiff and called-strike shares, mix."""
    e = _plays(feed, "pitcher").where(F.col("e.isPitch")).select(
        F.col("gamePk").alias("game_pk"), "date", "member", F.col("e.details.type.code").alias("code"),
        F.col("e.details.call.code").alias("call"), F.col("e.pitchData.startSpeed").alias("speed"))
    key = ["member", "game_pk", "date"]
    fast = F.col("code").isin(*FASTBALLS) & F.col("speed").isNotNull()
    kinds = e.groupBy(*key, "code").agg(
        F.count(F.lit(1)).alias("n"), F.count("speed").alias("timed"), F.sum(F.when(fast, F.col("speed"))).alias("ff_sum"),
        F.count_if(fast).alias("n_ff"), F.count_if(F.col("call").isin(*SWINGS)).alias("swings"),
        F.count_if(F.col("call").isin(*WHIFFS)).alias("whiffs"), F.count_if(F.col("call") == CALLED).alias("called"))
    # Codes per pitcher and game are a handful, so the mix is a small map.
    g = kinds.groupBy(*key).agg(
        F.sum("timed").alias("n_pitches"), F.sum("ff_sum").alias("ff_sum"), F.sum("n_ff").alias("n_ff"), F.sum("swings").alias("swings"),
        F.sum("whiffs").alias("whiffs"), F.sum("called").alias("called"),
        F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", "n"))).alias("codes"))
    n = F.greatest(F.col("n_pitches"), F.lit(1))
    mix = F.map_from_entries(F.transform(F.array_sort("codes"), lambda c: F.struct(c["code"], fixed(ratio(c["n"], n), 3))))
    return g.select(
        *key, fixed(ratio(F.col("ff_sum"), F.col("n_ff")), 2).alias("ff_avg"), "n_ff", "n_pitches",
        fixed(ratio(F.col("whiffs"), F.greatest(F.col("swings"), F.lit(1))), 3).alias("whiff_pct"),
        fixed(ratio(F.col("whiffs") + F.col("called"), n), 3).alias("csw_pct"), mix.alias("mix"))


def batted_games(feed: DataFrame) -> DataFrame:
    """Per (batter, game): batted balls, mean exit speed, hard hits, barrels."""
    e = _plays(feed, "batter").select(
        F.col("gamePk").alias("game_pk"), "date", "member", F.col("e.hitData.launchSpeed").alias("ls"),
        F.coalesce("e.hitData.launchAngle", F.lit(0.0)).alias("la")).where(F.col("ls").isNotNull())
    return e.groupBy("member", "game_pk", "date").agg(
        F.count(F.lit(1)).alias("bbe"), fixed(ratio(F.sum("ls"), F.count("ls")), 1).alias("ev_mean"),
        F.count_if(F.col("ls") >= HARD_HIT).alias("hardhit"), F.count_if(is_barrel(F.col("ls"), F.col("la"))).alias("barrels"))


def status_events(feed: DataFrame, universe: DataFrame) -> DataFrame:
    """Typed status rows of known members; ``universe``: person, member."""
    t = feed.select(F.explode("transactions").alias("t"))
    rows = t.select(
        F.concat(F.lit("status:"), F.col("t.id").cast("string")).alias("uid"), F.col("t.person.id").alias("person"),
        F.col("t.typeDesc").alias("type_desc"), F.to_date("t.date").alias("date"),
        F.to_date(F.coalesce("t.effectiveDate", "t.date")).alias("effective"), F.col("t.description").alias("description"),
        F.col("t.toTeam.name").alias("to_team"), F.col("t.fromTeam.name").alias("from_team"))
    return rows.join(universe, "person").drop("person")


def alertable(rows: DataFrame, words: str = ALERT_WORDS) -> DataFrame:
    return rows.where(F.col("type_desc").rlike(f"(?i){words}"))


def _games(feed: DataFrame) -> DataFrame:
    d = feed.select(F.explode("dates").alias("d")).select(F.to_date("d.date").alias("date"), F.explode("d.games").alias("g"))
    home, away = (F.struct(
        F.lit(s).alias("side"), F.col(f"g.teams.{s}.team.name").alias("team"), F.col(f"g.teams.{s}.probablePitcher.id").alias("probable"),
        F.col(f"g.linescore.teams.{s}.runs").alias("runs")) for s in ("home", "away"))
    return d.select("date", F.col("g.gamePk").alias("game_pk"), F.col("g.status.codedGameState").alias("state"),
                    F.col("g.venue.name").alias("venue"), F.inline(F.array(home, away)))


def schedule_sides(feed: DataFrame, states: list[str] | None = None) -> DataFrame:
    """Two rows per game, home and away."""
    rows = _games(feed)
    return rows.where(F.col("state").isin(*states)) if states else rows


def games_per_team(feed: DataFrame) -> DataFrame:
    return schedule_sides(feed, LIVE_STATES).groupBy("team").agg(F.count(F.lit(1)).alias("games"))


def probable_starts(feed: DataFrame, known: DataFrame) -> DataFrame:
    """Named starters of coming games; ``known``: probable, member."""
    rows = schedule_sides(feed).where(F.col("probable").isNotNull())
    return rows.join(known, "probable").select("member", "date", "game_pk", "side", "team")


def venue_runs(feed: DataFrame) -> DataFrame:
    """Total runs of finished games by venue."""
    done = schedule_sides(feed, ["F"])
    return done.groupBy("game_pk", "venue").agg(F.sum("runs").alias("runs"))


def positions_played(feed: DataFrame) -> DataFrame:
    """Games per (member, position); outfield spots count as one, DH not."""
    p = feed.select("member", F.explode(F.col("stats")[0]["splits"]).alias("s")).select("member", F.col("s.position.abbreviation").alias("p"))
    folded: Column = F.when(F.col("p").isin("LF", "CF", "RF", "OF"), "OF").otherwise(F.col("p"))
    return p.where(F.col("p").isNotNull() & (F.col("p") != "DH")).groupBy("member", folded.alias("position")).agg(F.count(F.lit(1)).alias("games"))


def players(feed: DataFrame) -> DataFrame:
    """Universe feed → dimension rows for identity matching."""
    from contestlake.functions.names import normalize_name

    p = feed.select(F.explode("people").alias("p"))
    return p.select(
        F.col("p.id").alias("target_id"), F.col("p.fullName").alias("name"), normalize_name(F.col("p.fullName")).alias("norm"),
        F.col("p.primaryPosition.abbreviation").alias("position"), (F.col("p.primaryPosition.type") == "Pitcher").alias("flag"),
        F.col("p.currentTeam.id").alias("team"), F.col("p.batSide.code").alias("bats"), F.col("p.pitchHand.code").alias("throws"),
        F.to_date("p.birthDate").alias("birthdate"))

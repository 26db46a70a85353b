"""Stamped text captures → typed rows.

Readers give ``lines``: path, blk, pos, line, where (blk, pos) orders the lines
of a file and a block is one input split.  Files are never read whole into one
row, and section headers are carried from block to block, so a capture of any
size is parsed in parallel.  Every parser returns (rows, rejects).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contestlake.functions import calendars
from contestlake.operators import scan
from contestlake.session import stored

ORDER = ["blk", "pos"]

# Cell formats of the captured pages.
PLAYER_CELL = r"^(.+?)\s+([A-Z0-9]{1,3}(?:,[A-Z0-9]{1,3})*)\s*[•�]\s*([A-Z]{2,3})$"
WAIVER_CELL = r"^W \((\d{1,2}/\d{1,2})\)$"
ACTION_WORDS = (
    r"Added off Waivers|Added|Dropped|Moved to IR|Move to Injured|"
    r"Moved to Minors|Sent to Minors|Activated|Called Up|Traded (?:from|to) .+"
)
SEGMENT = (
    r"^(.+?) ([A-Z0-9]{1,3}(?:,[A-Z0-9]{1,3})*) ?[•�|] ?([A-Z]{2,3}) ?-? ?(" + ACTION_WORDS + r")$"
)
ACTION_KINDS = {
    "Added": "add", "Added off Waivers": "claim_add", "Dropped": "drop",
    "Moved to IR": "move_to_il", "Move to Injured": "move_to_il",
    "Moved to Minors": "move_to_minors", "Sent to Minors": "move_to_minors",
    "Activated": "move_from_il", "Called Up": "move_from_minors", "Traded": "trade",
}
GRID_TAGS = {"R": "reserve", "I": "il", "M": "minors"}
BAT_COLUMNS = ["ab", "r", "h", "b1", "b2", "b3", "hr", "rbi", "bb", "so", "sb", "cs", "avg", "obp", "slg"]
PIT_COLUMNS = ["inns", "app", "gs", "qs", "cg", "w", "l", "sv", "bs", "hld", "k", "bbi", "ha", "era", "whip"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files in file order, without reading a file whole."""
    raw = spark.read.text(path)
    return raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("blk"),
        F.monotonically_increasing_id().alias("pos"),
        F.translate("value", "\u00a0", " ").alias("line"))


def strip_stamp(lines: DataFrame) -> DataFrame:
    """Drop the ``source: / captured: / ---`` head of stamped files.

    The stamp is the head of a file, so its end is looked for in the first
    block only; one row per file is kept for it.
    """
    head = lines.where(F.col("blk") == 0).groupBy("path").agg(
        F.min_by("line", "pos").alias("first"), F.min(F.when(F.col("line") == "---", F.col("pos"))).alias("cut"))
    stamped = head.where(F.col("first").startswith("source:") & F.col("cut").isNotNull()).select("path", "cut")
    out = lines.join(stamped, "path", "left")
    return out.where(F.col("cut").isNull() | (F.col("blk") > 0) | (F.col("pos") > F.col("cut"))).drop("cut")


def _cells(line: Column) -> Column:
    return F.transform(F.split(line, r"\|"), lambda c: F.trim(c))


def _kind(action: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in ACTION_KINDS.items() for x in kv])
    return F.try_element_at(pairs, F.when(action.startswith("Traded"), "Traded").otherwise(action))


def _fields(text: Column, pattern: str, count: int) -> Column:
    """Capture groups of one match as an array, null without a match.

    The text is rewritten to its groups once; separate extracts would run the
    pattern once per group.
    """
    mark = "\u0001"
    parts = F.split(F.regexp_replace(text, pattern, mark.join(f"${i}" for i in range(1, count + 1))), mark)
    return F.transform(F.array(parts), lambda p: F.when(F.size(p) == count, F.transform(p, lambda x: F.trim(x))))[0]


def _once(*columns: Column) -> Column:
    """Compute columns in a generator, so a filter on them does not repeat them."""
    return F.inline(F.array(F.struct(*columns)))


def _segment(text: Column) -> Column:
    """One ``Name POS • TEAM - Action`` segment as a struct, null if malformed."""
    found = F.transform(F.array(_fields(text, SEGMENT, 4)), lambda g: F.when(g.isNotNull(), F.struct(
        g[0].alias("player"), g[1].alias("positions"), g[2].alias("mlb_team"), _kind(g[3]).alias("action"),
        F.when(g[3].startswith("Traded"), F.trim(F.regexp_replace(g[3], r"^Traded (?:from|to) ", ""))).alias("counterparty"))))
    return found[0]


def _known(teams: list[str] | None, team: Column) -> Column:
    return team.isin(*teams) if teams else team != ""


def transactions(lines: DataFrame, teams: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``DATE|TEAM|PLAYERS|EFFECTIVE|COST``; a ``|`` inside the players cell is kept."""
    cells = _cells(F.col("line"))
    rows = lines.withColumn("c", cells).where((F.size("c") >= 5) & ~F.lower(F.get("c", F.lit(0))).isin("date"))
    n = F.size("c")
    rows = rows.select(
        *lines.columns, F.get("c", F.lit(0)).alias("stamp"), F.get("c", F.lit(1)).alias("team"),
        F.array_join(F.slice("c", F.lit(3), F.greatest(n - 4, F.lit(0))), "|").alias("players"),
        F.element_at("c", -2).alias("effective"), F.element_at("c", -1).alias("paid"))
    posted = calendars.posted_at(F.regexp_extract("stamp", r"^(\d{1,2}/\d{1,2}/\d{2} \d{1,2}:\d{2} [AP]M) ET$", 1))
    rows = rows.select(*lines.columns, "team", _once(
        posted.alias("posted_at"), F.transform(F.split("players", "; "), lambda s: _segment(F.trim(s))).alias("actions"),
        calendars.short_date(F.col("effective")).alias("effective_date"),
        F.when(F.col("paid").startswith("$"), F.ltrim(F.translate("paid", "$", "")).try_cast("decimal(9,2)")).alias("cost")))
    fine = F.col("posted_at").isNotNull() & _known(teams, F.col("team")) & F.forall("actions", lambda a: a.isNotNull())
    return rows.where(fine), rows.where(~F.coalesce(fine, F.lit(False))).select(*lines.columns)


# The old page dictates these patterns; its segments follow each other without a separator.
OLD_SEGMENT = (
    r"([A-Z][^|•�]*?)\s+([A-Z0-9]{1,2}(?:,[A-Z0-9]{1,2})*)\s*[•�|]\s*([A-Z]{2,3})\s*-?\s*"
    r"(Added off Waivers|Added|Dropped|Moved to IR|Move to Injured|Moved to Minors|Sent to Minors|"
    r"Activated|Called Up|Traded (?:from|to) [A-Za-z' ]+?)(?=\s+[A-Z][a-z'.]|\s*$)"
)
OLD_HEADER = r"^(\d{1,2}/\d{1,2}/\d{2} \d{1,2}:\d{2} [AP]M) ET (.+)$"
OLD_TAIL = r"\s*(\d{1,2}/\d{1,2}/\d{2})?\s*(?:\$(\d+\.\d{2}))?\s*$"


def _full_team(part: Column, teams: list[str]) -> Column:
    """The known team a clipped counterparty stands for."""
    known = F.filter(F.array(*[F.lit(t) for t in teams]), lambda t: t.startswith(part) | part.startswith(t))
    return F.coalesce(F.get(known, F.lit(0)), part)


def transactions_old(lines: DataFrame, teams: list[str]) -> tuple[DataFrame, DataFrame]:
    """One transaction over several lines; bare lines continue the one above.

    A line knows its transaction by the header position carried down to it, so
    continuation lines in the next block still find their header.
    """
    team_head = "|".join(t.replace("'", ".") for t in sorted(teams, key=len, reverse=True))
    text = F.trim("line")
    body = F.when(text.rlike(OLD_HEADER), F.regexp_extract(text, OLD_HEADER, 2))
    rows = lines.select(*lines.columns, text.alias("text"), body.alias("rest"))
    rows = rows.withColumn("team", F.when(F.col("rest").isNotNull(), F.regexp_extract("rest", f"^({team_head})", 1)))
    rows = rows.withColumn("payload", F.when(F.col("rest").isNull(), F.col("text")).otherwise(
        F.trim(F.expr("substring(rest, length(team) + 1)"))))
    # Few lines end with a date or a fee; the others are spared the search for them.
    ended = F.col("payload").rlike(r"[\d\s]$")
    tail = lambda i: F.when(ended, F.regexp_extract("payload", OLD_TAIL, i)).otherwise("")
    bare = F.when(ended, F.regexp_replace("payload", OLD_TAIL, "")).otherwise(F.col("payload"))
    whole = F.regexp_extract_all(bare, F.lit(OLD_SEGMENT), F.lit(0))
    found = F.transform(whole, lambda s: _segment(F.regexp_replace(F.trim(s), r"\s+", " ")))
    rows = rows.select(*lines.columns, "text", "rest", "team", _once(
        calendars.short_date(F.nullif(tail(1), F.lit(""))).alias("effective"), F.nullif(tail(2), F.lit("")).try_cast("decimal(9,2)").alias("paid"),
        F.filter(found, lambda s: s.isNotNull()).alias("segments")))
    rows = rows.withColumn("segments", F.transform("segments", lambda s: s.withField("counterparty", _full_team(s["counterparty"], teams))))
    header = F.col("rest").isNotNull()
    good = header & (F.col("team") != "") & (F.size("segments") > 0)
    rejects = rows.where(header & ~good).select(*lines.columns)
    start = F.when(good, F.struct(*ORDER))
    used = rows.withColumn("start", start).where(good | (~header & (F.size("segments") > 0)))
    # Read twice below, for what a block hands on and for its lines; the patterns run once.
    used = stored(used.select("path", *ORDER, "text", "team", "effective", "paid", "segments", "start"), "segments")
    used = scan.fill_forward(used, ["path"], ORDER, F.col("blk"), {"start": "head"}).where(F.col("head").isNotNull())
    key = F.struct(*ORDER)
    txns = used.groupBy("path", "head").agg(
        calendars.posted_at(F.regexp_extract(F.min_by("text", key), OLD_HEADER, 1)).alias("posted_at"),
        F.min_by("team", key).alias("team"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), "segments"))), lambda x: x["segments"])).alias("actions"),
        F.max_by("effective", F.when(F.col("effective").isNotNull(), key)).alias("effective_date"),
        F.max_by("paid", F.when(F.col("paid").isNotNull(), key)).alias("cost"))
    return txns.select("path", F.col("head.blk").alias("blk"), F.col("head.pos").alias("pos"), "posted_at", "team",
                       "actions", "effective_date", "cost"), rejects


def is_delimited(lines: DataFrame, mark: str = "|") -> DataFrame:
    """Per file: does its first body line use the delimited layout?"""
    return lines.where(F.trim("line") != "").groupBy("path").agg(
        F.contains(F.min_by("line", F.struct(*ORDER)), F.lit(mark)).alias("delimited"))


def sniffed_transactions(lines: DataFrame, teams: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both layouts in one set of files, each file read by its own parser."""
    flagged = lines.join(is_delimited(lines), "path")
    new, bad_new = transactions(flagged.where("delimited").drop("delimited"), teams)
    old, bad_old = transactions_old(flagged.where(~F.col("delimited")).drop("delimited"), teams)
    columns = ["path", *ORDER, "posted_at", "team", "actions", "effective_date", "cost"]
    return new.select(*columns).unionByName(old.select(*columns)), bad_new.unionByName(bad_old)


def _is_player(text: Column) -> Column:
    """Player cell test; lines without a bullet never reach the pattern."""
    return (F.contains(text, F.lit("•")) | F.contains(text, F.lit("\ufffd"))) & text.rlike(PLAYER_CELL)


def _player(cell: Column) -> list[Column]:
    part = lambda i: F.trim(F.regexp_extract(cell, PLAYER_CELL, i))
    return [part(1).alias("player"), F.split(part(2), ",").alias("positions"), part(3).alias("mlb_team")]


def pool(lines: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Availability table: 15 numeric stats, flag and clear date, bad numbers null."""
    names = BAT_COLUMNS if kind == "bat" else PIT_COLUMNS
    width = 5 + len(names)
    c = lambda i: F.get("c", F.lit(i))
    rows = lines.withColumn("c", F.split("line", r"\|"))
    heading = F.contains("line", F.lit("Avail|Player")) | F.col("line").startswith("ACTION|") | F.col("line").startswith("RANK|")
    shaped = F.size("c") == width
    # A header row of full width is dropped, not reported.
    rows = rows.where((F.trim("line") != "") & ~heading & ~(shaped & F.coalesce(c(3) == "Player", F.lit(False))))
    fine = shaped & F.coalesce(F.trim(c(3)).rlike(PLAYER_CELL), F.lit(False))
    wait = F.regexp_extract(F.trim(c(2)), WAIVER_CELL, 1)
    stats = F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]), F.transform(F.slice("c", 5, len(names)), lambda v: v.try_cast("double")))
    out = rows.where(fine).select(
        "path", *ORDER, F.when(c(0) != "", c(0)).alias("strong_id"), F.when(c(1) != "", c(1)).alias("add_pos"),
        F.when(wait != "", "W").otherwise(F.trim(c(2))).alias("avail"), F.when(wait != "", wait).alias("waiver_clear"),
        *_player(F.trim(c(3))), stats.alias("stats"), c(width - 1).try_cast("int").alias("rank"))
    return out, rows.where(~fine).select(*lines.columns)


def standings_page(lines: DataFrame) -> DataFrame:
    """Raw tab-delimited page → tidy (side, metric, team, value, points)."""
    text = F.trim("line")
    cells = F.transform(F.split("line", "\t"), lambda c: F.trim(c))
    side = F.when(text == "Batting Breakdown", "BATTING").when(text == "Pitching Breakdown", "PITCHING")
    code = F.when((F.size(cells) == 4) & (F.get(cells, F.lit(0)) == "TEAM"), F.get(cells, F.lit(1)))
    rows = lines.select(*lines.columns, cells.alias("c"), side.alias("s"), code.alias("m"))
    rows = scan.fill_forward(rows, ["path"], ORDER, F.col("blk"), {"s": "side", "m": "metric"})
    c = lambda i: F.get("c", F.lit(i))
    data = (F.size("c") == 4) & (c(0) != "TEAM") & (c(0) != "") & (c(1) != "") & (c(2) != "") & F.col("metric").isNotNull()
    return rows.where(data).select("path", "side", "metric", c(0).alias("team"), c(1).try_cast("double").alias("value"),
                                   c(2).try_cast("double").alias("points"))


def overall_page(lines: DataFrame) -> DataFrame:
    """The seven-column rank block above the first breakdown of the raw page."""
    text = F.trim("line")
    cells = F.transform(F.split("line", "\t"), lambda c: F.trim(c))
    rows = lines.select(*lines.columns, cells.alias("c"), F.when(text.rlike("^(Batting|Pitching) Breakdown$"), 1).alias("b"))
    rows = scan.fill_forward(rows, ["path"], ORDER, F.col("blk"), {"b": "broken"})
    c = lambda i: F.get("c", F.lit(i))
    keep = F.col("broken").isNull() & (F.size("c") == 7) & c(0).rlike(r"^\d+$")
    return rows.where(keep).select("path", c(0).cast("int").alias("rank"), c(1).alias("team"), c(2).try_cast("double").alias("batting"),
                                   c(3).try_cast("double").alias("pitching"), c(4).try_cast("double").alias("total"))


def standings_text(lines: DataFrame) -> DataFrame:
    """``BATTING: HR`` heading then ``Team value points`` joined by ``|``."""
    text = F.trim("line")
    code = F.when(text.startswith("OVERALL"), "OVERALL").otherwise(
        F.when(text.rlike(r"^(BATTING|PITCHING): [A-Z]+$"), F.regexp_extract(text, r": ([A-Z]+)$", 1)))
    rows = scan.fill_forward(lines.withColumn("m", code), ["path"], ORDER, F.col("blk"), {"m": "metric"})
    body = rows.where(F.col("metric").isNotNull() & F.col("m").isNull() & (F.col("metric") != "OVERALL"))
    cell = body.select("path", "metric", F.explode(F.split("line", r"\|")).alias("cell"))
    pattern = r"^\s*(.+?) ([.\d]+) ([\d.]+)\s*$"
    part = lambda i: F.regexp_extract("cell", pattern, i)
    return cell.where(F.col("cell").rlike(pattern)).select(
        "path", "metric", F.trim(part(1)).alias("team"), part(2).cast("double").alias("value"), part(3).cast("double").alias("points"))


def by_period(lines: DataFrame, teams: list[str] | None = None) -> DataFrame:
    """``=== Period n`` sections; the first of repeated metric tables counts."""
    text = F.trim("line")
    period = F.when(text.rlike(r"^=== Period \d+ "), F.regexp_extract(text, r"^=== Period (\d+) ", 1).cast("int"))
    cells = _cells(text)
    head = F.get(cells, F.lit(0))
    code = F.when(head.isin("Rank", "Team"), F.when((head == "Team") & (F.size(cells) == 4), F.get(cells, F.lit(1))).otherwise(""))
    rows = lines.select(*lines.columns, cells.alias("c"), period.alias("p"), F.when(period.isNotNull(), "").otherwise(code).alias("m"))
    rows = scan.fill_forward(rows, ["path"], ORDER, F.col("blk"), {"p": "period", "m": "metric"})
    c = lambda i: F.get("c", F.lit(i))
    data = rows.where(
        F.col("period").isNotNull() & (F.col("metric") != "") & F.col("m").isNull() & (F.size("c") == 4) & _known(teams, c(0)))
    keyed = data.select("path", "period", "metric", c(0).alias("team"), F.struct(*ORDER).alias("at"), F.struct(
        c(1).try_cast("double").alias("value"), c(2).try_cast("double").alias("points"), c(3).try_cast("double").alias("dif")).alias("v"))
    first = keyed.groupBy("path", "period", "metric", "team").agg(F.min_by("v", "at").alias("v"))
    return first.select("path", "period", "metric", "team", "v.*")


def lineups(lines: DataFrame, teams: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Five columns, or six when the file carries a strong id."""
    rows = lines.where(F.trim("line") != "").withColumn("c", F.split("line", r"\|"))
    c = lambda i: F.get("c", F.lit(i))
    cell = F.trim(F.element_at("c", -1))
    fine = F.size("c").isin(5, 6) & _known(teams, c(0)) & cell.rlike(PLAYER_CELL) & c(1).try_cast("int").isNotNull()
    out = rows.where(fine).select(
        "path", *ORDER, c(0).alias("team"), c(1).cast("int").alias("period"), c(2).alias("section"), c(3).alias("slot"),
        *_player(cell), F.when((F.size("c") == 6) & (c(4) != ""), c(4)).alias("strong_id"))
    return out, rows.where(~F.coalesce(fine, F.lit(False))).select(*lines.columns)


def _tagged(names: Column) -> Column:
    """Player label and status of every name in a grid cell."""
    tags = F.create_map(*[F.lit(x) for kv in GRID_TAGS.items() for x in kv])
    clean = F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != "")
    return F.transform(clean, lambda n: F.struct(
        F.trim(F.regexp_replace(n, r"\(([RIM])\)$", "")).alias("label"),
        F.coalesce(F.try_element_at(tags, F.regexp_extract(n, r"\(([RIM])\)$", 1)), F.lit("active")).alias("status")))


def roster_grid(lines: DataFrame, teams: list[str] | None = None) -> DataFrame:
    """Wide ``TEAM|C|1B|…`` rows → (team, slot_group, label, status)."""
    rows = lines.withColumn("c", _cells(F.col("line"))).where(F.size("c") >= 5)
    head = F.lower(F.get("c", F.lit(0))) == "team"
    rows = rows.withColumn("h", F.when(head, F.col("c")))
    rows = scan.fill_forward(rows, ["path"], ORDER, F.col("blk"), {"h": "slots"})
    body = rows.where(~head & F.col("slots").isNotNull() & _known(teams, F.get("c", F.lit(0))))
    cells = body.select("path", F.get("c", F.lit(0)).alias("team"), F.posexplode(F.slice("c", F.lit(2), F.size("c") - 1)).alias("i", "cell"), "slots")
    named = cells.select("path", "team", F.get("slots", F.col("i") + 1).alias("slot_group"), F.explode(_tagged(F.split("cell", "; "))).alias("e"))
    return named.select("path", "team", "slot_group", "e.*")


def roster_grid_old(lines: DataFrame, teams: list[str]) -> DataFrame:
    """A team line, then ``SLOT: name, name(R) | SLOT: …`` lines."""
    text = F.trim("line")
    rows = lines.where(~text.rlike("^(source:|captured:|legend:)") & (text != "")).withColumn(
        "t", F.when(text.isin(*teams), text))
    rows = scan.fill_forward(rows, ["path"], ORDER, F.col("blk"), {"t": "team"})
    parts = rows.where(F.col("t").isNull() & F.col("team").isNotNull()).select(
        "path", "team", F.explode(F.split(text, r" \| ")).alias("part")).where(F.contains("part", F.lit(":")))
    named = parts.select("path", "team", F.trim(F.regexp_extract("part", r"^([^:]*):", 1)).alias("slot_group"),
                         F.explode(_tagged(F.split(F.regexp_replace("part", r"^[^:]*:", ""), ","))).alias("e"))
    return named.select("path", "team", "slot_group", "e.*")


# Fixed value: a line of the draft page.
DRAFT_LINE = r"^(\d{1,2}) (.+?) ([A-Z0-9]{1,3}(?:,[A-Z0-9]{1,3})*) [•�] ([A-Z]{2,3})\b"


def draft(lines: DataFrame, teams: list[str]) -> tuple[DataFrame, DataFrame]:
    """Round headings, numbered picks, stars for auto and queued picks; the
    chat log after a ``===`` line is not part of the draft."""
    text = F.trim("line")
    rnd = F.when(text.rlike(r"^ROUND \d+$"), F.regexp_extract(text, r"^ROUND (\d+)$", 1).cast("int"))
    chat = F.when(text.startswith("==="), 1)
    rows = lines.select(*lines.columns, text.alias("text"), rnd.alias("r"), chat.alias("x"))
    rows = scan.fill_forward(rows, ["path"], ORDER, F.col("blk"), {"r": "round", "x": "chat"})
    rows = rows.where(F.col("round").isNotNull() & F.col("chat").isNull() & F.col("r").isNull() & (F.col("text") != ""))
    heads = "|".join(t.replace("'", ".") for t in sorted(teams, key=len, reverse=True))
    part = lambda i: F.regexp_extract("text", DRAFT_LINE, i)
    rows = rows.withColumn("team", F.regexp_extract(part(2), f"^({heads})", 1))
    fine = F.col("text").rlike(DRAFT_LINE) & (F.col("team") != "")
    name = F.trim(F.expr("substring(rest, length(team) + 1)"))
    good = rows.where(fine).withColumn("rest", part(2)).withColumn("name", name)
    pick = part(1).cast("int")
    picks = good.select(
        "path", "round", pick.alias("pick_in_round"), ((F.col("round") - 1) * len(teams) + pick).alias("overall"), "team",
        F.trim(F.regexp_replace("name", r"^\*+", "")).alias("player"), F.split(part(3), ",").alias("positions"), part(4).alias("mlb_team"),
        (F.col("name").startswith("*") & ~F.col("name").startswith("**")).alias("auto"), F.col("name").startswith("**").alias("queued"))
    return picks, rows.where(~fine).select(*lines.columns)


def news(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of player line, headline, byline and ``(age) body`` lines; bodies are kept whole."""
    text = F.trim("line")
    rows = lines.select(*lines.columns, text.alias("text"), F.when(_is_player(text), F.struct(*ORDER)).alias("p"))
    rows = scan.fill_forward(rows, ["path"], ORDER, F.col("blk"), {"p": "head"}).where(F.col("head").isNotNull())
    at = F.struct(*ORDER)
    blocks = rows.groupBy("path", "head").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "text"))).alias("l"))
    line = lambda i: F.get("l", F.lit(i))["text"]
    by = F.lower(F.coalesce(line(2), F.lit(""))).startswith("by ")
    rest = F.transform(F.slice("l", F.when(by, 4).otherwise(3), F.size("l")), lambda x: x["text"])
    body = F.array_join(F.filter(rest, lambda x: x != ""), " ")
    blocks = blocks.where(F.size("l") >= 3).select(
        "path", F.col("head.blk").alias("blk"), F.col("head.pos").alias("pos"), line(0).alias("line"), line(1).alias("headline"), body.alias("b"))
    aged = r"^\(([^)]+)\)\s*"
    out = blocks.select(
        "path", *ORDER, "line", *_player(F.col("line")), "headline", F.regexp_extract("b", aged, 1).alias("age_text"),
        F.regexp_replace("b", aged, "").alias("body"))
    fine = F.contains("headline", F.lit(":"))
    return out.where(fine).drop("line"), out.where(~fine).select("path", *ORDER, "line")


def corrections(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hand-kept JSON lines: trades that the transaction log lacks.

    Returns (effective, player, from_team, to_team, pos) and the lines that are
    no such correction.  ``pos`` keeps the order of the log.
    """
    fields = "type string, effective_date string, player string, from_team string, to_team string"
    rows = lines.where(F.trim("line") != "").withColumn("c", F.from_json("line", fields))
    day = F.to_date(F.regexp_extract(F.coalesce("c.effective_date", F.lit("")), r"^\d{4}-\d{2}-\d{2}$", 0).try_cast("date"))
    rows = rows.withColumn("effective", day)
    whole = F.col("c.player").isNotNull() & F.col("c.from_team").isNotNull() & F.col("c.to_team").isNotNull()
    fine = F.coalesce((F.col("c.type") == "trade_unlogged") & F.col("effective").isNotNull() & whole, F.lit(False))
    good = rows.where(fine).select("pos", "effective", "c.player", "c.from_team", "c.to_team")
    return good, rows.where(~fine).select(*lines.columns)

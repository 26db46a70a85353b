"""Capture parsers over lines that Spark writes from the driver tables.

Each query renders a table in one of the captured layouts and parses it back;
the SQL states the expected rows straight from the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from contestlake.functions.rates import fixed
from contestlake.operators import scan
from contestlake.plans import league as L
from contestlake.plans import standings as P
from contestlake.plans.registry import query
from contestlake.sources import captures as C

TEAMS = ["Alpha Dogs", "Beta", "Cape Codders", "Delta Force", "Echo"]
_SQL_TEAM = "list_extract(['Alpha Dogs','Beta','Cape Codders','Delta Force','Echo'], cast({k}%5 AS integer)+1)"
_VERBS = ["Added", "Added off Waivers", "Dropped", "Moved to IR", "Activated", "Sent to Minors", "Called Up"]
_KINDS = ["add", "claim_add", "drop", "move_to_il", "move_from_il", "move_to_minors", "move_from_minors"]


def _team(k):
    return F.get(F.array(*[F.lit(t) for t in TEAMS]), (k % 5).cast("int"))


def _verb(k):
    return F.get(F.array(*[F.lit(v) for v in _VERBS]), (k % 7).cast("int"))


def _lines(df, line, pos, per_file=4096, per_block=512):
    return df.select(
        F.concat(F.lit("capture-"), F.floor(pos / per_file).cast("string")).alias("path"),
        (F.floor(pos / per_block) % (per_file // per_block)).alias("blk"), pos.alias("pos"), line.alias("line"))


def _orders(spark, sf):
    k = F.col("o_orderkey")
    minutes = F.make_dt_interval(mins=(k % 1440).cast("int"))
    return L.table(spark, sf, "orders").select(
        k.alias("k"), "o_custkey", "o_orderdate", (F.col("o_orderdate") + minutes).alias("posted"))


def _log_lines(spark, sf):
    o = _orders(spark, sf)
    k = F.col("k")
    first = F.concat(F.lit("Joé O'Neil"), F.col("o_custkey").cast("string"), F.lit(" 1B,OF • NYY - "), _verb(k))
    second = F.concat(F.lit("; Al. Ruiz"), k.cast("string"), F.lit(" P | BOS - "),
                      F.when(k % 3 == 0, F.concat(F.lit("Traded from "), _team(k + 1))).otherwise("Dropped"))
    players = F.when(k % 17 == 0, F.lit("no segment here")).otherwise(F.concat(first, F.when(k % 2 == 0, second).otherwise("")))
    line = F.concat_ws("|", F.concat(F.date_format("posted", "M/d/yy h:mm a"), F.lit(" ET")), _team(k), players,
                       F.date_format("o_orderdate", "M/d/yy"),
                       F.when(k % 4 == 0, F.concat(F.lit("$"), F.format_string("%.2f", (k % 10) * 2.5))).otherwise(""))
    return _lines(o, line, k)


@query("parse_transaction_log", f"""
SELECT o_orderkey AS pos, o_orderdate + to_minutes(cast(o_orderkey%1440 AS integer)) AS posted_at, {_SQL_TEAM.format(k='o_orderkey')} AS team,
 cast(o_orderdate AS date) AS effective_date, CASE WHEN o_orderkey%4=0 THEN cast((o_orderkey%10)*2.5 AS double) END AS cost,
 CASE WHEN o_orderkey%2=0 THEN 2 ELSE 1 END AS n_actions, 'Joé O''Neil'||o_custkey AS first_player,
 list_extract({_KINDS}, cast(o_orderkey%7 AS integer)+1) || CASE WHEN o_orderkey%2=0 THEN CASE WHEN o_orderkey%3=0 THEN ';trade' ELSE ';drop' END ELSE '' END AS kinds,
 CASE WHEN o_orderkey%2=0 AND o_orderkey%3=0 THEN {_SQL_TEAM.format(k='(o_orderkey+1)')} END AS counterparty
FROM orders WHERE o_orderkey%17<>0""")
def parse_transaction_log(spark, sf):
    rows, _ = C.transactions(_log_lines(spark, sf), TEAMS)
    return rows.select(
        "pos", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), "team", "effective_date", F.col("cost").cast("double").alias("cost"),
        F.size("actions").alias("n_actions"), F.get("actions", F.lit(0))["player"].alias("first_player"),
        F.array_join(F.transform("actions", lambda a: a["action"]), ";").alias("kinds"),
        F.get("actions", F.lit(1))["counterparty"].alias("counterparty"))


@query("transaction_rejects", "SELECT o_orderkey AS pos FROM orders WHERE o_orderkey%17=0")
def transaction_rejects(spark, sf):
    return C.transactions(_log_lines(spark, sf), TEAMS)[1].select("pos")


def _folded(spark, sf):
    """An order is a header line, its parts are continuation lines."""
    head = _orders(spark, sf).select(
        "k", F.lit(0).cast("long").alias("n"),
        F.concat(F.date_format("posted", "M/d/yy h:mm a"), F.lit(" ET "), _team(F.col("k")), F.lit(" Joe Neil C • NYY - "),
                 _verb(F.col("k"))).alias("text"))
    part = L.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n")).distinct()
    # Line 1 is boilerplate; line 2 ends with a date and a fee.
    text = F.when(F.col("n") == 1, "View transaction details").otherwise(
        F.concat(F.lit("Al Ruiz P • BOS - Dropped"), F.when(F.col("n") == 2, F.lit(" 5/6/98 $2.50")).otherwise("")))
    every = head.unionByName(part.select("k", "n", text.alias("text")))
    return _lines(every, F.col("text"), F.col("k") * 100 + F.col("n"), 409600, 25600)


@query("parse_folded_transactions", f"""
WITH p AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber) FILTER (WHERE l_linenumber>1) AS extra,
  max(CASE WHEN l_linenumber=2 THEN 1 ELSE 0 END) AS tail FROM lineitem GROUP BY 1)
SELECT o_orderkey*100 AS pos, o_orderdate + to_minutes(cast(o_orderkey%1440 AS integer)) AS posted_at, {_SQL_TEAM.format(k='o_orderkey')} AS team,
 1+coalesce(extra,0) AS n_actions, CASE WHEN tail=1 THEN DATE '1998-05-06' END AS effective_date, CASE WHEN tail=1 THEN cast(2.5 AS double) END AS cost
FROM orders LEFT JOIN p ON k=o_orderkey""")
def parse_folded_transactions(spark, sf):
    rows, _ = C.transactions_old(_folded(spark, sf), TEAMS)
    return rows.select("pos", F.col("posted_at").cast("timestamp_ntz").alias("posted_at"), "team", F.size("actions").alias("n_actions"),
                       "effective_date", F.col("cost").cast("double").alias("cost"))


@query("sniffed_layouts", """
WITH p AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber) FILTER (WHERE l_linenumber>1) AS extra FROM lineitem GROUP BY 1)
SELECT 'new' AS layout, o_orderkey AS pos, CASE WHEN o_orderkey%2=0 THEN 2 ELSE 1 END AS n_actions FROM orders WHERE o_orderkey%17<>0
UNION ALL SELECT 'old', o_orderkey*100, 1+coalesce(extra,0) FROM orders LEFT JOIN p ON k=o_orderkey""")
def sniffed_layouts(spark, sf):
    old = _folded(spark, sf).withColumn("path", F.concat(F.lit("old-"), "path"))
    new = _log_lines(spark, sf).withColumn("path", F.concat(F.lit("new-"), "path"))
    rows, _ = C.sniffed_transactions(new.unionByName(old), TEAMS)
    return rows.select(F.substring("path", 1, 3).alias("layout"), "pos", F.size("actions").alias("n_actions"))


@query("parse_pool_table", """
SELECT p_partkey AS pos, cast(p_partkey AS varchar) AS strong_id, CASE WHEN p_partkey%3=0 THEN 'W' ELSE 'FA' END AS avail,
 CASE WHEN p_partkey%3=0 THEN '8/'||(1+p_partkey%28) END AS waiver_clear, p_name AS player, cast(p_size AS double) AS ab,
 CASE WHEN p_partkey%5<>0 THEN cast(p_retailprice AS double) END AS hr, CASE WHEN p_partkey%7<>0 THEN cast(p_partkey AS integer) END AS rank
FROM part WHERE p_partkey%19<>0""")
def parse_pool_table(spark, sf):
    k = F.col("p_partkey")
    stats = ["p_size", "1", "2", "3", "4", "5", None, "7", "8", "9", "10", "11", ".250", ".330", ".400"]
    cells = [k.cast("string"), F.lit(""), F.when(k % 3 == 0, F.concat(F.lit("W (8/"), (1 + k % 28).cast("string"), F.lit(")"))).otherwise("FA"),
             F.when(k % 19 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" OF • NYY")))]
    for s in stats:
        if s is None:
            cells.append(F.when(k % 5 == 0, "--").otherwise(F.col("p_retailprice").cast("string")))
        elif s == "p_size":
            cells.append(F.col("p_size").cast("string"))
        else:
            cells.append(F.lit(s))
    cells.append(F.when(k % 7 == 0, "n/a").otherwise(k.cast("string")))
    lines = _lines(L.table(spark, sf, "part"), F.concat_ws("|", *cells), k)
    rows, _ = C.pool(lines, "bat")
    return rows.select("pos", "strong_id", "avail", "waiver_clear", "player", F.col("stats")["ab"].alias("ab"), F.col("stats")["hr"].alias("hr"), "rank")


def _board(spark, sf):
    values = P.S.period_values(L.components(spark, sf), L.METRICS)
    return P.S.board(values, ["period"]).select(
        "entity", "period", "metric", F.format_string("%.4f", "value").alias("value"), F.format_string("%.1f", "points").alias("points"))


def _sections(spark, sf, heading, row, table_head):
    """Render period boards as sectioned lines; every table is printed twice."""
    body = _board(spark, sf)
    order = F.array_position(F.array(*[F.lit(m.code) for m in L.METRICS]), F.col("metric"))
    twice = body.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = twice.select("period", (order * 100 + F.col("copy") * 1000 + 10 + F.col("entity")).alias("at"), row.alias("line"))
    tables = twice.select("period", (order * 100 + F.col("copy") * 1000).alias("at"), table_head.alias("line")).distinct()
    heads = body.select("period", F.lit(-1).cast("long").alias("at"), heading.alias("line")).distinct()
    every = rows.unionByName(tables).unionByName(heads)
    return every.select(F.lit("standings").alias("path"), F.col("period").alias("blk"), "at", "line").withColumnRenamed("at", "pos")


@query("parse_by_period", P.WITH + """
, v AS (""" + L.sql_metrics("comp", "entity, period") + """), b AS (SELECT *, """ + L.sql_points("period, metric") + """ AS points FROM v)
SELECT period, metric, 'T'||entity AS team, value, points FROM b""")
def parse_by_period(spark, sf):
    lines = _sections(
        spark, sf, F.concat(F.lit("=== Period "), F.col("period").cast("string"), F.lit(" (final) ===")),
        F.concat_ws("|", F.concat(F.lit("T"), F.col("entity").cast("string")), "value", "points", F.lit("0")),
        F.concat_ws("|", F.lit("Team"), "metric", F.lit("Pts"), F.lit("Dif")))
    return C.by_period(lines).select("period", "metric", "team", "value", "points")


@query("parse_standings_page", P.WITH + """
, v AS (""" + L.sql_metrics("comp", "entity, period") + """), b AS (SELECT *, """ + L.sql_points("period, metric") + """ AS points FROM v)
SELECT period, CASE WHEN metric IN ('DISC','PPU') THEN 'PITCHING' ELSE 'BATTING' END AS side, metric, 'T'||entity AS team, value, points FROM b""")
def parse_standings_page(spark, sf):
    """One page per period."""
    body = _board(spark, sf)
    order = F.array_position(F.array(*[F.lit(m.code) for m in L.METRICS]), F.col("metric"))
    rows = body.select("period", (order * 100 + 10 + F.col("entity")).alias("pos"), F.concat_ws(
        "\t", F.concat(F.lit("T"), F.col("entity").cast("string")), "value", "points", F.lit("0")).alias("line"))
    heads = body.select("period", (order * 100).alias("pos"), F.concat_ws("\t", F.lit("TEAM"), "metric", F.lit("PTS"), F.lit("DIF")).alias("line")).distinct()
    sides = body.select("period", F.when(F.col("metric").isin("DISC", "PPU"), 499).otherwise(1).cast("long").alias("pos"), F.when(
        F.col("metric").isin("DISC", "PPU"), "Pitching Breakdown").otherwise("Batting Breakdown").alias("line")).distinct()
    lines = rows.unionByName(heads).unionByName(sides).select(
        F.concat(F.lit("page-"), F.col("period").cast("string")).alias("path"), F.floor(F.col("pos") / 100).alias("blk"), "pos", "line")
    out = C.standings_page(lines)
    return out.select(F.substring_index("path", "-", -1).cast("int").alias("period"), "side", "metric", "team", "value", "points")


@query("parse_lineups", f"""
SELECT o_orderkey AS pos, {_SQL_TEAM.format(k='o_orderkey')} AS team, cast(1+o_orderkey%27 AS integer) AS period, CASE WHEN o_orderkey%4=0 THEN 'bench' ELSE 'active' END AS section,
 'Customer '||o_custkey AS player, CASE WHEN o_orderkey%2=0 THEN cast(o_custkey AS varchar) END AS strong_id FROM orders WHERE o_orderkey%23<>0""")
def parse_lineups(spark, sf):
    k = F.col("k")
    o = _orders(spark, sf)
    cust = F.col("o_custkey").cast("string")
    cell = F.concat(F.lit("Customer "), cust, F.when(k % 23 == 0, "").otherwise(" OF,1B • NYY"))
    line = F.concat_ws("|", _team(k), (1 + k % 27).cast("string"), F.when(k % 4 == 0, "bench").otherwise("active"), F.lit("OF"),
                       F.when(k % 2 == 0, cust), cell)
    rows, _ = C.lineups(_lines(o, line, k), TEAMS)
    return rows.select("pos", "team", "period", "section", "player", "strong_id")


@query("parse_roster_grid", """
SELECT 'Cust '||c_custkey AS team, slot_group, label, status FROM customer,
 (VALUES ('C','Al Ruiz','active'),('C','Bo Diaz','il'),('OF','Cy Young','minors')) t(slot_group,label,status)
UNION ALL SELECT 'Cust '||c_custkey, 'P', 'D Rush'||c_custkey, 'reserve' FROM customer WHERE c_custkey%2=0""")
def parse_roster_grid(spark, sf):
    k = F.col("c_custkey")
    body = L.table(spark, sf, "customer").select(k.alias("k"), F.concat_ws(
        "|", F.concat(F.lit("Cust "), k.cast("string")), F.lit("Al Ruiz; Bo Diaz (I)"), F.lit(""), F.lit("Cy Young (M)"),
        F.when(k % 2 == 0, F.concat(F.lit("D Rush"), k.cast("string"), F.lit(" (R)"))).otherwise("")).alias("line"))
    heads = body.select((F.floor(F.col("k") / 100) * 100).alias("k"), F.lit("TEAM|C|1B|OF|P").alias("line")).distinct()
    lines = body.select((F.col("k") * 2 + 1).alias("pos"), "line").unionByName(heads.select((F.col("k") * 2).alias("pos"), "line"))
    lines = lines.select(F.lit("grid").alias("path"), F.floor(F.col("pos") / 64).alias("blk"), "pos", "line")
    return C.roster_grid(lines).drop("path")


@query("parse_draft", f"""
SELECT cast(p_partkey//5+1 AS integer) AS round, cast(p_partkey%5+1 AS integer) AS pick_in_round, cast(p_partkey+1 AS integer) AS overall,
 {_SQL_TEAM.format(k='p_partkey')} AS team, p_name AS player, p_partkey%7=0 AS auto, p_partkey%7=1 AS queued FROM part""")
def parse_draft(spark, sf):
    k = F.col("p_partkey")
    parts = L.table(spark, sf, "part")
    star = F.when(k % 7 == 0, "*").when(k % 7 == 1, "**").otherwise("")
    body = parts.select((F.floor(k / 5) * 10 + 1 + k % 5).alias("pos"), F.concat(
        (k % 5 + 1).cast("string"), F.lit(" "), _team(k), F.lit(" "), star, "p_name", F.lit(" C,1B • NYY rest")).alias("line"))
    heads = parts.select((F.floor(k / 5) * 10).alias("pos"), F.concat(F.lit("ROUND "), (F.floor(k / 5) + 1).cast("string")).alias("line")).distinct()
    chat = parts.agg((F.max(k) * 10 + 100).alias("pos")).select("pos", F.lit("=== chat ===").alias("line"))
    noise = chat.select((F.col("pos") + 1).alias("pos"), F.lit("1 Beta hello C • NYY").alias("line"))
    lines = body.unionByName(heads).unionByName(chat).unionByName(noise).select(
        F.lit("draft").alias("path"), F.floor(F.col("pos") / 256).alias("blk"), "pos", "line")
    return C.draft(lines, TEAMS)[0].drop("path", "positions", "mlb_team")


@query("parse_news", r"""
WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32)||chr(9)||chr(13))), lambda x: x<>'') AS l FROM documents),
b AS (SELECT doc_id, array_to_string(l, ' ') AS body FROM t)
SELECT doc_id AS pos, 'Doc D'||doc_id AS player, 'Club''s Doc: report '||doc_id AS headline, (doc_id%60)||' mins ago' AS age_text,
 length(body) AS body_len, md5(body) AS body_md5 FROM b WHERE doc_id%9<>0""")
def parse_news(spark, sf):
    """Documents as news items, with whole bodies."""
    d = L.table(spark, sf, "documents")
    k = F.col("doc_id")
    head = F.array(
        F.concat(F.lit("Doc D"), k.cast("string"), F.lit(" OF • NYY")),
        F.when(k % 9 == 0, F.lit("no colon")).otherwise(F.concat(F.lit("Club's Doc: report "), k.cast("string"))), F.lit("by Staff"),
        F.concat(F.lit("("), (k % 60).cast("string"), F.lit(" mins ago)")))
    text = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", ""))
    lines = d.select(k, F.posexplode(F.concat(head, text)).alias("i", "line"))
    lines = lines.select(F.concat(F.lit("news-"), F.floor(k / 256).cast("string")).alias("path"), k.alias("blk"),
                         F.col("i").cast("long").alias("pos"), "line")
    rows, _ = C.news(lines)
    return rows.select(F.col("blk").alias("pos"), "player", "headline", "age_text",
                       F.length("body").cast("long").alias("body_len"), F.md5("body").alias("body_md5"))


@query("block_fold", """
WITH b AS (SELECT *, last_value(CASE WHEN role='user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS block FROM conversations)
SELECT conv_id, block, count(*) AS lines, cast(sum(length(text)) AS bigint) AS chars FROM b GROUP BY 1,2""")
def block_fold(spark, sf):
    rows = L.table(spark, sf, "conversations").withColumn("h", F.when(F.col("role") == "user", F.col("turn")))
    rows = scan.fill_forward(rows, ["conv_id"], ["turn"], F.floor(F.col("turn") / 1024), {"h": "block"})
    return rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


@query("sectioned_lines", """
SELECT conv_id, turn, last_value(CASE WHEN role='user' THEN md5(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations""")
def sectioned_lines(spark, sf):
    rows = L.table(spark, sf, "conversations").withColumn("h", F.when(F.col("role") == "user", F.md5("text")))
    rows = scan.fill_forward(rows, ["conv_id"], ["turn"], F.floor(F.col("turn") / 1024), {"h": "section"})
    return rows.select("conv_id", "turn", "section")


@query("stamp_and_lines", """
WITH l AS (SELECT page_id, string_split(html, '<p>') AS parts FROM pages)
SELECT page_id, len(parts) AS lines, cast(list_sum(list_transform(parts, lambda x: length(replace(x, chr(160), ' ')))) AS bigint) AS chars FROM l""")
def stamp_and_lines(spark, sf):
    """Pages as stamped captures: three head lines, then the body lines."""
    p = L.table(spark, sf, "pages")
    stamp = F.array(F.concat(F.lit("source: "), "url"), F.lit("captured: 2024-01-01"), F.lit("---"))
    lines = p.select("page_id", F.posexplode(F.concat(stamp, F.split("html", "<p>"))).alias("i", "raw"))
    lines = lines.select(F.col("page_id").alias("path"), F.floor(F.col("i") / 1000).alias("blk"), F.col("i").cast("long").alias("pos"),
                         F.translate("raw", "\u00a0", " ").alias("line"))
    body = C.strip_stamp(lines)
    return body.groupBy(F.col("path").alias("page_id")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("line")).alias("chars"))

"""Pages and reports composed of other queries, and the finders behind them."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from contestlake.functions import names as N
from contestlake.functions.calendars import month_number
from contestlake.functions.rates import ON_BASE_WEIGHTS, fixed, ratio, singles, weighted_on_base
from contestlake.operators import aggregates as A
from contestlake.operators import identity as D
from contestlake.operators import marts as M
from contestlake.operators import ranking
from contestlake.operators import scenario as SCN
from contestlake.operators import signals as SG
from contestlake.operators import swaps as SW
from contestlake.plans import actions as ACT
from contestlake.plans import graphs as G
from contestlake.plans import identities as IDS
from contestlake.plans import league as L
from contestlake.plans import scenarios as SC
from contestlake.plans import signals as SIG
from contestlake.plans.registry import ORACLES, QUERIES, query, rnd
from contestlake.session import run_dir, sharing
from contestlake.sources import feeds, versions


def sub(name: str) -> str:
    """The SQL of another query as a table."""
    return f"({ORACLES[name]})"


def rows(spark, sf, name):
    return QUERIES[name](spark, sf)


# --- lineup by marginal points ----------------------------------------------

# A coming start is an urgent order of the next period; a member without an order in the last two periods is idle.
KEYED = SC.MARG + f""",
up AS (SELECT o_custkey AS member, count(*) AS starts FROM orders WHERE o_orderpriority='1-URGENT' AND (year(o_orderdate)-1995)*12+month(o_orderdate)={L.AS_OF + 1} GROUP BY 1),
ac AS (SELECT DISTINCT member FROM mp WHERE period BETWEEN {L.AS_OF - 1} AND {L.AS_OF}),
kf AS (SELECT fl.entity, fl.member, marginal, coalesce(starts,0) AS starts, quality, ac.member IS NULL AS idle,
  (marginal+coalesce(starts,0)*cast(0.3 AS double)+quality/cast(1000 AS double))*CASE WHEN ac.member IS NULL THEN cast(0.4 AS double) ELSE cast(1 AS double) END AS key
  FROM fl JOIN mg ON mg.member=fl.member LEFT JOIN up ON up.member=fl.member LEFT JOIN ac ON ac.member=fl.member)
"""
_SLOTTED = SC.sql_slots(KEYED, "(SELECT key FROM kf WHERE kf.member=fl.member)")


def keyed_members(spark, sf):
    """Members with the parts of their lineup key."""
    flows = SC.flows(spark, sf)
    marginal = QUERIES["member_marginal"](spark, sf).select("member", "marginal")
    orders = L.table(spark, sf, "orders")
    soon = orders.where((F.col("o_orderpriority") == "1-URGENT") & (month_number(F.to_date("o_orderdate"), L.BASE_YEAR) == L.AS_OF + 1))
    soon = soon.groupBy(F.col("o_custkey").alias("member")).agg(F.count(F.lit(1)).alias("starts"))
    active = L.member_periods(spark, sf).where(F.col("period").between(L.AS_OF - 1, L.AS_OF)).select("member").distinct()
    parts = flows.select("entity", "member", "quality").join(marginal, "member").join(soon, "member", "left")
    parts = parts.join(active.withColumn("played", F.lit(True)), "member", "left")
    parts = parts.select("entity", "member", "marginal", F.coalesce("starts", F.lit(0)).alias("starts"), "quality", F.col("played").isNull().alias("idle"))
    return parts.withColumn("key", SCN.lineup_key(F.col("marginal"), F.col("starts"), F.col("quality"), F.col("idle")))


@query("lineup_keys", KEYED + f"SELECT entity, member, marginal, starts, idle, {rnd('key', 6)} AS key FROM kf")
def lineup_keys(spark, sf):
    return keyed_members(spark, sf).select("entity", "member", "marginal", "starts", "idle", fixed(F.col("key"), 6).alias("key"))


@query("lineup_by_marginal", _SLOTTED + "SELECT * FROM asg")
def lineup_by_marginal(spark, sf):
    """Slots filled by marginal points, starts and quality, and not by quality alone."""
    rank = F.col("member") % 6
    current = F.when(rank == 0, "UTIL").when(rank == 1, "MACH")
    members = keyed_members(spark, sf).select("entity", "member", F.col("key").alias("score"), current.alias("current"))
    return SCN.assign_slots(members, SC.slot_options(spark, sf), SC.TEMPLATE)


# --- adds from the pool -----------------------------------------------------

POOL = 24  # the nation whose members count as free
HEADROOM = 400.0  # orders that we may still use


@query("streaming_adds", SC.BASEPTS + SIG.ACTIVITY.replace("WITH ln", ", ln", 1) + f""",
fr AS (SELECT * FROM ro WHERE entity={POOL}),
sv AS ({SC._sql_values(f"(SELECT member, inp.*, {', '.join(f'f.{c} AS d_{c}' for c in SC.N)} FROM (SELECT member, {', '.join(SC.N)} FROM fr) f JOIN inp ON inp.entity={L.US})", "member, entity")}),
al AS (SELECT fr.member, b0.entity, b0.metric, b0.direction, coalesce(sv.value, b0.value) AS value FROM fr JOIN b0 ON true
  LEFT JOIN sv ON sv.member=fr.member AND sv.entity=b0.entity AND sv.metric=b0.metric),
pa AS (SELECT member, entity, sum(pts) AS after FROM (SELECT member, entity, {L.sql_points("member, metric")} AS pts FROM al) GROUP BY 1,2),
ga AS (SELECT pa.member, after-before AS gain FROM pa JOIN bp ON bp.entity=pa.entity WHERE pa.entity={L.US}),
nx AS (SELECT o_custkey AS member, count(*) AS starts FROM orders WHERE o_orderdate>=DATE '2000-06-30' AND o_orderdate<DATE '2000-06-30'+90 GROUP BY 1 HAVING count(*)>=2),
cd AS (SELECT DISTINCT member FROM gt WHERE status LIKE 'ok%' OR status='unverified')
SELECT fr.member, gain, {rnd("qty/ord", 4)} AS per_order, {rnd(f"ord*{SC.LEFT}", 4)} AS uses, coalesce(starts,0)>=2 AS two_start
FROM fr JOIN ga ON ga.member=fr.member JOIN cd ON cd.member=fr.member LEFT JOIN nx ON nx.member=fr.member WHERE ord>0 AND ord*{SC.LEFT}<={HEADROOM}""")
def streaming_adds(spark, sf):
    """Usable free members by the points that adding them wins, what they make per order, and what they take of our headroom."""
    free = SC.flows(spark, sf).where(F.col("entity") == POOL)
    gains = SCN.member_gain(SC.inputs(spark, sf), free.drop("quality"), L.US, L.METRICS, L.AS_OF, SC.LEFT)
    usable = SIG.gated(spark, sf).where(F.col("status").startswith("ok") | (F.col("status") == "unverified")).select("member").distinct()
    soon = SG.coming_twice(SIG.usage_lines(spark, sf), SIG.USAGE_AS_OF, 90)
    uses = F.col("ord") * SC.LEFT
    found = free.where((F.col("ord") > 0) & (uses <= HEADROOM)).join(gains, "member").join(usable, "member", "left_semi").join(soon, "member", "left")
    return found.select("member", "gain", fixed(ratio(F.col("qty"), F.col("ord")), 4).alias("per_order"), fixed(uses, 4).alias("uses"),
                        F.coalesce(F.col("starts") >= 2, F.lit(False)).alias("two_start"))


# --- trade market -----------------------------------------------------------


@query("counterparty_offers", f"""
WITH s AS ({SC.SWAP} SELECT rival, give, get, q_give, q_get, ours, theirs, tier FROM sk WHERE k<=1 ORDER BY t, ours DESC, give, get LIMIT 1000)
SELECT s.rival, s.give, s.get, s.tier, s.ours, s.theirs, {rnd("s.q_get-s.q_give", 2)} AS market, c.score AS fit, c.trades
FROM s JOIN {sub("counterparty_scan")} c ON c.entity=s.rival""")
@sharing
def counterparty_offers(spark, sf):
    """The best swap of every target with complementary rivals: what each side wins, what the market says, how often they trade."""
    swaps = SW.scan_swaps(SC.inputs(spark, sf), SC.rosters(spark, sf), L.US, L.METRICS, L.AS_OF, SC.LEFT, per_target=1, top=1000)
    rivals = rows(spark, sf, "counterparty_scan")
    both = swaps.join(rivals.select(F.col("entity").alias("rival"), F.col("score").alias("fit"), "trades"), "rival")
    return both.select("rival", "give", "get", "tier", "ours", "theirs", fixed(F.col("q_get") - F.col("q_give"), 2).alias("market"), "fit", "trades")


@query("market_report", f"""
WITH m AS (SELECT entity, score, row_number() OVER (ORDER BY score DESC, entity) AS place FROM {sub("complementarity")}),
b AS (SELECT * FROM {sub("best_for_metric")})
SELECT m.place, m.entity, 'target' AS side, b.metric, b.member, b.value FROM m JOIN b ON b.entity=m.entity WHERE place<=4
UNION ALL SELECT m.place, m.entity, 'chip', b.metric, b.member, b.value FROM m JOIN b ON b.entity={L.US} WHERE place<=4""")
def market_report(spark, sf):
    """The four best counterparties with their members worth asking for and ours worth offering."""
    best = rows(spark, sf, "best_for_metric")
    four = rows(spark, sf, "complementarity").orderBy(F.desc("score"), "entity").limit(4)
    four = ranking.row_rank(four, [], [F.desc("score"), F.asc("entity")], "place").select("place", "entity")
    theirs = four.join(best, "entity").select("place", "entity", F.lit("target").alias("side"), "metric", "member", "value")
    sides = F.explode(F.sequence(F.lit(1), F.lit(4)))
    ours = best.where(F.col("entity") == L.US).select("metric", "member", "value", sides.alias("place")).join(four, "place")
    return theirs.unionByName(ours.select("place", "entity", F.lit("chip").alias("side"), "metric", "member", "value"))


# --- codes and rates --------------------------------------------------------

CODES = {"UNI": "GBR", "IRA": "IRN", "CHI": "CHN"}  # codes that the schedule writes in another way
_CODE = "CASE substr(n_name,1,3) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in CODES.items()) + " ELSE substr(n_name,1,3) END"


@query("coded_games_next", f"""
WITH g AS (SELECT {_CODE} AS team, count(*) AS games FROM orders JOIN customer ON c_custkey=o_custkey JOIN nation ON n_nationkey=c_nationkey WHERE o_orderstatus='P' GROUP BY 1)
SELECT n_nationkey AS entity, substr(n_name,1,3) AS code, games FROM nation LEFT JOIN g ON g.team={_CODE}""")
def coded_games_next(spark, sf):
    """Coming games per team, when the schedule knows some teams by other codes."""
    nation = L.table(spark, sf, "nation").select(F.col("n_nationkey").alias("entity"), F.substring("n_name", 1, 3).alias("code"))
    coming = L.table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("member"))
    schedule = coming.join(L.members(spark, sf).select("member", "entity"), "member").join(nation, "entity")
    games = schedule.groupBy(N.translated(F.col("code"), CODES).alias("team")).agg(F.count(F.lit(1)).alias("games"))
    return nation.withColumn("team", N.translated(F.col("code"), CODES)).join(games, "team", "left").select("entity", "code", "games")


@query("coded_crosswalk", IDS.MATCH.replace("c_nationkey AS team", "CASE c_nationkey WHEN 3 THEN 103 ELSE c_nationkey END AS team") + "SELECT * FROM fin")
def coded_crosswalk(spark, sf):
    """The crosswalk when the universe writes one team's code in another way."""
    sources, targets = IDS.people(spark, sf)
    sources = sources.withColumn("team", F.col("team").cast("string"))
    targets = targets.withColumn("team", F.when(F.col("team") == 3, "103").otherwise(F.col("team").cast("string")))
    return D.resolve_collisions(D.cascade(sources, targets, {"3": "103"}))


_ON_BASE = {"bb": "signup", "hbp": "error", "b2": "click", "b3": "view", "hr": "purchase"}


@query("weighted_rate", f"""
WITH c AS (SELECT user_id AS member, count(*) AS h, {", ".join(f"count(CASE WHEN event_type='{t}' THEN 1 END) AS {c}" for c, t in _ON_BASE.items())} FROM events GROUP BY 1),
s AS (SELECT *, greatest(h-b2-b3-hr, 0) AS b1 FROM c)
SELECT member, b1, {rnd("(" + "+".join(["cast(0 AS double)"] + [f"{c}*cast({w} AS double)" for c, w in ON_BASE_WEIGHTS.items()]) + ")/(h+bb+hbp)", 4)} AS rate FROM s""")
def weighted_rate(spark, sf):
    """Weighted rate per member from summed components; the plain hits are what the longer ones leave."""
    counts = [F.sum((F.col("event_type") == t).cast("long")).alias(c) for c, t in _ON_BASE.items()]
    c = L.table(spark, sf, "events").groupBy(F.col("user_id").alias("member")).agg(F.count(F.lit(1)).alias("h"), *counts)
    c = c.withColumn("b1", singles(F.col("h"), F.col("b2"), F.col("b3"), F.col("hr")))
    num, den = weighted_on_base(ON_BASE_WEIGHTS, ["h", "bb", "hbp"])
    return c.select("member", "b1", fixed(ratio(num, den), 4).alias("rate"))


@query("leaderboard_universe", f"""
SELECT c_custkey AS member, c_mktsegment AS role, {rnd("c_acctbal", 2)} AS value FROM customer WHERE c_custkey%4<>0""")
def leaderboard_universe(spark, sf):
    """A CSV leaderboard with a byte-order mark, joined to the members it names."""
    c = L.table(spark, sf, "customer")
    folder = run_dir(spark, "leaderboard")
    mark = "﻿player_id"
    c.where(F.col("c_custkey") % 4 != 0).select(F.col("c_custkey").alias(mark), F.format_string("%.2f", "c_acctbal").alias("value")).write.option("header", True).csv(folder)
    board = feeds.read_leaderboard(spark, folder, ["player_id", "value"])
    known = L.members(spark, sf).select(F.col("member").cast("double").alias("player_id"), "member", "role")
    return board.join(known, "player_id").select("member", "role", fixed(F.col("value"), 2).alias("value"))


# --- pages ------------------------------------------------------------------

AS_OF = date(2024, 1, 31)


def _section(name: str, key: str, value: str, table: str, rest: str = "") -> str:
    return f"SELECT '{name}' AS section, cast({key} AS varchar) AS key, cast({value} AS double) AS value FROM {table} {rest}"


MANAGER = [
    _section("standings", "entity", "total", sub("cumulative_standings"), f"WHERE period={L.PERIODS}"),
    _section("projected_final", "entity", "total", sub("projected_totals")),
    _section("battle", "metric||' > '||passes", "points_gain", sub("brief_battle_plan")),
    _section("cushion", "metric", "cushion", sub("cushion_below")),
    _section("wire", "member", "strength", sub("brief_wire_heat")),
    _section("streams", "member", "starts", sub("brief_streams")),
    _section("pulse", "kind", "count(*)", sub("brief_own_signals"), "GROUP BY kind"),
    _section("hazards", "member", "entity", f"({ACT.WITH} SELECT * FROM iv)", "WHERE to_ts IS NULL AND status='il' AND entity=4"),
    _section("lineup", "change", "count(*)", sub("lineup_changes"), f"WHERE entity={L.US} GROUP BY change"),
    _section("recommendations", "status", "n", sub("advice_funnel")),
    _section("eligibility", "member", "count(*)", sub("eligibility_windows"), "GROUP BY member ORDER BY 3 DESC, 2 LIMIT 8"),
    _section("snipers", "victim", "n", f"(SELECT victim, sum(n) AS n FROM {sub('snipe_motif')} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)"),
]


@query("manager_overview", "\nUNION ALL ".join(f"(SELECT * FROM ({s}))" for s in MANAGER))
@sharing
def manager_overview(spark, sf):
    """Everything that the manager's page shows, as (section, key, value)."""
    get = lambda name: rows(spark, sf, name)
    as_rows = lambda df, key, value: df.select(key.alias("key"), value.alias("value"))
    col, one = F.col, F.count(F.lit(1))
    held = ACT.intervals(spark, sf).where("to_ts is null and status = 'il' and entity = 4")
    eligible = get("eligibility_windows").groupBy(col("member").alias("key")).agg(one.alias("value")).orderBy(F.desc("value"), col("key").cast("string")).limit(8)
    snipers = get("snipe_motif").groupBy(col("victim").alias("key")).agg(F.sum("n").alias("value")).orderBy(F.desc("value"), "key").limit(3)
    return M.labelled({
        "standings": as_rows(get("cumulative_standings").where(col("period") == L.PERIODS), col("entity"), col("total")),
        "projected_final": as_rows(get("projected_totals"), col("entity"), col("total")),
        "battle": as_rows(get("brief_battle_plan"), F.concat("metric", F.lit(" > "), col("passes").cast("string")), col("points_gain")),
        "cushion": as_rows(get("cushion_below"), col("metric"), col("cushion")),
        "wire": as_rows(get("brief_wire_heat"), col("member"), col("strength")),
        "streams": as_rows(get("brief_streams"), col("member"), col("starts")),
        "pulse": get("brief_own_signals").groupBy(col("kind").alias("key")).agg(one.alias("value")),
        "hazards": as_rows(held, col("member"), col("entity")),
        "lineup": get("lineup_changes").where(col("entity") == L.US).groupBy(col("change").alias("key")).agg(one.alias("value")),
        "recommendations": as_rows(get("advice_funnel"), col("status"), col("n")),
        "eligibility": eligible,
        "snipers": snipers,
    })


OPS = [
    _section("reconcile", "kind", "n", sub("reconcile_counts")),
    _section("captures", "event_type", "date_diff('day', cast(max(ts) AS date), DATE '2024-01-31')", "events", "GROUP BY event_type"),
    _section("alerts", "event_id", "member", f"(SELECT a.event_id, a.member, e.ts FROM {sub('stream_alerts')} a JOIN events e ON e.event_id=a.event_id)", "ORDER BY ts DESC, event_id LIMIT 12"),
    _section("evals", "model||' @ '||stand", "mae", sub("model_deltas")),
    _section("sources", "stat||' / '||period", "mae", sub("rolling_scoreboard")),
    _section("advice", "status", "n", sub("advice_funnel")),
    _section("outcomes", "status", "count(*)", sub("outcome_scoring"), "GROUP BY status"),
    _section("orphans", "relation", "orphans", sub("orphans")),
]


@query("ops_overview", "\nUNION ALL ".join(f"(SELECT * FROM ({s}))" for s in OPS))
def ops_overview(spark, sf):
    """What the operations page shows: reconcile, captures, alerts, model evals, source scores, advice, outcomes, orphans."""
    get = lambda name: rows(spark, sf, name)
    as_rows = lambda df, key, value: df.select(key.alias("key"), value.alias("value"))
    col, one = F.col, F.count(F.lit(1))
    events = L.table(spark, sf, "events")
    ages = events.groupBy(col("event_type").alias("key")).agg(F.datediff(F.lit(AS_OF), F.max(F.to_date("ts"))).alias("value"))
    alerts = get("stream_alerts").join(events.select("event_id", "ts"), "event_id").orderBy(F.desc("ts"), "event_id").limit(12)
    scored = A.funnel(get("outcome_scoring"), "status", "score")
    return M.labelled({
        "reconcile": as_rows(get("reconcile_counts"), col("kind"), col("n")),
        "captures": ages,
        "alerts": as_rows(alerts, col("event_id"), col("member")),
        "evals": as_rows(get("model_deltas"), F.concat("model", F.lit(" @ "), col("stand").cast("string")), col("mae")),
        "sources": as_rows(get("rolling_scoreboard"), F.concat("stat", F.lit(" / "), col("period").cast("string")), col("mae")),
        "advice": as_rows(get("advice_funnel"), col("status"), col("n")),
        "outcomes": as_rows(scored, col("status"), col("n")),
        "orphans": as_rows(get("orphans"), col("relation"), col("orphans")),
    })


# --- the weekly brief -------------------------------------------------------

_BRIEF = {
    "1 standings": (sub("projected_totals"), "rank", "rank||'. '||entity||': '||printf('%.1f', total)", 8),
    "2 battle": (sub("brief_battle_plan"), "points_gain DESC, metric, passes", "line", 6),
    "3 streams": (sub("brief_streams"), "starts DESC, apps30 DESC, member", "member||': '||starts||' starts'", 6),
    "4 saves": (sub("brief_saves"), "saves30 DESC, member", "member||': '||role||', '||saves30||' saves'", 4),
    "5 wire": (sub("brief_wire_heat"), "strength DESC, member", "member||' '||kind||' '||printf('%+.2f', delta)", 8),
    "6 trades": (sub("scenario_swap_scan"), "ours DESC, give, get", "give||' for '||get||' of '||rival||': '||printf('%+.1f', ours)||', '||tier", 5),
    "7 pacing": (f"(SELECT * FROM {sub('resource_pace')} WHERE used IS NOT NULL)", "headroom, member", "member||': '||printf('%.1f', headroom)||' left'", 5),
}


@query("weekly_brief", "\nUNION ALL ".join(
    f"SELECT * FROM (SELECT '{name}' AS section, cast(row_number() OVER (ORDER BY {order}) AS integer) AS line_no, {line} AS line FROM {table}) WHERE line_no<={k}"
    for name, (table, order, line, k) in _BRIEF.items()))
@sharing
def weekly_brief(spark, sf):
    """The brief as numbered lines; it is stored as a version of a report table and read back."""
    get, text = (lambda name: rows(spark, sf, name)), (lambda c: F.col(c).cast("string"))
    lit, some = F.lit, F.format_string
    parts = {
        "1 standings": (get("projected_totals"), [F.asc("rank")], F.concat(text("rank"), lit(". "), text("entity"), lit(": "), some("%.1f", "total")), 8),
        "2 battle": (get("brief_battle_plan"), [F.desc("points_gain"), F.asc("metric"), F.asc("passes")], F.col("line"), 6),
        "3 streams": (get("brief_streams"), [F.desc("starts"), F.desc("apps30"), F.asc("member")], F.concat(text("member"), lit(": "), text("starts"), lit(" starts")), 6),
        "4 saves": (get("brief_saves"), [F.desc("saves30"), F.asc("member")], F.concat(text("member"), lit(": "), "role", lit(", "), text("saves30"), lit(" saves")), 4),
        "5 wire": (get("brief_wire_heat"), [F.desc("strength"), F.asc("member")], F.concat(text("member"), lit(" "), "kind", lit(" "), some("%+.2f", "delta")), 8),
        "6 trades": (get("scenario_swap_scan"), [F.desc("ours"), F.asc("give"), F.asc("get")], F.concat(
            text("give"), lit(" for "), text("get"), lit(" of "), text("rival"), lit(": "), some("%+.1f", "ours"), lit(", "), "tier"), 5),
        "7 pacing": (get("resource_pace").where("used is not null"), [F.asc("headroom"), F.asc("member")],
                     F.concat(text("member"), lit(": "), some("%.1f", "headroom"), lit(" left")), 5),
    }
    report = None
    for name, (found, order, line, k) in parts.items():
        # The section is part of the key, so that Spark ranks within a table of a few lines.
        one = M.report_lines(found.withColumn("section", lit(name)), ["section"], order, line, k)
        report = one if report is None else report.unionByName(one)
    table = versions.Table(spark, run_dir(spark, "briefs"))
    table.replace(report, f"brief of {datetime(2024, 1, 31):%Y-%m-%d}")
    return table.read()


@query("latest_signals", SIG.USER_TREND + "SELECT member, kind, delta, strength FROM sg WHERE newest>=TIMESTAMP '2024-01-28'")
def latest_signals(spark, sf):
    """The newest signal of each member and kind of the last days."""
    found = SIG.user_signals(spark, sf).withColumn("at", F.col("newest")).withColumn("seq", F.lit(0))
    return SG.newest_signals(found, 3, AS_OF).select("member", "kind", "delta", "strength")

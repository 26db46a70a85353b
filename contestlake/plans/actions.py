"""The event table read as an owner's action log.

entity = ``k`` div 10 of the event's props (10 owners), member = user.
signup adds, error drops, purchase trades from the next owner, view and click
move a member to and from the injured list.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from contestlake.functions.rates import cents, fixed
from contestlake.operators import aggregates as A
from contestlake.operators import intervals as I
from contestlake.operators import joins as J
from contestlake.operators import ranking
from contestlake.operators import rederive as R
from contestlake.plans import league as L
from contestlake.plans.registry import query, rnd
from contestlake.session import cut_lineage, step

# Event types as actions.
ACTIONS = {"signup": "add", "error": "drop", "purchase": "trade", "view": "move_to_il", "click": "move_from_il"}
ORDER = ["ts", "event_id"]


def actions(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    entity = F.floor(k / 10).cast("long")
    action = F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[F.col("event_type")]
    return L.table(spark, sf, "events").select(
        "event_id", "ts", F.col("user_id").alias("member"), entity.alias("entity"), action.alias("action"),
        F.when(F.col("event_type") == "purchase", (entity + 1) % 10).alias("counterparty"),
        cents(F.col("value")).alias("fee"))


SQL_ACTIONS = """
act AS (
  SELECT event_id, ts, user_id AS member, cast(floor(cast(json_extract_string(props,'$.k') AS bigint)/10) AS bigint) AS entity,
    CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'drop' WHEN 'purchase' THEN 'trade'
      WHEN 'view' THEN 'move_to_il' WHEN 'click' THEN 'move_from_il' END AS action,
    cast(round(value*100) AS bigint) AS fee FROM events),
mv AS (
  SELECT member, action, ts, event_id, entity, 'open' AS kind, 0 AS step, NULL AS status FROM act WHERE action='add'
  UNION ALL SELECT member, action, ts, event_id, entity, 'close', 0, NULL FROM act WHERE action='drop'
  UNION ALL SELECT member, action, ts, event_id, (entity+1)%10, 'close', 0, NULL FROM act WHERE action='trade'
  UNION ALL SELECT member, action, ts, event_id, entity, 'open', 1, NULL FROM act WHERE action='trade'
  UNION ALL SELECT member, action, ts, event_id, entity, 'status', 0, CASE action WHEN 'move_to_il' THEN 'il' ELSE 'active' END
    FROM act WHERE action IN ('move_to_il','move_from_il')),
eg AS (SELECT *, coalesce(lag(kind) OVER (PARTITION BY entity, member ORDER BY ts, event_id, step),'close') AS prev FROM mv WHERE kind<>'status'),
kept AS (SELECT *, lead(ts) OVER w AS to_ts, lead(action) OVER w AS ended_by FROM eg WHERE kind<>prev
  WINDOW w AS (PARTITION BY entity, member ORDER BY ts, event_id, step)),
tl AS (SELECT entity, member, ts, event_id, step, kind, NULL AS status, action FROM kept
  UNION ALL SELECT entity, member, ts, event_id, step, kind, status, action FROM mv WHERE kind='status'),
pl AS (SELECT *, last_value(CASE WHEN kind<>'status' THEN kind END IGNORE NULLS) OVER w AS lk,
  last_value(CASE WHEN kind<>'status' THEN event_id END IGNORE NULLS) OVER w AS le,
  last_value(CASE WHEN kind<>'status' THEN step END IGNORE NULLS) OVER w AS ls
  FROM tl WINDOW w AS (PARTITION BY entity, member ORDER BY ts, event_id, step ROWS UNBOUNDED PRECEDING)),
st AS (SELECT entity, member, le, ls, arg_max(status, (ts, event_id, step)) AS status FROM pl WHERE kind='status' AND lk='open' GROUP BY 1,2,3,4),
iv AS (SELECT k.entity, k.member, k.ts AS from_ts, k.to_ts, k.action AS via, k.ended_by, coalesce(s.status,'active') AS status
  FROM kept k LEFT JOIN st s ON s.entity=k.entity AND s.member=k.member AND s.le=k.event_id AND s.ls=k.step WHERE k.kind='open')
"""
WITH = "WITH " + SQL_ACTIONS


def intervals(spark, sf):
    return step(spark, sf, "intervals", lambda: I.build_intervals(actions(spark, sf), ORDER, "ts"))


@query("event_intervals", WITH + "SELECT entity, member, from_ts, to_ts, via, ended_by, status FROM iv")
def event_intervals(spark, sf):
    return intervals(spark, sf)


@query("interval_anomalies", WITH + """
SELECT entity, member, ts, event_id, action, CASE kind WHEN 'open' THEN 'double-open' ELSE 'close-without-open' END AS anomaly FROM eg WHERE kind=prev
UNION ALL SELECT entity, member, ts, event_id, action, 'status-move-without-stint' FROM pl WHERE kind='status' AND coalesce(lk,'close')<>'open'""")
def interval_anomalies(spark, sf):
    return I.interval_anomalies(actions(spark, sf), ORDER, "ts")


# Trades above 90 are taken out of the log and come back as the lines of a correction log.
_FIX = "event_type='purchase' AND value>90"
SQL_CORRECTED = SQL_ACTIONS.replace(
    "SELECT event_id, ts, user_id", f"SELECT CASE WHEN {_FIX} THEN event_id-1099511627776 ELSE event_id END AS event_id, "
    f"CASE WHEN {_FIX} THEN date_trunc('day', ts) ELSE ts END AS ts, user_id").replace(
    "WHEN 'purchase' THEN 'trade'", "WHEN 'purchase' THEN CASE WHEN value>90 THEN 'trade(corrected)' ELSE 'trade' END").replace(
    "action='trade'", "action IN ('trade','trade(corrected)')")


def corrected_log(spark, sf):
    from contestlake.sources import captures

    log = actions(spark, sf)
    unlogged = (F.col("action") == "trade") & (F.col("fee") > 9000)
    line = F.to_json(F.struct(
        F.lit("trade_unlogged").alias("type"), F.date_format("ts", "yyyy-MM-dd").alias("effective_date"), F.col("member").cast("string").alias("player"),
        F.col("counterparty").cast("string").alias("from_team"), F.col("entity").cast("string").alias("to_team")))
    good, _ = captures.corrections(log.where(unlogged).select(F.col("event_id").alias("pos"), line.alias("line")))
    fixes = good.select(
        F.col("player").cast("long").alias("member"), F.col("from_team").cast("long").alias("from_entity"),
        F.col("to_team").cast("long").alias("to_entity"), "effective", F.col("pos").alias("line"))
    return I.with_corrections(log.where(~unlogged), fixes, ORDER, "ts")


@query("corrected_intervals", "WITH " + SQL_CORRECTED + "SELECT entity, member, from_ts, to_ts, via, ended_by, status FROM iv")
def corrected_intervals(spark, sf):
    return I.build_intervals(corrected_log(spark, sf), ORDER, "ts")


# Every 17th event comes late: the stored intervals lack it.
_LATE = "event_id%17=0"
_TWO = f"""WITH
cur AS ({WITH} SELECT * FROM iv),
sto AS ({WITH.replace("FROM events)", f"FROM events WHERE NOT ({_LATE}))")} SELECT * FROM iv),
a AS (SELECT *, row_number() OVER (PARTITION BY entity, member, from_ts ORDER BY to_ts NULLS FIRST, via, ended_by NULLS FIRST, status) AS k FROM sto),
b AS (SELECT *, row_number() OVER (PARTITION BY entity, member, from_ts ORDER BY to_ts NULLS FIRST, via, ended_by NULLS FIRST, status) AS k FROM cur)
"""


def late_changes(spark, sf):
    log = actions(spark, sf)
    late = F.expr(_LATE)
    stored = cut_lineage(I.build_intervals(log.where(~late), ORDER, "ts"))
    return stored, R.interval_changes(stored, log, log.where(late), ORDER, "ts")


@query("late_change_set", _TWO + """
SELECT CASE WHEN a.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'delete' ELSE 'update' END AS op,
  coalesce(b.entity, a.entity) AS entity, coalesce(b.member, a.member) AS member, coalesce(b.from_ts, a.from_ts) AS from_ts,
  CASE WHEN b.k IS NULL THEN a.to_ts ELSE b.to_ts END AS to_ts, CASE WHEN b.k IS NULL THEN a.via ELSE b.via END AS via,
  CASE WHEN b.k IS NULL THEN a.ended_by ELSE b.ended_by END AS ended_by, CASE WHEN b.k IS NULL THEN a.status ELSE b.status END AS status
FROM a FULL JOIN b ON a.entity=b.entity AND a.member=b.member AND a.from_ts=b.from_ts AND a.k=b.k
WHERE a.k IS NULL OR b.k IS NULL OR a.to_ts IS DISTINCT FROM b.to_ts OR a.via<>b.via OR a.ended_by IS DISTINCT FROM b.ended_by OR a.status<>b.status""")
def late_change_set(spark, sf):
    return late_changes(spark, sf)[1].drop(R.PLACE)


@query("late_rederivation", WITH + "SELECT entity, member, from_ts, to_ts, via, ended_by, status FROM iv")
def late_rederivation(spark, sf):
    stored, changes = late_changes(spark, sf)
    return R.applied(stored, changes, [*I.KEY, "from_ts"])


DATES = [datetime(2024, 1, 8), datetime(2024, 1, 15), datetime(2024, 1, 22), datetime(2024, 1, 29)]


@query("roster_asof", WITH + """
SELECT d AS as_of, entity, member, status, via FROM iv
JOIN (VALUES (TIMESTAMP '2024-01-08'),(TIMESTAMP '2024-01-15'),(TIMESTAMP '2024-01-22'),(TIMESTAMP '2024-01-29')) t(d)
ON from_ts<=d AND (to_ts IS NULL OR to_ts>d)""")
def roster_asof(spark, sf):
    return I.roster_as_of(intervals(spark, sf), DATES)


@query("intervals_by_posted_cutoff", "WITH " + SQL_ACTIONS.replace("FROM events)", "FROM events WHERE ts<=TIMESTAMP '2024-01-15')")
       + "SELECT entity, member, from_ts, via, status FROM iv WHERE to_ts IS NULL")
def intervals_by_posted_cutoff(spark, sf):
    log = actions(spark, sf).where(F.col("ts") <= F.lit(DATES[1]).cast("timestamp_ntz"))
    out = I.build_intervals(log, ORDER, "ts")
    return out.where(F.col("to_ts").isNull()).select("entity", "member", "from_ts", "via", "status")


def grid(spark, sf):
    """A snapshot page: members whose last logged action is not a drop."""
    last = actions(spark, sf).groupBy("entity", "member").agg(F.max_by("action", F.struct("ts", "event_id")).alias("a"))
    status = F.when(F.col("a") == "move_to_il", "il").otherwise("active")
    return last.where(F.col("a") != "drop").select("entity", "member", status.alias("status"))


RECON = WITH + """,
grid AS (SELECT entity, member, CASE WHEN a='move_to_il' THEN 'il' ELSE 'active' END AS want
  FROM (SELECT entity, member, arg_max(action, (ts, event_id)) AS a FROM act GROUP BY 1,2) WHERE a<>'drop'),
hv AS (SELECT entity, member, status AS have FROM iv WHERE to_ts IS NULL),
rc AS (SELECT coalesce(h.entity,g.entity) AS entity, coalesce(h.member,g.member) AS member, have, want,
  CASE WHEN have IS NULL THEN 'grid_only' WHEN want IS NULL THEN 'replay_only' WHEN have=want THEN 'matched' ELSE 'status_fix' END AS kind,
  coalesce(want, have) AS status FROM hv h FULL OUTER JOIN grid g ON h.entity=g.entity AND h.member=g.member)
"""


@query("reconcile_full_outer", RECON + "SELECT * FROM rc")
def reconcile_full_outer(spark, sf):
    return I.reconcile(intervals(spark, sf), grid(spark, sf))


@query("reconcile_counts", RECON + "SELECT kind, count(*) AS n FROM rc GROUP BY 1")
def reconcile_counts(spark, sf):
    return reconcile_full_outer(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("free_agents_anti", WITH + """
SELECT DISTINCT user_id AS member, coalesce(c,0) AS open_stints FROM events
LEFT JOIN (SELECT member, count(*) AS c FROM iv WHERE to_ts IS NULL AND entity=3 GROUP BY 1) ON member=user_id WHERE c IS NULL""")
def free_agents_anti(spark, sf):
    held = intervals(spark, sf).where(F.col("to_ts").isNull() & (F.col("entity") == 3))
    everyone = J.universe("member", actions(spark, sf))
    return J.without(everyone, held, ["member"]).withColumn("open_stints", F.lit(0).cast("long"))


SNIPE = WITH + """,
sn AS (SELECT d.entity AS victim, a.entity AS sniper, count(*) AS n FROM act d JOIN act a ON d.member=a.member
  WHERE d.action='drop' AND a.action='add' AND a.entity<>d.entity AND a.ts>d.ts AND a.ts<d.ts+INTERVAL 3 DAY GROUP BY 1,2)"""


def snipes(spark, sf):
    log = actions(spark, sf).select("member", "entity", "ts", "action")
    return J.follow_counts(log.where(F.col("action") == "drop"), log.where(F.col("action") == "add"))


@query("snipe_motif", SNIPE + "SELECT * FROM sn")
def snipe_motif(spark, sf):
    return snipes(spark, sf)


@query("top_snipers", SNIPE + "SELECT victim, sniper, n FROM (SELECT *, row_number() OVER (PARTITION BY victim ORDER BY n DESC, sniper) AS r FROM sn) WHERE r<=1")
def top_snipers(spark, sf):
    return ranking.top_k(snipes(spark, sf), ["victim"], [F.desc("n"), F.asc("sniper")], 1).drop("rank")


@query("co_transaction_edges", WITH + """, t AS (SELECT DISTINCT entity, member FROM act WHERE action IN ('add','drop'))
SELECT a.entity AS a, b.entity AS b, count(DISTINCT a.member) AS weight FROM t a JOIN t b ON a.member=b.member AND a.entity<b.entity GROUP BY 1,2""")
def co_transaction_edges(spark, sf):
    return J.shared_member_edges(actions(spark, sf).where(F.col("action").isin("add", "drop")))


@query("fee_ledger", WITH + "SELECT entity, count(*) AS events, cast(sum(fee) AS bigint) AS fees FROM act GROUP BY 1")
def fee_ledger(spark, sf):
    return A.ledger(actions(spark, sf), "entity", "fee")


@query("trade_appetite", WITH + "SELECT entity, count(*) AS trades FROM act WHERE action='trade' GROUP BY 1")
def trade_appetite(spark, sf):
    return actions(spark, sf).where(F.col("action") == "trade").groupBy("entity").agg(F.count(F.lit(1)).alias("trades"))


@query("funnel", WITH + f"SELECT action AS status, count(*) AS n, {rnd('cast(sum(fee) AS double)/count(*)', 4)} AS mean_score FROM act GROUP BY 1")
def funnel(spark, sf):
    log = actions(spark, sf).withColumnRenamed("action", "status")
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("n"),
                                     fixed(F.sum("fee").cast("double") / F.count(F.lit(1)), 4).alias("mean_score"))


@query("roster_vs_roster_diff", WITH + """,
a AS (SELECT entity, member, status AS left_value FROM iv WHERE from_ts<=TIMESTAMP '2024-01-15' AND (to_ts IS NULL OR to_ts>TIMESTAMP '2024-01-15')),
b AS (SELECT entity, member, status AS right_value FROM iv WHERE from_ts<=TIMESTAMP '2024-01-22' AND (to_ts IS NULL OR to_ts>TIMESTAMP '2024-01-22'))
SELECT coalesce(a.entity,b.entity) AS entity, coalesce(a.member,b.member) AS member, left_value, right_value,
 CASE WHEN right_value IS NULL THEN 'left_only' WHEN left_value IS NULL THEN 'right_only' WHEN left_value=right_value THEN 'matched' ELSE 'differs' END AS status
FROM a FULL OUTER JOIN b ON a.entity=b.entity AND a.member=b.member""")
def roster_vs_roster_diff(spark, sf):
    rosters = I.roster_as_of(intervals(spark, sf), DATES[1:3])
    first, second = [F.lit(d).cast("timestamp_ntz") for d in DATES[1:3]]
    return J.full_compare(rosters.where(F.col("as_of") == first), rosters.where(F.col("as_of") == second),
                          ["entity", "member"], "status")

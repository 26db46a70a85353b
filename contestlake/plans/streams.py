"""Streaming queries over the event table; results equal the batch answer for
everything the watermark has closed."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestlake.functions.rates import cents
from contestlake.operators import signals as SG
from contestlake.plans import actions as ACT
from contestlake.plans import league as L
from contestlake.plans import signals as SIG
from contestlake.plans.registry import query
from contestlake.streaming import keyed as K
from contestlake.streaming import pipelines as P

#: Parts in which the event table lands, each a run of the query.
PARTS = 3


def stream(spark, sf):
    return P.parquet_stream(spark, f"{sf}/events.parquet", P.EVENTS)


@query("stream_dedup", "SELECT event_id%5000 AS uid FROM events GROUP BY 1")
def stream_dedup(spark, sf):
    s = P.event_time(stream(spark, sf).withColumn("uid", F.col("event_id") % 5000), delay="40 days")
    return P.drain(P.unseen(s, "uid").select("uid"), "dedup")


@query("stream_alerts", """
SELECT event_id, user_id AS member, event_type, c_mktsegment AS role FROM events JOIN customer ON c_custkey=user_id WHERE c_mktsegment<>'FURNITURE' AND event_type IN ('error','signup')""")
def stream_alerts(spark, sf):
    known = L.members(spark, sf).where(F.col("role") != "FURNITURE").select(F.col("member").alias("user_id"), "role")
    s = P.unseen(P.event_time(stream(spark, sf)), "event_id")
    hits = P.known_alerts(s, known, "user_id", "event_type", "error|signup")
    return P.drain(hits.select("event_id", F.col("user_id").alias("member"), "event_type", "role"), "alerts")


@query("stream_roster_alerts", "WITH " + ACT.SQL_ACTIONS + """
SELECT event_id, user_id AS member FROM events WHERE event_type='click' AND user_id IN (SELECT member FROM iv WHERE to_ts IS NULL AND entity=4)""")
def stream_roster_alerts(spark, sf):
    held = ACT.intervals(spark, sf)
    s = P.event_time(stream(spark, sf).where(F.col("event_type") == "click").withColumnRenamed("user_id", "member"))
    return P.drain(P.on_roster(s, held, 4).select("event_id", "member"), "roster")


@query("stream_news_attach", """
SELECT event_id, 'customer#'||lpad(cast(user_id*20 AS varchar),9,'0') AS norm, c_custkey AS member FROM events LEFT JOIN customer ON c_custkey=user_id*20 WHERE event_type='view'""")
def stream_news_attach(spark, sf):
    from contestlake.functions.names import normalize_name

    members = L.members(spark, sf).select(normalize_name(F.col("name")).alias("norm"), "member")
    name = F.concat(F.lit("  Custómer#"), F.lpad((F.col("user_id") * 20).cast("string"), 9, "0"))
    s = P.unseen(P.event_time(stream(spark, sf).where(F.col("event_type") == "view")), "event_id")
    return P.drain(P.attach_member(s, members, name).select("event_id", "norm", "member"), "news")


@query("stream_tumbling", """
WITH w AS (SELECT TIMESTAMP '2024-01-01'+to_days(cast(7*((cast(ts AS date)-DATE '2024-01-01')//7) AS integer)) AS start, event_type, count(*) AS n, cast(sum(cast(round(value*100) AS bigint)) AS bigint) AS cents FROM events GROUP BY 1,2)
SELECT start, event_type, n, cents FROM w WHERE start+INTERVAL 7 DAY<=(SELECT max(ts) FROM events)-INTERVAL 1 DAY""")
def stream_tumbling(spark, sf):
    s = P.event_time(stream(spark, sf))
    aggs = [F.count(F.lit(1)).alias("n"), F.sum(cents(F.col("value"))).alias("cents")]
    out = P.drain(P.tumbling(s, "ts", 7, "4 days", ["event_type"], aggs), "tumbling")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "cents")


@query("stream_sliding", """
WITH e AS (SELECT event_type, unnest(range(cast(ts AS date)-INTERVAL 13 DAY, cast(ts AS date)+INTERVAL 1 DAY, INTERVAL 1 DAY)) AS start FROM events)
SELECT start, event_type, count(*) AS n FROM e WHERE start+INTERVAL 14 DAY<=(SELECT max(ts) FROM events)-INTERVAL 1 DAY GROUP BY 1,2""")
def stream_sliding(spark, sf):
    s = P.event_time(stream(spark, sf))
    out = P.drain(P.sliding(s, "ts", 14, 1, ["event_type"], [F.count(F.lit(1)).alias("n")]), "sliding")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("stream_session", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts<lag(ts) OVER w+INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id AS member, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sid HAVING max(ts)+INTERVAL 6 HOUR<=(SELECT max(ts) FROM events)-INTERVAL 1 DAY""")
def stream_session(spark, sf):
    s = P.event_time(stream(spark, sf).withColumnRenamed("user_id", "member"))
    out = P.drain(P.sessions(s, "ts", "6 hours", ["member"], [F.count(F.lit(1)).alias("n")]), "session")
    return out.select("member", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stream_late_rows", """
SELECT o_orderkey FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS s FROM lineitem GROUP BY 1) ON l_orderkey=o_orderkey WHERE s>o_orderdate+INTERVAL 100 DAY""")
def stream_late_rows(spark, sf):
    schema = L.table(spark, sf, "lineitem").schema
    lines = P.parquet_stream(spark, f"{sf}/lineitem.parquet", schema)
    orders = L.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("occurred"))
    late = P.late_rows(lines.join(orders, "l_orderkey"), "occurred", "l_shipdate", 100)
    return P.drain(late.select(F.col("l_orderkey").alias("o_orderkey")), "late").distinct()


@query("stream_trend_state", """
WITH r AS (SELECT user_id AS member, ts, cast(round(value*100) AS bigint) AS cents, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_type='purchase'),
a AS (SELECT member, count(*) AS games, max(ts) AS newest, cast(sum(CASE WHEN rn<=2 THEN cents END) AS double)/count(CASE WHEN rn<=2 THEN 1 END) AS r, cast(sum(CASE WHEN rn>2 THEN cents END) AS double)/count(CASE WHEN rn>2 THEN 1 END) AS p FROM r WHERE rn<=7 GROUP BY 1),
d AS (SELECT *, """ + SIG.rnd("r-p", 2) + """ AS delta FROM a WHERE games>=4)
SELECT member, newest, CASE WHEN delta>0 THEN 'spend_up' ELSE 'spend_down' END AS kind, delta, """ + SIG.rnd("least(1.0,abs(delta)/20000.0)", 4) + """ AS strength FROM d WHERE abs(delta)>=2000""")
def stream_trend_state(spark, sf):
    def step(landed, root):
        rows = landed.where(F.col("event_type") == "purchase").select(
            F.col("user_id").alias("member"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), cents(F.col("value")).alias("amount"))
        return K.run(K.newest(rows, 7, 2), root)

    root, _ = K.in_parts(L.table(spark, sf, "events"), "ts", PARTS, step, "trend")
    return SG.trend_shift(K.newest_rows(spark, root), "amount", 2000.0, unit=20000.0, name="spend")


def acts(events):
    """Events as owners' actions."""
    k = F.get_json_object("props", "$.k").cast("long")
    entity = F.floor(k / 10).cast("long")
    action = F.create_map(*[F.lit(x) for kv in ACT.ACTIONS.items() for x in kv])[F.col("event_type")]
    return events.select(
        "event_id", "ts", F.col("user_id").alias("member"), entity.alias("entity"), action.alias("action"),
        F.when(F.col("event_type") == "purchase", (entity + 1) % 10).alias("counterparty"))


@query("stream_membership", "WITH " + ACT.SQL_ACTIONS + "SELECT entity, member, from_ts, to_ts, via, ended_by, status FROM iv")
def stream_membership(spark, sf):
    root, closed = K.in_parts(
        L.table(spark, sf, "events"), "ts", PARTS, lambda landed, root: K.run(K.closed_intervals(acts(landed), "ts", "event_id"), root), "membership")
    return K.all_intervals(spark, closed, root)


@query("stream_first_seen", """
WITH r AS (SELECT event_id, event_id%500 AS uid, ts, min(ts) OVER (PARTITION BY event_id%500) AS f,
  row_number() OVER (PARTITION BY event_id%500 ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, uid, ts, f AS first_at, n=1 AS is_new FROM r""")
def stream_first_seen(spark, sf):
    rows = L.table(spark, sf, "events").withColumn("uid", F.col("event_id") % 500)
    _, seen = K.in_parts(rows, "ts", PARTS, lambda landed, root: K.run(K.first_seen(landed, "uid", "ts", "event_id"), root), "sightings")
    return seen.select(F.col("place").alias("event_id"), "uid", K.stamp(F.col("at")).alias("ts"), K.stamp(F.col("first_at")).alias("first_at"), "is_new")


# A uid is new again when it was away for more than two days, and its state is gone by then.
@query("stream_expiring_dedup", """
WITH r AS (SELECT event_id, event_id%500 AS uid, ts, lag(ts) OVER (PARTITION BY event_id%500 ORDER BY ts, event_id) AS p FROM events)
SELECT event_id, uid FROM r WHERE p IS NULL OR ts>p+INTERVAL 2 DAY""")
def stream_expiring_dedup(spark, sf):
    rows = L.table(spark, sf, "events").withColumn("uid", F.col("event_id") % 500)
    _, seen = K.in_parts(rows, "ts", PARTS, lambda landed, root: K.run(K.first_seen(landed, "uid", "ts", "event_id", keep_days=2), root), "expiring")
    return seen.where("is_new").select(F.col("place").alias("event_id"), "uid")


@query("stream_follow_counts", ACT.SNIPE + "SELECT * FROM sn")
def stream_follow_counts(spark, sf):
    def step(landed, root):
        moves = acts(landed).select("member", "entity", "ts", "action")
        return P.drain(P.followed(moves.where(F.col("action") == "drop"), moves.where(F.col("action") == "add")), "follow", root)

    _, pairs = K.in_parts(L.table(spark, sf, "events"), "ts", PARTS, step, "follow")
    return pairs.groupBy("victim", "sniper").agg(F.count(F.lit(1)).alias("n"))

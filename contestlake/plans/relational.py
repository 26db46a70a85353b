"""Join, aggregation, ordering, set and scalar shapes on the driver tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from contestlake.functions import texts as T
from contestlake.functions.calendars import Calendar
from contestlake.functions.rates import cents, fixed, is_barrel, number, ratio
from contestlake.operators import aggregates as A
from contestlake.operators import joins as J
from contestlake.operators import ranking
from contestlake.plans import league as L
from contestlake.plans.registry import query, rnd
from contestlake.session import run_dir
from contestlake.sources import sinks, versions

WEEKS = Calendar(date(2024, 1, 1), date(2024, 1, 8), 5)


def events(spark, sf):
    return L.table(spark, sf, "events")


# --- joins -----------------------------------------------------------------


@query("latest_snapshot_asof", """
SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate=(SELECT max(o_orderdate) FROM orders WHERE o_orderdate<=TIMESTAMP '2000-02-29 00:00:00')""")
def latest_snapshot_asof(spark, sf):
    seen = L.table(spark, sf, "orders").where(F.col("o_orderdate") <= F.lit(datetime(2000, 2, 29)).cast("timestamp_ntz"))
    return ranking.newest(seen.select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderdate")


@query("range_to_equi_join", """
WITH p AS (SELECT i AS number, DATE '2024-01-01'+cast(7*(i-1) AS integer) AS s, DATE '2024-01-01'+cast(7*i-1 AS integer) AS e FROM range(1,6) t(i))
SELECT cast(number AS integer) AS number, s AS start_date, e AS end_date, count(*) AS n, cast(sum(cast(round(value*100) AS bigint)) AS bigint) AS cents FROM events JOIN p ON cast(ts AS date) BETWEEN s AND e GROUP BY 1,2,3""")
def range_to_equi_join(spark, sf):
    periods = WEEKS.table(spark).select("number", "start_date", "end_date")
    joined = J.in_period(events(spark, sf), periods, WEEKS.number(F.to_date("ts")))
    return joined.groupBy("number", "start_date", "end_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents(F.col("value"))).alias("cents"))


@query("semi_universe", """
SELECT c_custkey AS member, c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice>400000)
 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderpriority='1-URGENT' AND o_orderstatus='P') OR c_acctbal>9000""")
def semi_universe(spark, sf):
    o = L.table(spark, sf, "orders").withColumnRenamed("o_custkey", "member")
    c = L.table(spark, sf, "customer").withColumnRenamed("c_custkey", "member")
    known = J.universe("member", o.where(F.col("o_totalprice") > 400000),
                       o.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")),
                       c.where(F.col("c_acctbal") > 9000))
    return J.only_known(c.select("member", F.col("c_name").alias("name")), known, "member")


@query("optional_left", """
SELECT p_partkey AS part, p_brand AS brand, coalesce(n,0) AS returns, coalesce(n,9999) AS rank_key FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag='R' AND l_quantity>40 GROUP BY 1) ON l_partkey=p_partkey""")
def optional_left(spark, sf):
    back = L.table(spark, sf, "lineitem").where((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40)).groupBy(
        F.col("l_partkey").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    parts = L.table(spark, sf, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"))
    return parts.join(back, "part", "left").select(
        "part", "brand", F.coalesce("n", F.lit(0)).alias("returns"), F.coalesce("n", F.lit(9999)).alias("rank_key"))


@query("orphans", """
SELECT 'orders_without_lines' AS relation, count(*) AS orphans FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'customers_without_orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'parts_without_lines', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)
UNION ALL SELECT 'suppliers_without_lines', count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)
UNION ALL SELECT 'documents_without_label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def orphans(spark, sf):
    t = lambda n: L.table(spark, sf, n)
    li = t("lineitem")
    return J.orphan_counts({
        "orders_without_lines": (t("orders").select(F.col("o_orderkey").alias("k")), li.select(F.col("l_orderkey").alias("k")), ["k"]),
        "customers_without_orders": (t("customer").select(F.col("c_custkey").alias("k")), t("orders").select(F.col("o_custkey").alias("k")), ["k"]),
        "parts_without_lines": (t("part").select(F.col("p_partkey").alias("k")), li.select(F.col("l_partkey").alias("k")), ["k"]),
        "suppliers_without_lines": (t("supplier").select(F.col("s_suppkey").alias("k")), li.select(F.col("l_suppkey").alias("k")), ["k"]),
        "documents_without_label": (t("documents").select(F.col("doc_id").alias("k")), t("labels").select(F.col("doc_id").alias("k")), ["k"]),
    })


@query("star_join", """
SELECT r_name AS region, year(o_orderdate) AS year, count(*) AS lines, cast(sum(cast(round(l_extendedprice*100) AS bigint)) AS bigint) AS cents
FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY 1,2""")
def star_join(spark, sf):
    per_order = L.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(cents(F.col("l_extendedprice"))).alias("cents"))
    o = L.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("member"), F.year("o_orderdate").alias("year"))
    per_member = per_order.join(o, "o_orderkey").groupBy("member", "year").agg(F.sum("lines").alias("lines"), F.sum("cents").alias("cents"))
    place = L.table(spark, sf, "nation").join(L.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("entity"), F.col("r_name").alias("region"))
    who = per_member.join(L.members(spark, sf).select("member", "entity"), "member").groupBy("entity", "year").agg(
        F.sum("lines").alias("lines"), F.sum("cents").alias("cents"))
    return who.join(place, "entity").groupBy("region", "year").agg(F.sum("lines").alias("lines"), F.sum("cents").alias("cents"))


@query("list_parameter_join", """
WITH w AS (SELECT DISTINCT user_id, unnest([user_id, user_id+1000000]) AS member FROM events WHERE event_type='signup')
SELECT member, count(event_id) AS n FROM w LEFT JOIN events e ON e.user_id=w.member GROUP BY 1""")
def list_parameter_join(spark, sf):
    wanted = events(spark, sf).where(F.col("event_type") == "signup").select("user_id").distinct().select(
        F.explode(F.array("user_id", F.col("user_id") + 1000000)).alias("member"))
    seen = events(spark, sf).groupBy(F.col("user_id").alias("member")).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(seen, "member", "left").select("member", F.coalesce("n", F.lit(0)).alias("n"))


# --- ordering and sets -----------------------------------------------------


@query("top_rows_nulls_last", """
SELECT p_partkey AS part, cast(n AS bigint) AS n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity>49 GROUP BY 1) ON l_partkey=p_partkey ORDER BY n ASC NULLS LAST, p_partkey LIMIT 15""")
def top_rows_nulls_last(spark, sf):
    n = L.table(spark, sf, "lineitem").where(F.col("l_quantity") > 49).groupBy(F.col("l_partkey").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    parts = L.table(spark, sf, "part").select(F.col("p_partkey").alias("part"))
    return parts.join(n, "part", "left").orderBy(F.asc_nulls_last("n"), "part").limit(15)


@query("top_and_bottom", """
WITH m AS (SELECT l_suppkey AS venue, cast(sum(cast(l_quantity AS bigint)) AS bigint) AS qty FROM lineitem GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY qty DESC, venue) AS hi, row_number() OVER (ORDER BY qty, venue) AS lo FROM m)
SELECT 'top' AS side, venue, qty FROM r WHERE hi<=3 UNION ALL SELECT 'bottom', venue, qty FROM r WHERE lo<=3""")
def top_and_bottom(spark, sf):
    m = L.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("venue")).agg(F.sum(F.col("l_quantity").cast("long")).alias("qty"))
    top = m.orderBy(F.desc("qty"), "venue").limit(3).select(F.lit("top").alias("side"), "venue", "qty")
    return top.unionByName(m.orderBy("qty", "venue").limit(3).select(F.lit("bottom").alias("side"), "venue", "qty"))


@query("newest_row", """
SELECT user_id AS member, arg_max(event_type,(ts,event_id)) AS last_action, max(ts) AS last_seen FROM events GROUP BY 1""")
def newest_row(spark, sf):
    return events(spark, sf).groupBy(F.col("user_id").alias("member")).agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_action"), F.max("ts").alias("last_seen"))


@query("tiered_sort", """
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 12""")
def tiered_sort(spark, sf):
    tier = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    return L.table(spark, sf, "orders").orderBy(tier, F.desc("o_totalprice"), "o_orderkey").limit(12).select(
        "o_orderkey", "o_orderpriority", "o_totalprice")


@query("set_difference", """
SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_returnflag='R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag='N' AND l_quantity>45""")
def set_difference(spark, sf):
    li = L.table(spark, sf, "lineitem")
    part = F.col("l_partkey").alias("part")
    kept = li.where((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 45)).select(part)
    return J.without(li.where(F.col("l_returnflag") == "R").select(part).distinct(), kept, ["part"])


@query("set_intersection", """
SELECT l_suppkey AS venue, l_partkey AS part FROM lineitem WHERE l_returnflag='R' INTERSECT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag='A'""")
def set_intersection(spark, sf):
    li = L.table(spark, sf, "lineitem")
    pick = [F.col("l_suppkey").alias("venue"), F.col("l_partkey").alias("part")]
    return li.where(F.col("l_returnflag") == "R").select(*pick).intersect(li.where(F.col("l_returnflag") == "A").select(*pick))


@query("union_all_sources", """
SELECT 'customer' AS source, c_nationkey AS entity, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2""")
def union_all_sources(spark, sf):
    c = L.table(spark, sf, "customer").select(F.lit("customer").alias("source"), F.col("c_nationkey").alias("entity"))
    s = L.table(spark, sf, "supplier").select(F.lit("supplier").alias("source"), F.col("s_nationkey").alias("entity"))
    return c.unionByName(s).groupBy("source", "entity").agg(F.count(F.lit(1)).alias("n"))


# --- scalars ---------------------------------------------------------------


@query("json_extract", "SELECT event_id, cast(json_extract_string(props,'$.k') AS bigint) AS k FROM events")
def json_extract(spark, sf):
    return events(spark, sf).select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("map_stats", """
SELECT event_id, CASE WHEN event_type='click' THEN NULL ELSE value END AS v, cast(user_id AS double) AS u, cast(-1.0 AS double) AS missing FROM events""")
def map_stats(spark, sf):
    pairs = F.array(
        F.concat(F.lit("v="), F.when(F.col("event_type") == "click", "n/a").otherwise(F.col("value").cast("string"))),
        F.concat(F.lit("u="), F.col("user_id").cast("string")), F.lit("noise"))
    stats = T.stat_map(pairs)
    return events(spark, sf).select(
        "event_id", F.try_element_at(stats, F.lit("v")).alias("v"), T.stat(stats, "u").alias("u"), T.stat(stats, "zz", -1.0).alias("missing"))


@query("calendar_periods", """
SELECT event_id, cast(floor((cast(ts AS date)-DATE '2024-01-01')/7)+1 AS integer) AS period,
 cast(floor((cast(ts AS date)-DATE '2024-01-01')/7)+1+CASE WHEN isodow(ts)=1 THEN 0 ELSE 1 END AS integer) AS next_open,
 cast(floor((cast(ts AS date)-DATE '2024-01-01')/7)+1+CASE WHEN isodow(ts)=7 THEN 1 ELSE 0 END AS integer) AS pool_target FROM events""")
def calendar_periods(spark, sf):
    day = F.to_date("ts")
    return events(spark, sf).select("event_id", WEEKS.number(day).alias("period"), WEEKS.next_open(day).alias("next_open"),
                                    WEEKS.pool_target(day).alias("pool_target"))


@query("return_time_text", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity%4=0 THEN NULL WHEN l_quantity%4=1 THEN cast(l_linenumber AS double) WHEN l_quantity%4=2 THEN (l_linenumber+l_linenumber+2)/2.0 ELSE l_linenumber*4.0 END AS weeks FROM lineitem""")
def return_time_text(spark, sf):
    n = F.col("l_linenumber")
    q = F.col("l_quantity").cast("long") % 4
    text = (F.when(q == 0, "out indefinitely").when(q == 1, F.concat(F.lit("expected back in "), n.cast("string"), F.lit(" weeks")))
            .when(q == 2, F.concat(F.lit("will miss "), n.cast("string"), F.lit("-to-"), (n + 2).cast("string"), F.lit(" Weeks")))
            .otherwise(F.concat(n.cast("string"), F.lit(" months"))))
    return L.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.return_weeks(text).alias("weeks"))


@query("resource_pace", """
SELECT c_custkey AS member, CASE WHEN ok THEN c_acctbal END AS used, CASE WHEN ok THEN cast(c_custkey%1500 AS double) END AS pace_final,
 CASE WHEN ok THEN 1300.0-c_custkey%1500 END AS headroom, CASE WHEN ok THEN c_custkey%1500>=1000 END AS reaches_floor
FROM (SELECT *, c_custkey%5<>0 AND c_acctbal>=0 AS ok FROM customer)""")
def resource_pace(spark, sf):
    k = F.col("c_custkey")
    bal = F.format_string("%.2f", "c_acctbal")
    page = F.concat(F.lit("Min/Max Info\nYear to Date\t"), F.when(k % 5 == 0, "??").otherwise(bal), F.lit("\nOn Pace\t"), (k % 1500).cast("string"), F.lit(".0\n"))
    rows = L.table(spark, sf, "customer")  # a negative balance is no number on the page
    return rows.select(k.alias("member"), T.pace(page, 1300, 1000).alias("p")).select("member", "p.*")


@query("odds_bars", f"""
WITH c AS (SELECT l_suppkey AS venue, count(*) AS n FROM lineitem GROUP BY 1)
SELECT venue, repeat('#', cast(floor(cast(n AS double)/(SELECT max(n) FROM c)*36+cast(0.5 AS double)) AS integer)) AS bar FROM c""")
def odds_bars(spark, sf):
    c = L.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("venue")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("venue", T.bar(F.col("n"), c.agg(F.max("n")).scalar()).alias("bar"))


@query("launch_window", """
SELECT l_orderkey, l_linenumber, l_partkey, 60+l_quantity>=98 AND l_linenumber*7 BETWEEN greatest(8.0,26.0-(60+l_quantity-98)*cast(1.2 AS double)) AND least(50.0,30.0+(60+l_quantity-98)*1.5) AS hit FROM lineitem""")
def launch_window(spark, sf):
    return L.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", is_barrel(60 + F.col("l_quantity"), F.col("l_linenumber") * 7).alias("hit"))


@query("safe_numbers", "SELECT p_partkey, try_cast(CASE WHEN p_size%3=0 THEN 'n/a' ELSE cast(p_size AS varchar) END AS double) AS n FROM part")
def safe_numbers(spark, sf):
    text = F.when(F.col("p_size") % 3 == 0, "n/a").otherwise(F.col("p_size").cast("string"))
    return L.table(spark, sf, "part").select("p_partkey", number(text).alias("n"))


@query("freshness", """
WITH a AS (SELECT event_type AS agent, max(ts) AS seen FROM events GROUP BY 1), b AS (SELECT *, date_sub('second', seen, TIMESTAMP '2024-01-31 00:10:00')/60.0 AS age FROM a)
SELECT agent, seen, CASE WHEN age<10 THEN 'healthy' WHEN age<40 THEN 'stale' ELSE 'down' END AS status FROM b""")
def freshness(spark, sf):
    now = F.lit(datetime(2024, 1, 31, 0, 10)).cast("timestamp_ntz")
    seen = events(spark, sf).groupBy(F.col("event_type").alias("agent")).agg(F.max("ts").alias("seen"))
    return seen.select("agent", "seen", T.freshness(F.timestamp_diff("SECOND", "seen", now) / 60.0).alias("status"))


# --- aggregates, profiles, sinks -------------------------------------------


@query("source_scoreboard", f"""
WITH p AS (SELECT user_id AS member, cast((cast(ts AS date)-DATE '2024-01-01')//7+1 AS integer) AS period, 'K'||(user_id%3) AS stat, avg(cast(json_extract_string(props,'$.k') AS bigint)) AS projected FROM events WHERE event_type='view' GROUP BY 1,2,3),
r AS (SELECT user_id AS member, cast((cast(ts AS date)-DATE '2024-01-01')//7+1 AS integer) AS period, avg(cast(json_extract_string(props,'$.k') AS bigint)) AS realised FROM events WHERE event_type='purchase' GROUP BY 1,2)
SELECT stat, count(*) AS n, {rnd("cast(sum(cast(floor(abs(projected-coalesce(realised,0))*cast(10000 AS double)+cast(0.5 AS double)) AS bigint)) AS double)*cast(0.0001 AS double)/count(*)", 4)} AS mae FROM p LEFT JOIN r ON r.member=p.member AND r.period=p.period GROUP BY 1""")
def source_scoreboard(spark, sf):
    rows = events(spark, sf).select(
        F.col("user_id").alias("member"), WEEKS.number(F.to_date("ts")).alias("period"), "event_type",
        F.get_json_object("props", "$.k").cast("long").alias("k"))
    mean = ratio(F.sum("k"), F.count("k"))
    projected = rows.where(F.col("event_type") == "view").groupBy("member", "period").agg(mean.alias("projected")).withColumn(
        "stat", F.concat(F.lit("K"), (F.col("member") % 3).cast("string")))
    realised = rows.where(F.col("event_type") == "purchase").groupBy("member", "period").agg(mean.alias("realised"))
    return A.source_error(projected, realised, ["member", "period"], "stat")


TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@query("profile_tables", "\nUNION ALL ".join(
    f"""SELECT '{t}' AS table_name, column_name, (SELECT count(*) FROM {t}) AS row_count, non_null
FROM (UNPIVOT (SELECT count(COLUMNS('(.+)')) AS "\\1" FROM {t}) ON COLUMNS(*) INTO NAME column_name VALUE non_null)""" for t in TABLES))
def profile_tables(spark, sf):
    """Every column of every table."""
    out = None
    for name in TABLES:
        rows = A.profile_table(L.table(spark, sf, name), name)
        out = rows if out is None else out.unionByName(rows)
    return out.select("table_name", "column_name", "row_count", "non_null")


@query("conditional_sums", """
SELECT c_mktsegment AS role, cast(sum(CASE WHEN o_orderstatus='F' THEN 1 ELSE 0 END) AS bigint) AS f, cast(sum(CASE WHEN o_orderdate>TIMESTAMP '2001-01-01' THEN 1 ELSE 0 END) AS bigint) AS late, count(DISTINCT o_custkey) AS members FROM orders JOIN customer ON c_custkey=o_custkey GROUP BY 1""")
def conditional_sums(spark, sf):
    cut = F.lit(datetime(2001, 1, 1)).cast("timestamp_ntz")
    per = L.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("member")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderdate") > cut).alias("late"))
    return per.join(L.members(spark, sf).select("member", "role"), "member").groupBy("role").agg(
        F.sum("f").alias("f"), F.sum("late").alias("late"), F.count(F.lit(1)).alias("members"))


@query("argmax_key", """
WITH c AS (SELECT user_id AS member, event_type, count(*) AS n FROM events GROUP BY 1,2) SELECT member, arg_max(event_type,(n,event_type)) AS main_kind, cast(max(n) AS bigint) AS n FROM c GROUP BY 1""")
def argmax_key(spark, sf):
    c = events(spark, sf).groupBy(F.col("user_id").alias("member"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("member").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("main_kind"), F.max("n").alias("n"))


@query("expanding_sum", """
WITH d AS (SELECT user_id AS member, cast(ts AS date) AS day, cast(sum(cast(round(value*100) AS bigint)) AS bigint) AS cents FROM events GROUP BY 1,2)
SELECT member, day, cents, cast(sum(cents) OVER (PARTITION BY member ORDER BY day) AS bigint) AS so_far FROM d""")
def expanding_sum(spark, sf):
    from contestlake.operators import scan

    d = events(spark, sf).groupBy(F.col("user_id").alias("member"), F.to_date("ts").alias("day")).agg(F.sum(cents(F.col("value"))).alias("cents"))
    return scan.running_sum(d, ["member"], ["day"], F.year("day") * 12 + F.month("day"), {"cents": "so_far"})


@query("upsert_idempotent", """
WITH a AS (SELECT user_id%50 AS uid, ts AS observed_at, event_id, event_type FROM events) SELECT uid, max(ts) AS observed_at, arg_max(event_type,(ts,event_id)) AS event_type, arg_max(event_id,(ts,event_id)) AS event_id
FROM (SELECT user_id%50 AS uid, ts, event_id, event_type FROM events) GROUP BY uid""")
def upsert_idempotent(spark, sf):
    rows = events(spark, sf).select((F.col("user_id") % 50).alias("uid"), F.col("ts").alias("observed_at"), "event_id", "event_type")
    cut = F.lit(datetime(2024, 1, 16)).cast("timestamp_ntz")
    old, new = rows.where(F.col("observed_at") < cut), rows.where(F.col("observed_at") >= cut)
    once = sinks.merged(old, new, ["uid"], "observed_at")
    return sinks.merged(once, new, ["uid"], "observed_at")


@query("first_seen_flags", """
SELECT user_id*100+cast(json_extract_string(props,'$.k') AS bigint) AS uid, min(ts) AS first_seen, min(ts)>=TIMESTAMP '2024-01-16' AS is_new FROM events GROUP BY 1""")
def first_seen_flags(spark, sf):
    uid = F.col("user_id") * 100 + F.get_json_object("props", "$.k").cast("long")
    rows = events(spark, sf).select(uid.alias("uid"), "ts")
    cut = F.lit(datetime(2024, 1, 16)).cast("timestamp_ntz")
    old = rows.where(F.col("ts") < cut).groupBy("uid").agg(F.min("ts").alias("first_seen"))
    return sinks.first_seen(old, rows.where(F.col("ts") >= cut).select("uid", F.col("ts").alias("seen_at")), "uid")


@query("null_safe_merge", """
SELECT c_custkey AS uid, coalesce(CASE WHEN c_custkey%3=0 THEN NULL ELSE c_acctbal END, cast(-1.0 AS double)) AS balance, CASE WHEN c_custkey%2=0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS role FROM customer""")
def null_safe_merge(spark, sf):
    k = F.col("c_custkey")
    c = L.table(spark, sf, "customer")
    old = c.select(k.alias("uid"), F.lit(-1.0).alias("balance"), F.col("c_mktsegment").alias("role"))
    new = c.select(k.alias("uid"), F.when(k % 3 != 0, F.col("c_acctbal")).alias("balance"), F.when(k % 2 == 0, F.lower("c_mktsegment")).alias("role"))
    return sinks.filled(old, new, ["uid"], ["balance", "role"])


@query("guarded_update", """
SELECT c_custkey AS uid, CASE WHEN c_custkey%4=0 THEN NULL WHEN c_custkey%4=1 THEN c_custkey ELSE c_custkey+1 END AS s0, coalesce(CASE WHEN c_custkey%4=0 THEN NULL WHEN c_custkey%4=1 THEN c_custkey ELSE c_custkey+1 END, c_custkey) AS strong_id,
 CASE WHEN c_custkey%4<=1 THEN lower(c_mktsegment) ELSE c_mktsegment END AS role FROM customer""")
def guarded_update(spark, sf):
    k = F.col("c_custkey")
    c = L.table(spark, sf, "customer")
    s = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, k).otherwise(k + 1)
    old = c.select(k.alias("uid"), s.alias("s0"), s.alias("strong_id"), F.col("c_mktsegment").alias("role"))
    new = c.select(k.alias("uid"), k.alias("strong_id"), F.lower("c_mktsegment").alias("role"))
    return sinks.guarded(old, new, ["uid"], "strong_id", ["role"])


@query("closed_periods_only", """
SELECT cast((cast(ts AS date)-DATE '2024-01-01')//7+1 AS integer) AS period, count(*) AS n FROM events WHERE DATE '2024-01-01'+cast(7*((cast(ts AS date)-DATE '2024-01-01')//7+1)-1 AS integer)<DATE '2024-01-24' GROUP BY 1""")
def closed_periods_only(spark, sf):
    rows = events(spark, sf).withColumn("period", WEEKS.number(F.to_date("ts")))
    return sinks.closed_only(rows, WEEKS.end(F.col("period")), date(2024, 1, 24)).groupBy("period").agg(F.count(F.lit(1)).alias("n"))


@query("latency_ledger", f"""
WITH x AS (SELECT o_orderkey, l_linenumber, l_partkey, cast(l_shipdate AS date)-cast(o_orderdate AS date) AS lag, o_orderpriority FROM orders JOIN lineitem ON l_orderkey=o_orderkey)
SELECT o_orderpriority AS priority, count(*) AS n, cast(min(lag) AS bigint) AS low, cast(max(lag) AS bigint) AS high, {rnd("cast(sum(lag) AS double)/count(*)", 4)} AS mean FROM x GROUP BY 1""")
def latency_ledger(spark, sf):
    """Observation minus occurrence: days from an order to its line's shipping."""
    li = L.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.to_date("l_shipdate").alias("seen"))
    o = L.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("done"), F.col("o_orderpriority").alias("priority"))
    lag = F.datediff("seen", "done").cast("long")
    return li.join(o, "o_orderkey").groupBy("priority").agg(
        F.count(F.lit(1)).alias("n"), F.min(lag).alias("low"), F.max(lag).alias("high"), fixed(F.sum(lag) / F.count(F.lit(1)), 4).alias("mean"))


@query("versioned_payloads", """
SELECT c_custkey AS uid, CASE WHEN c_acctbal>0 THEN 'v2' ELSE 'v1' END AS model_version, CASE WHEN c_acctbal>0 THEN 'live' ELSE 'stale' END AS status,
  json_extract_string(to_json({r: CASE WHEN c_acctbal>0 THEN lower(c_mktsegment) ELSE c_mktsegment END}), '$.r') AS role FROM customer""")
def versioned_payloads(spark, sf):
    """Payloads of two model versions; what the second no longer derives is stale."""
    c = L.table(spark, sf, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("role"))
    table = versions.Table(spark, run_dir(spark, "payloads"))
    first = versions.payloads(c.select("uid", "role"), "uid", "v1", datetime(2024, 1, 1))
    table.derive(first, ["uid"], "v1")
    live = c.where("balance > 0").select("uid", F.lower("role").alias("role"))
    _, stale = table.derive(versions.payloads(live, "uid", "v2", datetime(2024, 1, 8)), ["uid"], "v2")
    both = table.read().withColumn("status", F.lit("live")).unionByName(stale.withColumn("status", F.lit("stale")))
    return both.select("uid", "model_version", "status", F.get_json_object("payload", "$.role").alias("role"))


@query("versioned_upsert", """
SELECT event_id%200 AS uid, max(ts) AS observed_at, arg_max(event_id,(ts,event_id)) AS event_id, max(ts)<TIMESTAMP '2024-01-16' AS unchanged FROM events GROUP BY 1""")
def versioned_upsert(spark, sf):
    """Two upserts as two versions; rows equal in both were left alone by the second."""
    rows = events(spark, sf).select((F.col("event_id") % 200).alias("uid"), F.col("ts").alias("observed_at"), "event_id")
    cut = F.lit(datetime(2024, 1, 16)).cast("timestamp_ntz")
    table = versions.Table(spark, run_dir(spark, "upserts"))
    first = table.upsert(rows.where(F.col("observed_at") < cut), ["uid"], "observed_at")
    table.upsert(rows.where(F.col("observed_at") >= cut), ["uid"], "observed_at")
    before = table.read(first.version).withColumn("unchanged", F.lit(True))
    return table.read().join(before, ["uid", "observed_at", "event_id"], "left").withColumn("unchanged", F.coalesce("unchanged", F.lit(False)))

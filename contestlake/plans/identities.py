"""Identity queries: customers seen through two name systems."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestlake.functions import names as N
from contestlake.functions.rates import fixed
from contestlake.operators import aggregates as A
from contestlake.operators import identity as D
from contestlake.operators import joins as J
from contestlake.plans import league as L
from contestlake.plans.registry import query, rnd


@query("normalise_name", """
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(strip_accents(text)),'[.'']','','g'),'\\s+',' ','g'))) AS norm_md5,
  length(trim(regexp_replace(regexp_replace(lower(strip_accents(text)),'[.'']','','g'),'\\s+',' ','g'))) AS norm_len FROM documents""")
def normalise_name(spark, sf):
    norm = N.normalize_name(F.col("text"))
    return L.table(spark, sf, "documents").select("doc_id", F.md5(norm).alias("norm_md5"), F.length(norm).cast("long").alias("norm_len"))


@query("deterministic_uid", """
SELECT event_id, substr(sha1(strftime(ts,'%Y-%m-%dT%H:%M:%S')||'|'||user_id||'|'||list_aggregate(list_sort([lower(event_type)||':a', 'k'||json_extract_string(props,'$.k')||':b']),'string_agg',';')),1,16) AS uid FROM events""")
def deterministic_uid(spark, sf):
    k = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    acts = F.array(
        F.struct(F.col("event_type").alias("player"), F.lit("a").alias("action")),
        F.struct(k.alias("player"), F.lit("b").alias("action")))
    uid = N.transaction_uid(F.col("ts"), F.col("user_id").cast("string"), acts)
    return L.table(spark, sf, "events").select("event_id", uid.alias("uid"))


def people(spark, sf):
    """Two name systems over the customers; pairs of customers share a last name."""
    k = F.col("c_custkey")
    base = F.concat(F.initcap("c_mktsegment"), F.lit(" N"), F.floor(k / 2).cast("string"))
    varied = (
        F.when(k % 7 == 0, F.concat(base, F.lit(" Jr.")))
        .when(k % 11 == 0, F.concat(F.substring("c_mktsegment", 1, 1), F.lit(". N"), F.floor(k / 2).cast("string")))
        .when(k % 13 == 0, F.translate(base, "ui", "üí")).otherwise(base))
    flag = F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    rows = L.table(spark, sf, "customer")
    targets = rows.select(k.alias("target_id"), N.normalize_name(base).alias("norm"), flag.alias("flag"),
                          F.col("c_nationkey").alias("team"))
    sources = rows.select(k.alias("source_id"), N.normalize_name(varied).alias("norm"),
                          F.when(k % 5 != 0, flag).alias("flag"), F.col("c_nationkey").alias("team"), (k % 3 != 0).alias("rostered"))
    return sources, targets


MATCH = """
WITH b AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_nationkey AS team, c_mktsegment IN ('BUILDING','MACHINERY') AS fl, c_custkey//2 AS half FROM customer),
tg AS (SELECT k AS target_id, lower(seg)||' n'||half AS norm, fl AS flag, team FROM b),
sr AS (SELECT k AS source_id, CASE WHEN k%7=0 THEN lower(seg)||' n'||half||' jr' WHEN k%11=0 THEN lower(substr(seg,1,1))||' n'||half ELSE lower(seg)||' n'||half END AS norm,
  CASE WHEN k%5<>0 THEN fl END AS flag, team, k%3<>0 AS rostered FROM b),
ks AS (SELECT *, 0 AS strength, norm AS key FROM sr UNION ALL SELECT *, 1, regexp_replace(norm,' (jr|sr|ii|iii|iv)$','') FROM sr WHERE rostered
  UNION ALL SELECT *, 2, list_extract(string_split(regexp_replace(norm,' (jr|sr|ii|iii|iv)$',''),' '),-1)||'|'||substr(norm,1,1) FROM sr WHERE rostered),
kt AS (SELECT *, 0 AS strength, norm AS key FROM tg UNION ALL SELECT *, 1, regexp_replace(norm,' (jr|sr|ii|iii|iv)$','') FROM tg
  UNION ALL SELECT *, 2, list_extract(string_split(regexp_replace(norm,' (jr|sr|ii|iii|iv)$',''),' '),-1)||'|'||substr(norm,1,1) FROM tg),
cand AS (SELECT s.source_id, s.strength, s.flag AS sf, s.team AS steam, t.target_id, t.flag AS tf, t.team AS tteam,
  count(*) OVER (PARTITION BY s.source_id, s.strength) AS n,
  count(*) FILTER (WHERE s.flag IS NULL OR t.flag=s.flag) OVER (PARTITION BY s.source_id, s.strength) AS nf
  FROM ks s JOIN kt t ON s.strength=t.strength AND s.key=t.key),
nar AS (SELECT * FROM cand WHERE n=1 OR ((sf IS NULL OR tf=sf) AND (nf<=1 OR tteam=steam))),
cnt AS (SELECT source_id, strength, count(*) AS candidates, min(target_id) AS tid FROM nar GROUP BY 1,2),
fst AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY strength) AS r FROM cnt),
m AS (SELECT sr.source_id, coalesce(candidates,0) AS candidates, CASE WHEN candidates=1 THEN tid END AS target_id,
  CASE strength WHEN 0 THEN 'exact' WHEN 1 THEN 'stripped' WHEN 2 THEN 'last_initial' END AS matched_by, strength,
  CASE WHEN candidates=1 THEN 'matched' WHEN candidates>1 THEN 'ambiguous' ELSE 'unmatched' END AS status
  FROM sr LEFT JOIN (SELECT * FROM fst WHERE r=1) f ON f.source_id=sr.source_id),
cl AS (SELECT *, count(*) OVER (PARTITION BY target_id) AS claims, min(strength) OVER (PARTITION BY target_id) AS best FROM m WHERE status='matched'),
cb AS (SELECT *, count(*) FILTER (WHERE strength=best) OVER (PARTITION BY target_id) AS at_best FROM cl),
fin AS (SELECT m.source_id, CASE WHEN m.status='matched' AND NOT (claims=1 OR (m.strength=best AND at_best=1)) THEN NULL ELSE m.target_id END AS target_id,
  m.matched_by, m.strength, CASE WHEN m.status='matched' AND NOT (claims=1 OR (m.strength=best AND at_best=1)) THEN 'rejected' ELSE m.status END AS status
  FROM m LEFT JOIN cb ON cb.source_id=m.source_id)
"""


@query("name_cascade", MATCH + "SELECT source_id, candidates, target_id, matched_by, strength, status FROM m")
def name_cascade(spark, sf):
    out = D.cascade(*people(spark, sf))
    return out.select("source_id", "candidates", "target_id", "matched_by", "strength", "status")


@query("name_crosswalk", MATCH + "SELECT * FROM fin")
def name_crosswalk(spark, sf):
    return D.resolve_collisions(D.cascade(*people(spark, sf)))


@query("crosswalk_overrides", MATCH + """, ov AS (SELECT c_custkey AS source_id, c_custkey AS forced_id FROM customer WHERE c_acctbal>9000)
SELECT fin.source_id, coalesce(forced_id, target_id) AS target_id, CASE WHEN forced_id IS NOT NULL THEN 'override' ELSE status END AS status
FROM fin LEFT JOIN ov ON ov.source_id=fin.source_id""")
def crosswalk_overrides(spark, sf):
    forced = L.table(spark, sf, "customer").where(F.col("c_acctbal") > 9000).select(
        F.col("c_custkey").alias("source_id"), F.col("c_custkey").alias("forced_id"))
    return D.apply_overrides(name_crosswalk(spark, sf), forced)


# --- merges and splits -----------------------------------------------------


def nodes(spark, sf):
    """Customers as nodes; every third pair shares a strong id."""
    k = F.col("c_custkey")
    strong = F.when(k % 6 < 2, F.floor(k / 6)).when(k % 6 < 5, -k)
    degree = L.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("degree"))
    return L.table(spark, sf, "customer").join(degree, "c_custkey", "left").select(
        k.alias("uid"), strong.cast("long").alias("strong_id"), F.when(k % 4 == 0, k).alias("other_id"),
        F.coalesce("degree", F.lit(0)).alias("degree"), F.col("c_name").alias("name"),
        F.when(k % 2 == 0, F.col("c_mktsegment")).alias("role"))


NODES = """
WITH dg AS (SELECT o_custkey, count(*) AS degree FROM orders GROUP BY 1),
nd AS (SELECT c_custkey AS uid, CASE WHEN c_custkey%6<2 THEN c_custkey//6 WHEN c_custkey%6<5 THEN -c_custkey END AS strong_id,
  CASE WHEN c_custkey%4=0 THEN c_custkey END AS other_id, coalesce(degree,0) AS degree, c_name AS name,
  CASE WHEN c_custkey%2=0 THEN c_mktsegment END AS role FROM customer LEFT JOIN dg ON o_custkey=c_custkey),
rk AS (SELECT *, row_number() OVER w AS r, first_value(uid) OVER w AS canonical FROM nd WHERE strong_id IS NOT NULL
  WINDOW w AS (PARTITION BY strong_id ORDER BY (other_id IS NOT NULL) DESC, degree DESC, length(name) DESC, uid)),
al AS (SELECT uid AS alias, canonical, strong_id FROM rk WHERE r>1)
"""


@query("dup_merge", NODES + "SELECT * FROM al")
def dup_merge(spark, sf):
    return D.merge_aliases(nodes(spark, sf))


@query("merged_properties", NODES + """
SELECT coalesce(canonical, uid) AS uid, arg_max(role, (CASE WHEN canonical IS NULL THEN 1 ELSE 0 END, -uid)) FILTER (WHERE role IS NOT NULL) AS role,
  arg_max(other_id, (CASE WHEN canonical IS NULL THEN 1 ELSE 0 END, -uid)) FILTER (WHERE other_id IS NOT NULL) AS other_id
FROM nd LEFT JOIN al ON al.alias=nd.uid GROUP BY 1""")
def merged_properties(spark, sf):
    n = nodes(spark, sf)
    return D.merged_properties(n, D.merge_aliases(n), ["role", "other_id"])


@query("rewrite_foreign_keys", NODES + """
SELECT coalesce(canonical, o_custkey) AS member, count(*) AS orders FROM orders LEFT JOIN al ON alias=o_custkey GROUP BY 1""")
def rewrite_foreign_keys(spark, sf):
    counts = L.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("member")).agg(F.count(F.lit(1)).alias("orders"))
    moved = D.rewrite(counts, dup_merge(spark, sf), "member")
    return moved.groupBy("member").agg(F.sum("orders").alias("orders"))


def pool_entries(spark, sf):
    """Parts as pool rows: name node = (name, size band), two sides, strong id = part."""
    node = F.concat_ws("|", "p_name", F.col("p_size").cast("string"))
    side = F.when(F.col("p_partkey") % 2 == 0, "bat").otherwise("pit")
    return L.table(spark, sf, "part").select(node.alias("uid"), side.alias("side"), F.col("p_partkey").alias("strong_id"))


ENTRIES = """
WITH en AS (SELECT p_name||'|'||p_size AS uid, CASE WHEN p_partkey%2=0 THEN 'bat' ELSE 'pit' END AS side, p_partkey AS strong_id FROM part),
us AS (SELECT uid, side, cast(min(strong_id) AS bigint) AS rank FROM en GROUP BY 1,2),
ln AS (SELECT uid, side, count(*) AS lines FROM lineitem JOIN en ON strong_id=l_partkey WHERE l_returnflag='R' GROUP BY 1,2),
bs AS (SELECT us.*, lines, count(*) OVER (PARTITION BY us.uid) AS sides FROM us LEFT JOIN ln ON ln.uid=us.uid AND ln.side=us.side)
"""


@query("collision_split", ENTRIES + """
SELECT uid, arg_max(side, (coalesce(lines,0), -rank, CASE WHEN side='bat' THEN 1 ELSE 0 END)) AS primary,
 CASE WHEN arg_max(side, (coalesce(lines,0), -rank, CASE WHEN side='bat' THEN 1 ELSE 0 END))='bat' THEN 'pit' ELSE 'bat' END AS other,
 uid||'_'||CASE WHEN arg_max(side, (coalesce(lines,0), -rank, CASE WHEN side='bat' THEN 1 ELSE 0 END))='bat' THEN 'pit' ELSE 'bat' END AS new_uid
FROM bs WHERE sides>1 GROUP BY uid""")
def collision_split(spark, sf):
    entries = pool_entries(spark, sf)
    ranked = entries.groupBy("uid", "side").agg(F.min("strong_id").alias("rank"))
    sold = L.table(spark, sf, "lineitem").where(F.col("l_returnflag") == "R").groupBy(
        F.col("l_partkey").alias("strong_id")).agg(F.count(F.lit(1)).alias("n"))
    lines = entries.join(sold, "strong_id").groupBy("uid", "side").agg(F.sum("n").alias("lines"))
    return D.split_collisions(ranked, lines)


@query("same_side_split", ENTRIES + """, ids AS (SELECT DISTINCT uid, strong_id FROM en),
mn AS (SELECT uid, count(*) AS n, min(strong_id) AS f FROM ids GROUP BY 1)
SELECT ids.uid, ids.strong_id, ids.uid||'_id'||ids.strong_id AS new_uid FROM ids JOIN mn ON mn.uid=ids.uid WHERE n>1 AND strong_id<>f""")
def same_side_split(spark, sf):
    entries = pool_entries(spark, sf)
    kept = entries.select("uid").distinct().withColumn("node_id", F.lit(None).cast("long"))
    return D.split_same_side(entries, kept)


@query("two_key_routing", ENTRIES + """, nm AS (SELECT uid, side, min(strong_id) AS named FROM en GROUP BY 1,2 HAVING count(*)>1)
SELECT en.strong_id, coalesce(CASE WHEN en.strong_id%10=0 THEN 's'||en.strong_id END, 'n'||named, 'u'||en.uid) AS uid FROM en LEFT JOIN nm ON nm.uid=en.uid AND nm.side=en.side""")
def two_key_routing(spark, sf):
    rows = pool_entries(spark, sf).withColumnRenamed("uid", "name")
    strong = rows.where(F.col("strong_id") % 10 == 0).select("strong_id", F.concat(F.lit("s"), F.col("strong_id").cast("string")).alias("strong_uid"))
    named = rows.groupBy("name", "side").agg(F.count(F.lit(1)).alias("n"), F.min("strong_id").alias("m")).where(F.col("n") > 1).select(
        "name", "side", F.concat(F.lit("n"), F.col("m").cast("string")).alias("named_uid"))
    return J.routed(rows, strong, named, F.concat(F.lit("u"), F.col("name"))).select("strong_id", "uid")


@query("identity_audit", ENTRIES + """
SELECT 'shared_strong_id' AS check_name, cast(strong_id AS varchar) AS key, cast(count(*) AS varchar) AS detail FROM
 (SELECT CASE WHEN c_custkey%6<2 THEN c_custkey//6 END AS strong_id FROM customer) WHERE strong_id IS NOT NULL GROUP BY strong_id HAVING count(*)>1
UNION ALL SELECT 'both_sides', uid, '2' FROM us GROUP BY uid HAVING count(*)>1
UNION ALL SELECT 'many_ids_one_node', uid, cast(count(DISTINCT strong_id) AS varchar) FROM en GROUP BY uid HAVING count(DISTINCT strong_id)>1
UNION ALL SELECT 'wrong_typed_date', cast(event_id AS varchar), props FROM events WHERE try_cast(props AS date) IS NULL AND event_type='signup'
UNION ALL SELECT 'rostered_without_id', cast(uid AS varchar), name FROM (SELECT c_custkey AS uid, c_name AS name FROM customer WHERE c_custkey%6=5) WHERE uid IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'regular_without_lines', cast(c_custkey AS varchar), c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'open_and_in_pool', cast(user_id AS varchar), cast(count(*) AS varchar) FROM events WHERE event_type='signup' AND user_id IN (SELECT user_id FROM events WHERE event_type='error') GROUP BY user_id""")
def identity_audit(spark, sf):
    customers = L.table(spark, sf, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("name"))
    orders = L.table(spark, sf, "orders").select(F.col("o_custkey").alias("uid"))
    events = L.table(spark, sf, "events")
    entries = pool_entries(spark, sf)
    shared = nodes(spark, sf).where(F.col("uid") % 6 < 2).select("strong_id", "uid")
    adds = events.where(F.col("event_type") == "signup")
    drops = events.where(F.col("event_type") == "error").select("user_id")
    return D.audit({
        "shared_strong_id": A.duplicate_keys(shared, ["strong_id"], "uid").select(F.col("strong_id").alias("key"), F.col("ids").alias("detail")),
        "both_sides": A.duplicate_keys(entries, ["uid"], "side").select(F.col("uid").alias("key"), F.col("ids").alias("detail")),
        "many_ids_one_node": A.duplicate_keys(entries, ["uid"], "strong_id").select(F.col("uid").alias("key"), F.col("ids").alias("detail")),
        "wrong_typed_date": adds.where(F.col("props").try_cast("date").isNull()).select(F.col("event_id").alias("key"), F.col("props").alias("detail")),
        "rostered_without_id": J.only_known(customers.where(F.col("uid") % 6 == 5), orders, "uid").select(F.col("uid").alias("key"), F.col("name").alias("detail")),
        "regular_without_lines": customers.join(orders, "uid", "left_anti").select(F.col("uid").alias("key"), F.col("name").alias("detail")),
        "open_and_in_pool": J.only_known(adds, drops, "user_id").groupBy(F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("detail")),
    })


@query("document_copies", """
WITH n AS (SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(strip_accents(text)),'[.'']','','g'),'\\s+',' ','g'))) AS uid FROM documents)
SELECT uid, count(*) AS ids, min(doc_id) AS first_id, max(doc_id) AS last_id FROM n GROUP BY uid HAVING count(*)>1""")
def document_copies(spark, sf):
    rows = L.table(spark, sf, "documents").select("doc_id", F.md5(N.normalize_name(F.col("text"))).alias("uid"))
    return A.duplicate_keys(rows, ["uid"], "doc_id")

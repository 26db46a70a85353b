"""Scenario, swap and lineup queries over the driver league."""

from __future__ import annotations

from pyspark.sql import functions as F

from contestlake.functions.rates import fixed
from contestlake.operators import ranking
from contestlake.operators import scenario as SC
from contestlake.operators import standings as S
from contestlake.operators import swaps as SW
from contestlake.plans import league as L
from contestlake.plans import standings as P
from contestlake.plans.registry import query, rnd
from contestlake.session import sharing

LEFT = L.PERIODS - L.AS_OF
QUALITY = {"ord": 1.0, "qty": 0.05, "rev": 2e-7, "ret": -0.5}
N = L.COMPONENTS


def inputs(spark, sf):
    return S.rate_inputs(L.dense_components(spark, sf), N, L.AS_OF)


def flows(spark, sf):
    """Weekly production per member with its quality."""
    totals = L.member_periods(spark, sf).where(F.col("period") <= L.AS_OF).groupBy("member").agg(*[F.sum(c).alias(c) for c in N])
    who = totals.join(L.members(spark, sf).select("member", "entity"), "member")
    return SC.weekly_flows(who, N, L.AS_OF).withColumn("quality", SC.quality(QUALITY))


def rosters(spark, sf):
    """Whole rosters: every customer of a nation."""
    return flows(spark, sf)


_Q = rnd("+".join(["cast(0 AS double)"] + [f"{c}*cast({w} AS double)" for c, w in QUALITY.items()]), 2)
BASE = P.WITH + ",\ninp AS (" + P._sql_inputs() + "),\nfl0 AS (SELECT c_nationkey AS entity, member, " + ", ".join(
    f"cast(sum({c}) AS double)/60 AS {c}" for c in N) + f""" FROM mp JOIN customer ON c_custkey=member WHERE period<=60 GROUP BY 1,2),
fl AS (SELECT *, {_Q} AS quality FROM fl0),
ro AS (SELECT * FROM fl)
"""


def _sql_values(source, keep):
    """Projected values of a CTE with inputs and ``d_x`` deltas, one row per metric."""
    def fin(c):
        return f"({c}_ytd+(cast(0.35 AS double)*{c}_recent+(1-cast(0.35 AS double))*{c}_ytd/60+d_{c})*{LEFT})"

    parts = []
    for m in L.METRICS:
        val = rnd(f"{fin(m.num)}*cast({m.scale} AS double)/{fin(m.den)}", 4) if m.is_rate else rnd(fin(m.num), 4)
        parts.append(f"SELECT {keep}, '{m.code}' AS metric, '{m.direction}' AS direction, {val} AS value FROM {source}")
    return " UNION ALL ".join(parts)


ZERO = ", ".join(f"cast(0 AS double) AS d_{c}" for c in N)
BASEPTS = BASE + f""",
b0 AS ({_sql_values(f"(SELECT inp.*, {ZERO} FROM inp)", "entity")}),
bp AS (SELECT entity, sum(pts) AS before FROM (SELECT entity, {L.sql_points("metric")} AS pts FROM b0) GROUP BY 1)
"""
MARG = BASEPTS + f""",
sc AS (SELECT entity AS owner, member, {", ".join(f"{c} AS f_{c}" for c in N)} FROM ro),
sv AS ({_sql_values(f"(SELECT owner, member, inp.*, {', '.join(f'-f_{c} AS d_{c}' for c in N)} FROM sc JOIN inp ON inp.entity=owner)", "owner, member, entity")}),
al AS (SELECT sc.owner, sc.member, b0.entity, b0.metric, b0.direction, coalesce(sv.value, b0.value) AS value FROM sc JOIN b0 ON true
  LEFT JOIN sv ON sv.member=sc.member AND sv.entity=b0.entity AND sv.metric=b0.metric),
mp2 AS (SELECT owner, member, entity, sum(pts) AS after FROM (SELECT owner, member, entity, {L.sql_points("owner, member, metric")} AS pts FROM al) GROUP BY 1,2,3),
mg AS (SELECT owner AS entity, member, before-after AS marginal FROM mp2 JOIN bp ON bp.entity=mp2.entity WHERE mp2.entity=owner)
"""


@query("member_marginal", MARG + "SELECT * FROM mg")
def member_marginal(spark, sf):
    out = SC.member_marginal(inputs(spark, sf), rosters(spark, sf).drop("quality"), L.METRICS, L.AS_OF, LEFT)
    return out.select("entity", "member", "marginal")


@query("scenario_deltas", BASEPTS + f""",
de AS (SELECT 'lose-'||(member%5) AS scenario, entity, {", ".join(f"-sum({c}) AS d_{c}" for c in N)} FROM ro GROUP BY 1,2),
sv AS ({_sql_values("(SELECT scenario, inp.*, " + ", ".join(f"d_{c}" for c in N) + " FROM de JOIN inp ON inp.entity=de.entity)", "scenario, entity")}),
sx AS (SELECT DISTINCT scenario FROM de),
al AS (SELECT sx.scenario, b0.entity, b0.metric, b0.direction, coalesce(sv.value, b0.value) AS value, sv.value IS NOT NULL AS hit FROM sx JOIN b0 ON true LEFT JOIN sv ON sv.scenario=sx.scenario AND sv.entity=b0.entity AND sv.metric=b0.metric),
ap AS (SELECT scenario, entity, sum(pts) AS after, bool_or(hit) AS hit FROM (SELECT scenario, entity, hit, {L.sql_points("scenario, metric")} AS pts FROM al) GROUP BY 1,2)
SELECT scenario, ap.entity, before, after, after-before AS change FROM ap JOIN bp ON bp.entity=ap.entity WHERE hit""")
def scenario_deltas(spark, sf):
    r = rosters(spark, sf)
    name = F.concat(F.lit("lose-"), (F.col("member") % 5).cast("string"))
    deltas = r.select(name.alias("scenario"), "entity", *[(-F.col(c)).alias(c) for c in N])
    return SC.evaluate_scenarios(inputs(spark, sf), deltas, L.METRICS, L.AS_OF, LEFT)


def _sql_swaps(damp, tag):
    d_us = ", ".join(f"g{tag}_{c}-f_{c} AS d_{c}" for c in N)
    d_them = ", ".join(f"f_{c}-g{tag}_{c} AS d_{c}" for c in N)
    return f"""
v{tag} AS ({_sql_values(f"(SELECT give, get, rival, inp.*, {d_us} FROM pr{tag} JOIN inp ON inp.entity=7)", "give, get, rival, entity")}
  UNION ALL {_sql_values(f"(SELECT give, get, rival, inp.*, {d_them} FROM pr{tag} JOIN inp ON inp.entity=rival)", "give, get, rival, entity")}),
a{tag} AS (SELECT pr{tag}.give, pr{tag}.get, pr{tag}.rival, b0.entity, b0.metric, b0.direction, coalesce(v{tag}.value, b0.value) AS value FROM pr{tag} JOIN b0 ON true
  LEFT JOIN v{tag} ON v{tag}.give=pr{tag}.give AND v{tag}.get=pr{tag}.get AND v{tag}.entity=b0.entity AND v{tag}.metric=b0.metric),
p{tag} AS (SELECT give, get, rival, entity, sum(pts) AS after FROM (SELECT give, get, rival, entity, {L.sql_points("give, get, metric")} AS pts FROM a{tag}) GROUP BY 1,2,3,4),
r{tag} AS (SELECT give, get, rival, sum(CASE WHEN p{tag}.entity=7 THEN after-before END) AS ours, sum(CASE WHEN p{tag}.entity=rival THEN after-before END) AS theirs FROM p{tag} JOIN bp ON bp.entity=p{tag}.entity WHERE p{tag}.entity IN (7, rival) GROUP BY 1,2,3)"""


_GF = ", ".join(f"g.{c} AS f_{c}" for c in N)
SWAP = BASEPTS + f""",
pr1 AS (SELECT g.member AS give, t.member AS get, t.entity AS rival, g.quality AS q_give, t.quality AS q_get, {_GF}, {", ".join(f"t.{c} AS g1_{c}" for c in N)} FROM ro g JOIN ro t ON g.entity=7 AND t.entity<>7),
pr2 AS (SELECT give, get, rival, {", ".join(f"f_{c}" for c in N)}, {", ".join(f"g1_{c}*cast(0.8 AS double) AS g2_{c}" for c in N)} FROM pr1),
{_sql_swaps(1.0, "1")},
{_sql_swaps(0.8, "2")},
sw AS (SELECT pr1.rival, pr1.give, pr1.get, q_give, q_get, r1.ours, r1.theirs, r2.ours<=0 AS fragile,
  CASE WHEN r1.ours<=0 THEN NULL WHEN r1.theirs>=0.5 AND q_give>=q_get*cast(0.55 AS double) THEN 'win-win' WHEN abs(r1.theirs)<=0.5 AND q_get<=q_give*cast(1.45 AS double) THEN 'fair-swap'
  WHEN r1.theirs>=-1.0 AND q_give>=q_get*cast(1.05 AS double) THEN 'needs-sweetener' END AS tier
  FROM pr1 JOIN r1 ON r1.give=pr1.give AND r1.get=pr1.get JOIN r2 ON r2.give=pr1.give AND r2.get=pr1.get),
so AS (SELECT *, CASE tier WHEN 'win-win' THEN 1 WHEN 'fair-swap' THEN 2 ELSE 3 END AS t FROM sw WHERE tier IS NOT NULL),
sk AS (SELECT *, row_number() OVER (PARTITION BY get ORDER BY t, ours DESC, give) AS k FROM so)
"""


@query("scenario_swap_scan", SWAP + "SELECT rival, give, get, q_give, q_get, ours, theirs, tier, fragile FROM sk WHERE k<=2 ORDER BY t, ours DESC, give, get LIMIT 12")
@sharing
def scenario_swap_scan(spark, sf):
    return SW.scan_swaps(inputs(spark, sf), rosters(spark, sf), L.US, L.METRICS, L.AS_OF, LEFT)


@query("cap_per_target", SWAP + "SELECT rival, give, get, ours, theirs, tier FROM sk WHERE k<=1 ORDER BY t, ours DESC, give, get LIMIT 1000")
def cap_per_target(spark, sf):
    out = SW.scan_swaps(inputs(spark, sf), rosters(spark, sf), L.US, L.METRICS, L.AS_OF, LEFT, per_target=1, top=1000)
    return out.select("rival", "give", "get", "ours", "theirs", "tier")


_DUO_COLS = ", ".join(f"a.{c}+b.{c} AS f_{c}" for c in N)
DUO = BASEPTS + f""",
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY quality DESC, member) AS st FROM ro WHERE entity<>7) WHERE st<=8),
pr3 AS (SELECT a.member||'-'||b.member AS give, a.member AS give1, b.member AS give2, t.member AS get, t.entity AS rival, {_DUO_COLS}, {", ".join(f"t.{c} AS g3_{c}" for c in N)}
  FROM ro a JOIN ro b ON a.entity=7 AND b.entity=7 AND a.member<b.member JOIN be t ON a.quality+b.quality>=t.quality*cast(0.9 AS double)),
{_sql_swaps(1.0, "3")},
du AS (SELECT pr3.rival, give1, give2, pr3.get, ours, theirs FROM pr3 JOIN r3 ON r3.give=pr3.give AND r3.get=pr3.get WHERE ours>0 AND theirs>=-0.5),
dk AS (SELECT *, row_number() OVER (PARTITION BY get ORDER BY ours+least(theirs,0) DESC, give1, give2) AS k FROM du)
SELECT rival, give1, give2, get, ours, theirs FROM dk WHERE k<=2 ORDER BY ours+least(theirs,0) DESC, get, give1, give2 LIMIT 10
"""


@query("two_for_one_scan", DUO)
@sharing
def two_for_one_scan(spark, sf):
    return SW.scan_two_for_one(inputs(spark, sf), rosters(spark, sf), L.US, L.METRICS, L.AS_OF, LEFT)


# --- lineup ----------------------------------------------------------------

TEMPLATE = [("AUTO", 1), ("BLDG", 1), ("MACH", 2), ("HOME", 1), ("UTIL", 3)]
SLOT_OF = {"AUTOMOBILE": ["AUTO"], "BUILDING": ["BLDG", "MACH"], "MACHINERY": ["MACH", "HOME"], "HOUSEHOLD": ["HOME"], "FURNITURE": []}


def slot_members(spark, sf):
    f = flows(spark, sf)
    rank = F.col("member") % 6
    current = F.when(rank == 0, "UTIL").when(rank == 1, "MACH")
    return f.select("entity", "member", F.col("quality").alias("score"), current.alias("current"))


def slot_options(spark, sf):
    table = F.create_map(*[x for k, v in SLOT_OF.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in [*v, "UTIL"]]))])
    return L.members(spark, sf).select("member", F.explode(table[F.col("role")]).alias("slot"))


def sql_slots(head, score, template=TEMPLATE):
    """SQL twin of the slot assignment; ``head`` has a CTE ``fl`` of members, and ``score`` is an expression over it."""
    opts = " UNION ALL ".join(f"SELECT c_custkey AS member, '{s}' AS slot FROM customer WHERE c_mktsegment='{r}'" for r, v in SLOT_OF.items() for s in [*v, "UTIL"])
    sql = head + f""",
sm AS (SELECT entity, member, {score} AS score, CASE member%6 WHEN 0 THEN 'UTIL' WHEN 1 THEN 'MACH' END AS current FROM fl),
op AS (SELECT sm.entity, sm.member, o.slot, {rnd("score+CASE WHEN current=o.slot THEN cast(0.75 AS double) ELSE 0 END", 6)} AS key FROM ({opts}) o JOIN sm ON sm.member=o.member)
"""
    taken = []
    for i, (slot, n) in enumerate(template):
        before = "".join(f" AND member NOT IN (SELECT member FROM t{j})" for j in range(i))
        sql += f""", t{i} AS MATERIALIZED (SELECT entity, member, '{slot}' AS slot FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY key DESC, member) AS r FROM op WHERE slot='{slot}'{before}) WHERE r<={n})"""
        taken.append(f"SELECT * FROM t{i}")
    return sql + ", asg AS (" + " UNION ALL ".join(taken) + ")\n"


SLOTS = sql_slots(BASE, "quality")


def assigned(spark, sf):
    return SC.assign_slots(slot_members(spark, sf), slot_options(spark, sf), TEMPLATE)


@query("slot_assignment", SLOTS + "SELECT * FROM asg")
def slot_assignment(spark, sf):
    return assigned(spark, sf)


@query("lineup_changes", SLOTS + """
SELECT sm.entity, sm.member, current, slot, CASE WHEN slot IS NOT DISTINCT FROM current THEN 'keep' WHEN slot IS NULL THEN 'bench' WHEN current IS NULL THEN 'start' ELSE 'move' END AS change
FROM sm LEFT JOIN asg ON asg.member=sm.member WHERE slot IS NOT NULL OR current IS NOT NULL""")
def lineup_changes(spark, sf):
    return SC.lineup_changes(slot_members(spark, sf), assigned(spark, sf))


#: More places of one kind than most entities can fill.
WIDE = [("AUTO", 130), *TEMPLATE[1:]]


@query("empty_slots", sql_slots(BASE, "quality", WIDE) + f""", wt AS (SELECT n_nationkey AS entity, s AS slot, n AS places FROM nation, (VALUES {", ".join(f"('{s}',{n})" for s, n in WIDE)}) v(s,n))
SELECT wt.entity, wt.slot, places-count(asg.member) AS empty FROM wt LEFT JOIN asg ON asg.entity=wt.entity AND asg.slot=wt.slot GROUP BY wt.entity, wt.slot, places HAVING places>count(asg.member)""")
def empty_slots(spark, sf):
    filled = SC.assign_slots(slot_members(spark, sf), slot_options(spark, sf), WIDE)
    return SC.empty_slots(L.entities(spark, sf), filled, WIDE)


@query("member_quality", BASE + "SELECT entity, member, quality FROM ro")
def member_quality(spark, sf):
    return rosters(spark, sf).select("entity", "member", fixed(F.col("quality"), 2).alias("quality"))

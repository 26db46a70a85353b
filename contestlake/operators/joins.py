"""Join patterns: keyed ranges, universes, cascades, routing, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestlake.session import cut_lineage


def in_period(facts: DataFrame, periods: DataFrame, number: Column) -> DataFrame:
    """Facts with the period they fall in, by period number instead of range."""
    return facts.withColumn("number", number).join(periods, "number")


def universe(key: str, *sources: DataFrame) -> DataFrame:
    """Union of key sets; the right side of a semi join over several EXISTS."""
    keys = sources[0].select(key)
    for s in sources[1:]:
        keys = keys.unionByName(s.select(key))
    return keys.distinct()


def only_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known, key, "left_semi")


def without(rows: DataFrame, taken: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(taken.select(*key).distinct(), key, "left_anti")


def orphan_counts(checks: dict[str, tuple[DataFrame, DataFrame, list[str]]]) -> DataFrame:
    """One row per foreign key: how many rows point nowhere."""
    out = None
    for name, (rows, parent, key) in checks.items():
        n = rows.join(parent.select(*key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))
        n = n.select(F.lit(name).alias("relation"), "orphans")
        out = n if out is None else out.unionByName(n)
    return out


def full_compare(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer reconcile: matched, differs, left_only, right_only."""
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("__l"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("__r"))
    both = a.join(b, keys, "full_outer")
    status = (
        F.when(F.col("__r").isNull(), "left_only").when(F.col("__l").isNull(), "right_only")
        .when(F.col("left_value").eqNullSafe(F.col("right_value")), "matched").otherwise("differs"))
    return both.select(*keys, "left_value", "right_value", status.alias("status"))


def routed(rows: DataFrame, strong: DataFrame, named: DataFrame, default: Column) -> DataFrame:
    """Target id by strong-id route, else by (name, side) route, else default.

    ``strong`` is (strong_id, strong_uid), ``named`` is (name, side, named_uid),
    each unique on its key.
    """
    out = rows.join(strong, "strong_id", "left").join(named, ["name", "side"], "left")
    return out.withColumn("uid", F.coalesce("strong_uid", "named_uid", default)).drop("strong_uid", "named_uid")


def nearby_actions(advice: DataFrame, actions: DataFrame, number: Column, start: Column,
                   before_days: int = 2) -> DataFrame:
    """Advice and the actions that carried it out.

    An action answers advice for the period it falls in, and for the next one
    when it falls in the last ``before_days`` before it starts.  Each action is
    written at most twice with a period number, then the join is an equality.
    """
    own = number
    early = F.datediff(start(own + 1), F.col("date")) <= before_days
    periods = F.filter(F.array(own, F.when(early, own + 1)), lambda p: p.isNotNull())
    reach = actions.withColumn("period", F.explode(periods))
    first = reach.groupBy("member", "period").agg(F.min("acted_at").alias("decided_at"))
    return advice.join(first, ["member", "period"], "left")


def follow_counts(leaves: DataFrame, arrivals: DataFrame, days: int = 3, chunk=None) -> DataFrame:
    """How often entity B takes a member within ``days`` after entity A left it.

    Input rows are (member, entity, ts).  Pairs are never built: for every
    leave and every other entity that ever took the member, two probes are put
    on the member's timeline and a running count of arrivals is read at both.
    Work is arrivals plus leaves times the entities per member.
    """
    from contestlake.operators import scan

    takers = arrivals.select("member", F.col("entity").alias("taker")).distinct()
    sides = leaves.select("member", F.col("entity").alias("left_by"), "ts").join(takers, "member")
    sides = sides.where(F.col("left_by") != F.col("taker"))
    probes = sides.select(
        "member", "taker", "left_by",
        F.inline(F.array(
            F.struct(F.col("ts").alias("at"), F.lit(2).alias("step"), F.lit(-1).alias("sign")),
            F.struct((F.col("ts") + F.expr(f"INTERVAL {days} DAYS")).alias("at"), F.lit(0).alias("step"), F.lit(1).alias("sign")),
        )))
    # Equal probes and equal arrivals collapse before the scan.
    probes = probes.groupBy("member", "taker", "left_by", "at", "step", "sign").agg(F.count(F.lit(1)).alias("times"))
    arrived = arrivals.groupBy("member", F.col("entity").alias("taker"), F.col("ts").alias("at")).agg(
        F.count(F.lit(1)).alias("n"))
    line = arrived.select("member", "taker", "at", F.lit(1).alias("step"), F.lit(-1).cast("long").alias("left_by"),
                          F.lit(0).alias("sign"), F.lit(0).cast("long").alias("times"), "n").unionByName(
        probes.select("member", "taker", "at", "step", F.col("left_by").cast("long"), "sign", "times",
                      F.lit(0).cast("long").alias("n")))
    order = ["at", "step", "left_by"]
    line = cut_lineage(line)  # read three times: for the bounds of the chunks, their sums and the rows
    part = chunk(F.col("at")) if chunk else scan.order_chunks(line, order)
    counted = scan.running_sum(line, ["member", "taker"], order, part, {"n": "seen"})
    return counted.where(F.col("sign") != 0).groupBy(F.col("left_by").alias("victim"), F.col("taker").alias("sniper")).agg(
        F.sum(F.col("sign") * F.col("times") * F.col("seen")).alias("n")).where(F.col("n") > 0)


def shared_member_edges(touches: DataFrame) -> DataFrame:
    """Entity pairs and the number of members both touched.

    Members are reduced to the sorted set of entities that touched them and
    counted per distinct set, so a pair is written once per distinct set and
    not once per member.  Sets are bounded by the entity dimension.
    """
    sets = touches.select("member", "entity").distinct().groupBy("member").agg(
        F.array_sort(F.collect_list("entity")).alias("who"))
    counted = sets.where(F.size("who") > 1).groupBy("who").agg(F.count(F.lit(1)).alias("times"))
    firsts = counted.select("who", "times", F.posexplode("who").alias("i", "a"))
    rest = F.slice(F.col("who"), F.col("i") + 2, F.size("who"))
    pairs = firsts.select("a", F.explode(rest).alias("b"), "times")
    return pairs.groupBy("a", "b").agg(F.sum("times").alias("weight"))

"""Official numbers rebuilt from day lines, and over-full lineups explained."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contestlake.functions.rates import ratio
from contestlake.operators import ranking
from contestlake.operators.metrics import Metric, component_names, metric_values
from contestlake.session import cut_lineage


def recompute(lineups: DataFrame, lines: DataFrame, metrics: list[Metric]) -> DataFrame:
    """Metric values per (entity, period) from the lines of active members.

    ``lineups``: entity, member, period, section; ``lines``: member, period and
    components.  Lines are summed per (member, period) before they are joined.
    """
    names = component_names(metrics)
    per = lines.groupBy("member", "period").agg(*[F.sum(c).alias(c) for c in names])
    active = lineups.where(F.col("section") == "active").select("entity", "member", "period")
    sums = active.join(per, ["member", "period"]).groupBy("entity", "period").agg(*[F.sum(c).alias(c) for c in names])
    return metric_values(sums, ["entity", "period"], metrics)


def _minus(a, b):
    return F.zip_with(a, b, lambda x, y: x - y)


def _plus(a, b):
    return F.zip_with(a, b, lambda x, y: x + y)


def _fits(part, whole):
    """Every element of ``part`` is at most the one of ``whole``."""
    return F.forall(F.zip_with(part, whole, lambda x, y: x <= y), lambda ok: ok)


def _needs(occupants, totals, caps, capacity, group, any_limit):
    """Groups to solve: what must be excluded (``gap``) and how many (``k``)."""
    cap = F.create_map(*[x for s, n in caps.items() for x in (F.lit(s), F.lit(n))])
    slots = occupants.groupBy(*group, "slot").agg(F.count(F.lit(1)).alias("n"))
    excess = F.greatest(F.col("n") - F.coalesce(F.try_element_at(cap, F.col("slot")), F.lit(1)), F.lit(0))
    sized = slots.withColumn("e", excess).groupBy(*group).agg(
        F.sum("n").alias("n"), F.sum("e").alias("k_slot"),
        F.map_from_entries(F.collect_list(F.struct("slot", "e"))).alias("quota"))
    over = F.col("n") - capacity
    ks = F.array_distinct(F.filter(
        F.array(F.col("k_slot"), F.when((over > 0) & (over <= any_limit), over)), lambda k: k.isNotNull()))
    out = sized.join(totals, group).withColumn("k_any", F.when((over > 0) & (over <= any_limit), over))
    return out.withColumn("excess", (F.col("k_slot") > 0) | (over > 0)).withColumn("ks", ks)


def reconcile_capacity(occupants: DataFrame, official: DataFrame, group: list[str], counts: list[str],
                       rates: dict[str, tuple[str, str, float]], caps: dict[str, int], capacity: int,
                       any_limit: int = 4) -> DataFrame:
    """Which listed members of an over-full lineup contributed nothing.

    ``occupants``: group, slot, idx (1..n within the group, unique), counting
    columns (whole numbers) and rate components.  ``official``: group,
    ``off_x`` per counting column and ``off_rate`` per rate.  ``rates`` maps a
    rate to (numerator, denominator, tolerance).

    The excluded members must sum to the gap between our totals and the
    official ones.  Sets are met in the middle: sets of half the size are kept
    only while they fit under the gap, and two halves are joined by *equality*
    of one with the gap minus the other, so sets of the full size are never
    enumerated.  Members that are alike in slot, counts and rate components are
    one class that a set takes by multiplicity, smallest indexes first: thirty
    members who did nothing give one set of each size.  Preference: rates agree, then per-slot excess, then the
    smallest indexes.  Outcome: no-excess, solved, solved-crossslot, unsolved.
    """
    comps = list(dict.fromkeys(c for n, d, _ in rates.values() for c in (n, d)))
    vec = F.array(*[F.col(c).cast("long") for c in counts])
    base = occupants.groupBy(*group).agg(*[F.sum(c).alias(f"t_{c}") for c in dict.fromkeys([*counts, *comps])])
    base = base.join(official, group)
    gap = F.array(*[(F.col(f"t_{c}") - F.col(f"off_{c}")).cast("long") for c in counts])
    need = _needs(occupants, base.withColumn("gap", gap), caps, capacity, group, any_limit)
    # Only over-full groups go on, and they are read by every step below.
    need = cut_lineage(need)
    open_ = need.where(F.col("excess") & F.forall("gap", lambda g: g >= 0))
    occupants = cut_lineage(occupants.join(open_.select(*group), group, "left_semi"))
    goals = open_.select(*group, "gap", F.explode("ks").alias("k"))
    limit = goals.agg(F.max("k")).first()[0] or 0

    # The n-th of a class may only follow the one before it; more than ``limit`` of a class are never taken.
    alike = [*group, "slot", "v", *comps]
    items = ranking.top_k(occupants.select(*group, "slot", "idx", *comps, vec.alias("v")), alike, [F.asc("idx")], limit, "nth")
    items = items.withColumn("kind", F.min("idx").over(Window.partitionBy(*alike))).select(*group, "kind", "nth", "idx", "v")
    ones = items.join(goals.groupBy(*group, "gap").agg(F.max("k").alias("k_max")), group).where(_fits(F.col("v"), F.col("gap")))
    ones = cut_lineage(ones.where(F.col("nth") <= F.col("k_max")).select(
        *group, F.struct("kind", "nth").alias("last"), F.struct("kind", "nth").alias("first"), F.array("idx").alias("ids"), "v", "gap", "k_max"))

    def follows(one, other):
        """Whether an item (or a set that begins with it) may stand behind another."""
        new = (other["kind"] > one["kind"]) & (other["nth"] == 1)
        return new | ((other["kind"] == one["kind"]) & (other["nth"] == one["nth"] + 1))

    sets = {1: ones}
    for size in range(2, (limit + 1) // 2 + 1):
        longer = sets[size - 1].where((F.col("k_max") + 1) / 2 >= size)
        step = ones.select(*group, F.col("last").alias("add"), F.col("ids").alias("add_ids"), F.col("v").alias("add_v"))
        grown = longer.join(step, group).where(follows(F.col("last"), F.col("add")))
        grown = grown.withColumn("v", _plus(F.col("v"), F.col("add_v"))).where(_fits(F.col("v"), F.col("gap")))
        sets[size] = cut_lineage(grown.select(
            *group, F.col("add").alias("last"), "first", F.concat("ids", "add_ids").alias("ids"), "v", "gap", "k_max"))
    found = [goals.where((F.col("k") == 0) & F.forall("gap", lambda g: g == 0)).select(
        *group, "k", F.array().cast("array<int>").alias("ids"))]
    for k in range(1, limit + 1):
        hi, lo = (k + 1) // 2, k // 2
        aims = goals.where(F.col("k") == k).select(*group, "k")
        left = sets[hi].where(F.col("first.nth") == 1).join(aims, group)
        if lo == 0:
            hits = left.where(F.col("v") == F.col("gap")).select(*group, "k", "ids")
        else:
            right = sets[lo].select(*group, F.col("first").alias("r_first"), F.col("ids").alias("r_ids"), F.col("v").alias("rest"))
            left = left.withColumn("rest", _minus(F.col("gap"), F.col("v")))
            hits = left.join(right, [*group, "rest"]).where(follows(F.col("last"), F.col("r_first"))).select(
                *group, "k", F.array_sort(F.concat("ids", "r_ids")).alias("ids"))
        found.append(hits)
    solutions = reduce(lambda a, b: a.unionByName(b), found)
    best = _pick(solutions, open_, occupants, group, rates, comps)
    out = need.select(*group, "excess").join(best, group, "left")
    outcome = F.when(~F.col("excess"), "no-excess").when(F.col("stage").isNull(), "unsolved").when(
        F.col("stage") == 1, "solved").otherwise("solved-crossslot")
    return out.select(*group, outcome.alias("outcome"), F.coalesce("ids", F.array().cast("array<int>")).alias("excluded"),
                      F.col("strict"))


def _pick(solutions, open_, occupants, group, rates, comps):
    """Best solution per group by (rates agree, stage, indexes)."""
    parts = solutions.withColumn("key", F.array_join("ids", ",")).select(*group, "k", "ids", "key", F.explode_outer("ids").alias("idx"))
    cells = parts.join(occupants.select(*group, "idx", "slot", *comps), [*group, "idx"], "left")
    per_slot = cells.groupBy(*group, "k", "key", "slot").agg(
        F.first("ids").alias("ids"), F.count("idx").alias("n"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in comps])
    sums = per_slot.groupBy(*group, "k", "key").agg(
        F.first("ids").alias("ids"), F.collect_list(F.struct("slot", "n")).alias("used"), *[F.sum(c).alias(f"x_{c}") for c in comps])
    full = sums.join(open_.drop("ks", "excess"), group)
    agree = F.lit(True)
    for name, (num, den, tol) in rates.items():
        ours = ratio(F.col(f"t_{num}") - F.col(f"x_{num}"), F.col(f"t_{den}") - F.col(f"x_{den}"))
        agree = agree & F.coalesce(F.abs(ours - F.col(f"off_{name}")) <= tol, F.lit(False))
    within = F.forall("used", lambda u: u["n"] == F.coalesce(F.try_element_at("quota", u["slot"]), F.lit(0)))
    staged = full.withColumn("strict", agree).withColumn(
        "stage", F.when((F.col("k") == F.col("k_slot")) & within, 1).when(F.col("k") == F.col("k_any"), 2))
    staged = staged.where(F.col("stage").isNotNull())
    order = F.struct((~F.col("strict")).alias("a"), F.col("stage"), F.col("ids"))
    return staged.groupBy(*group).agg(F.min_by(F.struct("ids", "stage", "strict"), order).alias("b")).select(
        *group, "b.ids", "b.stage", "b.strict")


def contributing(occupants: DataFrame, solved: DataFrame, group: list[str], components: list[str]) -> DataFrame:
    """Component sums of the members that did contribute."""
    rows = occupants.join(solved.select(*group, "excluded"), group)
    kept = rows.where(~F.array_contains("excluded", F.col("idx")))
    return kept.groupBy(*group).agg(*[F.sum(c).alias(c) for c in components])


def indexed(occupants: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Number the members of each lineup from one."""
    return occupants.withColumn("idx", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))

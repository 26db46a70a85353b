"""What-if valuation: re-rank the field under roster changes.

A scenario touches one or a few entities; everyone else keeps the values of
the base board, which has the size entities by metrics.  The board travels as
one array, and every touched value counts inside its row whom it beats, so all
scenarios are one job without a shuffle of their own.

Inputs come from ``standings.rate_inputs``: entity with ``x_ytd`` and
``x_recent`` per component.  Deltas are weekly component flows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlake.functions.rates import fixed, ratio
from contestlake.operators import ranking
from contestlake.operators.metrics import Metric, component_names
from contestlake.session import cut_lineage


def signed_values(metrics: list[Metric], ytd, recent, delta, played: int, left: int, weight: float) -> Column:
    """Projected value of every metric, turned so that more is better.

    ``ytd``, ``recent`` and ``delta`` give the column of a component.
    """
    def final(c):
        week = weight * recent(c) + (1 - weight) * ytd(c) / played
        return ytd(c) + (week + delta(c)) * left

    out = []
    for m in metrics:
        value = fixed(ratio(final(m.num), final(m.den), m.scale), 4) if m.is_rate else fixed(final(m.num), 4)
        out.append(F.coalesce(-value if m.direction == "lower" else value, F.lit(float("-inf"))))
    return F.array(*out)


def settled(df: DataFrame) -> DataFrame:
    """Write a small shared input once; every valuation step reads it again."""
    return cut_lineage(df)


def base_board(inputs: DataFrame, metrics: list[Metric], played: int, left: int, weight: float) -> DataFrame:
    """Values and total points of every entity without any change."""
    none = lambda c: F.lit(0.0)
    v = signed_values(metrics, lambda c: F.col(f"{c}_ytd"), lambda c: F.col(f"{c}_recent"), none, played, left, weight)
    board = inputs.select("entity", v.alias("v"))
    cells = board.select("entity", F.posexplode("v").alias("i", "value"))
    points = ranking.rank_points(cells, ["i"], "value", F.lit("higher")).groupBy("entity").agg(F.sum("points").alias("points"))
    return board.join(points, "entity")


def _versus(mine: Column, other: Column) -> Column:
    return F.when(mine > other, 1.0).when(mine == other, 0.5).otherwise(0.0)


def _score(mine: Column, rivals: Column, count: int) -> Column:
    """Rivals that one entity beats (ties count half), over all metrics."""
    return F.aggregate(rivals, F.lit(0.0), lambda acc, t: acc + reduce(
        lambda x, i: x + _versus(mine[i], t["v"][i]), range(count), F.lit(0.0)))


def field_of(board: DataFrame) -> Column:
    """The board as one array, an entry per entity; a row then finds its points without a join."""
    return board.agg(F.array_sort(F.collect_list(F.struct("entity", "points", "v")))).scalar()


def changes(touched: Column, field: Column, count: int) -> Column:
    """Per touched entity (entity, before, after, change); entities that the board lacks are left out."""
    ids = F.transform(touched, lambda t: t["entity"])
    still = F.filter(field, lambda f: ~F.array_contains(ids, f["entity"]))

    def one(t):
        others = F.filter(touched, lambda o: o["entity"] != t["entity"])
        after = _score(t["v"], still, count) + _score(t["v"], others, count) + float(count)
        before = F.get(F.filter(field, lambda f: f["entity"] == t["entity"]), F.lit(0))["points"]
        return F.struct(t["entity"].alias("entity"), before.alias("before"), after.alias("after"))

    known = F.filter(F.transform(touched, one), lambda c: c["before"].isNotNull())
    return F.transform(known, lambda c: F.struct(c["entity"], c["before"], c["after"], (c["after"] - c["before"]).alias("change")))


def value_touched(rows: DataFrame, board: DataFrame, count: int) -> DataFrame:
    """Points of every entity in ``touched``: entity, before, after, change.

    All other columns of ``rows`` together name the scenario.  Nothing is
    shuffled: the board is as long as there are entities.
    """
    keys = [c for c in rows.columns if c != "touched"]
    rows = rows.withColumn("__field", field_of(board))
    return rows.select(*keys, F.explode(changes(F.col("touched"), F.col("__field"), count)).alias("c")).select(*keys, "c.*")


def evaluate_scenarios(inputs: DataFrame, deltas: DataFrame, metrics: list[Metric], played: int, left: int,
                       weight: float = 0.35) -> DataFrame:
    """Points of every touched entity per scenario, before and after.

    ``deltas``: scenario, entity and one weekly flow column per component; the
    flows of one (scenario, entity) are summed before rates are rebuilt.
    """
    names = component_names(metrics)
    inputs = settled(inputs)
    flows = deltas.groupBy("scenario", "entity").agg(*[F.sum(c).alias(c) for c in names])
    board = base_board(inputs, metrics, played, left, weight)
    v = signed_values(metrics, lambda c: F.col(f"{c}_ytd"), lambda c: F.col(f"{c}_recent"), F.col, played, left, weight)
    rows = flows.join(inputs, "entity").select("scenario", "entity", v.alias("v"))
    touched = rows.groupBy("scenario").agg(F.array_sort(F.collect_list(F.struct("entity", "v"))).alias("touched"))
    return value_touched(touched, board, len(metrics))


def member_marginal(inputs: DataFrame, flows: DataFrame, metrics: list[Metric], played: int, left: int,
                    weight: float = 0.35) -> DataFrame:
    """Points an entity loses when a member's weekly flow disappears.

    ``flows``: entity, member and weekly components; one scenario per row.
    """
    names = component_names(metrics)
    inputs = settled(inputs)
    board = base_board(inputs, metrics, played, left, weight)
    rows = flows.join(inputs, "entity")
    v = signed_values(metrics, lambda c: F.col(f"{c}_ytd"), lambda c: F.col(f"{c}_recent"), lambda c: -F.col(c), played, left, weight)
    touched = rows.select("member", *[c for c in flows.columns if c not in ("member", "entity", *names)],
                          F.array(F.struct("entity", v.alias("v"))).alias("touched"))
    return value_touched(touched, board, len(metrics)).withColumn("marginal", -F.col("change")).drop("before", "after", "change")


def member_gain(inputs: DataFrame, flows: DataFrame, us, metrics: list[Metric], played: int, left: int,
                weight: float = 0.35) -> DataFrame:
    """Points that ``us`` wins when a free member's weekly flow is added; one scenario per row of ``flows``.

    Columns beside member and the components are kept.
    """
    names = component_names(metrics)
    inputs = settled(inputs)
    board = base_board(inputs, metrics, played, left, weight)
    kind = inputs.schema["entity"].dataType
    rows = flows.drop("entity").withColumn("entity", F.lit(us).cast(kind)).join(inputs, "entity")
    v = signed_values(metrics, lambda c: F.col(f"{c}_ytd"), lambda c: F.col(f"{c}_recent"), F.col, played, left, weight)
    kept = [c for c in flows.columns if c not in ("entity", *names)]
    touched = rows.select(*kept, F.array(F.struct("entity", v.alias("v"))).alias("touched"))
    return value_touched(touched, board, len(metrics)).withColumnRenamed("change", "gain").drop("entity", "before", "after")


# What a coming start adds, the weight of plain quality inside one step, and what an idle member keeps.
START_BUMP, QUALITY_SHARE, IDLE_SHARE = 0.3, 1000.0, 0.4


def lineup_key(marginal: Column, starts: Column, quality_: Column, idle: Column) -> Column:
    """Order of members for the lineup: marginal points and coming starts, then quality, cut for members who do not play."""
    value = marginal + starts * F.lit(START_BUMP) + quality_ / F.lit(QUALITY_SHARE)
    return value * F.when(idle, IDLE_SHARE).otherwise(1.0)


def weekly_flows(totals: DataFrame, names: list[str], played: int) -> DataFrame:
    return totals.select(*[c for c in totals.columns if c not in names], *[(F.col(c) / played).alias(c) for c in names])


def quality(weights: dict[str, float]) -> Column:
    """One number per member on a common scale, from weekly flows."""
    return fixed(sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0)), 2)


# --- lineup ----------------------------------------------------------------


def assign_slots(members: DataFrame, eligible: DataFrame, template: list[tuple[str, int]], sticky: float = 0.75) -> DataFrame:
    """Fill the template slot by slot, for every entity at once.

    ``members``: entity, member, score, current (slot or null); ``eligible``:
    member, slot.  Only the best ``sum(template)`` candidates of a slot can
    ever be used, because other slots take fewer than that, so each (entity,
    slot) is cut to that many first and the rounds run over short lists.
    """
    places = sum(n for _, n in template)
    options = eligible.join(members, "member")
    key = F.col("score") + F.when(F.col("current") == F.col("slot"), sticky).otherwise(0.0)
    options = options.withColumn("key", fixed(key, 6))
    short = ranking.top_k(options, ["entity", "slot"], [F.desc("key"), F.asc("member")], places).drop("rank")
    pool = short.groupBy("entity", "member").agg(F.map_from_entries(F.collect_list(F.struct("slot", "key"))).alias("keys"))
    pool = pool.withColumn("slot", F.lit(None).cast("string"))
    for slot, count in template:
        wants = F.when(F.col("slot").isNull(), F.try_element_at("keys", F.lit(slot)))
        w = Window.partitionBy("entity").orderBy(F.desc_nulls_last("want"), F.asc("member"))
        pool = pool.withColumn("want", wants).withColumn("place", F.row_number().over(w))
        take = F.col("want").isNotNull() & (F.col("place") <= count)
        pool = pool.withColumn("slot", F.when(take, F.lit(slot)).otherwise(F.col("slot"))).drop("want", "place")
    return pool.where(F.col("slot").isNotNull()).select("entity", "member", "slot")


def lineup_changes(members: DataFrame, assigned: DataFrame) -> DataFrame:
    """What changes against the current lineup: start, move, bench or keep."""
    both = members.select("entity", "member", "current").join(assigned, ["entity", "member"], "left")
    change = (
        F.when(F.col("slot").eqNullSafe(F.col("current")), "keep").when(F.col("slot").isNull(), "bench")
        .when(F.col("current").isNull(), "start").otherwise("move"))
    return both.select("entity", "member", "current", "slot", change.alias("change")).where(
        F.col("slot").isNotNull() | F.col("current").isNotNull())


def empty_slots(entities: DataFrame, assigned: DataFrame, template: list[tuple[str, int]]) -> DataFrame:
    """Template places without an eligible member."""
    want = entities.select("entity", F.inline(F.array(*[
        F.struct(F.lit(s).alias("slot"), F.lit(n).alias("places")) for s, n in template])))
    have = assigned.groupBy("entity", "slot").agg(F.count(F.lit(1)).alias("filled"))
    out = want.join(have, ["entity", "slot"], "left").withColumn("empty", F.col("places") - F.coalesce("filled", F.lit(0)))
    return out.where(F.col("empty") > 0).select("entity", "slot", "empty")

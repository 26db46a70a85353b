"""Action log → validity intervals, as-of membership, reconciliation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestlake.operators import scan
from contestlake.session import cut_lineage

KEY = ["entity", "member"]
#: A chunk that does not decrease with the effective time; by default chunks are bounded by their rows.
Chunk = Callable[[Column], Column] | None

# What each action does to membership.
OPENING = ["add", "claim_add", "draft"]
CLOSING = ["drop"]
CORRECTED = "trade(corrected)"
STATUS_MOVES = {"move_to_il": "il", "move_from_il": "active", "move_to_minors": "minors", "move_from_minors": "active"}


def membership_moves(actions: DataFrame, order: list[str]) -> DataFrame:
    """Open, close and status rows; a trade is a close there and an open here."""
    kind = F.col("action")
    nothing = F.array().cast("array<struct<entity:bigint,kind:string,step:int,status:string>>")

    def move(entity, name, step, status):
        return F.struct(entity.cast("long").alias("entity"), F.lit(name).alias("kind"), F.lit(step).alias("step"),
                        status.cast("string").alias("status"))

    none = F.lit(None)
    status = F.create_map(*[F.lit(x) for kv in STATUS_MOVES.items() for x in kv])
    trade = F.filter(
        F.array(F.when(F.col("counterparty").isNotNull(), move(F.col("counterparty"), "close", 0, none)),
                move(F.col("entity"), "open", 1, none)),
        lambda m: m.isNotNull())
    moves = (
        F.when(kind.isin(*OPENING), F.array(move(F.col("entity"), "open", 0, none)))
        .when(kind.isin(*CLOSING), F.array(move(F.col("entity"), "close", 0, none)))
        .when(kind.isin("trade", CORRECTED), trade)
        .when(kind.isin(*STATUS_MOVES), F.array(move(F.col("entity"), "status", 0, F.try_element_at(status, kind))))
        .otherwise(nothing))
    return actions.select("member", "action", *order, F.explode(moves).alias("m")).select(
        "member", "action", *order, F.col("m.entity").alias("entity"), F.col("m.kind").alias("kind"),
        F.col("m.step").alias("step"), F.col("m.status").alias("status"))


def with_corrections(actions: DataFrame, corrections: DataFrame, order: list[str], at: str) -> DataFrame:
    """The action log with trades that the log itself lacks.

    ``corrections``: member, from_entity, to_entity, effective (a date) and
    line, their place in the correction log.  They apply at the start of their
    day, in the order of the log and ahead of the day's own actions: the second
    order column must be a number, and theirs are negative.
    """
    kinds = dict(actions.dtypes)
    before = (F.col("line").cast("long") - F.lit(1 << 40)).cast(kinds[order[1]])
    rest = [F.lit(None).cast(kinds[c]).alias(c) for c in order[2:]]
    moves = corrections.select(
        "member", F.col("to_entity").alias("entity"), F.col("from_entity").alias("counterparty"), F.lit(CORRECTED).alias("action"),
        F.col("effective").cast(kinds[at]).alias(at), before.alias(order[1]), *rest)
    return actions.unionByName(moves, allowMissingColumns=True)


def _chunk_of(moves: DataFrame, order: list[str], at: str, chunk: Chunk) -> Column:
    """The stated chunks, or chunks of about equally many rows."""
    return chunk(F.col(at)) if chunk else scan.order_chunks(moves, order)


def _alternating(moves: DataFrame, order: list[str], chunk: Column) -> DataFrame:
    """Opens and closes flagged by whether they change the state.

    After any open or close the state equals that event's kind, kept or not,
    so an event is out of turn exactly when it repeats the one before it; a
    first close is out of turn too.
    """
    edges = moves.where(F.col("kind") != "status")
    seen = scan.shifted(edges, KEY, [*order, "step"], chunk, {"kind": "prev_kind"})
    return seen.withColumn("in_turn", F.col("kind") != F.coalesce(F.col("prev_kind"), F.lit("close"))).drop("prev_kind")


def build_intervals(actions: DataFrame, order: list[str], at: str, chunk: Chunk = None) -> DataFrame:
    """Intervals per (entity, member): from, to (null = open), via, status.

    ``actions`` has entity, member, action, counterparty and the order columns,
    the first of which must be the effective time ``at``.
    """
    return intervals_of(membership_moves(actions, order), order, at, chunk)


def intervals_of(moves: DataFrame, order: list[str], at: str, chunk: Chunk = None) -> DataFrame:
    """Intervals from membership moves."""
    part = _chunk_of(moves, order, at, chunk)
    # The kept turns are read four times below; they are written once.
    turns = cut_lineage(_alternating(moves, order, part).where("in_turn").drop("in_turn"))
    full = [*order, "step"]
    nxt = scan.shifted(turns, KEY, full, part, {at: "to_ts", "action": "ended_by"}, forward=True)
    opens = nxt.where(F.col("kind") == "open").select(
        *KEY, F.struct(*full).alias("opened"), F.col(at).alias("from_ts"), "to_ts", F.col("action").alias("via"), "ended_by")
    status = _interval_status(moves, turns, order, part)
    return opens.join(status, [*KEY, "opened"], "left").select(
        *KEY, "from_ts", "to_ts", "via", "ended_by", F.coalesce("status", F.lit("active")).alias("status"))


def _placed_moves(moves, turns, order, part):
    """Status moves with the kept open or close they follow."""
    full = [*order, "step"]
    none = F.lit(None).cast("string")
    line = turns.select(*KEY, *full, "kind", none.alias("status")).unionByName(
        moves.where(F.col("kind") == "status").select(*KEY, *full, "kind", "status"))
    edge = F.when(F.col("kind") != "status", F.struct("kind", F.struct(*full).alias("opened")))
    line = line.withColumn("edge", edge)
    return scan.fill_forward(line, KEY, full, part, {"edge": "last_edge"}).where(F.col("kind") == "status")


def _interval_status(moves, turns, order, part):
    placed = _placed_moves(moves, turns, order, part).where(F.col("last_edge.kind") == "open")
    return placed.groupBy(*KEY, F.col("last_edge.opened").alias("opened")).agg(
        F.max_by("status", F.struct(*order, "step")).alias("status"))


def interval_anomalies(actions: DataFrame, order: list[str], at: str, chunk: Chunk = None) -> DataFrame:
    """Events that could not apply: double open, close or move without open."""
    moves = membership_moves(actions, order)
    part = _chunk_of(moves, order, at, chunk)
    flagged = _alternating(moves, order, part)
    name = F.when(F.col("kind") == "open", "double-open").otherwise("close-without-open")
    edges = flagged.where(~F.col("in_turn")).select(*KEY, *order, "action", name.alias("anomaly"))
    turns = flagged.where("in_turn").drop("in_turn")
    lost = _placed_moves(moves.withColumn("status", F.col("action")), turns, order, part).where(
        F.coalesce(F.col("last_edge.kind"), F.lit("close")) != "open")
    return edges.unionByName(lost.select(
        *KEY, *order, F.col("status").alias("action"), F.lit("status-move-without-stint").alias("anomaly")))


def roster_as_of(intervals: DataFrame, dates: list) -> DataFrame:
    """Who belongs where at each date: from <= date < to.

    The dates are a short parameter list; each interval is expanded only to
    the dates it contains.
    """
    kind = intervals.schema["from_ts"].dataType
    stamps = F.array(*[F.lit(d).cast(kind) for d in dates])
    inside = F.filter(stamps, lambda d: (F.col("from_ts") <= d) & (F.col("to_ts").isNull() | (F.col("to_ts") > d)))
    return intervals.select(*KEY, "status", "via", F.explode(inside).alias("as_of"))


def reconcile(intervals: DataFrame, grid: DataFrame) -> DataFrame:
    """Open intervals against a snapshot; the snapshot decides the status."""
    have = intervals.where(F.col("to_ts").isNull()).select(*KEY, F.col("status").alias("have"), F.lit(1).alias("__h"))
    want = grid.select(*KEY, F.col("status").alias("want"), F.lit(1).alias("__w"))
    both = have.join(want, KEY, "full_outer")
    kind = (
        F.when(F.col("__h").isNull(), "grid_only").when(F.col("__w").isNull(), "replay_only")
        .when(F.col("have") == F.col("want"), "matched").otherwise("status_fix"))
    return both.select(*KEY, "have", "want", kind.alias("kind"), F.coalesce("want", "have").alias("status"))

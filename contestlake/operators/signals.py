"""Trend, streak, luck and usage signals over member appearances.

A series has one row per appearance: member, at (time), seq (unique id) and
value columns.  "Newest n" always goes through ``ranking.top_k``, which keeps n
rows per member in each map task, and season sums are partial aggregates, so a
member with a third of all appearances costs no more than any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contestlake.functions.rates import fixed, ratio, strength
from contestlake.functions.roles import activity_status, production_role, usage_role
from contestlake.operators import aggregates, ranking, scan

NEWEST = "rn"


def newest_rows(series: DataFrame, k: int) -> DataFrame:
    return ranking.top_k(series, ["member"], [F.desc("at"), F.desc("seq")], k, NEWEST)


def _mean_when(cond: Column, value: Column) -> Column:
    return ratio(F.sum(F.when(cond, value)), F.sum(F.when(cond & value.isNotNull(), 1)))


def _two_sided(delta: Column, threshold: float, up: str, down: str) -> Column:
    return F.when(delta >= threshold, up).when(delta <= -threshold, down)


def trend_shift(series: DataFrame, value: str, threshold: float, recent: int = 2, prior: int = 5,
                at_least: int = 4, unit: float = 2.5, name: str = "trend",
                since=None, places: int = 2) -> DataFrame:
    """Mean of the last ``recent`` appearances against the ``prior`` before."""
    rows = newest_rows(series, recent + prior)
    late = F.col(NEWEST) <= recent
    stats = rows.groupBy("member").agg(
        F.count(F.lit(1)).alias("games"), F.max("at").alias("newest"),
        _mean_when(late, F.col(value)).alias("recent"), _mean_when(~late, F.col(value)).alias("prior"))
    if since is not None:
        stats = stats.where(F.col("newest") >= F.lit(since))
    delta = fixed(F.col("recent") - F.col("prior"), places)
    out = stats.where(F.col("games") >= at_least).withColumn("delta", delta)
    out = out.withColumn("kind", _two_sided(F.col("delta"), threshold, f"{name}_up", f"{name}_down"))
    return out.where(F.col("kind").isNotNull()).select(
        "member", "newest", "kind", "delta", fixed(strength(F.col("delta"), unit), 4).alias("strength"))


def skill_heat(series: DataFrame, parts: dict[str, float], recent: int = 2, window: int = 6, at_least: int = 5,
               threshold: float = 1.0) -> DataFrame:
    """Sum of scaled shifts of several measures; a missing measure counts zero."""
    rows = newest_rows(series, window)
    late = F.col(NEWEST) <= recent
    aggs = [F.count(F.lit(1)).alias("games")]
    for c in parts:
        aggs += [_mean_when(late, F.col(c)).alias(f"{c}_r"), _mean_when(~late, F.col(c)).alias(f"{c}_b")]
    stats = rows.groupBy("member").agg(*aggs).where(F.col("games") >= at_least)
    heat = sum((F.coalesce(F.col(f"{c}_r") - F.col(f"{c}_b"), F.lit(0.0)) / u for c, u in parts.items()), F.lit(0.0))
    out = stats.withColumn("heat", fixed(heat, 3))
    out = out.withColumn("kind", _two_sided(F.col("heat"), threshold, "hot_arm", "cold_arm"))
    return out.where(F.col("kind").isNotNull()).select("member", "kind", "heat", fixed(strength(F.col("heat"), 3.0), 4).alias("strength"))


def shrunk_streak(series: DataFrame, window: int = 10, prior_volume: float = 60.0, z_flag: float = 0.9,
                  min_games: int = 40, min_window: float = 20, min_season: float = 100,
                  max_age_days: int | None = None, as_of=None) -> DataFrame:
    """Last games against the whole season, shrunk toward the season."""
    season = series.groupBy("member").agg(
        F.count(F.lit(1)).alias("games"), F.sum("num").alias("an"), F.sum("den").alias("ad"), F.max("at").alias("newest"))
    late = newest_rows(series, window).groupBy("member").agg(
        F.count(F.lit(1)).alias("wg"), F.sum("num").alias("wn"), F.sum("den").alias("wd"))
    both = season.join(late, "member").where(
        (F.col("games") >= min_games) & (F.col("wg") == window) & (F.col("wd") >= min_window) & (F.col("ad") >= min_season))
    if max_age_days is not None:
        both = both.where(F.datediff(F.lit(as_of), F.col("newest")) <= max_age_days)
    base, now = ratio(F.col("an"), F.col("ad")), ratio(F.col("wn"), F.col("wd"))
    both = both.withColumn("season", base).withColumn("window", now)
    shrunk = (F.col("wd") * F.col("window") + prior_volume * F.col("season")) / (F.col("wd") + prior_volume)
    spread = F.sqrt(F.greatest(F.col("season") * (1 - F.least(F.col("season"), F.lit(0.9))), F.lit(0.01)) / F.col("wd"))
    out = both.withColumn("z", fixed((shrunk - F.col("season")) / spread, 3))
    out = out.withColumn("kind", _two_sided(F.col("z"), z_flag, "hot_bat", "cold_bat"))
    return out.where(F.col("kind").isNotNull()).select(
        "member", "kind", "z", fixed(F.col("window"), 3).alias("window"), fixed(F.col("season"), 3).alias("season"),
        fixed(strength(F.col("z"), 3.0), 4).alias("strength"))


def volume_window_z(series: DataFrame, reversed_order: str, chunk: Column, volume: float = 25, z_flag: float = 1.5,
                    min_games: int = 15, min_window: float = 15, min_season: float = 80,
                    variance_floor: float = 0.05) -> DataFrame:
    """Newest games until a volume is reached, against the season.

    The game that crosses the volume is included: a row belongs while the rows
    newer than it hold less.  ``reversed_order`` is a unique column that grows
    with age and ``chunk`` a piece of it, so the scan runs newest first.
    """
    run = scan.running_sum(series, ["member"], [reversed_order], chunk, {"den": "newer"}, inclusive=False)
    inside = F.col("newer") < volume
    stats = run.groupBy("member").agg(
        F.count(F.lit(1)).alias("games"), F.sum("num").alias("sn"), F.sum("den").alias("sd"),
        F.sum(F.when(inside, F.col("num"))).alias("wn"), F.sum(F.when(inside, F.col("den"))).alias("wd"))
    stats = stats.where((F.col("games") >= min_games) & (F.col("wd") >= min_window) & (F.col("sd") >= min_season))
    p0 = ratio(F.col("sn"), F.col("sd"))
    spread = F.sqrt(F.greatest(p0 * (1 - p0), F.lit(variance_floor)) / F.col("wd"))
    out = stats.withColumn("z", fixed((ratio(F.col("wn"), F.col("wd")) - p0) / spread, 3))
    out = out.withColumn("kind", _two_sided(F.col("z"), z_flag, "contact_hot", "contact_cold"))
    return out.where(F.col("kind").isNotNull()).select(
        "member", "kind", "z", "wd", fixed(ratio(F.col("wn"), F.col("wd")), 3).alias("window"), fixed(p0, 3).alias("season"))


def mix_change(usage: DataFrame, prior: int = 6, rise: float = 0.10, at_least: float = 0.08, min_games: int = 4) -> DataFrame:
    """A kind whose newest share rose well above its mean share before.

    ``usage``: member, at, seq, kind, n — one row per appearance and kind.
    """
    games = usage.groupBy("member", "at", "seq").agg(F.sum("n").alias("total"))
    late = newest_rows(games, prior + 1)
    size = late.groupBy("member").agg(F.count(F.lit(1)).alias("games"))
    shares = usage.join(late, ["member", "at", "seq"]).withColumn("share", ratio(F.col("n"), F.col("total")))
    kinds = shares.groupBy("member", "kind").agg(
        F.sum(F.when(F.col(NEWEST) == 1, F.col("share"))).alias("use"),
        F.sum(F.when(F.col(NEWEST) > 1, F.col("share")).otherwise(0.0)).alias("before"))
    both = kinds.join(size, "member").where(F.col("games") >= min_games)
    base = F.col("before") / (F.col("games") - 1)
    both = both.withColumn("base", fixed(base, 4)).withColumn("use", fixed(F.col("use"), 4))
    flagged = both.where((F.col("use") - F.col("base") >= rise) & (F.col("use") >= at_least))
    jump = fixed(F.col("use") - F.col("base"), 4)
    return ranking.top_k(flagged.withColumn("jump", jump), ["member"], [F.desc("jump"), F.asc("kind")], 1).select(
        "member", "kind", "use", "base", fixed(strength(F.col("jump"), 0.25), 4).alias("strength"))


def luck_gap(actual: DataFrame, expected: DataFrame, threshold: float, unit: float, higher_is_good: bool = True) -> DataFrame:
    """Actual minus expected: sell what ran hot, buy what ran cold."""
    both = actual.join(expected, "member").withColumn("gap", fixed(F.col("actual") - F.col("expected"), 4))
    names = ("sell_high", "buy_low") if higher_is_good else ("buy_low", "sell_high")
    out = both.withColumn("kind", _two_sided(F.col("gap"), threshold, *names))
    return out.where(F.col("kind").isNotNull()).select("member", "kind", "gap", fixed(strength(F.col("gap"), unit), 4).alias("strength"))


def yearly_decline(values: DataFrame, threshold: float) -> DataFrame:
    """Members whose value fell by at least ``-threshold`` against last year."""
    before = values.select("member", (F.col("year") + 1).alias("year"), F.col("value").alias("before"))
    both = values.join(before, ["member", "year"]).withColumn("change", F.col("value") - F.col("before"))
    return both.where(F.col("change") <= threshold).select("member", "year", "value", "before", "change")


def free_agent_stamp(signals: DataFrame, intervals: DataFrame) -> DataFrame:
    """One place decides the flag: free means no open interval."""
    held = intervals.where(F.col("to_ts").isNull()).select("member").distinct().withColumn("held", F.lit(True))
    return signals.join(held, "member", "left").withColumn("free", F.col("held").isNull()).drop("held")


def newest_signals(signals: DataFrame, days: int, as_of) -> DataFrame:
    """Latest row per member and kind among the signals of the last days."""
    fresh = signals.where(F.col("at") >= F.date_sub(F.lit(as_of), days))
    return ranking.top_k(fresh, ["member", "kind"], [F.desc("at"), F.desc("seq")], 1).drop("rank")


# --- activity and gates ----------------------------------------------------


def activity(lines: DataFrame, as_of, window: int = 14, long_window: int = 30) -> DataFrame:
    """Usage of every (member, side) up to a date: counts, role, days since.

    ``lines``: member, side, date, starts, saves, holds, volume.
    """
    day = F.lit(as_of).cast("date")
    near = F.col("date") > F.date_sub(day, window)
    far = F.col("date") > F.date_sub(day, long_window)

    def total(cond, c):
        return F.sum(F.when(cond, F.coalesce(F.col(c), F.lit(0))).otherwise(0))

    one = lines.where(F.col("date") <= day).groupBy("member", "side").agg(
        F.max("date").alias("last_game"), F.sum(near.cast("long")).alias("apps14"), F.sum(far.cast("long")).alias("apps30"),
        total(far, "starts").alias("starts30"), total(far, "saves").alias("saves30"), total(far, "holds").alias("holds30"),
        total(near, "volume").alias("volume14"))
    c = F.col
    return one.withColumn("days_since", F.datediff(day, "last_game")).withColumn(
        "role", usage_role(c("side"), c("apps14"), c("apps30"), c("starts30"), c("saves30"), c("holds30"), c("volume14")))


def gate(candidates: DataFrame, usage: DataFrame, stale_days: int = 7) -> DataFrame:
    """Every candidate with a status; none is dropped."""
    joined = candidates.join(usage.select("member", "side", "apps14", "days_since", "role"), ["member", "side"], "left")
    return joined.withColumn("status", activity_status(F.col("days_since"), F.col("apps14"), stale_days))


def best_side(roster: DataFrame, usage: DataFrame) -> DataFrame:
    """Roster members with their most used side."""
    rank = F.struct("apps14", F.col("last_game"), F.col("side"))
    best = usage.groupBy("member").agg(F.max_by(F.struct("side", "apps14", "days_since", "role"), rank).alias("b"))
    out = roster.join(best, "member", "left")
    return out.select(*roster.columns, F.col("b.side").alias("side"), F.coalesce("b.apps14", F.lit(0)).alias("apps14"),
                      F.col("b.days_since").alias("days_since"), F.coalesce("b.role", F.lit("no day lines")).alias("usage_role"))


def eligibility_windows(games: DataFrame, held: DataFrame, low: int = 15, high: int = 19) -> DataFrame:
    """Positions a member is close to and does not hold yet.

    ``games``: member, position, games; ``held``: member, positions (array).
    """
    near = games.where(F.col("games").between(low, high)).join(held, "member", "left")
    have = F.coalesce(F.array_contains("positions", F.col("position")), F.lit(False))
    return near.where(~have).select("member", "position", "games")


def coming_twice(starts: DataFrame, as_of, days: int = 7, at_least: int = 2) -> DataFrame:
    day = F.lit(as_of).cast("date")
    soon = starts.where((F.col("date") >= day) & (F.col("date") < F.date_add(day, days)))
    return soon.groupBy("member").agg(F.count(F.lit(1)).alias("starts")).where(F.col("starts") >= at_least)


# --- projections and tests of signals --------------------------------------


def shrunken_projection(totals: DataFrame, roster: DataFrame, stats: list[str], weeks: int,
                        prior: dict[str, float], factors: DataFrame | None = None, bench: float = 0.35,
                        thin: int = 15) -> DataFrame:
    """Expected weekly production per entity from shrunken member rates.

    ``totals``: member, side, position, volume, starts_wins, saves, outs and
    the stats; ``roster``: entity, member, in_lineup, club; ``factors``: club,
    factor.
    """
    c = F.col
    rows = totals.withColumn("grp", production_role(c("side"), c("position"), c("starts_wins"), c("saves"), c("outs")))
    means = aggregates.group_mean_with_fallback(rows, "grp", "side", stats, thin).drop("n")
    base = F.create_map(*[F.lit(x) for kv in prior.items() for x in kv])
    rows = rows.join(means, ["side", "grp"]).withColumn("alpha", ratio(c("volume"), c("volume") + base[c("side")]))
    shrunk = [
        (c("alpha") * c(s) / weeks + (1 - c("alpha")) * c(f"mu_{s}") / weeks * 0.5).alias(f"p_{s}") for s in stats]
    rows = rows.select("member", "side", *shrunk)
    share = F.when(c("in_lineup"), 1.0).otherwise(bench)
    if factors is not None:
        roster = roster.join(factors, "club", "left")
        share = share * F.coalesce("factor", F.lit(1.0))
    weighted = roster.select("entity", "member", share.alias("w")).join(rows, "member")
    return weighted.groupBy("entity").agg(*[fixed(F.sum(c("w") * c(f"p_{s}")), 3).alias(s) for s in stats])


def as_of_trend(series: DataFrame, value: str, recent: int = 2, prior: int = 5) -> DataFrame:
    """Trend of every member as of the end of every period it appeared in.

    Each (member, period) is first cut to its newest ``recent + prior`` rows;
    the trailing frames then run over a few rows per period.  ``n`` counts all
    appearances so far.
    """
    k = recent + prior
    per = series.groupBy("member", "period").agg(F.count(F.lit(1)).alias("n_here"))
    cut = ranking.top_k(series, ["member", "period"], [F.desc("at"), F.desc("seq")], k, NEWEST)
    w = Window.partitionBy("member").orderBy("at", "seq")
    trail = cut.withColumn("recent", F.avg(value).over(w.rowsBetween(-(recent - 1), 0))).withColumn(
        "prior", F.avg(value).over(w.rowsBetween(-(k - 1), -recent)))
    last = trail.where(F.col(NEWEST) == 1).select("member", "period", "recent", "prior")
    so_far = Window.partitionBy("member").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return last.join(per, ["member", "period"]).withColumn("n", F.sum("n_here").over(so_far)).drop("n_here")


def signal_backtest(series: DataFrame, value: str, outcomes: DataFrame, thresholds: list[float], stands: list[int],
                    at_least: int = 4, min_next: float = 9, min_past: float = 90, calm: float = 0.3,
                    min_flagged: int = 8) -> DataFrame:
    """Does a falling trend predict a fall in the next period?

    ``outcomes``: member, period, num, vol.  A stand T uses appearances up to
    the end of T and the outcome of T + 1; thresholds are rows, not runs.
    """
    trend = as_of_trend(series, value)
    grid = series.select("member").distinct().select("member", F.explode(F.array(*[F.lit(s) for s in stands])).alias("stand"))
    until = Window.partitionBy("member").orderBy("period")
    spans = trend.withColumn("next_at", F.lead("period").over(until))
    reach = spans.select("member", "recent", "prior", "n", F.explode(F.filter(
        F.array(*[F.lit(s) for s in stands]),
        lambda s: (s >= F.col("period")) & (F.col("next_at").isNull() | (s < F.col("next_at"))))).alias("stand"))
    past = Window.partitionBy("member").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    sums = outcomes.groupBy("member", "period").agg(F.sum("num").alias("num"), F.sum("vol").alias("vol"))
    nxt = sums.select("member", (F.col("period") - 1).alias("stand"), F.col("num").alias("nn"), F.col("vol").alias("nv"))
    cum = sums.select("member", "period", F.sum("num").over(past).alias("pn"), F.sum("vol").over(past).alias("pv"),
                      F.lead("period").over(until).alias("next_at"))
    so_far = cum.select("member", "pn", "pv", F.explode(F.filter(
        F.array(*[F.lit(s) for s in stands]),
        lambda s: (s >= F.col("period")) & (F.col("next_at").isNull() | (s < F.col("next_at"))))).alias("stand"))
    keys = ["member", "stand"]
    rows = grid.join(reach, keys).join(so_far, keys).join(nxt, keys).where(
        (F.col("n") >= at_least) & F.col("prior").isNotNull() & (F.col("nv") >= min_next) & (F.col("pv") >= min_past))
    rows = rows.select(fixed(F.col("recent") - F.col("prior"), 6).alias("delta"),
                       (ratio(F.col("nn"), F.col("nv")) - ratio(F.col("pn"), F.col("pv"))).alias("move"))
    levels = rows.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    flagged = F.col("delta") <= -F.col("threshold")
    quiet = ~flagged & (F.abs(F.col("delta")) < calm)
    out = levels.groupBy("threshold").agg(
        F.sum(flagged.cast("long")).alias("n_flagged"),
        fixed(F.avg(F.when(flagged, F.col("move"))), 6).alias("flagged_move"),
        fixed(F.coalesce(F.avg(F.when(quiet, F.col("move"))), F.lit(0.0)), 6).alias("baseline_move"))
    return out.where(F.col("n_flagged") >= min_flagged).withColumn(
        "edge", fixed(F.col("flagged_move") - F.col("baseline_move"), 6))


def best_for_metric(totals: DataFrame, floors: dict[str, tuple[str, float]], metrics: dict[str, Column], k: int = 3) -> DataFrame:
    """Top members of every entity per metric above a volume floor."""
    rows = [
        totals.where(F.col(floors[m][0]) >= floors[m][1]).select("entity", "member", F.lit(m).alias("metric"), v.alias("value"))
        for m, v in metrics.items()
    ]
    every = reduce(lambda a, b: a.unionByName(b), rows).where(F.col("value").isNotNull())
    return ranking.top_k(every, ["entity", "metric"], [F.desc("value"), F.asc("member")], k)

"""Identity across sources: cascaded match, merges, splits, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestlake.functions import names as N


# Match passes, strongest evidence first.
PASSES = ["exact", "stripped", "last_initial"]


def _match_keys(norm: Column) -> Column:
    """The key of every pass as (strength, key) rows."""
    keys = [norm, N.strip_suffix(norm), F.concat_ws("|", N.last_name(norm), N.first_initial(norm))]
    return F.array(*[F.struct(F.lit(i).alias("strength"), k.alias("key")) for i, k in enumerate(keys)])


def _lookup(targets: DataFrame, by: list[str], tag: str) -> DataFrame:
    """Candidates per key level: how many, and the one id when it is unique.

    Candidates are counted and never listed, so a name that a third of the
    universe shares is a single row.  A lookup has up to a row per target and
    pass, which the size of the file does not tell: it is merged, not broadcast.
    """
    return targets.groupBy("strength", "key", *by).agg(
        F.count(F.lit(1)).alias(f"n_{tag}"), F.min("target_id").alias(f"id_{tag}")).hint("merge")


def _found(known: Column) -> Column:
    """Unique by key, else by key and flag, else by key, flag and team."""
    def level(tag):
        return F.struct(F.coalesce(F.col(f"n_{tag}"), F.lit(0)).alias("n"), F.col(f"id_{tag}").alias("id"))

    few = lambda tag: F.coalesce(F.col(f"n_{tag}"), F.lit(0)) <= 1
    by_flag = F.when(few("kf"), level("kf")).otherwise(level("kft"))
    return F.when(few("k"), level("k")).when(known, by_flag).otherwise(level("kt"))


def cascade(sources: DataFrame, targets: DataFrame, codes: dict[str, str] | None = None) -> DataFrame:
    """Match every source row by the first pass that has candidates.

    ``sources``: source_id, norm, flag, team, rostered.  ``targets``:
    target_id, norm, flag, team.  Fuzzy passes are for rostered rows only: on
    the long tail they would hand out wrong ids.  All passes run together: a
    source is one row per pass, four lookups serve them all, and the strongest
    pass with a candidate is kept.  ``codes`` translates the sources' teams to
    those of the targets.
    """
    if codes:
        sources = sources.withColumn("team", N.translated(F.col("team"), codes))
    keys = F.inline(_match_keys(F.col("norm")))
    wanted = targets.select("target_id", "flag", "team", keys)
    rows = sources.select("source_id", "flag", "team", "rostered", keys).where(
        (F.col("strength") == 0) | F.col("rostered"))
    for tag, by in [("k", []), ("kf", ["flag"]), ("kft", ["flag", "team"]), ("kt", ["team"])]:
        rows = rows.join(_lookup(wanted, by, tag), ["strength", "key", *by], "left")
    tried = rows.withColumn("found", _found(F.col("flag").isNotNull()))
    hit = F.when(F.col("found.n") > 0, F.struct("strength", "found"))
    best = tried.groupBy("source_id").agg(F.min_by(hit, F.when(hit.isNotNull(), F.col("strength"))).alias("hit"))
    n = F.coalesce(F.col("hit.found.n"), F.lit(0))
    names = F.array(*[F.lit(p) for p in PASSES])
    return best.select(
        "source_id", n.alias("candidates"), F.when(n == 1, F.col("hit.found.id")).alias("target_id"),
        F.get(names, F.col("hit.strength")).alias("matched_by"), F.col("hit.strength").alias("strength"),
        F.when(n == 1, "matched").when(n > 1, "ambiguous").otherwise("unmatched").alias("status"))


def resolve_collisions(matches: DataFrame) -> DataFrame:
    """A target claimed twice stays only with a strictly strongest claim."""
    claims = matches.where(F.col("status") == "matched").groupBy("target_id", "strength").agg(
        F.count(F.lit(1)).alias("at_strength"))
    best = claims.groupBy("target_id").agg(
        F.min("strength").alias("best"), F.min_by("at_strength", "strength").alias("at_best"),
        F.sum("at_strength").alias("claims"))
    judged = matches.join(best.hint("merge"), "target_id", "left")
    wins = (F.col("claims") == 1) | ((F.col("strength") == F.col("best")) & (F.col("at_best") == 1))
    lost = (F.col("status") == "matched") & ~wins
    return judged.select(
        "source_id", F.when(~lost | lost.isNull(), F.col("target_id")).alias("target_id"), "matched_by", "strength",
        F.when(lost, "rejected").otherwise(F.col("status")).alias("status"))


def apply_overrides(matches: DataFrame, overrides: DataFrame) -> DataFrame:
    """Hand decisions win: (source_id, forced_id)."""
    out = matches.join(overrides.hint("merge"), "source_id", "left")
    return out.select(
        "source_id", F.coalesce("forced_id", "target_id").alias("target_id"),
        F.when(F.col("forced_id").isNotNull(), "override").otherwise(F.col("status")).alias("status"))


def merge_aliases(nodes: DataFrame) -> DataFrame:
    """Alias → canonical for nodes that share a strong id.

    ``nodes``: uid, strong_id, other_id, degree, name.  The survivor has the
    other id, then the most links, then the fuller name, then the smaller uid.
    """
    rank = F.struct(
        F.col("other_id").isNotNull().cast("int"), F.col("degree"), F.length("name"), -F.col("uid"))
    keyed = nodes.where(F.col("strong_id").isNotNull())
    best = keyed.groupBy("strong_id").agg(F.max_by("uid", rank).alias("canonical"), F.count(F.lit(1)).alias("n"))
    shared = best.where(F.col("n") > 1).drop("n")
    return keyed.join(shared, "strong_id").where(F.col("uid") != F.col("canonical")).select(
        F.col("uid").alias("alias"), "canonical", "strong_id")


def merged_properties(nodes: DataFrame, aliases: DataFrame, properties: list[str]) -> DataFrame:
    """Survivors with gaps filled from the nodes merged into them."""
    mapped = nodes.join(aliases.select(F.col("alias").alias("uid"), "canonical"), "uid", "left")
    mapped = mapped.withColumn("own", F.col("canonical").isNull()).withColumn("uid2", F.coalesce("canonical", "uid"))
    order = F.struct(F.col("own").cast("int"), -F.col("uid"))
    picks = [F.max_by(p, F.when(F.col(p).isNotNull(), order)).alias(p) for p in properties]
    return mapped.groupBy(F.col("uid2").alias("uid")).agg(*picks)


def rewrite(rows: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """Point foreign keys at survivors."""
    to = aliases.select(F.col("alias").alias(key), "canonical")
    return rows.join(to, key, "left").withColumn(key, F.coalesce("canonical", key)).drop("canonical")


def split_collisions(entries: DataFrame, line_counts: DataFrame) -> DataFrame:
    """One name node fed by two sides: keep the primary side, route the other.

    ``entries``: uid, side, rank (one row per uid and side); ``line_counts``:
    uid, side, lines.  Primary is the side with most lines, without lines the
    side with the better rank; ties go to ``bat``.
    """
    both = entries.groupBy("uid").agg(F.count_distinct("side").alias("sides")).where(F.col("sides") > 1).drop("sides")
    sided = entries.join(both, "uid", "left_semi").join(line_counts, ["uid", "side"], "left")
    order = F.struct(F.coalesce("lines", F.lit(0)), -F.coalesce(F.col("rank"), F.lit(9999)), (F.col("side") == "bat").cast("int"))
    primary = sided.groupBy("uid").agg(F.max_by("side", order).alias("primary"))
    other = F.when(F.col("primary") == "bat", "pit").otherwise("bat")
    return primary.select("uid", "primary", other.alias("other"),
                          F.concat_ws("_", F.col("uid").cast("string"), other).alias("new_uid"))


def split_same_side(entries: DataFrame, kept: DataFrame) -> DataFrame:
    """Foreign strong ids on one node get uids of their own.

    ``entries``: uid, strong_id; ``kept``: uid, node_id (the id the node
    carries, may be null → smallest stays).
    """
    ids = entries.where(F.col("strong_id").isNotNull()).select("uid", "strong_id").distinct()
    many = ids.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.min("strong_id").alias("first")).where(F.col("n") > 1)
    plan = ids.join(many, "uid").join(kept, "uid", "left").withColumn("keep", F.coalesce("node_id", "first"))
    return plan.where(F.col("strong_id") != F.col("keep")).select(
        "uid", "strong_id", F.concat(F.col("uid").cast("string"), F.lit("_id"), F.col("strong_id").cast("string")).alias("new_uid"))


def audit(checks: dict[str, DataFrame]) -> DataFrame:
    """All integrity checks as (check, key, detail) rows."""
    rows = [df.select(F.lit(name).alias("check_name"), F.col("key").cast("string").alias("key"),
                      F.col("detail").cast("string").alias("detail")) for name, df in checks.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)

"""Quality rules with host verdicts (DataFrame functions only).

A document fails base rules on its own numbers.  Rule failures are then added
up by host (the ``source`` column), each host's rate is shrunk towards a beta
prior fitted to all hosts by moments, and a host whose shrunken rate of any
rule exceeds ``host_limit`` takes its documents with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestlake.session import cut_lineage

# Fixed values of the base rules.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
WINDOW = 8
REPEAT_PERCENT = 30

#: A host goes when the shrunken share of its documents failing one rule is above this.
HOST_LIMIT = 0.5
RULES = ("short", "repetitive", "symbols", "dup_lines")


def _pairs(hashes: Column, step: int) -> Column:
    """Hash of each element with the one ``step`` further on; doubles the window that a hash covers."""
    rest = F.slice(hashes, step + 1, F.greatest(F.size(hashes) - step, F.lit(0)))
    return F.slice(F.zip_with(hashes, rest, lambda a, b: F.xxhash64(a, b)), 1, F.greatest(F.size(hashes) - step, F.lit(0)))


def document_stats(docs: DataFrame) -> DataFrame:
    """Word, symbol and repetition counts of each document; a null text counts as empty.

    Keeps one row per input row with ``doc_id``, ``source``, ``text_key`` and
    the counts; other columns are not read.  Equal 8-word windows are found as
    equal 64-bit hashes; only texts that repeat a window are sorted.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, SPACES, "") != "")
    out = docs.select(
        "doc_id",
        "source",
        F.xxhash64("text").alias("text_key"),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    rest = ["doc_id", "source", "text_key", "word_chars", "n_symbols"]
    out = out.select(
        *rest,
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    rest += ["n_words", "n_lines", "n_dup_lines"]
    step = 1
    while step < WINDOW:
        out = out.select(*rest, _pairs(F.col("h"), step).alias("h"))
        step *= 2
    numbered = F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    out = out.select(*rest, F.when(repeats, F.array_sort(numbered)).alias("s"))
    last = F.size("s") - 1
    same = F.transform(
        "s",
        lambda x, i: F.when(
            ((i > 0) & (F.get("s", i - 1)["h"] == x["h"])) | ((i < last) & (F.get("s", i + 1)["h"] == x["h"])), x["i"]
        ),
    )
    out = out.select(*rest, F.sort_array(F.filter(same, lambda i: i.isNotNull())).alias("p"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    covered = F.aggregate(
        "p",
        zero,
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["reach"], i)).alias("n"), (i + WINDOW).alias("reach")),
        lambda a: a["n"],
    )
    return out.select(*rest, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def rule_flags(stats: DataFrame) -> DataFrame:
    """One boolean per rule, and ``base_failed`` for the two that reject on their own."""
    short = F.col("n_words") < MIN_WORDS
    repetitive = 100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    return stats.select(
        "*",
        short.alias("short"),
        repetitive.alias("repetitive"),
        (10 * F.col("n_symbols") > F.col("n_words")).alias("symbols"),
        (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")).alias("dup_lines"),
        (short | repetitive).alias("base_failed"),
    )


def host_verdicts(flags: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """(source, shrunken rate per rule, host_failed) for every host; null is a host of its own.

    The prior of a rule is a beta distribution fitted to all hosts.  Its mean is
    the share of all documents.  Its weight follows from how much more the
    hosts' rates differ than chance alone makes them (between and within hosts,
    each host counted by its documents): hosts that differ no more than that,
    or that have one document each, are all taken for the mean.  Five numbers
    per rule reach the driver.
    """
    hosts = cut_lineage(
        flags.groupBy("source").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES]
        )
    )
    sums = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("n")).alias("squares"),
        *[F.sum(r).alias(f"k_{r}") for r in RULES],
        *[F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"q_{r}") for r in RULES],
    ).first()
    rates = []
    for r in RULES:
        mean, weight = beta_prior(sums["hosts"], sums["docs"] or 0, sums["squares"] or 0, sums[f"k_{r}"] or 0, sums[f"q_{r}"] or 0.0)
        shrunk = F.lit(mean) if weight is None else (F.col(r) + F.lit(weight * mean)) / (F.col("n") + F.lit(weight))
        rates.append(shrunk.alias(f"rate_{r}"))
    rated = hosts.select("source", "n", *rates)
    return rated.withColumn("host_failed", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > host_limit)


def beta_prior(hosts: int, docs: int, squares: int, failed: int, weighted: float) -> tuple[float, float | None]:
    """(mean, weight in documents) of the prior; no weight if hosts do not differ beyond chance.

    ``squares`` is the sum of the hosts' squared sizes and ``weighted`` that of
    their squared failures over their sizes, which give the mean squares
    between and within hosts.
    """
    mean = failed / docs if docs else 0.0
    if hosts < 2 or docs <= hosts:
        return mean, None
    between = (weighted - failed * failed / docs) / (hosts - 1)
    within = (failed - weighted) / (docs - hosts)
    size = (docs - squares / docs) / (hosts - 1)
    spread = between - within
    if spread <= 1e-12:
        return mean, None
    return mean, size * within / spread


def judge(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: its counts, ``base_failed`` and ``kept``.

    Null texts count as empty (and so fail the length rule); repeated rows and
    equal ids are judged row by row; an empty table gives an empty result.
    Only the failed hosts are joined back, on a null-safe key.
    """
    flags = cut_lineage(rule_flags(document_stats(docs)))
    bad = host_verdicts(flags, host_limit).where("host_failed").select(F.col("source").alias("bad_source"), "host_failed")
    joined = flags.join(bad, flags["source"].eqNullSafe(bad["bad_source"]), "left")
    return joined.select(
        "doc_id", "source", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_failed").isNull()).alias("kept"),
    )


def keep_documents(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns."""
    good = (
        judge(docs, host_limit)
        .where("kept")
        .select(F.col("doc_id").alias("good_id"), F.col("source").alias("good_source"), F.col("text_key").alias("good_key"))
        .distinct()
    )
    same = (
        docs["doc_id"].eqNullSafe(good["good_id"])
        & docs["source"].eqNullSafe(good["good_source"])
        & (F.xxhash64(docs["text"]) == good["good_key"])
    )
    return docs.join(good, same, "left_semi")

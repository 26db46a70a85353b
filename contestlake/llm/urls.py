"""URL filters: host and path rules, and a classifier for the rest.

The classifier is a logistic regression over hashed character n-grams of host
and path.  It is trained on the driver from a labelled table of at most
``MAX_LABELLED`` urls; the weights are ``1 << BITS`` numbers and travel to the
tasks with the function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contestlake.llm.shingles import mix

# Rules as (host, path prefix, verdict).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

#: Bound on the labelled table that the driver reads.
MAX_LABELLED = 10_000
BITS = 14
GRAMS = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The labelled urls of the registered query are made of these words; none is taken from the tables.
BLOCK_WORDS = (
    "casino poker roulette jackpot gambling betting lottery slots wager bingo pharmacy viagra cialis pills steroid porn adult xxx cams escort "
    "nude erotic payday loans debtfix spam spammer spambot phishing malware trojan keygen warez cracked torrent "
    "popup clickbait adserver adtracker banner replica counterfeit prizes winner giveaway sweepstake hookup hotgirls getrich quickcash"
).split()
ALLOW_WORDS = (
    "morning harbour library river garden school mountain archive bakery weather museum history science village kitchen travel "
    "physics chemistry orchestra theatre council hospital university railway bridge forest island football cycling recipes novel "
    "poetry painting sculpture geology biology climate energy housing transport election parliament economy market farming "
    "carpentry pottery weaving sailing climbing chess puzzle language grammar dictionary atlas census almanac journal gazette "
    "chronicle observer tribune festival concert gallery cathedral monastery observatory laboratory workshop software compiler network"
).split()
#: Hosts and paths of both labels have these, and hyphens; they tell nothing.
EITHER_WORDS = "online free best my the world city shop club home new top win cheap live now".split()
#: Allowed urls with names that mean nothing, so that a name as such does not block.
MADE_UP = 300
#: Rounds through the words, each with other partners.
TURNS = 2
PREFIXES = ["", "www.", "m.", "blog.", "news."]
SUFFIXES = ["example.com", "example.org", "example.net"]
PLAIN_PATHS = ["/", "/index.html", "/about", "/p/17", "/2020/05/21", "", "/page/3.html", "/contact/"]


def default_labels() -> list[tuple[str, int]]:
    """(url, 1 to block or 0 to allow).

    What blocks a url stands in its host or in its path alone.  Hyphenated and
    plain hosts, prefixes, suffixes and path forms go round in both labels.
    """

    def turned(forms: list[str], i: int) -> list[str]:
        return forms[i % len(forms) :] + forms[: i % len(forms)]

    def named(words: list[str], i: int, t: int = 0) -> list[str]:
        a, b, c = words[i], words[(7 * i + 3 + 10 * t) % len(words)], EITHER_WORDS[(i + 5 * t) % len(EITHER_WORDS)]
        return turned([a, f"{a}-{b}", f"{a}{b}", f"{c}-{a}", f"{a}{c}", f"{a}-{c}"], i)

    def paths(words: list[str], i: int, t: int = 0) -> list[str]:
        a, b, c = words[i], words[(11 * i + 5 + 9 * t) % len(words)], EITHER_WORDS[(3 * i + 7 * t) % len(EITHER_WORDS)]
        return turned([f"/{a}/{c}", f"/{c}-{a}-{b}", f"/{a}.html", f"/{c}/{a}/12", f"/{b}-{a}", f"/{a}/{b}"], i)

    out = []

    def add(host: str, path: str, label: int) -> None:
        k = len(out)
        out.append((f"https://{PREFIXES[k % len(PREFIXES)]}{host}.{SUFFIXES[k // 2 % len(SUFFIXES)]}{path}", label))

    for i in range(len(BLOCK_WORDS) * TURNS):
        i, t = i % len(BLOCK_WORDS), i // len(BLOCK_WORDS)
        for j, host in enumerate(named(BLOCK_WORDS, i, t)):
            k = (6 * i + j) * 5 + t
            add(host, PLAIN_PATHS[k % len(PLAIN_PATHS)] if (i + j) % 3 else paths(ALLOW_WORDS, k % len(ALLOW_WORDS))[j], 1)
        for j, path in enumerate(paths(BLOCK_WORDS, i, t)):
            k = (6 * i + j) * 5 + t
            add(made_up(k) if (i + j) % 3 else named(ALLOW_WORDS, k % len(ALLOW_WORDS))[j], path, 1)
    for i in range(len(ALLOW_WORDS) * TURNS):
        i, t = i % len(ALLOW_WORDS), i // len(ALLOW_WORDS)
        for j, host in enumerate(named(ALLOW_WORDS, i, t)):
            add(host, PLAIN_PATHS[(6 * i + j + t) % len(PLAIN_PATHS)], 0)
        for j, path in enumerate(paths(ALLOW_WORDS, i, t)):
            k = 6 * i + j + 600 * t
            add(made_up(k) if (i + j) % 3 else named(ALLOW_WORDS, (13 * i + 5) % len(ALLOW_WORDS))[j], path, 0)
    for k in range(MADE_UP):
        name = EITHER_WORDS[k // 3 % len(EITHER_WORDS)]
        add([made_up(k), f"{made_up(k)}-{name}", f"{name}-{made_up(k)}"][k % 3], PLAIN_PATHS[k // 2 % len(PLAIN_PATHS)] if k % 5 else f"/{made_up(k + 7)}/{name}", 0)
    return out


def made_up(k: int) -> str:
    """A name of two or three syllables that means nothing."""
    letters = int(mix(np.array([k + 1], dtype=np.uint64))[0])
    out = ""
    for _ in range(2 + k % 2):
        letters, a = divmod(letters, 20)
        letters, b = divmod(letters, 5)
        letters, c = divmod(letters, 9)
        out += "bcdfghjklmnpqrstvwxz"[a] + "aeiou"[b] + "lmnrst   "[c].strip()
    return out


def split_urls(pages: DataFrame) -> DataFrame:
    """page_id, host and path.

    The host lies between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; the path goes on to
    ``?`` or ``#``.  Both are empty for null or without ``://``.
    """
    out = pages.select("page_id", F.coalesce("url", F.lit("")).alias("u"))
    rest = F.when(F.locate("://", F.col("u")) > 0, F.expr("substring(u, locate('://', u) + 3)")).otherwise("")
    out = out.select("page_id", rest.alias("rest"))
    host = F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), UPPER, LOWER)
    return out.select("page_id", host.alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def rule_for(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits ``host`` and ``path``, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, prefix, what in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(prefix)
        name = F.when(fits, F.lit(host + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def features(host: str, path: str, bits: int = BITS) -> np.ndarray:
    """Slots of the distinct character n-grams of host and path; the two do not share slots on purpose."""
    out = []
    for mark, part in ((1, host), (2, path)):
        codes = np.frombuffer(f"^{part}$".encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        for k in GRAMS:
            n = len(codes) - k + 1
            if n > 0:
                h = np.full(n, mark * 31 + k, dtype=np.uint64)
                for j in range(k):
                    h = h * np.uint64(0x100000001B3) + codes[j : j + n]
                out.append(mix(h) >> np.uint64(64 - bits))
    return np.unique(np.concatenate(out)).astype(np.int64) if out else np.zeros(0, dtype=np.int64)


class UrlModel:
    """Weights of the regression; a feature row is scaled to length 1."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, host: str, path: str) -> float:
        f = features(host, path)
        z = self.bias + (self.weights[f].sum() / np.sqrt(len(f)) if len(f) else 0.0)
        return float(1 / (1 + np.exp(-z)))


def train(labelled: list[tuple[str, str, int]], rounds: int = 300, rate: float = 2.0, decay: float = 1e-4) -> UrlModel:
    """Full-batch gradient descent from zero over (host, path, label); the order of the rows does not matter much and is fixed.

    Without rows of both labels nothing is learnt, and every url is allowed.
    """
    weights, bias = np.zeros(1 << BITS), 0.0
    rows = sorted(set(labelled))
    if len({y for _, _, y in rows}) < 2:
        return UrlModel(weights, -1.0)
    slots = [features(h, p) for h, p, _ in rows]
    y = np.array([label for _, _, label in rows], dtype=float)
    owner = np.repeat(np.arange(len(rows)), [len(s) for s in slots])
    flat = np.concatenate(slots)
    scale = 1 / np.sqrt(np.maximum([len(s) for s in slots], 1))
    for _ in range(rounds):
        z = np.bincount(owner, weights[flat], minlength=len(rows)) * scale + bias
        error = (1 / (1 + np.exp(-z)) - y) / len(rows)
        weights -= rate * (np.bincount(flat, (error * scale)[owner], minlength=len(weights)) * 10 + decay * weights)
        bias -= rate * error.sum()
    return UrlModel(weights, bias)


def model_from(labelled: DataFrame, limit: int = MAX_LABELLED) -> UrlModel:
    """Train on (url, label); a table with more than ``limit`` rows is an error, not cut."""
    pages = split_urls(labelled.select(F.col("label").alias("page_id"), "url"))
    rows = pages.where(F.col("page_id").isNotNull()).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} labelled urls")
    return train([(r["host"], r["path"], int(r["page_id"])) for r in rows])


def judge(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule, score, verdict for every page; no shuffle.

    A null url, or one without ``://``, has empty host and path and is scored
    like any other.  Repeated rows are judged each.
    """
    name, verdict = rule_for(RULES if rules is None else rules)
    split = split_urls(pages).withColumns({"rule": name, "ruled": verdict})

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(h, p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist())]
            yield pa.record_batch([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, "score"])

    out = split.mapInArrow(scored, "page_id long, host string, path string, rule string, ruled string, score double")
    chosen = F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", chosen.alias("verdict"), "score")

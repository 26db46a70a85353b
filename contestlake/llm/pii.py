"""Personal data: patterns, and words that give protected entities away.

Four patterns find the protected entities.  The corpus then tells how strongly
a word discloses one: the pointwise mutual information of word and entity, as
a share of the information that the entity carries.  A word that reaches a
threshold is sanitised wherever it stands: generalised to its class or, above
the higher threshold, removed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contestlake.llm.bitmaps import bitmap_of, contains
from contestlake.llm.joins import null_safe
from contestlake.llm.shingles import ALNUM, Words, batches, text_bytes
from contestlake.session import cut_lineage

# The base patterns. Possessive repeats keep long runs linear and match the same text.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "generalise", "remove")

#: Words on either side of an entity that count as seen with it.
WINDOW = 10
#: Different surroundings in which a word must stand by an entity; copies of one passage are one.
CONTEXTS = 3
#: Share of an entity's information that a word may give away before it is generalised, and before it is removed.
GENERALISE, REMOVE = 0.9, 0.95

Arrow = Iterator[pa.RecordBatch]
Span = tuple[int, int, str]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @: the letters before it, back to the last match, and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    """Every second digit from the right is doubled, nines are cast out, and the sum ends in 0."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each pattern that pass its test, by kind and start."""
    out: list[Span] = [(a, z, "email") for a, z in _emails(text)]
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(_small(p) for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


def entity(text: str, span: Span) -> str:
    """The protected entity behind a span, whatever its punctuation and case."""
    a, z, kind = span
    value = text[a:z]
    if kind == "email":
        return "email:" + value.lower()
    return f"{kind}:{value}" if kind == "ip" else f"{kind}:{NOT_DIGIT.sub('', value)}"


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{z}" for a, z, kind in spans)


def _hash(value: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(value, digest_size=8).digest(), "little", signed=True)


def _byte_places(text: str, data: bytes, places: list[int]) -> list[int]:
    """Byte offsets of sorted code point offsets."""
    if len(text) == len(data):
        return places
    out, at, byte = [], 0, 0
    for p in places:
        byte += len(text[at:p].encode())
        at = p
        out.append(byte)
    return out


def seen_with(text: str, spans: list[Span]) -> list[tuple[int, int, int]]:
    """(entity, word, surroundings) once for each entity and word within the window; words inside entities do not count."""
    if not spans:
        return []
    data = text.encode()
    edges = sorted({p for a, z, _ in spans for p in (a, z)})
    byte = dict(zip(edges, _byte_places(text, data, edges)))
    words = Words([data], ALNUM)
    inside = np.zeros(len(words.hash) + 1, dtype=np.int32)
    reach = [(np.searchsorted(words.end, byte[a], side="right"), np.searchsorted(words.start, byte[z])) for a, z, _ in spans]
    for i, j in reach:
        inside[i] += 1
        inside[j] -= 1
    free = np.cumsum(inside[:-1]) == 0
    number = np.flatnonzero(free)
    out: dict[tuple[int, int], int] = {}
    for span, (i, j) in zip(spans, reach):
        left, right = np.searchsorted(number, i), np.searchsorted(number, j)
        near = words.hash[np.r_[number[max(left - WINDOW, 0) : left], number[right : right + WINDOW]]]
        who, context = _hash(entity(text, span).encode()), _hash(near.tobytes())
        for w in near.view(np.int64).tolist():
            out.setdefault((who, w), context)
    return [(who, w, context) for (who, w), context in out.items()]


FOUND = pa.schema([("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()),
                   ("base_sha256", pa.string()), ("base", pa.string()), ("entities", pa.list_(pa.int64())),
                   ("seen", pa.list_(pa.struct([("entity", pa.int64()), ("word", pa.int64()), ("context", pa.int64())])))])
SCANNED = ("doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
           "entities array<long>, seen array<struct<entity: long, word: long, context: long>>")


def _scan(arrow: Arrow) -> Arrow:
    for b in arrow:
        for at in range(0, b.num_rows, 512):
            part, rows = b.slice(at, 512), []
            for value in part.column(2).to_pylist():
                text = value or ""
                spans = base_spans(text)
                kinds = [k for _, _, k in spans]
                seen = seen_with(text, spans)
                who = sorted({_hash(entity(text, s).encode()) for s in spans})
                listed = joined(spans)
                rows.append((*(kinds.count(k) for k in BASE), hashlib.sha256(listed.encode()).hexdigest(), listed, who,
                             [{"entity": e, "word": w, "context": c} for e, w, c in seen]))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), FOUND)]
            yield pa.record_batch([part.column(0), part.column(1), *columns], names=["doc_id", "text_key", *FOUND.names])


def _frequencies(bitmap: np.ndarray):
    """(word, documents) of the words in the bitmap, counted by run of texts."""

    def run(arrow: Arrow) -> Arrow:
        for b in arrow:
            for texts in batches(text_bytes(b.column(0))):
                words = Words(texts, ALNUM)
                some = np.flatnonzero(contains(bitmap, words.hash))
                owner = np.searchsorted(words.first, some, side="right")
                order = np.lexsort((owner, words.hash[some]))
                word, owner = words.hash[some][order], owner[order]
                once = np.r_[True, (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])][: len(word)]
                found, n = np.unique(word[once], return_counts=True)
                yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return run


def disclosing(docs: DataFrame, scanned: DataFrame, contexts: int = CONTEXTS, generalise: float = GENERALISE) -> DataFrame:
    """(word, disclosure) of the words at or above the lower threshold.

    disclosure = max over entities of ln(N c / (f_w f_e)) / ln(N / f_e), with N
    documents, f_w and f_e of them holding the word and the entity, c both
    within the window.  An entity in every document has nothing to disclose.
    """
    total = scanned.count()
    pairs = scanned.select(F.explode("seen").alias("s")).select("s.*")
    pairs = pairs.groupBy("entity", "word", "context").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.groupBy("entity", "word").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("contexts"))
    pairs = cut_lineage(pairs.where(F.col("contexts") >= contexts).drop("contexts"))
    holding = scanned.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("f_entity"))
    words = docs.select("text").mapInArrow(_frequencies(bitmap_of(pairs, F.col("word"))), "word long, n long")
    words = words.groupBy("word").agg(F.sum("n").alias("f_word"))
    known = pairs.join(holding, "entity").join(words, "word")
    carried = F.log(F.lit(float(total)) / F.col("f_entity"))
    shared = F.log(F.lit(float(total)) * F.col("both") / (F.col("f_word") * F.col("f_entity")))
    scored = known.where(F.col("f_entity") < total).groupBy("word").agg(F.max(shared / carried).alias("disclosure"))
    return scored.where(F.col("disclosure") >= generalise)


HITS = "doc_id long, text_key long, word long, places array<struct<start: int, stop: int>>"


def _occurrences(bitmap: np.ndarray):
    """Where the words of the bitmap stand, a row for each document and word; offsets in code points."""

    def run(arrow: Arrow) -> Arrow:
        for b in arrow:
            at = 0
            for texts in batches(text_bytes(b.column(2))):
                words = Words(texts, ALNUM)
                some = np.flatnonzero(contains(bitmap, words.hash))
                if len(some):
                    owner = np.searchsorted(words.first, some, side="right") - 1
                    # Code points before each byte: those that do not continue another.
                    points = np.r_[0, np.cumsum((words.data & 0xC0) != 0x80)]
                    base = points[words.text_start[owner]]
                    start, stop = points[words.start[some]] - base, points[words.end[some]] - base
                    order = np.lexsort((start, words.hash[some], owner))
                    owner, word, start, stop = owner[order], words.hash[some][order], start[order], stop[order]
                    head = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (word[1:] != word[:-1])])
                    rows = pa.array(at + owner[head])
                    places = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], ["start", "stop"])
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[head, len(word)].astype(np.int32)), places)
                    yield pa.record_batch(
                        [b.column(0).take(rows), b.column(1).take(rows), pa.array(word[head].view(np.int64)), lists],
                        names=["doc_id", "text_key", "word", "places"])
                at += len(texts)

    return run


def scan(docs: DataFrame, contexts: int = CONTEXTS, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, text_key, counts, base_sha256, spans, n_generalise and n_remove for every row.

    ``spans`` lists the base spans by kind and start, then the words to
    generalise and to remove by start; words inside base spans are left to
    those.  A null or empty text has none.  Repeated rows get a row each, and
    rows that share an id but not a text are judged apart; an empty table
    gives no rows.  Other columns are not read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    scanned = cut_lineage(source.mapInArrow(_scan, SCANNED))
    words = cut_lineage(disclosing(docs, scanned, contexts, generalise))
    hits = source.mapInArrow(_occurrences(bitmap_of(words, F.col("word"))), HITS).join(words, "word")
    kind = F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise")
    hits = hits.select("doc_id", "text_key", kind.alias("kind"), F.explode("places").alias("at")).distinct()
    hits = hits.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("kind", "at.start", "at.stop"))).alias("words"))
    key = ["doc_id", "text_key"]
    both = null_safe(scanned.drop("entities", "seen"), hits, key)
    base = F.transform(F.filter(F.split("base", ","), lambda s: s != ""), lambda s: F.split(s, ":"))
    outside = F.filter("words", lambda w: ~F.exists("ranges", lambda r: (r["a"] < w["stop"]) & (w["start"] < r["z"])))
    both = both.withColumn("ranges", F.transform(base, lambda s: F.struct(s[1].cast("int").alias("a"), s[2].cast("int").alias("z"))))
    both = both.withColumn("words", F.coalesce(outside, F.array().cast("array<struct<kind: string, start: int, stop: int>>")))
    listed = F.array_join(F.transform("words", lambda w: F.concat_ws(":", w["kind"], w["start"], w["stop"])), ",")

    def count(name):
        return F.size(F.filter("words", lambda w: w["kind"] == name)).cast("long").alias(f"n_{name}")

    return both.select(
        *key, "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("words") > 0, listed)).alias("spans"),
        count("generalise"), count("remove"))


def general(word: str) -> str:
    """The class that stands for a word."""
    if word.isdigit():
        return "[number]"
    if any(c.isdigit() for c in word):
        return "[code]"
    return "[name]" if word[:1].isupper() else "[word]"


def sanitised(text: str, spans: str) -> str:
    """The text with entities replaced by their kind, words generalised or removed."""
    out, at = [], 0
    for kind, a, z in sorted((x.split(":") for x in spans.split(",") if x), key=lambda s: (int(s[1]), int(s[2]))):
        a, z = int(a), int(z)
        if a >= at:
            out += [text[at:a], general(text[a:z]) if kind == "generalise" else f"[{kind}]" if kind in BASE else ""]
        at = max(at, z)
    return "".join([*out, text[at:]])


def sanitise_documents(docs: DataFrame, contexts: int = CONTEXTS, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """The same rows and columns with ``text`` sanitised; a null text stays null."""
    found = scan(docs, contexts, generalise, remove)
    found = found.select("doc_id", F.col("text_key").alias("_text_key"), F.col("spans").alias("_spans")).distinct()
    keyed = null_safe(docs.withColumn("_text_key", F.xxhash64("text")), found, ["doc_id", "_text_key"])
    names = docs.columns
    kept = keyed.select(*names, "_spans")
    at = names.index("text")

    def run(arrow: Arrow) -> Arrow:
        for b in arrow:
            columns = list(b.columns[:-1])
            spans = b.column(len(names)).to_pylist()
            texts = [t if t is None or not s else sanitised(t, s) for t, s in zip(columns[at].to_pylist(), spans)]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.record_batch(columns, names=names)

    return kept.mapInArrow(run, docs.schema)

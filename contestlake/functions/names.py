"""Name keys and deterministic identifiers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Precomposed Latin letters and their base letter, derived from Unicode."""
    marked, plain = [], []
    for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)):
        for point in block:
            base = "".join(
                c for c in unicodedata.normalize("NFKD", chr(point)) if not unicodedata.combining(c)
            )
            if len(base) == 1 and base != chr(point):
                marked.append(chr(point))
                plain.append(base)
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _accent_table()


def strip_accents(text: Column) -> Column:
    """Base letters only: precomposed letters are mapped, loose marks removed."""
    return F.regexp_replace(F.translate(text, _MARKED, _PLAIN), r"\p{Mn}", "")


def normalize_name(text: Column) -> Column:
    """Lower case, no accents, dots or apostrophes, single spaces."""
    plain = F.regexp_replace(F.lower(strip_accents(text)), r"[.']", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def strip_suffix(norm: Column) -> Column:
    """Drop one generational suffix from a normalised name."""
    return F.regexp_replace(norm, r" (jr|sr|ii|iii|iv)$", "")


def last_name(norm: Column) -> Column:
    return F.element_at(F.split(strip_suffix(norm), " "), -1)


def first_initial(norm: Column) -> Column:
    return F.substring(norm, 1, 1)


def label_key(label: Column) -> Column:
    """``'D Rushing'`` or a full name → (initial, last, qualifier) as one key."""
    qualifier = F.lower(F.regexp_extract(label, r"(?i)\((batter|pitcher)\)\s*$", 1))
    norm = normalize_name(F.regexp_replace(label, r"(?i)\s*\((batter|pitcher)\)\s*$", ""))
    return F.struct(
        F.substring(norm, 1, 1).alias("initial"),
        F.element_at(F.split(norm, " "), -1).alias("last"),
        qualifier.alias("qualifier"),
    )


def content_uid(*parts: Column) -> Column:
    """Sixteen hex digits of a hash over the canonical content."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


def transaction_uid(posted_at: Column, team: Column, actions: Column) -> Column:
    """Key of a transaction from its content, so re-encoding never forks it.

    The separator keeps action order out of the key: actions are sorted first.
    """
    parts = F.array_sort(
        F.transform(actions, lambda a: F.concat(normalize_name(a["player"]), F.lit(":"), a["action"]))
    )
    stamp = F.date_format(posted_at, "yyyy-MM-dd'T'HH:mm:ss")
    return content_uid(stamp, team, F.array_join(parts, ";"))


def is_only(positions: Column, allowed: list[str]) -> Column:
    """True when a comma list holds nothing outside ``allowed``; null if unknown."""
    tokens = F.split(positions, ",")
    inside = F.size(F.array_except(tokens, F.array(*[F.lit(a) for a in allowed]))) == 0
    return F.when(positions.isNotNull() & (positions != ""), inside)


# Team codes of the league's site that the official feeds write in another way.
TEAM_CODES = {"CHW": "CWS", "WAS": "WSH"}


def translated(code: Column, table: dict[str, str] = TEAM_CODES) -> Column:
    """A code as the other source writes it; codes outside the table are the same in both."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code) if pairs else code

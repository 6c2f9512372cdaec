"""Column functions on text that several operators share."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f\x0B]"
WORD = r"[\p{L}\p{N}_]"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def join_tags(*parts: Column) -> Column:
    """Comma-joined, empty parts left out."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), ",")


def any_of(c: Column, keywords: list[str]) -> Column:
    found = F.lit(False)
    for k in keywords:
        found = found | c.contains(k)
    return found


def keyword_tags(c: Column, tag_map: Mapping[str, list[str]]) -> Column:
    """Every tag of which any keyword occurs, in the map's order."""
    return F.array_compact(F.array(*[F.when(any_of(c, words), F.lit(tag)) for tag, words in tag_map.items()]))


def first_match_label(c: Column, mapping: Mapping[str, str]) -> Column:
    """The label of the first key that occurs; else the text itself, lower case, with _ for what is no word character."""
    out = None
    for key, label in mapping.items():
        hit = c.contains(key)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    rest = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}_]", "_"))
    return rest if out is None else out.otherwise(rest)


def occurrences(c: Column, word: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(word), F.lit("")))) / F.lit(len(word))).cast("long")


def short_hash(c: Column, digits: int = 8) -> Column:
    """The first hex digits of the md5 of a text."""
    return F.substring(F.md5(c.cast("binary")), 1, digits)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def first_number(c: Column) -> Column:
    """The first number in a text, or null."""
    return F.when(c.rlike(r"[0-9]"), F.regexp_extract(c, r"([0-9]+)", 1).try_cast("long"))

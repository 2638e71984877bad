"""Seller exports: columns are named by plan-time matching of headers, cells become typed native expressions."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores of a header against an alias, and the least that counts.
EQUAL, WORD, EDGE, PART, ALIKE, LEAST = 1.0, 0.92, 0.88, 0.8, 0.86, 0.8
#: Grams of a unit, in the order in which a weight's text is searched for them.
UNITS = [("kg|kilo", 1000.0), ("lb|pound", 453.592), ("oz|ounce", 28.3495), ("g", 1.0)]


def plain(header: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", header.lower()).strip()


def score(header: str, alias: str) -> float:
    """How well a header fits an alias: equal, one of its words, at an edge with a blank, somewhere in it, or alike."""
    h, a = plain(header), plain(alias)
    if not h or not a:
        return 0.0
    if h == a:
        return EQUAL
    if a in h.split():
        return WORD
    if h.startswith(f"{a} ") or h.endswith(f" {a}"):
        return EDGE
    if a in h:
        return PART
    ratio = SequenceMatcher(None, h, a).ratio()
    return ratio if ratio >= ALIKE else 0.0


def map_columns(columns: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    """{target: column}: each column's best target; of columns with one target the best, the earlier one in a tie."""
    claims: dict[str, tuple[float, str]] = {}
    for column in columns:
        best, target = max(((max(score(column, a) for a in names), -k, t) for k, (t, names) in enumerate(aliases.items())), default=(0, 0, ""))[::2]
        if best >= LEAST and best > claims.get(target, (0.0, ""))[0]:
            claims[target] = (best, column)
    return {target: column for target, (_, column) in claims.items()}


def number(text: Column) -> Column:
    """A cell's number: all but digits and points goes; null where no number is left."""
    return F.regexp_replace(text, r"[^0-9.]", "").try_cast("double")


def grams(text: Column) -> Column:
    """A weight in whole grams, cut off; a weight that names no unit is in grams."""
    factor = F.coalesce(*[F.when(F.lower(text).rlike(unit), F.lit(x)) for unit, x in UNITS], F.lit(1.0))
    return F.floor(number(text) * factor).cast("long")


def image_links(text: Column, most: int = 10) -> Column:
    parts = F.transform(F.split(text, r"[|,;\n]+"), lambda x: F.trim(x))
    return F.slice(F.filter(parts, lambda x: x.rlike("(?i)^https?://")), 1, most)


def named(export: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The mapped columns of ``export`` under their targets' names; others stay out."""
    return export.select([F.trim(F.col(f"`{column}`").cast("string")).alias(target) for target, column in mapping.items()])

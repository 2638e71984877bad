"""Values cut out of the text of scripts, which is no JSON as a whole, by brackets that match outside of quoted text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from wareloom.sources.page_tree import Page

_SIGN = re.compile(r"\"(?:[^\"\\]|\\.)*(?:\"|\Z)|'(?:[^'\\\n]|\\.)*'|[\[\]{}]", re.DOTALL)
_CLOSES = {"[": "]", "{": "}"}
GALLERY = ArrayType(StructType([StructField("url", StringType()), StructField("rule", StringType()), StructField("width", IntegerType()), StructField("height", IntegerType())]))
#: Where a marketplace's page has its main picture, its gallery's data, the keys of a picture's link there,
#: best first, and the elements around its thumbnails with the attributes of their links.
MAIN, DATA, LINK_KEYS = "landingImage", ("colorImages", "initial"), ("hiRes", "large", "mainUrl")
THUMBNAILS, LINK_ATTRIBUTES = ("imgTagWrapperId", "altImages", "main-image-container"), ("data-old-hires", "src", "data-src")


def cut(text: str, at: int) -> str | None:
    """The array or object that begins at ``at``; None if its brackets don't match or none begins there."""
    if text[at : at + 1] not in _CLOSES:
        return None
    open_: list[str] = []
    for m in _SIGN.finditer(text, at):
        sign = m[0]
        if sign in _CLOSES:
            open_.append(_CLOSES[sign])
        elif sign[0] not in "\"'":
            if open_.pop() != sign:
                return None
            if not open_:
                return text[at : m.end()]
    return None


def named(text: str, *names: str) -> Iterator[str]:
    """The arrays and objects that a script gives to ``names``, each name the first key of the one before's object: what
    stands behind ``a: {b:`` for a and b. Names may be quoted, and a variable has an equals sign."""
    key = lambda n: rf"(?<![\w$])['\"]?{re.escape(n)}['\"]?\s*[:=]\s*"
    for m in re.finditer(r"\{\s*".join(map(key, names)) + r"(?=[\[{])", text):
        if (found := cut(text, m.end())) is not None:
            yield found


def _parsed(text: str | None):
    try:
        return json.loads(text or "")
    except (ValueError, RecursionError):
        return None


def _size(value) -> tuple[int | None, int | None]:
    fine = isinstance(value, list) and len(value) == 2 and all(isinstance(x, int) and not isinstance(x, bool) and 0 <= x < 1 << 31 for x in value)
    return tuple(value) if fine else (None, None)


def gallery(html: str) -> list[dict]:
    """Pictures of a marketplace's page, by four rules in this order: the sizes of its main picture, largest area first;
    the main picture's original; its gallery's data in their order; thumbnails. A picture may come more than once."""
    page, out = Page(html), []

    def add(url, rule: str, size: tuple[int | None, int | None] = (None, None)) -> None:
        if isinstance(url, str) and url:
            out.append({"url": url, "rule": rule, "width": size[0], "height": size[1]})

    main = [page.given[e] for e in page.at(f"#{MAIN}")]
    sizes = next((s for g in main if isinstance(s := _parsed(g.get("data-a-dynamic-image")), dict)), {})
    area = lambda size: -(size[0] or 0) * (size[1] or 0)
    for url, size in sorted(((u, _size(v)) for u, v in sizes.items()), key=lambda x: area(x[1])):
        add(url, "sizes", size)
    add(next((g["data-old-hires"] for g in main if g.get("data-old-hires")), None), "original")
    entries = next((x for text in named(html, *DATA) if isinstance(x := _parsed(text), list)), [])
    for entry in entries:
        if isinstance(entry, dict):
            add(next((entry[k] for k in LINK_KEYS if isinstance(entry.get(k), str) and entry[k]), None), "data")
    for place in THUMBNAILS:
        for e in page.at(f"#{place}"):
            for image in page.at("img"):
                if e < image < page.last[e]:
                    add(next((page.given[image][k] for k in LINK_ATTRIBUTES if page.given[image].get(k)), None), "thumbnail")
    return out


@F.pandas_udf(GALLERY)
def gallery_of(html: pd.Series) -> pd.Series:
    """``gallery`` of each page; null for a null one."""
    return html.map(lambda h: None if h is None else gallery(h), na_action=None)

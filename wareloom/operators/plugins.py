"""Shops that the general reading gets wrong: rules of their own, the first that fits a page going on top of its cells."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom.functions import texts, values
from wareloom.operators.records import CELLS, LOCKED, kind_of
from wareloom.sources.scripts import gallery_of

_CELL = "struct<value:{},confidence:string,source:string,note:string>"


@dataclass(frozen=True)
class Plugin:
    """``matches`` tells from url and html whether a page is meant; ``cells`` gives (value, confidence) by cell, ``pictures``
    an array of links that come before the page's own."""

    name: str
    matches: Callable[[Column, Column], Column]
    cells: dict[str, Callable[[Column], tuple[Column, str]]] = field(default_factory=dict)
    pictures: Callable[[Column], Column] | None = None

    def __post_init__(self):
        wrong = [c for c in self.cells if c not in CELLS]
        if wrong:
            raise ValueError(f"{self.name} fills {', '.join(wrong)}" + (f"; nothing may fill {LOCKED}" if LOCKED in wrong else ""))


def apply(records: DataFrame, plugins: list[Plugin], url: str = "url", html: str = "html") -> DataFrame:
    """``records`` (cells, image_candidates, url, html) with plugin, the name of the first plug-in that matches, and its cells
    and pictures on top, their source the plug-in; a value it doesn't find leaves what is there."""
    which = F.coalesce(*[F.when(F.coalesce(p.matches(F.col(url), F.col(html)), F.lit(False)), p.name) for p in plugins], F.lit(None).cast("string"))
    out = records.withColumn("plugin", which)
    cells = {}
    for name in CELLS:
        if name in out.columns:
            new = F.col(name)
            for p in plugins:
                if name in p.cells:
                    value, sure = p.cells[name](F.col(html))
                    made = F.struct(value.alias("value"), F.lit(sure).alias("confidence"), F.lit("plugin").alias("source"), F.lit(p.name).alias("note"))
                    new = F.when((F.col("plugin") == p.name) & value.isNotNull(), made.cast(_CELL.format(kind_of(name)))).otherwise(new)
            cells[name] = new
    more = F.array().cast("array<string>")
    for p in plugins:
        if p.pictures is not None:
            more = F.when(F.col("plugin") == p.name, F.coalesce(p.pictures(F.when(F.col("plugin") == p.name, F.col(html))), F.array().cast("array<string>"))).otherwise(more)
    return out.withColumns({**cells, "image_candidates": F.array_union(more, "image_candidates")})


def _shop_variants(html: Column) -> Column:
    """The variants in a shop system's ``var meta = {...};``."""
    meta = F.regexp_extract(html, r"(?s)var meta = (\{.*?\});", 1)
    kind = "struct<product:struct<vendor:string,type:string,variants:array<struct<price:bigint,public_title:string>>>>"
    return F.from_json(meta, kind)["product"]["variants"]


def lowest_price(html: Column) -> Column:
    """struct<price, prices>: the lowest price of a shop page's variants, which it states in hundredths, and how many differ."""
    known = F.filter(F.transform(_shop_variants(html), lambda v: v["price"]), lambda p: p > 0)
    return F.when(F.size(known) > 0, F.struct((F.array_min(known) / 100).alias("price"), F.size(F.array_distinct(known)).alias("prices")))


SHOP_SYSTEM = Plugin(
    "shop-system",
    lambda url, html: F.contains(html, F.lit("var meta = {")) & F.contains(html, F.lit("/cdn/shop/")),
    {"sizes": lambda html: (F.nullif(F.array_join(texts.clean_sizes(F.transform(_shop_variants(html), lambda v: F.coalesce(v["public_title"], F.lit("")))), ","), F.lit("")), "high")},
)


#: Parts of links of a marketplace's own pictures, in lower case.
FURNITURE = ("/captcha/", "transparent-pixel", "grey-pixel", "/sprites/", "sprite-", "-sprite", "/g/01/", "player-thumb", "play-icon")


def ranked_gallery(pictures: Column) -> Column:
    """Links of a gallery's pictures (``scripts.gallery_of``) that show products: of each its original, then itself, each
    link once, in the pictures' order."""
    media = lambda u: u.rlike(texts.MEDIA_HOSTS) & ~reduce(lambda a, b: a | b, [F.contains(F.lower(u), F.lit(w)) for w in FURNITURE])
    links = F.transform(pictures, lambda p: F.regexp_replace(p["url"], "^//", "https://"))
    both = F.transform(F.filter(links, media), lambda u: F.array(texts.without_size_modifier(u), u))
    return F.array_distinct(F.flatten(both))


def _gallery(html: Column) -> Column:
    return ranked_gallery(gallery_of(html))


def _buy_box_price(html: Column) -> Column:
    return values.amount(F.regexp_extract(html, r'(?s)id="corePrice[^"]*".*?class="a-offscreen">([^<]+)<', 1))


def _marketplace_stock(html: Column) -> Column:
    said = F.lower(F.regexp_extract(html, r'(?s)id="availability".*?<span[^>]*>\s*([^<]+?)\s*<', 1))
    return F.when(F.contains(said, F.lit("in stock")) | F.contains(said, F.lit("usually dispatched")), "in_stock")


MARKETPLACE = Plugin(
    "marketplace",
    lambda url, html: url.rlike(r"(?i)^https?://(?:[^/?#]*\.)?amazon\.[a-z]{2,3}(?:\.[a-z]{2})?/"),
    {
        "title": lambda html: (F.nullif(texts.collapsed(F.regexp_extract(html, r'(?s)id="productTitle"[^>]*>([^<]+)<', 1)), F.lit("")), "high"),
        "availability": lambda html: (_marketplace_stock(html), "high"),
        "price_inr": lambda html: (F.bround(_buy_box_price(html), 0).cast("int"), "medium"),
    },
    _gallery,
)

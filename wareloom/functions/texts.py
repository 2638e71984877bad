"""Titles, descriptions, sizes, links of pictures and other texts as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wareloom.functions.urls import path_and_query
from wareloom.functions.values import let

#: What parts a page title's product from its shop, and the words of a shop's part at most.
SUFFIX_SEPARATORS, SUFFIX_WORDS = (" | ", " — ", " – ", " - ", " :: ", " » "), 6
#: What parts a stuffed title, and the words of a product's name at least.
TAIL_SEPARATORS, NAME_WORDS = (" | ", " - ", " – ", " — "), 3
#: Ends of a title that aren't part of a name.
MARKETING = (
    "free shipping", "free delivery", "best price", "lowest price", "buy online", "shop online", "online shopping",
    "cash on delivery", "with warranty", "official store", "authorized dealer", "authorised dealer",
)
TITLE_CHARS, DESCRIPTION_CHARS, DESCRIPTION_LEAST = 200, 5_000, 40
#: A line of a description with one of these goes.
BOILERPLATE = (
    "add to cart", "add to bag", "buy now", "buy it now", "free shipping", "free delivery", "size guide", "size chart", "share this",
    "share on", "return policy", "returns & exchanges", "cash on delivery", "customer reviews", "write a review", "you may also like",
    "related products", "subscribe", "newsletter", "cookie", "javascript", "sold out", "quantity", "sku:",
)
#: Texts of a size control that aren't sizes, and a size's characters at most.
SIZE_NOISE, SIZE_CHARS = ("select size", "choose size", "size", "select", "choose an option", "pick a size", "-", "--", "please select"), 24
#: Words of a shop's paths that every product shares; parts of links of pictures that aren't products.
ROUTING = ("products", "product", "item", "items", "shop", "buy", "dp", "collections")
REJECTED = ("thumb", "_50x50", "sm_", "icon", "sprite", "placeholder", "blank", "1x1", "logo", "payment", "badge")
#: Hosts of a marketplace's pictures.
MEDIA_HOSTS = r"(?i)^https?://(?:[^/?#]*\.)?(?:media-amazon\.com|ssl-images-amazon\.com|images-amazon\.com)(?:[/:?#]|$)"

_EDGES = r"[ ,;\-]+$"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility forms folded, which no built-in function does."""
    return texts.str.normalize("NFKC")


def collapsed(text: Column) -> Column:
    """Zero-width characters gone, white space as single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[​﻿]", ""), r"(?U)[\s\x1c-\x1f]+", " "))


def normalised(text: Column) -> Column:
    return collapsed(nfkc(text))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def title_case(text: Column) -> Column:
    """The first letter after anything that is no letter in upper case, all others in lower case."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1_000_000)))), "")


def shortened(text: Column, most: int) -> Column:
    """``text`` cut at a blank to at most ``most`` characters, without punctuation that parts words at its end."""

    def whole(cut: Column) -> Column:
        words = F.when(F.contains(cut, F.lit(" ")), F.nullif(F.regexp_replace(cut, r"[ ][^ ]*$", ""), F.lit("")))
        return F.regexp_replace(F.coalesce(words, cut), _EDGES, "")

    return let(text, lambda t: F.when(F.length(t) > most, let(F.substring(t, 1, most), whole)).otherwise(t))


def shouty(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return (letters >= 8) & (F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) > letters * 0.6)


def clean_title(text: Column, most: int = TITLE_CHARS) -> Column:
    """A title of normalised text: shouting in title case, and not too long."""
    return shortened(let(text, lambda t: F.when(shouty(t), title_case(t)).otherwise(t)), most)


def _parts(title: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(title, re.escape(separator)), lambda s: F.trim(s)), lambda s: s != "")


def without_suffix(title: Column) -> Column:
    """A page title without what its shop put behind the product: short parts at the end, but for the first."""

    def less(title: Column, separator: str) -> Column:
        def kept(parts: Column) -> Column:
            # the last part, after the first, that is too long to be a shop's
            last = F.array_max(F.transform(parts, lambda p, i: F.when((i == 0) | (F.size(_words(p)) > SUFFIX_WORDS), i + 1).otherwise(0)))
            return F.nullif(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.coalesce(last, F.lit(1)), F.lit(1))), separator), F.lit(""))

        there = F.contains(title, F.lit(separator))
        return F.when(there, F.coalesce(let(_parts(title, separator), kept), title)).otherwise(title)

    for separator in SUFFIX_SEPARATORS:
        title = let(title, _with(less, separator))
    return F.trim(title)


def _with(use, more):
    """``use`` of one column; a function of two parameters would be given places, too."""
    return lambda column: use(column, more)


def name_and_tail(title: Column) -> Column:
    """struct<name, tail>: of a title of three or more parts the first, or two if that is a bare brand, and the others."""

    def cut(parts: Column) -> Column:
        one, two = F.get(parts, F.lit(0)), F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
        rest = lambda k: F.slice(parts, F.lit(k + 1), F.greatest(F.size(parts) - k, F.lit(0)))
        both = lambda name, k: F.struct(name.alias("name"), rest(k).alias("tail"))
        enough = F.when(F.size(_words(one)) >= NAME_WORDS, both(one, 1)).when(F.size(_words(two)) >= NAME_WORDS, both(two, 2))
        return F.when(F.size(parts) >= 3, enough)

    def any_of(title: Column) -> Column:
        whole = F.struct(title.alias("name"), F.array().cast("array<string>").alias("tail"))
        return F.coalesce(*[let(_parts(title, s), cut) for s in TAIL_SEPARATORS], whole)

    return let(title, any_of)


def without_marketing(title: Column) -> Column:
    def less(title: Column) -> Column:
        out = F.when(F.lit(False), title)
        for phrase in MARKETING:
            rest = F.regexp_replace(F.substring(title, F.lit(1), F.length(title) - len(phrase)), r"[ ,;\-|–—]+$", "")
            out = out.when(F.endswith(F.lower(title), F.lit(phrase)), rest)
        return out.otherwise(title)

    return let(title, less)


def tidied(title: Column) -> Column:
    """The name to list: the title's name without marketing; the title itself where nothing would be left."""
    return let(title, lambda t: F.coalesce(F.nullif(clean_title(without_marketing(name_and_tail(t)["name"])), F.lit("")), t))


def clean_description(text: Column, most: int = DESCRIPTION_CHARS) -> Column:
    """Control characters gone, lines that are a shop's furniture dropped, no more than one empty line in a row, cut."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"\r\n?", "\n")
    furniture = "|".join(map(re.escape, BOILERPLATE))
    lines = F.filter(F.transform(F.split(plain, "\n", -1), collapsed), lambda x: ~F.lower(x).rlike(furniture))
    whole = F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    return let(whole, lambda w: F.when(F.length(w) > most, F.concat(shortened(w, most), F.lit("…"))).otherwise(w))


def clean_sizes(sizes: Column) -> Column:
    """An array of size labels in their order: prompts and long texts gone, letter sizes in upper case, each once."""
    kept = F.filter(F.transform(sizes, collapsed), lambda x: (x != "") & ~F.lower(x).isin(*SIZE_NOISE) & (F.length(x) <= SIZE_CHARS))
    named = F.transform(kept, lambda x: F.when(x.rlike("(?i)^(?:xs|s|m|l|xl|xxl|xxxl|[2-5]xl)$"), F.upper(x)).otherwise(x))
    return let(named, lambda all_: F.filter(all_, lambda x, i: F.array_position(F.transform(all_, F.lower), F.lower(x)) == i + 1))


def full_size(url: Column) -> Column:
    """The original behind a resized picture, only where a shop system's pattern is known; else null."""
    shop = url.rlike(r"(?i)shopify|/cdn/shop/|/s/files/")
    one = F.regexp_replace(
        url, r"(?i)_(?:\d{2,5}x\d{0,5}|x\d{2,5}|pico|icon|thumb|small|compact|medium|large|grande|master)(?:@[23]x)?(?=\.(?:jpe?g|png|webp|avif)\b)", ""
    )
    two = F.regexp_replace(url, r"(?i)-\d{2,5}x\d{2,5}(?=\.(?:jpe?g|png|webp|avif)\b)", "")
    return F.when(shop & (one != url), one).when(url.rlike("(?i)/wp-content/uploads/") & (two != url), two)


def slug_tokens(page_url: Column) -> Column:
    """The words of three letters or digits and more in a page's path, each once, but for the shop's own."""
    path = F.lower(F.regexp_extract(page_url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1))
    return F.array_except(F.array_distinct(F.regexp_extract_all(path, F.lit("([a-z0-9]{3,})"), 1)), F.array(*map(F.lit, ROUTING)))


def affinity(url: Column, tokens: Column) -> Column:
    """How many of ``tokens`` stand in a picture's file name."""
    name = F.substring_index(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1)), "/", -1)
    return F.size(F.filter(tokens, lambda t: F.contains(name, t)))


def rejected(url: Column) -> Column:
    """Whether path or query of a picture's link say that it shows no product."""
    return F.lower(path_and_query(url)).rlike("|".join(map(re.escape, REJECTED)))


def without_size_modifier(url: Column) -> Column:
    """A marketplace's picture in its own size."""
    return F.when(url.rlike(MEDIA_HOSTS), F.regexp_replace(url, r"\._[A-Za-z0-9_,]+_(?=\.[A-Za-z]{3,4}(?:[?#]|$))", "")).otherwise(url)


def absolute(base: Column, ref: Column) -> Column:
    """``ref`` as a whole http or https link, seen from the page ``base``; null for what can't be one.

    Dots in paths are resolved; data, script, blob and about links and bare fragments aren't links to anything.
    """
    r = F.trim(F.replace(F.replace(ref, F.lit("&amp;"), F.lit("&")), F.lit("&#38;"), F.lit("&")))
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    whole = (
        F.when(r.rlike("(?i)^https?://"), r)
        .when(r.startswith("//"), F.concat(scheme, F.lit(":"), r))
        .when(r.startswith("/"), F.concat(site, r))
        .when(r.startswith("?"), F.concat(site, F.when(path == "", "/").otherwise(path), r))
        .otherwise(F.concat(site, folder, r))
    )
    return F.when((r != "") & ~r.rlike(r"(?i)^(?:#|(?!https?:)[a-z][a-z0-9+.\-]*:)") & whole.rlike(r"(?i)^https?://[^/?#]"), _without_dots(whole))


def _without_dots(url: Column) -> Column:
    """A link with the dot segments of its path resolved."""
    site, rest = (F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)([^?#]*)(.*)$", k) for k in (1, 3))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    none = F.array().cast("array<string>")
    steps = F.aggregate(
        F.split(path, "/", -1), none,
        lambda out, s: F.when(s == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(1)))).when(s == ".", out).otherwise(F.concat(out, F.array(s))),
    )
    folder = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.when(path.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), F.concat(site, F.array_join(steps, "/"), folder, rest)).otherwise(url)


def data_uri(uri: Column) -> Column:
    """The bytes of a data: link, by base64 or by percent encoding; null for anything else."""
    body = F.regexp_extract(uri, r"(?s)^data:[^,]*,(.*)$", 1)
    text = F.coalesce(F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))), body)
    return F.when(uri.rlike("(?i)^data:[^,]*;base64,"), F.try_to_binary(body, F.lit("base64"))).when(uri.rlike("(?i)^data:[^,]*,"), F.encode(text, "utf-8"))


def redacted(text: Column) -> Column:
    """``text`` with the values of links' keys, tokens, signatures and secrets covered."""
    return F.regexp_replace(text, r"(?i)([?&](?:api[_-]?key|key|token|sig|signature|access_token|client_secret)=)[^&\s]+", "$1***REDACTED***")


def seller_note(*parts: Column) -> Column:
    """What is known beside the cells, in one line; what is null or empty stays out."""
    return F.concat_ws(" · ", *[F.nullif(p, F.lit("")) for p in parts])


def json_in(reply: Column) -> Column:
    """The JSON object in a reply that may stand in a code fence or between words; null without one that can be read."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(F.nullif(body, F.lit(""))).isNotNull(), body)

"""Link identity as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that tell where a click came from.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid", "msclkid",
    "mc_cid", "mc_eid", "igshid", "_ga", "_gl", "ref", "referrer", "source", "spm", "srsltid",
]
#: Parameters that a picture's link doesn't need.
IMAGE_TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "_ga"]
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))


def host(url: Column) -> Column:
    """Lower-case host without user, port."""
    authority = F.regexp_replace(F.regexp_extract(url, _AUTHORITY, 1), "^.*@", "")
    return F.lower(F.regexp_replace(authority, r":\d*$", ""))


def path_and_query(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), query))


def _encoded(part: Column, comma: bool) -> Column:
    """A query part decoded and encoded again, as form encoding does it; ``comma`` stays plain if asked."""
    plain = F.coalesce(F.try_url_decode(part), part)
    out = F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.replace(out, F.lit("%2C"), F.lit(",")) if comma else out


def _pairs(query: Column, keep, comma: bool) -> Column:
    """``query`` with the pairs whose lower-case name ``keep`` accepts, in order, encoded again."""
    name = lambda p: F.substring_index(p, "=", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & keep(F.lower(F.coalesce(F.try_url_decode(name(p)), name(p)))))
    both = lambda p: F.concat(
        _encoded(name(p), comma), F.lit("="),
        _encoded(F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise(""), comma),
    )
    return F.array_join(F.transform(kept, both), "&")


def canonical(url: Column) -> Column:
    """One identity per product page: host in lower case without user, default port and a spare www, no fragment and
    no tracking parameters; shops whose product id is known keep only that."""
    u = F.trim(url)
    s, h = scheme(u), host(u)
    port = F.regexp_extract(F.regexp_extract(u, _AUTHORITY, 1), r":(\d+)$", 1)
    short = F.when(h.startswith("www.") & (F.length(h) - F.length(F.replace(h, F.lit("."), F.lit(""))) > 1), F.substring(h, F.lit(5), F.length(h))).otherwise(h)
    usual = ((s == "http") & (port == "80")) | ((s == "https") & (port == "443")) | (port == "")
    site = F.concat(s, F.lit("://"), short, F.when(usual, "").otherwise(F.concat(F.lit(":"), port)))
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    clean = _pairs(query, lambda n: ~n.isin(TRACKING), True)
    asin = F.regexp_extract(path, r"/(?:dp|gp/product|gp/aw/d)/([A-Za-z0-9]{10})", 1)
    listing = F.regexp_extract(path, r"/listing/(\d+)", 1)
    pid = _pairs(clean, lambda n: n == "pid", False)
    with_query = lambda p, q: F.when(q == "", F.concat(site, p)).otherwise(F.concat(site, p, F.lit("?"), q))
    return (
        F.when(short.rlike(r"^(?:.+\.)?amazon\.(?:[a-z]{2,3})(?:\.[a-z]{2})?$") & (asin != ""), F.concat(site, F.lit("/dp/"), F.upper(asin)))
        .when(short.rlike(r"^(?:.+\.)?flipkart\.com$") & path.rlike("/p/itm"), with_query(path, pid))
        .when(short.rlike(r"^(?:.+\.)?etsy\.com$") & (listing != ""), F.concat(site, F.lit("/listing/"), listing))
        .otherwise(with_query(path, clean))
    )


def without_params(url: Column, names: list[str]) -> Column:
    """``url`` without the parameters called ``names`` (in any case), the others in their order."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = _pairs(query, lambda n: ~n.isin(*[x.lower() for x in names]), True)
    start, fragment = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    return F.when(query == "", url).otherwise(F.concat(start, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)), fragment))


def _base_letters() -> tuple[str, str]:
    """Small Latin letters with marks, and what each is without them."""
    marked = [chr(c) for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in block if chr(c).islower()]
    base = {c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in marked}
    plain = {c: b for c, b in base.items() if len(b) == 1 and b.isascii()}
    return "".join(plain), "".join(plain.values())


#: Letters that are written as two, or have no mark to take away.
_SPELLED = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ħ": "h", "ŧ": "t", "ŋ": "n", "ĳ": "ij"}


def unmarked(text: Column) -> Column:
    """Text in lower case with Latin letters as their base letters and no marks of their own; other scripts' letters stay."""
    out = F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}+", ""), *_base_letters())
    for letter, plain in _SPELLED.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def row_key(canonical_url: Column) -> Column:
    """A readable key: host and path as a slug of up to 60 characters, Latin letters without marks, and 8 digits of the
    link's SHA-1; these alone if nothing readable is left."""
    slug = F.trim(F.regexp_replace(unmarked(F.concat(host(canonical_url), F.regexp_extract(canonical_url, r"://[^/?#]*([^?#]*)", 1))), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.when(F.length(slug) <= 60, slug).otherwise(F.regexp_replace(F.substring(slug, 1, 61), "-[^-]*$", ""))
    return F.concat_ws("-", F.nullif(F.substring(cut, 1, 60), F.lit("")), F.substring(F.sha1(canonical_url), 1, 8))


def photo_identity(url: Column) -> Column:
    """The photograph behind an image link: its file name without the size that shops put into it."""
    name = F.lower(F.substring_index(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)", 1), "/", -1))
    for size in (r"\._[A-Za-z0-9_,]+_(?=\.[a-z]{3,4}$)", r"_\d{2,4}x\d{0,4}(?=\.[a-z]{3,4}$)", r"-\d{2,4}x\d{2,4}(?=\.[a-z]{3,4}$)"):
        name = F.regexp_replace(name, size, "")
    return name


def declared_width(url: Column) -> Column:
    """The width that an image link names, or null."""
    target = path_and_query(url)
    size = F.regexp_extract(target, r"(?<!\d)(\d{2,5})\s*[xX]\s*(\d{2,5})(?!\d)", 1)
    param = F.regexp_extract(target, r"(?:^|[?&_/\-])(?:w|width|sw)[=_\-](\d{2,5})(?!\d)", 1)
    return F.when(size != "", size).when(param != "", param).cast("int")

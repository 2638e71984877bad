"""Checks of links, pictures and pages: the predicate chain and its steps, page shapes, robots rules, addresses, retries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

#: The predicates in the order in which they are tried, their numbers and what fails them.
PREDICATES = ((1, "syntax"), (8, "not signed or expiring"), (9, "host reputation"), (2, "reachable"), (3, "redirect chain"), (4, "content-type"), (5, "size floor"), (6, "decodable, dimensions"), (7, "hotlink test"))
FAILED_BY = {
    "bad_syntax": 1, "signed_or_expiring_url": 8, "host_known_to_block": 9, "unreachable": 2, "too_many_redirects": 3, "redirect_to_interstitial": 3,
    "redirect_to_html": 3, "wrong_content_type": 4, "too_small": 5, "not_decodable": 6, "unusably_small": 6, "below_min_dimensions": 6, "hotlink_blocked": 7,
}
#: Parts of a link that won't work tomorrow; those with capitals are looked for as they are.
SIGNED = ("expires", "Expires", "X-Amz-Expires", "X-Amz-Signature", "Signature", "Key-Pair-Id", "token", "sig=", "st=", "se=", "/tmp/", "/session/", "/preview/")
MOST_HOPS, LEAST_BYTES, POSSIBLE_BYTES, HARD_MINIMUM, LISTABLE = 5, 10_240, 26, 400, 800
INTERSTITIAL = r"/(?:consent|challenge|captcha|interstitial|login|signin)"

#: What a page says that isn't about a product.
CAPTCHA = (
    "/errors/validatecaptcha", "enter the characters you see below", "type the characters you see in this image", "robot check", "cf-browser-verification",
    "cf_chl_opt", "checking your browser before accessing", "please verify you are a human", "captcha-delivery.com", "px-captcha",
    "unusual traffic from your computer network", "to discuss automated access to amazon data please contact", "why have i been blocked", "attention required! | cloudflare",
)
LOGIN = ("sign in to continue", "please log in to view", "you must be logged in", "log in to see prices", "members only", "create an account to view")
LOGIN_PATHS = ("/ap/signin", "/login", "/signin", "/sign-in", "/account/login")
UNAVAILABLE = (
    "currently unavailable", "no longer available", "this item is not available", "product not found", "page not found", "sorry, we couldn't find that page",
    "the page you requested does not exist", "this listing has been removed", "out of print",
)
CART = ("add to cart", "add to bag", "add to basket", "buy now", "add to trolley", "proceed to checkout")
PRICE = r"(?i)(?:₹|rs\.?\s|inr\s|\$|€|£)\s?\d[\d,]*(?:\.\d{1,2})?"


def picture_fault(bad_hosts: list[str] | None = None) -> Column:
    """The first reason against a picture, null for none; later predicates aren't asked.

    Columns: url, host, status, hops, final_path, content_type, content_length, decodable, width, height, hotlink_ok. Nulls
    of what wasn't learned count as nothing against it, but for a content type.
    """
    u, lower = F.col("url"), F.lower("url")
    signed = F.lit(False)
    for token in SIGNED:
        signed = signed | F.contains(lower if token == token.lower() else u, F.lit(token))
    kind = F.lower(F.trim(F.split(F.coalesce("content_type", F.lit("")), ";")[0]))
    hopped = F.coalesce(F.col("hops"), F.lit(0)) > 0
    small = F.col("content_length").between(POSSIBLE_BYTES, LEAST_BYTES - 1)
    return (
        F.when(~(u.rlike(r"^https?://[^/?#\s]+") | u.rlike("^data:image/")), "bad_syntax")
        .when(signed, "signed_or_expiring_url")
        .when(F.col("host").isin(*(bad_hosts or [""])), "host_known_to_block")
        .when(F.coalesce(F.col("status"), F.lit(0)) >= 400, "unreachable")
        .when(F.col("hops") > MOST_HOPS, "too_many_redirects")
        .when(hopped & F.lower("final_path").rlike(INTERSTITIAL), "redirect_to_interstitial")
        .when(hopped & F.contains(kind, F.lit("text/html")), "redirect_to_html")
        .when(~F.startswith(kind, F.lit("image/")), "wrong_content_type")
        .when(small, "too_small")
        .when(~F.coalesce(F.col("decodable"), F.lit(True)), "not_decodable")
        .when((F.col("width") < HARD_MINIMUM) | (F.col("height") < HARD_MINIMUM), "unusably_small")
        .when((F.col("width") < LISTABLE) | (F.col("height") < LISTABLE), "below_min_dimensions")
        .when(~F.coalesce(F.col("hotlink_ok"), F.lit(True)), "hotlink_blocked")
    )


def steps(judged: DataFrame, keys: list[str], reason: str = "reason", hotlink_test: bool = True) -> DataFrame:
    """(keys, place, predicate, name, outcome): each of the nine predicates in its order: ok, fail, not reached or skipped."""
    number = F.create_map(*[F.lit(x) for p in FAILED_BY.items() for x in p])[F.col(reason)]
    order = F.array(*[F.struct(F.lit(n).alias("predicate"), F.lit(name).alias("name")) for n, name in PREDICATES])
    failed_at = F.array_position(F.array(*[F.lit(n) for n, _ in PREDICATES]), number) - 1
    rows = judged.select(*keys, F.coalesce(failed_at, F.lit(len(PREDICATES))).alias("_at"), F.posexplode(order).alias("place", "p"))
    off = (F.col("p.predicate") == 7) & F.lit(not hotlink_test)
    outcome = F.when(off, "skipped").when(F.col("place") > F.col("_at"), "not reached").when(F.col("place") == F.col("_at"), "fail").otherwise("ok")
    return rows.select(*keys, "place", "p.predicate", "p.name", outcome.alias("outcome"))


def _said(text: Column, marks: tuple[str, ...]) -> Column:
    return F.filter(F.array(*map(F.lit, marks)), lambda m: F.contains(text, m))


def page_shape(html: Column, url: Column, buy_box: Column, has_product: Column) -> Column:
    """struct<verdict, product, evidence>: bot_challenge, sign_in_required, not_a_product_page or null for a page that can be
    read; ``buy_box`` is the text around the purchase control, or of the whole page where none is known."""
    page, link, box = F.lower(F.coalesce(html, F.lit(""))), F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(buy_box, F.lit("")))
    captcha, login, path, gone = _said(page, CAPTCHA), _said(page, LOGIN), _said(link, LOGIN_PATHS), _said(box, UNAVAILABLE)
    elsewhere = F.array_except(_said(page, UNAVAILABLE), gone)
    typed = page.rlike(r"<meta[^>]+property=[\"']og:type[\"'][^>]+content=[\"'][^\"']*product")
    product = F.coalesce(has_product, F.lit(False)) | typed | (F.size(_said(page, CART)) > 0) | page.rlike(PRICE)
    some = lambda a: F.size(a) > 0
    verdict = F.when(some(captcha), "bot_challenge").when((some(login) | some(path)) & ~product, "sign_in_required").when(some(gone) & ~product, "not_a_product_page")
    named = lambda what, marks: F.transform(marks, lambda m: F.concat(F.lit(f"{what}: "), m))
    seen = F.concat(named("body", captcha), named("body", login), named("final url", path), F.when(some(gone), named("buy-box", gone)).otherwise(named("elsewhere", elsewhere)))
    return F.struct(verdict.alias("verdict"), product.alias("product"), seen.alias("evidence"))


@F.pandas_udf(BooleanType())
def robots_allow(rules: pd.Series, status: pd.Series, url: pd.Series) -> pd.Series:
    """Whether a site's rules let ``url`` be read: 401 and 403 forbid all, any other error and no rules nothing."""
    from urllib.robotparser import RobotFileParser

    parsers: dict[str, RobotFileParser] = {}

    def allowed(text: str | None, code: float | None, link: str | None) -> bool:
        if code in (401, 403):
            return False
        if not text or (code is not None and code >= 400) or not link:
            return True
        if text not in parsers:
            parsers[text] = RobotFileParser()
            parsers[text].parse(text.splitlines())
        return parsers[text].can_fetch("*", link)

    clean = lambda s: [None if pd.isna(x) else x for x in s]
    return pd.Series([allowed(*x) for x in zip(clean(rules), clean(status), clean(url), strict=True)], dtype="bool")


@F.pandas_udf(StringType())
def address_fault(url: pd.Series) -> pd.Series:
    """Why a link must not be asked for: no_http, no_host, or the kind of private address it names; null if it may be.

    Only addresses written out are looked at; names are resolved by whoever fetches. IPv4 inside IPv6 counts as itself.
    """
    import ipaddress
    from urllib.parse import urlsplit

    def fault(link: str | None) -> str | None:
        try:
            parts = urlsplit(link or "")
            host = parts.hostname
        except ValueError:
            return "no_host"
        if parts.scheme not in ("http", "https"):
            return "no_http"
        if not host:
            return "no_host"
        if host in ("localhost", "metadata.google.internal") or host.endswith(".localhost"):
            return "loopback"
        try:
            at = ipaddress.ip_address(host)
        except ValueError:
            return None
        if at.version == 6:
            nat = at in ipaddress.ip_network("64:ff9b::/96")
            at = at.ipv4_mapped or (ipaddress.ip_address(int(at) & 0xFFFFFFFF) if nat else at)
        if str(at) == "169.254.169.254":
            return "metadata"
        kinds = ("is_loopback", "is_link_local", "is_multicast", "is_unspecified", "is_reserved", "is_private")
        return next((k[3:] for k in kinds if getattr(at, k)), None)

    return url.map(fault, na_action=None)


def escalates(attempts: Column) -> Column:
    """Whether a browser is worth a try after ``attempts`` (array<struct<kind, status>>): a transport failure is, a final
    answer never, a refusal (403, 429) once."""
    final = F.exists(attempts, lambda a: a["kind"].isin("dns_error", "not_html", "robots"))
    refusals = F.size(F.filter(attempts, lambda a: a["status"].isin(403, 429)))
    transport = F.exists(attempts, lambda a: a["kind"].isin("transport_reset", "connection_refused", "tls_error", "timeout"))
    return ~final & (transport | (refusals == 1))


def backoff(attempt: Column, base: float = 0.75) -> Column:
    """Seconds to wait before the attempt after ``attempt``."""
    return base * F.pow(F.lit(2.0), attempt - 1)

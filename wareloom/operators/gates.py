"""Checks of the last stage before a row is written, and the words that failures are told in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wareloom.functions import dims

# A fetcher's words and the reasons they are told as.
FETCH_REASONS = {
    "transport_reset": "timeout_read", "timeout_read": "timeout_read", "timeout_connect": "timeout_connect",
    "connection_refused": "timeout_connect", "tls_error": "timeout_connect", "dns_error": "dns_failure", "http_401": "blocked_403",
    "http_403": "blocked_403", "http_429": "blocked_429", "not_html": "not_a_product_page",
    "too_many_redirects": "not_a_product_page", "blocked_address": "not_a_product_page",
}


def fetch_reason(word: Column) -> Column:
    """The reason for a fetcher's word; a word that isn't known, or null, is a read that never ended."""
    known = F.create_map(*[F.lit(x) for pair in FETCH_REASONS.items() for x in pair])
    rest = F.when(word.startswith("http_5"), "http_error_5xx").when(word.startswith("http_4"), "not_a_product_page")
    return F.coalesce(known[word], rest, F.lit("timeout_read"))


def fetch_status(word: Column) -> Column:
    """The HTTP status in a fetcher's word, null if there is none."""
    return F.regexp_extract(word, r"^http_(\d+)$", 1).try_cast("int")


def slug_fault(category: Column, shelf: Column) -> Column:
    """What is wrong with a row's slugs, null if nothing is; an empty slug counts as none."""
    category, shelf = F.nullif(category, F.lit("")), F.nullif(shelf, F.lit(""))
    pair = F.concat_ws("/", category, shelf)
    return (
        F.when(~category.isin(*dims.CATEGORIES), F.concat(F.lit("unknown_category_slug:"), category))
        .when(shelf.isNotNull() & category.isNull(), F.concat(F.lit("subcategory_without_category:"), shelf))
        .when(shelf.isNotNull() & ~pair.isin(*dims.SHELVES), F.concat(F.lit("unknown_subcategory_slug:"), pair))
    )

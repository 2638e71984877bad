"""Units, money, text guards and keyword matches as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit spellings and their factors.
GRAMS = {
    "g": 1.0, "gm": 1.0, "gms": 1.0, "gram": 1.0, "grams": 1.0, "kg": 1000.0, "kgs": 1000.0, "kilo": 1000.0, "kilos": 1000.0,
    "kilogram": 1000.0, "kilograms": 1000.0, "mg": 0.001, "lb": 453.592, "lbs": 453.592, "pound": 453.592, "pounds": 453.592,
    "oz": 28.3495, "ounce": 28.3495, "ounces": 28.3495,
}
CENTIMETRES = {
    "cm": 1.0, "cms": 1.0, "centimetre": 1.0, "centimetres": 1.0, "centimeter": 1.0, "centimeters": 1.0, "mm": 0.1,
    "millimetre": 0.1, "millimetres": 0.1, "millimeter": 0.1, "millimeters": 0.1, "m": 100.0, "metre": 100.0, "metres": 100.0,
    "meter": 100.0, "meters": 100.0, "in": 2.54, "inch": 2.54, "inches": 2.54, '"': 2.54, "ft": 30.48, "foot": 30.48,
    "feet": 30.48, "'": 30.48,
}
UNIT_CODES = {"GRM": "g", "KGM": "kg", "MGM": "mg", "LBR": "lb", "ONZ": "oz", "CMT": "cm", "MMT": "mm", "MTR": "m", "INH": "in", "FOT": "ft"}
CURRENCY_SYMBOLS = {"₹": "INR", "€": "EUR", "£": "GBP", "¥": "JPY", "₩": "KRW"}
CURRENCY_PREFIXES = {
    "rs.": "INR", "rs": "INR", "inr": "INR", "us$": "USD", "usd": "USD", "eur": "EUR", "gbp": "GBP", "aed": "AED",
    "cad": "CAD", "aud": "AUD", "sgd": "SGD",
}


def let(value: Column, use) -> Column:
    """``use`` of ``value``, which is worked out once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def measured(text: Column, factors: dict[str, float]) -> Column:
    """A whole number of the base unit, rounded half to even; null for no number, an unknown unit or nothing left.
    A comma is a decimal point here."""
    number = F.regexp_extract(text, r"(\d+(?:[.,]\d+)?)", 1)
    unit = F.lower(F.regexp_extract(text, r"""\d+(?:[.,]\d+)?[^a-zA-Z"']*([a-zA-Z]+|"|')""", 1))
    factor = F.create_map(*[F.lit(x) for pair in factors.items() for x in pair])[unit]
    value = F.replace(number, F.lit(","), F.lit(".")).try_cast("double")
    return F.when((value > 0) & factor.isNotNull(), F.bround(value * factor, 0).cast("int"))


def amount(text: Column) -> Column:
    """The first price in a text: of points and commas the last kind is the decimal one; commas alone are so before two
    digits, points alone unless three digits follow the last. Null for none, or what is left can't be read, or nothing."""

    def number(raw: Column) -> Column:
        commas, points = F.contains(raw, F.lit(",")), F.contains(raw, F.lit("."))
        drop = lambda c: F.replace(raw, F.lit(c), F.lit(""))
        last_is_comma = raw.rlike(r",[^.,]*$")
        return (
            F.when(commas & points & last_is_comma, F.replace(drop("."), F.lit(","), F.lit(".")))
            .when(commas & points, drop(","))
            .when(commas & raw.rlike(r",\d{2}$"), F.replace(raw, F.lit(","), F.lit(".")))
            .when(commas, drop(","))
            .when(points & raw.rlike(r"\.\d{3}$"), drop("."))
            .otherwise(raw)
        )

    raw = F.regexp_replace(F.regexp_extract(text, r"(?U)(\d[\d.,\s]*\d|\d)", 1), r"(?U)\s", "")
    return let(let(raw, number).try_cast("double"), lambda v: F.when(v > 0, v))


def currency(text: Column) -> Column:
    """Currency by symbol, else by the longest prefix found anywhere, else USD for a plain dollar sign, else null."""
    out = F.when(F.lit(False), F.lit(""))
    for symbol, code in CURRENCY_SYMBOLS.items():
        out = out.when(F.contains(text, F.lit(symbol)), code)
    for prefix, code in sorted(CURRENCY_PREFIXES.items(), key=lambda x: -len(x[0])):
        out = out.when(F.contains(F.lower(text), F.lit(prefix)), code)
    return out.when(F.contains(text, F.lit("$")), "USD")


def ambiguous_currency(text: Column) -> Column:
    """Whether only a plain dollar sign tells the currency, which several countries use."""
    known = F.lit(False)
    for symbol in CURRENCY_SYMBOLS:
        known = known | F.contains(text, F.lit(symbol))
    for prefix in CURRENCY_PREFIXES:
        known = known | F.contains(F.lower(text), F.lit(prefix))
    return F.contains(text, F.lit("$")) & ~known


def price_inr(value: Column, code: Column, rate: Column, strategy: str, markup: float = 0.0) -> Column:
    """The listed price under a strategy: blank, copy (INR only), convert or markup (by a rate), half to even."""
    if strategy == "blank":
        return F.lit(None).cast("int")
    if strategy == "copy":
        return F.when(code == "INR", F.bround(value, 0).cast("int"))
    full = F.when(code == "INR", F.lit(1.0)).otherwise(rate)
    return F.bround(value * full * (1 + (markup if strategy == "markup" else 0.0) / 100), 0).cast("int")


def guarded(text: Column) -> Column:
    """A cell that a spreadsheet won't run."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_cell(text: Column) -> Column:
    """A cell quoted only where it must be; null is empty."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[",\r\n]'), quoted).otherwise(text), F.lit(""))


def has_keyword(text: Column, keyword: str, plural: bool = True) -> Column:
    ending = "(?:e?s)?" if plural else ""
    return text.rlike(rf"(?iU)(?<!\w){re.escape(keyword)}{ending}(?!\w)")


def human_bytes(n: Column) -> Column:
    """A size in bytes, KB or MB with one decimal; halves go to the even digit."""
    # format_string alone would round halves up
    tenths = lambda unit: F.bround(n / unit, 1)
    return (
        F.when(n.isNull(), "?")
        .when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", tenths(1024)))
        .otherwise(F.format_string("%.1f MB", tenths(1024 * 1024)))
    )

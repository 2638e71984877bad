"""Cells of a listing out of what ``sources.page_evidence`` read: which source is believed, and how far.

A cell is struct<value, confidence, source, note>; an absent one has a null value and the confidence none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom.functions import texts, urls, values

#: Labels of measures in a table of facts.
WEIGHT_LABELS = ("weight", "net weight", "product weight", "item weight", "unit weight")
SHIPPING_LABELS = ("shipping weight", "gross weight", "packed weight", "packaging weight")
TRIPLE_LABELS = ("dimensions", "dimension", "measurements", "measurement", "size", "product size", "product dimensions", "item dimensions")
AXIS_LABELS = {"length": ("length", "len", "long"), "width": ("width", "breadth", "wide"), "height": ("height", "high", "depth", "thickness", "tall")}
#: States of an offer, and what a listing may say of them.
IN_STOCK = ("instock", "instoreonly", "limitedavailability", "onlineonly")
TO_ORDER = ("madetoorder", "preorder", "presale", "backorder")
OUT_OF_STOCK = ("outofstock", "soldout", "discontinued")
IN_STOCK_VALUE = "in_stock"
COUNT = r"(?i)(\d{1,6})\s*(?:in stock|available|left|pieces?|units?)"
#: Which rule's picture comes first among equals.
RULES = ("structured", "og", "twitter", "srcset", "src", "lazy", "background")

#: Columns of a page's evidence that each of this module's functions reads.
NEEDS = {
    "title": ("product", "product_source", "meta", "h1", "page_title"), "description": ("product", "product_source", "meta", "blocks"),
    "weight": ("measures", "product_source", "pairs"), "axes": ("measures", "product_source", "pairs"), "price": ("offers", "meta", "prices"),
    "sizes": ("variants", "product_source", "sizes"), "availability": ("offers", "stock_text"), "stock": ("offers", "product_source", "pairs", "body"),
    "trail": ("trail", "product_source"), "candidates": ("base", "images"),
}

_CELL = "struct<value:{},confidence:string,source:string,note:string>"


def cell(value: Column, confidence: str | Column, source: Column | str, note: str | None = None, kind: str = "string") -> Column:
    """A cell if ``value`` is there (not null, not ''), else null."""
    parts = [F.lit(x) if x is None or isinstance(x, str) else x for x in (confidence, source, note)]
    of = lambda v: F.struct(v.alias("value"), *[p.alias(n) for p, n in zip(parts, ("confidence", "source", "note"), strict=True)])
    there = lambda v: v.isNotNull() & (v != "") if kind == "string" else v.isNotNull()
    return values.let(value, lambda v: F.when(there(v), of(v).cast(_CELL.format(kind))))


def first_of(*cells: Column, kind: str = "string", missing: str | None = None) -> Column:
    """The first cell that is there, else an absent one with ``missing`` for its note."""
    none = F.struct(F.lit(None).alias("value"), F.lit("none").alias("confidence"), F.lit(None).alias("source"), F.lit(missing).alias("note"))
    return F.coalesce(*cells, none.cast(_CELL.format(kind)))


def _meta(*keys: str) -> Column:
    return F.coalesce(*[F.col("meta")[k] for k in keys])


def title() -> Column:
    """Product name, then og or twitter title, the heading, and last the page title without its shop."""
    own, shared = (F.coalesce(F.col("product")["name"], F.col("product")["title"]), _meta("og:title", "twitter:title"))
    sure = lambda raw: F.when(texts.shouty(texts.collapsed(raw)), "medium").otherwise("high")
    clean = lambda raw: texts.clean_title(texts.collapsed(raw))
    return first_of(
        cell(clean(own), sure(own), F.col("product_source")),
        cell(clean(shared), sure(shared), F.when(F.col("meta")["og:title"].isNotNull(), "og").otherwise("twitter")),
        cell(texts.clean_title(F.col("h1")), "medium", "h1"),
        cell(texts.clean_title(texts.without_suffix(F.col("page_title"))), "low", "title_tag"),
        missing="no title",
    )


def description() -> Column:
    """Product description, then og or twitter, the meta description, and last a block of the page; each long enough."""
    long = lambda text: F.when(F.length(text) >= texts.DESCRIPTION_LEAST, text)
    clean = lambda text: long(texts.clean_description(text))
    enough = F.filter(F.col("blocks"), lambda b: F.length(texts.collapsed(b)) >= texts.DESCRIPTION_LEAST)
    return first_of(
        cell(clean(F.col("product")["description"]), "high", F.col("product_source")),
        cell(clean(_meta("og:description", "twitter:description")), "high", F.when(F.col("meta")["og:description"].isNotNull(), "og").otherwise("twitter")),
        cell(clean(F.col("meta")["description"]), "medium", "meta"),
        cell(clean(F.get(enough, F.lit(0))), "low", "heuristic"),
        missing="no description",
    )


def by_labels(labels: tuple[str, ...]) -> Column:
    """struct<label, value> of the first of ``labels`` that a fact has, or else that stands in a fact's label."""
    first = lambda fits: F.get(F.filter("pairs", fits), F.lit(0))
    whole = [first(_label(Column.__eq__, w)) for w in labels]
    return F.coalesce(*whole, *[first(_label(F.contains, w)) for w in labels])


def _label(test, word: str):
    return lambda pair: test(pair["label"], F.lit(word))


def _stated(name: str, factors: dict[str, float]) -> Column:
    """A product's own measure in the base unit: its number and unit code, or a text with both."""
    m = F.col("measures")[name]
    unit = F.coalesce(F.create_map(*[F.lit(x) for p in values.UNIT_CODES.items() for x in p])[F.upper(m["unit"])], F.lower(m["unit"]))
    factor = F.create_map(*[F.lit(x) for p in factors.items() for x in p])[unit]
    number = m["value"].try_cast("double")
    parsed = F.when((number > 0) & factor.isNotNull(), F.bround(number * factor, 0).cast("int"))
    return F.when(m["unit"].isNull(), values.measured(m["value"], factors)).otherwise(parsed)


def weight() -> Column:
    """Grams: the product's own weight, then a fact's, and last a shipping weight, which counts its parcel."""
    packed = lambda label: reduce(lambda a, b: a | b, [F.contains(label, F.lit(s)) for s in SHIPPING_LABELS])
    own = values.let(by_labels(WEIGHT_LABELS), lambda f: F.when(~packed(f["label"]), values.measured(f["value"], values.GRAMS)))
    return first_of(
        cell(_stated("weight", values.GRAMS), "high", F.col("product_source"), kind="int"),
        cell(own, "high", "spec_table", kind="int"),
        cell(values.measured(by_labels(SHIPPING_LABELS)["value"], values.GRAMS), "low", "spec_table", "shipping weight", kind="int"),
        kind="int", missing="no weight",
    )


def triple(text: Column) -> Column:
    """struct<length, width, height, stated> in centimetres of "70 x 50 x 2 cm"; null unless two or three numbers can be read.

    A unit behind the last number goes for those without one; letters before the numbers (L, W, H, D) tell the axes unless
    one comes twice, else the order does.
    """
    unit = lambda p: F.lower(F.regexp_extract(p, r"""\d+(?:[.,]\d+)?[^a-zA-Z"']*([a-zA-Z]+|"|')""", 1))
    factors = F.create_map(*[F.lit(x) for pair in values.CENTIMETRES.items() for x in pair])
    number = lambda p: F.replace(F.regexp_extract(p, r"(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")

    def sized(parts: Column) -> Column:
        known = F.filter(F.transform(parts, unit), lambda u: factors[u].isNotNull())
        last = F.coalesce(F.get(F.reverse(known), F.lit(0)), F.lit("cm"))
        whole = lambda p: F.when(number(p) > 0, F.bround(number(p) * F.coalesce(factors[unit(p)], factors[last]), 0).cast("int"))
        return F.when(F.size(parts) >= 2, F.transform(parts, whole))

    def placed(both: Column) -> Column:
        sizes, letters = both["sizes"], both["letters"]
        stated = (F.size(letters) == F.size(sizes)) & (F.size(F.array_distinct(letters)) == F.size(letters))
        at = lambda letter, k: F.when(stated, F.get(sizes, F.array_position(letters, letter).cast("int") - 1)).otherwise(F.get(sizes, F.lit(k)))
        found = F.struct(*[at(a, k).alias(n) for k, (a, n) in enumerate((("L", "length"), ("W", "width"), ("H", "height")))], stated.alias("stated"))
        return F.when(F.forall(sizes, lambda s: s.isNotNull()), found)

    parts = F.slice(F.filter(F.split(text, r"(?i)\s*[x×✕*]\s*"), lambda p: F.trim(p) != ""), 1, 3)
    letters = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b([LWHD])\s*[:=]?\s*(?=\d)"), 1), lambda a: F.replace(F.upper(a), F.lit("D"), F.lit("L")))
    return values.let(F.struct(values.let(parts, sized).alias("sizes"), letters.alias("letters")), placed)


def axes() -> list[Column]:
    """length_cm, width_cm, height_cm: the product's own, facts of their own (depth for a height), then three in a row."""
    row = triple(by_labels(TRIPLE_LABELS)["value"])
    out = []
    for name, labels in AXIS_LABELS.items():
        own = [cell(_stated(name, values.CENTIMETRES), "high", F.col("product_source"), kind="int")]
        own += [cell(_stated("depth", values.CENTIMETRES), "medium", F.col("product_source"), kind="int")] if name == "height" else []
        fact = cell(values.measured(by_labels(labels)["value"], values.CENTIMETRES), "high", "spec_table", kind="int")
        part = cell(row[name], F.when(row["stated"], "medium").otherwise("low"), "spec_table", "one of three in a row", kind="int")
        out.append(first_of(*own, fact, part, kind="int", missing="no dimension").alias(f"{name}_cm"))
    return out


def price() -> Column:
    """struct<amount, currency, ambiguous, source>: the first offer with a price, then meta prices, then the page's."""
    def found(raw: Column, code: Column, doubt: Column, source: str) -> Column:
        of = lambda v: F.struct(v.alias("amount"), code.alias("currency"), doubt.alias("ambiguous"), F.lit(source).alias("source"))
        return values.let(values.amount(raw), lambda v: F.when(v.isNotNull(), of(v)))

    offer = F.get(F.filter(F.col("offers"), lambda o: values.amount(o["price"]).isNotNull()), F.lit(0))
    text = F.get(F.filter(F.col("prices"), lambda p: values.amount(p).isNotNull()), F.lit(0))
    no = F.lit(False)
    return F.coalesce(
        found(offer["price"], F.upper(offer["currency"]), no, "json-ld"),
        *[found(_meta(f"{k}:price:amount"), F.upper(_meta(f"{k}:price:currency")), no, "og") for k in ("og", "product")],
        found(text, values.currency(text), values.ambiguous_currency(text), "heuristic"),
    )


def sizes() -> Column:
    """The sizes a page offers: its variants', then those of the first kind of control that has any."""
    controls = F.filter(F.transform(F.col("sizes"), texts.clean_sizes), lambda s: F.size(s) > 0)
    of = lambda labels: F.array_join(labels, ",")
    return first_of(
        cell(of(texts.clean_sizes(F.col("variants"))), "high", F.col("product_source")), cell(of(F.get(controls, F.lit(0))), "medium", "variants"), missing="no sizes"
    )


def availability() -> Column:
    """in_stock or nothing: other states are a person's to decide, so they are told by the note."""
    stated = F.get(F.filter(F.col("offers"), lambda o: o["availability"].isNotNull()), F.lit(0))["availability"]
    text, says = F.col("stock_text"), lambda *words: reduce(lambda a, b: a | b, [F.contains(F.col("stock_text"), F.lit(w)) for w in words])
    told = F.when(says("out of stock", "sold out"), "outofstock").when(says("made to order", "made-to-order"), "madetoorder").when(says("in stock", "available"), "instock")
    state = F.coalesce(F.lower(F.regexp_extract(stated, r"([^/#]*)$", 1)), F.when(text != "", told))
    note = F.when(state.isin(*TO_ORDER), "made to order").when(state.isin(*OUT_OF_STOCK), "out of stock").otherwise("no availability")
    none = F.struct(F.lit(None).alias("value"), F.lit("none").alias("confidence"), F.lit(None).alias("source"), note.alias("note"))
    return F.coalesce(cell(F.when(state.isin(*IN_STOCK), IN_STOCK_VALUE), "high", "json-ld"), none.cast(_CELL.format("string")))


def stock() -> Column:
    """A stated number of pieces: the offer's, a fact's, or one in the page's text; never a guess."""
    offered = F.get(F.filter(F.col("offers"), lambda o: F.trim(o["inventory"]).rlike(r"^\d{1,9}$")), F.lit(0))["inventory"]
    number = lambda text: F.regexp_extract(text, COUNT, 1)
    labels = ("stock", "quantity", "quantity in stock", "available quantity")
    fact = F.coalesce(*[F.get(F.filter("pairs", _label(Column.__eq__, k)), F.lit(0))["value"] for k in labels])
    of_fact = F.coalesce(F.nullif(number(fact), F.lit("")), F.nullif(F.regexp_extract(fact, r"^\s*(\d{1,6})\s*$", 1), F.lit("")))
    return first_of(
        cell(F.trim(offered).cast("int"), "high", F.col("product_source"), kind="int"), cell(of_fact.cast("int"), "medium", "spec_table", kind="int"),
        cell(F.nullif(number(F.col("body")), F.lit("")).cast("int"), "low", "heuristic", kind="int"), kind="int", missing="no stock count",
    )


def cells(evidence: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per page: ``key``, url, each cell, price, trail; ``evidence`` as ``read_pages`` gives it."""
    return evidence.select(
        key, "url", title().alias("title"), description().alias("description"), weight().alias("weight_g"), *axes(), price().alias("price"),
        sizes().alias("sizes"), availability().alias("availability"), stock().alias("stock_qty"), "trail",
    )


def candidates(evidence: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, page_url, url, rule, dom_index, width): pictures as whole links without tracking, those that show no product
    dropped, each link once per page, at its first place."""
    shots = evidence.select(key, F.col("url").alias("page_url"), "base", F.posexplode("images").alias("dom_index", "x"))
    link = urls.without_params(texts.absolute(F.col("base"), F.col("x.url")), urls.IMAGE_TRACKING)
    shots = shots.select(key, "page_url", "dom_index", link.alias("url"), "x.rule", "x.width").where("url is not null")
    shots = shots.where(~texts.rejected(F.col("url")))
    first = F.min_by(F.struct("dom_index", "rule", "width"), "dom_index").alias("x")
    # dealt by page once, they are where this and what sorts a page's pictures need them
    return shots.repartition(key).groupBy(key, "page_url", "url").agg(first).select(key, "page_url", "url", "x.*")


def ordered(found: DataFrame, key: str = "page_id", least: int = 800, pool: int = 12) -> DataFrame:
    """``candidates`` by photo, best first: (key, photo_rank, rank, url, upsized).

    A link whose original is known stands for it, the original first, the link behind it as its fallback unless it is
    too small. Photos come by the size they state, then by words of the page's path in their names, rule and place; the
    first ``pool`` stay.
    """
    base = found.withColumn("full", texts.full_size(F.col("url")))
    full = F.when(F.col("full").isNotNull() & ~texts.rejected(F.col("full")), F.col("full"))
    base = base.withColumn("photo", F.coalesce(full, "url")).withColumn("made", full.isNotNull())
    size = urls.declared_width(F.col("url"))
    stated = F.coalesce(size, F.col("width"))
    own = F.when(stated >= least, F.when(size.isNotNull(), 1).otherwise(2)).when(stated.isNotNull(), 4).otherwise(3)
    base = base.withColumn("tier", own).withColumn("stated", F.coalesce(stated, F.lit(0)))
    rule = F.array_position(F.array(*map(F.lit, RULES)), F.col("rule"))
    base = base.withColumn("words", texts.affinity(F.col("photo"), texts.slug_tokens(F.col("page_url")))).withColumn("of_rule", rule)
    # the link itself stands for its photo if the page has it, else the original made from another
    lead = F.struct(F.col("made").cast("int").alias("made"), "dom_index", F.when(F.col("made"), 0).otherwise(F.col("tier")).alias("tier"), "stated", "words", "of_rule")
    photos = base.groupBy(key, "photo").agg(F.min(lead).alias("lead"), F.sort_array(F.collect_list(F.when(F.col("made") & (F.col("tier") < 4), F.struct("tier", "dom_index", "url")))).alias("more"))
    order = F.struct("lead.tier", (-F.col("lead.words")).alias("words"), (-F.col("lead.stated")).alias("stated"), "lead.of_rule", "lead.dom_index", "photo", "lead.made", "more")
    # a page's pictures are a page's worth, so they are sorted as an array
    pages = photos.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(order)), 1, pool).alias("photos"))
    links = F.concat(F.array(F.struct(F.col("p.photo").alias("url"), (F.col("p.made") == 1).alias("upsized"))), F.transform("p.more", lambda m: F.struct(m["url"].alias("url"), F.lit(False).alias("upsized"))))
    flat = pages.select(key, F.posexplode("photos").alias("photo_rank", "p")).select(key, "photo_rank", F.posexplode(links).alias("rank", "x"))
    return flat.select(key, "photo_rank", "rank", "x.url", "x.upsized")

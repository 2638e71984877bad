"""Listing records: cells into the locked columns, what a person must look at, companion tables, merging, gates and edits.

A record is a row with row_key, source_url, status (ok, needs_review, failed), one cell per name in CELLS (see
``operators.extract``), notes and flags (array<string>), image_url, files (array of struct with hosted_url,
original_url, local_path, bytes, width, height) and image_candidates (array<string>).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom.functions import dims, urls, values

#: The columns of a listing, in order.
COLUMNS = (
    "title", "description", "category_slug", "subcategory_slug", "custom_category", "price_inr", "hs_code", "weight_g", "length_cm", "width_cm",
    "height_cm", "availability", "stock_qty", "sizes", "gi_region", "rfq_enabled", "rfq_min_qty", "bulk_only", "seller_note", "image_urls",
)
WHOLE = ("price_inr", "weight_g", "length_cm", "width_cm", "height_cm", "stock_qty", "rfq_min_qty")
#: The cell that nothing may fill, and the one that is made of the pictures.
LOCKED, PICTURES = "gi_region", "image_urls"
CELLS = tuple(c for c in COLUMNS if c not in (LOCKED, PICTURES))
#: Cells without which a listing can't be published.
REQUIRED = ("title", "description", "category_slug", "price_inr", "hs_code", "weight_g", "length_cm", "width_cm", "height_cm", "availability")
#: How sure each confidence is.
RANK = {"none": 0, "low": 1, "medium": 2, "high": 3}
AVAILABILITY = ("in_stock",)
BETWEEN = " | "
CELL = "struct<value:{},confidence:string,source:string,note:string>"

_FILE = "array<struct<hosted_url:string,original_url:string,local_path:string,bytes:bigint,width:int,height:int>>"


def kind_of(name: str) -> str:
    return "int" if name in WHOLE else "string"


def present(name: str) -> Column:
    value = F.col(name)["value"]
    return value.isNotNull() if name in WHOLE else value.isNotNull() & (value != "")


def complete(df: DataFrame) -> DataFrame:
    """``df`` as records: cells and other columns of a record that it lacks are there, empty."""
    empty = {c: F.lit(None).cast(CELL.format(kind_of(c))) for c in CELLS}
    empty |= {"status": F.lit("ok"), "notes": F.array().cast("array<string>"), "flags": F.array().cast("array<string>"), "image_url": F.lit("")}
    empty |= {"files": F.array().cast(_FILE), "image_candidates": F.array().cast("array<string>")}
    return df.withColumns({k: v for k, v in empty.items() if k not in df.columns})


def _plain(text: Column) -> Column:
    return values.guarded(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))


def _once_per_photo(links: Column) -> Column:
    """Links in their order, of each photograph the first."""
    photos = lambda all_: F.transform(all_, lambda u: urls.photo_identity(u))
    return values.let(links, lambda all_: F.filter(all_, lambda u, i: F.array_position(photos(all_), urls.photo_identity(u)) == i + 1))


def listable_photos() -> Column:
    """Links that a buyer can load, the main picture first, each photograph once."""
    links = F.concat(F.array("image_url"), F.transform("files", lambda f: f["hosted_url"]))
    return _once_per_photo(F.filter(links, lambda u: u.rlike("^https?://")))


def row_values() -> dict[str, Column]:
    """A record's cells as text, by column: what is absent is empty, numbers are digits, a spreadsheet won't run any."""
    out = {}
    for name in COLUMNS:
        if name == LOCKED:
            text = F.lit("")
        elif name == PICTURES:
            text = _plain(F.array_join(listable_photos(), BETWEEN))
        else:
            value = F.col(name)["value"]
            text = F.when(present(name), value.cast("string") if name in WHOLE else _plain(value)).otherwise("")
        out[name] = text.alias(name)
    return out


def csv_line(columns: list[Column]) -> Column:
    return F.concat_ws(",", *[values.csv_cell(c) for c in columns])


def listing_lines(records: DataFrame, order: str) -> DataFrame:
    """(``order``, line): a listing line for each record that hasn't failed."""
    kept = complete(records).where("status <> 'failed'")
    return kept.select(order, *row_values().values()).select(order, csv_line([F.col(c) for c in COLUMNS]).alias("line"))


class HeaderMismatch(Exception):
    """The file there has other columns than the rows that would be added."""


def append_listings(records: DataFrame, path: str, order: str) -> None:
    """Add the records' lines to the folder of line files at ``path``, sorted within each file; lines end in CRLF.

    The header is a file of its own that sorts first; if one is there, it must be this one.
    """
    spark, header = records.sparkSession, ",".join(COLUMNS)
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/header")
    if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        found = spark.read.option("lineSep", "\r\n").text(f"{path}/header").first()
        if found is None or found[0] != header:
            raise HeaderMismatch(f"{path} has other columns")
    else:
        spark.createDataFrame([(header,)], "line string").coalesce(1).write.option("lineSep", "\r\n").text(f"{path}/header")
    lines = listing_lines(records, order).repartitionByRange(order).sortWithinPartitions(order).select("line")
    lines.write.mode("append").option("lineSep", "\r\n").text(f"{path}/rows")


def extracted_anything() -> Column:
    return reduce(lambda a, b: a | b, map(present, CELLS))


def missing_required() -> Column:
    """Required cells that are absent; none if nothing was extracted."""
    gone = F.array_compact(F.array(*[F.when(~present(c), c) for c in REQUIRED]))
    return F.when(extracted_anything(), gone).otherwise(F.array().cast("array<string>"))


def low_confidence() -> Column:
    """``cell:confidence`` of cells that are there but not sure."""
    unsure = lambda c: present(c) & F.col(c)["confidence"].isin("low", "medium")
    return F.array_compact(F.array(*[F.when(unsure(c), F.concat(F.lit(f"{c}:"), F.col(c)["confidence"])) for c in CELLS]))


def cell_depths() -> Column:
    """A digit for each column: how sure its cell is, 0 for an absent one, - for the locked one."""
    digit = lambda c: F.coalesce(F.create_map(*[F.lit(str(x)) for p in RANK.items() for x in p])[F.col(c)["confidence"]], F.lit("1"))
    special = {LOCKED: F.lit("-"), PICTURES: F.when(F.size(listable_photos()) > 0, "3").otherwise("0")}
    return F.concat(*[special[c] if c in special else F.when(present(c), digit(c)).otherwise("0") for c in COLUMNS])


def needs_review(gi_mention: Column | None = None) -> Column:
    """Whether a listed record still wants a decision; one that failed or has nothing in it never does."""
    some = lambda array: F.size(array) > 0
    asked = (F.col("status") != "ok") | some("flags") | some("notes") | some(missing_required()) | some(low_confidence())
    asked = asked if gi_mention is None else asked | F.coalesce(gi_mention != "", F.lit(False))
    return (F.col("status") != "failed") & extracted_anything() & asked


def review_rows(records: DataFrame, key: str = "row_key") -> DataFrame:
    """(``key``, status, flags, missing, unsure, depths, notes) of the records that need review."""
    join = lambda c: F.array_join(c, BETWEEN)
    return complete(records).where(needs_review()).select(
        key, "status", join("flags").alias("flags"), join(missing_required()).alias("missing"), join(low_confidence()).alias("unsure"),
        cell_depths().alias("depths"), join("notes").alias("notes"),
    )


def with_images(records: DataFrame, key: str = "row_key", most: int = 10) -> DataFrame:
    """``key``, the listing's columns, and the pictures behind them: links by photograph, how many, those not used, sizes."""
    links = F.concat(F.array("image_url"), F.transform("files", lambda f: F.coalesce(F.nullif(f["hosted_url"], F.lit("")), f["original_url"])))
    base = complete(records).withColumn("_links", _once_per_photo(F.filter(links, lambda u: u != "")))
    hero = F.get("files", F.lit(0))
    unused = F.filter("image_candidates", lambda u: (u != "") & ~F.array_contains("_links", u))
    return base.select(
        key, *row_values().values(), _plain(F.col("image_url")).alias("image_url"),
        *[F.coalesce(_plain(F.get("_links", F.lit(k))), F.lit("")).alias(f"image_{k + 1}") for k in range(most)],
        F.size("_links").alias("image_count"), _plain(F.array_join(unused, BETWEEN)).alias("rejected_image_urls"),
        F.coalesce(hero["width"].cast("string"), F.lit("")).alias("width"), F.coalesce(hero["height"].cast("string"), F.lit("")).alias("height"),
    )


def manifest(records: DataFrame, key: str = "row_key") -> DataFrame:
    """One row per file of a record, in their order from 1."""
    return complete(records).select(key, F.posexplode("files").alias("place", "f")).select(key, (F.col("place") + 1).alias("place"), "f.*")


def image_links(found: DataFrame, index: str, links: str, extra: list[str], least: int = 10) -> DataFrame:
    """``found`` as a table that fits its owner's: their ``extra`` columns, ``index``, and image_url_1 to N, where N is
    ``least`` or the widest row's number of ``links``."""
    width = max(least, found.agg(F.max(F.size(links))).first()[0] or 0)
    cells = [F.coalesce(_plain(F.get(links, F.lit(k))), F.lit("")).alias(f"image_url_{k + 1}") for k in range(width)]
    return found.select(*[_plain(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in extra], index, *cells)


def merge_rendered(static: DataFrame, rendered: DataFrame, key: str = "row_key") -> DataFrame:
    """``static`` with what a second reading of the page adds, and gained (array<string>): a cell that was absent, or comes
    from a surer source; pictures if it has more; notes of both; needs_review if the second reading asks for it."""
    rank = F.create_map(*[F.lit(x) for p in RANK.items() for x in p])
    fresh = complete(rendered).select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in (*CELLS, "status", "notes", "image_candidates")])
    both = complete(static)
    base = both.join(fresh, both[key] == fresh["_key"], "left")
    there = lambda c: F.col(c)["value"].isNotNull() & (F.col(c)["value"].cast("string") != "")
    new, surer = {}, {}
    for c in CELLS:
        new[c] = there(f"_{c}") & ~F.coalesce(there(c), F.lit(False))
        surer[c] = there(f"_{c}") & F.coalesce(there(c), F.lit(False)) & (rank[F.col(f"_{c}")["confidence"]] > rank[F.col(c)["confidence"]])
    more = F.coalesce(F.size("_image_candidates") > F.size("image_candidates"), F.lit(False))
    gained = [F.when(new[c], c).when(surer[c], f"{c} (better source)") for c in CELLS] + [F.when(more, "pictures")]
    columns = {c: F.when(F.coalesce(new[c] | surer[c], F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)) for c in CELLS}
    columns["image_candidates"] = F.when(more, F.col("_image_candidates")).otherwise(F.col("image_candidates"))
    columns["notes"] = F.array_union("notes", F.coalesce("_notes", F.array().cast("array<string>")))
    columns["status"] = F.when((F.col("status") == "ok") & (F.col("_status") == "needs_review"), "needs_review").otherwise(F.col("status"))
    return base.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in both.columns], F.array_compact(F.array(*gained)).alias("gained"))


def flagged(records: DataFrame) -> DataFrame:
    """Records with what extraction itself says of them: no title fails a record, weak or absent cells raise flags."""
    base = complete(records)
    weak = lambda c: present(c) & F.col(c)["confidence"].isin("low", "none")
    said = F.array_compact(F.array(
        F.when(~present("description"), "no description"), F.when(F.size("image_candidates") == 0, "no pictures"),
        F.when(weak("title"), F.concat(F.lit("title is "), F.col("title")["confidence"])),
        F.when(weak("description"), F.concat(F.lit("description is "), F.col("description")["confidence"])),
    ))
    named = present("title")
    status = F.when(~named, "failed").when((F.col("status") == "ok") & (F.size(said) > 0), "needs_review").otherwise(F.col("status"))
    return base.withColumns({
        "status": status, "flags": F.when(named, F.array_union("flags", said)).otherwise(F.col("flags")),
        "notes": F.when(named, F.col("notes")).otherwise(F.array_union("notes", F.array(F.lit("no_title")))),
    })


def provenance_gate(records: DataFrame, raw_description: bool) -> DataFrame:
    """Records of other people's products (provenance third_party) are never plainly ok, and say so; with verbatim
    descriptions they are flagged. The last step, so nothing undoes it."""
    base, theirs = complete(records), F.col("provenance") == "third_party"
    copied = theirs & F.lit(raw_description) & present("description")
    return base.withColumns({
        "status": F.when(theirs & (F.col("status") == "ok"), "needs_review").otherwise(F.col("status")),
        "notes": F.when(theirs, F.array_union("notes", F.array(F.lit("not the seller's own page")))).otherwise(F.col("notes")),
        "flags": F.when(copied, F.array_union("flags", F.array(F.lit("description is verbatim")))).otherwise(F.col("flags")),
    })


def retract_gaps(notes: Column, gap_notes: Column, filled: Column) -> tuple[Column, Column]:
    """Notes and gap notes (map of cell to note) without those whose cells are ``filled``; a note that another open cell
    shares stays."""
    left = F.map_filter(gap_notes, lambda cell, _: ~F.array_contains(filled, cell))
    done = F.array_except(F.map_values(gap_notes), F.map_values(left))
    return F.filter(notes, lambda n: ~F.array_contains(done, n)), left


def rendered_again(static: DataFrame, rendered: DataFrame, missing: Column, key: str = "row_key") -> DataFrame:
    """``static`` after a second reading of its pages, for which it was told what was ``missing``, and gained.

    ``static`` has, besides its record, notes_before (how many notes stood before its first reading), status_before, and
    gap_notes (map of cell to note). Where the second reading is there, what the first said of the page it read is taken
    back (its notes and its status), the readings are merged (``merge_rendered``), gaps that are filled now are no longer
    told, and a note says what came of it. Where it isn't, all stands as it was, and a note says that it was tried.
    """
    found = rendered.select(F.col(key).alias("_again_key")).distinct()
    base = complete(static.withColumn("_missing", missing)).join(found, F.col(key) == F.col("_again_key"), "left").withColumn("_again", F.col("_again_key").isNotNull()).drop("_again_key")
    back = base.withColumns({
        "notes": F.when(F.col("_again"), F.slice("notes", F.lit(1), F.col("notes_before"))).otherwise(F.col("notes")),
        "status": F.when(F.col("_again"), F.col("status_before")).otherwise(F.col("status")),
    })
    merged = merge_rendered(back, rendered, key)
    filled = F.array_compact(F.array(*[F.when(present(c), c) for c in CELLS]))
    notes, gaps = retract_gaps(F.col("notes"), F.col("gap_notes"), filled)
    merged = merged.withColumns({"_notes": F.when(F.col("_again"), notes).otherwise(F.col("notes")), "_gaps": F.when(F.col("_again"), gaps).otherwise(F.col("gap_notes"))})
    told = F.when(F.size("gained") > 0, F.concat(F.lit("recovered "), F.array_join("gained", ", "))).otherwise("found nothing more")
    told = F.when(F.col("_again"), told).otherwise("failed, the first reading stands")
    note = F.concat(F.lit("no "), F.col("_missing"), F.lit("; rendering "), told)
    return merged.withColumns({"notes": F.array_append("_notes", note), "gap_notes": F.col("_gaps")}).drop("_missing", "_again", "_notes", "_gaps")


def seller_note(operator_note: Column, price: Column, code: Column) -> Column:
    """What a buyer's question would need: the operator's words, the page, weight, size, options and the price seen there."""
    sides = [F.col(c)["value"] for c in ("length_cm", "width_cm", "height_cm")]
    return F.concat_ws(
        " · ", F.nullif(operator_note, F.lit("")), F.concat(F.lit("Source: "), F.nullif(F.col("source_url"), F.lit(""))),
        F.concat(F.lit("Weight: "), F.col("weight_g")["value"], F.lit(" g")),
        F.concat(F.lit("Size: "), sides[0], F.lit(" x "), sides[1], F.lit(" x "), sides[2], F.lit(" cm")),
        F.when(present("sizes"), F.concat(F.lit("Options: "), F.col("sizes")["value"])),
        F.concat(F.lit("Listed on source at "), _general(price), F.lit(" "), code),
    )


def _general(number: Column) -> Column:
    """A number in six digits at most, without zeros that say nothing."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6g", number), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def defaults(rfq: Column, least: Column, bulk: Column) -> list[Column]:
    """rfq_enabled, rfq_min_qty and bulk_only as the seller's policy has them: yes or blank, a number only where asked for."""
    cell = lambda value, name: F.struct(
        value.alias("value"), F.when(value.isNotNull(), "high").otherwise("none").alias("confidence"), F.lit("policy").alias("source"), F.lit(None).alias("note")
    ).cast(CELL.format(kind_of(name))).alias(name)
    return [cell(F.when(rfq, "yes"), "rfq_enabled"), cell(F.when(rfq, least.cast("int")), "rfq_min_qty"), cell(F.when(bulk, "yes"), "bulk_only")]


def edit_fault(field: Column, raw: Column, category: Column) -> Column:
    """Why an edit of ``field`` to ``raw`` can't be made, null if it can; ``category`` is the record's, as it will stand.

    '' empties a cell, but not a title. Codes: locked, unknown_field, not_a_number, negative, free, unknown_category,
    unknown_subcategory, unknown_availability, bad_sizes, bad_hs_code, no_title, not_yes_or_blank.
    """
    value = F.trim(raw)
    number = F.regexp_replace(value, "[, ]", "").try_cast("long")
    shelves = F.array(*map(F.lit, dims.SHELVES))
    whole = F.when(value == "", None).when(number.isNull(), "not_a_number").when(number < 0, "negative").when((field == "price_inr") & (number == 0), "free")
    return (
        F.when(field == LOCKED, "locked")
        .when(~field.isin(*CELLS), "unknown_field")
        .when(field.isin(*WHOLE), whole)
        .when((field == "title") & (value == ""), "no_title")
        .when(value == "", None)
        .when((field == "category_slug") & ~value.isin(*dims.CATEGORIES), "unknown_category")
        .when((field == "subcategory_slug") & ~F.array_contains(shelves, F.concat(F.coalesce(category, F.lit("")), F.lit("/"), value)), "unknown_subcategory")
        .when((field == "availability") & ~value.isin(*AVAILABILITY), "unknown_availability")
        .when((field == "sizes") & ~F.replace(value, F.lit(" "), F.lit("")).rlike(r"^[^,\s]+(?:,[^,\s]+)*$"), "bad_sizes")
        .when((field == "hs_code") & ~value.rlike(r"^\d{4,10}$"), "bad_hs_code")
        .when(field.isin("rfq_enabled", "bulk_only") & (value != "yes"), "not_yes_or_blank")
    )


def incomplete_reasons(triggers: list[str], found: dict[str, Column]) -> Column:
    """The names of ``triggers`` that a record doesn't meet; ``found`` tells for each whether it is there."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(found[t], F.lit(False)), t) for t in triggers]))

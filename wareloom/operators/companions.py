"""The tables beside a listing file: what to review, what failed, the pictures behind each row, and links found for a sheet.

Each has its columns whole and in their order. What a record doesn't have (see ``FACTS``) is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom.operators import ledger, records

#: What a record may have besides its cells, and its kind.
FACTS = {
    "source_url": "string", "title_original": "string", "provenance": "string", "source_price": "double", "source_currency": "string", "fx_rate_used": "double",
    "fx_rate_as_of": "string", "gi_mention_found": "string", "image_method": "string", "image_problem": "string", "image_reason": "string", "fetch_stage": "string",
    "failure_reason": "string", "fetched_at": "timestamp", "rungs_tried": "string", "http_status": "int", "time_spent": "string",
}
#: The columns of each table.
REVIEW = (
    "row_key", "source_url", "title_original", "provenance", "status", "policy_flags", "missing_required", "low_confidence_fields", "source_price", "source_currency",
    "fx_rate_used", "suggested_hs_code", "gi_mention_found", "image_method", "image_problem", "image_reason", "local_image_path", "fetch_stage", "notes",
)
FAILED = ("source_url", "class", "reason", "stage", "http_status", "rungs_tried", "time_spent", "attempted_at")
MANIFEST = ("row_key", "image_order", "local_path", "original_source_url", "hosted_url", "method", "reason", "bytes", "width", "height")
LINKS = ("source_url", "title", "image_count", "width", "height", "method", "reason", "price_found", "currency", "category_guess", "weight_g", "dimensions_cm", "description")


def told(df: DataFrame) -> DataFrame:
    """``df`` as whole records (``records.complete``) with all FACTS, null where it lacks them."""
    return records.complete(df).withColumns({k: F.lit(None).cast(t) for k, t in FACTS.items() if k not in df.columns})


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _paths() -> Column:
    return F.array_join(F.transform("files", lambda f: f["local_path"]), records.BETWEEN)


def review_table(df: DataFrame) -> DataFrame:
    """REVIEW, all text: the records that are listed and want a decision."""
    base = told(df).where(records.needs_review(F.col("gi_mention_found")))
    join = lambda c: F.array_join(c, records.BETWEEN)
    original, code = F.col("title_original"), F.when(records.present("hs_code"), F.col("hs_code")["value"])
    cells = {
        "title_original": F.when(original != F.coalesce(F.col("title")["value"], F.lit("")), original), "policy_flags": join("flags"), "missing_required": join(records.missing_required()),
        "low_confidence_fields": join(records.low_confidence()), "fx_rate_used": F.concat(F.col("fx_rate_used").cast("string"), F.lit(" @ "), F.coalesce("fx_rate_as_of", F.lit(""))),
        "suggested_hs_code": code, "local_image_path": _paths(), "notes": F.coalesce(F.nullif(join("notes"), F.lit("")), "failure_reason"),
    }
    return base.select(*[_text(cells.get(c, F.col(c))).alias(c) for c in REVIEW])


def failed_table(df: DataFrame, plan: DataFrame) -> DataFrame:
    """FAILED: records that failed, and links of ``plan`` (source_url, outcome, reason, decided_at) that failed or were
    refused and never became a record. A status is the record's, or the one that its reason names."""
    base = told(df)
    own = base.where("status = 'failed'").select(
        "source_url", F.coalesce("failure_reason", F.lit("unknown")).alias("reason"), F.coalesce("fetch_stage", F.lit("")).alias("stage"), "http_status", F.coalesce("rungs_tried", F.lit("")).alias("rungs_tried"),
        F.coalesce("time_spent", F.lit("")).alias("time_spent"), F.col("fetched_at").alias("attempted_at"),
    )
    never = plan.where("outcome in ('failed', 'refused')").join(base.select("source_url").distinct(), "source_url", "left_anti").select(
        "source_url", F.coalesce("reason", F.lit("unknown")).alias("reason"), F.lit("not_attempted").alias("stage"), F.lit(None).cast("int").alias("http_status"), F.lit("").alias("rungs_tried"),
        F.lit("").alias("time_spent"), F.col("decided_at").alias("attempted_at"),
    )
    both = own.unionByName(never)
    named = F.regexp_extract("reason", "^http_([0-9]+)$", 1)
    cells = {"class": ledger.reason_class(F.col("reason")), "http_status": F.coalesce(F.nullif("http_status", F.lit(0)).cast("string"), named), "attempted_at": F.date_format("attempted_at", "yyyy-MM-dd'T'HH:mm:ss")}
    return both.select(*[cells.get(c, F.col(c)).alias(c) for c in FAILED])


def images_table(df: DataFrame, key: str = "row_key", most: int = 10) -> DataFrame:
    """The listing's columns, source_url, the pictures by photograph (``records.with_images``), how they were got, why there
    are none (the problem's word, else the reason), and where they lie."""
    base = told(df)
    pictures = records.with_images(base.select(*[c for c in base.columns if c not in FACTS or c == key]), key, most)
    more = base.select(F.col(key).alias("_key"), _text(F.col("source_url")).alias("source_url"), _text(F.col("image_method")).alias("method"), _text(F.coalesce("image_problem", "image_reason")).alias("reason"), _paths().alias("local_image_path"))
    out = pictures.join(more, F.col(key).eqNullSafe(F.col("_key")), "inner").drop("_key")
    lead = [key, *records.COLUMNS, "source_url"]
    size = ["width", "height"]
    return out.select(*lead, *[c for c in pictures.columns if c not in (*lead, *size)], "method", "reason", *size, "local_image_path")


def manifest_table(df: DataFrame) -> DataFrame:
    """MANIFEST: a row for each file of a record, in their order from 1."""
    rows = told(df).select("row_key", F.posexplode("files").alias("_place", "f"), "image_method", F.coalesce("image_problem", "image_reason").alias("_why"))
    cells = {"image_order": F.col("_place") + 1, "original_source_url": F.col("f.original_url"), "method": _text(F.col("image_method")), "reason": _text(F.col("_why")), "row_key": F.col("row_key")}
    return rows.select(*[cells.get(c, F.col(f"f.{c}") if c not in cells else None).alias(c) for c in MANIFEST])


def links_table(found: DataFrame, index: str, links: str, extra: list[str], least: int = 10) -> DataFrame:
    """A table that fits its owner's: their ``extra`` columns, LINKS (those that ``found`` lacks are empty; image_count is the
    number of links), ``index``, and image_url_1 to the widest row's number of links, ``least`` at any rate. All text is
    safe in a spreadsheet."""
    base = found.withColumns({c: F.lit(None).cast("string") for c in LINKS if c not in found.columns}).withColumn("image_count", F.size(F.coalesce(links, F.array().cast("array<string>"))))
    return records.image_links(base, index, links, [*extra, *LINKS], least)

"""Counts and summaries over outcomes, finds, traces, sheets and edits; partial aggregates combine before every shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batch_stats(outcomes: DataFrame, outcome: str = "outcome") -> DataFrame:
    """One row: how many rows were seen, and how many of each outcome."""
    n = lambda *names: F.count_if(F.col(outcome).isin(*names))
    return outcomes.agg(
        F.count("*").alias("seen"), F.count_if(F.col(outcome).isNotNull()).alias("processed"), n("written").alias("written"), n("needs_human").alias("review"),
        n("failed").alias("failed"), n("refused").alias("refused"), n("duplicate", "invalid").alias("skipped"),
    )


def find_stats(found: DataFrame) -> DataFrame:
    """One row over finds (image_count, low_res, reason, cached): with and without a photo, in low resolution, failed, cached."""
    failed, some = F.col("reason").isNotNull(), F.col("image_count") > 0
    return found.agg(
        F.count("*").alias("rows"), F.count_if(some & ~failed).alias("with_photo"), F.count_if(~some & ~failed).alias("without_photo"),
        F.count_if(some & F.col("low_res")).alias("low_res"), F.count_if(failed).alias("failed"), F.count_if("cached").alias("cached"),
    )


def failures_since_success(attempts: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """(key, failures, last_failure): failures of each key after its last success; one success clears them."""
    place = F.struct(*order)
    marked = attempts.withColumn("_bad", failed).withColumn("_at", place)
    last = marked.groupBy(key).agg(F.max(F.when(~F.col("_bad"), F.col("_at"))).alias("_ok"))
    later = marked.join(last, key).where("_bad and (_ok is null or _at > _ok)")
    return later.groupBy(key).agg(F.count("*").alias("failures"), F.max(order[0]).alias("last_failure"))


def zero_filled(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """(column, n): rows of each of ``names``, 0 for those without any."""
    known = rows.sparkSession.createDataFrame([(n,) for n in names], f"{column} string")
    counted = rows.groupBy(column).agg(F.count("*").alias("n"))
    return known.join(counted, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def sheet_summary(sheet: DataFrame) -> DataFrame:
    """One row over a master sheet (job_id, added_at): rows, jobs that added any, first and last addition."""
    return sheet.agg(
        F.count("*").alias("rows"), F.countDistinct(F.nullif(F.col("job_id"), F.lit(""))).alias("jobs"), F.min("added_at").alias("first_added"), F.max("added_at").alias("last_added")
    )


def edit_counts(edits: DataFrame) -> DataFrame:
    """One row over edits (row_key, field, edit_id): cells that are edited now, and rows with any."""
    cells = edits.select("row_key", "field").distinct()
    return cells.agg(F.count("*").alias("pending_edits"), F.countDistinct("row_key").alias("rows_edited"))


def cell_table(records: DataFrame, key: str, fields: list[str], edits: DataFrame, locked: list[str]) -> DataFrame:
    """(key, field, value, original, edited, locked): one row per cell, the latest edit on top of what was read."""
    long = records.select(key, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot([key], fields, "field", "original")
    last = edits.groupBy(key, "field").agg(F.max_by("value", F.struct("edited_at", "edit_id")).alias("edit"))
    joined = long.join(last, [key, "field"], "left")
    value = F.when(F.col("edit").isNull(), F.col("original")).otherwise(F.nullif(F.col("edit"), F.lit("")))
    return joined.select(key, "field", value.alias("value"), "original", F.col("edit").isNotNull().alias("edited"), F.col("field").isin(*locked).alias("locked"))


def reason_summary(reasons: Column) -> Column:
    """What spoke against a row's pictures, each reason once in order; no_candidates for a row without any."""
    return F.when(F.size(reasons) == 0, "no_candidates").otherwise(F.array_join(F.array_distinct(F.filter(reasons, lambda r: r.isNotNull())), ", "))


def preflight(plan: DataFrame, history: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """(host, links, refused, reason): accepted links by host, with what the host's recent history says."""
    recent = history.where((F.col("last_seen") >= now - F.make_dt_interval(F.lit(days))) & (F.col("last_seen") <= now))
    hosts = plan.where("status = 'ok'").groupBy("host").agg(F.count("*").alias("links"))
    return hosts.join(recent.select("host", "reason", "count"), "host", "left").select("host", "links", F.coalesce("count", F.lit(0)).alias("refused"), "reason")


def kept_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``rows`` with one row per ``key``, the first by ``order``: what insert-if-absent leaves."""
    cells = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.min_by(cells, order).alias("_row")).select("_row.*")


def by_content(rows: DataFrame, content: str, order: str) -> DataFrame:
    """``rows`` with sha256, one row per content, the first by ``order``."""
    return kept_first(rows.withColumn("sha256", F.sha2(content, 256)), "sha256", order)

"""Image candidates: identity, ranking, the predicate chain and the upload gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wareloom.functions import urls

SOURCES = ("structured", "og", "src")
HARD_MINIMUM, LISTABLE = 400, 800


def best_copies(shots: DataFrame) -> DataFrame:
    """The largest copy of each photograph of a page (the first of equals), with photo and area."""
    named = shots.withColumn("photo", urls.photo_identity(F.col("url"))).withColumn("area", F.col("width") * F.col("height"))
    best = Window.partitionBy("page", "photo").orderBy(F.desc("area"), "dom_index")
    return named.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def ranked(shots: DataFrame) -> DataFrame:
    """``shots`` with rank within their page: listable size first, then the longer side, source and place."""
    wide, high = F.col("width") >= LISTABLE, F.col("height") >= LISTABLE
    tier = F.when(wide & high, 0).when(wide | high, 1).otherwise(2)
    source = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source")), F.lit(0)), F.lit(9))
    order = Window.partitionBy("page").orderBy(tier, -F.greatest("width", "height"), source, "dom_index")
    return shots.withColumn("rank", F.row_number().over(order).cast("long"))


def judged(shots: DataFrame) -> DataFrame:
    """``shots`` with the reason of the first predicate that fails, null if none does; later ones aren't evaluated."""
    reason = (
        F.when(~F.col("url").startswith("https://"), "bad_url")
        .when((F.col("width") == 0) | (F.col("height") == 0), "not_decodable")
        .when((F.col("width") < HARD_MINIMUM) | (F.col("height") < HARD_MINIMUM), "below_hard_minimum")
        .when((F.col("width") < LISTABLE) | (F.col("height") < LISTABLE), "below_min_dimensions")
    )
    return shots.withColumn("reason", reason)


def walked(judged_: DataFrame, enough: int) -> DataFrame:
    """The candidates that are tried, in order, until ``enough`` have passed."""
    before = Window.partitionBy("page").orderBy("dom_index").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum(F.col("reason").isNull().cast("int")).over(before), F.lit(0))
    return judged_.withColumn("_passed", passed).where(F.col("_passed") < enough).drop("_passed")


def gate_check(judged_: DataFrame) -> DataFrame:
    """One row: pages, uploads, and uploads of pages that had a photo that passes (always 0)."""
    per = judged_.groupBy("page").agg(
        (F.count_if(F.col("reason").isNull()) > 0).alias("tier1_passed"), (F.count_if(F.col("reason") == "below_min_dimensions") > 0).alias("low")
    )
    gate = per.withColumn("do_upload", F.expr("not tier1_passed and not low"))
    return gate.agg(F.count("*").alias("pages"), F.count_if("do_upload").alias("uploads"), F.count_if(F.expr("do_upload and tier1_passed")).alias("violations"))

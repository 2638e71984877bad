"""Which rows a person must look at, and in what order they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def review(cells: DataFrame, key: str, graded: str, plain: str, required: list[str]) -> DataFrame:
    """``key``, missing, unsure, depths and needs_review of rows with a ``graded`` cell (its grade in confidence) and a
    ``plain`` one; ``required`` names the cells that must be there."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in required]))
    there, low = F.col(graded).isNotNull(), F.col("confidence").isin("low", "medium")
    grade = F.when(~there, "-")
    for name, digit in (("high", "3"), ("medium", "2"), ("low", "1")):
        grade = grade.when(F.col("confidence") == name, digit)
    return cells.select(
        key, F.array_join(missing, " | ").alias("missing"), F.when(there & low, F.concat(F.lit(f"{graded}:"), "confidence")).otherwise("").alias("unsure"),
        F.concat(grade.otherwise("0"), F.when(F.col(plain).isNull(), "-").otherwise("3")).alias("depths"), (~there | F.col(plain).isNull() | low).alias("needs_review"),
    )


def positions(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with a dense position by the numeric column ``order``, without gathering them in one task.

    Slices between quantiles of ``order``, so of about the same number of rows however its values lie, are numbered each
    for itself, after the counts of the slices before. Rows with the same value share a slice.
    """
    slices = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    bounds = sorted(set(rows.approxQuantile(order, [k / slices for k in range(1, slices)], 0.1 / slices)))
    place = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    cut = rows.withColumn("_s", place)
    before = Window.partitionBy(F.lit(0)).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("_s").agg(F.count("*").alias("_n")).select("_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    own = F.row_number().over(Window.partitionBy("_s").orderBy(order)) - 1
    return cut.withColumn("_o", own).join(F.broadcast(base), "_s").select((F.col("_o") + F.col("_b")).alias("position"), *rows.columns)

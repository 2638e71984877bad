"""Delimited files with quoted cells over several lines, read by ranges of bytes, however large a file is.

Lines are read by Spark's text reader, which splits files. Whether a line starts inside a quoted cell isn't known to the
task that reads it, so each line is read both ways: what state it ends in if it starts outside one, and if it starts
inside. Such pairs compose; each range of a file is one pair, so the state at the start of every range comes from a
running composition over a file's ranges, one short row each, and then the state at the start of every line within its
range. Lines that start outside begin a record. Only records of several lines are gathered; one parser call per record
does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: States of reading: outside a quoted cell, inside, behind a quote that may close it, outside at the start of a line.
_OUT, _IN, _QUOTE, _START = 0, 1, 2, 3


def _ends(line: Column, sep: str, begins: int) -> Column:
    """1 if a line that starts in a state ends inside a quoted cell, else 0. A quote opens a cell at its beginning alone;
    a doubled one inside is none; what stands behind a closing one runs to the next delimiter."""
    parts = F.split(line, '"', -1)
    before = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.struct((p == "").alias("empty"), F.endswith(p, F.lit(sep)).alias("cell")))

    def quote(state: Column, p: Column) -> Column:
        opens = p["cell"] | (p["empty"] & state.isin(_START, _QUOTE))
        return F.when(state == _IN, F.lit(_QUOTE)).when(opens, F.lit(_IN)).otherwise(F.lit(_OUT))

    return (F.aggregate(before, F.lit(begins), quote) == _IN).cast("int")


def _running(frame: DataFrame, by: list[str], order: str) -> DataFrame:
    """``frame`` (out, in: the state that each row ends in) with _if_out and _if_in: the state before each row, for either
    state before the first of its group: the last row that ends alike both ways decides, and each one after it that
    turns the state round."""
    window = Window.partitionBy(*by).orderBy(order)
    turns = (F.col("out") > F.col("in")).cast("int")
    frame = frame.withColumn("_turns", F.sum(turns).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    alike = F.when(F.col("out") == F.col("in"), F.struct(F.col("out").alias("v"), F.col("_turns").alias("n")))
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    frame = frame.withColumns({"_set": F.last(alike, ignorenulls=True).over(earlier), "_before": F.coalesce(F.lag("_turns").over(window), F.lit(0))})
    known = (F.col("_set.v") + F.col("_before") - F.col("_set.n")) % 2
    return frame.withColumns({"_if_out": F.coalesce(known, F.col("_before") % 2).cast("int"), "_if_in": F.coalesce(known, (1 + F.col("_before")) % 2).cast("int")}).drop("_turns", "_set", "_before")


def records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(file, block, at, record, first) of all records of the files under ``path``: block and at order those of a file,
    first marks a file's first. Lines end with \\n or \\r\\n; empty records are dropped."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )
    quoted = F.contains("line", F.lit('"'))
    lines = lines.withColumns({
        "out": F.when(quoted, _ends(F.regexp_replace("line", "\r$", ""), sep, _START)).otherwise(0),
        "in": F.when(quoted, _ends(F.regexp_replace("line", "\r$", ""), sep, _IN)).otherwise(1),
    })
    lines = _running(lines, ["file", "block"], "at")
    # a block as one row: the state it ends in, either way, from its last line
    over = lambda start: F.when(F.col(start) == 1, F.col("in")).otherwise(F.col("out"))
    last = F.max_by(F.struct(over("_if_out").alias("out"), over("_if_in").alias("in")), "at").alias("x")
    first_out, first_in = (F.max(F.when(F.col(c) == 0, F.col("at"))).alias(n) for c, n in (("_if_out", "_start_out"), ("_if_in", "_start_in")))
    blocks = lines.groupBy("file", "block").agg(last, first_out, first_in).select("file", "block", "x.out", "x.in", "_start_out", "_start_in")
    blocks = _running(blocks, ["file"], "block").withColumn("state", F.col("_if_out"))
    order = Window.partitionBy("file").orderBy("block")
    start = F.when(F.col("state") == 1, F.col("_start_in")).otherwise(F.col("_start_out"))
    held = F.last(F.when(start.isNotNull(), F.struct("block", start.alias("at"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "block", "state", held.alias("held"), F.coalesce(F.lead("state").over(order), F.lit(0)).alias("next_state"))
    lines = lines.join(blocks, ["file", "block"]).withColumn("begins", F.when(F.col("state") == 1, F.col("_if_in")).otherwise(F.col("_if_out")) == 0)
    window = Window.partitionBy("file", "block").orderBy("at")
    lines = lines.withColumns({
        "alone": F.col("begins") & F.coalesce(F.lead("begins").over(window), F.col("next_state") == 0),
        "own": F.coalesce(F.last(F.when(F.col("begins"), F.struct("block", "at")), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0)), F.col("held")),
        "first": (F.col("block") == 0) & (F.lag("at").over(window).isNull()),
    })
    single = lines.where("alone").select("file", "block", "at", F.col("line").alias("record"), "first")
    parts = lines.where("not alone and own is not null").groupBy("file", F.col("own.block").alias("block"), F.col("own.at").alias("at"))
    whole = parts.agg(
        F.sort_array(F.collect_list(F.struct(F.col("block").alias("b"), F.col("at").alias("a"), "line"))).alias("x"), F.max("first").alias("first")
    ).select("file", "block", "at", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("record"), "first")
    both = single.unionByName(whole)
    text = F.regexp_replace(F.when(F.col("first"), F.regexp_replace("record", "^﻿", "")).otherwise(F.col("record")), "\r$", "")
    return both.withColumn("record", text).where("record <> ''")


def read_quoted(spark: SparkSession, path: str, columns: list[str], sep: str = ",", header: bool = True) -> DataFrame:
    """The rows of delimited files as text columns, as Spark's reader of whole files gives them, in any number of tasks.
    A record with fewer cells has nulls for the others; with ``header`` each file's first record isn't a row."""
    found = records(spark, path, sep)
    found = found.where("not first") if header else found
    schema = ", ".join(f"c{k} string" for k in range(len(columns)))
    cells = F.from_csv("record", schema, {"sep": sep, "escape": '"', "quote": '"'}).alias("x")
    return found.select(cells).select(*[F.col(f"x.c{k}").alias(c) for k, c in enumerate(columns)])

"""People's edits of records as a log of events, folded to any moment, and many edits at once, judged row by row.

An event is (event_id, at, row_key, kind, field, value): set gives a field a value, undo takes back the last set of it that
stands, clear takes back all of them. Nothing is deleted: what was taken back can be seen at an earlier moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wareloom.operators.records import CELLS, edit_fault

EVENTS = "event_id long, at timestamp, row_key string, kind string, field string, value string"
KINDS = ("set", "undo", "clear")


def standing(log: DataFrame, moment: Column | None = None) -> DataFrame:
    """(row_key, field, value, event_id): of each row's field the set event that stands at ``moment`` (at or before it; the
    end by default), if any does. Events count in the order of their time and number; an undo that finds nothing to take
    back does nothing, events of other kinds or without a row, field or time don't count.

    Sets and undos are brackets: a set stands if no later event goes below the depth that it reached. So no field's
    events are gathered; each is looked at in two sorted passes.
    """
    events = log.where(F.col("kind").isin(*KINDS) & F.col("row_key").isNotNull() & F.col("field").isNotNull() & F.col("at").isNotNull())
    events = events if moment is None else events.where(F.col("at") <= moment)
    order = Window.partitionBy("row_key", "field").orderBy("at", "event_id")
    upto, behind = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(1, Window.unboundedFollowing)
    events = events.withColumn("_later_clears", F.coalesce(F.sum((F.col("kind") == "clear").cast("int")).over(behind), F.lit(0)))
    events = events.where("_later_clears = 0 and kind <> 'clear'")
    events = events.withColumn("_sum", F.sum(F.when(F.col("kind") == "set", 1).otherwise(-1)).over(upto))
    # an undo below zero does nothing: the depth is counted from the lowest sum so far
    events = events.withColumn("_depth", F.col("_sum") - F.least(F.min("_sum").over(upto), F.lit(0)))
    events = events.withColumn("_least", F.min("_depth").over(behind))
    kept = events.where("kind = 'set' and (_least is null or _least >= _depth)")
    return kept.groupBy("row_key", "field").agg(F.max_by(F.struct("value", "event_id"), F.struct("at", "event_id")).alias("x")).select("row_key", "field", "x.*")


def edited(records: DataFrame, edits: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``records`` (plain columns) with what stands (``standing``) on top; '' empties a cell."""
    wide = edits.groupBy("row_key").pivot("field", fields).agg(F.max("value"))
    wide = wide.select(F.col("row_key").alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = records.join(wide, F.col(key).cast("string") == F.col("_key"), "left")
    cells = {f: F.when(F.col(f"_{f}").isNull(), F.col(f).cast("string")).otherwise(F.nullif(F.col(f"_{f}"), F.lit(""))) for f in fields}
    return joined.select(*[cells.get(c, F.col(c)).alias(c) for c in records.columns])


def judged(records: DataFrame, log: DataFrame, requests: DataFrame, key: str, category: str = "category_slug") -> DataFrame:
    """``requests`` (request_id, row_key, field, value) with fault: null for those that can be made.

    Each row is judged as it will stand: with the edits that stand and the request's on top, so a category and a shelf
    of it may come together, and a new category makes an older shelf wrong. If anything of a row is at fault, nothing of
    the request is made in that row; all its fields carry the first fault (by the order of the cells). A row that isn't
    among ``records`` has the fault no_such_row. A field that a request names twice has its last value by order of text.
    """
    asked = requests.groupBy("request_id", "row_key", "field").agg(F.max("value").alias("value"))
    rows = asked.select("request_id", "row_key").distinct()
    old = standing(log).select("row_key", "field", "value")
    kept = rows.join(old, "row_key").join(asked.select("request_id", "row_key", "field"), ["request_id", "row_key", "field"], "left_anti")
    both = asked.withColumn("new", F.lit(True)).unionByName(kept.select("request_id", "row_key", "field", "value").withColumn("new", F.lit(False)))
    known = records.select(F.col(key).cast("string").alias("row_key"), F.col(category).alias("_own"), F.lit(True).alias("_there")).dropDuplicates(["row_key"])
    chosen = both.where(F.col("field") == category).groupBy("request_id", "row_key").agg(F.max("value").alias("_chosen"))
    full = both.join(known, "row_key", "left").join(chosen, ["request_id", "row_key"], "left")
    as_it_will_be = F.when(F.col("_chosen").isNull(), F.col("_own")).otherwise(F.trim("_chosen"))
    fault = F.when(F.col("_there").isNull(), "no_such_row").otherwise(edit_fault(F.col("field"), F.coalesce("value", F.lit("")), as_it_will_be))
    place = F.array_position(F.array(*map(F.lit, CELLS)), F.col("field"))
    full = full.select("request_id", "row_key", "field", "value", "new", fault.alias("own"), place.alias("place"))
    first = full.where("own is not null").groupBy("request_id", "row_key").agg(F.min_by("own", F.struct("place", "field")).alias("fault"))
    return full.where("new").join(first, ["request_id", "row_key"], "left").select("request_id", "row_key", "field", "value", "fault")


def applied(judged_: DataFrame, at: Column, first_id: int) -> DataFrame:
    """The events of the requests without a fault, numbered from ``first_id`` on without regard to gaps."""
    good = judged_.where("fault is null")
    # as many numbers as there may be: the position within a task and the task
    number = F.monotonically_increasing_id() + F.lit(first_id)
    return good.select(number.alias("event_id"), at.alias("at"), "row_key", F.lit("set").alias("kind"), "field", F.trim(F.coalesce("value", F.lit(""))).alias("value"))


def refused(judged_: DataFrame) -> DataFrame:
    """(request_id, row_key, fault): the rows in which nothing of a request was made."""
    return judged_.where("fault is not null").select("request_id", "row_key", "fault").distinct()

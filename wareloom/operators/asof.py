"""Joins by time: for each row the entry of its key that was the latest at the row's time, while it was valid.

Time is cut into buckets of a fraction of the validity. The last entry of each bucket is carried into the buckets that it
may still be valid in, one entry a key and bucket; then rows and entries of a (key, bucket) stand together, and one
sorted pass finds each row's entry. So a key with any number of rows is many groups, and no row meets all entries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wareloom.functions.values import let

#: Buckets that a validity is cut into.
PARTS = 16


def asof(
    rows: DataFrame, entries: DataFrame, keys: list[str], time: str, valid: float, entry_time: str | None = None, order: list[str] | None = None,
    name: str = "entry", parts: int = PARTS,
) -> DataFrame:
    """``rows`` with ``name``: struct of the columns of ``entries``, or null.

    The entry has the row's ``keys``, the latest ``entry_time`` (``time`` by default) that is at or before the row's
    ``time``, and is at most ``valid`` seconds older; both ends count. Of entries of the same time the last by ``order``
    (columns of ``entries``; by all columns where it leaves ties) counts. Rows and entries without a key or a time match
    nothing; rows stay, repeated ones too. A column of ``rows`` called ``name`` is replaced.
    """
    at = entry_time or time
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    span = max(1, int(valid * 1_000_000))
    width = max(1, -(-span // parts))
    reach = -(-span // width)
    bucket = lambda t: F.call_function("div", t - F.pmod(t, F.lit(width)), F.lit(width)).cast("long")
    keyed = [F.col(f"`{k}`") for k in keys]
    own = [c for c in rows.columns if c != name]
    none = F.lit(False)
    for k in keys:
        none = none | F.col(f"`{k}`").isNull()

    entry = F.struct(*[F.col(f"`{c}`") for c in entries.columns])
    last = [F.col(f"`{c}`") for c in order or ()]
    found = entries.where(~none & F.col(f"`{at}`").isNotNull()).select(
        *[k.alias(f"_k{i}") for i, k in enumerate(keyed)], micros(F.col(f"`{at}`")).alias("_t"), F.struct(*last, entry).alias("_order"), entry.alias("_e")
    )
    found = found.withColumn("_b", bucket(F.col("_t")))
    ids = [f"_k{i}" for i in range(len(keys))]
    # one entry a bucket goes on, to where it can still be valid
    carried = found.groupBy(*ids, "_b").agg(F.max_by(F.struct("_t", "_order", "_e"), F.struct("_t", "_order")).alias("x"))
    carried = carried.select(*ids, F.explode(F.sequence(F.col("_b") + 1, F.col("_b") + reach)).alias("_b"), "x")
    carried = carried.groupBy(*ids, "_b").agg(F.max_by("x", F.struct("x._t", "x._order")).alias("x")).select(*ids, "_b", "x.*")
    known = found.select(*ids, "_b", "_t", "_order", "_e").unionByName(carried).withColumns({"_side": F.lit(0), "_r": F.lit(None).cast(_struct_of(rows, own))})

    asked = rows.select(*[k.alias(f"_k{i}") for i, k in enumerate(keyed)], micros(F.col(f"`{time}`")).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("_r"), none.alias("_none"))
    asked = asked.withColumn("_none", F.col("_none") | F.col("_t").isNull())
    bare = asked.where("_none").select("_r", F.lit(None).cast(_struct_of(entries, entries.columns)).alias("_e"))
    empty = {"_order": known.schema["_order"].dataType, "_e": known.schema["_e"].dataType}
    there = asked.where("not _none").select(*ids, bucket(F.col("_t")).alias("_b"), "_t", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()], F.lit(1).alias("_side"), "_r")
    both = known.unionByName(there)
    window = Window.partitionBy(*ids, "_b").orderBy("_t", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("_side") == 0, F.struct("_t", "_e")), ignorenulls=True).over(window)
    joined = both.select("_side", "_t", "_r", latest.alias("_l")).where("_side = 1")
    valid_now = let(F.col("_l"), lambda x: F.when(F.col("_t") - x["_t"] <= span, x["_e"]))
    return joined.select("_r", valid_now.alias("_e")).unionByName(bare).select(*[F.col(f"_r.`{c}`").alias(c) for c in own], F.col("_e").alias(name))


def _struct_of(frame: DataFrame, columns: list[str]):
    return frame.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("x")).schema["x"].dataType


def known_bad(found: Column, least: int, count: str) -> Column:
    """Whether a valid entry says that its host failed ``least`` times or more."""
    return F.coalesce(found[count] >= least, F.lit(False))

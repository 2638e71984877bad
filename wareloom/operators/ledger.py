"""Relational work over plans, records, edits, caches and the master sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wareloom.functions import dims, urls


def plan(links: DataFrame) -> DataFrame:
    """``links`` (line, raw) with canonical, status (ok, duplicate, invalid) and first_line of the same product."""
    named = links.withColumn("canonical", F.when(urls.scheme("raw").isin("http", "https") & (urls.host("raw") != ""), urls.canonical(F.col("raw"))))
    # lines that are no link have no product to be joined on, so they stay out of the join
    known = named.where("canonical is not null")
    joined = known.join(known.groupBy("canonical").agg(F.min("line").alias("first_line")), "canonical")
    status = F.when(F.col("line") > F.col("first_line"), "duplicate").otherwise("ok")
    bad = named.where("canonical is null").select("line", "raw", "canonical", F.lit("invalid").alias("status"), F.lit(None).cast(links.schema["line"].dataType).alias("first_line"))
    return joined.select("line", "raw", "canonical", status.alias("status"), "first_line").unionAll(bad)


def estimate(plan_: DataFrame, delay: float = 2.0, concurrency: int = 5) -> DataFrame:
    """accepted, hosts, low and high: seconds that a run will take, bound by the busiest host."""
    hosts = plan_.where("status = 'ok'").groupBy(urls.host(F.col("canonical")).alias("host")).agg(F.count("*").alias("n"))
    low = F.greatest(F.coalesce(F.max("n"), F.lit(0)) * delay, F.coalesce(F.sum("n"), F.lit(0)) / concurrency * 1.5)
    sums = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("accepted"), F.count("*").alias("hosts"), low.alias("raw"))
    return sums.select("accepted", "hosts", F.col("raw").cast("long").alias("low"), (F.col("raw") * 2.2).cast("long").alias("high"))


def reason_class(reason: Column) -> Column:
    """refused or failed; an unknown reason failed."""
    return F.when(reason.isin([r for r, (k, _) in dims.REASONS.items() if k == "refused"]), "refused").otherwise("failed")


def accounting(outcomes: DataFrame) -> DataFrame:
    """One row: counts of each outcome and whether they add up to the inputs that aren't duplicate or invalid."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    counted = outcomes.agg(
        F.count("*").alias("total"), F.count_if(F.col("outcome").isNull()).alias("pending"), n("written", "needs_human").alias("listed"),
        n("refused").alias("refused"), n("failed").alias("failed"), n("duplicate", "invalid").alias("set_aside"),
    )
    return counted.withColumn("balanced", F.expr("pending = 0 and listed + refused + failed = total - set_aside"))


def overlay(records: DataFrame, edits: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``records`` with the latest edit of each field on top; an edit to '' makes the cell absent."""
    latest = edits.groupBy(key).pivot("field", fields).agg(F.max_by("value", F.struct("edited_at", "edit_id")))
    latest = latest.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = records.join(latest, key, "left")
    cells = {f: F.when(F.col(f"_{f}").isNull(), F.col(f)).otherwise(F.nullif(F.col(f"_{f}"), F.lit(""))) for f in fields}
    return joined.select(*[cells.get(c, F.col(c)).alias(c) for c in records.columns])


def master_merge(master: DataFrame, new: DataFrame, policy: str) -> DataFrame:
    """The master sheet (position, canonical, title, price) after adding ``new`` (seq, canonical, title, price).

    skip keeps what is there, replace puts the latest row of a product in its place, append adds every row. An empty
    canonical never matches.
    """
    if policy == "append":
        kept, added = master, new
    else:
        # rows without a canonical are never grouped: there may be any number of them
        keyed, bare = new.where("canonical <> ''"), new.where("coalesce(canonical, '') = ''")
        pick = F.min_by if policy == "skip" else F.max_by
        one = keyed.groupBy("canonical").agg(pick(F.struct("seq", "title", "price"), "seq").alias("x")).select("x.seq", "canonical", "x.title", "x.price")
        known = master.where("canonical <> ''").select("canonical").distinct()
        kept, added = master, one.join(known, "canonical", "left_anti").select(*new.columns).unionAll(bare)
        if policy == "replace":
            fresh_ = one.select("canonical", F.col("title").alias("_t"), F.col("price").alias("_p"), F.lit(True).alias("_new"))
            placed = master.where("canonical <> ''").join(fresh_, "canonical", "left")
            kept = placed.select(
                "position", "canonical", F.when(F.col("_new"), F.col("_t")).otherwise(F.col("title")).alias("title"), F.when(F.col("_new"), F.col("_p")).otherwise(F.col("price")).alias("price")
            ).unionAll(master.where("coalesce(canonical, '') = ''").select("position", "canonical", "title", "price"))
    # a running number after the sheet's last one, by the input's own order
    offset = master.agg(F.coalesce(F.max("position") + 1, F.lit(0)).alias("next"))
    added = added.crossJoin(F.broadcast(offset)).select((F.col("next") + F.col("seq")).alias("position"), "canonical", "title", "price")
    return kept.select("position", "canonical", "title", "price").unionByName(added)


def fresh(cache: DataFrame, now: Column, days: int, at: str) -> DataFrame:
    """Rows of a cache that are at most ``days`` old at ``now``."""
    return cache.where((F.col(at) >= now - F.make_dt_interval(F.lit(days))) & (F.col(at) <= now))


def longest_refusals(attempts: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """(key, longest, current): runs of failures without a success between, per key."""
    seen = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = attempts.withColumn("bad", failed).withColumn("island", F.sum((~F.col("bad")).cast("int")).over(seen))
    per = runs.groupBy(key, "island").agg(F.count_if("bad").alias("n"))
    return per.groupBy(key).agg(F.max("n").alias("longest"), F.max_by("n", "island").alias("current"))


def contiguous_prefix(done: DataFrame, index: str) -> DataFrame:
    """Rows before the first missing index: what an ordered writer may have put out."""
    later = done.select((F.col(index) + 1).alias("gap")).join(done.select(F.col(index).alias("gap")), "gap", "left_anti")
    starts = done.agg(F.min(index).alias("start"))
    stop = later.agg(F.min("gap").alias("stop")).crossJoin(starts).select(F.when(F.col("start") == 0, F.col("stop")).otherwise(0).alias("stop"))
    return done.crossJoin(F.broadcast(stop)).where(F.col(index) < F.col("stop")).drop("stop")

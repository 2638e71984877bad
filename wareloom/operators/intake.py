"""Before and after a run: what a paste will become, and which rows are worth another try at their pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wareloom.functions import urls
from wareloom.operators.records import complete

#: Links and leftovers that a preview shows; more are counted alone.
MOST_LINKS, MOST_UNPARSED = 250, 100


def previews(found: DataFrame, key: str, most_links: int = MOST_LINKS, most_unparsed: int = MOST_UNPARSED) -> DataFrame:
    """One row per paste of ``found`` (``sources.links.scan_texts``): key, accepted (products), duplicates, unparsed, hosts,
    links and leftovers (the first ones, in their order, each with its line), and truncated, whether there are more.

    A link is a duplicate if an earlier one of the same paste is the same product; links show once per product. Counts
    are of the whole paste. A paste without any find has no row.
    """
    kind = F.when(F.col("kind") == "unparsed", "unparsed").otherwise("link")
    rows = found.select(key, "line_no", "pos", "text", kind.alias("kind"), F.when(kind == "link", urls.canonical(F.col("text"))).alias("canonical"))
    place = F.struct("line_no", "pos", "text")
    links = rows.where("kind = 'link'").groupBy(key, "canonical").agg(F.min(place).alias("x"), F.count("*").alias("times")).withColumn("host", urls.host(F.col("canonical")))
    order = Window.partitionBy(key).orderBy("x")
    item = lambda most: F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.struct("x.line_no", "x.pos", "x.text"))))
    shown = links.withColumn("n", F.row_number().over(order)).groupBy(key).agg(
        F.count("*").alias("accepted"), (F.sum("times") - F.count("*")).alias("duplicates"), F.count_distinct("host").alias("hosts"), item(most_links).alias("links")
    )
    left = rows.where("kind = 'unparsed'").select(key, place.alias("x")).withColumn("n", F.row_number().over(order)).groupBy(key).agg(F.count("*").alias("unparsed"), item(most_unparsed).alias("leftovers"))
    both = shown.join(left.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")), "full")
    plain = lambda items: F.transform(F.coalesce(items, F.array().cast("array<struct<line_no:int,pos:int,text:string>>")), lambda x: F.struct(x["line_no"].alias("line_no"), x["text"].alias("text")))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    more = (F.coalesce("accepted", F.lit(0)) > most_links) | (F.coalesce("unparsed", F.lit(0)) > most_unparsed)
    return both.select(F.coalesce(key, "_key").alias(key), *[count(c) for c in ("accepted", "duplicates", "unparsed", "hosts")], plain("links").alias("links"), plain("leftovers").alias("leftovers"), more.alias("truncated"))


def rehostable(records: DataFrame) -> DataFrame:
    """Records without a listed picture that have candidates, as they go into another try: plainly ok, without notes and
    files. Failed ones take part, too; the others stay out."""
    base = complete(records).where((F.coalesce("image_url", F.lit("")) == "") & (F.size("image_candidates") > 0))
    none = F.array().cast("array<string>")
    return base.withColumns({"status": F.lit("ok"), "notes": none, "files": F.array().cast(base.schema["files"].dataType)})

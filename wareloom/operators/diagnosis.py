"""Why a page came out as it did: where each picture was found and what it was dropped for, and one nested row of checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wareloom.functions import texts, urls
from wareloom.operators import checks
from wareloom.operators.extract import RULES

#: Answers of a check; one that didn't run says so.
YES, NO, NOT_REACHED = "yes", "no", "not reached"
#: What a picture is dropped for, in the order of the tests.
DROPS = ("no link", "furniture", "repeated", "another product's")


def answer(value: Column) -> Column:
    """A check's answer: null is one that didn't run, never a no."""
    return F.when(value.isNull(), NOT_REACHED).when(value, YES).otherwise(NO)


def of_product(url: Column, page_url: Column) -> Column:
    """Whether a picture's link shares words with its page's path; one that the page carries itself is its own."""
    return F.startswith(url, F.lit("data:")) | (texts.affinity(url, texts.slug_tokens(page_url)) > 0)


def products_own(found: DataFrame, key: str = "page_id", url: str = "url", page_url: str = "page_url") -> DataFrame:
    """``found`` without pictures that aren't the product's own, on pages where any is; elsewhere all stay. Order and
    other columns are as they were; a picture without a page's link stays."""
    own = of_product(F.col(url), F.col(page_url))
    marked = found.withColumn("_own", own)
    # a page's pictures are a page's worth; ``found`` is read once, as what it is made of costs far more than this
    named = F.max(F.coalesce(F.col(page_url).isNotNull() & F.col("_own"), F.lit(False))).over(Window.partitionBy(key))
    return marked.withColumn("_named", named).where("coalesce(_own, true) or not _named").drop("_own", "_named")


def provenance(evidence: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, dom_index, rule, raw, url, dropped): every picture that a page's evidence has, the whole link that came of it,
    and the first test of DROPS that it failed; null for one that was kept."""
    raw = evidence.select(key, F.col("url").alias("_page_url"), "base", F.posexplode("images").alias("dom_index", "x")).select(key, "_page_url", "base", "dom_index", "x.rule", F.col("x.url").alias("raw"))
    shots = raw.withColumn("url", urls.without_params(texts.absolute(F.col("base"), F.col("raw")), urls.IMAGE_TRACKING))
    early = F.when(F.col("url").isNull(), DROPS[0]).when(texts.rejected(F.col("url")), DROPS[1])
    # a page's pictures are a page's worth; dealt by page once, they are where both windows need them
    shots = shots.withColumn("_early", early).repartition(key)
    same = Window.partitionBy(key, "url", F.col("_early").isNull()).orderBy("dom_index")
    shots = shots.withColumn("_early", F.coalesce("_early", F.when(F.row_number().over(same) > 1, DROPS[2])))
    alive = F.col("_early").isNull()
    own = alive & F.coalesce(of_product(F.col("url"), F.col("_page_url")), F.lit(False))
    shots = shots.withColumn("_own", own).withColumn("_named", F.max("_own").over(Window.partitionBy(key)))
    dropped = F.coalesce("_early", F.when(F.col("_named") & ~F.col("_own") & F.col("_page_url").isNotNull(), DROPS[3]))
    return shots.select(key, "dom_index", "rule", "raw", "url", dropped.alias("dropped"))


def walked(ordered: DataFrame, trace: DataFrame, key: str = "page_id") -> DataFrame:
    """Links in the order in which they are tried (``extract.ordered``), each with the rule that found it and its place on
    the page; a link that was made from another has neither."""
    kept = trace.where("dropped is null").groupBy(key, "url").agg(F.min(F.struct("dom_index", "rule")).alias("x")).select(key, "url", "x.*")
    return ordered.join(kept, [key, "url"], "left")


def reports(pages: DataFrame, trace: DataFrame, buy_box: Column, has_product: Column, key: str = "page_id") -> DataFrame:
    """One row per page of ``pages`` (key, url, html; a null html is a page that never came): key, url, and

    - shape: struct of answers (arrived, bot_check, sign_in, gone, product) and the verdict; a page that didn't come was
      asked nothing, one that was turned away wasn't asked what comes after that test;
    - images: struct of collected (an answer), found, kept, by_rule and by_drop (arrays in the order of the rules and
      tests, each with its count, 0 too) from ``trace`` (``provenance``); a page that was turned away has none collected.
    """
    shape = checks.page_shape(F.col("html"), F.col("url"), buy_box, has_product)
    base = pages.withColumn("_shape", F.when(F.col("html").isNotNull(), shape))
    verdict, arrived = F.col("_shape.verdict"), F.col("html").isNotNull()
    turned = F.coalesce(verdict == "bot_challenge", F.lit(False))
    told = F.struct(
        answer(arrived).alias("arrived"), answer(F.when(arrived, turned)).alias("bot_check"), answer(F.when(arrived & ~turned, F.coalesce(verdict == "sign_in_required", F.lit(False)))).alias("sign_in"),
        answer(F.when(arrived & ~turned & ~F.coalesce(verdict == "sign_in_required", F.lit(False)), F.coalesce(verdict == "not_a_product_page", F.lit(False)))).alias("gone"),
        answer(F.when(arrived, F.col("_shape.product"))).alias("product"), verdict.alias("verdict"),
    )
    counted = trace.groupBy(key, "rule", "dropped").agg(F.count("*").alias("n"))
    per = counted.groupBy(key).agg(F.collect_list(F.struct("rule", "dropped", "n")).alias("_all")).withColumnRenamed(key, "_key")
    looked = arrived & verdict.isNull()
    all_ = F.when(looked, F.coalesce("_all", F.array().cast("array<struct<rule:string,dropped:string,n:bigint>>")))
    total = lambda keep: F.aggregate(F.filter(all_, keep), F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    images = F.struct(
        answer(F.when(arrived, looked)).alias("collected"), total(lambda x: F.lit(True)).alias("found"), total(lambda x: x["dropped"].isNull()).alias("kept"),
        F.when(looked, F.array(*[F.struct(F.lit(r).alias("rule"), total(_is("rule", r)).alias("n")) for r in RULES])).alias("by_rule"),
        F.when(looked, F.array(*[F.struct(F.lit(d).alias("reason"), total(_is("dropped", d)).alias("n")) for d in DROPS])).alias("by_drop"),
    )
    return base.join(per, F.col(key) == F.col("_key"), "left").select(key, "url", told.alias("shape"), images.alias("images"))


def _is(name: str, value: str):
    return lambda x: F.coalesce(x[name] == value, F.lit(False))

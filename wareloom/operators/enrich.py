"""Classification, tariff codes and policy screening by the terms of a vocabulary's table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom.functions import dims
from wareloom.functions.values import let
from wareloom.operators.vocabulary import find_terms

#: What a term of a category weighs by where it stands, and the score of a winner at least.
WEIGHTS, LEAST_SCORE = {"title": 3, "description": 1, "trail": 5}, 3
#: Fixed value: words of a title that name a category of its own.
CUSTOM_WORDS = 6


def look_up(df: DataFrame, terms: DataFrame, title: Column, description: Column, trail: Column | None = None) -> DataFrame:
    """``df`` with found: which ``terms`` its texts have (``vocabulary.find_terms``); the others here read it."""
    fields = {"title": title, "description": description} | ({} if trail is None else {"trail": trail})
    return find_terms(df, fields, terms)


def _winner(terms: Column) -> Column:
    """Of found terms the slug with the highest score of LEAST_SCORE or more; null if it isn't the only one."""
    weight = lambda x: F.coalesce(F.create_map(*[F.lit(v) for kv in WEIGHTS.items() for v in kv])[x["field"]], F.lit(0))

    def scores(own: Column) -> Column:
        total = lambda s: F.aggregate(F.filter(own, lambda x: x["slug"] == s), F.lit(0), lambda sum_, x: sum_ + weight(x))
        return F.transform(F.array_distinct(F.transform(own, lambda x: x["slug"])), lambda s: F.struct(total(s).alias("score"), s.alias("slug")))

    def only(best: Column) -> Column:
        return F.when((F.size(best) == 1) & (F.get(best, F.lit(0))["score"] >= LEAST_SCORE), F.get(best, F.lit(0))["slug"])

    top = lambda t: let(F.array_max(F.transform(t, lambda x: x["score"])), lambda most: F.filter(t, lambda x: x["score"] == most))
    return let(let(let(terms, scores), top), only)


def classify(looked_up: DataFrame, title: str) -> DataFrame:
    """``looked_up`` with category_slug, subcategory_slug and custom_category (the title's first words on the fallback).
    Shelves are looked at within the category that won."""
    own = F.filter("found", lambda x: x["list"] == "category")
    out = looked_up.withColumn("_won", _winner(own))
    shelves = F.filter("found", lambda x: (x["list"] == "shelf") & F.startswith(x["slug"], F.concat(F.col("_won"), F.lit("/"))))
    out = out.withColumn("_shelf", F.when(F.col("_won").isNotNull(), _winner(shelves)))
    return out.select(
        *looked_up.columns,
        F.coalesce("_won", F.lit(dims.FALLBACK_CATEGORY)).alias("category_slug"),
        F.regexp_replace("_shelf", "^[^/]*/", "").alias("subcategory_slug"),
        F.when(F.col("_won").isNull(), F.array_join(F.slice(F.split(F.col(title), r"\s+"), 1, CUSTOM_WORDS), " ")).alias("custom_category"),
    )


def with_hs_code(classified: DataFrame, codes: DataFrame) -> DataFrame:
    """``classified`` with hs_code: of the first material of its category in the title, else of its shelf, else of its
    category (``codes``: slug, code), else null."""
    named = F.filter("found", lambda x: (x["list"] == "material") & (x["field"] == "title") & (x["slug"] == F.col("category_slug")))
    first = F.array_min(F.transform(named, lambda x: F.struct(x["rank"].alias("rank"), x["code"].alias("code"))))["code"]
    # each slug has one code; Spark broadcasts the table if it is small enough
    one = codes.groupBy("slug").agg(F.min("code").alias("code"))
    of = lambda name: one.select(F.col("slug").alias(f"_{name}"), F.col("code").alias(f"_{name}_code"))
    out = classified.withColumn("_at", F.concat_ws("/", "category_slug", "subcategory_slug"))
    out = out.join(of("shelf"), F.col("_at") == F.col("_shelf"), "left").join(of("category"), F.col("category_slug") == F.col("_category"), "left")
    return out.select(*classified.columns, F.coalesce(first, "_shelf_code", "_category_code").alias("hs_code"))


def policy_hits(found: Column) -> Column:
    """array<struct<category, term, field>>: one hit per term of a policy, the title first."""
    own = F.filter(found, lambda x: (x["list"] == "policy") & x["field"].isin("title", "description"))

    def first(all_: Column) -> Column:
        titled = lambda x: F.exists(all_, lambda y: (y["slug"] == x["slug"]) & (y["term"] == x["term"]) & (y["field"] == "title"))
        kept = F.filter(all_, lambda x: (x["field"] == "title") | ~titled(x))
        return F.transform(kept, lambda x: F.struct(x["slug"].alias("category"), x["term"].alias("term"), x["field"].alias("field")))

    return let(own, first)


def with_stated(derived: DataFrame, category: Column, code: Column | None = None) -> DataFrame:
    """``derived`` (category_slug, subcategory_slug, custom_category, hs_code and more) with what a seller stated on top,
    and said: array of notes.

    A stated value stands above a derived one, if the taxonomy knows it; a derived value that hangs on another, a shelf on
    its category, stands only where both agree on the one it hangs on. So a stated category keeps the derived shelf only
    if the derived category is the same, and has no category of its own; an unknown one gives way, and the note says
    what was stated. A stated code always stands. Empty text states nothing.
    """
    stated = F.nullif(F.trim(category), F.lit(""))
    known = F.coalesce(stated.isin(*dims.CATEGORIES), F.lit(False))
    agree = known & (F.col("category_slug") == stated)
    own_code = F.nullif(F.trim(code), F.lit("")) if code is not None else F.lit(None).cast("string")
    said = F.array_compact(F.array(
        F.when(known & ~agree & F.col("category_slug").isNotNull(), F.concat(F.lit("kept the stated category "), stated, F.lit(", derived "), F.col("category_slug"))),
        F.when(stated.isNotNull() & ~known, F.concat(F.lit("stated category "), stated, F.lit(" is unknown, filed under "), F.coalesce("category_slug", F.lit("nothing")))),
    ))
    made = {
        "category_slug": F.when(known, stated).otherwise(F.col("category_slug")),
        "subcategory_slug": F.when(~known | agree, F.col("subcategory_slug")),
        "custom_category": F.when(~known, F.col("custom_category")),
        "hs_code": F.coalesce(own_code, "hs_code"),
        "said": said,
    }
    kept = [c for c in derived.columns if c not in made]
    return derived.select(*kept, *[v.alias(n) for n, v in made.items()])

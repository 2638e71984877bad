"""Checks as data: a table of constraints, evaluated over other tables in one aggregate pass each, gives findings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.functions import dims

#: A constraint: the table it reads, its level, a title, what a row must not be (an SQL condition), how many such rows are
#: fine, and what to do about it. Needed rows are those a constraint wants at least (0: none).
CONSTRAINTS = "table string, level string, title string, fault string, most long, needed long, fix string"
LEVELS = ("ok", "warn", "fail")
#: Constraints on one table at most; they come to the driver.
MOST = 1_000
FINDINGS = "level string, title string, detail string, fix string"


def evaluate(tables: Mapping[str, DataFrame], constraints: DataFrame, key: Mapping[str, str] | None = None) -> DataFrame:
    """FINDINGS of all constraints, in one aggregate pass over each of ``tables`` that any of them names.

    A constraint holds if at most ``most`` rows meet ``fault`` (a null counts as no) and the table has ``needed`` rows at
    least; then its level is ok. detail says how many rows are at fault, and by ``key`` (a column of each table) the first
    of them. A constraint on a table that isn't there fails, as does one of an unknown level. Titles that are equal are
    findings each.
    """
    spark = constraints.sparkSession
    rows = constraints.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} constraints")
    out = []
    for name in dict.fromkeys(r["table"] for r in rows):
        own = [r for r in rows if r["table"] == name]
        frame = tables.get(name)
        if frame is None:
            out.append(spark.createDataFrame([("fail", r["title"], f"no table {name}", r["fix"]) for r in own], FINDINGS))
            continue
        first = F.col(f"`{key[name]}`").cast("string") if key and name in key else F.lit(None).cast("string")
        faults = [F.coalesce(F.expr(r["fault"]).cast("boolean"), F.lit(False)) for r in own]
        counts = [c for k, fault in enumerate(faults) for c in (F.count_if(fault).alias(f"n{k}"), F.min(F.when(fault, first)).alias(f"f{k}"))]
        totals = frame.agg(F.count("*").alias("rows"), *counts)
        found = []
        for k, r in enumerate(own):
            few, many = F.col("rows") < F.lit(r["needed"] or 0), F.col(f"n{k}") > F.lit(r["most"] or 0)
            level = F.when(few | many, r["level"] if r["level"] in LEVELS else "fail").otherwise("ok")
            said = F.concat(F.col(f"n{k}").cast("string"), F.lit(" of "), F.col("rows").cast("string"), F.lit(" rows"), F.coalesce(F.concat(F.lit(", first "), F.col(f"f{k}")), F.lit("")))
            said = F.when(few, F.concat(F.col("rows").cast("string"), F.lit(f" rows, {r['needed'] or 0} needed"))).otherwise(said)
            found.append(F.struct(level.alias("level"), F.lit(r["title"]).alias("title"), said.alias("detail"), F.when(level != "ok", r["fix"]).alias("fix")))
        out.append(totals.select(F.explode(F.array(*found)).alias("x")).select("x.*"))
    findings = spark.createDataFrame([], FINDINGS)
    for part in out:
        findings = findings.unionByName(part)
    return findings


def blocking(findings: DataFrame) -> DataFrame:
    """(blocked): whether any finding fails, which stops a run."""
    return findings.agg((F.count_if(F.col("level") == "fail") > 0).alias("blocked"))


def vocabulary_tables(terms: DataFrame, codes: DataFrame) -> dict[str, DataFrame]:
    """What constraints on vocabularies read: entries (each category or shelf with its terms and its parent's) and codes."""
    entries = terms.where("list in ('category', 'shelf')").groupBy("list", "slug").agg(F.count("*").alias("terms"))
    parents = terms.where("list = 'category'").select(F.col("slug").alias("parent"), F.lit(True).alias("has_parent")).distinct()
    entries = entries.withColumn("parent", F.substring_index("slug", "/", 1)).join(parents, "parent", "left")
    named = entries.select(F.col("slug").alias("_slug"), F.lit(True).alias("known")).distinct()
    codes = codes.join(named, F.col("slug") == F.col("_slug"), "left").drop("_slug")
    return {"terms": terms, "entries": entries, "codes": codes}


def default_constraints(spark: SparkSession) -> DataFrame:
    """Constraints on the vocabularies that come with the package or a seller's own."""
    rows = [
        ("terms", "fail", "terms are written", "coalesce(trim(term), '') = ''", 0, 1, "fill or remove the empty terms"),
        ("terms", "warn", "terms say something", "length(term) < 3 and list <> 'policy'", 0, 0, "a short term is found in many texts"),
        ("terms", "warn", "materials have codes", "list = 'material' and code is null", 0, 0, "give each material its code"),
        ("entries", "fail", "shelves have a category", "list = 'shelf' and has_parent is null", 0, 1, f"add the category, or move the shelf to {dims.FALLBACK_CATEGORY}"),
        ("entries", "warn", "entries have enough terms", "terms < 3", 0, 0, "an entry of few terms is rarely chosen"),
        ("codes", "fail", "codes are codes", "not code rlike '^[0-9]{4,10}$'", 0, 1, "a code is 4 to 10 digits"),
        ("codes", "fail", "codes are of known entries", "known is null", 0, 0, "remove the code or add the entry"),
    ]
    return spark.createDataFrame(rows, CONSTRAINTS)

import pytest
from pyspark.sql import functions as F

from wareloom.operators import enrich, findings, records, vocabulary


def test_constraints_over_tables(spark):
    rows = spark.createDataFrame([(1, None), (2, "x"), (3, "x")], "k int, v string")
    made = [
        ("t", "fail", "filled", "v is null", 0, 0, "fill it"), ("t", "warn", "few x", "v = 'x'", 2, 0, "less"), ("t", "warn", "no x", "v = 'x'", None, None, "less"),
        ("t", "warn", "enough", "false", 0, 4, "more"), ("gone", "warn", "there", "true", 0, 0, "add it"), ("t", "odd", "level", "true", 0, 0, "name it"),
        ("e", "fail", "empty is fine", "true", 0, 0, "x"), ("e", "fail", "empty isn't", "true", 0, 1, "x"),
    ]
    got = findings.evaluate({"t": rows, "e": rows.limit(0)}, spark.createDataFrame(made, findings.CONSTRAINTS), {"t": "k"})
    assert {r.title: (r.level, r.detail, r.fix) for r in got.collect()} == {
        "filled": ("fail", "1 of 3 rows, first 1", "fill it"), "few x": ("ok", "2 of 3 rows, first 2", None), "no x": ("warn", "2 of 3 rows, first 2", "less"),
        "enough": ("warn", "3 rows, 4 needed", "more"), "there": ("fail", "no table gone", "add it"), "level": ("fail", "3 of 3 rows, first 1", "name it"),
        "empty is fine": ("ok", "0 of 0 rows", None), "empty isn't": ("fail", "0 rows, 1 needed", "x"),
    }
    assert findings.blocking(got).first().blocked and not findings.blocking(got.where("level = 'warn'")).first().blocked
    assert findings.evaluate({}, spark.createDataFrame([], findings.CONSTRAINTS)).count() == 0


def test_vocabularies_are_in_order(spark):
    terms, codes, rules = vocabulary.default_terms(spark), vocabulary.default_codes(spark), findings.default_constraints(spark)
    fine = findings.evaluate(findings.vocabulary_tables(terms, codes), rules).collect()
    assert len(fine) == rules.count() and not [r for r in fine if r.level == "fail"]
    bad = terms.unionByName(spark.createDataFrame([("shelf", "gone/rings", "ring", True, 0, None)], vocabulary.TERMS))
    wrong = findings.evaluate(findings.vocabulary_tables(bad, codes.unionByName(spark.createDataFrame([("what", "12")], vocabulary.CODES))), rules, {"codes": "slug", "entries": "slug"})
    assert {r.title: r.detail.rpartition(" ")[2] for r in wrong.where("level = 'fail'").collect()} == {"shelves have a category": "gone/rings", "codes are codes": "what", "codes are of known entries": "what"}


@pytest.mark.parametrize(
    ("stated", "code", "derived", "want", "said"),
    [
        (None, None, ("apparel", "kids", None, "1"), ("apparel", "kids", None, "1"), []),
        (" ", "", ("apparel", "kids", None, "1"), ("apparel", "kids", None, "1"), []),
        ("apparel", "77", ("apparel", "kids", None, "1"), ("apparel", "kids", None, "77"), []),
        ("jewellery", None, ("apparel", "kids", None, "1"), ("jewellery", None, None, "1"), ["kept the stated category jewellery, derived apparel"]),
        ("more-crafts", None, ("more-crafts", None, "a b", None), ("more-crafts", None, None, None), []),
        ("Shoes", None, ("apparel", "kids", "a", "1"), ("apparel", "kids", "a", "1"), ["stated category Shoes is unknown, filed under apparel"]),
    ],
)
def test_stated_values(spark, stated, code, derived, want, said):
    kind = "category_slug string, subcategory_slug string, custom_category string, hs_code string, stated string, code string, n int"
    got = enrich.with_stated(spark.createDataFrame([(*derived, stated, code, 5)], kind), F.col("stated"), F.col("code")).first()
    assert (got.category_slug, got.subcategory_slug, got.custom_category, got.hs_code) == want and got.said == said and got.n == 5


def test_second_readings(spark):
    cell = "struct<value:{},confidence:string,source:string,note:string>"
    kind = f"row_key string, status string, title {cell.format('string')}, weight_g {cell.format('int')}, notes array<string>"
    weight = (7, "high", "y", None)
    static = spark.createDataFrame(
        [(k, "needs_review", ("t", "low", "x", None), None, ["given", "no weight", "no sizes"], 1, "ok", {"weight_g": "no weight", "sizes": "no sizes"}) for k in "abc"],
        f"{kind}, notes_before int, status_before string, gap_notes map<string,string>",
    )
    again = spark.createDataFrame([("a", "ok", None, weight, ["no sizes"]), ("b", "needs_review", None, None, ["no weight", "no sizes"])], kind)
    got = {r.row_key: r for r in records.rendered_again(static, again, F.lit("weight")).collect()}
    assert (got["a"].status, got["a"].weight_g.value, got["a"].title.value) == ("ok", 7, "t")
    assert got["a"].notes == ["given", "no sizes", "no weight; rendering recovered weight_g"] and got["a"].gap_notes == {"sizes": "no sizes"}
    assert got["b"].notes == ["given", "no weight", "no sizes", "no weight; rendering found nothing more"] and got["b"].status == "needs_review"
    assert got["c"].notes == ["given", "no weight", "no sizes", "no weight; rendering failed, the first reading stands"] and got["c"].status == "needs_review"

from pyspark.sql import functions as F

from wareloom.operators import gates


def test_words_and_statuses(spark):
    cases = [("http_403", "blocked_403", 403), ("http_410", "not_a_product_page", 410), ("http_5", "http_error_5xx", 5), ("http_x", "timeout_read", None)]
    cases += [("dns_error", "dns_failure", None), ("", "timeout_read", None), (None, "timeout_read", None)]
    frame = spark.createDataFrame([(w,) for w, *_ in cases], "w string")
    got = frame.select(gates.fetch_reason(F.col("w")), gates.fetch_status(F.col("w"))).collect()
    assert [tuple(r) for r in got] == [(r, s) for _, r, s in cases]


def test_slugs(spark):
    cases = [("apparel", None, None), (None, None, None), (None, "x", "subcategory_without_category:x"), ("y", "x", "unknown_category_slug:y")]
    frame = spark.createDataFrame([(c, k) for c, k, _ in cases], "c string, k string")
    assert [r[0] for r in frame.select(gates.slug_fault(F.col("c"), F.col("k"))).collect()] == [f for *_, f in cases]

from pyspark.sql import functions as F

from wareloom.operators import diagnosis, extract
from wareloom.sources import page_evidence

PAGES = [
    (1, "https://a.example/products/blue-kurta", "<img src=/x/blue-kurta-1.jpg><img src=/x/blue-kurta-1.jpg><img src=/x/size-chart.jpg><img src=/logo.png><img src='data:image/png;base64,x'>Add to cart"),
    (2, "https://a.example/products/blue-kurta", "<img src=/x/99_1.jpg><img src=/x/99_2.jpg>Add to cart"),
    (3, "https://a.example/p", "Robot Check <img src=/x/1.jpg>"),
    (4, "https://a.example/p", None),
    (5, None, "<img src=https://b.example/1.jpg>"),
]


def test_where_pictures_go(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    seen = page_evidence.read_pages(pages, columns=["base", "images"])
    trace = diagnosis.provenance(seen).cache()
    got = {(r.page_id, r.dom_index): r.dropped for r in trace.collect()}
    assert got == {(1, 0): None, (1, 1): "repeated", (1, 2): "another product's", (1, 3): "furniture", (1, 4): "no link", (2, 0): None, (2, 1): None, (3, 0): None, (5, 0): None}
    ordered = extract.ordered(diagnosis.products_own(extract.candidates(seen)))
    rows = {(r.page_id, r.photo_rank, r.rank): (r.rule, r.dom_index) for r in diagnosis.walked(ordered, trace).collect()}
    assert rows[1, 0, 0] == ("src", 0) and len([k for k in rows if k[0] == 1]) == 1 and len(rows) == 5
    out = {r.page_id: r for r in diagnosis.reports(pages, trace, F.lit(""), F.lit(None).cast("boolean")).collect()}
    shape = lambda k: tuple(out[k].shape)[:4]
    assert shape(1) == ("yes", "no", "no", "no") and shape(3) == ("yes", "yes", "not reached", "not reached") and shape(4) == ("no",) + ("not reached",) * 3
    assert (out[1].images.found, out[1].images.kept) == (5, 1) and {(d.reason, d.n) for d in out[1].images.by_drop} == {("no link", 1), ("furniture", 1), ("repeated", 1), ("another product's", 1)}
    assert out[3].images.collected == "no" and out[3].images.found is None and out[4].images.collected == "not reached"
    assert {(d.rule, d.n) for d in out[2].images.by_rule if d.n} == {("src", 2)} and len(out[2].images.by_rule) == len(extract.RULES)


def test_a_links_own_words(spark):
    rows = [("k", "https://c.example/blue.jpg", "https://a.example/blue-hat"), ("k", "https://c.example/7.jpg", "https://a.example/blue-hat"), ("k", "data:x", "https://a.example/blue-hat"),
            (None, "https://c.example/7.jpg", "https://a.example/blue-hat"), ("m", "https://c.example/7.jpg", None)]
    got = diagnosis.products_own(spark.createDataFrame(rows, "k string, url string, page_url string"), "k").collect()
    assert sorted((r.k or "", r.url) for r in got) == [("", "https://c.example/7.jpg"), ("k", "data:x"), ("k", "https://c.example/blue.jpg"), ("m", "https://c.example/7.jpg")]

import json
import random
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from wareloom.functions import texts, values
from wareloom.operators import extract
from wareloom.sources import page_evidence, readers


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


def cells(spark, html, url="https://shop.example/products/red-silk-saree"):
    row = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return extract.cells(page_evidence.read_pages(row)).first()


def page(product, body=""):
    return f'<script type="application/ld+json">{json.dumps(product)}</script><body>{body}</body>'


def test_odd_pages_give_empty_cells(spark):
    rows = [(k, None if k == 1 else "https://a.example", h) for k, h in enumerate([None, "", "<", "<script type='application/ld+json'>{", "<table><tr><td>a", "[" * 3000, '<script type="application/ld+json">' + "[" * 3000 + "</script>"])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = extract.cells(page_evidence.read_pages(frame)).collect()
    assert len(got) == len(rows) and all(r.weight_g.value is None and r.price is None and r.availability.value is None for r in got)
    assert extract.cells(page_evidence.read_pages(frame.limit(0))).count() == 0


@pytest.mark.parametrize("value", ["x", " x ", ["", None, "x"], {"@value": "x"}, {"name": {"@id": "x"}}, [[{"value": ["x"]}]]])
def test_scalars(value):
    assert page_evidence.scalar(value) == "x"


def test_scalars_of_numbers_and_nothing():
    assert [page_evidence.scalar(v) for v in (3, 2.5, {}, [], None, "", {"other": 1})] == ["3", "2.5", None, None, None, None, None]
    deep = "x"
    for _ in range(200):
        deep = [deep]
    assert page_evidence.scalar(deep) is None


def test_products_are_found_wherever_they_stand():
    item = {"@type": "Product", "name": "n"}
    for node in (item, [{"@type": "WebPage", "mainEntity": item}], {"a": {"b": [1, {"c": item}]}}, {"@graph": [{"@type": "List", "itemListElement": [{"item": item}]}]}, {"@type": ["Thing", "https://schema.org/Product"], "name": "n"}):
        assert page_evidence.product_in(node)["name"] == "n"
    deep = item
    for _ in range(9):
        deep = {"x": deep}
    assert page_evidence.product_in(deep) is None and page_evidence.product_in({"@type": "Offer"}) is None


def test_microdata_and_rdfa(spark):
    micro = '<div itemscope itemtype="https://schema.org/Product"><b itemprop="name">Red <i>stole</i></b><div itemprop="offers" itemscope itemtype="https://schema.org/Offer"><meta itemprop="price" content="1,250"><meta itemprop="priceCurrency" content="INR"><link itemprop="availability" href="https://schema.org/InStock"></div></div>'
    rdfa = '<div vocab="https://schema.org/" typeof="Product"><b property="name">Red stole</b><div property="offers" typeof="Offer"><span property="price" content="1250">x</span><span property="priceCurrency">INR</span></div></div>'
    for html, source in ((micro, "microdata"), (rdfa, "rdfa")):
        got = cells(spark, html)
        assert got.title.value == "Red stole" and got.title.source == source and (got.price.amount, got.price.currency) == (1250.0, "INR")
    assert cells(spark, micro).availability.value == "in_stock"


def test_weights(spark):
    assert cells(spark, page({"@type": "Product", "weight": "1.5 kg"})).weight_g.value == 1500
    assert cells(spark, page({"@type": "Product", "weight": {"value": 350, "unitCode": "GRM"}}, "<table><tr><td>Weight<td>9 kg")).weight_g.value == 350
    both = cells(spark, "<table><tr><td>Shipping weight<td>2 kg<tr><td>Net Weight:<td>1 kg</table>")
    assert (both.weight_g.value, both.weight_g.confidence) == (1000, "high")
    shipped = cells(spark, "<dl><dt>Gross weight<dd>2 kg</dl>").weight_g
    assert (shipped.value, shipped.confidence) == (2000, "low")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("70 x 50 x 2 cm", (70, 50, 2, False)), ("H70 x W50 x D2 cm", (2, 50, 70, True)), ("L 10 × W 4 in", (25, 10, None, True)), ("L2 x W3 x D4", (2, 3, 4, False)),
        ("10 mm x 2", (1, 0, None, False)), ("12", None), ("a x b", None), ("", None), (None, None), ("1 x 2 x 3 x 4 cm", (1, 2, 3, False)),
    ],
)
def test_triples(spark, text, want):
    got = one(spark, text, lambda c: extract.triple(c))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("2499", 2499.0), ("₹2,499.00", 2499.0), ("1.234,56", 1234.56), ("12,50", 12.5), ("12,34,50", None), ("1.50.000", 150000.0), ("1,299", 1299.0), ("1.500", 1500.0), ("0", None), ("free", None), ("1 299,00 €", 1299.0), ("7", 7.0), ("5.", 5.0), (None, None)],
)
def test_amounts(spark, text, want):
    assert one(spark, text, values.amount) == want


def test_titles(spark):
    shout = lambda t: one(spark, t, texts.clean_title)
    assert shout("HAND-MADE WOMEN'S 3D SAREE") == "HAND-MADE WOMEN'S 3D SAREE".title()
    assert shout("a " * 150) == ("a " * 100).strip()
    cases = {"Blue Kurta | MyStore | Free Shipping": "Blue Kurta", "Only | x": "Only", "Plain": "Plain", " | ": "|", "A long part of more than six words here | Shop": "A long part of more than six words here", "a 0 | b": "a 0"}
    for raw, want in cases.items():
        assert one(spark, raw, texts.without_suffix) == want
    names = {"Mivi | DuoPods Marathon Earbuds | 70H": "Mivi DuoPods Marathon Earbuds", "Stole Free Shipping": "Stole", "free shipping": "free shipping", "Blue Kurta - Medium": "Blue Kurta - Medium"}
    for raw, want in names.items():
        assert one(spark, raw, texts.tidied) == want


def test_descriptions(spark):
    raw = "Soft  silk\r\n\r\n\r\n\r\nADD TO CART now\nwoven \x07by hand"
    assert one(spark, raw, texts.clean_description) == "Soft silk\n\nwoven by hand"
    long = one(spark, "word " * 2000, texts.clean_description)
    assert long.endswith("word…") and len(long) <= 5001


def test_folding_equals_the_standard(spark):
    raw = ["ﬁne ＡＢＣ　x", "²​é", "", None]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(raw)], "k int, t string")
    got = {r.k: r.n for r in frame.select("k", texts.normalised(F.col("t")).alias("n")).collect()}
    assert got == {0: "fine ABC x", 1: unicodedata.normalize("NFKC", "²é"), 2: "", 3: None}


@pytest.mark.parametrize(
    ("ref", "want"),
    [
        ("c.jpg", "https://a.example/b/c.jpg"), ("../c.jpg?x=1&amp;y=2", "https://a.example/c.jpg?x=1&y=2"), ("/c/./d/../e.jpg", "https://a.example/c/e.jpg"), ("//cdn.example/x", "https://cdn.example/x"),
        ("HTTP://B.example/x", "HTTP://B.example/x"), ("?q=1", "https://a.example/b/page?q=1"), ("#top", None), ("data:image/png;base64,xx", None), ("javascript:void(0)", None), ("", None), (None, None), ("../../../c", "https://a.example/c"),
    ],
)
def test_absolute_links(spark, ref, want):
    assert one(spark, ref, lambda c: texts.absolute(F.lit("https://a.example/b/page"), c)) == want


def test_pictures_of_one_photo_stand_together(spark):
    body = '<img srcset="/s/files/a_400x.jpg 400w, /s/files/a_900x.jpg 900w" src="/s/files/a.jpg"><img src="/img/logo.png"><img data-src="/img/red-silk-saree-2.jpg"><img src="/img/other.jpg?w=200">'
    row = spark.createDataFrame([(1, "https://shop.example/products/red-silk-saree", f"<body>{body}")], "page_id long, url string, html string")
    got = extract.ordered(extract.candidates(page_evidence.read_pages(row))).orderBy("photo_rank", "rank").collect()
    links = [(r.photo_rank, r.url.removeprefix("https://shop.example")) for r in got]
    assert links == [(0, "/img/red-silk-saree-2.jpg"), (1, "/s/files/a.jpg"), (1, "/s/files/a_900x.jpg"), (2, "/img/other.jpg?w=200")]


def test_saved_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.html").write_bytes("<meta charset=iso-8859-1><link rel=canonical href='https://a.example/x'><p>é".encode("latin-1"))
    (tmp_path / "sub/b.htm").write_bytes(b"<!-- saved from url=(0021)https://b.example/y --><p>ok")
    (tmp_path / "c.txt").write_text("no page")
    mhtml = "From: <Saved>\nSnapshot-Content-Location: https://c.example/z\nMIME-Version: 1.0\nContent-Type: multipart/related; type=\"text/html\"; boundary=\"B\"\n\n--B\nContent-Type: text/html\nContent-Transfer-Encoding: quoted-printable\n\n<p>caf=C3=A9</p>\n--B--\n"
    (tmp_path / "d.mhtml").write_text(mhtml)
    got = {r.url: r.html for r in readers.read_saved_pages(spark, f"file://{tmp_path}").collect()}
    assert got.keys() == {"https://a.example/x", "https://b.example/y", "https://c.example/z"}
    assert got["https://a.example/x"].endswith("é") and "café" in got["https://c.example/z"]
    assert readers.pasted_page(spark, "<p>x", "https://p.example").count() == 1
    with pytest.raises(ValueError):
        readers.pasted_page(spark, "<p>x", "")


def test_uploads(spark, tmp_path):
    (tmp_path / "u.csv").write_text("a;https://a.example/1;b\nc;no;https://a.example/2\n;;\n")
    got = readers.read_delimited(spark, f"file://{tmp_path}/u.csv").collect()
    assert sorted((r.link or "", r.column_1 or "") for r in got) == [("", ""), ("https://a.example/1", "a"), ("https://a.example/2", "c")] or len(got) == 2
    (tmp_path / "e.tsv").write_text("﻿Name\tPrice\nx\t1\n\t\ny\t2\n", encoding="utf-8")
    rows = readers.read_export(spark, f"file://{tmp_path}/e.tsv")
    assert rows.columns == ["Name", "Price"] and sorted(r.Name for r in rows.collect()) == ["x", "y"]


def test_workbooks(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="x"><si><t>Name</t></si><si><r><t>Pri</t></r><r><t>ce</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="x"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row/><row><c r="A3" t="inlineStr"><is><t>saree</t></is></c><c r="C3"><v>12.5</v></c></row></sheetData></worksheet>')
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    got = readers.read_sheets(spark, f"file://{tmp_path}/*.xlsx").orderBy("row_no").collect()
    assert [r.cells for r in got] == [["Name", "", "Price"], ["saree", "", "12.5"]]


def test_mappings_are_kept_by_header(spark, tmp_path):
    path = f"file://{tmp_path}/maps"
    assert readers.load_mapping(spark, path, ["A"]) is None
    readers.save_mapping(spark, path, ["Name", "Price (INR)"], {"title": "Name"})
    readers.save_mapping(spark, path, ["Name", "Price (INR)"], {"title": "Name", "price": "Price (INR)"})
    assert readers.load_mapping(spark, path, ["price  inr", "NAME"]) == {"title": "Name", "price": "Price (INR)"}


def test_pages_of_any_characters_are_read(spark):
    r = random.Random(3)
    pieces = ["<table>", "<tr>", "<td>", "</td>", "</table>", "<dl>", "<dt>a:", "<dd>b", "<p>k: v", "</p>", "<li itemprop=name>", "<div itemscope itemtype='x/Product'>", "</div>",
              '<script type="application/ld+json">', "</script>", '{"@type":"Product","name":"\\ud800","sku":' + "9" * 5000 + "}", "[" * 3000, "&#xD800;", "\x00", " ", "<", "<!--", "]]>", "<select name=size>",
              "<option>", "<noscript>", "<base href=''>", "<img srcset='a 1w,,b'>", "style='background-image:url('", "<a style=\"background-image : url( 'x.png' )\">", "é", "\U0001f600"]
    rows = [(k, "".join(r.choices(pieces, k=r.randint(0, 30))), f"https://a.example/{k}") for k in range(300)]
    rows.append((300, '<script type="application/ld+json">{"@type":"Product","name":"\\ud800x","sku":' + "9" * 5000 + "}</script>", None))
    got = {x.page_id: x for x in page_evidence.read_pages(spark.createDataFrame(rows, "page_id long, html string, url string")).collect()}
    assert len(got) == 301 and got[300].product == {"name": "?x", "sku": "9" * 5000}


def test_reading_takes_time_in_proportion_to_the_page():
    def seconds(page):
        began, read = time.process_time(), page_evidence.Evidence(page, None)
        out = {name: getattr(read, name)() for name in ("pairs", "sizes", "blocks", "trail", "images", "body")}
        return time.process_time() - began, out

    for page in ("<table><tr><td>a<td>" * 4000, "<div>" * 4000 + "k: v", "<dl><dt>a<dd>" * 4000, "<b>" * 20000 + "</i>" * 20000, "<select name=size>" * 4000 + "<option>m" * 4000):
        took, _ = seconds(page)
        assert took < 2, (page[:40], took)
    # controls below any number of elements
    assert seconds("<select name=size>" + "<b>" * 100 + "<option>XL")[1]["sizes"] == [["XL"]]


def test_facts_of_nested_markup():
    facts = lambda html: {f["label"]: f["value"] for f in page_evidence.Evidence(html, None).pairs()}
    assert facts("<table><tr><th>Weight:<td>2 kg<td>more<tr><td>alone<tr><th>weight<td>other</table>") == {"weight": "2 kg"}
    assert facts("<table><tr><td>Box<td><table><tr><td>Size<td>4</table></table>") == {"box": "Size 4", "size": "4"}
    assert facts("<dl><dt>A<dd>1<dd>2<dt>B<dd>3</dl>") == {"a": "1", "b": "2"}
    assert facts("<p>Net weight (g): 20<br>x: 1<br>no colon<br>Full width： 3") == {"net weight (g)": "20", "full width": "3"}
    assert facts(f"<p>Colour: {'x' * 300}</p>") == {}


def test_only_wanted_columns_are_read(spark):
    rows = spark.createDataFrame([(1, "<h1>a</h1>", "u")], "page_id long, html string, url string")
    assert page_evidence.read_pages(rows, columns=["h1", "base"]).first().asDict() == {"page_id": 1, "url": "u", "h1": "a", "base": "u"}

import json
import random

from pyspark.sql import functions as F

from wareloom.operators import plugins
from wareloom.sources.scripts import cut, gallery, gallery_of, named


def test_what_is_cut_is_what_was_written():
    r = random.Random(9)

    def value(depth):
        kind = r.choice(["list", "dict", "text", "number"] if depth < 4 else ["text", "number"])
        if kind == "list":
            return [value(depth + 1) for _ in range(r.randrange(4))]
        if kind == "dict":
            return {"".join(r.choices("ab]{\"\\", k=2)) + str(k): value(depth + 1) for k in range(r.randrange(4))}
        return "".join(r.choices("ab[]{}\"'\\\n", k=r.randrange(8))) if kind == "text" else r.randrange(9)

    for _ in range(500):
        made = [value(0), value(0)]
        text = json.dumps(made)
        before = r.choice(["", "f(x); ", "var s = '[';"])
        found = cut(f"{before}{text}; g('}}]');", len(before))
        assert json.loads(found) == made
        assert cut(text[:-1], 0) is None or cut(text[:-1], 0) != text
    assert cut("[}", 0) is None and cut("[[]", 0) is None and cut("x", 0) is None and cut("", 0) is None and cut('["]', 0) is None
    assert cut("[" * 100_000 + "]" * 100_000, 0) == "[" * 100_000 + "]" * 100_000


def test_names_in_scripts():
    text = "var meta = {a: [1, {b: ']'}]}; 'gallery' : {'first': [2]}, other.gallery={ \"first\":[3}, first: [4]"
    assert list(named(text, "meta")) == ["{a: [1, {b: ']'}]}"] and list(named(text, "gallery", "first")) == ["[2]"]
    assert list(named(text, "first")) == ["[2]", "[4]"] and list(named(text, "eta")) == []


def test_rules_in_order():
    page = """<img id=landingImage data-old-hires="o" src="s" data-a-dynamic-image='{"small":[1,2],"big":[30,40],"odd":["a",2],"none":null}'>
    <script>'colorImages': {'initial': [{"hiRes":null,"large":"l1"},{"hiRes":"h2","large":"l2"},{"mainUrl":"m"},{},5]}</script><div id=altImages><b><img data-src=t></b></div><img src=elsewhere>"""
    got = [(p["url"], p["rule"], p["width"]) for p in gallery(page)]
    assert got == [("big", "sizes", 30), ("small", "sizes", 1), ("odd", "sizes", None), ("none", "sizes", None), ("o", "original", None), ("l1", "data", None), ("h2", "data", None), ("m", "data", None), ("t", "thumbnail", None)]
    for odd in ("", "<img id=landingImage data-a-dynamic-image='[1]'>", "<script>colorImages: {initial: [{]</script>", "<script>colorImages:{initial:[1,</script>", "<img id=landingImage data-a-dynamic-image='{'>"):
        assert gallery(odd) == []


def test_galleries_as_columns(spark):
    media = "https://m.media-amazon.com/images/I/"
    page = f"<img id=landingImage data-old-hires='{media}1._SL9_.jpg'><div id=altImages><img src='{media}1.jpg'><img src='https://a.example/2.jpg'><img src='{media}Play-Icon.png'>"
    rows = spark.createDataFrame([(1, page), (2, None), (3, "")], "k int, html string")
    got = {r.k: r.x for r in rows.select("k", plugins.ranked_gallery(gallery_of(F.col("html"))).alias("x")).collect()}
    assert got == {1: [f"{media}1.jpg", f"{media}1._SL9_.jpg"], 2: None, 3: []}

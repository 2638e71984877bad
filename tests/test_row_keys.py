import hashlib

from pyspark.sql import functions as F

from wareloom.functions import urls


def test_keys_are_readable_in_any_latin_script(spark):
    links = {
        "https://a.example/Crème-Brûlée/Ősz": "a-example-creme-brulee-osz", "https://straße.example/ø/œuvre": "strasse-example-o-oeuvre", "https://a.example/商品/1": "a-example-1", "https:///商品": "",
        "https://a.example/" + "word-" * 20: "a-example-" + "word-" * 9 + "word", "https://a.example/" + "x" * 80: "a-example", "https://a.example/Ẵ?q=é": "a-example-a",
    }
    rows = spark.createDataFrame([(u,) for u in links], "u string").select("u", urls.row_key(F.col("u")).alias("k")).collect()
    for r in rows:
        digest = hashlib.sha1(r.u.encode()).hexdigest()[:8]
        assert r.k == (f"{links[r.u]}-{digest}" if links[r.u] else digest), r
    assert spark.createDataFrame([(None,)], "u string").select(urls.row_key(F.col("u")).alias("k")).first().k in (None, "")


def test_letters_without_marks(spark):
    text = "ÀÉÎõüçñšžğżśűőåāęįŐẴ İstanbul Łódź ħŧŋĳ ÆŒß e\u0301 商品 йод"
    got = spark.createDataFrame([(text,)], "t string").select(urls.unmarked(F.col("t"))).first()[0]
    assert got == "aeioucnszgzsuoaaeioa istanbul lodz htnij aeoess e 商品 йод"

import random
import re

import pytest
from pyspark.sql import functions as F

from wareloom.operators import enrich, vocabulary

SIGNS = "ab_ -.sé1İ"


def _plain(terms, texts):
    """Which terms stand in which texts, by one pattern per term."""
    out = set()
    for name, slug, term, plural, *_ in terms:
        ending = "(?:e?s)?" if plural else ""
        for field, text in texts.items():
            if text and term and re.search(rf"(?<!\w){re.escape(term)}{ending}(?!\w)", text, re.IGNORECASE):
                out.add((name, slug, term, field))
    return out


def _random(seed):
    r = random.Random(seed)
    word = lambda most, signs="ab_ -.s1é": "".join(r.choices(signs, k=r.randint(1, most)))
    keys = {(r.choice("xy"), r.choice("pq"), word(4)) for _ in range(60)}
    terms = [(a, b, t, r.random() < 0.5, k, str(k)) for k, (a, b, t) in enumerate(sorted(keys))]
    texts = [(k, r.choice([None, "", word(30).upper(), word(30)]), word(40)) for k in range(200)]
    return terms, texts


@pytest.mark.parametrize("chunk", [vocabulary.CHUNK_CHARS, 800])
def test_terms_are_found_as_patterns_find_them(spark, chunk):
    for seed in range(3):
        terms, texts = _random(seed)
        rows = spark.createDataFrame(texts, "k long, title string, found string")
        out = vocabulary.find_terms(rows, {"title": F.col("title"), "more": F.col("found")}, spark.createDataFrame(terms, vocabulary.TERMS), chunk)
        assert out.columns == ["k", "title", "found"]
        got = {r.k: [(x["list"], x.slug, x.term, x.field) for x in r.found] for r in out.collect()}
        for k, title, more in texts:
            assert len(got[k]) == len(set(got[k])) and set(got[k]) == _plain(terms, {"title": title, "more": more}), (title, more)


def test_letters_whose_lower_case_is_longer(spark):
    terms = spark.createDataFrame([("x", "p", "stanbul", False, 0, None), ("x", "p", "bul", True, 0, None)], vocabulary.TERMS)
    rows = spark.createDataFrame([("İSTANBUL",), ("İ STANBUL BULS",)], "t string")
    got = [[x.term for x in r.found] for r in vocabulary.find_terms(rows, {"t": F.col("t")}, terms).collect()]
    assert got == [[], ["bul", "stanbul"]]


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], vocabulary.TERMS)
    rows = spark.createDataFrame([("a",), (None,)], "t string")
    assert [r.found for r in vocabulary.find_terms(rows, {"t": F.col("t")}, empty).collect()] == [[], []]
    blank = spark.createDataFrame([("x", "p", "", False, 0, None), ("x", "p", None, False, 0, None)], vocabulary.TERMS)
    assert [r.found for r in vocabulary.find_terms(rows, {"t": F.col("t")}, blank).collect()] == [[], []]
    assert vocabulary.find_terms(rows.limit(0), {"t": F.col("t")}, vocabulary.default_terms(spark)).count() == 0


def test_a_hundred_thousand_terms_are_no_larger_plan(spark):
    rows = spark.createDataFrame([(1, "a term77777 of gold", "t5s")], "k long, title string, told string")
    plans = []
    for n in (10, 100_000):
        terms = spark.range(n).select(
            F.lit("category").alias("list"), F.concat(F.lit("s"), F.col("id") % 50).alias("slug"), F.concat(F.lit("term"), "id").alias("term"),
            F.lit(True).alias("plural"), F.col("id").cast("int").alias("rank"), F.lit(None).cast("string").alias("code"))
        found = enrich.classify(enrich.look_up(rows, terms, F.col("title"), F.col("told")), "title")
        plans.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
    assert found.first().category_slug == "s27" and abs(plans[0] - plans[1]) < 200


def test_ties_have_no_winner(spark):
    terms = [("category", s, t, True, 0, None) for s, t in (("one", "red"), ("two", "blue"), ("two", "sky"))] + [("shelf", "two/a", "sky", True, 0, None), ("shelf", "one/b", "sky", True, 0, None)]
    rows = [("red blue", None), ("red blue sky", "sky"), (None, "red"), ("reds", "")]
    found = enrich.look_up(spark.createDataFrame(rows, "title string, told string"), spark.createDataFrame(terms, vocabulary.TERMS), F.col("title"), F.col("told"))
    got = [(r.category_slug, r.subcategory_slug, r.custom_category) for r in enrich.classify(found, "title").collect()]
    assert got == [("more-crafts", None, "red blue"), ("two", "a", None), ("more-crafts", None, None), ("one", None, None)]


def test_tables_of_terms_are_checked(spark, tmp_path):
    (tmp_path / "good.csv").write_text("list,slug,term,plural\npolicy,weapons, Big Knife ,true\n")
    assert vocabulary.read_terms(spark, str(tmp_path / "good.csv")).collect() == [("policy", "weapons", "big knife", True, 0, None)]
    for text, fault in (("list,slug,term\na,b,c\na,b, C\n", "twice"), ("list,slug,term\na,,c\n", "no slug"), ("list,slug\na,b\n", "without term"), ("list,slug,term,sort\na,b,c,d\n", "unknown")):
        (tmp_path / "bad.csv").write_text(text)
        with pytest.raises(ValueError, match=fault):
            vocabulary.read_terms(spark, str(tmp_path / "bad.csv")).count()

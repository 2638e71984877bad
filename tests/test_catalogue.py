import duckdb
import pandas as pd
import pytest

from wareloom.functions import urls, values
from wareloom.operators import ledger
from wareloom.plans import companions, pages, records, registry, reports, streams  # noqa: F401  (add their queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def rows(frame: pd.DataFrame) -> list:
    def cell(x):
        if pd.isna(x):
            return None
        return round(float(x), 6) if not isinstance(x, (str, bool, pd.Timestamp)) else str(x)

    return sorted((tuple(map(cell, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(registry.SQL[name]).df())


@pytest.mark.parametrize(
    ("raw", "same"),
    [
        ("https://www.Amazon.in/some-slug/dp/b0ftfmnybv/ref=x?tag=1#top", "https://amazon.in/dp/B0FTFMNYBV"),
        ("http://Shop.example:80/A?utm_source=x&b=1,2&c#f", "http://shop.example/A?b=1,2&c="),
        ("https://user@www.shop.example:8443", "https://shop.example:8443/"),
        ("https://www.flipkart.com/x/p/itm1?lid=2&pid=ABC", "https://flipkart.com/x/p/itm1?pid=ABC"),
        ("https://etsy.com/in-en/listing/123/slug?x=1", "https://etsy.com/listing/123"),
        ("https://www.in/x/", "https://www.in/x/"),
    ],
)
def test_canonical(spark, raw, same):
    frame = spark.createDataFrame([(raw,)], "u string")
    assert frame.select(urls.canonical(frame.u)).first()[0] == same


def test_measures(spark):
    cases = [("1.2 kg", 1200), ("2 lb", 907), ("1,200 g", 1), ("0.5 g", 0), ("2.5 g", 2), ("5 stone", None), (None, None), ("", None)]
    frame = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    assert [r[0] for r in frame.select(values.measured(frame.t, values.GRAMS)).collect()] == [x for _, x in cases]


def test_plan_keeps_the_first_and_marks_what_is_no_link(spark):
    links = [(1, "https://a.example/x?ref=1"), (2, "https://a.example/x"), (3, "no link"), (4, None)]
    got = {r.line: (r.status, r.first_line) for r in ledger.plan(spark.createDataFrame(links, "line long, raw string")).collect()}
    assert got == {1: ("ok", 1), 2: ("duplicate", 1), 3: ("invalid", None), 4: ("invalid", None)}

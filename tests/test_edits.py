import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wareloom.operators import edits

START = datetime(2024, 1, 1)


def test_standing_edits_at_any_moment(spark):
    r = random.Random(3)
    log = [(k, START + timedelta(minutes=r.randrange(40)), r.choice("ab"), r.choices(["set", "undo", "clear"], [6, 4, 1])[0], r.choice(["title", "sizes"]), f"v{k}") for k in range(120)]
    odd = [(900, None, "a", "set", "title", "x"), (901, START, None, "set", "title", "x"), (902, START, "a", "set", None, "x"), (903, START, "a", "other", "title", "x")]
    frame = spark.createDataFrame(log + odd, edits.EVENTS).repartition(3)
    for minute in (-1, 0, 7, 20, 33, None):
        stacks = {}
        for number, at, row, kind, field, value in sorted(log, key=lambda x: (x[1], x[0])):
            if minute is None or at <= START + timedelta(minutes=minute):
                stack = stacks.setdefault((row, field), [])
                if kind == "set":
                    stack.append((value, number))
                elif kind == "clear":
                    stack.clear()
                elif stack:
                    stack.pop()
        moment = None if minute is None else F.lit(START + timedelta(minutes=minute))
        got = {(x.row_key, x.field): (x.value, x.event_id) for x in edits.standing(frame, moment).collect()}
        assert got == {k: s[-1] for k, s in stacks.items() if s}


def test_what_stands_is_laid_over_the_records(spark):
    records = spark.createDataFrame([(1, "red", None), (2, "blue", "S"), (3, None, "M")], "k int, title string, sizes string")
    log = [(1, START, "1", "set", "title", "new"), (2, START, "2", "set", "sizes", ""), (3, START, "3", "set", "title", "x"), (4, START, "3", "undo", "title", None)]
    out = edits.edited(records, edits.standing(spark.createDataFrame(log, edits.EVENTS)), "k", ["title", "sizes"])
    assert sorted(map(tuple, out.collect())) == [(1, "new", None), (2, "blue", None), (3, None, "M")]


def test_many_rows_at_once(spark):
    records = spark.createDataFrame([("a", "apparel"), ("b", "jewellery"), ("c", None), ("c", None)], "k string, category_slug string")
    log = spark.createDataFrame([(1, START, "b", "set", "subcategory_slug", "rings")], edits.EVENTS)
    asks = [
        (1, "a", "subcategory_slug", "kids"), (1, "b", "subcategory_slug", "kids"), (1, "gone", "subcategory_slug", "kids"),
        (2, "c", "category_slug", " apparel "), (2, "c", "subcategory_slug", "kids"), (2, "c", "sizes", "S, M"),
        (3, "b", "category_slug", "apparel"), (4, "a", "price_inr", "free"), (4, "a", "hs_code", "1"), (5, "b", "title", None), (6, "a", "nonsense", "x"),
    ]
    judged = edits.judged(records, log, spark.createDataFrame(asks, "request_id int, row_key string, field string, value string"), "k").cache()
    got = {(x.request_id, x.row_key, x.field): x.fault for x in judged.collect()}
    assert len(got) == len(asks)
    assert [got[1, k, "subcategory_slug"] for k in ("a", "b", "gone")] == [None, "unknown_subcategory", "no_such_row"]
    assert {got[2, "c", f] for f in ("category_slug", "subcategory_slug", "sizes")} == {None}
    # an older edit, of a shelf, doesn't go with the new category
    assert got[3, "b", "category_slug"] == "unknown_subcategory"
    assert got[4, "a", "price_inr"] == got[4, "a", "hs_code"] and got[4, "a", "hs_code"] in ("not_a_number", "bad_hs_code")
    assert got[5, "b", "title"] == "no_title" and got[6, "a", "nonsense"] == "unknown_field"
    assert {(x.request_id, x.row_key) for x in edits.refused(judged).collect()} == {(1, "b"), (1, "gone"), (3, "b"), (4, "a"), (5, "b"), (6, "a")}
    events = edits.applied(judged, F.lit(START), 10).collect()
    assert sorted((x.row_key, x.field, x.value) for x in events) == [("a", "subcategory_slug", "kids"), ("c", "category_slug", "apparel"), ("c", "sizes", "S, M"), ("c", "subcategory_slug", "kids")]
    assert len({x.event_id for x in events}) == 4 and min(x.event_id for x in events) >= 10

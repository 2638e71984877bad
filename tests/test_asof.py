import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from wareloom.operators.asof import asof, known_bad

START = datetime(2024, 1, 1)


def test_against_trying_every_entry(spark):
    for seed in range(4):
        r = random.Random(seed)
        moment = lambda: None if r.random() < 0.05 else START + timedelta(seconds=r.choice([r.randrange(60), r.randrange(4000) - 2000]))  # noqa: E731, B023
        entries = [(r.choice(["a", "b", None]), r.choice([1, 2]), moment(), r.randrange(3), k) for k in range(120)]
        rows = [(r.choice(["a", "b", "c", None]), r.choice([1, 2]), moment(), k) for k in range(150)]
        rows += rows[:10]
        valid, parts = r.choice([(1, 1), (30, 4), (900, 16), (10, 7)])
        left = spark.createDataFrame(rows, "p string, m int, at timestamp, id int").repartition(3).withColumn("entry", F.lit("old"))
        right = spark.createDataFrame(entries, "p string, m int, made timestamp, rank int, k int").repartition(2)
        out = asof(left, right, ["p", "m"], "at", valid, "made", ["rank"], parts=parts)
        assert out.columns == ["p", "m", "at", "id", "entry"]
        got = sorted(((x.id, x.p, x.entry and x.entry.k) for x in out.collect()), key=repr)
        want = []
        for p, m, at, i in rows:
            fits = [(made, rank, k) for q, n, made, rank, k in entries if p is not None and (q, n) == (p, m) and at and made and timedelta() <= at - made <= timedelta(seconds=valid)]
            want.append((i, p, max(fits)[2] if fits else None))
        assert got == sorted(want, key=repr)


def test_nothing_and_much(spark):
    rows = spark.createDataFrame([("a", START)] * 3, "p string, at timestamp")
    none = asof(rows, rows.limit(0), ["p"], "at", 5)
    assert [x.entry for x in none.collect()] == [None] * 3 and asof(rows.limit(0), rows, ["p"], "at", 5).count() == 0
    # both ends of the validity count
    late = spark.createDataFrame([("a", START + timedelta(seconds=5), 3), ("a", START + timedelta(seconds=5, microseconds=1), 3)], "p string, at timestamp, n int")
    counted = rows.limit(1).withColumn("failed", F.lit(3))
    got = asof(late, counted, ["p"], "at", 5).select(known_bad(F.col("entry"), 3, "failed").alias("bad"), "at").orderBy("at").collect()
    assert [x.bad for x in got] == [True, False]


def test_a_hot_key_is_many_groups(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("p"), F.timestamp_seconds(F.col("id")).alias("at"), "id")
    out = asof(rows, rows.where("id % 50 = 0"), ["p"], "at", 100, parts=10)
    assert out.where("entry.id = id - id % 50").count() == 20_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "_b" in plan

import random

import pytest

from wareloom.sources import readers
from wareloom.sources.quoted import read_quoted, records


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "97b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(6))
def test_as_the_reader_of_whole_files(spark, small_splits, tmp_path, seed):
    r = random.Random(seed)
    sep = ",;"[seed % 2]
    cell = lambda: "".join(r.choices(["a", "b", '"', "\n", sep, " ", "é", '""'], k=r.randint(0, 9)))

    def written(c):
        plain = c.startswith('x"y') or not (any(x in c for x in f'"\n{sep}') or r.random() < 0.2)
        return c if plain else '"' + c.replace('"', '""') + '"'

    end = "\r\n" if seed in (1, 4) else "\n"
    for name in "fg":
        rows = [[str(k), f'x"y{k}' if seed > 2 and r.random() < 0.3 else cell(), cell()] for k in range(50)]
        body = end.join(sep.join(map(written, x)) for x in [["k", "one", "two"], *rows]) + (end if r.random() < 0.5 else "")
        (tmp_path / f"{name}.csv").write_bytes(body.encode())
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    got = sorted(map(repr, read_quoted(spark, str(tmp_path), ["k", "one", "two"], sep).collect()))
    assert got == sorted(map(repr, spark.read.csv(str(tmp_path), sep=sep, header=True, multiLine=True, escape='"').collect()))


def test_records_longer_than_splits_and_odd_ends(spark, small_splits, tmp_path):
    long = "line\n" * 200
    text = f'\ufeffk,v\n1,"{long}"\n\n2,"open ""\nnot closed\n3,4'
    (tmp_path / "a.csv").write_text(text)
    got = read_quoted(spark, str(tmp_path), ["k", "v"]).collect()
    assert [x.k for x in got if x.v == long] == ["1"] and len(got) == 2
    first = [x for x in records(spark, str(tmp_path)).collect() if x.first]
    assert [x.record for x in first] == ["k,v"]


def test_short_rows_and_lone_carriage_returns(spark, tmp_path):
    (tmp_path / "short.csv").write_text("a,b,c\n1\n2,3\n4,5,6,7\n")
    assert [tuple(x) for x in readers.read_export(spark, str(tmp_path / "short.csv")).orderBy("a").collect()] == [("1", None, None), ("2", "3", None), ("4", "5", "6")]
    (tmp_path / "mac.csv").write_bytes(b"a,b\r1,2\r3,4\r")
    assert sorted(tuple(x) for x in readers.read_export(spark, str(tmp_path / "mac.csv")).collect()) == [("1", "2"), ("3", "4")]

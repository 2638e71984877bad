import pytest
from pyspark.sql import functions as F

from wareloom.operators import checks, plugins, records, reports


def rows(spark, n=3):
    cell = "struct<value:string,confidence:string,source:string,note:string>"
    frame = spark.createDataFrame([(k, f"k{k}", (f'a "b",{k}\nc', "high", "x", None)) for k in range(n)], f"n int, row_key string, title {cell}")
    return records.complete(frame.withColumn("source_url", F.lit("https://a.example")))


def test_listings_are_appended_under_one_header(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    records.append_listings(rows(spark), path, "n")
    records.append_listings(rows(spark, 1), path, "n")
    lines = "".join(sorted(p.read_bytes().decode() for p in (tmp_path / "out/rows").glob("part-*")))
    assert (tmp_path / "out/header").is_dir() and lines.count("\r\n") == 4 and '"a ""b"",0\nc",' in lines
    spark.createDataFrame([("other",)], "line string").coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/header")
    with pytest.raises(records.HeaderMismatch):
        records.append_listings(rows(spark), path, "n")


def test_an_empty_record_has_no_faults(spark):
    bare = records.complete(spark.createDataFrame([("k", "needs_review")], "row_key string, status string"))
    got = bare.select(records.missing_required().alias("m"), records.needs_review().alias("r"), records.cell_depths().alias("d")).first()
    assert (got.m, got.r, got.d) == ([], False, "00000000000000-00000")


def test_nothing_fills_the_locked_cell():
    with pytest.raises(ValueError, match="nothing may fill"):
        plugins.Plugin("p", lambda u, h: F.lit(True), {"gi_region": lambda h: (F.lit("x"), "high")})


def test_steps_without_the_hotlink_test(spark):
    judged = spark.createDataFrame([(1, "too_small"), (2, None)], "k int, reason string")
    got = checks.steps(judged, ["k"], hotlink_test=False).collect()
    by = {k: [r.outcome for r in sorted(got, key=lambda r: r.place) if r.k == k] for k in (1, 2)}
    assert by[1] == ["ok"] * 6 + ["fail", "not reached", "skipped"] and by[2] == ["ok"] * 8 + ["skipped"]


@pytest.mark.parametrize(
    ("link", "fault"),
    [
        ("http://127.0.0.1/", "loopback"), ("http://[::1]/", "loopback"), ("http://192.168.1.1", "private"), ("http://[::ffff:10.0.0.1]/", "private"), ("http://[64:ff9b::a00:1]/", "private"),
        ("http://169.254.169.254/latest", "metadata"), ("http://169.254.1.1/", "link_local"), ("http://224.0.0.1/", "multicast"), ("ftp://a.example", "no_http"), ("http:///x", "no_host"), (None, "no_http"),
        ("https://a.example/", None), ("https://8.8.8.8/", None), ("http://[bad", "no_host"),
    ],
)
def test_addresses(spark, link, fault):
    assert spark.createDataFrame([(link,)], "u string").select(checks.address_fault(F.col("u"))).first()[0] == fault


def test_keeping_the_first_of_a_content(spark):
    frame = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None)], "n int, content string")
    assert sorted(r.n for r in reports.by_content(frame, "content", "n").collect()) == [1, 2, 4]

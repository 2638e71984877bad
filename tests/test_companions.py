from datetime import datetime

from wareloom.operators import companions, records

FILE = "array<struct<hosted_url:string,original_url:string,local_path:string,bytes:bigint,width:int,height:int>>"


def test_tables_have_all_their_columns(spark):
    bare = spark.createDataFrame([("k", "ok"), ("m", "failed")], "row_key string, status string")
    plan = spark.createDataFrame([], "source_url string, outcome string, reason string, decided_at timestamp")
    assert companions.review_table(bare).columns == list(companions.REVIEW) and companions.review_table(bare).count() == 0
    failed = companions.failed_table(bare, plan)
    assert failed.columns == list(companions.FAILED) and [tuple(r) for r in failed.collect()] == [(None, "failed", "unknown", "", "", "", "", None)]
    assert companions.manifest_table(bare).columns == list(companions.MANIFEST) and companions.manifest_table(bare).count() == 0
    pictures = companions.images_table(bare)
    assert pictures.columns[:22] == ["row_key", *records.COLUMNS, "source_url"] and pictures.columns[-5:] == ["method", "reason", "width", "height", "local_image_path"]
    assert pictures.count() == 2
    links = companions.links_table(spark.createDataFrame([(1, None, "=x")], "n int, links array<string>, own string"), "n", "links", ["own"], 2)
    assert links.columns == ["own", *companions.LINKS, "n", "image_url_1", "image_url_2"] and links.first().image_count == "0" and links.first().own == "'=x"


def test_links_that_never_became_records(spark):
    at = datetime(2024, 1, 2, 3, 4, 5)
    rows = spark.createDataFrame([("k", "failed", "https://a/1", "http_404", None, at), ("m", "ok", "https://a/2", None, None, at), ("n", "failed", "https://a/3", "http_x", 500, at)],
                                 "row_key string, status string, source_url string, failure_reason string, http_status int, fetched_at timestamp")
    plan = [("https://a/1", "failed", "other", at), ("https://a/2", "refused", "other", at), ("https://a/4", "refused", "robots_disallowed", at), ("https://a/5", "failed", None, None), ("https://a/6", "written", None, at)]
    out = companions.failed_table(rows, spark.createDataFrame(plan, "source_url string, outcome string, reason string, decided_at timestamp"))
    got = {r.source_url: (r["class"], r.reason, r.stage, r.http_status, r.attempted_at) for r in out.collect()}
    assert got == {
        "https://a/1": ("failed", "http_404", "", "404", "2024-01-02T03:04:05"), "https://a/3": ("failed", "http_x", "", "500", "2024-01-02T03:04:05"),
        "https://a/4": ("refused", "robots_disallowed", "not_attempted", "", "2024-01-02T03:04:05"), "https://a/5": ("failed", "unknown", "not_attempted", "", None),
    }

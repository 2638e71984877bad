from wareloom.operators import intake
from wareloom.sources import links


def test_previews_count_all_and_show_the_first(spark):
    many = "\n".join(f"https://a{k % 3}.example/p/{k}" for k in range(12)) + "\nhttps://www.a0.example/p/0\n" + "\n".join(f"typo {k}" for k in range(7))
    rows = [(1, many), (2, "nothing here"), (3, ""), (None, "b.example/x")]
    found = links.scan_texts(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    got = {r.k: r for r in intake.previews(found, "k", 5, 4).collect()}
    assert set(got) == {1, 2, None}
    one = got[1]
    assert (one.accepted, one.duplicates, one.unparsed, one.hosts, one.truncated) == (12, 1, 7, 3, True)
    assert [x.text for x in one.links] == [f"https://a{k % 3}.example/p/{k}" for k in range(5)] and [x.text for x in one.leftovers] == [f"typo {k}" for k in range(4)]
    assert [x.line_no for x in one.leftovers] == [14, 15, 16, 17]
    assert (got[2].accepted, got[2].unparsed, got[2].links, got[2].truncated) == (0, 1, [], False) and (got[None].accepted, got[None].leftovers) == (1, [])


def test_records_for_another_try(spark):
    kind = "row_key string, status string, image_url string, image_candidates array<string>, notes array<string>"
    rows = [("a", "needs_review", "", ["x"], ["n"]), ("b", "failed", None, ["x"], []), ("c", "ok", "https://a/1", ["x"], []), ("d", "ok", "", [], [])]
    got = {r.row_key: (r.status, r.notes) for r in intake.rehostable(spark.createDataFrame(rows, kind)).collect()}
    assert got == {"a": ("ok", []), "b": ("ok", [])}

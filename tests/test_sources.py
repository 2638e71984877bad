from wareloom.sources import exports, links


def test_links_keep_order_and_repeats(spark):
    text = "x https://a.example/1,https://a.example/1\n\n(https://b.example/q_(z)) ​https://c.example."
    frame = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    got = sorted((r.line_no, r.pos, r.link) for r in links.links_in_lines(frame, "k", "t").collect())
    assert got[:2] == [(1, 0, "https://a.example/1"), (1, 1, "https://a.example/1")]
    assert got[3] == (3, 1, "https://c.example")


def test_columns_go_to_their_best_target():
    aliases = {"title": ["title"], "price": ["price"], "weight": ["weight"]}
    assert exports.map_columns(["Sub title", "Title", "Item Weight (kg)", "Notes", "pricing"], aliases) == {"title": "Title", "weight": "Item Weight (kg)"}


def test_export_cells(spark):
    cells = [("1.5 kg", 1500), ("1,200 g", 1200), ("2 pounds", 907), ("7", 7), ("heavy", None), (None, None)]
    frame = spark.createDataFrame([(t,) for t, _ in cells], "t string")
    assert [r[0] for r in frame.select(exports.grams(frame.t)).collect()] == [x for _, x in cells]

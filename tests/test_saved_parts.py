import base64

from wareloom.sources.saved_parts import photos, read_parts, read_saved_with_parts

MHTML = """From: <Saved by a browser>
Snapshot-Content-Location: https://shop.example/p/1
MIME-Version: 1.0
Content-Type: multipart/related; boundary="b"

--b
Content-Type: text/html
Content-Location: https://shop.example/p/1

<img src="/img/one.png"><img src="cid:two@x"><img src="other.png"><img srcset="https://cdn.example/a.png?v=1 2x, b 1x">
--b
Content-Type: image/png
Content-Transfer-Encoding: base64
Content-Location: https://shop.example/img/one.png

{one}
--b
Content-Type: image/png
Content-Transfer-Encoding: base64
Content-ID: <two@x>

{two}
--b--
"""


def test_parts_of_saved_pages(spark, tmp_path):
    folder = tmp_path / "my page_files"
    folder.mkdir()
    for k in range(15):
        (folder / f"p {k}.jpg").write_bytes(b"x" * (100 + k))
    (folder / "Same.JPG").write_bytes(b"x" * 114)
    (folder / "style.css").write_text("a{}")
    (tmp_path / "my page.html").write_text(
        "<link rel=canonical href=https://shop.example/d/x><img src='./my%20page_files/p%203.jpg?x=1'><img src='my page_files/same.jpg' data-src='/far.jpg'><img src='data:image/png,x'><source srcset='my%20page_files/p%204.jpg 1x, b 2x'><img src='50%.jpg'>"
    )
    (tmp_path / "bare.htm").write_text("<img src=a.jpg>")
    one, two = (base64.b64encode(x).decode() for x in (b"one" * 9, b"two"))
    (tmp_path / "saved.mhtml").write_text(MHTML.format(one=one, two=two))
    pages, refs, kept = read_saved_with_parts(spark, str(tmp_path))
    assert pages.count() == 3
    got = {(r.page_id.rpartition("/")[2], r.place, r.attribute): (r.link, r.saved) for r in refs.collect()}
    page, archive = next(k[0] for k in got if k[0].startswith("my")), "saved.mhtml"
    assert got == {
        (page, 0, "src"): (None, "p 3.jpg"), (page, 1, "src"): (None, "Same.JPG"), (page, 1, "data-src"): ("https://shop.example/far.jpg", None), (page, 3, "srcset"): (None, "p 4.jpg"),
        (page, 4, "src"): ("https://shop.example/d/50%.jpg", None), ("bare.htm", 0, "src"): (None, None),
        (archive, 0, "src"): ("https://shop.example/img/one.png", "one.png"), (archive, 1, "src"): (None, "cid:two@x"),
        (archive, 2, "src"): ("https://shop.example/p/other.png", None), (archive, 3, "srcset"): ("https://cdn.example/a.png?v=1", None),
    }
    shots = sorted((r.page_id.rpartition("/")[2], r.rank, r.bytes, r.uri) for r in kept.collect())
    own = [s for s in shots if s[0] == page]
    assert [s[1] for s in own] == list(range(12)) and [s[2] for s in own] == list(range(114, 102, -1))
    assert [(s[2], s[3]) for s in shots if s[0] == archive] == [(27, f"data:image/png;base64,{one}"), (3, f"data:image/png;base64,{two}")]


def test_no_parts(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>x")
    assert read_parts(spark, str(tmp_path)).count() == 0 and photos(read_parts(spark, str(tmp_path))).count() == 0

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wareloom.llm.html_text import extract_text, visible_text


def test_formulas():
    page = "<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><mspace/></mrow><annotation>x=\\half</annotation></semantics></math> holds"
    assert visible_text(page) == "so x= 1 2 holds"


def test_images_of_text():
    svg = "<svg><title>t</title><desc>d</desc><defs><text>no</text></defs><path d='M0'/><defs/>loose<g><text>Jan<title>t</title></text><text>F<tspan>eb</tspan></text></g></svg>"
    assert visible_text(f"<p>chart {svg} end") == "chart Jan Feb end"
    assert visible_text("<svg><foreignObject><p>inner</p></foreignObject></svg>after") == "inner\n\nafter"
    assert visible_text("<svg><g><div>an open image ends here</div>") == "an open image ends here"
    assert visible_text("<object data='x.swf'><p>instead</p></object>") == "instead"


def test_open_head():
    assert visible_text("<head><title>t</title> text at once<p>more") == "text at once\n\nmore"
    assert visible_text("<head> <meta charset=utf-8> <style>s</style> <link rel=x>\n<body>b") == "b"
    assert visible_text("<head><img alt='logo'>text") == "logotext"


def test_visibility_is_handed_down():
    assert visible_text("a <span style='visibility:hidden'>b <i style='visibility: visible'>c</i> d</span> e") == "a c e"
    assert visible_text("<span style='visibility:hidden'>b <i style='display:block'>c</i><img alt=x></span>") == ""
    assert visible_text("<p style='backface-visibility:hidden'>a") == "a"
    table = "<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes</table>"
    assert visible_text(table).strip(" |") == "yes"


@pytest.mark.parametrize("page", [
    "<ol start='²'><li>a</ol>", "<ol start='--5'><li>a</ol>", f"<ol start='{'9' * 5000}'><li>a</ol>", "<table><tr><td colspan='²' rowspan='x'>a</table>",
    "<table><tr><td>" * 400 + "a", "<table><tr><td>" * 5000 + "a", "<p" * 50 + ">a", "<svg><math>" * 3000 + "<mi>a",
])
def test_odd_pages_have_their_text(page):
    assert re.sub(r"[^a]", "", visible_text(page)) == "a"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "</", "<p>", "<table>", "<tr>", "<td colspan=2>", "<td rowspan=0>", "<li>", "<ol start=", "'", '"', "=", "<pre>", "<style>p{", "}", "<svg>", "<math>", "<br>", "</td>", "</table>", "<!--", "-->", "<dd>", "a", "\n", "&amp;", "<textarea>", "\x00", "é"]), max_size=40))
def test_any_markup_ends(parts):
    visible_text("".join(parts))


def test_long_pages_take_linear_time():
    began = time.time()
    for page in ("<p>" * 5 + "<div>" * 60_000, "<p><table><td>" + "<div>" * 60_000, "</p>" * 60_000, "<li>" * 60_000, "<b>" * 60_000 + "<p>" * 2_000, '<a b="' * 60_000):
        visible_text(page)
    assert time.time() - began < 60


def test_values_and_verbatim_text():
    assert visible_text("<input value=typed> <input type=hidden value=no><input type=password value=no><input type=submit value=Go>") == "typed Go"
    assert visible_text("x<pre>a\n\n  b\n</pre>y") == "x\n\na\n\n  b\n\ny"
    assert visible_text("<table><tr><td><pre>a\n  b</pre><td>c</table>") == "a   | c\n  b |"
    assert visible_text("<ul><li value=3>a</ul><ol><li value=3>a<li>b</ol>") == "- a\n\n3. a\n4. b"


def test_cells_over_columns_and_rows():
    page = "<table><tr><th colspan=2>name<th>n<tr><td rowspan=2>left<td>one<td>1<tr><td>three<td>22</table>"
    assert visible_text(page) == "name         | n\nleft | one   | 1\n     | three | 22"
    assert visible_text("<table><tr><td colspan=3>a long head over all<tr><td>b<td>c<td>d</table>") == "a long head over all\nb | c | d"


def test_style_sheets():
    page = "<style>/* p{} */ .off, #gone{display:none} p.off{display: block} b{visibility:hidden} @media print{i{display:none}}</style>"
    page += "<div class='x off'>no</div><p class=off>yes</p><div id=gone>no</div><b>no<i style='visibility:visible'>seen</i></b><span style='display:none'>no</span>end"
    assert visible_text(page) == "yes\n\nseenend"


def test_nested_blocks_of_style_sheets():
    seen = lambda sheet: visible_text(f"<style>{sheet}</style><i>a</i> <b>b</b>")
    assert seen("@media print{i{display:none}}") == "a b"
    assert seen("@media print{@media screen{i{display:none}} b{display:none}} b{display:none}") == "a"
    assert seen("@media all{@media screen{i{display:none}} b{color:red}}") == "b"
    assert seen("@layer base{i{display:none}}@keyframes x{from{display:none}b{display:none}}") == "b"
    assert seen("i{color:red; &:hover{display:none} display:none} b{content:'}'}") == "b"
    assert seen("@media screen{i{display:none}") == "b" and seen("i{display:none") == "b" and seen("}}i{display:none}") == "b"
    assert visible_text("<p aria-hidden=true>read</p>") == "read"


def test_quotes():
    assert visible_text("<p title=\"open>text</p> after") == "text\n\nafter"
    assert visible_text("<p it's>don't</p><a href='x>y'>z</a>") == "don't\n\nz"


def _random_page(r):
    """Markup, with end tags left out here and there, and its words in order, each with whether it is to be seen."""
    words, out, number = [], [], iter(range(10**6))

    def word(seen):
        w = f"w{next(number)}x"
        words.append((w, seen))
        out.append(w)

    def block(depth, seen):
        for _ in range(r.randint(1, 4)):
            kind = r.choice(["p", "div", "ul", "table", "span", "hide", "script", "text", "pre", "head"] if depth < 4 else ["text", "p", "script"])
            if kind == "text":
                word(seen)
                out.append(r.choice([" ", "\n", "<br>", "<!-- c -->"]))
            elif kind == "p":
                out.append("<p>")
                word(seen)
                out.append(r.choice(["</p>", "</p>", "<p>"]))
            elif kind in ("div", "span"):
                out.append(f"<{kind}>" if kind == "div" else "<div><b>")
                block(depth + 1, seen)
                out.append("</div>" if kind == "div" else "</b></div>")
            elif kind == "ul":
                kind = r.choice(["<ul>", "<ol start=7>"])
                out.append(kind)
                for _ in range(r.randint(1, 3)):
                    out.append("<li>")
                    block(depth + 1, seen)
                    out.append(r.choice(["", "</li>"]))
                out.append(f"</{kind[1:3]}>")
            elif kind == "table":
                out.append("<table>")
                for _ in range(r.randint(1, 3)):
                    out.append("<tr>")
                    out.append(r.choice(["<td>", "<th colspan=2>"]))
                    word(seen)
                    out.append(r.choice(["", "</td>", "</td></tr>"]))
                out.append("</table>")
            elif kind == "hide":
                out.append(r.choice(["<div hidden>", "<div style='color:red;display : none'>", "<div class=off>", "<div class=late>"]))
                block(depth + 1, False)
                out.append("</div>")
            elif kind == "script":
                out.append("<script>var a='</p>nothing';</script>")
            elif kind == "pre":
                out.append("<pre>")
                word(seen)
                out.append("\n\n ")
                word(seen)
                out.append("</pre>")
            else:
                out.append("<h2>")
                word(seen)
                out.append("</h2>")

    sheet = [".off{display:none}", "@media screen{.late{color:red;display:none}}"]
    for _ in range(r.randint(0, 4)):
        inner = r.choice(["p,div,b{display:none}", "h2{visibility:hidden}", "@supports (display:grid){li{display:none}}", "td{}"])
        head = r.choice(["@media print", "@media (max-width: 600px)", "@supports (x: '}')", "@media screen and (min-width:1px)", "@page"])
        sheet.insert(r.randint(0, len(sheet)), f"{head}{{{inner} /* }} */ {inner}}}")
    sheet.insert(0, r.choice(["", "@import url('a;{b.css');", "@charset \"utf-8\";", "u{content:'}'}", "@font-face{src:url(a)}"]))
    out.append(f"<html><head><title>t</title><style>{r.choice(['', ' ']).join(sheet)}</style></head><body>")
    block(0, True)
    return "".join(out), words


def test_all_visible_words_of_random_pages_in_order():
    for seed in range(400):
        page, words = _random_page(random.Random(seed))
        assert re.findall(r"w\d+x", visible_text(page)) == [w for w, seen in words if seen], page


def test_pages_of_any_kind(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "<p>x", "a"), (3, "<p>x", "b"), (None, "y" * 200_000, "a")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted(r.text for r in got) == ["", "", "x", "x", "y" * 200_000]
    assert extract_text(spark.createDataFrame([], "page_id long, html string")).count() == 0

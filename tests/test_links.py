import random
import time

import pytest

from wareloom.sources.links import gaps, link_end, scan_line, scan_paste, scan_texts


@pytest.mark.parametrize(
    ("line", "links", "left"),
    [
        ("https://a.example/x,https://b.example/y", ["https://a.example/x,", "https://b.example/y"], []),
        ("https://a.example/?ids=1,2;3.", ["https://a.example/?ids=1,2;3"], []),
        ("(https://a.example/p_(1)).", ["https://a.example/p_(1)"], []),
        ("<https://a.example>|'https://b.example'", ["https://a.example", "https://b.example"], []),
        ("mail me@shop.example or notes.txt", [], ["mail me@shop.example or notes.txt"]),
        ("shop.example/notes.txt, notes.txt", ["https://shop.example/notes.txt"], ["notes.txt"]),
        ("Shop.Example and more", ["https://Shop.Example"], []),
        ("buy a.example; or this/that", ["https://a.example"], ["or this/that"]),
        ("one, two;; - |", [], ["one", "two"]),
        ("https:// nothing", [], ["https:// nothing"]),
        ("", [], []),
    ],
)
def test_lines(line, links, left):
    found, rest = scan_line(line)
    assert ([x.rstrip(",") for _, x, _ in found], rest) == ([x.rstrip(",") for x in links], left)


def test_gaps_and_spans_make_up_the_whole():
    r = random.Random(1)
    for _ in range(300):
        size = r.randrange(20)
        cuts = sorted(r.choices(range(size + 1), k=2 * r.randrange(4)))
        spans = [(a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        left = list(gaps(spans, size))
        assert sorted(k for a, b in [*left, *spans] for k in range(a, b)) == list(range(size)) and all(a < b for a, b in left)


def test_brackets_at_the_end():
    assert "x)]"[: link_end("x)]")] == "x" and "(x)"[: link_end("(x).!")] == "(x)" and link_end("...") == 0


def test_markup_hidden_characters_and_lines():
    got = list(scan_paste("[a.example/x](https://b.example/y)\r\nhref = 'c.example/z'\u2028https://d.ex\u200bample\u00a0e\n\n\uff48ttps://f.example"))
    assert got == [(1, 0, "link", "https://b.example/y"), (2, 0, "domain", "https://c.example/z"), (3, 0, "link", "https://d.example"), (5, 0, "link", "https://f.example")]


def test_five_thousand_links_take_little_time():
    paste = "\n".join(f"https://a.example/p/{k}, www.b{k}.example/q;" for k in range(2500))
    list(scan_paste(paste))
    began = time.process_time()
    got = list(scan_paste(paste))
    assert len(got) == 5000 and time.process_time() - began < 0.2
    line = " ".join(f"https://a.example/p/{k} b.example/{k}" for k in range(2500))
    began = time.process_time()
    assert len(scan_line(line)[0]) == 5000 and time.process_time() - began < 0.2


def test_tables(spark):
    rows = [(1, "x.example\nword"), (None, None), (3, ""), (3, "a.example"), (3, "a.example")]
    got = sorted((r.k or 0, r.line_no, r.pos, r.kind, r.text) for r in scan_texts(spark.createDataFrame(rows, "k long, text string"), "k", "text").collect())
    assert got == [(1, 1, 0, "domain", "https://x.example"), (1, 2, 0, "unparsed", "word"), (3, 1, 0, "domain", "https://a.example"), (3, 1, 0, "domain", "https://a.example")]

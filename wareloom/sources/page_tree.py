"""A page's elements and texts in reading order, from one pass of the standard HTML parser.

Nothing is nested: elements are numbered as they open, the elements within one are the numbers up to ``last`` of it, and
its texts are a slice of all texts. So a question about what is inside an element is a slice, however deep it lies.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from html.parser import HTMLParser
from itertools import accumulate

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
UNSEEN = frozenset(("script", "style", "template", "noscript"))
#: What a start tag closes that was left open, and what keeps it from looking further out.
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "p": ({"p"}, {"td", "th", "table", "li", "div"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
}


class Page(HTMLParser):
    """By number of an element: ``tags``, ``given`` (its attributes), ``up`` (the one around it, -1 for none), ``last``
    (one more than the last number inside), ``texts`` (bounds in ``parts``, the page's texts without white space around
    them). ``code``: what scripts hold."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags: list[str] = []
        self.given: list[dict[str, str]] = []
        self.up: list[int] = []
        self.last: list[int] = []
        self.begins: list[int] = []
        self.ends: list[int] = []
        self.parts: list[str] = []
        self.code: dict[int, list[str]] = {}
        self._open: list[int] = []
        self._depths: dict[str, list[int]] = defaultdict(list)
        self._unseen = 0
        self.feed(html)
        self.close()
        self._close(0)
        self._index()

    # ---- parsing

    def _close(self, depth: int) -> None:
        """Close what is open at ``depth`` and deeper."""
        for e in reversed(self._open[depth:]):
            self.last[e], self.ends[e] = len(self.tags), len(self.parts)
            self._depths[self.tags[e]].pop()
            self._unseen -= self.tags[e] in UNSEEN
        del self._open[depth:]

    def _innermost(self, tags) -> int:
        return max((d[-1] for t in tags if (d := self._depths.get(t))), default=-1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS:
            closes, keeps = _ENDS[tag]
            at = self._innermost(closes)
            if at > self._innermost(keeps):
                self._close(at)
        e = len(self.tags)
        self.tags.append(tag)
        self.given.append({k: v or "" for k, v in reversed(attrs)})
        self.up.append(self._open[-1] if self._open else -1)
        self.last.append(e + 1)
        self.begins.append(len(self.parts))
        self.ends.append(len(self.parts))
        if tag not in _VOID:
            self._depths[tag].append(len(self._open))
            self._open.append(e)
            self._unseen += tag in UNSEEN

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._close(len(self._open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if self._depths.get(tag):
            self._close(self._depths[tag][-1])

    def handle_data(self, data: str) -> None:
        if self._unseen:
            self.code.setdefault(self._open[-1], []).append(data)
        elif text := data.strip():
            self.parts.append(text)

    def updatepos(self, i: int, j: int) -> int:
        """Lines aren't counted: nothing asks for them."""
        return j

    # ---- questions

    def _index(self) -> None:
        self.by: dict[str, list[int]] = defaultdict(list)
        for e, (tag, given) in enumerate(zip(self.tags, self.given, strict=True)):
            self.by[tag].append(e)
            for name, value in given.items():
                self.by[f"[{name}]"].append(e)
                if name == "class":
                    for c in dict.fromkeys(value.split()):
                        self.by[f".{c}"].append(e)
                elif name == "id":
                    self.by[f"#{value}"].append(e)
        #: Characters of all texts before each.
        self.before = [0, *accumulate(map(len, self.parts))]

    def at(self, place: str) -> list[int]:
        """Elements that a place means, in order: ``tag``, ``.class``, ``#id``, ``[attribute]`` or ``[attribute=value]``."""
        name, sign, value = place.strip("[]").partition("=")
        if place[0] == "[" and sign:
            return [e for e in self.by.get(f"[{name}]", ()) if self.given[e][name] == value]
        return self.by.get(place, [])

    def holds(self, e: int, tag: str) -> bool:
        """Whether an element has one of ``tag`` inside."""
        own = self.by.get(tag, [])
        k = bisect_right(own, e)
        return k < len(own) and own[k] < self.last[e]

    def size(self, e: int) -> int:
        """Characters of an element's texts."""
        return self.before[self.ends[e]] - self.before[self.begins[e]]

    def text(self, e: int, between: str = " ") -> str:
        return between.join(self.parts[self.begins[e] : self.ends[e]])

    def inherited(self, marks: list[int]) -> list[int]:
        """Bits of each element together with those of all around it."""
        out: list[int] = []
        for e, own in enumerate(marks):
            out.append(own | (out[self.up[e]] if self.up[e] >= 0 else 0))
        return out

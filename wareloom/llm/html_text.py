"""Layout-aware text of HTML pages.

A tree builder supplies implied tags (a new list item ends the one before, a block ends an open paragraph, table rows
and cells end each other, end tags close what is open inside them). Visibility rules drop what a browser doesn't
show. The renderer then writes every visible text once: blocks apart by line ends, paragraphs and headings by an empty
line, list items behind their mark and indented by depth, table cells padded to their column's width.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wareloom.llm.common import bound_batches, in_slices, with_own_names

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript iframe audio video canvas datalist title".split())
#: What a head holds; any other tag, and text, ends one that is still open.
IN_HEAD = frozenset("head base link meta title style script template noscript".split())
#: Of an SVG image only text (and HTML within it) is written, and not what is there to be described or used elsewhere.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask pattern marker".split())
#: Of a formula all but its sources and what only takes up room.
UNSAID = frozenset("annotation annotation-xml mphantom".split())
#: Parts of a formula that aren't set on one line.
APART = frozenset("mfrac msub msup msubsup munder mover munderover mroot mmultiscripts mtable mtr mtd".split())
#: HTML starts again in these, inside an image or a formula; tags of the third set end an image or a formula they stand in.
FOREIGN, AGAIN = frozenset({"svg", "math"}), frozenset("foreignobject desc mi mo mn ms mtext annotation-xml".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
    "ruby s small span strong strike sub sup table tt u ul var".split()
)
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul caption".split()
)
#: Blocks with an empty line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure".split())
#: An open tag of the key's set is ended by a new one of the key's, unless a tag of the third set stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
SCOPE = frozenset({"table", "td", "th", "caption", "html", "body"})
#: A value may stand in quotes behind an equals sign; other quotes are characters like any.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_DECLARED = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([\w-]+)", re.IGNORECASE)
#: What matters in a style sheet's text: quoted text, the end of a statement, braces.
_SHEET = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[;{}]", re.DOTALL)
#: At-rules whose rules hold on any screen that shows the whole page.
_ALWAYS = re.compile(r"@media\s*(?:(?:only\s+)?screen|all)?\s*|@layer\b[^,]*", re.IGNORECASE)
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)\Z")
_NUMBER = re.compile(r"-?[0-9]{1,6}", re.ASCII)
_BLANK = re.compile(r"[ \t\r\n\f]+")
#: Inputs that show their value.
VALUED = frozenset("text search email url tel number date time month week datetime-local submit button reset".split())
#: Columns and rows that a cell takes at most, as HTML has it.
MOST_COLUMNS, MOST_ROWS = 1000, 65_534


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


class _Open:
    """The stack of open nodes, with the places of each tag in it, so that no question needs a walk over the stack."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {root.tag: [0]}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, size: int) -> None:
        while len(self.nodes) > size:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """The place of the innermost open node of ``tags``; -1 without one."""
        return max((places[-1] for t in tags if (places := self.places.get(t))), default=-1)

    def close(self, names, stops) -> bool:
        """Close the innermost of ``names`` and all that is open in it, unless one of ``stops`` stands between."""
        at = self.last(names)
        if at < 1 or self.last(stops) > at:
            return False
        self.cut(at)
        return True


def sheet_rules(sheet: str) -> list[tuple[str, str]]:
    """The (selector, declarations) of a style sheet, in order. The body of an at-rule counts if it has no condition but
    a screen (@media, @media screen, @media all, @layer); all others (print, widths, @supports, @keyframes ...) are
    skipped whole, as are rules nested in a rule. What isn't closed at the end is closed there."""
    sheet = re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.DOTALL)
    rules, open_, begin = [], [], 0  # open blocks: the selector of a rule, "" of an at-rule that counts, None of what is skipped
    for m in [*_SHEET.finditer(sheet), None]:
        sign, at, end = (m[0], m.start(), m.end()) if m else ("", len(sheet), len(sheet))
        if sign == "{":
            head = sheet[begin:at].strip()
            if any(x is None or x for x in open_):
                # inside a rule or what is skipped; a rule's own declarations stay readable on both sides
                open_.append(None)
            else:
                open_.append("" if _ALWAYS.fullmatch(head) else None if head.startswith("@") else head or None)
        elif sign == "}" or not m:
            if open_ and open_[-1]:
                rules.append((open_[-1], sheet[begin:at]))
            open_ = open_[:-1]
        elif sign == ";" and open_ and open_[-1]:
            rules.append((open_[-1], sheet[begin:at]))
        elif sign != ";":
            continue
        begin = end
    return rules


def parse(html: str) -> tuple[Node, list[tuple[str, str]]]:
    """The tree of a page, and the (selector, declarations) of its style sheets; never fails, whatever the markup."""
    root, rules = Node("#root", {}), []
    open_ = _Open(root)
    at, raw = 0, ""
    while at < len(html):
        here = open_.nodes[-1]
        if raw:
            end = re.compile(rf"</{raw}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
            stop = end.start() if end else len(html)
            here.children.append(unescape(html[at:stop]) if raw in ("textarea", "title") else html[at:stop])
            if raw == "style":
                rules += sheet_rules(html[at:stop])
            at, raw = end.end() if end else len(html), ""
            open_.cut(len(open_.nodes) - 1)
            continue
        m = _TOKEN.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            if here.tag == "head" and text.strip(" \t\r\n\f"):
                open_.cut(len(open_.nodes) - 1)
            open_.nodes[-1].children.append(unescape(text))
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                open_.nodes[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in VOID and tag != "br":
                continue
            if tag == "p" and not open_.places.get("p"):
                open_.nodes[-1].children.append(Node("p", {}))
            stops = {"table", "#root"} if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "li") else SCOPE - {tag}
            open_.close({tag}, stops if tag not in ("table", "html", "body") else ())
            continue
        own = {}
        if m[3].strip(" /\n\t"):
            for name, value in _ATTRIBUTE.findall(m[3]):
                own.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in "\"'" and value[-1:] == value[:1] and len(value) > 1 else value))
        inside = 0
        if (tag in BREAKOUT or m[3].endswith("/")) and open_.last(FOREIGN) > open_.last(AGAIN):
            inside = open_.last(FOREIGN)
            if tag in BREAKOUT:
                open_.cut(inside)
                inside = 0
        if tag in ("html", "body") and open_.places.get(tag):
            continue
        if tag != "html" and open_.nodes[-1].tag == "head" and tag not in IN_HEAD:
            open_.cut(len(open_.nodes) - 1)
        if tag in BLOCK and tag not in ("html", "body"):
            open_.close({"p"}, SCOPE)
        if tag in ENDS:
            while open_.close(*ENDS[tag]):
                pass
        if re.fullmatch("h[1-6]", tag) and re.fullmatch("h[1-6]", open_.nodes[-1].tag):
            open_.cut(len(open_.nodes) - 1)
        node = Node(tag, own)
        open_.nodes[-1].children.append(node)
        if tag in VOID or (inside and m[3].endswith("/")):
            continue
        open_.push(node)
        if tag in RAW:
            raw = tag
    return root, rules


class Styles:
    """What a page's rules say of display and visibility, by tag, class and number; the last of the strongest counts.

    Selectors that look at more than the node itself (combinators, states, attributes) and rules under a condition
    (``sheet_rules``) are left out: whether they hold can't be told here.
    """

    def __init__(self, rules: list[tuple[str, str]]):
        self.by: dict[str, list[tuple]] = {}
        for order, (selectors, body) in enumerate(rules):
            said = {k.lower(): v.lower() for k, v in _DECLARED.findall(body)}
            for selector in selectors.split(",") if said else ():
                m = _SIMPLE.match(selector.strip())
                if not m or not m[0] or "@" in selectors:
                    continue
                marks = re.findall(r"[.#][\w-]+", m[2])
                strength = (sum(x[0] == "#" for x in marks), sum(x[0] == "." for x in marks), bool(m[1] and m[1] != "*"))
                key = marks[0] if marks else (m[1] or "*").lower()
                self.by.setdefault(key, []).append((strength, order, (m[1] or "*").lower(), frozenset(marks), said))

    def of(self, node: Node) -> dict[str, str]:
        found: list[tuple] = []
        if self.by:
            marks = {f".{c}" for c in node.attributes.get("class", "").split()} | {f"#{node.attributes.get('id', '')}"}
            for key in {*marks, node.tag, "*"} & self.by.keys():
                found += [x for x in self.by[key] if x[2] in ("*", node.tag) and x[3] <= marks]
        said: dict[str, str] = {}
        for *_, own in sorted(found, key=lambda x: x[:2]):
            said |= own
        return said | {k.lower(): v.lower() for k, v in _DECLARED.findall(node.attributes.get("style", ""))}


def visible(node: Node, said: dict[str, str]) -> bool:
    """Whether anything of a node is to be seen, but for the visibility that it hands down."""
    a = node.attributes
    return not (
        node.tag in HIDDEN
        or ("hidden" in a and "display" not in said)
        or (node.tag == "dialog" and "open" not in a)
        or said.get("display") == "none"
    )


def shown(said: dict[str, str], before: bool) -> bool:
    """The visibility of a node in a parent of visibility ``before``."""
    return {"hidden": False, "collapse": False, "visible": True, "initial": True}.get(said.get("visibility", ""), before)


class _Page:
    """Lines under construction. ``gap`` is what the next text needs before it: 0 nothing, 1 a new line, 2 an empty one."""

    def __init__(self):
        self.lines: list[str] = []
        self.now, self.gap, self.space, self.indent, self.mark = "", 0, False, "", ""

    def block(self, gap: int) -> None:
        if self.now:
            self.lines.append(self.now.rstrip(" "))
            self.now = ""
        self.gap, self.space = max(self.gap, gap), False

    def text(self, text: str) -> None:
        flat = _BLANK.sub(" ", text)
        body = flat.strip(" ")
        if not body:
            self.space = self.space or bool(flat)
            return
        blank = (self.space or flat[0] == " ") and self.now and not self.now.endswith(" ")
        self.start()
        self.now += (" " if blank else "") + body
        self.space = flat[-1] == " "

    def start(self) -> None:
        if not self.now:
            if self.gap == 2 and self.lines:
                self.lines.append("")
            self.now, self.gap = self.indent + self.mark, 0
            if self.mark:
                self.mark = ""

    def verbatim(self, text: str) -> None:
        """Text of which every blank counts; its empty lines stay if text stands before and behind them."""
        for k, line in enumerate(text.split("\n")):
            if k:
                if not self.now and self.lines and self.gap == 1:
                    self.lines.append("")
                self.block(1)
            if line.strip():
                self.start()
                self.now += line

    def line(self, line: str) -> None:
        self.block(1)
        self.start()
        self.now += line
        self.lines.append(self.now.rstrip(" "))
        self.now = ""

    def end(self) -> list[str]:
        self.block(0)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _number(text: str | None, least: int, most: int, default: int) -> int:
    return min(max(int(text), least), most) if text and _NUMBER.fullmatch(text) else default


class _Table:
    """Cells of a table, with the columns and rows that they take."""

    def __init__(self):
        self.rows: list[list[tuple[_Page, int, int]]] = []

    def row(self) -> None:
        self.rows.append([])

    def cell(self, node: Node | None = None) -> _Page:
        if not self.rows:
            self.row()
        a = node.attributes if node else {}
        page = _Page()
        self.rows[-1].append((page, _number(a.get("colspan"), 1, MOST_COLUMNS, 1), _number(a.get("rowspan"), 0, MOST_ROWS, 1)))
        return page

    def lines(self) -> Iterator[str]:
        """Rows as lines: columns as wide as their widest cell, a cell of several lines on as many lines."""
        taken: dict[int, int] = {}  # column: rows from above that still take it
        placed, widths, wide = [], {}, []
        for k, row in enumerate(self.rows):
            column, out = 0, []
            for page, columns, rows in row:
                while taken.get(column, 0) > 0:
                    column += 1
                text = page.end()
                out.append((column, columns, text))
                size = max(map(len, text), default=0)
                if columns == 1:
                    widths[column] = max(widths.get(column, 0), size)
                elif size:
                    wide.append((columns, column, size))
                for c in range(column, column + columns) if rows != 1 else ():
                    taken[c] = max(taken.get(c, 0), (rows or len(self.rows) - k))
                column += columns
            placed.append(out)
            taken = {c: n - 1 for c, n in taken.items() if n > 1}
        # a column that only cells over several columns take has no width of its own
        for columns, column, size in sorted(wide):
            own = [c for c in range(column, column + columns) if c in widths]
            last = own[-1] if own else column
            widths[last] = widths.get(last, 0) + max(0, size - sum(widths.get(c, 0) for c in own) - 3 * max(0, len(own) - 1))
        order = sorted(widths)
        for row in placed:
            at = {c: (columns, text) for c, columns, text in row}
            for k in range(max((len(text) for _, _, text in row), default=0)):
                parts, skip = [], -1
                for c in order:
                    if c < skip:
                        continue
                    columns, text = at.get(c, (1, []))
                    skip = c + columns
                    span = [widths[x] for x in order if c <= x < skip]
                    parts.append((text[k] if k < len(text) else "").ljust(sum(span) + 3 * (len(span) - 1)))
                line = " | ".join(parts).rstrip()
                if line.strip(" |"):
                    yield line


class _Writer:
    """Writes a tree over a stack of its own, so deep trees are fine. A step carries the page it writes to, whether text is
    verbatim, the visibility handed down, the open lists, and HTML (''), a formula, an SVG image or text within one."""

    def __init__(self, styles: Styles):
        self.styles, self.work = styles, []

    def later(self, do) -> None:
        self.work.append((do, None, None, None, None, None))

    def children(self, node: Node, page: _Page, lists: tuple, pre: bool, seen: bool, mode: str) -> None:
        for c in reversed(node.children):
            self.work.append((c, page, lists, pre, seen, mode))
            if mode == "math" and node.tag in APART:
                self.later(lambda: setattr(page, "space", True))

    def table(self, node: Node, page: _Page, pre: bool, seen: bool) -> None:
        table = _Table()

        def end() -> None:
            for line in table.lines():
                page.line(line)
            page.block(2)

        page.block(2)
        self.later(end)
        todo = [(node, seen)]
        steps: list = []
        while todo:
            n, seen = todo.pop()
            below = []
            for c in n.children:
                if isinstance(c, str):
                    if seen and c.strip():
                        if n.tag == "tr":
                            steps.append((c, table.cell(), (), pre, seen, ""))
                        else:
                            steps.append((c, page, (), pre, seen, ""))
                    continue
                said = self.styles.of(c)
                if not visible(c, said):
                    continue
                if c.tag in ("tr", "tbody", "thead", "tfoot"):
                    below.append((c, shown(said, seen)))
                elif c.tag in ("td", "th") or n.tag == "tr":
                    if n.tag != "tr" and not (table.rows and table.rows[-1] and steps and steps[-1][1] is table.rows[-1][-1][0]):
                        table.row()
                    steps.append((c, table.cell(c), (), pre, seen, ""))
                else:
                    steps.append((c, page, (), pre, seen, ""))
            # rows are numbered in the order of the tree: what stands below comes before what follows
            if below:
                table_rows = below
                for c, own in reversed(table_rows):
                    todo.append((c, own))
            if todo and todo[-1][0].tag == "tr":
                table.row()
        self.work += reversed(steps)

    def write(self, node, page: _Page, seen: bool = True) -> None:
        self.work.append((node, page, (), False, seen, ""))
        while self.work:
            n, page, lists, pre, seen, mode = self.work.pop()
            if callable(n):
                n()
            elif isinstance(n, str):
                if seen and mode != "svg":
                    (page.verbatim if pre else page.text)(n)
            else:
                said = self.styles.of(n)
                if visible(n, said):
                    self.node(n, page, lists, pre, shown(said, seen), mode)

    def node(self, n: Node, page: _Page, lists: tuple, pre: bool, seen: bool, mode: str) -> None:
        tag = n.tag
        if (mode in ("svg", "text") and tag in UNDRAWN) or (mode == "math" and tag in UNSAID):
            return
        if tag in FOREIGN:
            mode = tag
        elif tag == "foreignobject":
            mode = ""
        elif tag == "text" and mode == "svg":
            mode, page.space = "text", True
        if tag == "br":
            page.verbatim("\n") if pre else page.block(1)
        elif tag == "table":
            self.table(n, page, pre, seen)
        elif tag == "img":
            if seen and n.attributes.get("alt", "").strip():
                page.text(n.attributes["alt"])
        elif tag == "input":
            if seen and n.attributes.get("type", "text").lower() in VALUED and n.attributes.get("value"):
                page.text(n.attributes["value"])
        else:
            self.inside(n, page, lists, pre or tag in ("pre", "textarea", "listing", "xmp"), seen, mode)

    def inside(self, n: Node, page: _Page, lists: tuple, pre: bool, seen: bool, mode: str) -> None:
        tag = n.tag
        gap = (2 if tag in SPACED and not (tag in ("ul", "ol") and lists) else 1) if tag in BLOCK else 0
        if gap:
            page.block(gap)
            self.later(lambda: page.block(gap))
        if tag in ("ul", "ol", "menu", "dir"):
            lists = (*lists, [tag, _number(n.attributes.get("start"), -999_999, 999_999, 1)])
        elif tag == "li":
            kind, before = lists[-1] if lists else ["ul", 1], (page.indent, page.mark)
            kind[1] = _number(n.attributes.get("value"), -999_999, 999_999, kind[1])
            page.indent, page.mark = "  " * max(0, len(lists) - 1), "- " if kind[0] != "ol" else f"{kind[1]}. "
            kind[1] += 1

            def restore() -> None:
                page.block(1)
                page.indent, page.mark = before

            self.later(restore)
        elif tag == "dd":
            before_indent = page.indent
            page.indent += "  "

            def outdent() -> None:
                page.block(1)
                page.indent = before_indent

            self.later(outdent)
        elif tag in ("option", "button"):
            page.space = True
        elif tag == "text" and mode == "text":
            self.later(lambda: setattr(page, "space", True))
        self.children(n, page, lists, pre, seen, mode)


def visible_text(html: str | None) -> str:
    """All visible text of a page, laid out; '' for null, empty or invisible pages."""
    page, (root, rules) = _Page(), parse(html or "")
    _Writer(Styles(rules)).write(root, page)
    return "\n".join(page.end()).strip("\n")


def extract_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with a column ``text`` (replaced if there is one) of the visible text in column ``html``.

    Null or empty html gives ''. Rows are independent; repeated rows give the same text, an empty table none.
    """
    bound_batches(pages.sparkSession)
    base = pages.drop(text) if text != html else pages
    plain, back = with_own_names(base, ("_seen",))
    column = plain.columns[base.columns.index(html)]

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in in_slices(batches, column):
            yield batch.append_column("_seen", pa.array([visible_text(h) for h in batch.column(column).to_pylist()], pa.string()))

    out = plain.mapInArrow(scan, StructType([*plain.schema, StructField("_seen", StringType())]))
    return back(out, F.col("_seen").alias(text)) if text != html else back(out.drop(column).withColumnRenamed("_seen", column))

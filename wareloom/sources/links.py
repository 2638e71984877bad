"""Links out of pasted text: those with a scheme as DataFrame functions, and whole pastes with what is left over."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A link ends before white space, quotes, angle brackets and bars, and where another link begins.
LINK = r"(?i)(https?://[^\s<>\"'|]+?)(?=https?://|[\s<>\"'|]|$)"


def links_in_lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, pos, link): every link of every line from 1 on, in order; repeats are kept.

    Zero-width characters go first; punctuation that ends a link isn't part of it, nor is a closing bracket whose
    opening one stands before the link. Null and empty texts have no links.
    """
    lines = texts.select(key, F.posexplode(F.split(text, r"\r\n|\r|\n", -1)).alias("line_no", "line"))
    clean = F.regexp_replace("line", "[​‌‍⁠﻿]", "")
    found = lines.select(key, (F.col("line_no") + 1).alias("line_no"), F.posexplode(F.regexp_extract_all(clean, F.lit(LINK), 1)).alias("pos", "raw"))
    bare = F.regexp_replace("raw", r"[.,;:!?]+$", "")
    bare = F.when(~F.contains(bare, F.lit("(")), F.regexp_replace(bare, r"[.,;:!?)]+$", "")).otherwise(bare)
    return found.select(key, "line_no", "pos", bare.alias("link")).where("link rlike '(?i)^https?://.'")


# ---------------------------------------------------------------- whole pastes

#: Characters that no one sees, blanks that compatibility folding leaves, and what never stands in a link.
UNSEEN = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
BLANKS = "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
#: Fixed patterns: links with a scheme, links in markup, bare domains with a path; what parts leftovers.
_SCHEME = r"https?://"
_RUN = re.compile(rf"{_SCHEME}(?:(?!{_SCHEME})[^\s\"'<>`|\\^{{}}])+", re.IGNORECASE)
_LABELLED = re.compile(r"\[[^\]]*\]\(\s*<?([^)\s>]+)>?\s*\)")
_ATTRIBUTE = re.compile(r"\bhref\s*=\s*[\"']([^\"']+)[\"']", re.IGNORECASE)
_DOMAIN = re.compile(r"(?<![\w@.\-/])((?:[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?\.)+[a-z]{2,63})(/[^\s\"'<>`|\\]*)?", re.IGNORECASE)
_PARTED = re.compile(r"[\n\r\t,;|]+")
#: Endings of names that are files, not domains; punctuation that ends a sentence, not a link; brackets.
FILE_ENDINGS = frozenset(
    "txt md csv tsv json xml yaml yml log ini cfg py js ts sh bat exe dll zip gz tar rar pdf doc docx xls xlsx ppt pptx jpg jpeg png gif webp svg mp4 mp3 mov".split()
)
SENTENCE_ENDS, BRACKETS = ".,;:!?", {")": "(", "]": "[", "}": "{"}
FOUND = "line_no int, pos int, kind string, text string"

Span = tuple[int, int]


def link_end(text: str) -> int:
    """Where a run that starts as a link ends as one: before sentence punctuation and closing brackets that it didn't open."""
    surplus = {c: text.count(c) - text.count(o) for c, o in BRACKETS.items()}
    end = len(text)
    while end:
        last = text[end - 1]
        if last in BRACKETS and surplus[last] > 0:
            surplus[last] -= 1
        elif last not in SENTENCE_ENDS:
            break
        end -= 1
    return end


def gaps(spans: list[Span], size: int) -> Iterator[Span]:
    """What is left of 0 to ``size`` without ``spans``, which are in order and don't overlap."""
    at = 0
    for begin, end in spans:
        if at < begin:
            yield at, begin
        at = end
    if at < size:
        yield at, size


def _blanked(line: str, spans: list[Span]) -> str:
    """The line with blanks for ``spans``, so that places stay what they are."""
    kept = list(gaps(spans, len(line)))
    out = []
    for (begin, end), (_, before) in zip(kept, [(0, 0), *kept]):
        out += [" " * (begin - before), line[begin:end]]
    return "".join(out).ljust(len(line))


def scan_line(line: str) -> tuple[list[tuple[int, str, bool]], list[str]]:
    """(links, leftovers) of a line: links as (place, link, whether its scheme is assumed) in order. Leftovers of a line
    without links are all of its parts that have a letter or digit, otherwise those alone that may have been meant as
    links, with a point or a slash."""
    links, taken = [], []
    for m in _RUN.finditer(line):
        taken.append(m.span())
        if end := link_end(m[0]):
            links.append((m.start(), m[0][:end], False))
    bare: list[Span] = []
    if "." in line:
        for begin, stop in gaps(taken, len(line)):
            for m in _DOMAIN.finditer(line[begin:stop]):
                host, path = m[1], m[2] or ""
                name, _, ending = host.rpartition(".")
                if not path and "." not in name and ending.lower() in FILE_ENDINGS:
                    continue
                bare.append((begin + m.start(), begin + m.end()))
                link = f"https://{host}{path}"
                links.append((begin + m.start(), link[: link_end(link)], True))
    parts = (p.strip() for p in _PARTED.split(_blanked(line, sorted([*taken, *bare]))))
    left = [p for p in parts if re.search(r"\w", p) and (not links or "." in p or "/" in p)]
    return sorted(links), left


def scan_paste(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(line from 1, place among the line's finds of this kind, kind, text) of a paste: kind is link, domain (a link whose
    scheme is assumed) or unparsed."""
    text = unicodedata.normalize("NFKC", text).translate(dict.fromkeys(map(ord, UNSEEN)) | dict.fromkeys(map(ord, BLANKS), " "))
    for markup in (_LABELLED, _ATTRIBUTE):
        text = markup.sub(lambda m: f" {m[1]} ", text)
    for number, line in enumerate(text.splitlines(), 1):
        links, left = scan_line(line)
        yield from ((number, pos, "domain" if assumed else "link", link) for pos, (_, link, assumed) in enumerate(links))
        yield from ((number, pos, "unparsed", part) for pos, part in enumerate(left))


def scan_texts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, pos, kind, text) of pasted texts: every link in order with or without a scheme, in markup or not,
    and what was left over, so that nothing pasted goes unseen. Compatibility forms are folded first. Repeats are kept;
    a null text is an empty one; repeated rows are read each for itself."""
    schema = StructType([texts.schema[key], *StructType.fromDDL(FOUND).fields])

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            keys = batch.column(0)
            rows = [(k, *found) for k, t in enumerate(batch.column(1).to_pylist()) for found in scan_paste(t or "")]
            owner, numbers, places, kinds, found = zip(*rows, strict=True) if rows else ((),) * 5
            arrays = [keys.take(pa.array(owner, pa.int64())), pa.array(numbers, pa.int32()), pa.array(places, pa.int32()), pa.array(kinds, pa.string()), pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return texts.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(scan, schema)

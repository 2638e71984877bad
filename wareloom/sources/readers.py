"""Readers of what sellers hand over: delimited uploads, exports, spreadsheets and saved pages. Spark's readers open the files."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.sources.exports import plain
from wareloom.sources.quoted import read_quoted

#: What may part cells, the first of equals; lines that are looked at for it, rows that are looked at for links.
DELIMITERS, SNIFFED_LINES, SNIFFED_ROWS = (",", "\t", ";", "|"), 20, 200
LINK = r"(?i)^\s*(?:https?://|www\.)\S+$"
#: Where a saved page says where it came from, in order.
_ORIGINS = (
    r"<base[^>]+href=[\"']?([^\"'\s>]+)", r"<link[^>]+rel=[\"']?canonical\b[^>]*href=[\"']?([^\"'\s>]+)", r"<meta[^>]+property=[\"']?og:url\b[^>]*content=[\"']?([^\"'\s>]+)",
    r"<meta[^>]+name=[\"']?twitter:url\b[^>]*content=[\"']?([^\"'\s>]+)", r"saved from url=\(\d+\)(\S+)",
)


def is_link(cell: Column) -> Column:
    return F.coalesce(cell.rlike(LINK), F.lit(False))


def delimiter_of(lines: list[str]) -> str:
    """The delimiter that occurs most in the first lines."""
    counts = Counter(c for line in lines[:SNIFFED_LINES] for c in line if c in DELIMITERS)
    return max(DELIMITERS, key=lambda d: (counts[d], -DELIMITERS.index(d)))


def _rows(spark: SparkSession, path: str, sep: str, header: bool) -> DataFrame:
    """The text columns of delimited files, in as many tasks as their bytes make; the header comes from Spark's reader.
    Files whose lines end in a lone carriage return are read by that one, a task a file."""
    whole = spark.read.csv(path, sep=sep, header=header, inferSchema=False, multiLine=True, escape='"')
    lone = any("\r" in r[0][:-1] for r in spark.read.option("lineSep", "\n").text(path).limit(1).collect())
    return whole if lone or not whole.columns else read_quoted(spark, path, whole.columns, sep, header)


def read_delimited(spark: SparkSession, path: str, url_column: str | None = None) -> DataFrame:
    """A delimited file's columns as text, and link and more_links (array): each row's first link and the others in it.

    The first line is a header unless a cell of it looks like a link; without one, columns are called column_1 and so on.
    ``url_column`` names the column of links; by default it is the one with most of them in the first rows, the first of
    equals. Rows without any link have a null one. The driver sees the first lines alone.
    """
    head = [r[0] for r in spark.read.text(path).limit(SNIFFED_LINES).collect()]
    sep = delimiter_of(head)
    cells = [c.strip().strip('"') for c in head[0].split(sep)] if head else []
    named = bool(cells) and not any(re.match(LINK, c) for c in cells)
    rows = _rows(spark, path, sep, named)
    rows = rows if named else rows.toDF(*[f"column_{k + 1}" for k in range(len(rows.columns))])
    texts = [F.col(f"`{c}`") for c in rows.columns]
    if url_column is None and texts:
        few = rows.limit(SNIFFED_ROWS).agg(*[F.count_if(is_link(c)) for c in texts]).first()
        url_column = rows.columns[max(range(len(few)), key=lambda k: (few[k], -k))]
    own = [F.col(f"`{url_column}`"), *[c for c, name in zip(texts, rows.columns, strict=True) if name != url_column]] if texts else []
    links = F.filter(F.array(*[F.trim(c) for c in own]), is_link)
    return rows.select("*", F.get(links, F.lit(0)).alias("link"), F.slice(links, F.lit(2), F.greatest(F.size(links) - 1, F.lit(0))).alias("more_links"))


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """A seller's export (CSV or TSV with a header, in UTF-8 with or without a mark) as text columns; blank rows are dropped."""
    sep = delimiter_of([r[0] for r in spark.read.text(path).limit(1).collect()])
    rows = _rows(spark, path, sep, True)
    rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    return rows.where(" or ".join(f"trim(`{c}`) <> ''" for c in rows.columns)) if rows.columns else rows


def sheet_rows(content: bytes) -> list[list[str]]:
    """The first sheet of a workbook as rows of text: shared and inline strings, numbers as they are written."""
    import io
    import zipfile
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        tag = lambda e: e.tag.rsplit("}", 1)[-1]
        text = lambda e: "".join(t.text or "" for t in e.iter() if tag(t) == "t")
        shared = [text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if tag(e) == "si"] if "xl/sharedStrings.xml" in names else []
        first = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: (len(n), n), default=None)
        out: list[list[str]] = []
        for row in ElementTree.fromstring(z.read(first)).iter() if first else ():
            if tag(row) != "row":
                continue
            cells: dict[int, str] = {}
            for c in (x for x in row if tag(x) == "c"):
                letters, at = re.match(r"[A-Z]*", c.get("r", ""))[0], 0
                for letter in letters:
                    at = at * 26 + ord(letter) - 64
                value = next((x.text or "" for x in c if tag(x) == "v"), "")
                cells[at - 1 if letters else len(cells)] = shared[int(value)] if c.get("t") == "s" else text(c) if c.get("t") == "inlineStr" else value
            out.append([cells.get(k, "") for k in range(max(cells, default=-1) + 1)])
    return out


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_no, cells array<string>) of the first sheet of each workbook under ``path``; row 0 is the header. A file
    that is no workbook has no rows; blank rows are dropped."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def scan(batches: Iterator) -> Iterator:
        import zipfile
        from xml.etree.ElementTree import ParseError

        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = [r for r in sheet_rows(content) if any(c.strip() for c in r)]
                except (zipfile.BadZipFile, ParseError, KeyError, ValueError, IndexError):
                    rows = []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.string()))], ["path", "row_no", "cells"]
                )

    return files.mapInArrow(scan, "path string, row_no int, cells array<string>")


def header_signature(columns: list[str]) -> str:
    """What exports with the same headers, in any order and case, have in common."""
    return hashlib.blake2s("|".join(sorted(map(plain, columns))).encode(), digest_size=8).hexdigest()


def save_mapping(spark: SparkSession, path: str, columns: list[str], mapping: dict[str, str]) -> None:
    """Keep a mapping of targets to columns for exports with these headers; a later one of the same headers replaces it."""
    row = [(header_signature(columns), json.dumps(mapping, sort_keys=True))]
    spark.createDataFrame(row, "signature string, mapping string").coalesce(1).write.mode("overwrite").parquet(f"{path}/signature={row[0][0]}")


def load_mapping(spark: SparkSession, path: str, columns: list[str]) -> dict[str, str] | None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/signature={header_signature(columns)}")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return json.loads(spark.read.parquet(folder.toString()).first()["mapping"])


def decoded(content: bytes) -> str:
    """A page's text: by its mark, its own declaration, else UTF-8, else Windows' western letters."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace")
    said = re.search(rb"<meta[^>]+charset=[\"']?\s*([\w-]+)", content[:4096], re.IGNORECASE)
    for name in ([said[1].decode("ascii", "ignore")] if said else []) + ["utf-8"]:
        try:
            return content.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return content.decode("cp1252", "replace")


def saved_page(content: bytes) -> tuple[str | None, str]:
    """(origin, html) of a saved page, be it HTML or MHTML; the origin is null if the page doesn't say."""
    html, origin = None, None
    if re.search(rb"^(?:from:|mime-version:|content-type:\s*multipart/related)", content[:2048], re.IGNORECASE | re.MULTILINE) and b"multipart/related" in content[:4096].lower():
        import email
        from email import policy

        message = email.message_from_bytes(content, policy=policy.compat32)
        origin = message.get("Snapshot-Content-Location")
        part = next((p for p in message.walk() if p.get_content_type() == "text/html"), None)
        html = decoded(part.get_payload(decode=True) or b"") if part is not None else ""
        origin = origin or (part.get("Content-Location") if part is not None else None)
    html = decoded(content) if html is None else html
    found = (re.search(p, html, re.IGNORECASE) for p in _ORIGINS)
    links = [m[1] for m in found if m and m[1].lower().startswith(("http://", "https://"))]
    return origin or (links[0] if links else None), html


def read_saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) of the saved pages under ``path``, subfolders included; page_id is the file's path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{html,htm,mhtml,mht}").load(path).select("path", "content")

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            pages = [saved_page(c or b"") for c in batch.column("content").to_pylist()]
            columns = [pa.array([p[k] for p in pages], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *columns], ["page_id", "url", "html"])

    return files.mapInArrow(scan, "page_id string, url string, html string")


def pasted_page(spark: SparkSession, html: str, url: str) -> DataFrame:
    """One pasted page as a table of pages; it must say where it is from."""
    if not re.match(r"(?i)https?://[^/?#\s]+", url or ""):
        raise ValueError("a pasted page needs the link it is from")
    return spark.createDataFrame([(url, url, html)], "page_id string, url string, html string")

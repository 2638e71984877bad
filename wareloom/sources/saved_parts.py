"""Saved pages with what was saved beside them: pictures in a page's folder or in a single-file archive.

A page's parts and its references are two tables; which part a reference means is a join of names: the file's name in the
page's own folder, the address that an archive recorded for a part, or its content id. Nothing is read twice, and a page
with many pictures is many rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wareloom.functions import texts
from wareloom.sources.page_tree import Page
from wareloom.sources.readers import saved_page

#: Bytes of a saved file at most; pictures that a page keeps, the largest ones.
MOST_BYTES, MOST_PHOTOS = 32 << 20, 12
#: What browsers call the folder beside a page.
FOLDERS = ("_files", ".files", "_dateien", "_fichiers", "_archivos")
#: Kinds of pictures by the ends of their names.
KINDS = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "avif": "image/avif", "svg": "image/svg+xml", "bmp": "image/bmp"}
#: Attributes that refer to a picture, in order.
REFERRING = ("src", "data-src", "srcset", "data-srcset")
_PAGES = ("html", "htm", "mhtml", "mht")
PART = "page_id string, name string, location string, cid string, kind string, content binary"


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, folder, name, ending, length, content) of all files under ``path`` that aren't too large."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= MOST_BYTES)
    name = F.call_function("url_decode", F.replace(F.substring_index("path", "/", -1), F.lit("+"), F.lit("%2B")))
    return files.select(
        "path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), name.alias("name"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("ending"), "length", "content"
    )


def _picture_kind(ending: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[ending]


def archive_parts(content: bytes) -> Iterator[tuple[str, str, str, bytes]]:
    """(location, content id, kind, bytes) of the pictures in a single-file archive; none of what is no archive."""
    import email
    from email import policy

    if b"multipart/related" not in content[:4096].lower():
        return
    for part in email.message_from_bytes(content, policy=policy.compat32).walk():
        kind = part.get_content_type()
        data = part.get_payload(decode=True) if kind.startswith("image/") else None
        if data:
            yield str(part.get("Content-Location") or "").strip(), str(part.get("Content-ID") or "").strip(" <>"), kind, data


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """PART: the pictures saved with each page under ``path``: those of its folder (its name without its ending, and one
    of FOLDERS), and those inside an archive. page_id is the page's path, as ``read_saved_pages`` has it."""
    files = _files(spark, path)
    pages = files.where(F.col("ending").isin(*_PAGES))
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    folders = pages.select(F.col("path").alias("page_id"), F.explode(F.array(*[F.concat(stem, F.lit(f)) for f in FOLDERS])).alias("folder"))
    beside = files.withColumn("kind", _picture_kind(F.col("ending"))).where("kind is not null").join(folders, "folder")
    beside = beside.select("page_id", "name", F.lit("").alias("location"), F.lit("").alias("cid"), "kind", "content")

    def unpack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [(k, *p) for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for p in archive_parts(c or b"")]
            owner, locations, ids, kinds, data = zip(*rows, strict=True) if rows else ((),) * 5
            names = [re.sub(r"[?#].*", "", x).rpartition("/")[2] for x in locations]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((owner, names, locations, ids, kinds, data), [pa.string()] * 5 + [pa.binary()], strict=True)], ["page_id", "name", "location", "cid", "kind", "content"])

    inside = pages.where(F.col("ending").isin("mhtml", "mht")).select("path", "content").mapInArrow(unpack, PART)
    return beside.unionByName(inside)


def references(pages: DataFrame) -> DataFrame:
    """(page_id, url, place, attribute, ref): what the pictures of ``pages`` (page_id, url, html) refer to, in order; of a
    set of sizes its first link. Data in place of a link is none."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for k, html in enumerate(batch.column("html").to_pylist()):
                page = Page(html or "")
                for place, e in enumerate(sorted([*page.at("img"), *page.at("source")])):
                    for name in REFERRING:
                        words = page.given[e].get(name, "").split(",")[0].split() if name.endswith("srcset") else [page.given[e].get(name, "").strip()]
                        if words and words[0] and not words[0].lower().startswith("data:"):
                            rows.append((k, place, name, words[0].encode("utf-8", "replace").decode()))
            owner, places, names, refs = zip(*rows, strict=True) if rows else ((),) * 4
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(at), batch.column("url").take(at), pa.array(places, pa.int32()), pa.array(names, pa.string()), pa.array(refs, pa.string())], ["page_id", "url", "place", "attribute", "ref"])

    return pages.select("page_id", "url", "html").mapInArrow(scan, "page_id string, url string, place int, attribute string, ref string")


def resolved(refs: DataFrame, parts: DataFrame) -> DataFrame:
    """``refs`` with link (what the reference means on the web, null where nothing is known) and saved (the part that
    holds it, by its name, address or content id, null for none). An archive's recorded address counts as the link; a name in a page's folder says nothing
    of the web, so such a reference has no link. Of parts that fit, the content id's comes first, then the address, then
    the name (as written, then without regard to case), then the first by name."""
    link = texts.absolute(F.col("url"), F.col("ref"))
    name = F.call_function("url_decode", F.replace(F.substring_index(F.regexp_replace("ref", "[?#].*$", ""), "/", -1), F.lit("+"), F.lit("%2B")))
    refs = refs.withColumns({"_link": F.when(~F.lower("ref").startswith("cid:"), link), "_n": F.monotonically_increasing_id()})
    valid = F.when(~F.col("ref").rlike("%(?![0-9A-Fa-f]{2})"), name).otherwise(F.substring_index(F.regexp_replace("ref", "[?#].*$", ""), "/", -1))
    asked = F.array(
        F.struct(F.lit(0).alias("rank"), F.when(F.lower("ref").startswith("cid:"), F.substring("ref", F.lit(5), F.length("ref"))).alias("key")),
        F.struct(F.lit(1).alias("rank"), F.coalesce("_link", "ref").alias("key")),
        F.struct(F.lit(2).alias("rank"), valid.alias("key")), F.struct(F.lit(3).alias("rank"), F.lower(valid).alias("key")),
    )
    told = F.array(
        F.struct(F.lit(0).alias("rank"), F.col("cid").alias("key")), F.struct(F.lit(1).alias("rank"), F.col("location").alias("key")),
        F.struct(F.lit(2).alias("rank"), F.when(F.col("location") == "", F.col("name")).alias("key")), F.struct(F.lit(3).alias("rank"), F.when(F.col("location") == "", F.lower("name")).alias("key")),
    )
    keys = lambda frame, each: frame.withColumn("x", F.explode(each)).select("*", "x.rank", "x.key").drop("x").where("coalesce(key, '') <> ''")
    known = keys(parts.select("page_id", "name", "location", "cid"), told).select(F.col("page_id").alias("_page"), F.col("rank").alias("_rank"), F.col("key").alias("_key"), F.col("name").alias("_name"), F.col("location").alias("_location"), F.col("cid").alias("_cid"))
    wanted = keys(refs.select("page_id", "_n", "_link", "ref"), asked).select("page_id", "_n", "rank", "key")
    found = wanted.join(known, (F.col("page_id") == F.col("_page")) & (F.col("rank") == F.col("_rank")) & (F.col("key") == F.col("_key")))
    best = found.groupBy("_n").agg(F.min_by(F.struct("_name", "_location", "_cid"), F.struct("rank", "_name", "_location", "_cid")).alias("_part")).withColumnRenamed("_n", "_m")
    out = refs.join(best, F.col("_n") == F.col("_m"), "left")
    location = F.nullif(F.col("_part._location"), F.lit(""))
    return out.select("page_id", "url", "place", "attribute", "ref", F.when(F.col("_part").isNull(), F.col("_link")).otherwise(location).alias("link"), F.coalesce(F.nullif(F.col("_part._name"), F.lit("")), location, F.concat(F.lit("cid:"), F.col("_part._cid"))).alias("saved"))


def photos(parts: DataFrame, most: int = MOST_PHOTOS) -> DataFrame:
    """(page_id, rank, name, kind, bytes, uri): of each page's pictures the largest ``most``, largest first, equal ones by
    name and address; each as a data link. Files of one content are one picture."""
    sized = parts.withColumns({"bytes": F.octet_length("content"), "_sha": F.sha2("content", 256)}).dropDuplicates(["page_id", "_sha"])
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("bytes"), "name", "location", "_sha"))
    kept = sized.withColumn("rank", rank - 1).where(F.col("rank") < most)
    return kept.select("page_id", "rank", "name", "kind", "bytes", F.concat(F.lit("data:"), "kind", F.lit(";base64,"), F.replace(F.base64("content"), F.lit("\r\n"), F.lit(""))).alias("uri"))


def read_saved_with_parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, resolved references, photos) of the saved pages under ``path``."""
    files = _files(spark, path).where(F.col("ending").isin(*_PAGES)).select("path", "content")

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            read = [saved_page(c or b"") for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *[pa.array([p[k] for p in read], pa.string()) for k in (0, 1)]], ["page_id", "url", "html"])

    pages, parts = files.mapInArrow(scan, "page_id string, url string, html string"), read_parts(spark, path)
    return pages, resolved(references(pages), parts), photos(parts)

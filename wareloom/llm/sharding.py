"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

Every (record key, shard) has a score that only these two decide: ln(u) / weight, u in (0, 1) from the first 52 bits of
the md5 of "key:shard", which any other system works out alike. A record goes to the shard of its highest score, so a
shard gets records in proportion to its weight, a new shard takes records only into itself, and the records of a shard
that goes spread over the rest. Nothing is kept about where a record lies.

Shards are written as Parquet, one folder each. Rows are dealt by ranges of (shard, key), so a shard has as many files
as its bytes need, whatever key or text is hot, and files follow one another in the order of their names: a row's slot
is the number of rows in earlier files of its shard and its own place in its file.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from wareloom.llm.common import quoted, with_own_names

#: Bits of the hash that make u.
BITS = 52
#: Columns that the written shards have besides those of the records.
ADDED = ("shard", "slot")


def weights_of(shards: int | Mapping[int, float]) -> dict[int, float]:
    """Weights by shard number; ``shards`` may be a count of equal shards. Weights are positive."""
    weights = {k: 1.0 for k in range(shards)} if isinstance(shards, int) else {int(k): float(w) for k, w in shards.items()}
    if not weights or min(weights.values()) <= 0 or max(weights.values()) == float("inf"):
        raise ValueError("one shard at least, weights positive and finite")
    return weights


def _score(key: Column, shard: Column) -> Column:
    named = F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), shard["k"].cast("string"))
    u = (F.conv(F.substring(F.md5(named.cast("binary")), 1, BITS // 4), 16, 10).cast("double") + 0.5) / F.lit(float(1 << BITS))
    return F.struct((F.ln(u) / shard["w"]).alias("score"), (-shard["k"]).alias("back"))


def best_shard(key: Column, shards: int | Mapping[int, float]) -> Column:
    """struct(score double, back int): the highest score of a key, and minus the number of its shard (so that of equal
    scores the lowest shard's counts). A null key counts as empty text."""
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in sorted(weights_of(shards).items())])

    return F.array_max(F.transform(each, lambda s: _score(key, s)))


def shard_of(key: Column, shards: int | Mapping[int, float]) -> Column:
    """The shard of a key: int."""
    return -best_shard(key, shards)["back"]


def grown_shard(key: Column, shard: Column, shards: int | Mapping[int, float], more: Mapping[int, float]) -> Column:
    """Where a key of ``shard`` (found for ``shards``) goes once the shards of ``more`` are there too: only the scores of
    its shard and of those are worked out."""
    own = _score(key, F.struct(shard.alias("k"), F.element_at(F.create_map(*[F.lit(x) for kw in weights_of(shards).items() for x in kw]), shard).alias("w")))
    return -F.array_max(F.array(own, best_shard(key, more)))["back"]


def moves(docs: DataFrame, key: str, old: int | Mapping[int, float], new: int | Mapping[int, float]) -> DataFrame:
    """The records that another set of shards moves: their key column, from_shard, to_shard. Weights may change too:
    a lighter shard only gives records away, a heavier one only takes some."""
    found = docs.select(quoted(key), shard_of(quoted(key), old).alias("from_shard"), shard_of(quoted(key), new).alias("to_shard"))
    return found.where("from_shard <> to_shard")


def write_shards(docs: DataFrame, path: str, shards: int | Mapping[int, float] = 16, key: str = "doc_id") -> None:
    """Write ``docs`` (any columns) to ``path``/shard=N by ``key``, in the order of the key, then of ``text`` (its crc32
    and length, nulls first) if there is such a column, then as read.

    Rows with a null key are records with an empty one. Repeated rows and keys stay as they are: all rows of a key are in
    one shard, in files as large as others, since the row's number in the input parts ranges too. A column called like an
    added one (shard, slot) gets an underscore. An empty table leaves an empty folder's schema to the reader: nothing is
    written for shards without rows. Columns with dots or accents in their names get underscores for them.
    """
    docs, _ = with_own_names(docs, [*ADDED, "_row", "_crc", "_length"])
    text = F.col("text").cast("string") if "text" in docs.columns else F.lit(None).cast("string")
    placed = docs.withColumns({
        "shard": shard_of(quoted(key), shards), "_row": F.monotonically_increasing_id(),
        "_crc": F.crc32(text.cast("binary")), "_length": F.octet_length(text),
    })
    order = ["shard", quoted(key), "_crc", "_length", "_row"]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row", "_crc", "_length")
    dealt.write.option("compression", "zstd").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The written records with shard (int) and slot (long, gapless from 0 in each shard). ``schema``: of the records, for
    a path that may hold none."""
    reader = spark.read if schema is None else spark.read.schema(StructType([*schema.fields, StructField("shard", IntegerType())]))
    stored = reader.option("basePath", path).parquet(path)
    stored = stored.withColumns({"shard": F.col("shard").cast("int"), "_file": F.col("_metadata.file_name"), "_at": F.col("_metadata.row_index")})
    # one row a file: the rows of a shard's earlier files
    files = stored.groupBy("shard", "_file").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("shard").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("shard", "_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    found = stored.join(files, ["shard", "_file"]).withColumn("slot", (F.col("_before") + F.col("_at")).cast("long"))
    return found.drop("_file", "_at", "_before")

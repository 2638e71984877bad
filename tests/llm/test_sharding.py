import hashlib
import math
import zlib
from collections import Counter, defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from wareloom.llm.common import Scratch
from wareloom.llm.queries import QUERIES
from wareloom.llm.sharding import moves, read_shards, shard_of, weights_of, write_shards

SF = "/root/testdata/sf0.001"


def plain_shard(key, weights):
    """By the definition, without Spark."""
    text = "" if key is None else str(key)
    u = {k: (int(hashlib.md5(f"{text}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for k in weights}
    return max(weights, key=lambda k: (math.log(u[k]) / weights[k], -k))


def test_op12(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op12_sharding"](spark, SF).collect()}
    assert len(got) == len(docs)
    slots = defaultdict(list)
    for doc, text in zip(docs.doc_id, docs.text, strict=True):
        data = text.encode() if isinstance(text, str) else b""
        r = got[doc]
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.shard == plain_shard(doc, weights_of(16)) and r.grown_shard == plain_shard(doc, weights_of(17)) and r.grown_shard in (r.shard, 16)
        slots[r.shard].append((r.slot, doc))
    for own in slots.values():
        assert sorted(own) == list(enumerate(sorted(d for _, d in own)))


def test_weights_and_changes(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    shards = {3: 1.0, 5: 2.0, 9: 0.5}
    found = keys.select("k", shard_of(F.col("k"), shards).alias("s"))
    assert {r.k: r.s for r in found.limit(500).collect()} == {k: plain_shard(k, shards) for k in range(500)}
    share = Counter(r.s for r in found.collect())
    assert all(abs(share[k] / 20_000 - w / 3.5) < 0.02 for k, w in shards.items())
    # a shard that goes gives its own records alone, to all others; a heavier one only takes
    gone = moves(keys, "k", shards, {3: 1.0, 9: 0.5}).collect()
    assert len(gone) == share[5] and {r.from_shard for r in gone} == {5} and {r.to_shard for r in gone} == {3, 9}
    taken = moves(keys, "k", shards, shards | {9: 1.0}).collect()
    assert {r.to_shard for r in taken} == {9} and 0 < len(taken) / 20_000 < 0.2
    assert moves(keys, "k", 4, 4).count() == 0
    for wrong in (0, {}, {1: 0.0}, {1: -1.0}, {1: math.inf}):
        with pytest.raises(ValueError, match="one shard"):
            shard_of(F.col("k"), wrong)


def test_records_of_any_kind(spark):
    rows = [(k % 7 if k % 11 else None, None if k % 5 == 0 else "text" if k % 3 else str(k), "s", k) for k in range(500)] + [(7, "copy", "x", 0)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, Shard string, `slot` long").repartition(5)
    path = Scratch(spark, "test").path("shards")
    write_shards(docs, path, 3)
    out = read_shards(spark, path)
    assert out.columns == ["doc_id", "text", "Shard_", "slot_", "shard", "slot"] or set(out.columns) == {"doc_id", "text", "Shard_", "slot_", "shard", "slot"}
    got = out.collect()
    assert sorted(map(repr, ((r.doc_id, r.text, r.Shard_, r.slot_) for r in got))) == sorted(map(repr, rows))
    for s in {r.shard for r in got}:
        own = sorted((r.slot, r.doc_id, r.text) for r in got if r.shard == s)
        assert [x[0] for x in own] == list(range(len(own)))
        key = lambda d, t: (d is not None, d or 0, t is not None, zlib.crc32((t or "").encode()))
        assert [key(d, t) for _, d, t in own] == sorted(key(d, t) for _, d, t in own)
    assert all(r.shard == plain_shard(r.doc_id, weights_of(3)) for r in got)
    empty = Scratch(spark, "test").path("shards")
    write_shards(docs.limit(0), empty, 3)
    assert read_shards(spark, empty, docs.select("doc_id", "text").schema).count() == 0

"""Token-ID binary output: concatenated ids with Elias-Fano document boundaries.

A store is a folder of Parquet containers that Spark's committer writes, so any file system that Spark knows will do
and a lost task leaves nothing half-written. One row is a block of the id array, in ascending doc_id order:

* ``part``, ``block``: place in the order; ``first``: ids of the part before the block; ``n_ids``, ``n_docs``
* ``ids``: the ids, little-endian, 2 bytes each where the vocabulary allows it, else 4 (``width``)
* ``low_bits``, ``low``, ``high``, ``samples``: Elias-Fano code of the n_docs + 1 boundaries (see ``EliasFano``)
* ``doc_ids``: the documents' keys, in order

Offsets take about 2 + log2(ids per document) bits a document; there is no 64-bit offset table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareloom.llm.tokens import END_ID, default_tokenizer, worker_encoder

BLOCK_IDS = 1 << 20
SAMPLE = 64
BLOCK_SCHEMA = (
    "part int, block int, first long, n_ids long, n_docs int, width int, ids binary, "
    "low_bits int, low binary, high binary, samples binary, doc_ids array<long>"
)


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
#: Ones of each byte, and the place of each of its ones.
_ONES, _PLACE = _BITS.sum(axis=1).astype(np.int64), np.argsort(1 - _BITS, axis=1, kind="stable")


class EliasFano:
    """A non-decreasing sequence of integers: low bits packed, high bits in unary, every 64th one sampled for select."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        v = values.astype(np.int64)
        lows = (v[:, None] >> np.arange(low_bits)) & 1
        ones = (v >> low_bits) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[ones] = 1
        pack = lambda x: np.packbits(x.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, low_bits, pack(lows), pack(bits), ones[::SAMPLE].astype("<u4").tobytes())

    def _low(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), dtype=np.int64)
        raw = np.frombuffer(self.low + bytes(8), dtype=np.uint8)
        at = index * self.low_bits
        word = np.zeros(len(index), dtype=np.int64)
        for k in range((self.low_bits + 7) // 8 + 1):
            word |= raw[at // 8 + k].astype(np.int64) << (8 * k)
        return (word >> (at % 8)) & ((1 << self.low_bits) - 1)

    def select(self, index: np.ndarray) -> np.ndarray:
        """The values at ``index``: from the sample before each, a scan of the unary bits, byte by byte for all at once."""
        index = np.asarray(index, dtype=np.int64)
        if not len(index):
            return index
        at = np.frombuffer(self.samples, dtype="<u4")[index // SAMPLE].astype(np.int64)
        raw = np.frombuffer(self.high, dtype=np.uint8)
        byte, left = at >> 3, index % SAMPLE + 1
        now = raw[byte] & (0xFF << (at & 7)).astype(np.uint8)  # the sample's own bit is the first to count
        going = np.arange(len(index))
        while len(going := going[_ONES[now[going]] < left[going]]):
            left[going] -= _ONES[now[going]]
            byte[going] += 1
            now[going] = raw[byte[going]]
        high = byte * 8 + _PLACE[now, left - 1] - index
        return (high << self.low_bits) | self._low(index)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, dtype=np.uint8), bitorder="little"))[: self.n]
        index = np.arange(self.n)
        return ((ones - index) << self.low_bits) | self._low(index)


def write_store(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS
) -> None:
    """Write ``docs`` (doc_id, text; other columns are ignored) to a new store at ``path``.

    Null texts count as empty, so each document has its end id at least. Rows are in ascending doc_id order, nulls
    first; rows that share a doc_id are in an order of their own (by hash, then by text), each a document, and needn't
    be in one part. An empty table makes a store without blocks.
    """
    tokenizer = tokenizer or default_tokenizer()

    def blocks(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in BLOCK_SCHEMA.split(", ")])
        encoder, part = worker_encoder(tokenizer), TaskContext.get().partitionId()
        width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        keys, held, sizes, state = [], [], [], {"block": 0, "first": 0, "size": 0}

        def flush():
            lengths = np.concatenate(sizes)
            code, ids = EliasFano.of(np.concatenate(([0], np.cumsum(lengths)))), np.concatenate(held)
            row = {
                "part": part, "block": state["block"], "first": state["first"], "n_ids": len(ids), "n_docs": len(lengths),
                "width": width, "ids": ids.tobytes(), "low_bits": code.low_bits, "low": code.low, "high": code.high,
                "samples": code.samples, "doc_ids": [k for own in keys for k in own.to_pylist()],
            }
            state.update(block=state["block"] + 1, first=state["first"] + len(ids), size=0)
            for x in (keys, held, sizes):
                x.clear()
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for first, last, ids, counts in encoder.slices(batch.column("text")):
                ends = np.cumsum(counts + 1)
                every = np.full(ends[-1], end_id, dtype=f"<u{width}")
                inside = np.ones(len(every), dtype=bool)
                inside[ends - 1] = False
                every[inside] = ids
                at = 0
                while at < len(counts):
                    done = ends[at - 1] if at else 0
                    to = min(len(counts), int(np.searchsorted(ends, done + block_ids - state["size"])) + 1)
                    keys.append(batch.column("doc_id").slice(first + at, to - at))
                    held.append(every[done : ends[to - 1]])
                    sizes.append(counts[at:to] + 1)
                    state["size"] += len(held[-1])
                    at = to
                    if state["size"] >= block_ids:
                        yield flush()
        if held:
            yield flush()

    order = ["doc_id", F.xxhash64("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def _code(row: dict) -> EliasFano:
    return EliasFano(row["n_docs"] + 1, row["low_bits"], row["low"], row["high"], row["samples"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a store: doc_id, start, n_tokens, ids_crc32, part, block; places by selects.

    Only the number of ids of each part (as many numbers as write tasks) passes the driver, to place the parts.
    """
    store = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    base, total = {}, 0
    for part, n in sorted(store.groupBy("part").agg(F.sum("n_ids")).collect()):
        base[part] = total
        total += n

    def documents(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                n, code = row["n_docs"], _code(row)
                start, end = code.select(np.arange(n)), code.select(np.arange(1, n + 1))
                raw = memoryview(np.frombuffer(row["ids"], dtype=f"<u{row['width']}").astype("<u4").tobytes())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "start": pa.array(start + base[row["part"]] + row["first"], pa.int64()),
                        "n_tokens": pa.array(end - start, pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.int64()),
                        "part": pa.array([row["part"]] * n, pa.int32()),
                        "block": pa.array([row["block"]] * n, pa.int32()),
                    }
                )

    return store.mapInArrow(
        documents, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, block int"
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a store with its ids: doc_id, ids array<int>; each is cut out by two selects."""

    def documents(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                bounds = _code(row).select(np.arange(row["n_docs"] + 1)).astype(np.int32)
                ids = pa.array(np.frombuffer(row["ids"], dtype=f"<u{row['width']}").astype(np.int32))
                cells = pa.ListArray.from_arrays(pa.array(bounds), ids)
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), cells], ["doc_id", "ids"])

    return spark.read.schema(BLOCK_SCHEMA).parquet(path).mapInArrow(documents, "doc_id long, ids array<int>")

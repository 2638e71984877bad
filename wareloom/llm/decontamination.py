"""Benchmark decontamination: an FM-index per shard of the corpus, searched for the benchmark's phrases.

Words outside the benchmark's vocabulary can't be part of an occurrence, so a shard's text is the runs of vocabulary
words that are as long as the shortest phrase. The index answers which phrases occur (backward search through
wavelet-tree ranks) and where (sampled suffix positions); overlapping occurrences merge into spans.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wareloom.llm.common import Scratch, held, in_slices, with_own_names
from wareloom.llm.fm_index import FMIndex

WINDOW = 10
#: A shard is indexed when it has so many words in runs, or holds so many bytes.
SHARD_WORDS, SHARD_BYTES = 1 << 17, 8 << 20
#: Benchmark text that is broadcast at once; a larger benchmark takes several passes over the corpus.
BLOCK_BYTES = 8 << 20
FOUND = "n_words long, n_hit long, item_ids array<string>, hit_spans array<struct<first:int,last:int>>"
#: A-Z in lower case; what separates words is a blank.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Phrases:
    """The distinct windows of a block of items, as vocabulary ids."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], set[str]] = {}
        for key, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                seen.setdefault(tuple(ids[k : k + window]), set()).add(key)
        by_length: dict[int, list] = {}
        for phrase, keys in seen.items():
            by_length.setdefault(len(phrase), []).append((phrase, sorted(keys)))
        self.groups = {n: (np.array([p for p, _ in x]), [k for _, k in x]) for n, x in by_length.items()}
        self.shortest = min(by_length, default=0)


def _search(phrases: Phrases, ids: np.ndarray, lengths: np.ndarray) -> list[tuple[np.ndarray, set[str]]]:
    """For each document (``lengths`` words each, one 0 between) its hit words as a mask, and the items found."""
    found: list = [None] * len(lengths)
    edges = np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0])))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    keep = end - begin >= phrases.shortest
    begin, end = begin[keep], end[keep]
    if not phrases.groups or not len(begin):
        return found
    size = end - begin + 1
    at = np.concatenate(([0], np.cumsum(size)))
    source = np.arange(at[-1]) - np.repeat(at[:-1] - begin, size)
    text = np.where(np.isin(np.arange(at[-1]), at[1:] - 1), 0, ids[np.minimum(source, len(ids) - 1)])
    index = FMIndex(text, len(phrases.vocabulary))
    first = np.concatenate(([0], np.cumsum(lengths + 1)))
    for n, (rows, keys) in phrases.groups.items():
        low, high = index.search(rows)
        hits = np.maximum(high - low, 0)
        if not hits.any():
            continue
        which = np.repeat(np.arange(len(rows)), hits)
        place = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(low, hits)
        word = source[index.locate(place)]
        doc = np.searchsorted(first, word, side="right") - 1
        for d, w, k in zip(doc.tolist(), (word - first[doc]).tolist(), which.tolist(), strict=True):
            if found[d] is None:
                found[d] = (np.zeros(lengths[d], dtype=bool), set())
            found[d][0][w : w + n] = True
            found[d][1].update(keys[k])
    return found


def _spans(mask: np.ndarray) -> list[dict]:
    edges = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    pairs = zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True)
    return [{"first": a, "last": b - 1} for a, b in pairs]


def cut_words(text: str, spans: list[dict]) -> str:
    """``text`` without the words of ``spans``, and without what stands between the words of a span."""
    places = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at : places[s["first"]][0]])
        at = places[s["last"]][1]
    return "".join(out) + text[at:]


def _pass(docs: DataFrame, items: list[tuple[str, str | None]], window: int, first: bool) -> DataFrame:
    shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        phrases = held(("phrases", key), lambda: Phrases(shared.value, window))
        look, waiting, state = phrases.vocabulary.get, [], {"words": 0, "bytes": 0}
        none = pa.list_(pa.string()), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

        def flush():
            lengths = np.concatenate([x[2] for x in waiting])
            found = _search(phrases, np.concatenate([x[1] for x in waiting]), lengths)
            at = 0
            for batch, _, own in waiting:
                part = found[at : at + len(own)]
                at += len(own)
                masks = [f[0] if f else None for f in part]
                items_found = [f[1] if f else set() for f in part]
                if not first:
                    for k, (spans, old) in enumerate(zip(batch.column("hit_spans").to_pylist(), batch.column("item_ids").to_pylist(), strict=True)):
                        if spans and masks[k] is None:
                            masks[k] = np.zeros(own[k], dtype=bool)
                        for s in spans:
                            masks[k][s["first"] : s["last"] + 1] = True
                        items_found[k] = items_found[k] | set(old)
                    batch = batch.drop_columns(["n_words", "n_hit", "item_ids", "hit_spans"])
                columns = (
                    pa.array(own, pa.int64()),
                    pa.array([0 if m is None else int(m.sum()) for m in masks], pa.int64()),
                    pa.array([sorted(x) for x in items_found], none[0]),
                    pa.array([[] if m is None else _spans(m) for m in masks], none[1]),
                )
                for name, column in zip(("n_words", "n_hit", "item_ids", "hit_spans"), columns, strict=True):
                    batch = batch.append_column(name, column)
                yield batch
            waiting.clear()
            state.update(words=0, bytes=0)

        for batch in in_slices(batches):
            texts = batch.column("text").to_pylist()
            words = [words_of(t) for t in texts]
            lengths = np.array([len(w) for w in words], dtype=np.int64)
            ids = np.zeros(int(lengths.sum()) + len(words), dtype=np.int32)
            at = 0
            for w in words:
                ids[at : at + len(w)] = np.fromiter(map(look, w, repeat(0)), np.int32, len(w))
                at += len(w) + 1
            waiting.append((batch, ids, lengths))
            state["words"] += int((ids > 0).sum())
            state["bytes"] += batch.nbytes
            if state["words"] >= SHARD_WORDS or state["bytes"] >= SHARD_BYTES:
                yield from flush()
        if waiting:
            yield from flush()

    own = [f for f in docs.schema if first or f.name not in found_names()]
    return docs.mapInArrow(scan, StructType([*own, *StructType.fromDDL(FOUND)]))


def found_names() -> list[str]:
    return [c.split()[0] for c in re.split(r", (?=\w+ )", FOUND)]


def benchmark_blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of about ``limit`` bytes of text, read one after the other."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(-(-size // limit)) or 1
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield [(r[0], r[1]) for r in part.toLocalIterator()]


def find_overlap(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, item_ids and hit_spans (first and last word, merged) of benchmark occurrences.

    ``docs`` needs a text column; all others pass through, and columns named like the four results are replaced.
    ``benchmark``: item_id, text; an item's phrases are its windows of ``window`` words, or all of a shorter item.
    Items without words have no phrase; a null item_id counts as ''. Null or empty texts have no words. Equal
    item_ids are one item with the phrases of each row; repeated documents are searched each for itself.
    An empty benchmark finds nothing. A benchmark beyond ``block_bytes`` is searched block by block, with a written
    table between the passes, so no broadcast grows past that.
    """
    out = docs.drop(*found_names())
    scratch = Scratch(docs.sparkSession, "overlap")
    for k, items in enumerate(benchmark_blocks(benchmark, block_bytes)):
        out = _pass(out if k == 0 else scratch.write(out, "pass"), items, window, k == 0)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the benchmark's occurrences cut out of ``text`` (the four columns of ``find_overlap`` stay).

    Texts without an occurrence, null ones among them, stay as they are.
    """
    found = find_overlap(docs, benchmark, window)
    k = found.columns.index("text")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in in_slices(batches):
            spans = batch.column("hit_spans").to_pylist()
            if any(spans):
                texts = [cut_words(t, s) if s else t for t, s in zip(batch.column("text").to_pylist(), spans, strict=True)]
                batch = batch.set_column(k, "text", pa.array(texts, pa.string()))
            yield batch

    return found.mapInArrow(cut, found.schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the same columns, whatever their names, and occurrences cut out; n_chars, if there is one, follows a
    text that changed. Rows all stay, those with null or empty texts as they are."""
    plain, back = with_own_names(docs, found_names())
    out = decontaminate(plain, benchmark, window)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_hit") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return back(out)

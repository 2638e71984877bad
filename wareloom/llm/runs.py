"""Periodic runs of a text's words by Lyndon arrays, and texts with the repeats of such runs taken out.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends. Its roots are Lyndon
words: in one of the two orders of the words (rising or falling) a root that starts behind the run's first word is the
longest Lyndon word at its place, from i to the next smaller suffix. So the Lyndon arrays of both orders name every run
by (start of a root, period); the matches of i with i + period to the right, which the arrays' own comparisons have
measured, and to the left give its bounds.

Both arrays are built left to right on an ordered alphabet of which only comparisons are used. The stretch matched
furthest right so far is kept: what it covers repeats a part further left, whose comparisons have been made, and their
results are taken over; only words behind it are compared. So the words compared number a small multiple of the words.

Runs asked for have a length of at least ``LEAST`` words and ``TIMES`` periods, so every three words in a row that lie
in a run occur three times in the text. Stretches without such triples can't touch a run; they are found by sorting
triples with numpy for many texts at once, and the arrays are built for what is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wareloom.llm.common import bound_batches, in_slices, with_own_names

#: Words and periods that a run has at least.
LEAST, TIMES = 6, 4
#: Bytes of text of which words are numbered and triples sorted at once.
SLICE = 1 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def lyndon_edges(x: list[int]) -> tuple[list[int], list[int], int]:
    """Of each place in ``x``: where its next smaller suffix starts (len(x) if none does: so the longest Lyndon word at i
    ends there), and how many words the two suffixes have in common; and the number of words compared in all."""
    n = len(x)
    follower, common = [n] * n, [0] * n
    # of each place the next smaller suffix to the left, and what is in common with it
    leader, held = [-1] * n, [0] * n
    # x[right : far] equals x[right - gap : far - gap]
    right, gap, far, compared = 0, 0, 0, 0

    def match(a: int, b: int, k: int) -> int:
        nonlocal right, gap, far, compared
        begin = k
        while b + k < n and x[a + k] == x[b + k]:
            k += 1
        compared += k - begin + 1
        if b + k > far:
            right, gap, far = b, b - a, b + k
        return k

    for r in range(1, n):
        a, k, first = r - 1, 0, True
        while a >= 0:
            last = a
            # between the suffixes at the last place and at this one ``inner`` words are in common, k with r's
            inner = k if first else held_last
            if first or inner == k:
                room = far - r
                if room > k and right < r:
                    # r is inside what has been matched: its image q was compared with a's image, or with a itself
                    q, b = r - gap, (a - gap if a >= right else a)
                    if b < 0 or b >= q:
                        known = -1
                    elif follower[b] == q:
                        known = common[b]
                    elif leader[q] == b:
                        known = held[q]
                    else:
                        known = -1
                    if known < 0:
                        k = match(a, r, k)
                    elif known == room:
                        k = match(a, r, room)
                    else:
                        k = min(known, room)
                else:
                    k = match(a, r, k)
                smaller = r + k == n or x[a + k] > x[r + k]
            elif inner < k:
                k, smaller = inner, False
            else:
                smaller = True
            if not smaller:
                leader[r], held[r] = a, k
                break
            follower[a], common[a] = r, k
            held_last, first = held[last], False
            a = leader[a]
    return follower, common, compared


def find_runs(x: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``x`` with ``least`` words and ``times`` periods (three at least), by start,
    then period. A run's period is its smallest."""
    found, n = set(), len(x)
    for order in (x, [-v for v in x]):
        follower, common, _ = lyndon_edges(order)
        until: dict[int, int] = {}  # by period: where the last run found ends
        for i in range(n):
            p = follower[i] - i
            # the root that starts in the run's first period has two more at least behind it
            if common[i] < (times - 2) * p or until.get(p, 0) > i:
                continue
            a, b = i - 1, i + p - 1
            while a >= 0 and x[a] == x[b]:
                a, b = a - 1, b - 1
            end = i + p + common[i]
            until[p] = end - p
            if end - a - 1 >= max(least, times * p):
                found.add((a + 1, end - a - 1, p))
    return sorted(found)


def _stretches(ids: np.ndarray, of: np.ndarray, kinds: int) -> Iterator[tuple[int, int]]:
    """Bounds of the stretches of ``ids`` (words of the texts ``of``, numbered below ``kinds``) in which every three words
    in a row occur three times in their text. A pair, a triple, then a triple with its text are numbered in turn, each
    among those that are still possible."""
    n = len(ids)
    if n < LEAST:
        return
    at = np.flatnonzero(of[:-2] == of[2:])
    code = ids[:-1] * kinds + ids[1:]
    distinct, pair, times = np.unique(code, return_inverse=True, return_counts=True)
    frequent = times[pair] >= 3
    at = at[frequent[at] & frequent[at + 1]]
    if not len(at):
        return
    distinct, triple, times = np.unique(pair[at] * kinds + ids[at + 2], return_inverse=True, return_counts=True)
    keep = times[triple] >= 3
    at, triple = at[keep], triple[keep]
    texts = int(of[-1]) + 1
    distinct, triple, times = np.unique(triple * texts + of[at], return_inverse=True, return_counts=True)
    at = at[times[triple] >= 3]
    if not len(at):
        return
    cuts = np.flatnonzero((np.diff(at) != 1) | (of[at[1:]] != of[at[:-1]])) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(at)]):
        begin, end = int(at[a]), int(at[b - 1]) + 3
        if end - begin >= LEAST:
            yield begin, end


class _Numbers(dict):
    """Numbers words as they come: equal words have one number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def folded(words: list[bytes], key: object) -> list[bytes]:
    """The words with a planted period: of one key in ten, by its crc32, the words from some place on repeat the first p
    from there. A null key plants nothing."""
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return words[:a] + (root * ((n - a) // p + 1))[: n - a]


def runs_of(texts: Iterable[list[bytes]]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Each text's words with its runs: (first word, length, period), by start, then period."""
    texts = list(texts)
    numbers = _Numbers()
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ids = np.fromiter((k for t in texts for k in map(numbers.__getitem__, t)), np.int64, int(sizes.sum()))
    starts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(texts)), sizes)
    found: list[list] = [[] for _ in texts]
    for begin, end in _stretches(ids, of, max(1, len(numbers))):
        k = int(of[begin])
        shift = begin - int(starts[k])
        found[k] += [(s + shift, length, p) for s, length, p in find_runs(ids[begin:end].tolist())]
    return zip(texts, map(sorted, found))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that lie in a run behind its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, p in runs:
        edge[start + p] += 1
        edge[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return [words[k] for k in kept.tolist()]


def collapse_runs(docs: DataFrame, key: str = "doc_id", change: Callable[[list[bytes], object], list[bytes]] | None = None) -> DataFrame:
    """``docs`` (``key``, text, any other columns) with runs, array of structs (start, length, period) by start, then
    period, and collapsed_text: the words outside runs and of their first periods, joined by one blank.

    Words are what white space of ASCII parts. A null text, an empty one or one of blanks has no runs and collapses to
    empty text. Rows are read by themselves: repeated rows, keys that are null or the same and ties change nothing. A
    text is read whole, in memory in proportion to it. ``change`` is applied to a text's words first. Columns called
    runs or collapsed_text are replaced by the result's.
    """
    bound_batches(docs.sparkSession)
    docs = docs.drop("runs", "collapsed_text")
    own, back = with_own_names(docs, ["runs", "collapsed_text"])
    schema = StructType([*own.schema.fields, *StructType.fromDDL(f"runs {RUNS}, collapsed_text string").fields])

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in in_slices(batches, "text", SLICE):
            keys = batch.column(key).to_pylist() if change else None
            # bytes part at white space of ASCII alone
            words = [t.split() if t else [] for t in batch.column("text").cast(pa.binary()).to_pylist()]
            if change:
                words = [change(w, k) for w, k in zip(words, keys, strict=True)]
            runs, texts = [], []
            for w, found in runs_of(words):
                runs.append([{"start": s, "length": length, "period": p} for s, length, p in found])
                texts.append(b" ".join(collapse(w, found)))
            added = [pa.array(runs, kind), pa.array(texts, pa.binary()).view(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "runs", "collapsed_text"])

    return back(own.mapInArrow(read, schema), "runs", "collapsed_text")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of what ``collapse_runs`` found: ``key``, n_runs, the run with the most periods (exactly; of equal ones the first
    start, then the smallest period; nulls without runs), and digests of all runs and of the collapsed text."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    more = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    best = F.aggregate("runs", none, lambda a, b: F.when(more(a, b), b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    found = found.select(key, "runs", "collapsed_text", best.alias("best"))
    return found.select(
        key, F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"),
    )

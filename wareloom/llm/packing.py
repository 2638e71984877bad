"""Best-fit packing by bin completion over the histogram of piece lengths.

Pieces are at most ``capacity`` ids long, so the whole corpus has at most ``capacity`` different lengths however many
documents there are. The search runs on that histogram: it takes the largest length left, enumerates the undominated
fillings of the space beside it, least waste first, and uses one as often as the counts allow, or less often on the
way back. The answer is a plan of (length, ranks) -> (sequences, offset); pieces find their place by their rank among
the pieces of their length, which Spark computes without ever gathering a length in one task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wareloom.llm.common import Scratch
from wareloom.llm.tokens import END_ID, default_tokenizer, worker_encoder

CAPACITY = 1024
#: Partial fillings that the search looks at before it settles for the best plan so far; None: until the plan is optimal.
SEARCH_STEPS = 150_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY):
    """Pieces of ``docs`` (doc_id, text; other columns are ignored): PIECE_SCHEMA.

    A document is its text's ids (null: none) and the end id. Only longer documents than ``capacity`` are cut, into
    pieces of that length with the shorter one, if any, first. Repeated rows are packed each for itself.
    """
    tokenizer = tokenizer or default_tokenizer()

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder, end = worker_encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            keys = batch.column("doc_id")
            for first, last, ids, counts in encoder.slices(batch.column("text")):
                raw, total = memoryview(ids.astype("<u4", copy=False).tobytes()), counts + 1
                parts = -(-total // capacity)
                row = np.repeat(np.arange(len(counts)), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                head = total - (parts - 1) * capacity
                length = np.where(piece == 0, head[row], capacity)
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                at = (np.cumsum(counts) - counts)[row] + start
                ends = piece == parts[row] - 1
                crc = [
                    zlib.crc32(end, zlib.crc32(raw[4 * a : 4 * (a + n - 1)])) if e else zlib.crc32(raw[4 * a : 4 * (a + n)])
                    for a, n, e in zip(at.tolist(), length.tolist(), ends.tolist(), strict=True)
                ]
                columns = (pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(first, last - first).take(pa.array(row)), *columns], names=[c.split()[0] for c in PIECE_SCHEMA.split(", ")]
                )

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECE_SCHEMA)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences that any packing needs (Martello and Toth's L2 bound)."""
    sizes = sorted(counts)
    best = -(-sum(s * c for s, c in counts.items()) // capacity)
    for k in [s for s in sizes if s <= capacity // 2] + [0]:
        alone = sum(c for s, c in counts.items() if s > capacity - k)
        half = [(s, c) for s, c in counts.items() if capacity // 2 < s <= capacity - k]
        n = sum(c for _, c in half)
        small = sum(s * c for s, c in counts.items() if k <= s <= capacity // 2)
        room = n * capacity - sum(s * c for s, c in half)
        best = max(best, alone + n + max(0, -(-(small - room) // capacity)))
    return best


class Steps:
    """What is left of the search's steps."""

    def __init__(self, steps: int | None):
        self.left = steps

    def take(self) -> bool:
        if self.left is not None:
            self.left -= 1
        return self.left is None or self.left >= 0


def _spread(bits: int, width: int) -> int:
    """Every set bit, and the ``width`` bits above it."""
    done = 0
    while done < width:
        step = min(done + 1, width - done)
        bits |= bits << step
        done += step
    return bits


def fillings(room: int, counts: dict[int, int], waste: int, steps: Steps) -> Iterator[list[int]]:
    """All undominated fillings of ``room`` from ``counts`` that waste at most ``waste``, least waste first.

    A filling is dominated if some of its lengths (or none) could give way to one more available length that is no
    shorter than they are together and still fits: whatever packing uses the filling, one at least as good uses the
    other. Lengths join a filling in falling order, so a part of a filling in which some lengths can give way isn't
    continued. With the same waste, fillings of longer lengths come first.
    """
    sizes = [s for s in sorted(counts) if counts[s] and s <= room]
    if not sizes:
        if room <= waste:
            yield []
        return
    if sizes[-1] == room:
        yield [room]
        return
    mask, reach = (1 << (room + 1)) - 1, [1]
    for s in sizes:
        bits, times, step = reach[-1], min(counts[s], room // s), 1
        while times:
            step = min(step, times)
            bits |= (bits << (s * step)) & mask
            times -= step
            step *= 2
        reach.append(bits)
    there = sum(1 << s for s in sizes)
    used: dict[int, int] = {}

    def grow(k: int, left: int, chosen: list[int], some: int, two: int, slack: int) -> Iterator[list[int]]:
        """Fillings that continue ``chosen`` with ``left`` more, of sizes[:k]; ``some`` and ``two``: sums of at least
        one and of at least two of the chosen."""
        if not left:
            if all(s > slack for s in sizes[: bisect_right(sizes, slack)] if counts[s] > used.get(s, 0)):
                yield chosen
            return
        for i in range(min(k, bisect_right(sizes, left)) - 1, -1, -1):
            if not reach[i + 1] >> left & 1:
                return
            s = sizes[i]
            if used.get(s, 0) >= counts[s] or not (reach[i] | reach[i + 1]) >> (left - s) & 1:
                continue
            if not steps.take():
                return
            used[s] = used.get(s, 0) + 1
            now_two = two | (some << s)
            free = there if counts[s] > used[s] else there & ~(1 << s)
            for x in chosen:
                if counts[x] <= used[x]:
                    free &= ~(1 << x)
            apart = _spread(1 << s, slack) & ~(1 << s)
            if not (_spread(now_two, slack) | apart) & free:
                yield from grow(i + 1, left - s, [*chosen, s], some | (1 << s) | (some << s), now_two, slack)
            used[s] -= 1

    for slack in range(min(waste, room - sizes[0]) + 1):
        if reach[-1] >> (room - slack) & 1:
            yield from grow(len(sizes), room - slack, [], 0, 0, slack)
        if steps.left is not None and steps.left < 0:
            return


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """A plan that puts beside the largest length left the largest that fits, again and again."""
    counts, plan = {s: c for s, c in counts.items() if c}, []
    while counts:
        sizes, bin_, left = sorted(counts), [], capacity
        while True:
            k = bisect_right(sizes, left)
            while k and counts[sizes[k - 1]] <= bin_.count(sizes[k - 1]):
                k -= 1
            if not k:
                break
            bin_.append(sizes[k - 1])
            left -= sizes[k - 1]
        times = min(counts[s] // bin_.count(s) for s in set(bin_))
        plan.append((bin_, times))
        for s in bin_:
            counts[s] -= times
        counts = {s: c for s, c in counts.items() if c}
    return plan


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY, steps: int | None = SEARCH_STEPS):
    """[(lengths, times)]: fillings that use up ``counts``, in as few sequences as the search finds.

    Depth-first bin completion around the largest length left, with best fit as the first incumbent. A filling is used
    as often as it can be, then half as often and so on down to once, which together with all undominated fillings
    makes the search complete: without a limit of steps it ends with an optimal plan. A branch ends when its waste so
    far leaves no room for fewer sequences than the incumbent, or where it meets counts that it has been to with no
    more waste; the search ends at the lower bound.
    """
    now = {s: c for s, c in counts.items() if c}
    if not now:
        return []
    total, goal = sum(s * c for s, c in now.items()), lower_bound(now, capacity)
    best = best_fit(now, capacity)
    bins, budget = sum(n for _, n in best), Steps(steps)
    random = np.random.default_rng(7)
    number = {s: int(random.integers(1, 1 << 62)) for s in now}
    seen: dict[int, int] = {}
    path: list[tuple[list[int], int]] = []
    state, waste = sum(number[s] * c for s, c in now.items()) & ((1 << 64) - 1), 0

    def spare() -> int:
        return (bins - 1) * capacity - total - waste

    def moves() -> Iterator[tuple[list[int], int]]:
        big = max(s for s, c in now.items() if c)
        now[big] -= 1
        options = fillings(capacity - big, dict(now), spare(), budget)
        now[big] += 1
        for f in options:
            bin_ = [big, *f]
            times = min(now[s] // bin_.count(s) for s in set(bin_))
            while times:
                yield bin_, times
                times //= 2

    stack = [moves()] if bins > goal else []
    while stack and bins > goal and (budget.left is None or budget.left >= 0):
        move = next(stack[-1], None)
        if move is None:
            stack.pop()
            if path:
                bin_, times = path.pop()
                waste -= (capacity - sum(bin_)) * times
                for s in bin_:
                    now[s] += times
                    state += number[s] * times
                state &= (1 << 64) - 1
            continue
        bin_, times = move
        more = (capacity - sum(bin_)) * times
        if more > spare():
            continue
        after = (state - sum(number[s] for s in bin_) * times) & ((1 << 64) - 1)
        if seen.get(after, waste + more + 1) <= waste + more:
            continue
        seen[after] = waste + more
        for s in bin_:
            now[s] -= times
        path.append((bin_, times))
        state, waste = after, waste + more
        if any(now.values()):
            stack.append(moves())
            continue
        best, bins = list(path), sum(n for _, n in path)
        stack.append(iter(()))
    return best


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (PIECE_SCHEMA, already written) with sequence_id and offset: each sequence is filled from 0 on.

    The driver gets one count per length and sends back the plan, which grows with the number of lengths (at most
    ``capacity``), not with the pieces.
    """
    counts = {int(n): int(c) for n, c in pieces.groupBy("length").count().collect()}
    steps: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for bin_, times in plan_sequences(counts, capacity):
        offset = 0
        for s in bin_:
            steps.setdefault(s, []).append((used.get(s, 0), sequence, offset))
            used[s] = used.get(s, 0) + times
            offset += s
        sequence += times
    plan = {s: np.array(v, dtype=np.int64).T for s, v in steps.items()}

    buckets = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    per = dealt.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(own)).join(base, ["bucket", "length"])
    ranked = ranked.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own") - 1).alias("rank")
    )
    shared = pieces.sparkSession.sparkContext.broadcast(plan)

    def place(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for s in np.unique(length):
                rows = np.flatnonzero(length == s)
                first, begin, at = shared.value[int(s)]
                k = np.searchsorted(first, rank[rows], side="right") - 1
                sequence[rows], offset[rows] = begin[k] + rank[rows] - first[k], at[k]
            kept = batch.drop_columns(["rank"])
            yield kept.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return ranked.mapInArrow(place, f"{PIECE_SCHEMA}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Cut and pack ``docs`` (doc_id, text): PIECE_SCHEMA, sequence_id, offset. Each text is encoded once."""
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.write(cut_pieces(docs, tokenizer, capacity=capacity), "pieces"), scratch, capacity)


def packed_ids(docs: DataFrame, placed: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The sequences themselves: sequence_id, ids array<int>, at most a sequence's capacity each.

    ``docs`` must hold one row per doc_id here; the placements say where each piece's ids go.
    """
    tokenizer = tokenizer or default_tokenizer()

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = worker_encoder(tokenizer)
        for batch in batches:
            for first, last, ids, counts in encoder.slices(batch.column("text")):
                cells = [[*own, end_id] for own in np.split(ids.astype(np.int32), np.cumsum(counts)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), pa.array(cells, pa.list_(pa.int32()))], ["doc_id", "ids"]
                )

    ids = docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids array<int>")
    parts = placed.join(ids, placed.doc_id.eqNullSafe(ids.doc_id)).select(
        "sequence_id", "offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("part")
    )
    return parts.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "part"))), lambda x: x["part"])).alias("ids")
    )

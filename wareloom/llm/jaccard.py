"""N-gram Jaccard join: size-aware heavy-light similarity join on word-shingle sets.

1. One pass turns every text into a set of 64-bit shingle hashes and keeps its size, a fingerprint, its smallest
   hashes and a bitmap (the parity of the set's hashes, one to two bits a shingle). Documents with equal sets become
   one class.
2. Light (small) sets enumerate their subsets of exactly the size that a link needs; sets that share a subset link.
   Heavy sets scan inverted lists of their rarest shingles. The boundary is where the two costs, counted on the
   corpus, meet.
3. In each list one member is tried against all others (a star). Verified links make components; then only members of
   different components are paired, so copies are never paired with each other, yet every link between different
   components is found.
4. Bits in which two bitmaps differ are shingles that one set has alone, so bitmaps bound the intersection from above:
   pairs that can't link go without moving a set. What is left is verified on whole sets, which are made again for the
   documents concerned only, first one partner for each, then the others that are still in different components.
   Members of long lists are verified in tiles, which give forests of links: pairs aren't written there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareloom.llm.common import Scratch, connected_components, held, in_slices, quoted

#: A link: intersection * 100 >= 90 * union.
SIMILARITY = (90, 100)
SHINGLE = 3
#: Sets up to this size are kept whole from the first pass; the light boundary lies below.
KEPT_WHOLE = 64
#: Shingles in more sets' prefixes than this are frequent and come last; the number is raised until they are few.
FREQUENT, MOST_FREQUENT = 8, 1_000_000
#: Lists of up to SHORT_LIST members pair them as rows; longer ones are compared in tiles of about TILE members.
SHORT_LIST, TILE = 16, 256
#: Sets of a tile in which whole sets are compared, and their hashes, at most.
SET_TILE, TILE_HASHES = 1024, 1 << 20
#: Partners of one document in one verification block, and bits of the filter on documents concerned.
BLOCK, FILTER_BITS = 256, 1 << 24
#: Document numbers that may be broadcast.
BROADCAST_IDS = 1_000_000
SLICE_BYTES = 1 << 17

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word-shingle hashes of texts, vectorised over slices of a batch."""

    def __init__(self, words: int = SHINGLE):
        self.words = words
        self.powers = np.zeros(0, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, SLICE_BYTES * 2)
            for name, base in (("powers", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                table = np.full(size, base, dtype=np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table, dtype=np.uint64))

    def _slice(self, texts: list[bytes]) -> list[np.ndarray]:
        joined = b" ".join(texts) + b" "
        self._grow(len(joined) + 1)
        raw = np.frombuffer(joined, dtype=np.uint8)
        edge = np.diff(np.concatenate(([True], SPACE[raw], [True])).view(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        total = np.concatenate(
            (np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * self.powers[: len(raw)], dtype=np.uint64))
        )
        word = _mix((total[end] - total[start]) * self.inverse[start] + (end - start).astype(np.uint64))
        first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        at = np.searchsorted(start, first)
        k = self.words
        grams = np.zeros(max(0, len(word) - k + 1), dtype=np.uint64)
        for j in range(k):
            grams = grams * np.uint64(_BASE) + word[j : j + len(grams)]
        grams = _mix(grams)
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= k:
                own = np.sort(grams[a : b - k + 1].view(np.int64))
                out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
            elif b > a:
                few = np.uint64(b - a)
                for w in word[a:b]:
                    few = _mix(np.array([few], np.uint64) * np.uint64(_BASE) + w)[0]
                out.append(np.array([few], dtype=np.uint64).view(np.int64))
            else:
                out.append(np.zeros(0, dtype=np.int64))
        return out

    def sets(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        part: list[bytes] = []
        size = 0
        for t in texts:
            part.append((t or "").encode().translate(LOWER))
            size += len(part[-1])
            if size >= SLICE_BYTES:
                yield from self._slice(part)
                part, size = [], 0
        if part:
            yield from self._slice(part)


def _ceil(a: int, b: int) -> int:
    return -(-a // b)


class Rule:
    """Sizes and overlaps that a similarity of num / den asks for."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n: int) -> int:
        return n - _ceil(self.num * n, self.den) + 1

    def overlap(self, a: int, b: int) -> int:
        return _ceil(self.num * (a + b), self.num + self.den)

    def partners(self, n: int) -> range:
        return range(max(1, _ceil(self.num * n, self.den)), self.den * n // self.num + 1)

    def subset_sizes(self, n: int) -> list[int]:
        return sorted({self.overlap(n, b) for b in self.partners(n) if self.overlap(n, b) <= min(n, b)})

    def subsets(self, n: int) -> int:
        return sum(comb(n, c) for c in self.subset_sizes(n))


def _list_of(arrays: list[np.ndarray]):
    import pyarrow as pa

    offsets = np.concatenate(([0], np.cumsum([len(x) for x in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))


def _rows_of(column) -> list[np.ndarray]:
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _bitmap(grams: np.ndarray) -> bytes:
    """Parities of the hashes of a set by their lowest bits: a power of two of bits, at least one a shingle."""
    bits = 1 << max(6, (len(grams) - 1).bit_length())
    return np.packbits(np.bincount(grams & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(bitmaps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps of the same length as rows of 64-bit words, folded to ``size`` bytes: parities of fewer bits add up."""
    rows = np.frombuffer(b"".join(bitmaps), dtype=np.uint64).reshape(len(bitmaps), -1, size // 8)
    return np.bitwise_xor.reduce(rows, axis=1)


def _fingerprints(grams: np.ndarray) -> tuple[int, int]:
    raw = grams.view(np.uint64)
    return tuple(int(_mix(x).sum(dtype=np.uint64).astype(np.int64)) for x in (raw, raw ^ np.uint64(_BASE)))


def shingle_table(docs: DataFrame, rule: Rule, words: int) -> DataFrame:
    """doc_id, n, f1, f2 (fingerprint of the set), low (its smallest hashes, all of a set of up to KEPT_WHOLE), bits."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingler = held(("shingler", words), lambda: Shingler(words))
        for batch in in_slices(batches):
            n, f1, f2, low, bits = [], [], [], [], []
            for s in shingler.sets(batch.column("text").to_pylist()):
                n.append(len(s))
                for column, value in zip((f1, f2), _fingerprints(s), strict=True):
                    column.append(value)
                p = rule.prefix(len(s)) if len(s) else 0
                low.append(s if len(s) <= KEPT_WHOLE else s[: p + max(8, p // 4)])
                bits.append(_bitmap(s))
            columns = (pa.array(n, pa.int32()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), _list_of(low), pa.array(bits, pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n", "f1", "f2", "low", "bits"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n int, f1 long, f2 long, low array<long>, bits binary")


def _bit(ids: np.ndarray) -> np.ndarray:
    return (_mix(ids.view(np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def whole_sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(c, grams array<long>) of the classes in ``classes`` (c, doc_id, f1, f2), which has been written.

    A bit filter of fixed size (its bits are or-ed on the executors first) keeps other texts from being hashed; the
    join behind it removes what the filter let through.
    """

    def places(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            bit = _bit(batch.column("doc_id").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(bit >> 15), pa.array(bit & 32767)], ["row", "pos"])

    marks = classes.select("doc_id").mapInArrow(places, "row long, pos long")
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row, own in marks.groupBy("row").agg(F.expr("bitmap_construct_agg(pos)").alias("bits")).collect():
        bits[row * 4096 : row * 4096 + 4096] = np.frombuffer(own, dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingler, bits = held(("shingler", words), lambda: Shingler(words)), shared.value
        for batch in batches:
            keys = batch.column("doc_id")
            at = _bit(keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            wanted = ((bits[at >> 3] >> (at & 7)) & 1).astype(bool) & keys.is_valid().to_numpy(zero_copy_only=False)
            part = batch.filter(pa.array(wanted))
            for own in in_slices([part]):
                sets = list(shingler.sets(own.column("text").to_pylist()))
                prints = np.array([_fingerprints(s) for s in sets], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), pa.array(prints[:, 0]), pa.array(prints[:, 1]), _list_of(sets)], ["doc_id", "f1", "f2", "grams"]
                )

    found = docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, f1 long, f2 long, grams array<long>")
    return found.join(classes, ["doc_id", "f1", "f2"]).dropDuplicates(["doc_id", "f1", "f2"]).select("c", "grams")


def may_link(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The ``pairs`` (a, b) that sizes and bitmaps don't rule out."""
    side = lambda x: classes.select(*[F.col(c).alias(f"{x}{c}" if c != "c" else x) for c in ("c", "n", "bits")])
    fit = f"{rule.den} * least(an, bn) >= {rule.num} * greatest(an, bn)"
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(fit)
    num, den = rule.num, rule.den

    def look(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b, an, bn = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "an", "bn"))
            left, right = (np.array(batch.column(c).to_pylist(), dtype=object) for c in ("abits", "bbits"))
            shape = np.array([(len(x), len(y)) for x, y in zip(left, right)], dtype=np.int64).reshape(-1, 2)
            keep = np.zeros(len(a), dtype=bool)
            for x, y in np.unique(shape, axis=0).tolist():
                at = np.flatnonzero((shape == (x, y)).all(axis=1))
                apart = _folded(left[at].tolist(), min(x, y)) ^ _folded(right[at].tolist(), min(x, y))
                both = (an[at].astype(np.int64) + bn[at] - np.bitwise_count(apart).sum(axis=1, dtype=np.int64)) // 2
                keep[at] = both * den >= num * (an[at] + bn[at] - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return joined.select("a", "b", "an", "bn", "abits", "bbits").mapInArrow(look, "a long, b long")


def verify(docs: DataFrame, pairs: DataFrame, classes: DataFrame, rule: Rule, words: int, scratch: Scratch) -> DataFrame:
    """The written ``pairs`` (a, b) whose whole sets link; written.

    ``a`` stands in blocks of about BLOCK partners; a block is a's set and then its partners' sets, read in order.
    """
    own = classes.select("c", "doc_id", "f1", "f2")
    concerned = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    concerned = scratch.write(own.join(concerned, "c", "left_semi"), "concerned")
    sets = scratch.write(whole_sets(docs, concerned, words), "sets")
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = pairs.join(blocks, "a").withColumn("block", F.expr("pmod(xxhash64(b), blocks)"))
    heads = blocks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    heads = heads.join(sets.withColumnRenamed("c", "a"), "a")
    tails = dealt.select("a", "block", "b").join(sets.withColumnRenamed("c", "b"), "b")
    rows = heads.select("a", "block", F.lit(None).cast("long").alias("b"), "grams").unionAll(tails.select("a", "block", "b", "grams"))
    num, den = rule.num, rule.den

    def check(batches: Iterator) -> Iterator:
        import pyarrow as pa

        head, own = None, np.zeros(0, np.int64)
        for batch in batches:
            left, right = [], []
            a, block, b = (batch.column(c).to_pylist() for c in ("a", "block", "b"))
            for k, grams in enumerate(_rows_of(batch.column("grams"))):
                if b[k] is None:
                    head, own = (a[k], block[k]), grams.copy()
                elif head == (a[k], block[k]):
                    at = np.minimum(np.searchsorted(own, grams), len(own) - 1)
                    both = int((own[at] == grams).sum())
                    if both * den >= num * (len(own) + len(grams) - both):
                        left.append(a[k])
                        right.append(b[k])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    placed = rows.repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    links = scratch.write(placed.mapInArrow(check, "a long, b long"), "links")
    scratch.drop(sets, concerned)
    scratch.release()
    return links


def resolve(docs: DataFrame, pairs: DataFrame, classes: DataFrame, rule: Rule, words: int, scratch: Scratch) -> DataFrame:
    """Links among the written ``pairs`` (a, b) that make the same components as all of them; written.

    One partner of each b is verified first; then the pairs whose ends are still in different components.
    """
    first = scratch.write(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    links = verify(docs, first, classes, rule, words, scratch)
    found = scratch.write(connected_components(links, scratch), "found")
    side = lambda x: found.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}"))
    rest = pairs.join(first, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    rest = scratch.write(rest.where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b"), "rest")
    scratch.drop(first, found)
    if rest.isEmpty():
        return links
    more = verify(docs, rest, classes, rule, words, scratch)
    scratch.drop(rest)
    return links.unionAll(more)


def crowd_members(crowds: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """(head, band, c, component, guest, n, bits): the members of each crowd (head, c, component) by bands of sizes.

    Sizes of linked sets lie in the same or in neighbouring bands, so a member stands in its own band and is a guest in
    the one below. Guests of a band meet each other in their own.
    """
    step = float(np.log(rule.den / rule.num))
    members = crowds.select("head", "c", "component").join(classes.select("c", "n", "bits"), "c")
    # rounding may put a size into either of two bands; it has a place in both
    low, high = (F.floor(F.log(F.col("n") * F.lit(x)) / step).cast("int") for x in (1 - 1e-9, 1 + 1e-9))
    members = members.withColumn("low", low).withColumn("band", F.explode(F.array_distinct(F.array("low", high, F.col("low") - 1))))
    return members.select("head", "band", "c", "component", (F.col("band") < F.col("low")).alias("guest"), "n", "bits")


def crowd_sizes(members: DataFrame) -> DataFrame:
    """A row for each crowd's band in which members of different components can link.

    ``own`` is its commonest component; r0, r1, r2, r3 count the others' members, those of ``own``, and the guests of each.
    """
    parts = members.groupBy("head", "band", "component").agg(
        F.count_if(~F.col("guest")).alias("here"), F.count_if("guest").alias("guests"), F.max("n").alias("most")
    )
    largest = F.max(F.struct((F.col("here") + F.col("guests")).alias("size"), "component", "here", "guests")).alias("x")
    whole = parts.groupBy("head", "band").agg(largest, F.sum("here").alias("h"), F.sum("guests").alias("g"), F.max("most").alias("most"), F.count("*").alias("k"))
    rest = [F.col("h") - F.col("x.here"), F.col("x.here"), F.col("g") - F.col("x.guests"), F.col("x.guests")]
    return whole.where("k > 1 and h > 0").select("head", "band", F.col("x.component").alias("own"), "most", *[c.alias(f"r{k}") for k, c in enumerate(rest)])


def in_tiles(members: DataFrame, scratch: Scratch, size: str, once: bool = False) -> DataFrame:
    """``members`` with tile, i and j: rows of one (head, band, i, j) are the members of two tiles, or of one.

    A tile has about ``size`` members, an expression over ``most``, the largest set's size. All pairs of tiles stand
    there but those of one component and those of guests alone; a band of up to ``size`` members is one tile. With
    ``once``, each member stands in one tile and tiles aren't paired.
    """
    sizes = crowd_sizes(members).withColumn("size", F.expr(size)).withColumn("few", F.expr("r0 + r1 + r2 + r3 <= size"))
    kinds = [F.expr(f"cast(if(few, {int(not k)}, ceil(r{k} / size)) as int)").alias(f"t{k}") for k in range(4)]
    # written, so that both sides of the join are plain exchanges, of which Spark can split the one of a large crowd
    sizes = scratch.write(sizes.select("head", "band", "own", "few", F.expr("cast(ceil((r0 + r1 + r2 + r3) / size) as int)").alias("all"), *kinds), "sizes")
    rows = members.join(sizes, ["head", "band"]).withColumn("h", F.xxhash64("c"))
    if once:
        rows = rows.withColumn("tile", F.expr("cast(pmod(h, all) as int)"))
        return rows.select(*members.columns, "tile", F.col("tile").alias("i"), F.col("tile").alias("j"))
    rows = rows.withColumn("kind", F.expr("if(few, 0, if(guest, 2, 0) + if(component = own, 1, 0))"))
    start = "element_at(array(0, t0, t0 + t1, t0 + t1 + t2), kind + 1)"
    rows = rows.withColumn("tile", F.expr(f"cast({start} + pmod(h, element_at(array(t0, t1, t2, t3), kind + 1)) as int)"))
    meets = "case kind when 0 then true when 1 then o < t0 or o between t0 + t1 and t0 + t1 + t2 - 1 when 2 then o < t0 + t1 else o < t0 end"
    rows = rows.withColumn("other", F.explode(F.expr(f"filter(sequence(0, t0 + t1 + t2 + t3 - 1), o -> {meets})")))
    return rows.select(*members.columns, "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))


class _Tiles:
    """The members of two tiles, and which pairs of them sizes and bitmaps don't rule out."""

    def __init__(self, rows: list[tuple], group: tuple, rule: Rule):
        self.c, self.component, tile, guest, self.n, bits = (np.array(x, dtype=np.int64) if k < 5 else x for k, x in enumerate(list(zip(*rows))[:6]))
        size = min(map(len, bits))
        words = np.concatenate([_folded([x], size) for x in bits])
        self.left = np.flatnonzero(tile == group[2])
        self.right = self.left if group[2] == group[3] else np.flatnonzero(tile == group[3])
        n, left, right = self.n, self.left[:, None], self.right[None, :]
        apart = np.zeros((left.size, right.size), dtype=np.int64)
        for w in range(words.shape[1]):
            apart += np.bitwise_count(words[left, w] ^ words[right, w])
        both = np.minimum((n[left] + n[right] - apart) // 2, np.minimum(n[left], n[right]))
        self.fits = (both * rule.den >= rule.num * (n[left] + n[right] - both)) & (self.component[left] != self.component[right])
        self.fits &= (guest[left] & guest[right]) == 0


def _tiles(batches: Iterable, columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each (head, band, i, j) of sorted batches, if there are two at least."""
    group, rows = None, []
    for batch in batches:
        own = [_rows_of(batch.column(x)) if x == "grams" else batch.column(x).to_pylist() for x in columns]
        for head, band, i, j, *row in zip(*(batch.column(x).to_pylist() for x in ("head", "band", "i", "j")), *own, strict=True):
            if group != (head, band, i, j):
                if len(rows) > 1:
                    yield group, rows
                group, rows = (head, band, i, j), []
            rows.append(row)
    if len(rows) > 1:
        yield group, rows


def near_members(members: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """The ``members`` of crowds that, by sizes and bitmaps, may link with one of another component; written."""

    def look(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for group, rows in _tiles(batches, ["c", "component", "tile", "guest", "n", "bits"]):
            x = _Tiles(rows, group, rule)
            near = np.unique(np.concatenate((x.left[x.fits.any(axis=1)], x.right[x.fits.any(axis=0)])))
            if len(near):
                head, band = (pa.array(np.full(len(near), v), kind) for v, kind in ((group[0], pa.int64()), (group[1], pa.int32())))
                yield pa.RecordBatch.from_arrays([head, band, pa.array(x.c[near])], ["head", "band", "c"])

    tiles = in_tiles(members, scratch, f"{TILE}").repartition("head", "band", "i", "j").sortWithinPartitions("head", "band", "i", "j")
    near = tiles.mapInArrow(look, "head long, band int, c long").distinct()
    return scratch.write(members.join(near, ["head", "band", "c"], "left_semi"), "near")


def tile_links(tiles: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, of_a, of_b): in each group of ``tiles`` links, and their ends' components, that join all that its links join.

    Whole sets are compared, and pairs that the links found in the group have joined no more: a group of any links has
    fewer rows here than members.
    """
    num, den = rule.num, rule.den

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for group, rows in _tiles(batches, ["c", "component", "tile", "guest", "n", "bits", "grams"]):
            x, grams, out = _Tiles(rows, group, rule), [r[6] for r in rows], []
            label = x.component.copy()
            for k in np.flatnonzero(x.fits.any(axis=1)).tolist():
                one = int(x.left[k])
                near = x.right[x.fits[k] & (label[x.right] != label[one])]
                if not len(near):
                    continue
                own, others = grams[one], np.concatenate([grams[y] for y in near])
                hits = np.concatenate(([0], np.cumsum(own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others)))
                both = np.diff(hits[np.concatenate(([0], np.cumsum(x.n[near])))])
                for y in near[both * den >= num * (x.n[one] + x.n[near] - both)].tolist():
                    if label[y] != label[one]:
                        label[label == label[y]] = label[one]
                        out.append((x.c[one], x.c[y], x.component[one], x.component[y]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*out, strict=True)], ["a", "b", "of_a", "of_b"])

    rows = tiles.join(sets, "c").repartition("head", "band", "i", "j").sortWithinPartitions("head", "band", "i", "j")
    return rows.mapInArrow(compare, "a long, b long, of_a long, of_b long")


def crowd_links(docs: DataFrame, crowds: DataFrame, classes: DataFrame, rule: Rule, words: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that, with the components there are, join all that links among members of a crowd join; written.

    ``crowds``: head, c, component. Members that may link with another component are compared on whole sets, first in
    one tile each, then, those of different components still, in all pairs of tiles. No list of pairs is ever made: a
    member costs a row for each tile it meets, and links are a forest of each group of tiles.
    """
    size = f"greatest(1, least({SET_TILE}, {TILE_HASHES} div most))"
    members = scratch.write(crowd_members(crowds, classes, rule), "members")
    near = near_members(members, rule, scratch)
    scratch.drop(members)
    concerned = classes.select("c", "doc_id", "f1", "f2").join(near.select("c").distinct(), "c", "left_semi")
    concerned = scratch.write(concerned, "concerned")
    sets = scratch.write(whole_sets(docs, concerned, words), "sets")
    links = scratch.write(tile_links(in_tiles(near, scratch, size, once=True), sets, rule), "tile-links")
    joined = connected_components(links.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")), scratch)
    joined = joined.select(F.col("id").alias("component"), F.col("component").alias("now"))
    left = near.join(joined, "component", "left").withColumn("component", F.coalesce("now", "component")).select(*near.columns)
    left = scratch.write(left, "left")
    apart = near_members(left, rule, scratch)
    more = scratch.write(tile_links(in_tiles(apart, scratch, size), sets, rule), "more-links")
    scratch.drop(near, concerned, sets, left, apart)
    scratch.release()
    return links.select("a", "b").unionAll(more.select("a", "b"))


def light_boundary(sizes: dict[int, int], rule: Rule, members: float) -> int:
    """The largest size whose sets enumerate subsets more cheaply than they scan lists.

    A subset costs a row; a list costs a row per prefix shingle and its share of the other members read.
    """
    best, bound = None, 0
    for x in range(0, KEPT_WHOLE // 2):
        cost = sum(c * (rule.subsets(n) if n <= x else rule.prefix(n) * (1 + members)) for n, c in sizes.items())
        if best is None or cost < best:
            best, bound = cost, x
    return bound


def light_lists(sets: DataFrame, bound: int, rule: Rule) -> DataFrame:
    """(key, c, n, pos): a key for each subset of a linking size of the sets up to ``bound``."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], []]
            docs = batch.column("c").to_pylist()
            for doc, grams in zip(docs, _rows_of(batch.column("low")), strict=True):
                mixed, n = _mix(grams.view(np.uint64)), len(grams)
                everything = int(mixed.sum(dtype=np.uint64))
                for c in rule.subset_sizes(n):
                    for gone in combinations(range(n), n - c):
                        rest = (everything - sum(int(mixed[k]) for k in gone)) % (1 << 64)
                        key = int(_mix(np.array([rest ^ c], dtype=np.uint64)).view(np.int64)[0])
                        for column, value in zip(out, (key, doc, n), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array([0] * len(out[0]), pa.int32())],
                ["key", "c", "n", "pos"],
            )

    return sets.where(F.col("n").between(1, bound)).mapInArrow(scan, "key long, c long, n int, pos int")


def frequent_shingles(sets: DataFrame, rule: Rule, scratch: Scratch) -> tuple[np.ndarray, float]:
    """Shingles in very many prefixes, at most MOST_FREQUENT of them, and the mean length of a prefix shingle's list."""
    prefix = F.expr(f"n - cast(ceil({rule.num} * n / {rule.den}) as int) + 1")
    counted = sets.select(F.explode(F.slice("low", F.lit(1), prefix)).alias("key")).groupBy("key").count()
    counted = scratch.write(counted.where(F.col("count") > 1), "shared")
    rows = sets.agg(F.sum(prefix)).first()[0] or 0
    shared, reads = counted.agg(F.sum("count"), F.sum(F.col("count").cast("double") * F.col("count"))).first()
    limit = FREQUENT
    while counted.where(F.col("count") > limit).count() > MOST_FREQUENT:
        limit *= 2
    found = [r[0] for r in counted.where(F.col("count") > limit).select("key").collect()]
    scratch.drop(counted)
    return np.sort(np.array(found, dtype=np.int64)), ((reads or 0) + rows - (shared or 0)) / max(rows, 1)


def heavy_lists(docs: DataFrame, sets: DataFrame, least: int, frequent: np.ndarray, rule: Rule, words: int, scratch: Scratch) -> DataFrame:
    """(key, c, n, pos): the prefix of each set of ``least`` shingles or more, in one order for all sets.

    The order is by hash, frequent shingles last. Where the kept hashes hold too few others, the set is made again.
    """
    shared = sets.sparkSession.sparkContext.broadcast(frequent)

    def lists(column: str, whole: bool):
        def scan(batches: Iterator) -> Iterator:
            import pyarrow as pa

            often = shared.value
            for batch in batches:
                keys, docs_, sizes, places = [], [], [], []
                ids = batch.column("c").to_numpy(zero_copy_only=False)
                n = [0] * len(ids) if whole else batch.column("n").to_pylist()
                for k, grams in enumerate(_rows_of(batch.column(column))):
                    size = len(grams) if whole else n[k]
                    p = rule.prefix(size)
                    last = often[np.minimum(np.searchsorted(often, grams), len(often) - 1)] == grams if len(often) else np.zeros(len(grams), bool)
                    first = grams[~last][:p]
                    if len(first) < p:
                        if len(grams) < size:
                            keys.append(np.zeros(1, np.int64))
                            docs_.append(ids[k : k + 1])
                            sizes.append(np.array([size]))
                            places.append(np.array([-1]))
                            continue
                        first = np.concatenate((first, grams[last]))[:p]
                    keys.append(first)
                    docs_.append(np.full(len(first), ids[k]))
                    sizes.append(np.full(len(first), size))
                    places.append(np.arange(len(first)))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x), kind) for x, kind in zip((keys, docs_, sizes, places), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                        ["key", "c", "n", "pos"],
                    )

        return scan

    schema = "key long, c long, n int, pos int"
    made = scratch.write(sets.where(F.col("n") >= least).mapInArrow(lists("low", False), schema), "prefixes")
    short = scratch.write(sets.select("c", "doc_id", "f1", "f2").join(made.where("pos = -1").select("c"), "c", "left_semi"), "short")
    again = whole_sets(docs, short, words).mapInArrow(lists("grams", True), schema)
    return made.where("pos >= 0").unionAll(again)


def jaccard_components(docs: DataFrame, words: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Words are what stands between white space (space, tab to carriage return), A-Z in lower case; a text's set is its
    distinct shingles of ``words`` words, all its words if it has fewer, empty if it has none or is null. Two
    documents link when their sets' Jaccard similarity is ``similarity`` or more; empty sets link with nothing.
    component_id is the smallest doc_id reachable by links, the document's own without any. Rows that share a doc_id
    are one document, which has the links of each; rows with a null doc_id link with nothing and have no component.
    Hashes have 64 bits, fingerprints of sets 128.
    """
    rule = Rule(*similarity)
    scratch = Scratch(docs.sparkSession, "jaccard")
    table = scratch.write(shingle_table(docs, rule, words), "shingles")
    own = ["n", "f1", "f2"]
    known = table.where("n > 0 and doc_id is not null")
    # one row for each different set; c numbers them, as rows that share a doc_id may have different sets
    first = F.min_by(F.struct("low", "bits"), "doc_id").alias("x")
    classes = known.groupBy(*own).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("members"), first)
    classes = scratch.write(classes.select(F.monotonically_increasing_id().alias("c"), "doc_id", *own, "members", "x.*"), "classes")

    frequent, members = frequent_shingles(classes, rule, scratch)
    sizes = {r[0]: r[1] for r in classes.where(F.col("n") <= KEPT_WHOLE).groupBy("n").count().collect()}
    bound = light_boundary(sizes, rule, members)
    least = max(1, _ceil(rule.num * (bound + 1), rule.den))
    lists = heavy_lists(docs, classes, least, frequent, rule, words, scratch).unionAll(light_lists(classes, bound, rule))
    lists = scratch.write(lists, "lists")

    heads = lists.groupBy("key").agg(F.min("c").alias("head"), F.max("c").alias("last")).where("head < last").drop("last")
    shared = scratch.write(lists.join(heads, "key"), "shared")
    scratch.drop(lists)
    scratch.release()
    star = scratch.write(shared.where("c <> head").select(F.col("head").alias("a"), F.col("c").alias("b")).distinct(), "star")
    star = scratch.write(may_link(star, classes, rule), "star-pairs")
    links = resolve(docs, star, classes, rule, words, scratch)
    found = scratch.write(connected_components(links, scratch), "components")

    sides = shared.join(found.withColumnRenamed("id", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    sides = scratch.write(sides, "sides")
    scratch.drop(shared)
    apart = sides.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("times"))
    sides = sides.join(apart.where("c1 < c2").select("key", "times"), "key")
    sides = scratch.write(sides, "apart")
    scratch.release()
    small, large = sides.where(F.col("times") <= SHORT_LIST), sides.where(F.col("times") > SHORT_LIST)
    need = f"ceil({rule.num} * (x.n + y.n) / {rule.num + rule.den})"
    x, y = small.alias("x"), small.alias("y")
    pairs = x.join(
        y, F.expr(f"x.key = y.key and x.c < y.c and x.component <> y.component and x.n - x.pos >= {need} and y.n - y.pos >= {need}")
    )
    pairs = scratch.write(pairs.select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct(), "pairs")
    crowds = scratch.write(large.select("head", "c", "component").distinct(), "crowds")
    more = scratch.write(may_link(pairs, classes, rule), "more-pairs")
    scratch.drop(pairs)
    links = links.unionAll(resolve(docs, more, classes, rule, words, scratch))
    if not crowds.isEmpty():
        links = links.unionAll(crowd_links(docs, crowds, classes, rule, words, scratch))
    scratch.drop(crowds)

    reps = lambda x: classes.select(F.col("c").alias(x), F.col("doc_id").alias(f"doc_{x}"))
    links = links.join(reps("a"), "a").join(reps("b"), "b").select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    same = known.select("doc_id", *own).join(classes.where("members > 1").select(F.col("doc_id").alias("rep"), *own), own)
    same = same.where("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    found = connected_components(links.unionAll(same), scratch)
    scratch.drop(classes, sides)
    scratch.release()
    return (
        table.select("doc_id", F.col("n").cast("long").alias("n_shingles"))
        .join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    )


def keep_one(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """``docs`` with one document of each component: the one whose doc_id is the component.

    Of repeated rows (the same doc_id and text) one stays; rows that share a doc_id but not a text stay, as do rows
    with a null doc_id and, each for itself, empty and null texts. An empty table stays empty. Other columns pass
    through, whatever their names.
    """
    found = jaccard_components(docs, words, similarity)
    scratch = Scratch(docs.sparkSession, "keep-one")
    found = scratch.write(found, "found")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    kept = without(docs, gone)
    if again.isEmpty():
        return kept
    repeated = kept.join(again, "doc_id", "left_semi")
    return kept.join(again, "doc_id", "left_anti").unionByName(repeated.dropDuplicates(["doc_id", "text"]).select(*map(quoted, docs.columns)))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for the doc_ids in ``gone``, which are broadcast if they are up to BROADCAST_IDS."""
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))

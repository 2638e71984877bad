"""Embedding near-dedup by spherical-cap filters.

A filter is a random direction, and a vector belongs to every filter whose cap it lies in (inner product at or above the
cap's height). Heights and numbers of filters go by the number of vectors: caps keep about MEMBERS members, and a pair at
the cosine shares one but for MISS of all cases, which the geometry of caps gives exactly. A vector so stands in about
ten caps, however many vectors there are.

Into a cap goes a vector's direction in a byte per dimension, with how far the rounded direction is from it. That decides
all pairs but those next to the cosine, which are compared by the vectors themselves in double precision. Each row also
tells in which caps its vector is, so a pair counts in the first cap that both share, and a cap gives sums and a spanning
forest of its links instead of pairs: what is written grows with the vectors, not with their links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareloom.llm.common import Scratch, connected_components

COSINE, SEED = 0.9, 17
#: The share of pairs at exactly the cosine that may share no cap, members of a cap, the least share of a
#: vector's caps that a partner at the cosine must be in as well, filters at most (two bytes each).
MISS, MEMBERS, LEAST_SHARED, FILTERS = 0.007, 1000, 0.25, 60_000
#: Members of one tile at most, and their components; a cap with more is split into pairs of tiles, each a task's work of
#: bounded size.
TILE, TILE_NUMBERS = 4096, 1 << 21
#: Scores of caps, products of members and shared caps that are held at once.
HELD = 1 << 20
#: What floats may be off by.
SLACK = 1e-5


def cap_shares(dimensions: int, height: float, angle: float) -> tuple[float, float]:
    """(share of all directions within a cap of ``height``, share within two caps of which the poles are ``angle`` apart)."""
    if dimensions == 1:
        return 0.5, 0.5
    power = (dimensions - 2) / 2

    def share(least: float, width) -> float:
        # over the projection on a plane through the pole(s): its length r from 1 down to the least that reaches
        if least >= 1:
            return 0.0
        if power == 0:
            return max(0.0, float(width(np.ones(1))[0])) / (2 * np.pi)
        most = (1 - least**2) ** power
        s = (np.arange(2000) + 0.5) / 2000
        r = np.sqrt(np.maximum(0.0, 1 - (1 - least**2) * s ** (1 / power)))
        return most * float(np.maximum(0.0, width(r)).mean()) / (2 * np.pi)

    arc = lambda r: 2 * np.arccos(np.minimum(1.0, height / r))
    return share(height, arc), share(height / np.cos(angle / 2), lambda r: arc(r) - angle)


class CapCode:
    """The filters for vectors of so many ``dimensions``, of which there are about ``rows``."""

    def __init__(self, dimensions: int, rows: int = 100_000, cosine: float = COSINE, miss: float = MISS, seed: int = SEED):
        angle = float(np.arccos(min(1.0, cosine)))
        self.height, self.filters = 0.0, 1
        # the highest caps that still have members enough, and of whose number there aren't too many
        for k, height in enumerate([0.5] if dimensions == 1 else np.arange(1, 99) / 100):
            single, both = cap_shares(dimensions, float(height), angle)
            filters = np.ceil(np.log(miss) / np.log1p(-both)) if both > 0 else np.inf
            if k and (single * rows < MEMBERS or both < LEAST_SHARED * single or filters > FILTERS):
                break
            self.height, self.filters = float(height), int(filters)
        poles = np.random.default_rng(seed).standard_normal((self.filters, dimensions), dtype=np.float32)
        poles /= np.maximum(np.linalg.norm(poles, axis=1, keepdims=True), np.float32(1e-12))
        self.poles = poles.T.copy()

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the numbers of all filters whose cap it lies in, in order."""
        out, step = [], max(1, HELD // self.filters)
        for at in range(0, len(unit), step):
            part = unit[at : at + step].astype(np.float32)
            row, number = np.nonzero(part @ self.poles >= np.float32(self.height))
            out += np.split(number, np.searchsorted(row, np.arange(1, len(part))))
        return out


#: The name under which these filters were made of codes per block.
ProductCode = CapCode


def _blocks(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their numbers as a matrix) of a column of lists or bytes, by length."""
    import pyarrow as pa

    if pa.types.is_binary(column.type):
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
        values = np.frombuffer(column.buffers()[2] or b"", dtype=np.int8)
    else:
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, values[offsets[at][:, None] + np.arange(d)]


def _units(block: np.ndarray) -> np.ndarray:
    block = block.astype(np.float64)
    block /= np.abs(block).max(axis=1, keepdims=True)
    return block / np.linalg.norm(block, axis=1, keepdims=True)


def _rounded(batches: Iterator) -> Iterator:
    """Each vector's direction in a byte per dimension (q), and how far that is from it (off)."""
    import pyarrow as pa

    for batch in batches:
        off, q = np.zeros(batch.num_rows, np.float32), [b""] * batch.num_rows
        for at, block in _blocks(batch.column("v")):
            unit = _units(block)
            small = np.rint(unit / np.abs(unit).max(axis=1, keepdims=True) * 127).astype(np.int8)
            off[at] = np.linalg.norm(unit - _units(small), axis=1) + SLACK
            for k, row in zip(at.tolist(), small, strict=True):
                q[k] = row.tobytes()
        kept = [batch.column(c) for c in ("vec_id", "h1", "h2", "d")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(off), pa.array(q, pa.binary())], ["vec_id", "h1", "h2", "d", "off", "q"])


_HEAD = np.dtype([("times", "<i8"), ("off", "<f4"), ("caps", "<i4")])


def _capped(rows: int, cosine: float, code: CapCode | None):
    """Of classes (rep, times, off, q): each one's caps, and what its rows there hold in one piece of bytes: head, caps, q."""

    def caps(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codes: dict[int, CapCode] = {}
        for batch in batches:
            found: list = [None] * batch.num_rows
            for at, block in _blocks(batch.column("q")):
                d = block.shape[1]
                if d not in codes:
                    codes[d] = code or CapCode(d, rows, cosine)
                for k, own in zip(at.tolist(), codes[d].decode(_units(block)), strict=True):
                    found[k] = own.astype("<u2"), d
            head = np.zeros(batch.num_rows, _HEAD)
            head["times"], head["off"], head["caps"] = batch.column("times").to_numpy(), batch.column("off").to_numpy(), [len(f) for f, _ in found]
            held = [h.tobytes() + f.tobytes() + q for h, (f, _), q in zip(head, found, batch.column("q").to_pylist(), strict=True)]
            every = pa.array([f.astype(np.int64) + (d << 16) for f, d in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("rep"), every, pa.array(held, pa.binary())], ["vec_id", "caps", "held"])

    return caps


def _first_shared(one: np.ndarray, two: np.ndarray, number: int) -> np.ndarray:
    """Whether pairs of rows of caps (in order, -1 or less behind them) share none before ``number``."""
    out = np.ones(len(one), dtype=bool)
    step = max(1, HELD // max(1, one.shape[1] * two.shape[1]))
    for at in range(0, len(one), step):
        a, b = one[at : at + step], two[at : at + step]
        out[at : at + step] = ~((a[:, :, None] == b[:, None, :]) & (a < number)[:, :, None] & (a >= 0)[:, :, None]).any(axis=(1, 2))
    return out


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest one that it reaches over the edges."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[a], root[b])
        for end in (a, b, root[a], root[b]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


#: What a cap gives: sums (of a's linked rows: n), edges of a forest (a, b), and open pairs (a, b, rows of a: n, of b: m).
_SUM, _EDGE, _OPEN = 0, 1, 2
_FOUND = "kind int, a long, b long, n long, m long"


def _compared(cap: int, halves: bool, keys: np.ndarray, left: np.ndarray, held: list[bytes], cosine: float) -> Iterator[np.ndarray]:
    """_FOUND, as rows, of the members of one cap, or of two tiles (``halves``; ``left``: of the first) of one."""
    d, number = cap >> 16, cap & 0xFFFF
    data = np.frombuffer(b"".join(held), dtype=np.uint8)
    ends = np.cumsum([len(h) for h in held])
    begins = ends - [len(h) for h in held]
    head = data[begins[:, None] + np.arange(_HEAD.itemsize)].view(_HEAD)[:, 0]
    q = data[(ends - d)[:, None] + np.arange(d)].view(np.int8).astype(np.float32 if d <= 1000 else np.float64)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    at = np.arange(head["caps"].max())
    place = np.minimum((begins + _HEAD.itemsize)[:, None] + 2 * at, len(data) - 2)
    caps = np.where(at < head["caps"][:, None], data[place].astype(np.int32) + (data[place + 1].astype(np.int32) << 8), -1)
    off, times = head["off"], head["times"]
    one = np.flatnonzero(left) if halves else np.arange(len(keys))
    two = np.flatnonzero(~left) if halves else one
    sums, links, opened = np.zeros(len(keys)), [], []
    step = max(1, HELD // max(1, len(two)))
    for k in range(0, len(one), step):
        rows = one[k : k + step]
        product = q[rows] @ q[two].T
        product += off[rows][:, None] + off[two]
        a, b = np.nonzero(product >= cosine)
        margin = product[a, b]
        a, b = rows[a], two[b]
        kept = keys[a] != keys[b] if halves else (a < b) & (keys[a] != keys[b])
        a, b, margin = a[kept], b[kept], margin[kept]
        new = _first_shared(caps[a], caps[b], number)
        a, b, margin = a[new], b[new], margin[new]
        sure = margin - 2 * (off[a] + off[b]) >= cosine
        x, y = a[sure], b[sure]
        sums += np.bincount(x, times[y], len(keys)) + np.bincount(y, times[x], len(keys))
        root = _forest(x, y, len(keys))
        links.append(np.stack((np.flatnonzero(root != np.arange(len(keys))), root[root != np.arange(len(keys))])))
        if not sure.all():
            x, y = a[~sure], b[~sure]
            yield np.stack((np.full(len(x), _OPEN), keys[x], keys[y], times[x], times[y]))
    some = np.flatnonzero(sums)
    if len(some):
        yield np.stack((np.full(len(some), _SUM), keys[some], keys[some], sums[some].astype(np.int64), np.zeros(len(some), np.int64)))
        edges = np.concatenate(links, axis=1)
        root = _forest(edges[0], edges[1], len(keys))
        some = np.flatnonzero(root != np.arange(len(keys)))
        zero = np.zeros(len(some), np.int64)
        yield np.stack((zero + _EDGE, keys[some], keys[root[some]], zero, zero))


def _verified(cosine: float):
    """The links among open pairs (a, b, n, m, u, v), by the vectors in double precision."""

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            near = np.zeros(batch.num_rows, dtype=bool)
            for (at, u), (_, v) in zip(_blocks(batch.column("u")), _blocks(batch.column("v")), strict=True):
                near[at] = np.einsum("ij,ij->i", _units(u), _units(v)) >= cosine
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in "abnm"], list("abnm")).filter(pa.array(near))

    return verify


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, code: CapCode | None = None) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding array<float>): vec_id, n_links, component_id, kept.

    Vectors with a cosine of ``cosine`` or more link, whatever other columns say. Null or empty vectors, zero
    vectors and vectors with null, infinite or NaN components link with nothing; so do vectors of different
    dimensions. Equal vectors are one class, searched once. n_links counts other rows; component_id is the smallest
    vec_id reachable; kept marks its row. Rows with a null vec_id link with nothing, are in no component and aren't
    kept; rows that share a vec_id count each as a row. Random pairs at a cosine of exactly 0.9 share a filter in 99 of
    100 cases, in any number of dimensions, nearer ones more surely.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    ok = F.expr(
        "vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and "
        "abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"
    )
    # -0.0 equals 0.0
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    rows = vectors.select("vec_id", F.transform("embedding", lambda x: (x + F.lit(0).cast(kind)).cast(kind)).alias("v"), F.coalesce(ok, F.lit(False)).alias("ok"))
    good = rows.where("ok").select("vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), F.size("v").alias("d"))
    members = scratch.write(good.mapInArrow(_rounded, "vec_id long, h1 long, h2 long, d int, off float, q binary"), "members")
    classes = members.groupBy("h1", "h2", "d").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.min_by(F.struct("off", "q"), "vec_id").alias("x"))
    classes = scratch.write(classes.select("h1", "h2", "d", "rep", "times", "x.off", "x.q"), "classes")
    made = classes.select("rep", "times", "off", "q").mapInArrow(_capped(classes.count(), cosine, code), "vec_id long, caps array<long>, held binary")
    made = scratch.write(made, "capped")
    # the work of a cap with k members is its tiles squared; each member goes to every pair that has its tile
    hits = made.select("vec_id", "held", F.explode("caps").alias("cap"))
    tile = f"greatest(64, least({TILE}, {TILE_NUMBERS} div shiftright(cap, 16)))"
    counts = made.select(F.explode("caps").alias("cap")).groupBy("cap").agg(F.count("*").alias("k"))
    counts = counts.select("cap", F.expr(f"cast(ceil(k / {tile}) as int)").alias("tiles")).where("tiles > 1")
    tiled = hits.join(F.broadcast(counts), "cap", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("tile", F.expr("cast(pmod(xxhash64(vec_id), tiles) as int)"))
    tiled = tiled.withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    tiled = tiled.select("vec_id", "held", "cap", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))

    def compare(batches: Iterator) -> Iterator:
        import pyarrow as pa

        group, parts = None, []

        def done():
            keys, left, held = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [h for p in parts for h in p[2]]
            if len(keys) > 1:
                for out in _compared(group[0], group[1] != group[2], keys, left, held, cosine):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.int64()) for k, c in enumerate(out)], ["kind", "a", "b", "n", "m"])

        for batch in batches:
            cap, i, j, key, tile = (batch.column(c).to_numpy() for c in ("cap", "i", "j", "vec_id", "tile"))
            held = batch.column("held").to_pylist()
            turns = np.flatnonzero((np.diff(cap) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(cap)]):
                if a == b:
                    continue
                if group != (own := (int(cap[a]), int(i[a]), int(j[a]))):
                    if parts:
                        yield from done()
                    group, parts = own, []
                parts.append((key[a:b].copy(), tile[a:b] == own[1], held[a:b]))
        if parts:
            yield from done()

    dealt = tiled.repartition("cap", "i", "j").sortWithinPartitions("cap", "i", "j")
    found = scratch.write(dealt.mapInArrow(compare, _FOUND), "found")
    scratch.drop(made)
    scratch.release()
    opened = found.where(f"kind = {_OPEN}").select("a", "b", "n", "m")
    reps = good.join(classes.select(F.col("rep").alias("vec_id"), "h1", "h2"), ["vec_id", "h1", "h2"], "left_semi").select("vec_id", "v")
    pairs = opened.join(reps.select(F.col("vec_id").alias("a"), F.col("v").alias("u")), "a").join(reps.withColumnRenamed("vec_id", "b"), "b")
    pairs = pairs.where("size(u) = size(v)").select("a", "b", "n", "m", "u", "v")
    more = scratch.write(pairs.mapInArrow(_verified(cosine), "a long, b long, n long, m long").distinct(), "verified")
    sums = found.where(f"kind = {_SUM}").select("a", "n").unionAll(more.select("a", F.col("m").alias("n"))).unionAll(more.select(F.col("b").alias("a"), "n"))
    near = sums.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("near"))
    members = members.select("vec_id", "h1", "h2", "d")
    same = members.join(classes.select("h1", "h2", "d", "rep", "times"), ["h1", "h2", "d"])
    edges = found.where(f"kind = {_EDGE}").select("a", "b").unionAll(more.select("a", "b"))
    edges = edges.unionAll(same.where("rep <> vec_id").select(F.col("rep").alias("a"), F.col("vec_id").alias("b")))
    linked = connected_components(edges, scratch)
    per = same.join(near, "rep", "left").select("vec_id", (F.col("times") - 1 + F.coalesce("near", F.lit(0))).alias("own"))
    per = per.groupBy("vec_id").agg(F.sum("own").alias("n_links"))
    out = rows.select("vec_id").join(per, "vec_id", "left").join(linked.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept"),
    )

"""Whitening of embeddings by matrix-free block Lanczos.

Entries become integers (floor(SCALE * entry) + SHIFT), so the count, the sums and the deviations are exact, and a
centred entry is (n * x - S) / n with an exact numerator. The covariance is never formed: each pass over the vectors
returns X'(Xv) of the centred rows for a block v of directions, added up where the rows are; only dimensions x block
numbers reach the driver.

The driver keeps an orthonormal basis of at most ``basis`` directions and what the covariance makes of them. Each new
block is what the last pass gave, orthogonalised twice against the whole basis. Directions that vanish in this (the basis
has filled an invariant subspace) are replaced by fresh random ones. When the basis is full, it is restarted from its
best Ritz vectors, with what is orthogonal of their residuals as the next block. It ends when the residuals of all
wanted pairs are small against the largest eigenvalue, or when the basis spans all dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareloom.llm.common import bound_batches, quoted

SCALE, SHIFT = 1024, 100_000
COMPONENTS, BLOCK, BASIS, SEED = 8, 16, 256, 29
#: Residuals of converged pairs are at most this part of the largest eigenvalue; passes end at the most there.
TOLERANCE, PASSES = 1e-13, 200
#: Eigenvalues below this part of the trace count as zero: they have no component.
RANK = 1e-12
#: Numerators and their squares' sums below this are worked out in 64 bits, others in integers of any size.
SAFE = 1 << 62


@dataclass
class Totals:
    """What the first two passes find: rows, dimensions, sums by dimension, the largest integer, the sum of deviations."""

    n: int
    d: int
    sums: list[int]
    largest: int
    deviations: int = 0

    @property
    def trace(self) -> float:
        return self.deviations / self.n**3


def usable(vector: Column) -> Column:
    """Whether a vector has entries, none null, NaN or infinite, and each fits into a long once scaled."""
    bound = float(1 << 62) / SCALE
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < bound)), F.lit(False))


def _integers(column) -> np.ndarray:
    """Rows of a list column of one length, as integers."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(values * SCALE).astype(np.int64) + SHIFT).reshape(len(column), -1)


def _numerators(x: np.ndarray, t: Totals) -> np.ndarray:
    """n * x - S, exactly."""
    if t.n * t.largest < SAFE // 2:
        return x * t.n - np.array(t.sums, dtype=np.int64)
    return x.astype(object) * t.n - np.array(t.sums, dtype=object)


def _deviation(numerators: np.ndarray) -> list[int]:
    most = int(np.abs(numerators).max(initial=0))
    if most * most * numerators.shape[1] < SAFE:
        return (numerators * numerators).sum(axis=1).tolist()
    wide = numerators.astype(object)
    return (wide * wide).sum(axis=1).tolist()


def _decimal(values: list[int]):
    """Integers for a decimal(38, 0) column; any that needs more digits is an error."""
    from decimal import Decimal

    import pyarrow as pa

    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


def _totals(rows: DataFrame) -> Totals | None:
    """The first pass; None without rows. Vectors of another length than the most frequent one don't take part."""
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return None
    d = lengths["d"]

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        n, largest, sums = 0, 0, [0] * d
        for batch in batches:
            if batch.num_rows:
                x = _integers(batch.column(0))
                most = int(np.abs(x).max())
                own = x.sum(axis=0) if most * len(x) < SAFE else x.astype(object).sum(axis=0)
                n, largest, sums = n + len(x), max(largest, most), [a + int(b) for a, b in zip(sums, own)]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), _decimal(sums), pa.array([n] * d, pa.int64()), pa.array([largest] * d, pa.int64())], ["k", "s", "n", "m"]
            )

    parts = rows.where(F.size("v") == d).mapInArrow(add, "k int, s decimal(38,0), n long, m long")
    found = parts.groupBy("k").agg(F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("n").alias("n"), F.max("m").alias("m")).orderBy("k").collect()
    return Totals(found[0]["n"], d, [int(r["s"]) for r in found], max(found[0]["m"], 1))


def _deviations(rows: DataFrame, t: Totals) -> int:
    """The second pass: the sum of all rows' deviations."""

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = sum(sum(_deviation(_numerators(_integers(b.column(0)), t))) for b in batches if b.num_rows)
        # in two parts, each far below the decimal's limit
        yield pa.RecordBatch.from_arrays([_decimal([total >> 60]), _decimal([total & ((1 << 60) - 1)])], ["high", "low"])

    high, low = rows.mapInArrow(add, "high decimal(38,0), low decimal(38,0)").agg(F.sum("high"), F.sum("low")).first()
    return (int(high) << 60) + int(low)


def _centred(column, t: Totals) -> np.ndarray:
    return _numerators(_integers(column), t).astype(np.float64) / t.n


def _apply(rows: DataFrame, t: Totals, block: np.ndarray) -> np.ndarray:
    """One pass: covariance @ block, without the covariance."""
    width = block.shape[1]

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((t.d, width))
        for batch in batches:
            if batch.num_rows:
                y = _centred(batch.column(0), t)
                total += y.T @ (y @ block)
        yield pa.RecordBatch.from_arrays([pa.array(range(t.d), pa.int32()), *[pa.array(total[:, j]) for j in range(width)]], ["k", *[f"c{j}" for j in range(width)]])

    parts = rows.mapInArrow(add, ", ".join(["k int", *[f"c{j} double" for j in range(width)]]))
    found = parts.groupBy("k").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(width)]).collect()
    out = np.zeros((t.d, width))
    for r in found:
        out[r["k"]] = [r[f"c{j}"] for j in range(width)]
    return out / t.n


def _block(candidates: np.ndarray, basis: np.ndarray, width: int, random: np.random.Generator) -> np.ndarray:
    """At most ``width`` unit directions orthogonal to the basis and each other: from the candidates, and random ones for
    those that vanish."""
    d, out = len(basis), []
    width = min(width, d - basis.shape[1])
    todo = [c for c in candidates.T]
    while len(out) < width:
        v = todo.pop(0) if todo else random.standard_normal(d)
        size = np.linalg.norm(v)
        if not size > 0:
            continue
        v = v / size
        own = np.column_stack([basis, *out]) if out else basis
        for _ in range(2):
            v = v - own @ (own.T @ v)
        left = np.linalg.norm(v)
        # what is left of a direction that lies in the basis is rounding
        if left < 1e-10:
            continue
        v = v / left
        v = v - own @ (own.T @ v)
        out.append(v / np.linalg.norm(v))
    return np.column_stack(out) if out else np.zeros((d, 0))


def leading_pairs(apply, d: int, wanted: int, block: int = BLOCK, basis: int = BASIS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues falling, unit eigenvectors as columns, passes) of the symmetric positive matrix that ``apply`` gives
    for a block of directions."""
    random = np.random.default_rng(seed)
    wanted, block = min(wanted, d), min(max(block, wanted), d)
    basis = min(d, max(basis, 4 * block))
    q, image = np.zeros((d, 0)), np.zeros((d, 0))
    step = _block(random.standard_normal((d, block)), q, block, random)
    for passes in range(1, PASSES + 1):
        made = apply(step)
        q, image = np.hstack([q, step]), np.hstack([image, made])
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, mapped = q @ turn, image @ turn
        rest = mapped - vectors * values
        size = np.linalg.norm(rest[:, :wanted], axis=0)
        if q.shape[1] == d or passes == PASSES or (q.shape[1] >= wanted and size.max() <= TOLERANCE * max(values[0], 0)):
            break
        fresh = made - q @ (q.T @ made)
        if basis < d and q.shape[1] + block > basis:
            # the residuals of all Ritz vectors lie in what the last pass gave
            keep = max(wanted, basis // 2)
            q, image = vectors[:, :keep], mapped[:, :keep]
        step = _block(fresh, q, block, random)
    vectors = vectors[:, :wanted] / np.linalg.norm(vectors[:, :wanted], axis=0)
    return values[:wanted], vectors, passes


def whiten(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", column: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Per usable row of ``vectors`` and component (from 1, by falling eigenvalue): ``key``, component int, n long,
    deviation decimal(38,0), whitened double, explained double, identity_error double.

    Left out are rows whose vector is null, empty, or has an entry that is null, NaN, infinite or beyond 2**62 once
    scaled, and vectors of another length than the most frequent one (of equally frequent ones the shortest). Every other
    row counts by itself, whether its vector or its key is repeated or its key is null. Components are as many as
    ``components``, the dimensions and the vectors' rank allow: vectors that are all the same, a single one or an empty
    table give no rows. Equal eigenvalues have any orthonormal vectors of their space, the same for all rows. Other
    columns aren't read. ``vectors`` is read once per pass (its sums, its deviations, blocks of directions, a last one
    that measures the result): give a stored table.
    """
    bound_batches(vectors.sparkSession)
    own = quoted(column)
    rows = vectors.where(usable(own)).select(quoted(key).alias("key"), own.cast("array<double>").alias("v"))
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"`{key.replace('`', '``')}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    t = _totals(rows.select("v"))
    if t is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("v") == t.d)
    values = rows.select("v")
    t.deviations = _deviations(values, t)
    if not t.deviations:
        return vectors.sparkSession.createDataFrame([], schema)
    e, u, _ = leading_pairs(lambda b: _apply(values, t, b), t.d, components, block)
    k = int((e > RANK * t.trace).sum())
    e, u = e[:k], u[:, :k]
    scaled = u / np.sqrt(e)
    # covariance of the whitened rows: their means are zero, as the rows are centred exactly
    error = float(np.abs(scaled.T @ _apply(values, t, scaled) - np.eye(k)).max())
    explained = e / t.trace

    def project(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            numerators = _numerators(_integers(batch.column("v")), t)
            white = (numerators.astype(np.float64) / t.n) @ scaled
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, t.n)),
                    _decimal(_deviation(numerators)).take(each), pa.array(white.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)

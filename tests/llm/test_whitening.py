import numpy as np
import pandas as pd
import pytest

from wareloom.llm import whitening
from wareloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def exact(vectors):
    """(x, deviations, covariance) with integers of any size."""
    x = np.floor(np.array(vectors, dtype=np.float64) * 1024).astype(np.int64).astype(object) + 100_000
    n = len(x)
    centred = x * n - x.sum(axis=0)
    y = (centred / n).astype(np.float64)
    return (centred**2).sum(axis=1), y, y.T @ y / n


def check(rows, keys, vectors, k):
    deviations, y, v = exact(vectors)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    got = pd.DataFrame([r.asDict() for r in rows])
    assert len(got) == len(keys) * k and set(got.n) == {len(keys)}
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[keys].to_numpy()
    want = y @ u / np.sqrt(e)
    table = table * np.sign((table * want).sum(axis=0))
    assert np.abs(table - want).max() < 1e-7
    assert np.allclose(got.groupby("component").explained.first(), e / np.trace(v), rtol=1e-9)
    assert dict(zip(keys, deviations, strict=True)) == {a: int(b) for a, b in got.groupby("vec_id").deviation.first().items()}
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    assert np.abs(table.T @ table / len(keys) - np.eye(k)).max() < 1e-7


def test_op11(spark):
    frame = pd.read_parquet(f"{SF}/embeddings.parquet")
    check(QUERIES["op11_embedding_whitening"](spark, SF).collect(), frame.vec_id.tolist(), frame.embedding.tolist(), 8)


def test_lanczos_against_whole_decompositions():
    r = np.random.default_rng(2)
    for d, rank, block, basis in ((1, 1, 16, 64), (5, 5, 16, 64), (40, 3, 4, 64), (120, 120, 8, 40), (200, 200, 8, 48), (90, 20, 8, 32)):
        values = np.zeros(d)
        values[:rank] = np.sort(r.random(rank))[::-1] * 10
        values[: rank // 3] = values[0]  # many equal ones
        q = np.linalg.qr(r.standard_normal((d, d)))[0]
        matrix = (q * values) @ q.T
        e, u, passes = whitening.leading_pairs(lambda b, m=matrix: m @ b, d, 8, block, basis)
        k = min(8, d)
        assert np.allclose(e, values[:k], atol=1e-11) and passes < 150
        assert np.abs(u.T @ u - np.eye(k)).max() < 1e-12 and np.abs(matrix @ u - u * e).max() < 1e-10


def test_vectors_of_any_kind(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((60, 6)) * [9, 5, 3, 2, 1, 0]
    rows = [(k, v.tolist(), "e") for k, v in enumerate(base)] + [(3000 + k, base[7].tolist(), None) for k in range(20)]
    odd = [(90, None, ""), (91, [], ""), (92, [1.0, None, 1, 1, 1, 1], ""), (93, [float("nan")] * 6, ""), (94, [float("inf")] + [0.0] * 5, ""), (95, [1.0, 2.0], ""), (96, [1e300] * 6, "")]
    odd = [(k, None if v is None else [None if x is None else float(x) for x in v], e) for k, v, e in odd]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, explained string").repartition(4)
    # the last dimension never varies, so there are five components
    check(whitening.whiten(frame).collect(), [x[0] for x in rows], [x[1] for x in rows], 5)
    check(whitening.whiten(frame, components=2, block=3).collect(), [x[0] for x in rows], [x[1] for x in rows], 2)
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for few in (frame.limit(0), frame.where("vec_id = 1"), frame.where("vec_id >= 3000"), frame.where("vec_id between 90 and 94")):
        none = whitening.whiten(few)
        assert none.columns == columns and none.count() == 0


@pytest.mark.parametrize("large", [1e3, 1e12])
def test_numbers_beyond_64_bits(spark, large):
    r = np.random.default_rng(6)
    vectors = r.standard_normal((40, 3)) * large
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    check(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), [x[0] for x in rows], [x[1] for x in rows], 3)

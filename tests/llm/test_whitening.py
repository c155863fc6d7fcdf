import numpy as np
import pytest

from cadenza.llm import whitening
from cadenza.llm.queries import QUERIES


def brute(x, k):
    """Plain numpy: (n, S, values, vectors, trace) of the distinct rows."""
    fit = np.unique(x, axis=0)
    v = np.cov(fit.T, bias=True).reshape(x.shape[1], x.shape[1])
    values, vectors = np.linalg.eigh(v)
    return len(fit), fit.sum(0), values[::-1][:k], vectors[:, ::-1][:, :k], np.trace(v)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64])
def test_eigenvectors(n):
    rng = np.random.default_rng(n)
    b = rng.normal(size=(n, n))
    a = b @ b.T
    values, vectors = whitening.leading(a, 4)
    want = np.linalg.eigvalsh(a)[::-1][:4]
    assert np.allclose(values, want, rtol=1e-11, atol=1e-12 * want[0])
    assert np.allclose(a @ vectors, vectors * values, atol=1e-10 * want[0])
    assert np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-10)


@pytest.mark.parametrize("values", [[5, 5, 5, 1, 1], [3, 3, 3, 3, 3], [7, 7 - 1e-9, 2, 2, 0], [1e12, 1, 1, 1e-3, 0],
                                    [0, 0, 0, 0, 0], [2, 0, 0, 0, 0]])
def test_equal_eigenvalues(values):
    q, _ = np.linalg.qr(np.random.default_rng(5).normal(size=(5, 5)))
    for a in (q @ np.diag(values) @ q.T, np.diag(values).astype(float)):
        a = (a + a.T) / 2
        got, vectors = whitening.leading(a, 4)
        top = max(values) or 1
        assert np.allclose(got, values[:4], rtol=1e-9, atol=1e-9 * top)
        assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-8)
        assert np.allclose(a @ vectors, vectors * got, atol=1e-8 * top)


def test_sturm_counts():
    d, e = np.array([2.0, -1, 0, 4, 1]), np.array([1.0, 0, 0.5, 2])
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    for x in np.linspace(-4, 7, 45):
        assert whitening.count_below(d, e ** 2, x, 1e-18) == (values < x).sum()


def check(rows, ids, x, k=4):
    n, s, values, vectors, trace = brute(x, k)
    k = int((values > 1e-12 * trace).sum())
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == set(ids) and len(rows) == k * len(ids)
    signs = None
    for i, v in zip(ids, x):
        for c in range(k):
            want = (v - s / n) @ vectors[:, c] / np.sqrt(values[c])
            got = [r for r in by[i] if r.component == c + 1]
            for r in got:
                assert r.n == n and abs(r.explained - values[c] / trace) <= 1e-10 and r.identity_error <= 1e-6
                if (ids.count(i)) == 1:
                    assert r.deviation == sum(int(n * a - b) ** 2 for a, b in zip(v, s))
                    signs = signs or {}
                    sign = signs.setdefault(c, 1 if (r.whitened > 0) == (want > 0) else -1)
                    assert abs(sign * r.whitened - want) < 1e-6


def test_query(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()
    x = np.floor(256 * np.array([r.embedding for r in rows], np.float32).astype(float)) + 0
    check(QUERIES["op13_whitening"](spark, sf_small).collect(), [r.vec_id for r in rows], x)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25]), (1, [0.5, -0.25]), (2, [1.0, 2.0]), (3, [0.0, 1.5]), (4, None), (5, [None, 1.0]),
            (6, [nan, 0.0]), (7, [inf, 0.0]), (8, [-0.0, 1.5]), (None, [3.0, 1.0]), (9, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "2 AS n", "3 AS id")
    got = whitening.whiten(df).collect()
    kept = [(i, v) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    x = np.floor(256 * np.array([v + [0.0] * (2 - len(v)) for _, v in kept])) + 0
    assert {r.n for r in got} == {len(np.unique(x, axis=0))} == {5}
    check(got, [i for i, _ in kept], x)
    assert whitening.whiten(df.limit(0)).count() == 0
    one = whitening.whiten(df.filter("vec_id = 1"))
    assert one.count() == 0 and one.columns == whitening.whiten(df).columns
    none = spark.createDataFrame([(1, []), (2, None)], "vec_id long, embedding array<float>")
    assert whitening.whiten(none).count() == 0


def test_wide_numbers_stay_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-2 ** 20, 2 ** 20, (300, 3))
    df = spark.createDataFrame([(i, (r / 256).tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    check(whitening.whiten(df, 2).collect(), list(range(300)), x.astype(float), 2)

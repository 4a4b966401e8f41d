import math

import numpy as np
import pytest

from netloom.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, k=4):
    """x, deviations and whitened values (up to sign) through numpy's own eigenvectors."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), float)
    n, s = len(fit), fit.sum(0)
    y = fit - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, x in kept:
        dev = sum((n * v - int(t)) ** 2 for v, t in zip(x, s))
        out.setdefault(i, []).append((n, dev, (np.array(x) - s / n) @ vectors / np.sqrt(values), values / np.trace(y.T @ y / n)))
    return out


def check(got, want, k):
    assert len(got) == k * sum(map(len, want.values()))
    sign = {}
    for r in got:
        n, dev, w, share = want[r.vec_id][0]
        assert (r.n, r.deviation) == (n, dev)
        w = w[r.component - 1]
        if r.component not in sign and abs(w) > 1e-6:
            sign[r.component] = math.copysign(1, w * r.whitened)
        assert r.whitened * sign.get(r.component, 1) == pytest.approx(w, rel=1e-7, abs=1e-9)
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
        assert r.identity_error < 1e-9


def test_equals_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((150, 12)) * np.linspace(3, 0.2, 12)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000 + i, v[0].tolist()) for i in range(100)]  # many copies count once
    rows += [(2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2003, [1.0] * 11 + [float("inf")]), (2004, [])]
    data = spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA).withColumnRenamed("label", "x").repartition(40)
    check(whitening.whiten(data).collect(), plain(rows[:250]), 4)


def test_few_dimensions_copies_null_ids_and_empty(spark):
    rows = [(None, [0.5, 1.0]), (None, [0.25, 3.0]), (3, [0.1, -2.0]), (3, [0.1, -2.0])]
    got = whitening.whiten(spark.createDataFrame([(i, x, 0) for i, x in rows], SCHEMA)).collect()
    assert len(got) == 8 and {r.n for r in got} == {3}
    one = spark.createDataFrame([(1, [0.5, 1.0], 0), (2, [0.5, 1.0], 0)], SCHEMA)
    assert whitening.whiten(one).collect() == [] == whitening.whiten(one.limit(0)).collect()


@pytest.mark.parametrize("seed", range(6))
def test_eigenvectors(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 40))
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = np.sort(rng.choice([1.0, 2.0, 2.0, 5.0, 5.0 + 1e-9, 1e-5], d) if seed % 2 else rng.random(d))[::-1]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    e, v = whitening.principal(a, 4)
    assert np.allclose(e, values[:4], rtol=1e-12, atol=1e-13)
    assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-12
    assert np.abs(a @ v - v * e).max() < 1e-12 * max(1, np.abs(a).max()) * 10


def test_diagonal_and_zero_matrices():
    e, v = whitening.principal(np.diag([3.0, 1.0, 2.0]), 4)
    assert np.allclose(e, [3, 2, 1]) and np.allclose(np.abs(v), [[1, 0, 0], [0, 0, 1], [0, 1, 0]])
    assert np.allclose(whitening.principal(np.zeros((3, 3)), 4)[0], 0)


def test_large_deviations_are_exact():
    rows, n, sums = [[1 << 14, -5], [3, 7], [1 << 45, 0]], 10 ** 4, (17, 4)
    exact = [sum((n * a - b) ** 2 for a, b in zip(r, sums)) for r in rows]
    assert exact[2] >= 1 << 63
    assert whitening.deviations(np.array(rows), n, np.array(sums)) == [*exact[:2], None]

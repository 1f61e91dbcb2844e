"""op12 against numpy's eigenvectors and exact integers."""

import math
import random

import numpy as np
import pytest

from oxbow.llm import queries, whitening
from oxbow.llm.common import load

SCHEMA = "vec_id long, embedding array<double>, x string, dim int"


def plain(rows, components=16):
    """{(vec_id, component): ...} of rows of one length, whitened by numpy over exact centring."""
    kept = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    each = sorted({tuple(x) for _, x in kept})
    n, dim = len(each), len(each[0])
    sums = [sum(x[i] for x in each) for i in range(dim)]
    centre = lambda x: [(n * a - s) / n for a, s in zip(x, sums)]
    c = np.array([centre(x) for x in each])
    cov = c.T @ c / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:components], vectors[:, ::-1].T[:components]
    out = []
    for i, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for k, (e, u) in enumerate(zip(values, vectors)):
            out.append((i, k + 1, n, deviation, float(np.dot(centre(x), u) / math.sqrt(e)), e / np.trace(cov)))
    return out


def same(found, expected):
    assert len(found) == len(expected)
    signs = {}
    for f, e in zip(sorted(found, key=lambda r: r[:4]), sorted(expected, key=lambda r: r[:4])):
        assert tuple(f[:4]) == e[:4]
        assert f[5] == pytest.approx(e[5], rel=1e-6)
        assert f[6] <= 1e-6
        if abs(e[4]) > 1e-3:
            assert abs(f[4]) == pytest.approx(abs(e[4]), rel=1e-5, abs=1e-6)
            assert signs.setdefault(f[1], f[4] * e[4] > 0) == (f[4] * e[4] > 0)


def test_like_numpy(spark):
    rng = random.Random(4)
    scale = [3.0, 2.0, 1.5, 1.1, 0.6]
    rows = [(i, [rng.gauss(0.3, s) for s in scale]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(1000, 1300)]  # one vector in almost half of all rows
    rows += [(None, rows[9][1]), (5, rows[5][1]), (2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0]), (2002, [math.nan, 0.0, 0.0, 0.0, 0.0]), (2003, [math.inf, 0.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], SCHEMA).repartition(6)
    found = [tuple(r) for r in whitening.whiten(table).collect()]
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    same([key(r) for r in found], [key(r) for r in plain(rows)])


def test_jacobi_is_accurate_for_small_eigenvalues():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 33):
        m = rng.normal(size=(d, 3 * d))
        m = m @ m.T
        scaled = m * np.outer(10.0 ** -np.arange(d).clip(0, 12), 10.0 ** -np.arange(d).clip(0, 12))
        values, vectors = whitening.jacobi(scaled)
        assert (np.diff(values) <= 0).all()
        assert np.allclose(vectors @ vectors.T, np.eye(d), atol=1e-12)
        assert np.allclose(vectors @ scaled @ vectors.T, np.diag(values), atol=1e-13 * values[0])
        # Graded positive definite matrices: the determinant needs every eigenvalue right relative to itself.
        sign, log = np.linalg.slogdet(m)
        assert np.log(values).sum() == pytest.approx(log - 2 * math.log(10) * np.arange(d).clip(0, 12).sum(), abs=1e-6)


def test_odd_tables(spark):
    def run(rows):
        return sorted(map(tuple, whitening.whiten(spark.createDataFrame([(i, v, "", 1) for i, v in rows], SCHEMA)).collect()))

    assert run([]) == [] and run([(1, None), (2, [])]) == []
    assert run([(1, [2.0, 3.0])]) == [(1, 1, 1, 0, 0.0, 0.0, 0.0), (1, 2, 1, 0, 0.0, 0.0, 0.0)]
    flat = run([(1, [0.0, 5.0]), (2, [1.0, 5.0])])  # the second component has no variance
    assert [(r[0], r[1], r[2], r[3], abs(r[4]), r[5]) for r in flat] == [(1, 1, 2, 4096, 1.0, 1.0), (1, 2, 2, 4096, 0.0, 0.0), (2, 1, 2, 4096, 1.0, 1.0), (2, 2, 2, 4096, 0.0, 0.0)]
    mixed = run([(1, [0.0]), (2, [1.0]), (3, [0.0, 1.0]), (4, [2.0, 1.0])])  # lengths are fitted apart
    assert [(r[0], r[1], r[2]) for r in mixed] == [(1, 1, 2), (2, 1, 2), (3, 1, 2), (3, 2, 2), (4, 1, 2), (4, 2, 2)]
    huge = run([(1, [1e300]), (2, [-1e300]), (3, [0.0])])
    assert [r[3] for r in huge] == [None, None, 0] and all(math.isfinite(r[4]) for r in huge)


def test_deviation_is_exact_for_large_sums():
    own = whitening.Fit(3_000_000, [3_000_000 * 1_000_000 + 17], np.ones(1), np.ones((1, 1)), 1.0)
    x = np.array([[1_000_900], [1_000_000], [1_002_000_000]])
    assert own.deviation(x) == [v if v < 2**63 else None for v in ((3_000_000 * int(a) - own.sums[0]) ** 2 for a in x[:, 0])]


def test_query_like_numpy(spark, data):
    rows = [(r.vec_id, r.embedding) for r in load(spark, data, "embeddings").collect()]
    same([tuple(r) for r in queries.op12_whitening(spark, data).collect()], plain(rows))

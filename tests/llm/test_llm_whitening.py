"""Whitening against exact fractions and numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from lectern.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, x string, component string"


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "n", "x", "c") for i, v in rows], SCHEMA.replace("float", kind))


def sample(n, d, seed=0, scale=None):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) * (scale if scale is not None else np.linspace(0.5, 0.1, d))).astype(np.float32)


def by_row(rows):
    out = {}
    for r in rows:
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def test_polynomial_equals_fractions(spark):
    r = np.random.default_rng(3)
    a = r.integers(-50, 50, (7, 5))
    m = (a.T @ a).tolist()
    got = whitening.characteristic(spark, m)
    # Faddeev-LeVerrier in fractions
    d, c, b = len(m), [Fraction(1)], [[Fraction(int(i == j)) for j in range(5)] for i in range(5)]
    for k in range(1, d + 1):
        ab = [[sum(m[i][t] * b[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        c.append(-sum(ab[i][i] for i in range(d)) / k)
        b = [[ab[i][j] + (c[-1] if i == j else 0) for j in range(d)] for i in range(d)]
    assert got == [int(x) for x in reversed(c)]


@pytest.mark.parametrize("m", [[[0, 1, 0], [0, 0, 1], [5, 0, 0]], [[2, 0, 0], [0, 2, 0], [0, 0, 3]], [[4]], [[1, 2], [3, 4]]])
def test_polynomial_mod_small(m):
    p = 2_147_483_647
    x = 12345
    d = len(m)
    a = [[Fraction((x if i == j else 0) - m[i][j]) for j in range(d)] for i in range(d)]
    det = Fraction(1)
    for j in range(d):
        i = next((i for i in range(j, d) if a[i][j]), None)
        if i is None:
            det = Fraction(0)
            break
        if i != j:
            a[i], a[j], det = a[j], a[i], -det
        det *= a[j][j]
        for i in range(j + 1, d):
            f = a[i][j] / a[j][j]
            a[i] = [u - f * v for u, v in zip(a[i], a[j])]
    got = whitening.polynomial_mod(np.array(m, np.int64), p)
    assert sum(int(c) * pow(x, k, p) for k, c in enumerate(got)) % p == int(det) % p


def test_roots_counted_and_refined():
    # (x - 9)^2 (x - 5) x (x^2 - 3x + 1): roots 9, 9, 5, 2.618..., 0.381..., 0
    c = np.poly1d([1.0])
    for f in ([1, -9], [1, -9], [1, -5], [1, 0], [1, -3, 1]):
        c = c * np.poly1d(f)
    c = [int(v) for v in reversed(c.coeffs)]
    assert [whitening.roots_above(c, a) for a in (-1, 0, 2, 4, 5, 8, 9)] == [6, 5, 4, 3, 2, 2, 0]
    got = [Fraction(r, 1 << s) for r, s in whitening.largest_roots(c, 10)]
    want = [9, 9, 5, (3 + math.sqrt(5)) / 2, (3 - math.sqrt(5)) / 2]
    assert [float(v) for v in got] == pytest.approx(want, rel=1e-15)
    assert abs(got[0] - 9) < Fraction(1, 1 << 150) and got[0] == got[1]


def test_against_numpy(spark):
    v = sample(300, 12)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900 + i, v[i].tolist()) for i in range(40)]
    got = by_row(whitening.op12_whitening(vectors(spark, rows).repartition(6)).collect())
    x = np.floor(256 * np.array([r[1] for r in rows], np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    cov = (fit - fit.mean(axis=0)).T @ (fit - fit.mean(axis=0)) / n
    e, u = np.linalg.eigh(cov)
    assert len(got) == len(rows)
    for k, (i, _) in enumerate(rows):
        own = got[i]
        assert sorted(own) == [1, 2, 3, 4]
        for c in own:
            r = own[c]
            assert r.n == n and r.deviation == int(((n * x[k] - s) ** 2).sum())
            w = (x[k] - fit.mean(axis=0)) @ u[:, -c] / math.sqrt(e[-c])
            assert abs(abs(r.whitened) - abs(w)) < 1e-9
            assert r.explained == pytest.approx(e[-c] / np.trace(cov), rel=1e-10) and r.identity_error < 1e-9
    for c in (1, 2, 3, 4):  # the same sign in all rows
        signs = {np.sign(got[i][c].whitened * ((x[k] - fit.mean(axis=0)) @ u[:, -c])) for k, (i, _) in enumerate(rows)}
        assert len(signs) == 1


def test_equal_eigenvalues_give_orthonormal_components(spark):
    # the corners of a cube: covariance is a multiple of the identity
    rows = [(i, [float(i >> k & 1) for k in range(5)]) for i in range(32)]
    got = whitening.op12_whitening(vectors(spark, rows)).collect()
    assert len(got) == 32 * 4 and got[0].identity_error < 1e-9
    assert {round(r.explained, 12) for r in got} == {0.2}


def test_close_eigenvalues(spark):
    scale = np.array([1.0, 1.0, 1.0, 1.0, 0.5])
    rows = [(i, x.tolist()) for i, x in enumerate(sample(400, 5, 4, scale))]
    assert whitening.op12_whitening(vectors(spark, rows)).first().identity_error < 1e-9


def test_odd_rows(spark):
    v = [x.tolist() for x in sample(30, 6)]
    nan, inf = float("nan"), float("inf")
    rows = [(i, x) for i, x in enumerate(v)] + [(None, v[0]), (100, None), (101, [*v[1][:5], None]), (102, [*v[1][:5], nan]), (103, [inf, *v[1][:5]]),
                                                (104, []), (5, v[5]), (106, v[2][:3]), (107, [-0.0] * 6)]
    got = whitening.op12_whitening(vectors(spark, rows)).collect()
    assert len(got) == 4 * 35 and {r.vec_id for r in got} == {*range(30), None, 104, 106, 107}
    assert {r.n for r in got} == {32}  # the empty vector and the zero vector are one
    zero = by_row(got)
    assert [zero[104][c].whitened for c in (1, 2, 3, 4)] == pytest.approx([zero[107][c].whitened for c in (1, 2, 3, 4)])


def test_huge_entries_stay_exact(spark):
    rows = [(i, [float(x) * 2.0**40 for x in v]) for i, v in enumerate([[1, 2], [3, 5], [-7, 1], [2, 2]])] + [(9, [1e300, 0.0])]
    assert whitening.op12_whitening(vectors(spark, rows[:4], "double")).first().identity_error < 1e-9
    n, s, m = whitening.scatter(whitening.grid_vectors(vectors(spark, rows[:4], "double")))
    x = [[int(256 * c) for c in v] for _, v in rows[:4]]
    assert n == 4 and s == [sum(c) for c in zip(*x)] and m[0][1] == 4 * sum(a * b for a, b in x) - s[0] * s[1]
    got = whitening.op12_whitening(vectors(spark, rows, "double")).collect()
    assert all(r.deviation is None for r in got) and len(got) == 10


def test_nothing_to_whiten(spark):
    assert whitening.op12_whitening(vectors(spark, [])).count() == 0
    assert whitening.op12_whitening(vectors(spark, [(1, None)])).count() == 0
    assert whitening.op12_whitening(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    got = whitening.op12_whitening(vectors(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0])])).collect()
    assert [r.component for r in got] == [1, 1] and sorted(r.whitened for r in got) == pytest.approx([-1, 1])

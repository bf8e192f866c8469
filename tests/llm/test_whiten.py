import math
from fractions import Fraction

import numpy as np
import pytest

from gradeframe.llm import whiten

SCHEMA = "vec_id long, embedding array<float>"


def ints(vector):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector]


def made(n=150, dims=9, seed=4):
    rng = np.random.default_rng(seed)
    data = rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims)) * 0.5 + rng.normal(size=dims) * 3
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(data.astype(np.float32))]
    bad = [(900, None), (901, rows[0][1][:-1] + [float("nan")]), (902, rows[0][1][:-1] + [float("inf")]), (903, rows[0][1][:-1] + [None]),
           (904, []), (905, rows[0][1][:-1])]
    return rows + bad, rows + [rows[3], rows[3], (None, rows[5][1])]


def test_whole_operator_against_exact_arithmetic(table):
    every, good = made()
    got = whiten.whitened_components(table(every + good[-3:], SCHEMA, extra=("x", "component", "n"))).collect()
    xs = [(i, ints(v)) for i, v in good]
    n, dims = len(xs), len(xs[0][1])
    sums = [sum(x[k] for _, x in xs) for k in range(dims)]
    cov = np.array([[float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for _, x in xs), n ** 3)) for j in range(dims)] for i in range(dims)])
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1], vector[:, ::-1]
    assert len(got) == n * dims and {r.n for r in got} == {n}
    want_dev = sorted((repr(i), sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in xs)
    assert sorted((repr(r.vec_id), r.deviation) for r in got if r.component == 1) == want_dev
    for c in range(dims):
        mine = {r.vec_id: r.whitened for r in got if r.component == c + 1}
        theirs = {i: sum((a - s / n) * v for a, s, v in zip(x, sums, vector[:, c])) / math.sqrt(value[c]) for i, x in xs}
        sign = 1 if mine[0] * theirs[0] > 0 else -1
        assert all(mine[i] * sign == pytest.approx(theirs[i], abs=1e-9) for i in theirs)
    assert next(r.explained for r in got if r.component == 2) == pytest.approx(value[1] / value.sum(), rel=1e-12)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


@pytest.mark.parametrize("values", [
    [5, 4, 3, 2, 1, 0.5], [5, 5, 5, 1, 1, 1], [3, 3 + 1e-9, 3 + 2e-9, 1, 1 + 1e-11, 0.2], [1, 1e-3, 1e-6, 1e-9, 1e-12, 0], [2, 2 - 1e-6, 2 - 3e-6, 2 - 1e-5, 1, 1],
])
def test_refinement_reaches_double_precision(values):
    """Distinct, equal and nearly equal eigenvalues: residuals and orthogonality to a few units of double precision."""
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(6, 6)))[0].astype(np.longdouble)
    q = q @ (np.eye(6) * 3 - q.T @ q) / 2
    a = ((q * np.array(values, np.longdouble)) @ q.T)
    a = ((a + a.T) / 2).astype(np.float64)
    value, x = whiten.refine(a, np.linalg.eigh(a.astype(np.float32))[1])
    exact = np.sort(np.array(values))
    assert np.abs(value - exact).max() < 3e-15 * max(values)
    assert np.abs(x.T @ x - np.eye(6)).max() < 1e-15
    assert np.abs(a.astype(np.longdouble) @ x - x * value).max() < 1e-15 * max(values)
    # where the gap allows it, each vector is right to double precision as well
    lo, vectors = np.argsort(values, kind="stable"), q
    for place, k in enumerate(lo):
        gap = min(abs(values[k] - v) for j, v in enumerate(values) if j != k)
        if gap > 1e-2:
            assert abs(abs(float(x[:, place] @ vectors[:, k])) - 1) < 1e-14


def test_products_of_large_integers_are_exact():
    rng = np.random.default_rng(2)
    for top in (3, 2 ** 20, 2 ** 31, 2 ** 50):
        d = rng.integers(-top, top, (700, 3))
        want = [[sum(int(a) * int(b) for a, b in zip(d[:, i], d[:, j])) for j in range(3)] for i in range(3)]
        assert whiten.exact_gram(d).tolist() == want


def test_defined_results_for_odd_tables(table):
    assert whiten.whitened_components(table([], SCHEMA)).count() == 0
    assert whiten.whitened_components(table([(1, None), (2, [])], SCHEMA)).count() == 0
    assert whiten.whitened_components(table([(1, [1.0, 2.0])], SCHEMA)).count() == 0
    assert whiten.whitened_components(table([(i, [1.0, 2.0]) for i in range(5)], SCHEMA)).count() == 0
    line = whiten.whitened_components(table([(i, [float(i), 2.0 * i, 1.0]) for i in range(6)], SCHEMA)).collect()      # rank one
    assert {r.component for r in line} == {1} and len(line) == 6 and line[0].explained == pytest.approx(1) and line[0].identity_error < 1e-12
    text = whiten.whitened_components(table([(f"v{i}", [float(i), float(i * i)]) for i in range(6)], "vec_id string, embedding array<double>"))
    assert dict(text.dtypes)["vec_id"] == "string" and text.count() == 12


def test_more_components_than_asked_for(table):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(np.random.default_rng(3).normal(size=(80, 40)))]
    got = whiten.whitened_components(table(rows, SCHEMA)).groupBy("component").count().collect()
    assert sorted(r["component"] for r in got) == list(range(1, 33)) and {r["count"] for r in got} == {80}


def test_deviation_beyond_64_bits_is_an_error(table):
    with pytest.raises(Exception):
        whiten.whitened_components(table([(i, [i * 1e12, 1.0]) for i in range(5)], "vec_id long, embedding array<double>")).collect()

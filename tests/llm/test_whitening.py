import math
from fractions import Fraction

import numpy as np
import pytest
from framewise.llm import whitening as W
from pyspark.sql import functions as F


def _whole(vectors):
    return [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]


def _exact_covariance(x):
    n = len(x)
    mean = [Fraction(sum(c), n) for c in zip(*x, strict=True)]
    return [[sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in x) / n for j in range(len(mean))] for i in range(len(mean))]


def test_sums_of_outer_products_are_exact_to_both_parts():
    rng = np.random.default_rng(3)
    x = np.floor(rng.standard_normal((300, 5)) * [1, 64, 1e5, 1e9, 1]) + W.SHIFT
    sums = [Fraction(int(s)) for s in x.sum(0)]
    pair = W.divided(W.outer_sum(W.centred(x, W.as_pair([s / 300 for s in sums]))), 300)
    expect = _exact_covariance([[int(v) for v in r] for r in x])
    scale = [math.sqrt(expect[i][i]) for i in range(5)]
    for i in range(5):
        for j in range(5):
            found = Fraction(float(pair[0][i, j])) + Fraction(float(pair[1][i, j]))
            assert abs(found - expect[i][j]) < 1e-20 * scale[i] * scale[j]


def test_merging_keeps_what_plain_sums_lose():
    total = (np.zeros(1), np.zeros(1))
    for v in (1e16, 1.0, 1e-8, -1e16):
        total = W.added(total, (np.array([v]), np.zeros(1)))
    assert total[0][0] + total[1][0] == 1.0 + 1e-8


def test_eigenvectors_to_double_precision():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    values = np.sort(np.concatenate(([1e4, 1.0, 1.0 + 1e-7], rng.random(37))))[::-1]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, vectors = W.eigen((a, np.zeros_like(a)))
    assert np.all(np.diff(found) <= 0)
    assert np.abs(vectors.T @ vectors - np.eye(40)).max() < 2e-14
    wide = a.astype(np.longdouble) @ vectors - vectors * found
    assert np.abs(wide).max() < 1e-15 * 1e4


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, whitened double").repartition(3)


def _run(df):
    model = W.fit(df)
    return model, W.whitened(df, model, W.identity_error(df, model))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((500, 6)) * [3, 2, 1, 0.7, 0.4, 0.2] @ np.linalg.qr(rng.standard_normal((6, 6)))[0]).astype(np.float32).tolist()
    odd = [(900, None), (901, []), (902, [1.0] * 5 + [None]), (903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (905, [1.0] * 5), (906, [2.0**41] + [0.0] * 5)]
    rows = [*enumerate(vectors), (3, vectors[7]), (None, vectors[8]), *odd]
    kept = [(i, v) for i, v in rows if i is None or i < 900]
    x = _whole([v for _, v in kept])
    exact = _exact_covariance(x)
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    values, basis = np.linalg.eigh(np.array([[float(c) for c in r] for r in exact]))
    values, basis = values[::-1], basis[:, ::-1]
    model, found = _run(_frame(spark, rows))
    found = found.collect()
    assert len(found) == len(kept) * 6 and {r.n for r in found} == {n}
    assert np.allclose(model.values, values, rtol=1e-12)
    deviation = sorted((str(i), sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))) for (i, _), v in zip(kept, x, strict=True))
    assert sorted((str(r.vec_id), r.deviation) for r in found if r.component == 1) == deviation
    centred = np.array([[float(a - Fraction(s, n)) for a, s in zip(v, sums, strict=True)] for v in x])
    for k in range(6):
        expect = centred @ basis[:, k] / math.sqrt(values[k])
        own = sorted(abs(r.whitened) for r in found if r.component == k + 1)
        assert np.allclose(own, np.sort(np.abs(expect)), rtol=1e-9, atol=1e-11)
    assert max(abs(r.explained - values[r.component - 1] / values.sum()) for r in found) < 1e-12
    assert {r.identity_error for r in found} <= {found[0].identity_error} and found[0].identity_error < 1e-9


def test_few_and_equal_vectors(spark):
    assert _run(_frame(spark, [(1, [1.0, 2.0])] * 40))[1].collect() == []
    assert _run(_frame(spark, []))[1].collect() == []
    assert _run(_frame(spark, [(1, None), (2, [])]))[1].collect() == []
    _, found = _run(_frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [5.0, 2.0])]))
    assert {r.component for r in found.collect()} == {1}  # the other one has no variance


def test_no_more_than_the_wanted_components(spark):
    rng = np.random.default_rng(6)
    _, found = _run(_frame(spark, list(enumerate(rng.standard_normal((200, 40)).tolist()))))
    assert found.count() == 200 * 32
    assert found.agg(F.max("identity_error")).first()[0] < 1e-9


def test_deviations_beyond_a_long():
    model = W.Whitening(4, [0, 0], (np.eye(2), np.zeros((2, 2))))
    assert model.deviations(np.array([[2.0**30, 0.0], [1.0, 1.0], [2.0**31, 0.0]])) == [None, 32, None]


@pytest.mark.parametrize("n", [1, 3, 1000])
def test_division(n):
    p = W.divided((np.array([1.0]), np.array([1e-17])), n)
    assert abs(Fraction(float(p[0][0])) + Fraction(float(p[1][0])) - (Fraction(1.0) + Fraction(1e-17)) / n) < 1e-31

"""Whitening against a plain eigendecomposition, exact deviations and edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest

from pitscape.llm import whitening

VECTORS = "vec_id long, embedding array<float>, label int, dims int, x string, n long"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in rows], VECTORS)


def plain(rows, top=whitening.TOP):
    """n, {id: deviation}, whitened (components as columns), explained."""
    good = [(i, v) for i, v in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good]
    n, dims = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(dims)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)) for r in x]
    c = np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in x])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    keep = values > 1e-12 * values[0]
    values, vectors = values[keep][:top], vectors[:, keep][:, :top]
    return n, [i for i, _ in good], deviation, c @ vectors / np.sqrt(values), values / (c * c).sum() * n


def pulled(out):
    rows = sorted(out.collect(), key=lambda r: (r.vec_id, r.component))
    ids = sorted({r.vec_id for r in rows})
    k = max(r.component for r in rows)
    return rows, ids, np.array([r.whitened for r in rows]).reshape(len(ids), k)


@pytest.mark.parametrize(("dims", "n"), [(40, 300), (5, 200), (12, 9)])
def test_whitening_matches_eigenvectors(spark, dims, n):
    rnd = np.random.default_rng(dims)
    data = (rnd.standard_normal((n, dims)) * np.geomspace(3, 0.3, dims) + 5).astype(np.float32).tolist()
    rows = list(enumerate(data)) + [(n, None), (n + 1, [None] * dims), (n + 2, [float("nan")] * dims), (n + 3, [float("inf")] * dims), (n + 4, [])]
    out = whitening.whitened(table(spark, rows).repartition(4))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got, ids, w = pulled(out)
    count, want_ids, deviation, want, explained = plain(rows)
    assert ids == want_ids and w.shape == want.shape
    by = {r.vec_id: r.deviation for r in got}
    assert [by[i] for i in ids] == deviation and {r.n for r in got} == {count}
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w * sign - want).max() < 1e-7
    assert np.allclose(sorted({r.explained for r in got}, reverse=True), explained, rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_repeated_eigenvalues_and_lean_directions(spark):
    # two pairs of equal eigenvalues, a direction without variance, one that is the sum of two others
    rows = []
    for k, step in enumerate(8.0 * np.diag([1, 1, 0.25, 0.25])):
        for s in (1, -1):
            v = [float(s * c) for c in step]
            rows.append((2 * k + (s < 0), [*v, 7.0, v[0] + v[1]]))
    got, ids, w = pulled(whitening.whitened(table(spark, rows)))
    assert w.shape == (8, 4) and got[0].identity_error < 1e-9
    assert np.allclose(w.T @ w / 8, np.eye(4), atol=1e-9)
    want = plain(rows)[4]
    assert np.allclose([r.explained for r in got[:4]], want, rtol=1e-9)


def test_lengths_apart_repeats_and_no_variance(spark):
    one = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 5.0]), (4, [0.0, 0.75])]
    other = [(7, [1.0, 2.0, 3.0]), (8, [1.0, 2.0, 3.0])]
    out = whitening.whitened(table(spark, one + other)).collect()
    assert sorted(str(r.vec_id) for r in out) == sorted(["1", "1", "1", "1", "None", "None", "4", "4"])
    assert {r.n for r in out} == {4}
    assert whitening.whitened(table(spark, [])).collect() == []
    assert whitening.whitened(table(spark, [(1, [2.0, 3.0])])).collect() == []


def test_deviations_beyond_long_are_null():
    centre = whitening.Centre(2, 3, (3_000_000, 3 * 2**61))
    x = np.array([[1_000_000, 2**61], [1_000_001, 2**61 + 2**33], [999_999, 2**61 - 2**33]])
    assert centre.deviation(x) == [0, None, None]
    assert centre.deviation(x[:, :]) == [0, None, None] and whitening.Centre(2, 3, (3_000_000, 3)).deviation(np.array([[1_000_001, 1]])) == [9]

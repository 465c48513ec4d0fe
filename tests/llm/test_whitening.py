import math

import numpy as np
import pytest

from newsmood.llm import whitening
from newsmood.llm.bidiagonal import bidiagonalise, dqds, right_vectors

ROWS = "vec_id long, embedding array<float>"


def whole_numbers(rows):
    return [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows]


def brute(rows, k=16):
    """{(id, component): (deviation, |whitened|, explained)} with the covariance formed and numpy's solver."""
    rows = whole_numbers(rows)
    fit = [list(x) for x in {tuple(x) for _, x in rows}]
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = np.array([t / n for t in total])
    centred = np.array(fit, np.float64) - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = []
    for i, x in rows:
        far = sum((n * c - t) ** 2 for c, t in zip(x, total, strict=True))
        white = (np.array(x) - mean) @ vectors / np.sqrt(values)
        out.append((i, far, white, values / (centred ** 2).sum() * n))
    return n, out


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS x", "'n' AS n", "2 AS component").repartition(3)
    return whitening.whiten(df, **how).collect()


def check(found, rows, k=16):
    n, want = brute(rows, k)
    by_row = {}
    for r in found:
        by_row.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    signs = {}
    assert len(found) == len(rows) * k and set(by_row) == {i for i, _ in rows}
    for i, far, white, explained in want:
        assert set(by_row[i]) == set(range(1, k + 1))
        for c in range(1, k + 1):
            r = by_row[i][c][0]
            sign = signs.setdefault(c, np.sign(r.whitened) * np.sign(white[c - 1]))
            assert (r.n, r.deviation) == (n, far)
            assert r.whitened == pytest.approx(sign * white[c - 1], abs=1e-7)
            assert r.explained == pytest.approx(explained[c - 1], rel=1e-9)
            assert r.identity_error < 1e-9


def test_same_as_the_eigenvectors_of_the_covariance(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 50)
    monkeypatch.setattr(whitening, "FAN", 2)
    rng = np.random.default_rng(1)
    points = rng.normal(size=(400, 20)) @ np.diag(np.linspace(3, 0.3, 20)) + 2
    rows = [(i, v.tolist()) for i, v in enumerate(points.astype(np.float32))]
    rows += [(1_000 + i, rows[0][1]) for i in range(300)] + rows[:3] # a hot vector, rows that repeat
    once = {i: (i, v) for i, v in rows}
    check(run(spark, list(once.values())), list(once.values()))
    assert len(run(spark, rows)) == 16 * len(rows)


def test_few_dimensions_and_rows_that_take_no_part(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate((rng.normal(size=(60, 3)) * [1, 2, 3]).astype(np.float32))]
    rows.append((900, [0.0, 0.0, 0.0]))
    bad = [(901, None), (902, [1.0, None, 2.0]), (903, [float("nan"), 0.0, 0.0]), (904, [float("-inf"), 0.0, 0.0]),
           (905, [1e30, 0.0, 0.0]), (906, [1.0]), (907, [])]
    check(run(spark, rows + bad), rows, 3)
    assert {r.vec_id for r in run(spark, [*rows, (None, [1.0, 1.0, 1.0])])} == {None, *(i for i, _ in rows)}


def test_directions_without_variance_are_left_out(spark):
    rng = np.random.default_rng(3)
    flat = np.hstack([rng.normal(size=(50, 2)), np.full((50, 3), 0.5)])
    assert {r.component for r in run(spark, [(i, v.tolist()) for i, v in enumerate(flat)])} == {1, 2}
    assert run(spark, [(1, [1.0, 2.0])] * 5) == []
    assert run(spark, []) == []


def test_sums_and_deviations_of_large_numbers(spark):
    rows = [(i, [v, 1.0]) for i, v in enumerate([1e15, -1e15, 3e12, 5.0])]
    found = {r.vec_id: r for r in run(spark, rows) if r.component == 1}
    n, want = brute(rows, 2)
    for i, far, *_ in want:
        assert found[i].deviation == (far if far < 2**63 else None)


@pytest.mark.parametrize("matrix", [
    lambda g: g.normal(size=(300, 48)), lambda g: g.normal(size=(9, 30)), lambda g: np.vstack([np.eye(12)] * 4),
    lambda g: g.normal(size=(200, 30)) * np.logspace(0, -7, 30), lambda g: g.normal(size=(5, 1)),
    lambda g: np.vstack([np.eye(30) * 5, g.normal(size=(90, 30)) * 1e-9]),
    lambda g: np.linalg.qr(g.normal(size=(90, 24)))[0] @ np.diag([3] * 8 + [2] * 8 + [1] * 8)])
def test_bidiagonal_solver(matrix):
    a = matrix(np.random.default_rng(5))
    r = np.linalg.qr(a, mode="r")
    r = np.vstack([r, np.zeros((r.shape[1] - r.shape[0], r.shape[1]))]) if r.shape[0] < r.shape[1] else r
    values, vectors = right_vectors(r, 16)
    want = np.linalg.svd(a, compute_uv=False)[:16] ** 2
    k = len(values)
    assert k == (want > 1e-24 * want[0]).sum()
    assert values == pytest.approx(want[:k], rel=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-12
    assert np.abs(a.T @ (a @ vectors) - vectors * values).max() < 1e-13 * want[0]


def test_dqds_keeps_small_values():
    a, b = np.array([1.0, 1e-3, 1e-6, 1e-9, 2.0]), np.array([1.0, 1e-2, 1e-5, 1e-10])
    full = np.diag(a) + np.diag(b, 1)
    product = np.prod(a ** 2)
    assert np.prod(dqds(a, b)) == pytest.approx(product, rel=1e-12)  # to relative accuracy, the smallest too
    main, above, right = bidiagonalise(full)
    assert np.linalg.svd(np.diag(main) + np.diag(above, 1), compute_uv=False)[:3] == pytest.approx(
        np.linalg.svd(full, compute_uv=False)[:3], rel=1e-12)
    assert np.abs(right.T @ right - np.eye(5)).max() < 1e-14

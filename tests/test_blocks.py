"""Components of a covariance, conjugate gradients, and sums under block covariances, against dense algebra."""

import numpy as np
import pytest

from gramlaw.operators import blocks
from gramlaw.plans.basis import evaluate_external


def entries(spark, S, offset=0):
    i, j = np.nonzero(S)
    return spark.createDataFrame([(int(a) + offset, int(b) + offset, float(S[a, b])) for a, b in zip(i, j)], "i long, j long, v double")


def brute_components(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("chunk", [1 << 20, 7])
def test_components(spark, monkeypatch, chunk):
    monkeypatch.setattr(blocks, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(300)]
    edges += [(5000, 5001 + int(k)) for k in range(200)] + [(9000 - k, 9001 - k) for k in range(50)]
    got = blocks.components(spark.createDataFrame(edges, "i long, j long").repartition(6)).collect()
    want = {x: r for x, r in brute_components(edges).items() if any(x in e and e[0] != e[1] for e in edges)}
    assert {r["i"]: r["block"] for r in got} == want and len(got) == len(want)


def test_sums_over_blocks_of_all_kinds(spark):
    rng = np.random.default_rng(5)
    n = 260
    S = np.diag(0.5 + rng.random(n))
    S[7, 7] = 0.0  # a variance of zero weighs nothing
    for lo in range(20, 60, 4):
        A = rng.normal(size=(4, 4))
        S[lo : lo + 4, lo : lo + 4] = A @ A.T + np.eye(4)
    S[60:62, 60:62] = [[1.0, 1.0], [1.0, 1.0]]  # singular: pseudo-inverse
    band = 0.6 ** np.abs(np.subtract.outer(np.arange(180), np.arange(180))) * (np.abs(np.subtract.outer(np.arange(180), np.arange(180))) < 3) + np.eye(180)
    S[80:, 80:] = band
    U = np.column_stack([np.ones(n), rng.normal(size=(n, 2)), 5.0 + rng.normal(size=n)])
    rows = spark.createDataFrame([(i, *map(float, U[i])) for i in range(n)], "i long, one double, a double, b double, y double").repartition(5)
    want = U.T @ np.linalg.pinv(S) @ U
    upper = S.copy()
    upper[np.tril_indices(n, -1)] = 0.0
    upper += np.triu(S, 1)  # an entry and its mirror count by their mean
    for table in (S, upper):
        K, rows_seen = blocks.precision_sums(rows, entries(spark, table), ["one", "a", "b", "y"], max_block=50)
        np.testing.assert_allclose(K, want, rtol=1e-8)
        assert rows_seen == n


def test_large_banded_block(spark):
    """One block of 50 000 rows: never a group, solved in rounds."""
    n = 50_000
    i = np.arange(n)
    d, off = 2.0 + (i % 5) * 0.2, 0.7
    U = np.column_stack([np.ones(n), np.sin(i / 50.0), np.cos(i / 7.0)])
    rows = spark.range(n).selectExpr("id as i", "1.0D as one", "sin(id / 50.0) as x", "cos(id / 7.0) as y")
    cells = spark.range(n).selectExpr("id as i", "id as j", "2.0D + (id % 5) * 0.2D as v")
    right = spark.range(n - 1).selectExpr("id as i", "id + 1 as j", f"{off}D as v")
    sigma = cells.unionByName(right).unionByName(right.selectExpr("j as i", "i as j", "v"))
    c, x = np.zeros(n), np.zeros((n, 3))  # elimination of a tridiagonal matrix
    for k in range(n):
        m = d[k] - (off * c[k - 1] if k else 0.0)
        c[k] = off / m
        x[k] = (U[k] - (off * x[k - 1] if k else 0.0)) / m
    for k in range(n - 2, -1, -1):
        x[k] -= c[k] * x[k + 1]
    K, _ = blocks.precision_sums(rows, sigma, ["one", "x", "y"])
    np.testing.assert_allclose(K, U.T @ x, rtol=1e-8, atol=1e-6)


def test_not_positive_definite_raises(spark):
    S = np.eye(30) + 0.9 * (np.abs(np.subtract.outer(np.arange(30), np.arange(30))) == 1)
    rows = spark.createDataFrame([(i, 1.0, float((-1) ** i)) for i in range(30)], "i long, one double, y double")
    with pytest.raises(ValueError):
        blocks.precision_sums(rows, entries(spark, S), ["one", "y"], max_block=10)


def test_external_basis_with_a_large_block(spark):
    rng = np.random.default_rng(11)
    n = 120
    S = 0.5 ** np.abs(np.subtract.outer(np.arange(n), np.arange(n))) * 0.4 + 0.3 * np.eye(n)
    B, W = rng.normal(size=(n, 1)), np.linalg.inv(S)
    y = 2.0 * B[:, 0] + 0.5 + 0.2 * rng.normal(size=n)
    basis = spark.createDataFrame([(i, float(B[i, 0])) for i in range(n)], "i long, b0 double")
    target = spark.createDataFrame([(i, float(y[i])) for i in range(n)], "i long, y double")
    one = np.ones(n)
    mu, my = one @ W @ B / (one @ W @ one), one @ W @ y / (one @ W @ one)
    w = np.linalg.solve((B - mu).T @ W @ (B - mu) + 2e-3 * np.eye(1), (B - mu).T @ W @ (y - my))
    for bound in (1024, 16):
        fit = evaluate_external(basis, target, entries(spark, S), 1, max_block=bound)
        np.testing.assert_allclose(fit.weights, w, rtol=1e-8)

"""Tall QR against NumPy, on columns that a Gram matrix cannot tell apart."""

import numpy as np
from pyspark.sql import functions as F

from gramlaw.operators import qr
from gramlaw.operators.algebra import orthonormal_map


def test_near_equal_columns_keep_their_digits(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(3000, 3))
    X[:, 1] = X[:, 0] + 1e-10 * X[:, 1]
    w = 0.5 + rng.random(3000)
    df = spark.createDataFrame([(*map(float, x), float(v)) for x, v in zip(X, w)], "a double, b double, c double, w double").repartition(70)
    A = X * np.sqrt(w)[:, None]
    want = np.linalg.qr(A, mode="r")
    want *= np.sign(np.diag(want))[:, None]
    R, n = qr.triangular_factor(df, ["a", "b", "c"], F.col("w"))
    assert n == 3000
    np.testing.assert_allclose(R[:1], want[:1], rtol=1e-10)
    np.testing.assert_allclose(R[1:], want[1:], rtol=1e-4, atol=1e-13)
    assert 0.5 < qr.conditioning(R)["cond"] / np.linalg.cond(A) < 2.0 and np.linalg.cond(A) > 1e9
    out, T = qr.superfeatures(df, ["a", "b", "c"], F.col("w"))
    Q = (X @ T) * np.sqrt(w)[:, None]
    np.testing.assert_allclose(Q.T @ Q, np.eye(3), atol=1e-4)
    G = A.T @ A
    try:
        bad = A @ orthonormal_map(G)
        assert np.abs(bad.T @ bad - np.eye(3)).max() > 1e-2  # what the Gram makes of them
    except np.linalg.LinAlgError:
        pass
    row = out.orderBy("a").first()
    np.testing.assert_allclose([row["s0"], row["s2"]], (np.array([row["a"], row["b"], row["c"]]) @ T)[[0, 2]], rtol=1e-6, atol=1e-9)


def test_tree_of_any_shape(spark, monkeypatch):
    monkeypatch.setattr(qr, "FAN_IN", 3)
    rng = np.random.default_rng(3)
    X = rng.normal(size=(200, 5))
    want = np.linalg.qr(X, mode="r")
    want *= np.sign(np.diag(want))[:, None]
    for parts in (1, 2, 29):
        df = spark.createDataFrame([tuple(map(float, x)) for x in X], ", ".join(f"x{k} double" for k in range(5))).repartition(parts)
        R, _ = qr.triangular_factor(df, [f"x{k}" for k in range(5)])
        np.testing.assert_allclose(R, want, rtol=1e-9, atol=1e-12)


def test_few_rows_and_equal_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0)], "a double, b double, c double")
    R, n = qr.triangular_factor(df, ["a", "b", "c"])
    np.testing.assert_allclose(R, [[1, 2, 1], [0, 0, 0], [0, 0, 0]], atol=1e-12)
    assert n == 1 and np.isfinite(qr.orthonormal_from(R)).all() and qr.conditioning(R)["cond"] == float("inf")
    R, n = qr.triangular_factor(df.where("false"), ["a", "b"])
    assert n == 0 and R.shape == (2, 2)

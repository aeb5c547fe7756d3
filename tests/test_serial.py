"""Folds inside one AR(1) series, against dense marginal covariances."""

import numpy as np
import pytest

from gramlaw.operators.algebra import split_views
from gramlaw.operators.catalog import Candidate
from gramlaw.operators.gram import PLAIN, WEIGHTED, Design, affine, gram
from gramlaw.operators.noise import Ar1
from gramlaw.operators.serial import serial_frame
from gramlaw.plans.options import Options
from gramlaw.plans.search import search

CANDS = [Candidate("x", "unary", {"f": "x", "i": 0}), Candidate("t", "unary", {"f": "tanh", "i": 0})]


def series(seed, n=300, folds=4, run=None):
    rng = np.random.default_rng(seed)
    step = np.cumsum(rng.integers(1, 4, n))
    x = rng.normal(size=n)
    y = 1e3 + np.tanh(x) + 0.1 * rng.normal(size=n)
    fold = rng.integers(0, folds, n) if run is None else np.arange(n) // run % folds
    return step, x, y, fold


def raw(g, m):
    shift = np.concatenate([[0.0], -g.centre / g.scale, [0.0]])
    return affine(m.M, shift, np.concatenate([[1.0], g.scale, [1.0]]))


def covariance(step, noise):
    return noise.sigma**2 * noise.rho ** np.abs(np.subtract.outer(step, step))


@pytest.mark.parametrize("hot_rows,run", [(10**6, None), (60, None), (60, 37)])
def test_fold_sums_equal_dense_marginals(spark, hot_rows, run):
    noise = Ar1("s", "step", 0.85, 0.7, split=True)
    lines = [series(1, run=run), series(2, 40, run=run)]
    rows = [(s, int(a), float(b), float(c), int(d)) for s, line in enumerate(lines) for a, b, c, d in zip(*line)]
    df = spark.createDataFrame(rows, "s int, step long, x double, y double, fold int").repartition(6)
    g = gram(Design(serial_frame(df, noise, ["x", "y"], "fold", 4, hot_rows), ["x"], ["y"], leaf="fold", serial=4), CANDS)
    for k in range(4):
        for sums, use in ((g.leaves, lambda f: f == k), (g.trained, lambda f: f != k)):  # noqa: B023
            want, plain, n = np.zeros((4, 4)), np.zeros((4, 4)), 0
            for step, x, y, fold in lines:
                at = use(fold)
                U = np.column_stack([np.ones(at.sum()), x[at], np.tanh(x[at]), y[at]])
                want += U.T @ np.linalg.inv(covariance(step[at], noise)) @ U
                plain += U.T @ U
                n += int(at.sum())
            np.testing.assert_allclose(raw(g, sums[k, WEIGHTED]), want, rtol=1e-7)
            np.testing.assert_allclose(raw(g, sums[k, PLAIN]), plain, rtol=1e-9)
            assert sums[k, PLAIN].n == n
    whole = sum(np.column_stack([np.ones(len(x)), x, np.tanh(x), y]).T @ np.linalg.inv(covariance(step, noise)) @ np.column_stack([np.ones(len(x)), x, np.tanh(x), y]) for step, x, y, _ in lines)
    np.testing.assert_allclose(raw(g, g.total(WEIGHTED)), whole, rtol=1e-7)
    assert [k for k, _ in split_views(g)] == [0, 1, 2, 3]


def test_a_fold_without_rows_and_a_series_in_one_fold(spark):
    noise = Ar1("s", "step", 0.5, 1.0, split=True)
    rows = [(0, i, float(i % 5), float(i % 3), 0) for i in range(30)] + [(1, i, float(i % 4), float(i % 7), 2) for i in range(30)]
    df = spark.createDataFrame(rows, "s int, step long, x double, y double, fold int")
    g = gram(Design(serial_frame(df, noise, ["x", "y"], "fold", 3), ["x"], ["y"], leaf="fold", serial=3), CANDS[:1])
    np.testing.assert_allclose(raw(g, g.trained[0, WEIGHTED]), raw(g, g.leaves[2, WEIGHTED]), rtol=1e-9)
    assert [k for k, _ in split_views(g)] == [0, 2]


def test_search_over_one_series(spark):
    step, x, y, fold = series(5, 400, 3)
    df = spark.createDataFrame([(0, int(a), float(b), float(c), int(d)) for a, b, c, d in zip(step, x, y, fold)], "s int, step long, x double, y double, fold int")
    noise = Ar1("s", "step", 0.85, 0.7, split=True)
    opt = Options(folds=3, n_proj=2, n_pairs=0, max_grammar=1, bag_boots=0, refine=False)
    for given in ("fold", None):
        report = search(df, ["x"], "y", "step", opt, ar1=noise, fold=given, consensus=True, stage=given is None)["y"]
        assert len(report.folds) == 3 and report.metrics["n"] == 400 and report.metrics["R2_OOF"] > 0.95
    with pytest.raises(ValueError):
        search(df, ["x"], "y", "step", opt.patched(bag_boots=4), ar1=noise)
    with pytest.raises(ValueError):  # a single series stays in one fold where folds may not cut it
        search(df, ["x"], "y", "step", opt, ar1=Ar1("s", "step", 0.85, 0.7))


def test_predecessors_come_from_one_scan(spark):
    df = spark.createDataFrame([(0, k, float(k), 0.5, k % 4) for k in range(40)], "s int, t long, x double, y double, fold int")
    plan = serial_frame(df, Ar1("s", "t", 0.9, 1.0), ["x", "y"], "fold", 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1

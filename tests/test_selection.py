"""Searches on moments against row-by-row recomputation with direct least squares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlaw.functions.scores import criterion, ebic_bits, mdl_bits
from gramlaw.operators import select
from gramlaw.operators.algebra import split_views, whole_view
from gramlaw.operators.catalog import Candidate, build_bank, evaluate
from gramlaw.operators.gram import Design, gram
from gramlaw.operators.groups import groups_from_moments
from gramlaw.operators.noise import variance_weight
from gramlaw.operators.select import Block
from gramlaw.plans.options import Options, older
from test_moments import frame


def rows_view(X, y, cands, fold, k, w=None):
    tr, va = fold != k, fold == k
    Z = evaluate(cands, X)
    mu, sd = Z[tr].mean(0), Z[tr].std(0)
    sd = np.where(sd < 1e-12, 1, sd)
    Z = (Z - mu) / sd
    one = np.ones(len(y)) if w is None else w
    return Z[tr], y[tr], one[tr], Z[va], y[va], one[va]


def direct_ridge(Fm, y, w, alpha=1e-3):
    mu = (w @ Fm) / w.sum() if Fm.shape[1] else np.zeros(0)
    my = (w @ y) / w.sum()
    Fc = Fm - mu
    b = np.linalg.solve(Fc.T @ (w[:, None] * Fc) + alpha * np.eye(Fm.shape[1]), Fc.T @ (w * (y - my))) if Fm.shape[1] else np.zeros(0)
    return b, my - mu @ b


def direct_forward(Z, y, w, Zv, yv, wv, steps, opt, weighted):
    Fm, Fv, picks = np.zeros((len(y), 0)), np.zeros((len(yv), 0)), []
    for _ in range(steps):
        best = (np.inf, None, None)
        for j in range(Z.shape[1]):
            if j in picks or Z[:, j].std() < 1e-8:
                continue
            z, zv = Z[:, j], Zv[:, j]
            if Fm.shape[1]:
                g = np.linalg.solve(Fm.T @ (w[:, None] * Fm) + 1e-4 * np.eye(Fm.shape[1]), Fm.T @ (w * z))
                r, rv = z - Fm @ g, zv - Fv @ g
                if 1 - np.sqrt(w @ r**2) / (np.sqrt(w @ z**2) + 1e-12) > 0.995:
                    continue
            else:
                r, rv = z, zv
            mu = w @ r / w.sum()
            sd = np.sqrt(w @ (r - mu) ** 2 / w.sum())
            A, Av = np.column_stack([Fm, (r - mu) / sd]), np.column_stack([Fv, (rv - mu) / sd])
            b, b0 = direct_ridge(A, y, w)
            res = yv - Av @ b - b0
            score = criterion(wv @ res**2, len(yv), 0, "MDL", mdl_bits("atomic", 0, A.shape[1]), opt.bit_weight)
            if score < best[0]:
                best = (score, j, (A, Av))
        picks.append(best[1])
        Fm, Fv = best[2]
    return picks, Fm, Fv


@pytest.mark.parametrize("weighted", [False, True])
def test_forward_atoms_match_row_computation(spark, weighted):
    df, X, y, s = frame(spark, n=400)
    s = np.where(s > 0, s, 0.7)
    df = df.withColumn("w", variance_weight(F.when(F.col("s") > 0, F.col("s")).otherwise(0.7)))
    cands = build_bank(np.eye(3), 11, 4, 2)
    g = gram(Design(df, ["x0", "x1", "x2"], ["y"], weight="w" if weighted else None, leaf="fold"), cands)
    fold = np.arange(400) % 5
    view = dict(split_views(g))[1]
    opt = Options(max_atoms=4)
    found = select.forward_atoms(view, opt)
    w = 1 / s if weighted else None
    picks, Fm, Fv = direct_forward(*rows_view(X, y, cands, fold, 1, w), 4, opt, weighted)
    assert found.chosen == picks
    Z = rows_view(X, y, cands, fold, 1, w)[3]
    got = np.hstack([np.ones((len(Z), 1)), Z, np.zeros((len(Z), 1))]) @ found.A.T
    np.testing.assert_allclose(got, Fv, rtol=1e-5, atol=1e-5)


def test_residuals_are_orthogonal_and_fit_is_unchanged(spark):
    df, X, y, _ = frame(spark, n=400)
    cands = build_bank(np.eye(3), 11, 3, 1)
    view = whole_view(gram(Design(df, ["x0", "x1", "x2"], ["y"]), cands))
    opt = Options(rdmp_alpha=0.0, alpha=0.0)
    base = np.array([view.unit(0), view.unit(1)])
    block = [60, 75]
    R = select.residual_block(view, base, block, opt)
    sums = base @ view.tr @ R.T
    np.testing.assert_allclose(sums / view.n_tr, 0, atol=1e-8)
    a = select.fit_with(view, np.vstack([base, R]), opt)[2]
    b = select.fit_with(view, np.vstack([base, [view.unit(j) for j in block]]), opt)[2]
    np.testing.assert_allclose(a, b, rtol=1e-6)


def direct_greedy(Z, y, w, threshold, limit, gamma, max_corr=0.98):
    r = np.sqrt(w)
    P = Z * r[:, None]
    P = P / np.linalg.norm(P, axis=0)
    y0 = (y - w @ y / w.sum()) * r
    n, p = Z.shape
    best, chosen, gains = ebic_bits(y0 @ y0, n, 1, p, gamma), [], []
    while len(chosen) < limit:
        options = []
        for j in range(p):
            if j in chosen or (chosen and np.abs(P[:, chosen].T @ P[:, j]).max() > max_corr):
                continue
            A = P[:, [*chosen, j]]
            res = y0 - A @ np.linalg.lstsq(A, y0, rcond=None)[0]
            options.append((ebic_bits(res @ res, n, 1 + len(chosen) + 1, p, gamma) - best, -j))
        gain, j = max(options)
        if gain < threshold:
            break
        chosen.append(-j)
        gains.append(gain)
        best += gain
    return chosen, gains


@pytest.mark.parametrize("weighted", [False, True])
def test_operator_set_matches_row_computation(spark, weighted):
    df, X, y, s = frame(spark, n=500)
    s = np.where(s > 0, s, 0.7)
    df = df.withColumn("w", variance_weight(F.when(F.col("s") > 0, F.col("s")).otherwise(0.7)))
    cands = build_bank(np.eye(3), 11, 4, 2)
    view = whole_view(gram(Design(df, ["x0", "x1", "x2"], ["y"], weight="w" if weighted else None), cands))
    og = select.operator_set(view, [c.name for c in cands], Options())
    Z = evaluate(cands, X)
    live = np.flatnonzero(view.live)
    Z = (Z - Z.mean(0)) / Z.std(0)
    w = 1 / s if weighted else np.ones(500)
    chosen, gains = direct_greedy(Z[:, live], y, w, 0.8, 10, 0.25)
    assert og.selected == [int(live[j]) for j in chosen]
    np.testing.assert_allclose([o.bits for o in og.ops], gains, rtol=1e-5, atol=1e-4)
    A = Z[:, og.selected]
    y0 = y - w @ y / w.sum()
    G = A.T @ (w[:, None] * A)
    beta = np.linalg.solve(G, A.T @ (w * y0))
    res = y0 - A @ beta
    se = np.sqrt(np.diag(np.linalg.inv(G)) * (w @ res**2) / (500 - 1 - len(beta)))
    np.testing.assert_allclose([o.coeff for o in og.ops], beta, rtol=1e-5)
    np.testing.assert_allclose([o.stderr for o in og.ops], se, rtol=1e-4)
    assert all(b > a for a, b in zip(og.bits_path, og.bits_path[1:]))
    assert all(b <= a + 1e-9 for a, b in zip(og.rss_path, og.rss_path[1:]))
    np.testing.assert_allclose(og.r2_train, 1 - (w @ res**2) / (w @ y0**2), rtol=1e-8)


def test_near_copies_are_blocked(spark):
    df, X, y, _ = frame(spark, n=400)
    df = df.withColumn("twin", F.col("x0") + F.col("x1") * 1e-4)
    cands = [Candidate(n, "unary", {"f": "x", "i": j}) for j, n in enumerate(["x0", "twin", "x1"])]
    view = whole_view(gram(Design(df, ["x0", "twin", "x1"], ["y"]), cands))
    og = select.operator_set(view, ["x0", "twin", "x1"], Options(bits_threshold=-1e9, max_ops=3))
    assert not {0, 1} <= set(og.selected)


def test_small_table_defaults():
    assert select.sized_defaults(500, Options()) == (0.8, 10, 0.25)
    assert select.sized_defaults(501, Options()) == (0.6, 16, 0.0)
    assert select.sized_defaults(501, Options(max_ops=3)) == (0.6, 3, 0.0)


def test_block_rules():
    assert older().grammar_needs_both is False and Options().grammar_needs_both is True
    assert Block("fct", (), 5).n_reals == 5
    assert criterion(10.0, 4, 5, "AICc") == float("inf")
    with pytest.raises(ValueError):
        criterion(1.0, 10, 1, "HQIC")


def test_groups():
    corr = np.array([[1, 0.99, -0.985, 0.0], [0.99, 1, 0.99, 0.0], [-0.985, 0.99, 1, 0.05], [0, 0, 0.05, 1.0]])
    spec = groups_from_moments(corr, np.array([1.0, 1.0, 1.02, 1.05]))
    assert spec.perm_groups == ((0, 1, 2),)
    assert spec.rot2d_pairs == ((0, 3), (1, 3), (2, 3))
    assert groups_from_moments(np.eye(1), np.ones(1)).sign_groups == ((0,),)


def test_products_read_only_the_columns_in_use():
    from gramlaw.operators.algebra import small
    from gramlaw.operators.select import _rows_of

    rng = np.random.default_rng(5)
    U = rng.normal(size=(50, 9))
    M, A = U.T @ U, np.zeros((2, 9))
    A[0, [0, 3]], A[1, [3, 6]] = (0.5, -2.0), (1.5, 1.0)
    E = np.vstack([np.eye(9)[0], A, np.eye(9)[8]])
    broken = M.copy()
    broken[:, [1, 2, 4, 5, 7]] = broken[[1, 2, 4, 5, 7]] = np.nan  # columns that no feature has
    for y in (8, -1):
        np.testing.assert_allclose(small(broken, A, y), E @ M @ E.T, rtol=1e-12)
    np.testing.assert_allclose(_rows_of(A, M), A @ M, rtol=1e-12)
    np.testing.assert_allclose(small(M, A[:0], 8), M[np.ix_([0, 8], [0, 8])])

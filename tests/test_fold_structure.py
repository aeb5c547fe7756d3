"""What a search reads off the inputs comes from the training rows of each fold."""

import numpy as np

from gramlaw.operators.gram import Design, corrcoef_from, profile_inputs
from gramlaw.operators.groups import groups_from_moments
from gramlaw.plans.options import Options
from gramlaw.plans.search import fit_folds, fold_banks


def rows(seed, change=False):
    """Inputs 1 and 2 move together; in fold 0, if changed, inputs 0 and 1 do so much more."""
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(300, 3))
    X[:, 2] = 0.6 * X[:, 1] + X[:, 2]
    fold = np.arange(300) % 3
    if change:
        X[fold == 0, 1] = 40.0 * X[fold == 0, 0]
    return X, fold, np.sin(X[:, 0]) + 0.3 * X[:, 2]


def design(spark, change):
    X, fold, y = rows(4, change)
    df = spark.createDataFrame([(*map(float, x), int(f), float(t)) for x, f, t in zip(X, fold, y)], "x0 double, x1 double, x2 double, fold int, y double")
    return Design(df.repartition(4), ["x0", "x1", "x2"], ["y"], leaf="fold")


def test_training_profiles(spark):
    X, fold, _ = rows(4, True)
    prof = profile_inputs(design(spark, True))
    for k in range(3):
        T = X[fold != k]
        seen = prof.training(k)
        n = len(T)
        want = np.corrcoef(T.T) * n / (n - 1)
        np.fill_diagonal(want, 1.0)
        np.testing.assert_allclose(seen.corr(3), want, rtol=1e-9)
        np.testing.assert_allclose(seen.variances(3), T.var(0), rtol=1e-9)
        assert seen.inner.n == n and groups_from_moments(seen.corr(3), seen.variances(3)) == groups_from_moments(want, T.var(0))
    np.testing.assert_allclose(corrcoef_from(prof.inner, 3), prof.corr(3))


def test_changed_validation_rows_change_no_candidate(spark):
    opt = Options(n_proj=4, n_pairs=6, max_grammar=2, bag_boots=0, refine=False, linear_lock=2.0, folds=3)
    banks, fits = [], []
    for change in (False, True):
        d = design(spark, change)
        cands, own = fold_banks(profile_inputs(d), 3, opt)
        banks.append({k: {c.name for c, use in zip(cands, mask) if use} for k, mask in own.items()})
        fits.append(fit_folds(d, opt, ["x0"])[0])
    assert banks[0][0] == banks[1][0] and banks[0][None] != banks[1][None] and banks[0][1] != banks[1][1]
    assert any("ei:1" in n for n in banks[1][0]) and any("ei:0" in n for n in banks[1][1])
    for fit in fits:
        used = {c.name for (k, _), f in fit.items() if k == 0 for j, c in enumerate(f.cands) if np.abs(f.A[:, 1 + j]).sum() > 0}
        assert not any("ei:0" in n or n.startswith("bilinear:0_1") for n in used)

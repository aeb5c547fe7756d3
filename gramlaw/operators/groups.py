"""Symmetry groups read off correlations and variances."""

from __future__ import annotations

import numpy as np

from gramlaw.operators.catalog import GroupSpec

# Fixed values (must equal the reference's for equal results).
PERM_CORR, ROT_CORR, ROT_VARIANCE_GAP, MAX_ROT_PAIRS = 0.98, 0.1, 0.1, 12


def groups_from_moments(
    corr: np.ndarray, variances: np.ndarray, perm_corr: float = PERM_CORR, var_gap: float = ROT_VARIANCE_GAP, max_pairs: int = MAX_ROT_PAIRS
) -> GroupSpec:
    """All inputs as one sign group; near-copies as permutation groups; uncorrelated equal-variance pairs as rotations."""
    d = len(variances)
    if d < 2:
        return GroupSpec(sign_groups=(tuple(range(d)),))
    C = np.abs(corr - np.diag(np.diag(corr)))
    taken: set[int] = set()
    perms = []
    for i in range(d):
        if i in taken:
            continue
        close = [j for j in range(i + 1, d) if j not in taken and C[i, j] >= perm_corr]
        taken.update(close)
        if len(close) >= 2:
            perms.append((i, *close))
    pairs = []
    for i in range(d):
        for j in range(i + 1, d):
            middle = 0.5 * (variances[i] + variances[j])
            if C[i, j] < ROT_CORR and middle != 0 and abs(variances[i] - variances[j]) / middle < var_gap:
                pairs.append((i, j))
    return GroupSpec((tuple(range(d)),), tuple(perms), tuple(pairs[:max_pairs]))

"""Scores and description lengths: each as a plain number function, the common ones also as Column formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gramlaw.functions.atoms import EPS

LN2 = math.log(2.0)

# Fixed values (must equal the reference's for equal results): bits per block kind, column and real parameter.
TYPE_BITS = {
    "bilinear": 10.0,
    "relu_proj": 8.0,
    "sinproj": 8.0,
    "fct": 11.0,
    "perm_invar": 7.0,
    "dihedral_invar": 8.0,
    "group_invar": 10.0,
    "combo_vec": 10.0,
    "hsml_unary": 5.5,
    "hsml_binary": 7.5,
    "atomic": 4.0,
    "graph": 12.0,
}
OLDER_TYPE_BITS = TYPE_BITS | {"bilinear": 8.0, "combo_vec": 9.0, "hsml_binary": 6.5}
DEFAULT_TYPE_BITS = 8.0
COLUMN_BITS = 0.75
REAL_BITS = 1.5


def mdl_bits(kind: str, n_reals: int, n_cols: int, type_bits: dict[str, float] = TYPE_BITS) -> float:
    return type_bits.get(kind, DEFAULT_TYPE_BITS) + COLUMN_BITS * max(0, n_cols) + REAL_BITS * n_reals


def mdl_bits_column(kind: Column, n_reals: Column, n_cols: Column, type_bits: dict[str, float] = TYPE_BITS) -> Column:
    table = F.create_map(*[F.lit(v) for kv in type_bits.items() for v in kv])
    base = F.coalesce(F.try_element_at(table, kind), F.lit(DEFAULT_TYPE_BITS))
    return base + F.greatest(n_cols, F.lit(0)) * COLUMN_BITS + n_reals * REAL_BITS


def criterion(rss: float, n: int, k: int, which: str = "MDL", bits: float = 0.0, bit_weight: float = 1.0) -> float:
    """AICc, BIC or MDL from a residual sum of squares (or χ² under a noise model)."""
    fit = n * math.log(max(rss, 0.0) / max(1, n) + EPS)
    name = which.upper()
    if name == "AICC":
        return math.inf if n <= k + 1 else fit + 2 * k + 2 * k * (k + 1) / (n - k - 1)
    if name == "BIC":
        return fit + k * math.log(n + EPS)
    if name == "MDL":
        return fit + bit_weight * bits
    raise ValueError(f"unknown criterion {which}")


def criterion_column(rss: Column, n: Column, k: int, which: str, bits: float = 0.0, bit_weight: float = 1.0) -> Column:
    fit = n * F.log(rss / F.greatest(n, F.lit(1)) + EPS)
    name = which.upper()
    if name == "AICC":
        spare = n - F.lit(k + 1)
        safe = F.when(spare > 0, spare)
        return F.when(spare > 0, fit + 2.0 * k + F.lit(2.0 * k * (k + 1)) / safe).otherwise(F.lit(math.inf))
    if name == "BIC":
        return fit + F.log(n + EPS) * k
    if name == "MDL":
        return fit + bit_weight * bits
    raise ValueError(f"unknown criterion {which}")


def ebic_bits(rss, n: int, k: int, p: int, gamma: float):
    """Evidence in bits, larger is better. Accepts a NumPy array of residual sums."""
    import numpy as np

    value = n * np.log(np.maximum(np.asarray(rss, dtype=float) / n, 1e-300)) + k * math.log(n)
    if gamma > 0 and k > 0 and p > 1:
        value = value + 2.0 * gamma * k * math.log(p)
    return -value / LN2


def ebic_bits_column(rss: Column, n: Column, k: int, p: int, gamma: float) -> Column:
    value = n * F.log(F.greatest(rss / n, F.lit(1e-300))) + F.log(n) * k
    if gamma > 0 and k > 0 and p > 1:
        value = value + 2.0 * gamma * k * math.log(p)
    return -value / LN2


def bits_from_bic_change(change: float) -> float:
    """Half-log convention: -Δ/(2 ln 2)."""
    return -change / (2.0 * LN2)


def bits_between(bic_before: float, bic_after: float) -> float:
    """Full-log convention, the one selection uses: (before - after)/ln 2."""
    return (bic_before - bic_after) / LN2


def r2_column(y: Column, yhat: Column, mean_y: Column) -> Column:
    """Aggregate: 1 - SS_res/SS_tot; ``mean_y`` is the mean of y over the group."""
    res, tot = y - yhat, y - mean_y
    return 1.0 - F.sum(res * res) / (F.sum(tot * tot) + 1e-12)


def mse_column(y: Column, yhat: Column) -> Column:
    return F.avg((y - yhat) * (y - yhat))

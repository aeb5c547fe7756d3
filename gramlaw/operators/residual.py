"""Residualized feature chains as plain columns: each step subtracts its explained part of the earlier features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlaw.operators import catalog
from gramlaw.operators.catalog import Candidate


@dataclass(frozen=True)
class Step:
    """Scale the candidate by (centre, scale), subtract ``Σ gamma·earlier``, then scale by (mu, sd)."""

    cand: Candidate
    centre: float
    scale: float
    gamma: tuple[float, ...] = ()
    mu: float = 0.0
    sd: float = 1.0


def add_chain(df: DataFrame, steps: list[Step], cols: list[Column], prefix: str = "f") -> DataFrame:
    """Features ``f0, f1, …``; later ones refer to earlier ones by name, so nothing is computed twice."""
    for k, s in enumerate(steps):
        value = (catalog.column(s.cand, cols) - s.centre) / s.scale
        for j, g in enumerate(s.gamma):
            value = value - F.col(f"{prefix}{j}") * g
        df = df.withColumn(f"{prefix}{k}", (value - s.mu) / s.sd)
    return df


def residualize_columns(df: DataFrame, base: list[str], block: list[str], alpha: float = 1e-4, weight: str | None = None) -> DataFrame:
    """Replace each block column b by ``res_b = b - F·Γ`` with Γ from the (weighted) moments of the base columns."""
    import numpy as np

    from gramlaw.operators.algebra import residualize

    w = F.col(weight) if weight else F.lit(1.0)
    pairs = [(f, b) for f in base for b in [*base, *block]]
    row = df.agg(*[F.sum(w * F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in pairs]).first()
    G = np.array([[row[f"{a}__{b}"] for b in base] for a in base])
    C = np.array([[row[f"{a}__{b}"] for b in block] for a in base])
    gamma = residualize(G, C, alpha)
    out = df
    for q, b in enumerate(block):
        value = F.col(b)
        for p, a in enumerate(base):
            value = value - F.col(a) * float(gamma[p, q])
        out = out.withColumn(f"res_{b}", value)
    return out

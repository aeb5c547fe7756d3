"""Evaluation of a given basis under a noise model: intercept alone against the whole basis."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlaw.functions.scores import bits_between, bits_from_bic_change, criterion
from gramlaw.operators.algebra import residual_square, ridge
from gramlaw.operators.blocks import precision_sums
from gramlaw.operators.catalog import Candidate
from gramlaw.operators.gram import PLAIN, WEIGHTED, Design, affine, gram, profile_inputs
from gramlaw.operators.noise import variance_weight
from gramlaw.sources.tables import check_shapes


def raw_moments(design: Design) -> tuple[np.ndarray, int]:
    """Moments of ``(1, inputs, y)`` in raw units and in the design's noise geometry, and the row count."""
    cands = [Candidate(n, "unary", {"f": "x", "i": j}) for j, n in enumerate(design.names())]
    g = gram(design, cands, profile_inputs(design))
    m = g.total(WEIGHTED if design.weighted else PLAIN)
    t = len(design.targets)
    shift = np.concatenate([[0.0], -g.centre / g.scale, np.zeros(t)])
    factor = np.concatenate([[1.0], g.scale, np.ones(t)])
    return affine(m.M, shift, factor), m.n


@dataclass
class BasisFit:
    weights: np.ndarray
    intercept: float
    names: list[str]
    rows: list[tuple]
    checks: dict[str, float]

    def comparison(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            self.rows, "model string, k int, aicc double, bic double, mdl double, delta_bic_bits double, delta_mdl_bits double, half_bits double"
        )

    def amplitudes(self, spark: SparkSession) -> DataFrame:
        rows = [(n, float(w)) for n, w in zip(self.names, self.weights)]
        return spark.createDataFrame(rows, "operator string, amplitude double").orderBy(F.desc(F.abs("amplitude")))


def _fit(K: np.ndarray, n: int, names: list[str], alpha: float) -> BasisFit:
    """Both models from the moments of ``(1, basis, y)`` in the noise geometry."""
    d = len(names)
    K0 = K[np.ix_([0, d + 1], [0, d + 1])]
    w0, b0 = ridge(K0, alpha)
    w, b = ridge(K, alpha)
    chi0, chi1 = residual_square(K0, w0, b0), residual_square(K, w, b)
    score = lambda chi, k: [criterion(chi, n, k, c) for c in ("AICc", "BIC", "MDL")]
    s0, s1 = score(chi0, 1), score(chi1, d + 1)
    rows = [
        ("intercept", 1, *s0, None, None, None),
        ("basis", d + 1, *s1, bits_between(s0[1], s1[1]), bits_between(s0[2], s1[2]), bits_from_bic_change(s1[1] - s0[1])),
    ]
    return BasisFit(w, b, names, rows, {"chi2": chi1})


def evaluate_basis(design: Design, alpha: float = 2e-3, variance: str | None = None) -> BasisFit:
    """GLS ridge of the target on the basis, scored against the intercept by AICc, BIC and MDL, with noise checks."""
    if variance:
        df = design.df.withColumn("__w", variance_weight(F.col(variance)))
        design = Design(df, design.features, design.targets, design.dim, "__w", design.leaf, design.lagged)
    K, n = raw_moments(design)
    fit = _fit(K, n, design.names(), alpha)
    w, b = fit.weights, fit.intercept
    if variance:
        yhat = F.lit(b)
        for wj, c in zip(w, design.columns()):
            yhat = yhat + c * float(wj)
        s = F.col(variance)
        white = (F.col(design.targets[0]) - yhat) / F.sqrt(F.greatest(s, F.lit(1e-12)))
        floored = F.greatest(s, F.lit(1e-12))
        row = design.df.agg(
            F.stddev_pop(white).alias("white_std"),
            (F.max(F.abs(s)) / F.greatest(F.min(F.abs(s)), F.lit(1e-300))).alias("cond"),
            (F.sqrt(F.sum((floored - s) * (floored - s))) / (F.sqrt(F.sum(s * s)) + 1e-12)).alias("fro_error"),
        ).first()
        fit.checks |= row.asDict()
    return fit


def evaluate_external(basis: DataFrame, target: DataFrame, sigma: DataFrame, width: int, alpha: float = 2e-3, max_block: int = 1024) -> BasisFit:
    """A basis table (i, b0…), a target table (i, y) and covariance entries (i, j, v), checked and evaluated.

    A diagonal covariance becomes a variance column. Any other one is split into its connected blocks: those of at most
    ``max_block`` rows are whitened densely, larger ones are solved by conjugate gradients; neither has a size limit.
    """
    check_shapes(basis, target, sigma)
    names = [f"b{j}" for j in range(width)]
    rows = basis.join(target, "i")
    if sigma.where((F.col("i") != F.col("j")) & (F.col("v") != 0)).limit(1).count() == 0:
        variance = sigma.where("i = j").select("i", F.col("v").alias("variance"))
        return evaluate_basis(Design(rows.join(variance, "i"), names, ["y"]), alpha, "variance")
    K, n = precision_sums(rows.withColumn("one", F.lit(1.0)), sigma, ["one", *names, "y"], max_block)
    return _fit(K, n, names, alpha)

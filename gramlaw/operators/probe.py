"""Invariance probes: how much does a law's prediction move when its inputs are transformed by a symmetry?"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlaw.operators.catalog import GroupSpec, evaluate
from gramlaw.plans.law import Law


EXPRESSION_LIMIT = 24  # terms × probes × draws that still make a compact expression


@dataclass(frozen=True)
class Probe:
    """One symmetry and how its draws are made: ``flip``, ``perm``, ``rotate`` or ``scale`` over input positions."""

    kind: str
    idx: tuple[int, ...]
    spread: float = 0.2
    p: float = 0.5


SIDES = 16**7


def roll(key: Column, draw: int, seed: int) -> Column:
    """Row number below ``SIDES`` from a hash of key, draw and seed: the first 7 hex digits of an MD5."""
    text = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(draw)), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(text, 1, 7), 16, 10).cast("long")


def coin(key: Column, draw: int, seed: int, p: float = 0.5) -> Column:
    """Row coin: true with probability ``p``."""
    return roll(key, draw, seed) < F.lit(int(p * SIDES))


def draw_numbers(probe: Probe, which: int, draw: int, seed: int) -> np.random.Generator:
    return np.random.default_rng([seed, which, draw])


def transformed(probe: Probe, which: int, draw: int, seed: int, cols: list[Column], key: Column) -> list[Column]:
    """Input columns after one draw."""
    out = list(cols)
    rng = draw_numbers(probe, which, draw, seed)
    if probe.kind == "flip":
        heads = coin(key, draw, seed, probe.p)
        for j in probe.idx:
            out[j] = F.when(heads, -cols[j]).otherwise(cols[j])
    elif probe.kind == "perm":
        for j, source in zip(probe.idx, rng.permutation(probe.idx)):
            out[j] = cols[int(source)]
    elif probe.kind == "rotate":
        angle = rng.uniform(0.0, 2.0 * math.pi)
        i, j = probe.idx
        out[i] = cols[i] * math.cos(angle) - cols[j] * math.sin(angle)
        out[j] = cols[i] * math.sin(angle) + cols[j] * math.cos(angle)
    elif probe.kind == "scale":
        factor = math.exp(rng.normal(0.0, probe.spread))
        for j in probe.idx:
            out[j] = cols[j] * factor
    else:
        raise ValueError(f"unknown probe {probe.kind}")
    return out


def probes_for(spec: GroupSpec) -> list[Probe]:
    """Sign flip of the first sign group, every permutation group, every rotation pair, every scale group."""
    out = [Probe("flip", tuple(spec.sign_groups[0]))] if spec.sign_groups else []
    out += [Probe("perm", tuple(g)) for g in spec.perm_groups]
    out += [Probe("rotate", tuple(pair)) for pair in spec.rot2d_pairs]
    return out + [Probe("scale", tuple(g)) for g in spec.scale_groups]


def probe_shifts(df: DataFrame, law: Law, probes: list[Probe], key: str, draws: int = 16, seed: int = 42, batches: bool | None = None) -> DataFrame:
    """Mean |Δprediction| per (probe, draw), all draws from one scan; no row is copied.

    Short laws are aggregated as JVM expressions; for long ones the draws are evaluated on Arrow batches, with the row
    coins still made by Spark.
    """
    if batches or batches is None and len(law.terms) * len(probes) * draws > EXPRESSION_LIMIT:
        return _shifts_in_batches(df, law, probes, key, draws, seed)
    cols = [F.col(f"`{n}`").cast("double") for n in law.features]
    base = law.column(cols)
    aggs = [
        F.avg(F.abs(base - law.column(transformed(pr, s, r, seed, cols, F.col(key))))).alias(f"m_{s}_{r}")
        for s, pr in enumerate(probes)
        for r in range(draws)
    ]
    wide = df.agg(*aggs)
    cells = [
        F.struct(F.lit(s).alias("sampler"), F.lit(pr.kind).alias("kind"), F.lit(r).alias("draw"), F.col(f"m_{s}_{r}").alias("shift"))
        for s, pr in enumerate(probes)
        for r in range(draws)
    ]
    return wide.select(F.inline(F.array(*cells)))


def _moved(probe: Probe, which: int, draw: int, seed: int, X: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Input rows after one draw."""
    Y = X.copy()
    rng = draw_numbers(probe, which, draw, seed)
    idx = list(probe.idx)
    if probe.kind == "flip":
        Y[np.ix_(heads, idx)] *= -1.0
    elif probe.kind == "perm":
        Y[:, idx] = X[:, rng.permutation(idx)]
    elif probe.kind == "rotate":
        angle = rng.uniform(0.0, 2.0 * math.pi)
        turn = np.array([[math.cos(angle), math.sin(angle)], [-math.sin(angle), math.cos(angle)]])
        Y[:, idx] = X[:, idx] @ turn
    else:
        Y[:, idx] *= math.exp(rng.normal(0.0, probe.spread))
    return Y


def _shifts_in_batches(df: DataFrame, law: Law, probes: list[Probe], key: str, draws: int, seed: int) -> DataFrame:
    d = len(law.features)
    cands = [c for _, c in law.terms]
    w = np.array([v for v, _ in law.terms])
    flips = any(pr.kind == "flip" for pr in probes)
    rolls = F.array(*[roll(F.col(key), r, seed) for r in range(draws if flips else 0)]).cast("array<long>")
    narrow = df.select(*[F.col(f"`{n}`").cast("double").alias(f"x{j}") for j, n in enumerate(law.features)], rolls.alias("rolls"))

    def run(batches):
        sums = np.zeros((len(probes), draws))
        n = 0
        for batch in batches:
            X = np.column_stack([batch.column(f"x{j}").to_numpy(zero_copy_only=False).astype(float) for j in range(d)])
            rolls = batch.column("rolls").flatten().to_numpy(zero_copy_only=False).reshape(len(X), -1)
            base = evaluate(cands, X) @ w
            n += len(X)
            for s, pr in enumerate(probes):
                for r in range(draws):
                    heads = rolls[:, r] < int(pr.p * SIDES) if pr.kind == "flip" else np.zeros(len(X), dtype=bool)
                    moved = evaluate(cands, _moved(pr, s, r, seed, X, heads)) @ w
                    sums[s, r] += np.abs(base - moved).sum()
        cells = [(s, pr.kind, r, float(sums[s, r]), n) for s, pr in enumerate(probes) for r in range(draws)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*cells)], names=["sampler", "kind", "draw", "total", "n"])

    parts = narrow.mapInArrow(run, "sampler long, kind string, draw long, total double, n long")
    return parts.groupBy("sampler", "kind", "draw").agg((F.sum("total") / F.sum("n")).alias("shift"))


def probe_scores(shifts: DataFrame) -> DataFrame:
    """Median over draws per sampler."""
    return shifts.groupBy("sampler", "kind").agg(F.median("shift").alias("score"))


def probe_median(scores: DataFrame) -> DataFrame:
    """Median over samplers: the invariance score."""
    return scores.agg(F.median("score").alias("median"))

"""Noise models: row weights, whitening in diagonal, AR(1) and block form, and χ² with a sparse precision table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlaw.session import prepare

VARIANCE_FLOOR = 1e-12  # fixed value
STACK = 1 << 20  # numbers in the matrices that a task whitens at a time


def variance_weight(variance: Column) -> Column:
    """1/variance, and 0 where the variance is not positive."""
    safe = F.greatest(variance, F.lit(VARIANCE_FLOOR))
    return F.when(variance > 0, 1.0 / safe).otherwise(F.lit(0.0))


def whiten_diagonal(df: DataFrame, cols: list[str], variance: str) -> DataFrame:
    root = F.sqrt(variance_weight(F.col(variance)))
    return df.withColumns({f"white_{c}": F.col(c) * root for c in cols})


@dataclass(frozen=True)
class Ar1:
    """AR(1) noise within ``series`` on the integer grid ``step``: correlation ``rho`` per unit step, deviation ``sigma``.
    ``split`` lets folds cut through a series; otherwise a series stays in one fold."""

    series: str
    step: str
    rho: float
    sigma: float = 1.0
    split: bool = False


def ar1_frame(df: DataFrame, noise: Ar1, cols: list[str]) -> DataFrame:
    """Attach the previous row's values with the factor ``phi`` and scale ``gain`` that whiten the series."""
    from gramlaw.operators.scan import with_previous

    out = with_previous(df, noise.series, [noise.step], [noise.step, *cols])
    gap = (F.col(noise.step) - F.col(f"prev_{noise.step}")).cast("double")
    phi = F.when(gap.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(noise.rho), gap))
    return out.withColumn("phi", phi).withColumn("gain", 1.0 / (noise.sigma * F.sqrt(1.0 - F.col("phi") * F.col("phi"))))


def whiten_ar1(df: DataFrame, series: str, step: str, cols: list[str], rho: float, sigma: float) -> DataFrame:
    """Whiten within each series of an AR(1) process on an integer grid, allowing gaps.

    ``(x_t - ρ^g·x_prev)/(σ√(1-ρ^{2g}))`` with g the gap to the previous observation, and x/σ for the first one.
    """
    out = ar1_frame(df, Ar1(series, step, rho, sigma), cols)
    white = {f"white_{c}": (F.col(c) - F.col("phi") * F.coalesce(F.col(f"prev_{c}"), F.lit(0.0))) * F.col("gain") for c in cols}
    return out.withColumns(white)


def _whitener(sigma: np.ndarray) -> np.ndarray:
    """C with CᵀC equal to the pseudo-inverse of Σ: transposed Cholesky factor, or the symmetric root if singular."""
    W = np.linalg.pinv(0.5 * (sigma + sigma.T), rcond=1e-12)
    try:
        return np.linalg.cholesky(W).T
    except np.linalg.LinAlgError:
        values, vectors = np.linalg.eigh(W)
        return (vectors * np.sqrt(np.clip(values, 0.0, None))) @ vectors.T


def _whiteners(sigma: np.ndarray) -> np.ndarray:
    """``_whitener`` of each matrix of a stack."""
    W = np.linalg.pinv(0.5 * (sigma + sigma.transpose(0, 2, 1)), rcond=1e-12)
    try:
        return np.linalg.cholesky(W).transpose(0, 2, 1)
    except np.linalg.LinAlgError:
        return np.stack([_whitener(S) for S in sigma])


def whiten_blocks(df: DataFrame, block: str, pos: str, cols: list[str], sigma: DataFrame, max_block: int = 1024) -> DataFrame:
    """Whiten jointly within blocks. ``sigma`` has columns (block, i, j, v) with positions matching ``pos``.

    A block's covariance is dense, so its size must be bounded by the model; a larger block raises instead of pulling an
    unbounded group into one task. Each block becomes one row of arrays, and Arrow batches carry many blocks at a time.
    """
    size = df.groupBy(block).count().agg(F.max("count")).first()[0] or 0
    if size > max_block:
        raise ValueError(f"block of {size} rows exceeds {max_block}; use the AR(1) or sparse form")
    kind = dict(df.dtypes)
    rows = df.groupBy(block).agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos).cast("long").alias("pos"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x")))).alias("rows")
    )
    entries = sigma.groupBy(block).agg(F.collect_list(F.struct("i", "j", "v")).alias("entries"))
    flat = rows.join(entries, block, "left").select(
        block,
        F.col("rows.pos").alias("pos"),
        F.flatten("rows.x").alias("x"),
        *[F.coalesce(F.col(f"entries.{c}"), F.array().cast(f"array<{t}>")).alias(c) for c, t in (("i", "long"), ("j", "long"), ("v", "double"))],
    )
    width = len(cols)
    names = [block, pos, *[f"white_{c}" for c in cols]]

    def run(batches):
        for b in batches:
            p, i, j = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "i", "j"))
            x, v = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(float) for c in ("x", "v"))
            size, cells = (pc.list_value_length(b.column(c)).to_numpy().astype(np.int64) for c in ("pos", "v"))
            x, white = x.reshape(-1, width), np.empty((len(p), width))
            start = size.cumsum() - size
            # rows as numbers that grow with block and position, by which the entries find their place
            _, code = np.unique(np.concatenate([p, i, j]), return_inverse=True)
            of_row, of_cell = np.repeat(np.arange(len(size)), size), np.repeat(np.arange(len(size)), cells)
            key = lambda of, place: of * (len(code) + 1) + place
            there = key(of_row, code[: len(p)])
            want = [key(of_cell, code[len(p) : len(p) + len(i)]), key(of_cell, code[len(p) + len(i) :])]
            a, c = (np.minimum(np.searchsorted(there, w), max(len(there) - 1, 0)) for w in want)
            here = (there[a] == want[0]) & (there[c] == want[1]) if len(there) else np.zeros(len(i), dtype=bool)
            for k in np.unique(size):
                which = np.flatnonzero(size == k)
                for lo in range(0, len(which), max(1, STACK // int(k * k))):
                    some = which[lo : lo + max(1, STACK // int(k * k))]
                    rank = np.full(len(size), -1)
                    rank[some] = np.arange(len(some))
                    at = here & (rank[of_cell] >= 0)
                    S = np.zeros((len(some), k, k))
                    S[rank[of_cell[at]], a[at] - start[of_cell[at]], c[at] - start[of_cell[at]]] = v[at]
                    rows = start[some][:, None] + np.arange(k)
                    white[rows] = _whiteners(S) @ x[rows]
            columns = [b.column(block).take(pa.array(of_row)), pa.array(p), *[pa.array(white[:, q]) for q in range(width)]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    prepare(df.sparkSession)
    white = flat.mapInArrow(run, ", ".join([f"`{block}` {kind[block]}", f"`{pos}` bigint", *[f"`white_{c}` double" for c in cols]]))
    return white.withColumn(pos, F.col(pos).cast(kind[pos]))


def sparse_chi2(residuals: DataFrame, key: str, r: str, precision: DataFrame, hot_entries: int = 2_000_000) -> DataFrame:
    """χ² = Σ w_ij·r_i·r_j for a sparse precision table (i, j, w); one residual per key.

    Entries of a column j with more than ``hot_entries`` meet its single residual by broadcast (there are at most
    entries/hot_entries such columns), the others by a shuffle join. Products are summed per i before the second join,
    so that one meets a row per index.
    """
    rj = residuals.select(F.col(key).alias("j"), F.col(r).alias("rj"))
    ri = residuals.select(F.col(key).alias("i"), F.col(r).alias("ri"))
    hot = precision.groupBy("j").count().where(F.col("count") > hot_entries).select("j")
    if not hot.isEmpty():
        heavy = precision.join(F.broadcast(rj.join(F.broadcast(hot), "j")), "j")
        light = precision.join(F.broadcast(hot), "j", "left_anti").join(rj, "j")
        met = heavy.select("i", "w", "rj").unionByName(light.select("i", "w", "rj"))
    else:
        met = precision.join(rj, "j")
    inner = met.groupBy("i").agg(F.sum(F.col("w") * F.col("rj")).alias("wr"))
    return inner.join(ri, "i").agg(F.sum(F.col("wr") * F.col("ri")).alias("chi2"))


def weight_diagnostics(df: DataFrame, weight: Column) -> DataFrame:
    """Extremes and condition number of a diagonal weight."""
    low, high = F.greatest(F.min(weight), F.lit(0.0)), F.max(weight)
    return df.agg(
        low.alias("min_eig"),
        high.alias("max_eig"),
        F.when(high > 0, high / F.greatest(low, F.lit(1e-16))).otherwise(F.lit(float("inf"))).alias("cond"),
    )

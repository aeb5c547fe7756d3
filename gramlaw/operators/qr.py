"""Orthonormal columns and condition numbers of tall tables by a tree of QR factors.

A Gram matrix squares the condition number: columns that agree in eight digits lose them all there. Here each task keeps
the triangular factor of the rows it has seen (columns², whatever the rows), and factors are stacked and reduced again, in
a tree over tasks. Only the last factor reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlaw.session import prepare, spread

FAN_IN = 32


def _reduced(R: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack([R, rows]), mode="r")


def triangular_factor(df: DataFrame, cols: list[str | Column], weight: Column | None = None) -> tuple[np.ndarray, int]:
    """R of the rows' QR factorisation (positive diagonal), rows scaled by the root of ``weight``, and the row count.
    A table of fewer rows than columns gives a factor with zero rows below."""
    prepare(df.sparkSession)
    k = len(cols)
    root = F.lit(1.0) if weight is None else F.sqrt(weight)
    narrow = spread(df.select(F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") * root for c in cols]).alias("row")))

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        R, n = np.zeros((0, k)), 0
        for b in batches:
            if b.num_rows:
                R, n = _reduced(R, b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)), n + b.num_rows
        if n:
            yield _record(TaskContext.get().partitionId(), n, R)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        R, n = np.zeros((0, k)), 0
        for b in batches:
            for count, data in zip(b.column("n").to_pylist(), b.column("data").to_pylist(), strict=True):
                R, n = _reduced(R, np.frombuffer(data).reshape(-1, k)), n + count
        if n:
            yield _record(TaskContext.get().partitionId(), n, R)

    schema = "part long, n long, data binary"
    parts, factors = narrow.rdd.getNumPartitions(), narrow.mapInArrow(factor, schema)
    while parts > 1:
        parts = -(-parts // FAN_IN)
        factors = factors.repartition(parts, F.col("part") % parts).mapInArrow(merged, schema)
    R, n = np.zeros((0, k)), 0
    for row in factors.collect():  # one row, or FAN_IN at most
        R, n = _reduced(R, np.frombuffer(row["data"]).reshape(-1, k)), n + row["n"]
    R = np.vstack([R, np.zeros((k - len(R), k))])
    return np.where(np.diag(R) < 0, -1.0, 1.0)[:, None] * R, n


def _record(part: int, n: int, R: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([np.ascontiguousarray(R).tobytes()])], names=["part", "n", "data"])


def orthonormal_from(R: np.ndarray) -> np.ndarray:
    """T with orthonormal columns X·T: the inverse of R, or, if that is singular, right singular vectors over singular
    values of at least 1e-12."""
    if np.diag(R).all():
        return np.linalg.solve(R, np.eye(len(R)))
    _, values, right = np.linalg.svd(R)
    return right.T / np.maximum(values, 1e-12)


def conditioning(R: np.ndarray) -> dict[str, float]:
    """Condition number of the columns and of their Gram matrix, without forming it."""
    values = np.linalg.svd(R, compute_uv=False)
    cond = float(values[0] / values[-1]) if values[-1] > 0 else float("inf")
    return {"cond": cond, "cond_gram": cond * cond}


def superfeatures(df: DataFrame, cols: list[str], weight: Column | None = None, prefix: str = "s") -> tuple[DataFrame, np.ndarray]:
    """``df`` with orthonormal columns ``s0…`` in the geometry of ``weight``, and the map T, which also serves new rows."""
    R, _ = triangular_factor(df, cols, weight)
    T = orthonormal_from(R)
    return apply_superfeatures(df, cols, T, prefix), T


def apply_superfeatures(df: DataFrame, cols: list[str], T: np.ndarray, prefix: str = "s") -> DataFrame:
    def one(q: int) -> Column:
        out = F.col(cols[0]) * float(T[0, q])
        for c, t in zip(cols[1:], T[1:, q], strict=True):
            out = out + F.col(c) * float(t)
        return out

    return df.withColumns({f"{prefix}{q}": one(q) for q in range(T.shape[1])})

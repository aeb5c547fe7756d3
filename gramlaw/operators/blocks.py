"""Generalised least squares under a sparse covariance: its connected blocks, dense ones whitened, large ones solved.

A covariance table (i, j, v) splits into the connected components of its non-zero entries. Rows without any partner need
no algebra. A component of at most ``max_block`` rows is whitened as a dense matrix, one group for each. Larger ones are
never gathered: Σ X = U is solved for all columns of U at once by conjugate gradients with a diagonal preconditioner, each
step a join of the entries with the current direction and a sum by row. Only the sums UᵀΣ⁻¹U reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlaw.operators.noise import variance_weight, whiten_blocks
from gramlaw.session import materialise, prepare

CHUNK = 1 << 20  # entries that a task links at a time


def symmetric(sigma: DataFrame) -> DataFrame:
    """(i, j, v) of (Σ + Σᵀ) / 2, each entry once, zeros left out."""
    half = F.when(F.col("i") == F.col("j"), F.col("v")).otherwise(F.col("v") / 2)
    cell = lambda i, j: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), half.alias("v"))
    both = F.when(F.col("i") == F.col("j"), F.array(cell("i", "j"))).otherwise(F.array(cell("i", "j"), cell("j", "i")))
    return sigma.select(F.inline(both)).groupBy("i", "j").agg(F.sum("v").alias("v")).where("v != 0 or i = j")


def least_linked(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, and for each the least node that the edges connect it with."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]


def components(edges: DataFrame) -> DataFrame:
    """(i, block) of every node of the edges (i, j): ``block`` is the least node connected with it.

    Tasks link the edges they hold first, so that long chains of neighbouring rows shrink to a star a task. Then every
    node's edges are moved to the least neighbour of the node's neighbour, and to its own least neighbour, until all are
    stars: the rounds grow with the logarithm of the longest path that is left."""
    prepare(edges.sparkSession)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out():
            u, v = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            nodes, root = least_linked(u, v)
            return pa.RecordBatch.from_arrays([pa.array(nodes[nodes != root]), pa.array(root[nodes != root])], names=["u", "v"])

        for b in batches:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            size += b.num_rows
            if size >= CHUNK:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    pairs = edges.where("i != j").select(F.greatest("i", "j").cast("long").alias("u"), F.least("i", "j").cast("long").alias("v"))
    e = materialise(pairs.repartitionByRange("u").mapInArrow(linked, "u long, v long").distinct(), "links")
    while True:
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        above = least.select(F.col("u").alias("v"), F.col("m").alias("mv"))
        jumped = e.join(above, "v", "left").select("u", F.coalesce("mv", "v").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        down = jumped.groupBy("u").agg(F.min("v").alias("m"))
        moved = jumped.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(down.select("u", F.col("m").alias("v")).unionByName(moved).distinct(), "links")
        twice = e.groupBy("u").count().where("count > 1")
        if twice.isEmpty() and e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            break
    tops = e.select(F.col("v").alias("i"), F.col("v").alias("block")).distinct()
    return e.select(F.col("u").alias("i"), F.col("v").alias("block")).unionByName(tops)


def solve(sigma: DataFrame, rows: DataFrame, cols: list[str], tol: float = 1e-13, most: int = 2000) -> DataFrame:
    """``rows`` (i, cols) with ``inv_c``, the columns of Σ⁻¹U, by preconditioned conjugate gradients.

    ``sigma`` is symmetric with a positive diagonal for every row; one that turns out not to be positive definite raises.
    Each step writes its vectors once and sends three sums a column to the driver."""
    each = range(len(cols))
    diagonal = sigma.where("i = j").select("i", F.col("v").alias("d"))
    entries = materialise(sigma, "entries")

    def times(vectors: DataFrame, name: str) -> DataFrame:
        """Σ times the vectors ``u_k``, as ``name_k``."""
        side = vectors.select(F.col("i").alias("j"), *[f"u_{k}" for k in each])
        return entries.join(side, "j").groupBy("i").agg(*[F.sum(F.col("v") * F.col(f"u_{k}")).alias(f"{name}_{k}") for k in each])

    zero, col = F.lit(0.0), lambda v, k: F.col(f"{v}_{k}")
    start = rows.join(diagonal, "i")
    state = start.select("i", "d", *[c for k in each for c in (zero.alias(f"x_{k}"), F.col(cols[k]).cast("double").alias(f"r_{k}"), zero.alias(f"p_{k}"), zero.alias(f"s_{k}"), (F.col(cols[k]) / F.col("d")).alias(f"u_{k}"))])
    gamma = alpha = beta = first = None
    for step in range(most):
        if step:  # along the direction of the step before
            p = [col("u", k) + F.lit(float(beta[k])) * col("p", k) for k in each]
            s = [col("w", k) + F.lit(float(beta[k])) * col("s", k) for k in each]
            r = [col("r", k) - F.lit(float(alpha[k])) * s[k] for k in each]
            state = state.select("i", "d", *[c for k in each for c in ((col("x", k) + F.lit(float(alpha[k])) * p[k]).alias(f"x_{k}"), r[k].alias(f"r_{k}"), p[k].alias(f"p_{k}"), s[k].alias(f"s_{k}"), (r[k] / F.col("d")).alias(f"u_{k}"))])
        state = materialise(state.join(times(state, "w"), "i"), "directions")
        sums = state.agg(*[F.coalesce(F.sum(col("r", k) * col("u", k)), zero) for k in each], *[F.coalesce(F.sum(col("w", k) * col("u", k)), zero) for k in each]).first()
        now, delta = np.array(sums[: len(cols)]), np.array(sums[len(cols) :])
        first = now if first is None else first
        open_ = now > tol**2 * np.maximum(first, 1e-300)
        if not open_.any():
            break
        if (now < 0).any() or (delta[open_] <= 0).any():
            raise ValueError("the covariance of a large block is not positive definite")
        if step == 0:
            beta, alpha = np.zeros(len(cols)), np.where(open_, now / np.where(delta == 0, 1, delta), 0.0)
        else:
            beta = np.where(open_, now / np.where(gamma == 0, 1, gamma), 0.0)
            scale = delta - beta * now / np.where(alpha == 0, 1, alpha)
            if (scale[open_] <= 0).any():
                raise ValueError("the covariance of a large block is not positive definite")
            alpha = np.where(open_, now / np.where(scale == 0, 1, scale), 0.0)
        gamma = now
    else:
        raise ValueError(f"no solution after {most} steps: the covariance is close to singular")
    return rows.join(state.select("i", *[F.col(f"x_{k}").alias(f"inv_{c}") for k, c in enumerate(cols)]), "i")


def precision_sums(rows: DataFrame, sigma: DataFrame, cols: list[str], max_block: int = 1024) -> tuple[np.ndarray, int]:
    """UᵀΣ⁻¹U of the columns ``cols`` of ``rows`` (with key i), and the number of rows.

    Variances that are not positive weigh nothing in rows of their own; a singular block of at most ``max_block`` rows has
    the pseudo-inverse, a larger one must be positive definite."""
    rows = materialise(rows.select(F.col("i").cast("long").alias("i"), *[F.col(c).cast("double").alias(c) for c in cols]), "basis-rows")
    entries = materialise(symmetric(sigma.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v")), "covariance")
    block = materialise(components(entries), "components")
    size = block.groupBy("block").agg(F.count("*").alias("size"))
    of = block.join(size, "block").select("i", "block", "size")
    place = materialise(rows.join(of, "i", "left"), "basis-blocks")
    pairs = [(a, b) for a in range(len(cols)) for b in range(a, len(cols))]
    K = np.zeros((len(cols), len(cols)))

    def add(df: DataFrame, left, right, weight=None) -> None:
        product = lambda a, b: F.col(left(cols[a])) * F.col(right(cols[b])) * (F.lit(1.0) if weight is None else weight)
        for (a, b), total in zip(pairs, df.agg(*[F.sum((product(a, b) + product(b, a)) / 2) for a, b in pairs]).first(), strict=True):
            K[a, b] += total or 0.0
            if a != b:
                K[b, a] += total or 0.0

    alone = place.where("block is null").join(entries.where("i = j").select("i", "v"), "i")
    same = lambda c: c
    add(alone, same, same, variance_weight(F.col("v")))
    linked = entries.join(of, "i")
    small = place.where(f"size <= {max_block}")
    if not small.isEmpty():
        white = lambda c: f"white_{c}"
        add(whiten_blocks(small.select("block", "i", *cols), "block", "i", cols, linked.where(f"size <= {max_block}").select("block", "i", "j", "v"), max_block), white, white)
    large = place.where(f"size > {max_block}")
    if not large.isEmpty():
        solved = solve(linked.where(f"size > {max_block}").select("i", "j", "v"), large.select("i", *cols), cols)
        add(solved, same, lambda c: f"inv_{c}")
    return K, rows.count()

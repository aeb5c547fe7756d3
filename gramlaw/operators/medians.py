"""Exact medians of many projections at once, by narrowing histograms in a few shared passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gramlaw.operators.gram import PARTIAL_SCHEMA, Design, _layout, _matrix, _narrow, record, sum_partials
from gramlaw.session import spread

BINS = 2048
FEW = 4096


def training_medians(design: Design, directions: list[list[float]], folds: list[int], whole: bool) -> dict[tuple[int, int], float]:
    """Median of each projection over the training rows of each fold (all rows if ``whole``), keyed (fold, direction).

    Tasks count rows per leaf inside the open brackets of each projection; only those fixed-size histograms are
    shuffled. The training count of a fold is the sum over the other leaves, so folds share brackets and passes. A
    bracket with few rows left is finished from its distinct values.
    """
    layout = _layout(design)
    W = np.array(directions).T
    frame = spread(_narrow(design))

    def projected(batches):
        for batch in batches:
            leaf = batch.column("leaf").to_numpy(zero_copy_only=False)
            times = _matrix(batch, ["c"], 1)[:, 0] if layout["copies"] else np.ones(len(leaf))
            yield _matrix(batch, layout["x"], layout["d"]) @ W, leaf, times

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple] = {}
        for Z, leaf, times in projected(batches):
            for k in np.unique(leaf):
                for r in range(W.shape[1]):
                    use = (leaf == k) & np.isfinite(Z[:, r])
                    z = Z[use, r]
                    if len(z):
                        lo, hi, n = found.get((int(k), r), (np.inf, -np.inf, 0))
                        found[int(k), r] = (min(lo, z.min()), max(hi, z.max()), n + round(times[use].sum()))
        rows = [(*key, *v) for key, v in found.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["leaf", "r", "lo", "hi", "n"])

    seen = frame.mapInArrow(extremes, "leaf long, r long, lo double, hi double, n long").groupBy("leaf", "r")
    seen = seen.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).collect()
    leaves = sorted({row["leaf"] for row in seen})
    uses = {k: [q for q in leaves if whole or q != k] for k in folds}
    # open bracket per (fold, direction, rank): lo, hi (exclusive), training rows below, training rows inside
    open_: dict[tuple[int, int, int], list] = {}
    for r in range(W.shape[1]):
        mine = {row["leaf"]: row for row in seen if row["r"] == r}
        lo, hi = min(m["lo"] for m in mine.values()), np.nextafter(max(m["hi"] for m in mine.values()), np.inf)
        for k in folds:
            n = sum(mine[q]["n"] for q in uses[k] if q in mine)
            for rank in sorted({(n + 1) // 2, n // 2 + 1}):
                open_[k, r, rank] = [lo, hi, 0, n]
    wide = lambda b: b[3] > FEW and b[1] - b[0] > BINS * np.spacing(max(abs(b[0]), abs(b[1])))

    while any(wide(b) for b in open_.values()):
        brackets = sorted({(key[1], b[0], b[1]) for key, b in open_.items() if wide(b)})
        edges = [np.linspace(lo, hi, BINS + 1) for _, lo, hi in brackets]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            acc = np.zeros((len(brackets), len(leaves), BINS))
            for Z, leaf, times in projected(batches):
                place = np.searchsorted(leaves, leaf)
                for u, (r, lo, hi) in enumerate(brackets):
                    z = Z[:, r]
                    inside = (z >= lo) & (z < hi)
                    cell = np.searchsorted(edges[u], z[inside], side="right") - 1
                    acc[u] += np.bincount(place[inside] * BINS + cell, weights=times[inside], minlength=acc[u].size).reshape(acc[u].shape)
            for u in range(len(brackets)):
                yield record([(u, 0, 0, 0, acc[u].tobytes())])

        rows = sum_partials(frame.mapInArrow(count, PARTIAL_SCHEMA), groups=8).collect()
        counts = {brackets[row["leaf"]]: (edges[row["leaf"]], np.frombuffer(row["data"]).reshape(len(leaves), BINS)) for row in rows}
        for (k, r, rank), b in open_.items():
            if wide(b):
                e, per_leaf = counts[r, b[0], b[1]]
                training = per_leaf[[leaves.index(q) for q in uses[k]]].sum(axis=0)
                below = b[2] + np.concatenate([[0.0], np.cumsum(training)])
                j = int(np.searchsorted(below, rank, side="left")) - 1
                open_[k, r, rank] = [float(e[j]), float(e[j + 1]), int(below[j]), int(training[j])]

    brackets = sorted({(key[1], b[0], b[1]) for key, b in open_.items()})

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for Z, leaf, times in projected(batches):
            for u, (r, lo, hi) in enumerate(brackets):
                inside = (Z[:, r] >= lo) & (Z[:, r] < hi)
                if inside.any():
                    pairs = np.column_stack([leaf[inside], Z[inside, r]])
                    values, which = np.unique(pairs, axis=0, return_inverse=True)
                    n = np.rint(np.bincount(which.ravel(), weights=times[inside]))
                    cols = [pa.array(np.full(len(values), u)), pa.array(values[:, 0].astype(np.int64)), pa.array(values[:, 1]), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, names=["u", "leaf", "v", "n"])

    values = frame.mapInArrow(distinct, "u long, leaf long, v double, n long").groupBy("u", "leaf", "v").agg(F.sum("n").alias("n")).collect()
    by: dict[int, list] = {}
    for row in sorted(values, key=lambda row: row["v"]):
        by.setdefault(row["u"], []).append(row)
    found: dict[tuple[int, int], list[float]] = {}
    for (k, r, rank), b in open_.items():
        below = b[2]
        for row in by[brackets.index((r, b[0], b[1]))]:
            below += row["n"] if row["leaf"] in uses[k] else 0
            if below >= rank:
                found.setdefault((k, r), []).append(row["v"])
                break
    return {key: float(np.mean(v)) for key, v in found.items()}

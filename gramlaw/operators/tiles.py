"""Gram matrices of banks too wide for one task or for the driver, as a table of tiles.

The columns (1, candidates, targets) are cut into strips of ``WIDTH``; a tile is the product of two strips, and the upper
triangle of tiles is the Gram. Tiles are dealt to passes in square patches of strips, so many that the sums of a patch fit
``TASK_BYTES`` in a task, and a pass evaluates only the candidates of its strips. Rows are never shuffled; partial tiles are
added up by tile and written to the shared folder. What selection reads of the matrix is single rows and the diagonal: a
row is a strip of tiles, read in one small job, whose columns (p numbers a fold, not p²) reach the driver. ``RowMatrix``
stands where a dense matrix stands in a fold's view, so that forward atoms and greedy operators are the same code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlaw.operators.algebra import CONSTANT_SD, FoldView
from gramlaw.operators.catalog import Candidate, evaluate
from gramlaw.operators.gram import PLAIN, ROWS_PER_STEP, WEIGHTED, Design, RawProfile, _layout, _matrix, _narrow, profile_inputs, working_scale
from gramlaw.session import materialise, spread

WIDTH, TASK_BYTES, TASKS_PER_CORE = 256, 128 << 20, 2
TILE = "leaf int, kind int, a int, b int, n long, data binary"
KEYS = ["leaf", "kind", "a", "b"]


def patches(strips: int, width: int, sums: int, budget: int) -> list[list[tuple[int, int]]]:
    """The upper triangle of tiles in square patches whose ``sums`` accumulators a tile fit the budget."""
    side = max(1, int((budget / (8 * width * width * sums)) ** 0.5))
    starts = range(0, strips, side)
    square = lambda a0, b0: [(a, b) for a in range(a0, min(a0 + side, strips)) for b in range(b0, min(b0 + side, strips)) if a <= b]
    return [square(a0, b0) for a0 in starts for b0 in starts if a0 <= b0]


def _tile_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*KEYS, "n", "data"])


def _patch_pass(design: Design, cands: list[Candidate], centre: np.ndarray, scale: np.ndarray, tiles: list[tuple[int, int]], width: int) -> DataFrame:
    """Partial tiles of one patch, a row for each task, leaf, kind and tile."""
    P, p = 1 + len(centre), len(cands)
    strips = sorted({s for tile in tiles for s in tile})
    span = {s: (s * width, min((s + 1) * width, P)) for s in strips}
    columns = [c for s in strips for c in range(*span[s])]
    place = {s: slice(columns.index(span[s][0]), columns.index(span[s][0]) + span[s][1] - span[s][0]) for s in strips}
    own = [c for c in columns if 1 <= c <= p]
    used, layout = [cands[c - 1] for c in own], _layout(design)
    at = np.array(own, dtype=np.int64)
    where = np.array([columns.index(c) for c in own], dtype=np.int64)
    goals = [(columns.index(c), c - 1 - p) for c in columns if c > p]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple, np.ndarray] = {}
        counts: dict[int, int] = {}

        def standard(X, Y):
            U = np.empty((len(columns), X.shape[0]))
            if columns[0] == 0:
                U[0] = 1.0
            if used:
                V = np.empty((len(used), X.shape[0]))
                evaluate(used, X, V)
                U[where] = (V - centre[at - 1][:, None]) / scale[at - 1][:, None]
            for row, t in goals:
                U[row] = (Y[:, t] - centre[p + t]) / scale[p + t]
            return U

        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS_PER_STEP):
                batch = whole.slice(lo, ROWS_PER_STEP)
                U, V = standard(_matrix(batch, layout["x"], layout["d"]), _matrix(batch, layout["y"], 0)), None
                if layout["lagged"]:
                    prev = standard(_matrix(batch, layout["px"], layout["d"]), _matrix(batch, layout["py"], 0))
                    phi, gain = _matrix(batch, ["phi"], 1).T, _matrix(batch, ["gain"], 1).T
                    V = gain * (U - np.where(phi == 0.0, 0.0, phi * np.nan_to_num(prev)))
                elif layout["weight"]:
                    V = U * np.sqrt(_matrix(batch, ["w"], 1)).T
                leaf = batch.column("leaf").to_numpy(zero_copy_only=False)
                times = _matrix(batch, ["c"], 1)[:, 0] if layout["copies"] else np.ones(len(leaf))
                for k in np.unique(leaf):
                    rows = leaf == k
                    counts[int(k)] = counts.get(int(k), 0) + int(round(times[rows].sum()))
                    for kind, W in ((PLAIN, U), (WEIGHTED, V)):
                        if W is None:
                            continue
                        part = W[:, rows] * np.sqrt(times[rows])
                        for a, b in tiles:
                            product = part[place[a]] @ part[place[b]].T
                            key = (int(k), kind, a, b)
                            if key in acc:
                                acc[key] += product
                            else:
                                acc[key] = product
        for (k, kind, a, b), M in acc.items():
            yield _tile_batch([(k, kind, a, b, counts[k], M.tobytes())])

    narrow = spread(_narrow(design))
    cores = design.df.sparkSession.sparkContext.defaultParallelism
    return narrow.coalesce(TASKS_PER_CORE * cores).mapInArrow(run, TILE)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of runs of equal tiles: the rows come sorted, so that one tile is held at a time."""
    key = total = None
    n = 0
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in (*KEYS, "n", "data")), strict=True):
            if row[:4] == key:
                total += np.frombuffer(row[5])
                n += row[4]
                continue
            if key is not None:
                yield _tile_batch([(*key, n, total.tobytes())])
            key, n, total = row[:4], row[4], np.frombuffer(row[5]).copy()
    if key is not None:
        yield _tile_batch([(*key, n, total.tobytes())])


@dataclass
class TiledGram:
    """Written tiles of ``(1, candidates, targets)`` in working shift and scale; ``read`` holds the rows fetched so far."""

    tiles: DataFrame
    cands: list[Candidate]
    centre: np.ndarray
    scale: np.ndarray
    width: int
    counts: dict[int, int]
    kinds: list[int]
    banks: dict[int | None, np.ndarray] | None = None
    read: dict[tuple[int, int, int], np.ndarray] = field(default_factory=dict)
    diagonals: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    @property
    def P(self) -> int:
        return 1 + len(self.centre)

    def fetch(self, k: int) -> None:
        """Bring row ``k`` of every leaf and kind to the driver."""
        if (*self._some(), k) in self.read:
            return
        s, at, width, P = k // self.width, k % self.width, self.width, self.P

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for leaf, kind, a, c, n, data in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                    M = np.frombuffer(data).reshape(min((a + 1) * width, P) - a * width, -1)
                    if a == s:
                        yield _tile_batch([(leaf, kind, s, c, n, M[at].tobytes())])
                    elif c == s:
                        yield _tile_batch([(leaf, kind, s, a, n, np.ascontiguousarray(M[:, at]).tobytes())])

        for r in self.tiles.where((F.col("a") == s) | (F.col("b") == s)).mapInArrow(run, TILE).collect():  # P numbers a leaf and kind
            part = np.frombuffer(r["data"])
            self.read.setdefault((r["leaf"], r["kind"], k), np.zeros(P))[r["b"] * width : r["b"] * width + len(part)] = part

    def _some(self) -> tuple[int, int]:
        return next(iter(self.counts)), self.kinds[0]

    def row(self, k: int, leaves: list[int], kind: int) -> np.ndarray:
        self.fetch(k)
        return sum(self.read[leaf, kind, k] for leaf in leaves)

    def diagonal(self, leaves: list[int], kind: int) -> np.ndarray:
        if not self.diagonals:
            width, P = self.width, self.P

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for leaf, kind, a, c, n, data in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                        side = min((a + 1) * width, P) - a * width
                        yield _tile_batch([(leaf, kind, a, c, n, np.frombuffer(data).reshape(side, side).diagonal().tobytes())])

            for r in self.tiles.where("a = b").mapInArrow(run, TILE).collect():
                part = np.frombuffer(r["data"])
                self.diagonals.setdefault((r["leaf"], r["kind"]), np.zeros(P))[r["a"] * width : r["a"] * width + len(part)] = part
        return sum(self.diagonals[leaf, kind] for leaf in leaves)


class RowMatrix:
    """A symmetric matrix of ``(1, candidates, one target)`` whose rows are fetched when they are first read."""

    __array_ufunc__ = None  # products from the left come here

    def __init__(self, gram: TiledGram, leaves: list[int], kind: int, keep: np.ndarray, shift: np.ndarray, factor: np.ndarray):
        self.gram, self.leaves, self.kind, self.keep, self.shift, self.factor = gram, leaves, kind, keep, shift, factor
        self.shape = (len(keep), len(keep))
        self.first = gram.row(0, leaves, kind)[keep]
        self.rows: dict[int, np.ndarray] = {}

    def row(self, k: int) -> np.ndarray:
        k = int(k)
        if k not in self.rows:
            raw, s = self.gram.row(int(self.keep[k]), self.leaves, self.kind)[self.keep], self.shift
            self.rows[k] = (raw - s * raw[0] - self.first * s[k] + s * s[k] * self.first[0]) * self.factor * self.factor[k]
        return self.rows[k]

    def diagonal(self) -> np.ndarray:
        raw, s = self.gram.diagonal(self.leaves, self.kind)[self.keep], self.shift
        return (raw - 2 * s * self.first + s * s * self.first[0]) * self.factor**2

    def __rmatmul__(self, E: np.ndarray) -> np.ndarray:
        used = np.flatnonzero(np.abs(np.atleast_2d(E)).sum(axis=0))
        out = np.zeros((*E.shape[:-1], len(self.keep)))
        for k in used:
            out += E[..., k, None] * self.row(k)
        return out

    def __getitem__(self, key):
        if isinstance(key, np.ndarray):
            return np.array([self.row(k) for k in key]).reshape(len(key), len(self.keep))
        if not isinstance(key, tuple):
            return self.row(key)
        r, c = key
        if isinstance(r, slice):
            return self.row(c)[r]
        if isinstance(r, (int, np.integer)):
            return self.row(r)[c]
        c = np.ravel(c) if isinstance(c, np.ndarray) else c
        return np.array([self.row(k)[c] for k in np.ravel(r)])


def tiled_gram(design: Design, cands: list[Candidate], prof: RawProfile | None = None, width: int = WIDTH, budget: int = TASK_BYTES) -> TiledGram:
    """The Gram of a bank, tile by tile. ``design.leaf`` numbers the folds, of which there are few."""
    if design.serial:
        raise ValueError("folds that cut through a series have leaves of their own; use the dense form")
    prof = prof or profile_inputs(design)
    centre, scale = working_scale(cands, prof)
    kinds = [PLAIN, WEIGHTED] if design.weighted else [PLAIN]
    folds = max(len(prof.parts), 1)
    strips = -(-(1 + len(centre)) // width)
    parts, n_tiles = None, 0
    for tiles in patches(strips, width, len(kinds) * folds, budget):
        one = _patch_pass(design, cands, centre, scale, tiles, width)
        parts, n_tiles = one if parts is None else parts.unionByName(one), n_tiles + len(tiles)
    cores = design.df.sparkSession.sparkContext.defaultParallelism
    summed = parts.repartition(max(cores, n_tiles * len(kinds) * folds // 128), *KEYS).sortWithinPartitions(*KEYS).mapInArrow(_added, TILE)
    written = materialise(summed, "tiles", "none")
    counts = {r["leaf"]: r["n"] for r in written.where(f"a = 0 and b = 0 and kind = {PLAIN}").select("leaf", "n").collect()}
    return TiledGram(written, cands, centre, scale, width, counts, kinds)


def tiled_views(gram: TiledGram, target: int = 0) -> list[tuple[int, FoldView]]:
    """One view per fold, as of a dense Gram; with a single leaf one view of all rows."""
    folds = sorted(gram.counts)
    return [(k, _view(gram, [f for f in folds if f != k] or [k], [k], target, k)) for k in folds]


def tiled_whole(gram: TiledGram, target: int = 0) -> FoldView:
    every = sorted(gram.counts)
    return _view(gram, every, every, target, None)


def _view(gram: TiledGram, train: list[int], valid: list[int], target: int, fold: int | None) -> FoldView:
    p = len(gram.cands)
    keep = np.array([*range(1 + p), 1 + p + target])
    first, diag = gram.row(0, train, PLAIN), gram.diagonal(train, PLAIN)
    mu = first[1 : 1 + p] / first[0]
    sd = np.sqrt(np.maximum(diag[1 : 1 + p] / first[0] - mu**2, 0.0))
    live = sd > CONSTANT_SD
    sd = np.where(live, sd, 1.0)
    y_centre, y_scale = gram.centre[p + target], gram.scale[p + target]
    shift = np.concatenate([[0.0], mu, [-y_centre / y_scale]])
    factor = np.concatenate([[1.0], 1.0 / sd, [y_scale]])
    matrix = lambda leaves, kind: RowMatrix(gram, leaves, kind, keep, shift, factor)
    tr_plain, va_plain = matrix(train, PLAIN), matrix(valid, PLAIN)
    weighted = WEIGHTED in gram.kinds
    tr, va = (matrix(train, WEIGHTED), matrix(valid, WEIGHTED)) if weighted else (tr_plain, va_plain)
    n = lambda leaves: sum(gram.counts[leaf] for leaf in leaves)
    view = FoldView(tr, va, tr_plain, va_plain, n(train), n(valid), gram.centre[:p] + gram.scale[:p] * mu, gram.scale[:p] * sd, live, weighted)
    return view.restricted((gram.banks or {}).get(fold))

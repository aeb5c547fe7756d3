"""Second moments of a candidate bank in one pass over the rows.

Rows never leave their partition: each task evaluates the bank on Arrow batches and adds up ``UᵀU`` for
``U = (1, z_1..z_p, y_1..y_t)`` per leaf (fold, bucket). Only partial sums are shuffled, cut into row blocks, and a
streaming sum reduces them in one or two levels, so no task ever holds more than its own accumulators.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlaw.functions.atoms import finite
from gramlaw.operators.catalog import Candidate, distinct_columns, evaluate
from gramlaw.session import spread

PLAIN, WEIGHTED = 0, 1
SAMPLE, SAMPLE_PIECES = -1, 64
BLOCK_BYTES = 1 << 20
ROWS_PER_STEP = 4096
WAVES = 2  # tasks a core that add up moments, however many pieces the input has
PARTIAL_SCHEMA = "leaf int, kind int, block int, n long, data binary"


@dataclass(frozen=True)
class Design:
    """Which columns of a DataFrame are inputs, targets, row weight and fold key.

    ``features`` is either a list of numeric columns or the name of one array column (then ``dim`` is its length).
    ``lagged`` marks AR(1) noise: the frame then carries ``prev_*`` copies of inputs and targets, the factor ``phi``
    and the scale ``gain``, and every moment is taken of ``gain·(u_t - phi·u_prev)``. ``copies`` names a column of
    repetition counts: each row then enters moments and row counts as if it were there that many times. ``origin`` is
    taken off each target before anything is summed, so that a large offset costs no digits; only the intercept of a
    finished law takes it back. ``serial`` is the number of folds that cut through correlated series: the frame then
    carries the roles of ``serial_frame``, and ``leaf`` its fold. ``even`` says that the frame is a table written in even
    parts for all cores, whose rows a pass need not deal out again.
    """

    df: DataFrame
    features: list[str] | str
    targets: list[str]
    dim: int = 0
    weight: str | None = None
    leaf: str | None = None
    lagged: bool = False
    copies: str | None = None
    origin: tuple[float, ...] = ()
    serial: int = 0
    even: bool = False

    @property
    def d(self) -> int:
        return self.dim if isinstance(self.features, str) else len(self.features)

    @property
    def weighted(self) -> bool:
        return self.weight is not None or self.lagged or self.serial > 0

    def columns(self) -> list[Column]:
        """Input columns in order, as expressions."""
        if isinstance(self.features, str):
            return [F.col(self.features)[j].cast("double") for j in range(self.dim)]
        return [F.col(f"`{n}`").cast("double") for n in self.features]

    def names(self) -> list[str]:
        return [f"{self.features}[{j}]" for j in range(self.dim)] if isinstance(self.features, str) else list(self.features)


@dataclass
class Moments:
    """A summed Gram over ``(1, candidates…, targets…)``; ``n`` counts rows.

    Candidates stay in the working shift and scale they were accumulated in (a power like x³ would lose all digits in
    raw units); targets are in raw units.
    """

    M: np.ndarray
    n: int
    p: int
    t: int = 1

    def __add__(self, other: "Moments") -> "Moments":
        return Moments(self.M + other.M, self.n + other.n, self.p, self.t)

    def __sub__(self, other: "Moments") -> "Moments":
        return Moments(self.M - other.M, self.n - other.n, self.p, self.t)

    def target(self, k: int) -> "Moments":
        """Moments of ``(1, candidates, one target)``."""
        keep = [*range(1 + self.p), 1 + self.p + k]
        return Moments(self.M[np.ix_(keep, keep)], self.n, self.p, 1)

    def means(self) -> np.ndarray:
        return self.M[0] / max(self.M[0, 0], 1e-300)

    def covariance(self) -> np.ndarray:
        mu = self.means()
        return self.M / max(self.M[0, 0], 1e-300) - np.outer(mu, mu)


# --------------------------------------------------------------------------------------------------------------
# Row side


def _matrix(batch: pa.RecordBatch, names: list[str] | str, dim: int) -> np.ndarray:
    if isinstance(names, str):
        col = batch.column(names)
        return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), dim)
    if not names:
        return np.empty((batch.num_rows, 0))
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names])


def _narrow(design: Design, extra: list[Column] | None = None) -> DataFrame:
    """Only the columns the pass needs, under fixed names; rows without every target (null or NaN) are left out."""
    cols: list[Column] = []
    df = design.df
    for t in design.targets:
        df = df.where(F.col(f"`{t}`").isNotNull() & ~F.isnan(F.col(f"`{t}`").cast("double")))
    origin = design.origin or (0.0,) * len(design.targets)
    if isinstance(design.features, str):
        cols.append(F.col(design.features).alias("x"))
        if design.lagged:
            cols.append(F.col(f"prev_{design.features}").alias("px"))
    else:
        cols += [F.col(f"`{n}`").cast("double").alias(f"x{j}") for j, n in enumerate(design.features)]
        if design.lagged:
            cols += [F.col(f"`prev_{n}`").cast("double").alias(f"px{j}") for j, n in enumerate(design.features)]
    cols += [(F.col(f"`{t}`").cast("double") - F.lit(origin[k])).alias(f"y{k}") for k, t in enumerate(design.targets)]
    if design.lagged:
        cols += [(F.col(f"`prev_{t}`").cast("double") - F.lit(origin[k])).alias(f"py{k}") for k, t in enumerate(design.targets)]
        cols += [F.col("phi").cast("double").alias("phi"), F.col("gain").cast("double").alias("gain")]
    if design.weight:
        cols.append(F.col(design.weight).cast("double").alias("w"))
    if design.copies:
        cols.append(F.col(design.copies).cast("double").alias("c"))
    cols.append((F.col(design.leaf) if design.leaf else F.lit(0)).cast("int").alias("leaf"))
    return df.select(*cols, *(extra or []))


def _dealt(design: Design) -> DataFrame:
    """The columns of a pass in enough pieces for all cores."""
    return _narrow(design) if design.even else spread(_narrow(design))


def _layout(design: Design) -> dict:
    array = isinstance(design.features, str)
    names = lambda prefix, k: [f"{prefix}{j}" for j in range(k)]
    return {
        "x": "x" if array else names("x", design.d),
        "px": "px" if array else names("px", design.d),
        "y": names("y", len(design.targets)),
        "py": names("py", len(design.targets)),
        "d": design.d,
        "weight": design.weight is not None,
        "lagged": design.lagged,
        "copies": design.copies is not None,
    }


def block_rows(P: int) -> int:
    return max(1, min(P, BLOCK_BYTES // (8 * P)))


def pack(acc: dict, counts: dict, P: int) -> Iterator[tuple]:
    """Row blocks of the upper triangle, each with its leaf, kind and row count."""
    step = block_rows(P)
    for (leaf, kind), M in acc.items():
        for b, lo in enumerate(range(0, P, step)):
            yield leaf, kind, b, counts[leaf], np.ascontiguousarray(M[lo : lo + step, lo:]).tobytes()


def unpack(rows, P: int) -> dict[tuple[int, int], tuple[np.ndarray, int]]:
    step = block_rows(P)
    out: dict[tuple[int, int], list] = {}
    for r in rows:
        M, n = out.setdefault((r["leaf"], r["kind"]), [np.zeros((P, P)), 0])
        lo = r["block"] * step
        hi = min(lo + step, P)
        M[lo:hi, lo:] = np.frombuffer(r["data"]).reshape(hi - lo, P - lo)
        out[(r["leaf"], r["kind"])][1] = r["n"]
    for M, _ in out.values():
        upper = np.triu_indices(P, 1)
        M.T[upper] = M[upper]
    return {k: (M, n) for k, (M, n) in out.items()}


def record(rows: list[tuple]) -> pa.RecordBatch:
    leaf, kind, block, n, data = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(leaf, pa.int32()), pa.array(kind, pa.int32()), pa.array(block, pa.int32()), pa.array(n, pa.int64()), pa.array(data, pa.binary())],
        names=["leaf", "kind", "block", "n", "data"],
    )


class Square:
    """What a pass adds up: here all products of two columns."""

    def __init__(self, columns: int):
        self.columns = columns

    def rows_per_step(self) -> int:
        return ROWS_PER_STEP

    def filler(self, cands: list[Candidate], shift: np.ndarray, factor: np.ndarray):
        """Evaluates the candidates of a batch, shifted and scaled, into the rows of an array."""

        def fill(X: np.ndarray, out: np.ndarray) -> None:
            evaluate(cands, X, out)
            out -= shift[:, None]
            out *= factor[:, None]

        return fill

    def products(self, U: np.ndarray) -> np.ndarray:
        return U @ U.T

    def packed(self, acc: dict, counts: dict) -> Iterator[tuple]:
        return pack(acc, counts, self.columns)


def _sorted_by_leaf(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with the rows of a leaf side by side, in their order."""
    leaf = batch.column("leaf").to_numpy(zero_copy_only=False)
    if (leaf[1:] < leaf[:-1]).any():
        batch = batch.take(pa.array(np.argsort(leaf, kind="stable")))
    return batch


def _leaf_runs(batch: pa.RecordBatch) -> list[tuple[int, slice]]:
    """Each leaf's place in a batch that is sorted by leaf: its columns are a view."""
    leaf = batch.column("leaf").to_numpy(zero_copy_only=False)
    found, start = np.unique(leaf, return_index=True)
    return [(int(k), slice(int(lo), int(hi))) for k, lo, hi in zip(found, start, [*start[1:], len(leaf)])]


def _accumulate(layout: dict, cands: list[Candidate], centre: np.ndarray, scale: np.ndarray, form: Square | None = None, ordered: bool = False):
    """Task body: bank on each batch, leaf by leaf into the accumulators, then the packed partial sums. ``ordered`` rows come
    leaf by leaf, so the sums of a leaf are done when the next one begins."""

    form = form or Square(1 + len(centre))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple[int, int], np.ndarray] = {}
        counts: dict[int, int] = {}
        P = 1 + len(centre)

        p, factor = len(cands), 1.0 / scale
        fill, step = form.filler(cands, centre[:p], factor[:p]), form.rows_per_step()
        shift_y, factor_y = centre[p:, None], factor[p:, None]

        def standard(X, Y):
            """Columns as rows of U, shifted and scaled."""
            U = np.empty((P, X.shape[0]))
            U[0] = 1.0
            fill(X, U[1 : 1 + p])
            U[1 + p :] = (Y.T - shift_y) * factor_y
            return U

        def add(key, U):
            if key in acc:
                acc[key] += form.products(U)
            else:
                acc[key] = form.products(U)

        for whole in batches:
            whole = _sorted_by_leaf(whole)  # a step then meets few leaves
            for lo in range(0, whole.num_rows, step):
                batch = whole.slice(lo, step)
                runs = _leaf_runs(batch)
                U = standard(_matrix(batch, layout["x"], layout["d"]), _matrix(batch, layout["y"], 0))
                V = None
                if layout["lagged"]:
                    prev = standard(_matrix(batch, layout["px"], layout["d"]), _matrix(batch, layout["py"], 0))
                    phi, gain = _matrix(batch, ["phi"], 1).T, _matrix(batch, ["gain"], 1).T
                    V = gain * (U - np.where(phi == 0.0, 0.0, phi * np.nan_to_num(prev)))
                elif layout["weight"]:
                    V = U * np.sqrt(_matrix(batch, ["w"], 1)).T
                times = _matrix(batch, ["c"], 1)[:, 0] if layout["copies"] else None
                if times is not None:
                    U *= np.sqrt(times)
                    V = None if V is None else V * np.sqrt(times)
                for k, rows in runs:
                    if ordered and acc and k not in counts:
                        for item in form.packed(acc, counts):
                            yield record([item])
                        acc.clear()
                        counts.clear()
                    counts[k] = counts.get(k, 0) + int(rows.stop - rows.start if times is None else round(times[rows].sum()))
                    add((k, PLAIN), U[:, rows])
                    if V is not None:
                        add((k, WEIGHTED), V[:, rows])
        for item in form.packed(acc, counts):
            yield record([item])

    return run


# --------------------------------------------------------------------------------------------------------------
# Sum side


def _stream_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    acc: dict[tuple, list] = {}
    samples = 0
    for batch in batches:
        cols = batch.to_pydict()
        for leaf, kind, block, n, data in zip(*(cols[c] for c in ("leaf", "kind", "block", "n", "data"))):
            if leaf == SAMPLE:
                samples += 1
                if samples <= SAMPLE_PIECES:
                    yield record([(leaf, kind, block, n, data)])
                continue
            part = np.frombuffer(data)
            if (leaf, kind, block) in acc:
                acc[leaf, kind, block][0] += part
                acc[leaf, kind, block][1] += n
            else:
                acc[leaf, kind, block] = [part.copy(), n]
    for (leaf, kind, block), (data, n) in acc.items():
        yield record([(leaf, kind, block, n, data.tobytes())])


def sum_partials(partials: DataFrame, groups: int, fan_in: int = 1) -> DataFrame:
    """Add partial blocks per (leaf, kind, block). ``fan_in`` > 1 first sums within salted subgroups, so that with
    many thousands of map tasks no single reducer has to stream all their partials."""
    keys = ["leaf", "kind", "block"]
    return salted_sum(partials, groups, fan_in).repartition(groups, *keys).mapInArrow(_stream_sum, PARTIAL_SCHEMA)


def salted_sum(partials: DataFrame, groups: int, fan_in: int) -> DataFrame:
    """First level of a two-level sum; with one subgroup the partial sums are passed on as they are."""
    if fan_in <= 1:
        return partials
    salted = partials.withColumn("salt", F.spark_partition_id() % fan_in)
    keys = ["leaf", "kind", "block", "salt"]
    return salted.repartition(groups * fan_in, *keys).drop("salt").mapInArrow(_stream_sum, PARTIAL_SCHEMA)


def partial_moments(
    design: Design, cands: list[Candidate], centre: np.ndarray, scale: np.ndarray, max_tasks: int | None = None, form: Square | None = None
) -> DataFrame:
    """Packed sums of every task, not yet added up. ``max_tasks`` (``WAVES`` a core) bounds how many partial sums are
    shuffled, so that what a reducer reads depends on the cluster and the columns, not on the rows."""
    if design.serial:
        from gramlaw.operators.serial import entered

        design = entered(design)
    narrow = _dealt(design)
    narrow = narrow.coalesce(max_tasks or max(8, WAVES * narrow.sparkSession.sparkContext.defaultParallelism))
    return narrow.mapInArrow(_accumulate(_layout(design), cands, centre, scale, form), PARTIAL_SCHEMA)


def dealt_moments(design: Design, cands: list[Candidate], centre: np.ndarray, scale: np.ndarray, leaves: int) -> DataFrame:
    """As ``partial_moments`` for a bank so wide that a task cannot hold the sums of all ``leaves``. Rows are dealt by leaf,
    each leaf to as many tasks as keep all cores busy, and arrive sorted by it; a leaf's sums leave the task when its rows
    end. So a row is read once, and what is shuffled beside the rows are the sums of each leaf and not of each task and leaf."""
    cores = design.df.sparkSession.sparkContext.defaultParallelism
    each = -(-WAVES * cores // leaves)
    narrow = _narrow(design)
    part = F.pmod(F.xxhash64(*[F.col(c) for c in narrow.columns]), F.lit(each))
    narrow = narrow.withColumn("part", part).repartition(leaves * each, "leaf", "part").drop("part").sortWithinPartitions("leaf")
    return narrow.mapInArrow(_accumulate(_layout(design), cands, centre, scale, ordered=True), PARTIAL_SCHEMA)


def fan_in_for(df: DataFrame) -> tuple[int, int]:
    """Reducers and salted subgroups for adding up partial sums, from the size of the cluster."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(cores, 8), 1 if cores <= 64 else 16


def leaf_moments(design: Design, cands: list[Candidate], centre: np.ndarray, scale: np.ndarray) -> DataFrame:
    """Summed Gram blocks per leaf, still distributed."""
    groups, fan_in = fan_in_for(design.df)
    return sum_partials(partial_moments(design, cands, centre, scale), groups, fan_in)


def affine(M: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Moments of ``scale·(u - shift)`` given those of ``u``; both vectors start with the constant column (0 and 1)."""
    out = M - np.outer(shift, M[0]) - np.outer(M[0], shift) + np.outer(shift, shift) * M[0, 0]
    out *= scale[:, None]
    out *= scale[None, :]
    return out


@dataclass
class RawProfile:
    """First and second moments of the inputs and targets, plus a bounded row sample for working scales.

    ``inner`` holds them about ``mean`` and in units of ``sd``, where a large offset costs no digits; ``flat`` marks inputs
    whose least and largest value are equal.
    """

    inner: Moments
    mean: np.ndarray
    sd: np.ndarray
    flat: np.ndarray
    sample_x: np.ndarray
    sample_y: np.ndarray
    parts: dict[int, Moments] = field(default_factory=dict)  # ``inner`` of each leaf

    def training(self, fold: int) -> "RawProfile":
        """The profile of the rows outside ``fold``."""
        others = [m for k, m in self.parts.items() if k != fold]
        return replace(self, inner=sum(others[1:], others[0])) if others else self

    @property
    def moments(self) -> Moments:
        """The moments in raw units, for tables of sums."""
        back = lambda v, first: np.concatenate([[first], v])
        M = affine(self.inner.M, back(-self.mean / self.sd, 0.0), back(self.sd, 1.0))
        return Moments(M, self.inner.n, self.inner.p, self.inner.t)

    def corr(self, d: int) -> np.ndarray:
        return corrcoef_from(self.inner, d)

    def variances(self, d: int) -> np.ndarray:
        inner = np.maximum(np.diag(self.inner.covariance())[1 : 1 + d], 0.0)
        return np.where(self.flat, 0.0, inner * self.sd[:d] ** 2)

    def about_means(self) -> tuple[tuple[float, ...], "RawProfile"]:
        """The targets' means as origins, and the profile as a design with these origins has it."""
        t = self.inner.t
        origin = self.mean[-t:]
        mean = np.concatenate([self.mean[:-t], np.zeros(t)])
        return tuple(float(v) for v in origin), replace(self, mean=mean, sample_y=self.sample_y - origin)


def corrcoef_from(m: Moments, d: int, sample_factor: bool = True) -> np.ndarray:
    """Correlation matrix of the first ``d`` columns. With ``sample_factor`` the off-diagonals carry n/(n-1), as the
    covariance divides by n-1 while the deviations divide by n; constant columns give zero."""
    cov = m.covariance()[1 : 1 + d, 1 : 1 + d]
    sd = np.sqrt(np.maximum(np.diag(cov), 0.0))
    good = sd > 1e-12
    inv = np.where(good, 1.0 / np.where(good, sd, 1.0), 0.0)
    factor = m.n / max(m.n - 1, 1) if sample_factor else 1.0
    R = cov * factor * np.outer(inv, inv)
    np.fill_diagonal(R, good.astype(float))
    return R


def profile_inputs(design: Design, sample_rows: int = 4096) -> RawProfile:
    """One pass over the narrow columns: exact moments of inputs and targets and at most ``sample_rows`` rows in all.

    The sample only chooses the shift and scale in which the large Gram is accumulated; results do not depend on it
    beyond rounding, because the shift and scale are undone exactly.
    """
    d, t = design.d, len(design.targets)
    base = replace(design, weight=None, lagged=False, serial=0)
    layout = _layout(base)
    raw = [Candidate(f"x{i}", "unary", {"f": "x", "i": i}) for i in range(d)]
    narrow = _dealt(base)
    mean, sd, flat = _location(narrow, layout, d)
    keep_each = max(1, sample_rows // SAMPLE_PIECES)
    body = _accumulate(layout, raw, mean, sd)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        part = TaskContext.get().partitionId()
        sampling = part < SAMPLE_PIECES // 2 or part & (part - 1) == 0  # the first tasks and sparser later ones

        def tee():
            for batch in batches:
                if sampling and not kept and batch.num_rows:
                    step = max(1, batch.num_rows // keep_each)
                    head = batch.take(pa.array(range(0, batch.num_rows, step)[:keep_each]))
                    kept.append(np.hstack([_matrix(head, layout["x"], d), _matrix(head, layout["y"], 0)]))
                yield batch

        yield from body(tee())
        if kept:
            yield record([(SAMPLE, PLAIN, 0, 0, np.ascontiguousarray(kept[0]).tobytes())])

    parts = narrow.mapInArrow(run, PARTIAL_SCHEMA)
    rows = sum_partials(parts, groups=1, fan_in=fan_in_for(design.df)[1]).collect()
    parts = {leaf: Moments(G, count, d, t) for (leaf, _), (G, count) in unpack([r for r in rows if r["leaf"] >= 0], 1 + d + t).items()}
    inner = sum(parts.values(), Moments(np.zeros((1 + d + t, 1 + d + t)), 0, d, t))
    sample = np.vstack([np.frombuffer(r["data"]).reshape(-1, d + t) for r in rows if r["leaf"] < 0])
    return RawProfile(inner, mean, sd, flat, sample[:, :d], sample[:, d:], parts)


def profile_with(known: RawProfile, more: Design) -> RawProfile:
    """The profile ``known`` after the rows of ``more`` are added: in its means, units and row sample, as long as no input
    that was constant varies now. Both designs have the same columns and origin."""
    d, t = more.d, len(more.targets)
    base = replace(more, weight=None, lagged=False, serial=0)
    raw = [Candidate(f"x{i}", "unary", {"f": "x", "i": i}) for i in range(d)]
    sums = spread(_narrow(base)).mapInArrow(_accumulate(_layout(base), raw, known.mean, known.sd), PARTIAL_SCHEMA)
    rows = sum_partials(sums, groups=1, fan_in=fan_in_for(more.df)[1]).collect()
    parts = dict(known.parts)
    for (leaf, _), (G, count) in unpack(rows, 1 + d + t).items():
        added = Moments(G, count, d, t)
        parts[leaf] = parts[leaf] + added if leaf in parts else added
    return replace(known, inner=sum(parts.values(), Moments(np.zeros((1 + d + t, 1 + d + t)), 0, d, t)), parts=parts)


def table_with(known: GramTable, more: Design, prof: RawProfile) -> GramTable:
    """The moments ``known`` after the rows of ``more`` are added, in the same working shift and scale."""
    t = len(more.targets)
    centre, scale = np.concatenate([known.centre, prof.mean[-t:]]), np.concatenate([known.scale, prof.sd[-t:]])
    leaves = dict(known.leaves)
    for key, m in distinct_moments(more, known.cands, centre, scale).items():
        leaves[key] = leaves[key] + m if key in leaves else m
    return replace(known, leaves=leaves)


def _location(narrow: DataFrame, layout: dict, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and constancy of the (finite) inputs and the targets, by merged central moments."""
    x = [F.col("x")[j] for j in range(d)] if isinstance(layout["x"], str) else [F.col(c) for c in layout["x"]]
    cols = [finite(c) for c in x] + [F.col(c) for c in layout["y"]]
    of = lambda fn: F.array(*[fn(c) for c in cols])
    row = narrow.agg(F.count("*").alias("n"), of(F.mean).alias("mean"), of(F.stddev_pop).alias("sd"), of(F.min).alias("lo"), of(F.max).alias("hi")).first()
    if not row["n"]:
        raise ValueError("no rows with a target value")
    mean, sd = np.array(row["mean"], dtype=float), np.array(row["sd"], dtype=float)
    flat = np.array(row["lo"]) == np.array(row["hi"])
    mean = np.where(np.isfinite(mean), np.where(flat, np.array(row["lo"], dtype=float), mean), 0.0)
    return mean, np.where(np.isfinite(sd) & (sd > 0) & ~flat, sd, 1.0), flat[:d]


def working_scale(cands: list[Candidate], prof: RawProfile) -> tuple[np.ndarray, np.ndarray]:
    """Shift and scale for accumulation, from the profile's row sample."""
    V = np.hstack([evaluate(cands, prof.sample_x), prof.sample_y])
    mu, sd = V.mean(axis=0), V.std(axis=0)
    t = prof.inner.t
    mu[-t:], sd[-t:] = prof.mean[-t:], prof.sd[-t:]  # of all rows, not of the sample
    floor = np.maximum(1e-12, 1e-9 * np.abs(mu))
    return mu, np.where(sd > floor, sd, np.maximum(np.abs(mu), 1.0))


def raw_targets(M: np.ndarray, t: int, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Put the last ``t`` columns back into raw units."""
    shift, factor = np.zeros(M.shape[0]), np.ones(M.shape[0])
    factor[-t:] = scale[-t:]
    shift[-t:] = -centre[-t:] / scale[-t:]
    return affine(M, shift, factor)


def collect_moments(
    summed: DataFrame, p: int, t: int, centre: np.ndarray, scale: np.ndarray
) -> dict[tuple[int, int], Moments]:
    """Bring per-leaf sums to the driver: their size depends on the number of columns and leaves, never on rows."""
    P = 1 + p + t
    return {
        key: Moments(raw_targets(M, t, centre, scale), n, p, t) for key, (M, n) in unpack(summed.collect(), P).items()
    }


def distinct_moments(design: Design, cands: list[Candidate], centre: np.ndarray, scale: np.ndarray) -> dict[tuple[int, int], Moments]:
    """Moments per (leaf, kind), on the driver. Candidates whose columns are equal share the sums of one of them."""
    first, at = distinct_columns(cands)
    p, t = len(first), len(design.targets)
    own = np.array([*first, *range(len(cands), len(cands) + t)], dtype=int)
    kept = [cands[j] for j in first]
    found = collect_moments(leaf_moments(design, kept, centre[own], scale[own]), p, t, centre[own], scale[own])
    back = np.array([0, *(1 + at), *range(1 + p, 1 + p + t)], dtype=int)
    return {key: Moments(m.M[np.ix_(back, back)], m.n, len(cands), t) for key, m in found.items()}


@dataclass
class GramTable:
    """Moments of a bank per (leaf, kind) with the working shift and scale of its candidates."""

    cands: list[Candidate]
    centre: np.ndarray
    scale: np.ndarray
    leaves: dict[tuple[int, int], Moments]
    trained: dict[tuple[int, int], Moments] | None = None  # of each fold's training rows, where no sum of leaves gives them
    whole: dict[int, Moments] | None = None
    banks: dict[int | None, np.ndarray] | None = None  # candidates that a fold may use; None: those of all rows

    def total(self, kind: int = PLAIN) -> Moments:
        if self.whole is not None:
            return self.whole[kind]
        parts = [m for (_, k), m in self.leaves.items() if k == kind]
        out = parts[0]
        for m in parts[1:]:
            out = out + m
        return out


def gram(design: Design, cands: list[Candidate], prof: RawProfile | None = None) -> GramTable:
    """Moments per (leaf, kind) of a bank; kind is ``PLAIN`` or ``WEIGHTED``."""
    prof = prof or profile_inputs(design)
    centre, scale = working_scale(cands, prof)
    summed = leaf_moments(design, cands, centre, scale)
    leaves = collect_moments(summed, len(cands), len(design.targets), centre, scale)
    return gram_table(design, cands, centre, scale, leaves)


def gram_table(design: Design, cands: list[Candidate], centre: np.ndarray, scale: np.ndarray, leaves: dict) -> GramTable:
    table = GramTable(cands, centre[: len(cands)], scale[: len(cands)], leaves)
    if not design.serial:
        return table
    from gramlaw.operators.serial import by_fold

    return by_fold(table, design.serial)

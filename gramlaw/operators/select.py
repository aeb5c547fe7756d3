"""Greedy searches on moments: forward atoms, evidence-scored operator set, grammar blocks."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from gramlaw.functions.scores import criterion, ebic_bits, mdl_bits
from gramlaw.operators.algebra import (
    FoldView,
    centred,
    residual_square,
    residualize,
    ridge,
    small,
    total_square,
)
from gramlaw.operators.catalog import Candidate
from gramlaw.plans.options import Options

RANK_TOL = 1e-10
TIE = 1e-9
RSS_FLOOR = 1e-12  # share of the total below which a residual is rounding of the moments; an exact law counts as this


# --------------------------------------------------------------------------------------------------------------
# Forward atoms


@dataclass
class Alphabet:
    """Chosen atoms in order; the rows of ``A`` express the residualized, scaled features in the view's columns."""

    chosen: list[int]
    A: np.ndarray
    score: float
    mse: float
    steps: list[dict] = field(default_factory=list)


def _score(rss, n, opt: Options, bits: float):
    return n * np.log(np.maximum(rss, 0.0) / max(1, n) + 1e-9) + opt.bit_weight * bits


def _rows_of(A: np.ndarray, M: np.ndarray) -> np.ndarray:
    """``A @ M``, reading only the rows of ``M`` for columns that ``A`` has."""
    at = np.flatnonzero(A.any(axis=0))
    return A[:, at] @ M[at]


def forward_atoms(view: FoldView, opt: Options) -> Alphabet:
    """Add the candidate whose residual lowers the validation score most; stop at the first step without gain.

    All candidates are scored at once from the cross moments of the chosen features with every column, so a step costs
    a few small products instead of a refit per candidate.
    """
    if opt.criterion.upper() != "MDL":
        raise ValueError("forward search scores by MDL")
    p, y = view.p, view.y
    z = slice(1, 1 + p)
    A = np.zeros((0, p + 2))
    ends = np.zeros((2, p + 2))
    ends[0, 0] = ends[1, y] = 1.0
    K = small(view.tr, A, y)
    w, b0 = ridge(K, opt.alpha)
    best = float(_score(residual_square(small(view.va, A, y), w, b0), view.n_va, opt, mdl_bits("atomic", 0, 0, opt.type_bits)))
    mse = residual_square(small(view.va_plain, A, y), w, b0) / view.n_va
    out = Alphabet([], A, best, mse)
    diag_tr, diag_va = view.tr.diagonal()[z], view.va.diagonal()[z]
    total_w = view.tr[0, 0]
    denom = total_w + (1e-12 if view.weighted else 0.0)
    base = view.tr_plain if opt.rdmp_ols else view.tr
    open_ = view.live.copy()
    while len(out.chosen) < opt.max_atoms:
        A = out.A
        k = len(A)
        C = _rows_of(A, view.tr)
        AB = C if base is view.tr else _rows_of(A, base)
        Gamma = residualize(AB @ A.T, AB[:, z], opt.rdmp_alpha)
        FF, Fz = C @ A.T, C[:, z]
        norm2 = np.maximum(diag_tr - 2 * (Gamma * Fz).sum(0) + (Gamma * (FF @ Gamma)).sum(0), 0.0)
        ok = open_.copy()
        if k:
            ok &= ~(1.0 - np.sqrt(norm2) / (np.sqrt(np.maximum(diag_tr, 0)) + 1e-12) > opt.dup_threshold)
        sum_r = view.tr[0, z] - Gamma.T @ C[:, 0]
        mu = sum_r / denom
        var = np.maximum((norm2 - 2 * mu * sum_r + mu**2 * total_w) / denom, 0.0)
        ok &= var > 1e-15
        sd = np.maximum(np.sqrt(var), 1e-6) if view.weighted else np.where(var < 1e-24, 1.0, np.sqrt(var))
        if not ok.any():
            break
        muK, S = centred(small(view.tr, A, y))
        muF, mu_y = muK[:k], muK[k]
        c = (Fz - FF @ Gamma - np.outer(muF, sum_r)) / sd
        v = (norm2 - mu * sum_r) / sd**2
        g = (view.tr[y, z] - Gamma.T @ C[:, y] - mu_y * sum_r) / sd
        inv = np.linalg.inv(S[:k, :k] + opt.alpha * np.eye(k)) if k else np.zeros((0, 0))
        wF0 = inv @ S[:k, k]
        Pc = inv @ c
        wr = (g - c.T @ wF0) / (v + opt.alpha - (c * Pc).sum(0))
        wF = wF0[:, None] - Pc * wr
        b0s = mu_y - muF @ wF
        E = np.vstack([ends[:1], A, ends[1:]])
        CV = _rows_of(E, view.va)
        Kva, kz = CV @ E.T, CV[:, z]
        H = np.vstack([-b0s + mu * wr / sd, -wF + Gamma * (wr / sd), np.ones(p)])
        tz = -wr / sd
        rss = (H * (Kva @ H)).sum(0) + 2 * tz * (H * kz).sum(0) + tz**2 * diag_va
        scores = np.where(ok, _score(rss, view.n_va, opt, mdl_bits("atomic", 0, k + 1, opt.type_bits)), np.inf)
        j = first_best(-scores)
        row = (view.unit(j) - Gamma[:, j] @ A) / sd[j]
        row[0] -= mu[j] / sd[j]
        A2 = np.vstack([A, row])
        w, b0 = ridge(small(view.tr, A2, y), opt.alpha)
        new_mse = residual_square(small(view.va_plain, A2, y), w, b0) / view.n_va
        if not (scores[j] < out.score - 1e-8 or new_mse < out.mse - opt.min_mse_gain):
            break
        open_[j] = False
        step = dict(idx=j, Gamma=Gamma[:, j].tolist(), mu=float(mu[j]), sd=float(sd[j]), score=float(scores[j]), mse=float(new_mse))
        out = Alphabet([*out.chosen, j], A2, float(scores[j]), float(new_mse), [*out.steps, step])
    return out


# --------------------------------------------------------------------------------------------------------------
# Evidence-scored operator set


@dataclass
class Operator:
    name: str
    idx: int
    coeff: float
    stderr: float
    bits: float
    rank: int
    freq: float = 1.0


@dataclass
class OperatorSet:
    intercept: float
    ops: list[Operator]
    selected: list[int]
    bits_path: list[float]
    rss_path: list[float]
    r2_path: list[float]
    rss: float
    r2_train: float
    cond: float
    r2_val: float | None = None
    entry: list[tuple[float, float]] = field(default_factory=list)  # coefficient and error of each pick when it entered


def sized_defaults(n: int, opt: Options) -> tuple[float, int, float]:
    """Evidence threshold, operator limit and EBIC gamma, stricter for small tables."""
    few = n <= 500
    return (
        opt.bits_threshold if opt.bits_threshold is not None else (0.8 if few else 0.6),
        opt.max_ops if opt.max_ops is not None else (10 if few else 16),
        opt.ebic_gamma if opt.ebic_gamma is not None else (0.25 if few else 0.0),
    )


def first_best(values: np.ndarray) -> int:
    """The first of the largest values; what differs by rounding only is equal, so that equal columns give the first of
    them whatever shift and scale the moments were summed in."""
    top = float(np.max(values))
    return int(np.argmax(values >= top - TIE * (1.0 + abs(top)))) if np.isfinite(top) else int(np.argmax(values))


def greedy_operators(
    M: np.ndarray, n: int, live: np.ndarray, opt: Options, limit: int | None = None, intercept: bool = True
) -> tuple[list[int], list[float], list[float], float, list[tuple[float, float]]]:
    """Forward selection by EBIC gain in bits on the moments ``M`` of ``(1, candidates, y)``.

    Columns are brought to unit norm; after each pick the remaining columns are reduced by its component, so the
    residual of adding any candidate is one division. Returns picks, gains, residual sums, the intercept, and the
    coefficient and standard error (unit norm) of each pick when it entered.
    """
    threshold, max_ops, gamma = sized_defaults(n, opt)
    max_ops = limit if limit is not None else max_ops
    p = len(live)
    z, y = slice(1, 1 + p), p + 1
    mu = float(M[0, y] / max(M[0, 0], 1e-12)) if intercept else 0.0
    k0 = 1 if intercept else 0
    norms = np.sqrt(np.maximum(M.diagonal()[z], 0.0))
    safe = np.where(norms > 0, norms, 1.0)
    b = (M[z, y] - mu * M[z, 0]) / safe
    rss = max(float(M[y, y] - 2 * mu * M[0, y] + mu * mu * M[0, 0]), 0.0)
    p_live = int(live.sum())
    floor = RSS_FLOOR * rss
    current = float(ebic_bits(rss, n, k0, p_live, gamma))
    open_ = live & (norms > 0)
    V = np.zeros((0, p))
    left = (norms > 0).astype(float)
    picks, gains, path, entry = [], [], [rss], []
    near = np.zeros(p)
    while len(picks) < max_ops and open_.any():
        drop = np.where(left > RANK_TOL, b**2 / np.maximum(left, RANK_TOL), 0.0)
        gain = ebic_bits(np.maximum(rss - drop, floor), n, k0 + len(picks) + 1, p_live, gamma) - current
        gain = np.where(open_ & (near <= opt.max_corr), gain, -np.inf)
        j = first_best(gain)
        if gain[j] <= 0.0 or gain[j] < threshold:
            break
        column = M[1 + j, z] / (safe[j] * safe)
        near = np.maximum(near, np.abs(column))
        length = np.sqrt(left[j])
        direction = (column - V.T @ V[:, j]) / length
        beta = b[j] / length
        V = np.vstack([V, direction])
        b = b - beta * direction
        left = np.maximum(left - direction**2, 0.0)
        rss = max(rss - float(beta) ** 2, floor)
        current += float(gain[j])
        open_[j] = False
        picks.append(j)
        gains.append(float(gain[j]))
        path.append(rss)
        sigma2 = rss / max(n - (k0 + len(picks)), 1)
        entry.append((float(beta / length / safe[j]), float(np.sqrt(sigma2) / length / safe[j])))
    return picks, gains, path, mu, entry


def refit(M: np.ndarray, n: int, picks: list[int], mu: float, intercept: bool = True):
    """Least squares of y - mu on the picked columns in the noise geometry, with standard errors."""
    y = M.shape[0] - 1
    idx = [1 + j for j in picks]
    G = M[np.ix_(idx, idx)]
    b = M[idx, y] - mu * M[idx, 0]
    total = max(float(M[y, y] - 2 * mu * M[0, y] + mu * mu * M[0, 0]), 0.0)
    if not picks:
        return np.zeros(0), np.zeros(0), total, total, float("nan")
    beta = np.linalg.lstsq(G, b, rcond=None)[0]
    rss = max(float(total - 2 * beta @ b + beta @ G @ beta), 0.0)
    sigma2 = rss / max(n - (int(intercept) + len(picks)), 1)
    se = np.sqrt(np.clip(np.diag(np.linalg.pinv(G, rcond=1e-12)) * sigma2, 0.0, None))
    return beta, se, rss, total, float(np.linalg.cond(G))


def operator_set(view: FoldView, names: list[str], opt: Options, intercept: bool = True) -> OperatorSet:
    picks, gains, path, mu, entry = greedy_operators(view.tr, view.n_tr, view.live, opt, intercept=intercept)
    out = _finish(view, names, picks, gains, path, mu, {}, intercept)
    out.entry = entry
    start = float(ebic_bits(path[0], view.n_tr, int(intercept), int(view.live.sum()), sized_defaults(view.n_tr, opt)[2]))
    out.bits_path = [start + b for b in out.bits_path]
    return out


def _finish(view, names, picks, gains, path, mu, freq, intercept=True) -> OperatorSet:
    beta, se, rss, total, cond = refit(view.tr, view.n_tr, picks, mu, intercept)
    y = view.y
    ops = [
        Operator(names[j], j, float(c), float(s), g, r + 1, freq.get(j, 1.0))
        for r, (j, c, s, g) in enumerate(zip(picks, beta, se, gains))
    ]
    yy = float(view.tr[y, y]) + 1e-300
    r2_val = None
    if picks:
        A = np.array([view.unit(j) for j in picks])
        Kv = small(view.va_plain, A, y)
        r2_val = 1.0 - residual_square(Kv, beta, mu) / max(total_square(Kv), 1e-300)
    return OperatorSet(
        mu, ops, list(picks), list(np.cumsum([0.0, *gains])), path, [1.0 - r / yy for r in path],
        rss, 1.0 - rss / max(total, 1e-300), cond, r2_val,
    )


def with_frequency(view: FoldView, names: list[str], og: OperatorSet, counts: dict[int, int], boots: int, opt: Options) -> OperatorSet:
    """Attach subsample frequencies, drop operators picked too rarely, and refit the rest."""
    freq = {j: counts.get(j, 0) / boots for j in og.selected}
    kept = [op for op in og.ops if opt.min_freq <= 0 or freq[op.idx] >= opt.min_freq]
    out = _finish(view, names, [o.idx for o in kept], [o.bits for o in kept], og.rss_path, og.intercept, freq)
    ranks = {o.idx: o.rank for o in kept}
    out.ops = [replace(o, rank=ranks[o.idx]) for o in out.ops]
    out.bits_path, out.rss_path, out.r2_path, out.entry = og.bits_path, og.rss_path, og.r2_path, og.entry
    return out


# --------------------------------------------------------------------------------------------------------------
# Grammar blocks


@dataclass(frozen=True)
class Block:
    """Columns offered together. ``n_reals`` counts the numbers needed to describe the block."""

    kind: str
    cands: tuple[Candidate, ...]
    n_reals: int


@dataclass
class Growth:
    A: np.ndarray
    score: float
    mse: float
    accepted: list[int]


def fit_with(view: FoldView, A: np.ndarray, opt: Options):
    """Ridge on features ``A``: weights, intercept, validation χ² and plain mean square error."""
    w, b0 = ridge(small(view.tr, A, view.y), opt.alpha)
    chi2 = residual_square(small(view.va, A, view.y), w, b0)
    mse = residual_square(small(view.va_plain, A, view.y), w, b0) / max(view.n_va, 1)
    return w, b0, chi2, mse


def residual_block(view: FoldView, A: np.ndarray, columns: list[int], opt: Options) -> np.ndarray:
    """Raw block columns minus their part explained by ``A``, centred and scaled in the training geometry."""
    B = np.array([view.raw(j) for j in columns])
    base = view.tr_plain if opt.rdmp_ols else view.tr
    R = B - residualize(A @ base @ A.T, A @ base @ B.T, opt.rdmp_alpha).T @ A
    total_w = view.tr[0, 0]
    denom = total_w + (1e-12 if view.weighted else 0.0)
    sums = R @ view.tr[:, 0]
    mu = sums / denom
    var = np.maximum((np.einsum("ij,jk,ik->i", R, view.tr, R) - 2 * mu * sums + mu**2 * total_w) / denom, 0.0)
    sd = np.maximum(np.sqrt(var), 1e-6) if view.weighted else np.where(var < 1e-24, 1.0, np.sqrt(var))
    R[:, 0] -= mu
    return R / sd[:, None]


def start_growth(view: FoldView, A: np.ndarray, opt: Options) -> Growth:
    _, _, chi2, mse = fit_with(view, A, opt)
    bits = mdl_bits("atomic", 0, len(A), opt.type_bits)
    return Growth(A, criterion(chi2, view.n_va, len(A) + 1, "MDL", bits, opt.bit_weight), mse, [])


def offer(view: FoldView, g: Growth, kind: str, n_reals: int, columns: list[int], opt: Options, rule: str, tag: int) -> Growth:
    """Accept a block if it pays for its bits. ``rule``: "both" needs a lower score and no worse error; "either" takes
    a lower score or a clearly lower error."""
    k = len(g.A) + len(columns) + 1
    if k >= view.n_tr - 1:
        return g
    A2 = np.vstack([g.A, residual_block(view, g.A, columns, opt)])
    _, _, chi2, mse = fit_with(view, A2, opt)
    bits = mdl_bits(kind, n_reals, len(columns), opt.type_bits) + mdl_bits("atomic", 0, len(g.A), opt.type_bits)
    score = criterion(chi2, view.n_va, k, "MDL", bits, opt.bit_weight)
    lower = score < g.score - 1e-6
    accept = (lower and mse <= g.mse + 1e-4) if rule == "both" else (lower or mse < g.mse - 1e-3)
    return Growth(A2, score, mse, [*g.accepted, tag]) if accept else g


def grow_grammar(view: FoldView, A: np.ndarray, blocks: list[tuple[Block, list[int]]], opt: Options) -> Growth:
    g = start_growth(view, A, opt)
    rule = "both" if opt.grammar_needs_both else "either"
    for tag, (block, columns) in enumerate(blocks):
        g = offer(view, g, block.kind, block.n_reals, columns, opt, rule, tag)
    return g

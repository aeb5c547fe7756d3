"""Expression-graph refinement: grow products and tune parameters, scoring whole generations from one moment pass.

Every generation gathers once what its proposals add to the moments of the graphs they grew out of (``borders``), and
scores each proposal by small algebra: fit on the training rows, loss on the validation rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from gramlaw.operators import select
from gramlaw.operators.algebra import FoldView, centred, residual_square, split_views, whole_view
from gramlaw.operators.borders import GraphSums
from gramlaw.operators.catalog import Candidate
from gramlaw.operators.gram import Design, GramTable, RawProfile, gram
from gramlaw.operators.graphs import Graph, graph_pool, node_candidate, product_of, seed_graph
from gramlaw.plans.options import Options

MAX_FRONTIER, FRONTIER_STEP, PROPOSAL_STEP = 40, 4, 5  # fixed values
TUNE_ROUNDS, TUNE_STEP = 8, 0.2  # fixed values


def flipped(cand: Candidate, inputs: tuple[int, ...]) -> Candidate:
    """The same graph column with some inputs negated."""

    def swap(node):
        if isinstance(node, int):
            return ["sub", {}, [["sub", {}, [node, node]], node]] if node in inputs else node
        return [node[0], node[1], [swap(p) for p in node[2]]]

    return node_candidate(swap(cand.args["node"]))


def picked(M: np.ndarray, columns: list[int]) -> np.ndarray:
    """Moments of ``(1, columns, y)``; a view's columns are already centred and scaled on the training rows."""
    if columns == list(range(M.shape[0] - 2)):
        return M
    idx = [0, *(1 + j for j in columns), M.shape[0] - 1]
    return M[np.ix_(idx, idx)]


@dataclass
class Scorer:
    """Energies of graphs on one view. ``at`` maps a column name to its position."""

    view: FoldView
    at: dict[str, int]
    opt: Options

    def weights(self, columns: list[int]):
        K = picked(self.view.tr, columns)
        mu, S = centred(K)
        k = len(columns)
        w = np.linalg.solve(S[:k, :k] + self.opt.alpha * np.eye(k), S[:k, k])
        return w, float(mu[k] - mu[:k] @ w)

    def loss(self, columns: list[int]) -> float:
        """Mean square (or mean χ²) on validation of a fit on training."""
        w, b0 = self.weights(columns)
        return residual_square(picked(self.view.va, columns), w, b0) / max(self.view.n_va, 1)

    def redundancy(self, columns: list[int]) -> float:
        """Mean absolute off-diagonal correlation of the outputs, from the full validation moments."""
        k = len(columns)
        if k <= 1:
            return 0.0
        K = picked(self.view.va_plain, columns)
        _, S = centred(K)
        sd = np.sqrt(np.maximum(np.diag(S)[:k], 0.0))
        inv = np.where(sd > 1e-12, 1.0 / np.where(sd > 1e-12, sd, 1.0), 0.0)
        n = max(self.view.n_va, 2)
        R = np.abs(S[:k, :k] * np.outer(inv, inv)) * n / (n - 1)
        np.fill_diagonal(R, 0.0)
        return float(R.sum() / (k * (k - 1)))

    def flip_shift(self, graph: Graph, columns: list[int]) -> float:
        """Root mean square change of the fitted values when inputs change sign, over the deviation of y.

        A mean absolute change is not a moment; the root mean square is, and bounds it from above.
        """
        if not self.opt.flip_inputs:
            return 0.0
        w, _ = self.weights(columns)
        other = [self.at[flipped(node_candidate(o), self.opt.flip_inputs).name] for o in graph.outputs]
        w2, _ = self.weights(other)
        K = picked(self.view.va_plain, [*columns, *other])
        q = np.concatenate([[0.0], w, -w2, [0.0]])
        _, S = centred(K)
        sd_y = np.sqrt(max(S[-1, -1], 0.0) / max(self.view.n_va, 1)) + 1e-8
        return float(np.sqrt(max(q @ K @ q, 0.0) / max(self.view.n_va, 1)) / sd_y)

    def energy(self, graph: Graph) -> float:
        """Weighted loss, redundancy, description length and sign-flip change. Reordering the parents of a commutative
        operator does not change any value here, so the order penalty is zero."""
        columns = [self.at[node_candidate(o).name] for o in graph.outputs]
        live = [j for j in columns if self.view.live[j]]
        if not live:
            return float("inf")
        o = self.opt
        value = o.energy_loss * self.loss(live) + o.energy_redundancy * self.redundancy(live) + o.energy_mdl * graph.bits() / 1e4
        return float(value + (o.energy_flip * self.flip_shift(graph, columns) if o.flip_inputs else 0.0))


def move_distances(graphs: list[Graph]) -> np.ndarray:
    """Between every two graphs: the share of their kinds of consecutive moves that only one of them has made."""
    kinds: dict[tuple[str, str], int] = {}
    made = [{kinds.setdefault(pair, len(kinds)) for pair in zip(g.history, g.history[1:])} for g in graphs]
    has = np.zeros((len(graphs), max(1, len(kinds))))
    for row, which in zip(has, made):
        row[list(which)] = 1.0
    both = has @ has.T
    either = has.sum(1)[:, None] + has.sum(1)[None, :] - both
    return np.where(either > 0, 1.0 - both / np.maximum(either, 1.0), 0.0)


def diverse_best(scored: list[tuple[Graph, float]], k: int) -> list[tuple[Graph, float]]:
    """The graph of least energy, then one by one the graph whose moves differ most from all kept (less energy first on ties)."""
    order = np.argsort([e for _, e in scored], kind="stable")
    if len(order) <= k:
        return [scored[j] for j in order]
    far = move_distances([scored[j][0] for j in order])
    kept = [0]
    nearest = far[0].copy()
    nearest[0] = -1.0
    while len(kept) < k:
        kept.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, far[kept[-1]])
        nearest[kept] = -1.0
    return [scored[order[j]] for j in kept]


def columns_of(graphs: list[Graph], opt: Options) -> list[Candidate]:
    pool: dict[str, Candidate] = {}
    for g in graphs:
        for o in g.outputs:
            c = node_candidate(o)
            pool.setdefault(c.name, c)
            if opt.flip_inputs:
                f = flipped(c, opt.flip_inputs)
                pool.setdefault(f.name, f)
    return list(pool.values())


def view_of(table: GramTable, fold: int, target: int, whole: bool) -> FoldView:
    return whole_view(table, target) if whole else split_views(table, target, fold)[0][1]


@dataclass
class Generations:
    """Scorers of graphs on one design; every call of ``gather`` is one pass over the rows."""

    sums: GraphSums
    opt: Options
    whole: bool

    @staticmethod
    def of(design: Design, prof: RawProfile, opt: Options, whole: bool) -> "Generations":
        return Generations(GraphSums(design, prof, lambda g: columns_of([g], opt)), opt, whole)

    def gather(self, pairs: list[tuple[Graph, Graph | None]]) -> None:
        self.sums.gather(pairs)

    def scorer(self, graph: Graph, key: tuple[int, int]) -> Scorer:
        fold, target = key
        view = self.sums.view(graph, None if self.whole else fold, target)
        return Scorer(view, {c.name: j for j, c in enumerate(self.sums.columns(graph))}, self.opt)

    def energies(self, graphs: dict) -> dict:
        """Energies per key ``(fold, target)`` of that key's graphs."""
        return {key: [(g, self.scorer(g, key).energy(g)) for g in gs] for key, gs in graphs.items()}

    def loss(self, graph: Graph, key: tuple[int, int]) -> float:
        s = self.scorer(graph, key)
        return s.loss([s.at[node_candidate(o).name] for o in graph.outputs])


def retuned(g: Graph, node, name: str, delta: float) -> Graph:
    """The graph with one parameter of one node moved."""
    return g.replaced(node, [node[0], {**node[1], name: node[1][name] + delta}, node[2]], f"opt:{node[0]}")


def tune(design: Design, start: dict, prof: RawProfile, opt: Options, whole: bool, over: Generations | None = None) -> dict:
    """Coordinate search on the parameters of each key's graph: try ±step on every parameter in one pass per round,
    keep the best single change, halve the step; stop when no key improves."""
    over = over or Generations.of(design, prof, opt, whole)
    best = dict(start)
    step = TUNE_STEP
    for turn in range(TUNE_ROUNDS):
        trials = {
            key: [g, *[retuned(g, node, name, delta) for node in g.tunable() for name in node[1] for delta in (step, -step)]]
            for key, g in best.items()
        }
        if all(len(v) == 1 for v in trials.values()):
            break
        if turn == 0:
            over.gather([(g, None) for g in best.values()])
        over.gather([(new, gs[0]) for gs in trials.values() for new in gs])
        improved = False
        for key, gs in trials.items():
            losses = [over.loss(g, key) for g in gs]
            j = int(np.argmin(losses))
            if j > 0 and losses[j] < losses[0]:
                best[key] = gs[j]
                improved = True
        step *= 0.5
        if not improved:
            break
    return best


def proposal(g: Graph, rng: np.random.Generator, tuning: bool) -> Graph:
    """A random move: the product of two nodes or, if asked for and there are parameters, a change of one of them, each as
    often. The steps are those of ``tune``."""
    nodes = g.tunable() if tuning else []
    if nodes and rng.random() < 0.5:
        node = nodes[int(rng.integers(len(nodes)))]
        name = sorted(node[1])[int(rng.integers(len(node[1])))]
        step = TUNE_STEP * 0.5 ** int(rng.integers(TUNE_ROUNDS))
        return retuned(g, node, name, step if rng.random() < 0.5 else -step)
    return g.grown(product_of(g, rng), "add_mul")


def search_graphs(
    design: Design, keys: list[tuple[int, int]], prof: RawProfile, opt: Options, whole: bool, over: Generations | None = None
) -> dict[tuple[int, int], Graph]:
    """Beam over graphs per key. The graphs of all folds and targets share the pass of a generation, which gathers the
    products of a proposal's new columns with its own columns only. With ``refine_tune`` the beam starts from tuned seeds
    and tunes on as it grows."""
    over = over or Generations.of(design, prof, opt, whole)
    seed = seed_graph(design.d)
    seeds = {key: seed for key in keys}
    if opt.refine_tune:
        seeds = tune(design, seeds, prof, opt, whole, over)
    over.gather([(g, None) for g in seeds.values()])
    frontier = over.energies({k: [g] for k, g in seeds.items()})
    best = {k: v[0] for k, v in frontier.items()}
    seen = {k: {seeds[k].key()} for k in keys}
    width, proposals = opt.refine_frontier, opt.refine_proposals
    for generation in range(opt.refine_depth):
        rng = np.random.default_rng([opt.seed, generation])
        proposed: dict[tuple[int, int], list[Graph]] = {}
        pairs = []
        for k in keys:
            for g, _ in frontier[k]:
                if len(graph_pool(g)) < 2:
                    continue
                for _ in range(proposals):
                    new = proposal(g, rng, opt.refine_tune)
                    if new.key() not in seen[k]:
                        seen[k].add(new.key())
                        proposed.setdefault(k, []).append(new)
                        pairs.append((new, g))
        if not proposed:
            break
        over.gather(pairs)
        stalled = True
        for k, values in over.energies(proposed).items():
            frontier[k] = diverse_best(values, width)
            top = min(frontier[k], key=lambda t: t[1])
            if top[1] < best[k][1] - 1e-6:
                best[k] = top
                stalled = False
        over.sums.keep([g for values in frontier.values() for g, _ in values])
        if stalled:
            width, proposals = min(width + FRONTIER_STEP, MAX_FRONTIER), min(proposals + PROPOSAL_STEP, MAX_FRONTIER)
    return {k: g for k, (g, _) in best.items()}


def top_outputs(view: FoldView, columns: list[int], k: int) -> list[int]:
    """The ``k`` columns most correlated with y on validation."""
    K = picked(view.va_plain, columns)
    _, S = centred(K)
    sd = np.sqrt(np.maximum(np.diag(S), 0.0))
    corr = np.abs(S[:-1, -1]) / (sd[:-1] * sd[-1] + 1e-12)
    return [columns[j] for j in np.argsort(-corr, kind="stable")[:k]]


def refine_fits(design: Design, fits: dict, prof: RawProfile, opt: Options, whole: bool) -> None:
    """Search graphs for every fit and add the best graph's outputs if they pay; updates the fits in place."""
    from gramlaw.plans.search import _carry

    graphs = search_graphs(design, list(fits), prof, opt, whole)
    pool: dict[str, Candidate] = {}
    for f in fits.values():
        for j in np.flatnonzero(np.abs(f.A[:, 1:-1]).sum(0)):
            pool.setdefault(f.cands[j].name, f.cands[j])
    for g in graphs.values():
        for c in g.outputs_as_candidates():
            pool.setdefault(c.name, c)
    cands = list(pool.values())
    at = {n: j for j, n in enumerate(pool)}
    table = gram(design, cands, prof)
    for key, f in fits.items():
        view = view_of(table, *key, whole)
        A = _carry(f.A, f.view, view, [at.get(c.name, -1) for c in f.cands])
        columns = list(dict.fromkeys(at[c.name] for c in graphs[key].outputs_as_candidates()))
        columns = [j for j in columns if view.live[j]]
        if len(columns) > opt.refine_keep:
            columns = top_outputs(view, columns, opt.refine_keep)
        start = select.start_growth(view, A, opt)
        grown = select.offer(view, start, "graph", 1, columns, opt, "either", 0) if columns else start
        w, b0, _, _ = select.fit_with(view, grown.A, opt)
        if grown.accepted:
            f.blocks = [*f.blocks, "graph"]
            f.kept += "+graph"
        f.A, f.w, f.b0, f.view, f.cands = grown.A, w, b0, view, cands


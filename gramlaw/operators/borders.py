"""Moments of many graphs that differ from a known one by a few columns.

A graph that grew out of another shares all columns with it but the new ones. Only the products of the new columns with
the graph's own columns are gathered: a border of the parent's moments. All graphs of a generation share one pass and one
dictionary of nodes, so a sub-expression that several of them use is computed once a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

from gramlaw.functions.atoms import REGISTRY, finite_array
from gramlaw.operators.algebra import CONSTANT_SD, FoldView, split_views, whole_view
from gramlaw.operators.catalog import Candidate
from gramlaw.operators.gram import (
    BLOCK_BYTES,
    PLAIN,
    ROWS_PER_STEP,
    WEIGHTED,
    Design,
    GramTable,
    Moments,
    RawProfile,
    Square,
    fan_in_for,
    gram_table,
    partial_moments,
    raw_targets,
    sum_partials,
    working_scale,
)
from gramlaw.operators.graphs import Graph, key_of

STEP_BYTES = 16 << 20  # of a batch's columns
ROOT = ""  # the graph without outputs


def value_key(node) -> str:
    """Equal for nodes that are equal to the last digit: the order in which a commutative operator takes its parents does not
    matter."""
    if isinstance(node, int):
        return f"x{node}"
    op, params, parents = node
    keys = [value_key(p) for p in parents]
    return f"{op}{params}({','.join(sorted(keys) if REGISTRY[op].commutative else keys)})"


class NodeDictionary:
    """Every distinct sub-expression of some graph columns once, parents before users."""

    def __init__(self, cands: list[Candidate]):
        self.slots: dict[str, int] = {}
        self.steps: list[tuple] = []
        self.outputs = [self._place(c.args["node"]) for c in cands]
        self.rows: dict[int, list[int]] = {}  # of the output array, by slot
        for row, slot in enumerate(self.outputs):
            self.rows.setdefault(slot, []).append(row)
        self.read = {p for _, _, parents in self.steps for p in parents}

    def _place(self, node) -> int:
        key = key_of(node)
        if key not in self.slots:
            step = (None, node, ()) if isinstance(node, int) else (node[0], node[1], tuple(self._place(p) for p in node[2]))
            self.slots[key] = len(self.steps)
            self.steps.append(step)
        return self.slots[key]

    def fill(self, X: np.ndarray, out: np.ndarray, shift: np.ndarray, factor: np.ndarray) -> None:
        """The columns of a batch, shifted and scaled, as rows of ``out``; each is finished while it is in the cache."""
        XT = np.ascontiguousarray(X.T)
        values: list[np.ndarray | None] = []
        with np.errstate(all="ignore"):
            for slot, (op, what, parents) in enumerate(self.steps):
                v = XT[what] if op is None else REGISTRY[op].array(*[values[p] for p in parents], **what)
                values.append(v if slot in self.read else None)
                for row in self.rows.get(slot, ()):
                    np.subtract(finite_array(v), shift[row], out=out[row])
                    out[row] *= factor[row]


def _at(which: np.ndarray) -> np.ndarray | slice:
    """The same rows, as a slice where they lie side by side: taking them is then a view."""
    return slice(int(which[0]), int(which[-1]) + 1) if len(which) and (np.diff(which) == 1).all() else which


class Borders(Square):
    """Products of given sets of rows of U with given sets of columns, the squares of some rows, and the products of given
    pairs of rows, laid end to end."""

    def __init__(self, columns: int, pieces: list[tuple[np.ndarray, np.ndarray]], squares: np.ndarray, pairs: np.ndarray):
        super().__init__(columns)
        self.shapes = [(len(a), len(b)) for a, b in pieces]
        self.pieces = [(_at(a), _at(b)) for a, b in pieces]
        self.squares, self.pairs = _at(squares), pairs
        self.numbers = sum(a * b for a, b in self.shapes) + len(squares) + len(pairs)

    def rows_per_step(self) -> int:
        return int(np.clip(STEP_BYTES // (8 * self.columns), 256, ROWS_PER_STEP))

    def filler(self, cands: list[Candidate], shift: np.ndarray, factor: np.ndarray):
        nodes = NodeDictionary(cands)
        return lambda X, out: nodes.fill(X, out, shift, factor)

    def products(self, U: np.ndarray) -> np.ndarray:
        out, at = np.empty(self.numbers), 0
        for (a, b), shape in zip(self.pieces, self.shapes):
            size = shape[0] * shape[1]
            np.matmul(U[a], U[b].T, out=out[at : at + size].reshape(shape))
            at += size
        own = U[self.squares]
        np.einsum("ij,ij->i", own, own, out=out[at : at + len(own)])
        if len(self.pairs):
            np.einsum("ij,ij->i", U[self.pairs[:, 0]], U[self.pairs[:, 1]], out=out[at + len(own) :])
        return out

    def packed(self, acc: dict, counts: dict) -> Iterator[tuple]:
        step = BLOCK_BYTES // 8
        for (leaf, kind), v in acc.items():
            for b, lo in enumerate(range(0, len(v), step)):
                yield leaf, kind, b, counts[leaf], v[lo : lo + step].tobytes()


@dataclass
class Known:
    """A graph's columns and its sums over ``(1, columns, targets)`` in working units, one matrix per (leaf, kind)."""

    columns: list[Candidate]
    sums: np.ndarray


@dataclass
class Piece:
    """One product of the last pass: its place and the positions of its rows and columns by name."""

    start: int
    shape: tuple[int, int]
    rows: dict[str | int, int]
    columns: dict[str | int, int]

    def pick(self, flat: np.ndarray, rows: list, columns: list) -> np.ndarray:
        M = flat[:, self.start : self.start + self.shape[0] * self.shape[1]].reshape(len(flat), *self.shape)
        at = lambda places, names: np.array([places[n] for n in names], dtype=int)
        return M[:, at(self.rows, rows)[:, None], at(self.columns, columns)]


@dataclass
class Inner:
    """Products of the new columns of one graph with one another: the places of all new columns, of their squares and pairs."""

    at: dict[str, int]
    places: dict[tuple[int, int], int]
    names: list[str]

    def pick(self, flat: np.ndarray, rows: list, columns: list) -> np.ndarray:
        where = lambda a, b: self.places[min(a, b), max(a, b)]
        return flat[:, np.array([[where(self.at[r], self.at[c]) for c in columns] for r in rows], dtype=int)]


@dataclass
class Fresh:
    """What a graph has beyond its parent: products of its new columns with columns that all parents of the generation
    share, with the parent's other columns, and with one another."""

    parent: Known
    parent_graph: Graph | None
    columns: list[Candidate]
    pieces: tuple[Piece, Piece, Inner]


class GraphSums:
    """Moments of graphs, gathered generation by generation.

    ``columns_of`` lists a graph's columns. ``gather`` takes pairs (graph, parent) whose parents are known (None: no parent,
    all columns are new) and makes one pass over the rows; ``keep`` forgets all graphs but the given ones. ``numbers`` is how
    many sums a leaf held in the last pass.
    """

    def __init__(self, design: Design, prof: RawProfile, columns_of: Callable[[Graph], list[Candidate]]):
        self.design, self.prof, self.columns_of = design, prof, columns_of
        self.known: dict[str, Known] = {}
        self.fresh: dict[str, Fresh] = {}
        self.leaves: list[tuple[int, int]] = []  # (leaf, kind), in the order of all sums
        self.counts: list[int] = []
        self.flat = np.empty((0, 0))
        self.scales: dict[str, tuple[float, float]] = {}
        self.targets: tuple[np.ndarray, np.ndarray] | None = None
        self.numbers = 0
        self.views: dict[tuple[str, int | None, int], FoldView] = {}  # of parents, by fold (None: all rows) and target

    def gather(self, pairs: list[tuple[Graph, Graph | None]]) -> None:
        t = len(self.design.targets)
        families: dict[str, list[Graph]] = {}
        parent_of: dict[str, Graph | None] = {}
        ready = [g.key() for g, _ in pairs if self.has(g)]
        for graph, parent in pairs:
            if not self.has(graph):
                families.setdefault(ROOT if parent is None else parent.key(), []).append(graph)
                parent_of.setdefault(ROOT if parent is None else parent.key(), parent)
        if not families:
            return
        self.keep_keys([*ready, *[k for k in families if k != ROOT]])
        first = ROOT not in self.known
        self.known.setdefault(ROOT, Known([], np.empty((0, 0, 0))))
        pool: dict[str, Candidate] = {c.name: c for key in families for c in self.known[key].columns}
        own: dict[str, list[Candidate]] = {}
        news: dict[str, dict[str, None]] = {}  # per parent: its children's new columns
        fresh: dict[str, Candidate] = {}
        for key, children in families.items():
            base = {c.name for c in self.known[key].columns}
            rows = news.setdefault(key, {})
            for g in children:
                own[g.key()] = self.columns_of(g)
                for c in own[g.key()]:
                    if c.name not in base:
                        rows.setdefault(c.name)
                        fresh.setdefault(c.name, c)
        place: dict[str, int] = {n: 1 + j for j, n in enumerate(pool)}  # known columns first, then new ones
        cands, values, new_at = list(pool.values()), {}, {}
        for n, c in fresh.items():  # new columns that are equal share a row, which a column known to another parent does not
            v = value_key(c.args["node"])
            if v not in values:
                values[v] = 1 + len(cands)
                cands.append(c)
            new_at[n] = values[v]
        first_new = 1 + len(pool)
        ends = list(range(t))  # targets go by number, the constant by -1
        at = {-1: 0, **place, **{e: 1 + len(cands) + e for e in ends}}
        pieces: list[tuple[np.ndarray, np.ndarray]] = []
        end = 0

        def piece(rows: list, columns: list, row_at: dict) -> Piece:
            nonlocal end
            distinct = {r: j for j, r in enumerate(dict.fromkeys(row_at[r] for r in rows))}
            pieces.append((np.array(list(distinct), dtype=int), np.array([at[c] for c in columns], dtype=int)))
            start, shape = end, (len(distinct), len(columns))
            end += shape[0] * shape[1]
            return Piece(start, shape, {r: distinct[row_at[r]] for r in rows}, {c: j for j, c in enumerate(columns)})

        root = piece([-1, *ends], [-1, *ends], at) if first else None
        parents = [{c.name: None for c in self.known[key].columns} for key in families]
        shared = [n for n in parents[0] if all(n in p for p in parents)]
        common = piece(list(fresh), [-1, *shared, *ends], new_at)
        own_parts = {key: piece(list(news[key]), [c.name for c in self.known[key].columns if c.name not in common.columns], new_at) for key in families}
        squares = np.arange(first_new, 1 + len(cands))
        places = {(r, r): end + j for j, r in enumerate(squares.tolist())}
        end += len(squares)
        self.fresh = {}
        for key, children in families.items():
            for g in children:
                if g.key() not in self.fresh:
                    new = [c.name for c in own[g.key()] if c.name in news[key]]
                    where = sorted({new_at[n] for n in new})
                    for i, a in enumerate(where):
                        for b in where[i + 1 :]:
                            places.setdefault((a, b), len(places) + end - len(squares))
                    self.fresh[g.key()] = Fresh(self.known[key], parent_of[key], own[g.key()], (common, own_parts[key], Inner(new_at, places, new)))
        pairs = np.array([k for k in places if k[0] != k[1]], dtype=int).reshape(-1, 2)
        centre, scale = working_scale(cands, self.prof)
        self.scales |= {n: (float(centre[j - 1]), float(scale[j - 1])) for n, j in (place | new_at).items()}
        self.targets = centre[-t:], scale[-t:]
        form = Borders(1 + len(cands) + t, pieces, squares, pairs)
        self.numbers = form.numbers
        summed = sum_partials(partial_moments(self.design, cands, centre, scale, form=form), *fan_in_for(self.design.df))
        parts: dict[tuple[int, int], dict[int, np.ndarray]] = {}
        counts: dict[tuple[int, int], int] = {}
        for r in summed.collect():
            parts.setdefault((r["leaf"], r["kind"]), {})[r["block"]] = np.frombuffer(r["data"])
            counts[r["leaf"], r["kind"]] = r["n"]
        self.leaves = sorted(parts)
        self.counts = [counts[k] for k in self.leaves]
        self.flat = np.array([np.concatenate([parts[k][b] for b in sorted(parts[k])]) for k in self.leaves])
        if first:
            self.known[ROOT].sums = root.pick(self.flat, [-1, *ends], [-1, *ends])

    def has(self, graph: Graph) -> bool:
        return graph.key() in self.known or graph.key() in self.fresh

    def keep(self, graphs: list[Graph]) -> None:
        self.keep_keys([g.key() for g in graphs])

    def keep_keys(self, keys: list[str]) -> None:
        self.known = {k: self._whole(k) for k in dict.fromkeys([*keys, *([ROOT] if ROOT in self.known else [])])}
        self.fresh, self.flat = {}, np.empty((0, 0))
        self.views = {k: v for k, v in self.views.items() if k[0] in self.known}

    def _whole(self, key: str) -> Known:
        """A graph's sums: the parent's where both columns are the parent's, borders elsewhere."""
        if key in self.known:
            return self.known[key]
        f, t = self.fresh[key], len(self.design.targets)
        k, kp = len(f.columns), len(f.parent.columns)
        ends = list(range(t))
        place = {-1: 0, **{c.name: 1 + j for j, c in enumerate(f.parent.columns)}, **{e: 1 + kp + e for e in ends}}
        mine = {-1: 0, **{c.name: 1 + j for j, c in enumerate(f.columns)}, **{e: 1 + k + e for e in ends}}
        common, own_part, inner = f.pieces
        kept = [n for n in mine if n in place]
        here, there = [mine[n] for n in kept], [place[n] for n in kept]
        new = inner.names
        rows = [mine[n] for n in new]
        by = [(p, [n for n in kept if n in p.columns]) for p in (common, own_part)] + [(inner, new)]
        M = np.empty((len(self.leaves), 1 + k + t, 1 + k + t))
        M[:, np.array(here)[:, None], here] = f.parent.sums[:, np.array(there)[:, None], there]
        for part, names in by if new else ():
            block, columns = part.pick(self.flat, new, names), [mine[n] for n in names]
            M[:, np.array(rows)[:, None], columns] = block
            M[:, np.array(columns, dtype=int)[:, None], rows] = block.transpose(0, 2, 1)
        return Known(f.columns, M)

    def table(self, graph: Graph) -> GramTable:
        """The moments of one graph's columns, as a pass over these columns alone would give them."""
        known, t = self._whole(graph.key()), len(self.design.targets)
        centre = np.array([*[self.scales[c.name][0] for c in known.columns], *self.targets[0]])
        scale = np.array([*[self.scales[c.name][1] for c in known.columns], *self.targets[1]])
        k = len(known.columns)
        leaves = {key: Moments(raw_targets(M, t, centre, scale), n, k, t) for key, M, n in zip(self.leaves, known.sums, self.counts)}
        return gram_table(self.design, known.columns, centre, scale, leaves)

    def columns(self, graph: Graph) -> list[Candidate]:
        key = graph.key()
        return (self.known.get(key) or self.fresh[key]).columns

    def view(self, graph: Graph, fold: int | None, target: int) -> FoldView:
        """The view of one graph's columns in which ``fold`` validates (None: all rows do both), as ``table`` has it. A column
        is scaled by its own training rows, so a child takes over its parent's view and only its border is worked out."""
        key = graph.key()
        if self.design.serial:
            return self._full_view(graph, fold, target)
        if key in self.known:
            if (key, fold, target) not in self.views:
                self.views[key, fold, target] = self._full_view(graph, fold, target)
            return self.views[key, fold, target]
        f = self.fresh[key]
        base = f.parent_graph
        return self._bordered(f, self.view(base, fold, target), fold, target) if base is not None else self._full_view(graph, fold, target)

    def _full_view(self, graph: Graph, fold: int | None, target: int) -> FoldView:
        table = self.table(graph)
        return whole_view(table, target) if fold is None else split_views(table, target, fold)[0][1]

    def _bordered(self, f: Fresh, base: FoldView, fold: int | None, target: int) -> FoldView:
        """``base`` with the columns that ``f`` does not have left out and its new ones put in."""
        common, own_part, inner = f.pieces
        before = {c.name: j for j, c in enumerate(f.parent.columns)}
        names = [c.name for c in f.columns]
        kept = [n for n in names if n in before]
        new, old_at = inner.names, [1 + before[n] for n in kept]
        P, y = len(names) + 2, len(names) + 1
        mine = {n: 1 + j for j, n in enumerate(names)}
        here, fresh_at = [0, *[mine[n] for n in kept], y], [mine[n] for n in new]
        there = [0, *old_at, base.y]
        in_place = here[:-1] == there[:-1] and y >= base.y
        if not new:
            blocks = {}
        else:  # products of new columns with (1, kept, new, target), per leaf, in working units; the target's in raw ones
            W = np.empty((len(self.leaves), len(new), P))
            W[:, :, 0] = common.pick(self.flat, new, [-1])[:, :, 0]
            for part in (common, own_part):
                some = [n for n in kept if n in part.columns]
                W[:, :, [mine[n] for n in some]] = part.pick(self.flat, new, some)
            W[:, :, fresh_at] = inner.pick(self.flat, new, new)
            centre, scale = self.targets[0][target], self.targets[1][target]
            W[:, :, y] = (common.pick(self.flat, new, [target])[:, :, 0] + W[:, :, 0] * (centre / scale)) * scale
            kinds = np.array([kind for _, kind in self.leaves])
            folds = np.array([leaf for leaf, _ in self.leaves])
            blocks = {}
            for kind in sorted(set(kinds.tolist())):
                valid = (kinds == kind) & ((folds == fold) if fold is not None else True)
                train = (kinds == kind) & ((folds != fold) if fold is not None else True)
                blocks[kind] = W[train].sum(0), W[valid].sum(0)
        shift, sd, live = np.zeros(P - 2), np.ones(P - 2), np.ones(P - 2, dtype=bool)
        centre_of, scale_of = np.array([self.scales[n] for n in names]).T
        place = np.array(here[1:-1], dtype=int) - 1
        from_parent = np.array(old_at, dtype=int) - 1
        sd[place] = base.scale[from_parent] / scale_of[place]
        shift[place] = (base.shift[from_parent] - centre_of[place]) / scale_of[place]
        live[place] = base.live[from_parent]
        if new:
            at = np.array(fresh_at, dtype=int)
            plain = blocks[PLAIN][0]
            total = base.tr_plain[0, 0]
            mu = plain[:, 0] / total
            deviation = np.sqrt(np.maximum(plain[np.arange(len(at)), at] / total - mu**2, 0.0))
            live[at - 1] = deviation > CONSTANT_SD
            sd[at - 1] = np.where(live[at - 1], deviation, 1.0)
            shift[at - 1] = mu

        def built(old: np.ndarray, border: np.ndarray | None) -> np.ndarray:
            M = np.empty((P, P))
            if in_place:  # nothing moved: new columns are written over below
                k = min(y, base.y)
                M[:k, :k], M[:k, y], M[y, :k], M[y, y] = old[:k, :k], old[:k, -1], old[-1, :k], old[-1, -1]
            else:
                M[np.ix_(here, here)] = old[np.ix_(there, there)]
            if border is not None:
                back, factor = np.concatenate([[0.0], shift, [0.0]]), np.concatenate([[1.0], 1.0 / sd, [1.0]])
                ones = np.empty(P)  # sums of all columns, not yet shifted and scaled
                ones[here] = M[0, here] / factor[here] + back[here] * old[0, 0]
                ones[at] = border[:, 0]
                rows = border - np.outer(back[at], ones) - np.outer(border[:, 0], back) + np.outer(back[at], back) * old[0, 0]
                rows *= factor[at][:, None] * factor[None, :]
                M[at] = rows
                M[:, at] = rows.T
            return M

        border = lambda kind, side: blocks[kind][side] if new else None
        weighted = base.weighted
        tr_plain, va_plain = built(base.tr_plain, border(PLAIN, 0)), built(base.va_plain, border(PLAIN, 1))
        tr = built(base.tr, border(WEIGHTED, 0)) if weighted else tr_plain
        va = built(base.va, border(WEIGHTED, 1)) if weighted else va_plain
        return FoldView(tr, va, tr_plain, va_plain, base.n_tr, base.n_va, centre_of + scale_of * shift, scale_of * sd, live, weighted)

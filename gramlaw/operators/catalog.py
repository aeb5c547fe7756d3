"""Candidate columns: what they are called, how they are computed, and the bank that lists them.

A candidate is one derived column. ``kind`` names its formula and ``args`` its parameters:

=============  =========================================================================
unary          atom ``f`` of input ``i``
hsml_unary     atom ``f`` of the projection ``X·w``
hsml_binary    ``X·w1 op X·w2`` with op one of + - * /
relu_proj      max(0, X·w - t)
sinproj        sin(X·w + b)
fct            cos z + cos(kappa z)/kappa with z = X·w + b0
bilinear       x_i·x_j
radius         (x_i² + x_j²)^power
group          one of abs, square, sum_abs, sum_sq, sum, pair_sum, unit, log_norm over ``idx``
graph          an expression graph node, nested tuples ``(op, params, parents)``
=============  =========================================================================
"""

from __future__ import annotations

import itertools
import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlaw.functions.atoms import EPS, REGISTRY, UNARY, USER_ATOMS, USER_OPS, adopt, apply_atom, apply_atom_array, finite, finite_array, finite_sql

# Fixed values (must equal the reference's for equal results).
DIVISION_FLOOR = 1e-3
NORM_EPS = 1e-12


@dataclass(frozen=True)
class Candidate:
    name: str
    kind: str
    args: dict = field(hash=False)
    block: str = ""

    def __reduce__(self):
        """A candidate that travels to an executor takes the user's own atoms and operators with it."""
        return _arrived, (self.name, self.kind, self.args, self.block, dict(USER_ATOMS), dict(USER_OPS))

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "kind": self.kind, "args": self.args, "block": self.block})

    @staticmethod
    def from_json(text: str) -> "Candidate":
        d = json.loads(text)
        return Candidate(d["name"], d["kind"], d["args"], d.get("block", ""))


def _arrived(name: str, kind: str, args: dict, block: str, atoms: dict, ops: dict) -> Candidate:
    adopt(atoms, ops)
    return Candidate(name, kind, args, block)


# --------------------------------------------------------------------------------------------------------------
# Evaluation on a NumPy batch (rows × inputs)


def _ratio(a, b):
    return a / (np.abs(b) + DIVISION_FLOOR)


_PAIR_ARRAY = {"+": np.add, "-": np.subtract, "*": np.multiply, "/": _ratio}


def _graph_array(node, X, memo):
    if isinstance(node, int):
        return X[:, node]
    key = json.dumps(node)
    if key not in memo:
        op, params, parents = node
        memo[key] = REGISTRY[op].array(*[_graph_array(p, X, memo) for p in parents], **params)
    return memo[key]


def _dots(W: np.ndarray, XT: np.ndarray) -> np.ndarray:
    """Projections of the inputs. As in the column form, a zero weight leaves its input out, also where that is missing
    or infinite (the product would be NaN)."""
    Z = W @ XT
    odd = np.flatnonzero(~np.isfinite(XT).all(axis=0)) if not np.isfinite(XT.sum()) else ()
    if len(odd):
        for k, w in enumerate(W):
            used = np.flatnonzero(w)
            Z[k, odd] = w[used] @ XT[np.ix_(used, odd)]
    return Z


def _dot_array(w, X: np.ndarray) -> np.ndarray:
    return _dots(np.asarray(w, dtype=float)[None, :], X.T)[0]


def _one_array(c: Candidate, X: np.ndarray, memo: dict) -> np.ndarray:
    a = c.args
    if c.kind == "hsml_binary":
        return _PAIR_ARRAY[a["op"]](_dot_array(a["w1"], X), _dot_array(a["w2"], X))
    if c.kind == "relu_proj":
        return np.maximum(0.0, _dot_array(a["w"], X) - a["t"])
    if c.kind == "sinproj":
        return np.sin(_dot_array(a["w"], X) + a["b"])
    if c.kind == "fct":
        z = _dot_array(a["w"], X) + a["b0"]
        return np.cos(z) + np.cos(a["kappa"] * z) / a["kappa"]
    if c.kind == "bilinear":
        return X[:, a["i"]] * X[:, a["j"]]
    if c.kind == "radius":
        return (X[:, a["i"]] ** 2 + X[:, a["j"]] ** 2) ** a.get("power", 1)
    if c.kind == "graph":
        return _graph_array(a["node"], X, memo)
    if c.kind == "group":
        V = X[:, a["idx"]]
        what = a["what"]
        if what == "abs":
            return np.abs(X[:, a["j"]])
        if what == "square":
            return X[:, a["j"]] ** 2
        if what == "sum_abs":
            return np.abs(V).sum(axis=1)
        if what == "sum_sq":
            return (V * V).sum(axis=1)
        if what == "sum":
            return V.sum(axis=1)
        if what == "pair_sum":
            return 0.5 * (V.sum(axis=1) ** 2 - (V * V).sum(axis=1))
        norm = np.sqrt((V * V).sum(axis=1)) + NORM_EPS
        return X[:, a["j"]] / norm if what == "unit" else np.log(norm + NORM_EPS)
    raise ValueError(f"unknown candidate kind {c.kind}")


def evaluate(cands: list[Candidate], X: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """All candidates on one batch, as rows × candidates.

    Atoms are applied to whole blocks of inputs or projections at a time. Values are laid out candidate by candidate
    (``out`` is candidates × rows), so that every block is written in one piece.
    """
    XT = np.ascontiguousarray(X.T)
    X = XT.T
    out = np.empty((len(cands), X.shape[0])) if out is None else out
    by_atom: dict[str, list[int]] = {}
    by_proj: dict[str, list[int]] = {}
    memo: dict = {}
    with np.errstate(all="ignore"):
        for pos, c in enumerate(cands):
            if c.kind == "unary":
                by_atom.setdefault(c.args["f"], []).append(pos)
            elif c.kind == "hsml_unary":
                by_proj.setdefault(c.args["f"], []).append(pos)
            else:
                out[pos] = finite_array(_one_array(c, X, memo))
        for fname, where in by_atom.items():
            out[where] = apply_atom_array(fname, XT[[cands[p].args["i"] for p in where]])
        if by_proj:
            vectors = {}
            for where in by_proj.values():
                for p in where:
                    vectors.setdefault(tuple(cands[p].args["w"]), len(vectors))
            Z = _dots(np.array(list(vectors)), XT)
            for fname, where in by_proj.items():
                out[where] = apply_atom_array(fname, Z[[vectors[tuple(cands[p].args["w"])] for p in where]])
    return out.T


# --------------------------------------------------------------------------------------------------------------
# Column form


def dot(w, cols: list[Column]) -> Column:
    """Projection of the inputs; zero weights are left out so the scan reads only what is used."""
    total = None
    for wj, c in zip(w, cols):
        if wj == 0.0:
            continue
        term = c if wj == 1.0 else c * F.lit(float(wj))
        total = term if total is None else total + term
    return F.lit(0.0) if total is None else total


def pair_column(op: str, a: Column, b: Column) -> Column:
    if op == "+":
        return a + b
    if op == "-":
        return a - b
    if op == "*":
        return a * b
    return a / (F.abs(b) + DIVISION_FLOOR)


def graph_column(node, cols: list[Column]) -> Column:
    if isinstance(node, int):
        return cols[node]
    op, params, parents = node
    return REGISTRY[op].column(*[graph_column(p, cols) for p in parents], **params)


def _add_all(terms: list[Column]) -> Column:
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def column(c: Candidate, cols: list[Column]) -> Column:
    """JVM expression of one candidate over the ordered input columns."""
    a = c.args
    if c.kind == "unary":
        return apply_atom(a["f"], cols[a["i"]])
    if c.kind == "hsml_unary":
        return apply_atom(a["f"], dot(a["w"], cols))
    if c.kind == "hsml_binary":
        return finite(pair_column(a["op"], dot(a["w1"], cols), dot(a["w2"], cols)))
    if c.kind == "relu_proj":
        return finite(F.greatest(dot(a["w"], cols) - a["t"], F.lit(0.0)))
    if c.kind == "sinproj":
        return finite(F.sin(dot(a["w"], cols) + a["b"]))
    if c.kind == "fct":
        z = dot(a["w"], cols) + a["b0"]
        return finite(F.cos(z) + F.cos(z * a["kappa"]) / a["kappa"])
    if c.kind == "bilinear":
        return finite(cols[a["i"]] * cols[a["j"]])
    if c.kind == "radius":
        r2 = cols[a["i"]] * cols[a["i"]] + cols[a["j"]] * cols[a["j"]]
        return finite(r2 if a.get("power", 1) == 1 else r2 * r2)
    if c.kind == "graph":
        return finite(graph_column(a["node"], cols))
    if c.kind == "group":
        V = [cols[j] for j in a["idx"]]
        what = a["what"]
        if what == "abs":
            return finite(F.abs(cols[a["j"]]))
        if what == "square":
            return finite(cols[a["j"]] * cols[a["j"]])
        if what == "sum_abs":
            return finite(_add_all([F.abs(v) for v in V]))
        if what == "sum":
            return finite(_add_all(V))
        squares = _add_all([v * v for v in V])
        if what == "sum_sq":
            return finite(squares)
        if what == "pair_sum":
            total = _add_all(V)
            return finite((total * total - squares) * 0.5)
        norm = F.sqrt(squares) + NORM_EPS
        return finite(cols[a["j"]] / norm if what == "unit" else F.log(norm + NORM_EPS))
    raise ValueError(f"unknown candidate kind {c.kind}")


# --------------------------------------------------------------------------------------------------------------
# SQL text form


def _lit(v: float) -> str:
    return f"({float(v)!r})" if v < 0 else repr(float(v))


def dot_sql(w, names: list[str]) -> str:
    terms = [f"{_lit(wj)}*{n}" for wj, n in zip(w, names) if wj != 0.0]
    return "(" + "+".join(terms or ["0.0"]) + ")"


def _graph_sql(node, names):
    if isinstance(node, int):
        return names[node]
    op, params, parents = node
    texts = dict(zip("xy", [_graph_sql(p, names) for p in parents]))
    return REGISTRY[op].sql.format(**texts, **{k: _lit(v) for k, v in (REGISTRY[op].defaults | params).items()})


def sql(c: Candidate, names: list[str]) -> str:
    """SQL text of one candidate over the ordered input names."""
    a = c.args
    if c.kind == "unary":
        return finite_sql(UNARY[a["f"]].sql.format(x=names[a["i"]]))
    if c.kind == "hsml_unary":
        return finite_sql(UNARY[a["f"]].sql.format(x=dot_sql(a["w"], names)))
    if c.kind == "hsml_binary":
        one, two = dot_sql(a["w1"], names), dot_sql(a["w2"], names)
        if a["op"] == "/":
            return finite_sql(f"({one}/(abs({two})+{DIVISION_FLOOR!r}))")
        return finite_sql(f"({one}{a['op']}{two})")
    if c.kind == "relu_proj":
        return finite_sql(f"greatest({dot_sql(a['w'], names)}-{_lit(a['t'])},0.0)")
    if c.kind == "sinproj":
        return finite_sql(f"sin({dot_sql(a['w'], names)}+{_lit(a['b'])})")
    if c.kind == "fct":
        z, k = f"({dot_sql(a['w'], names)}+{_lit(a['b0'])})", _lit(a["kappa"])
        return finite_sql(f"(cos({z})+cos({k}*{z})/{k})")
    if c.kind == "bilinear":
        return finite_sql(f"({names[a['i']]}*{names[a['j']]})")
    if c.kind == "radius":
        x, y = names[a["i"]], names[a["j"]]
        r2 = f"({x}*{x}+{y}*{y})"
        return finite_sql(r2 if a.get("power", 1) == 1 else f"({r2}*{r2})")
    if c.kind == "graph":
        return finite_sql(_graph_sql(a["node"], names))
    if c.kind == "group":
        V = [names[j] for j in a["idx"]]
        what = a["what"]
        total = "(" + "+".join(V) + ")"
        squares = "(" + "+".join(f"{v}*{v}" for v in V) + ")"
        norm = f"(sqrt({squares})+{NORM_EPS!r})"
        texts = {
            "sum": total,
            "sum_sq": squares,
            "sum_abs": "(" + "+".join(f"abs({v})" for v in V) + ")",
            "pair_sum": f"(0.5*({total}*{total}-{squares}))",
            "log_norm": f"ln({norm}+{NORM_EPS!r})",
        }
        if what in texts:
            return finite_sql(texts[what])
        x = names[a["j"]]
        return finite_sql({"abs": f"abs({x})", "square": f"({x}*{x})", "unit": f"({x}/{norm})"}[what])
    raise ValueError(f"unknown candidate kind {c.kind}")


# --------------------------------------------------------------------------------------------------------------
# The bank


def unit_vector(rng: np.random.Generator, d: int) -> np.ndarray:
    w = rng.normal(size=d)
    return w / (np.linalg.norm(w) + EPS)


TIED = 1e-9


def closest_pair(corr: np.ndarray) -> tuple[int, int]:
    """The most correlated pair of inputs. Pairs that differ by rounding only, as inputs with a linear relation do, are
    equal, and the first is taken: else the order of summation would choose, another one in every fold."""
    off = np.abs(corr - np.diag(np.diag(corr)))
    i, j = np.unravel_index(int(np.argmax(off >= off.max() * (1.0 - TIED))), off.shape)
    return int(i), int(j)


def projections(corr: np.ndarray, rng: np.random.Generator, n_proj: int = 24) -> list[tuple[str, list[float]]]:
    """Two axes of the most correlated input pair, then random directions; one name always means one vector."""
    d = corr.shape[0]
    if d == 1:
        return [("proj[e0]", [1.0])]
    i, j = closest_pair(corr)
    axes = np.eye(d)
    defs = [(f"proj[ei:{i}]", axes[i].tolist()), (f"proj[ej:{j}]", axes[j].tolist())]
    for k in range(len(defs), n_proj):
        defs.append((f"proj[rand:{k}]", unit_vector(rng, d).tolist()))
    return defs


def build_bank(
    corr: np.ndarray,
    seed: int,
    n_proj: int = 24,
    n_pairs: int = 24,
    raw_unary: bool = True,
    skip_inputs: frozenset[int] = frozenset(),
) -> list[Candidate]:
    """Every stage-one candidate: atoms of inputs, atoms of projections, and sums/products/ratios of projection pairs.

    Drawn once per ``(seed, inputs)`` so that the same name is the same column in every fold. ``skip_inputs`` lists
    inputs known to be constant over the whole table: any function of them is constant too.
    """
    d = corr.shape[0]
    rng = np.random.default_rng(seed)
    bank: list[Candidate] = []
    if raw_unary:
        for f in UNARY:
            bank += [Candidate(f"{f}[x{i}]", "unary", {"f": f, "i": i}) for i in range(d) if i not in skip_inputs]
    defs = projections(corr, rng, n_proj)
    for pname, w in defs:
        bank += [Candidate(f"hsml:{f}({pname})", "hsml_unary", {"f": f, "w": w}) for f in UNARY]
    pairs = list(itertools.combinations(defs, 2))
    order = list(range(len(pairs)))
    rng.shuffle(order)
    for k in order[:n_pairs]:
        (n1, w1), (n2, w2) = pairs[k]
        for op in "+-*/":
            bank.append(Candidate(f"hsml2:({n1}{op}{n2})", "hsml_binary", {"op": op, "w1": w1, "w2": w2}))
    return bank


ALIKE = {"sgn*x": "|x|", "softsign": "x/(1+|x|)"}  # atoms that are the same function


def distinct_columns(cands: list[Candidate]) -> tuple[list[int], np.ndarray]:
    """The first candidate of each column, and where among these each candidate's column is. Atoms that are the same
    function, and atoms of an input and of its axis, are equal to the last digit."""
    place: dict[tuple, int] = {}
    first, at = [], []
    for pos, c in enumerate(cands):
        key = ("", c.name)
        if c.kind in ("unary", "hsml_unary"):
            w = c.args.get("w", ())
            used = [j for j, v in enumerate(w) if v]
            axis = c.args["i"] if c.kind == "unary" else used[0] if len(used) == 1 and w[used[0]] == 1.0 else tuple(w)
            f, twin = c.args["f"], ALIKE.get(c.args["f"], c.args["f"])
            key = (f if {f, twin} & USER_ATOMS.keys() else twin, axis)
        if key not in place:
            place[key] = len(first)
            first.append(pos)
        at.append(place[key])
    return first, np.array(at, dtype=int)


def catalog_frame(spark: SparkSession, cands: list[Candidate]) -> DataFrame:
    """The bank as a table: position, name, kind, and the parameters as JSON."""
    rows = [(k, c.name, c.kind, c.block, json.dumps(c.args)) for k, c in enumerate(cands)]
    return spark.createDataFrame(rows, "pos int, name string, kind string, block string, args string")


# --------------------------------------------------------------------------------------------------------------
# Grammar blocks (groups of candidate columns accepted or rejected together)


@dataclass(frozen=True)
class GroupSpec:
    sign_groups: tuple = ()
    perm_groups: tuple = ()
    rot2d_pairs: tuple = ()
    scale_groups: tuple = ()


def perm_block(idx, block: str) -> list[Candidate]:
    idx = list(idx)
    return [
        Candidate(f"{block}:{what}", "group", {"what": what, "idx": idx}, block)
        for what in ("sum", "sum_sq", "pair_sum")
    ]


def group_block(spec: GroupSpec, block: str, d: int = 0, include_raw: bool = False) -> list[Candidate]:
    """Invariant features of a group description, in the order sign, permutation, rotation, scale."""
    out = [Candidate(f"{block}:raw{j}", "unary", {"f": "x", "i": j}, block) for j in range(d)] if include_raw else []
    for g, idx in enumerate(map(list, spec.sign_groups)):
        for what in ("abs", "square"):
            out += [
                Candidate(f"{block}:sign{g}:{what}{j}", "group", {"what": what, "idx": idx, "j": j}, block) for j in idx
            ]
        for what in ("sum_abs", "sum_sq"):
            out.append(Candidate(f"{block}:sign{g}:{what}", "group", {"what": what, "idx": idx}, block))
    for g, idx in enumerate(spec.perm_groups):
        for c in perm_block(idx, block):
            out.append(Candidate(f"{block}:perm{g}:{c.args['what']}", "group", c.args, block))
    for i, j in spec.rot2d_pairs:
        out.append(Candidate(f"{block}:rot{i}_{j}", "radius", {"i": i, "j": j, "power": 1}, block))
    for g, idx in enumerate(map(list, spec.scale_groups)):
        out += [
            Candidate(f"{block}:scale{g}:unit{j}", "group", {"what": "unit", "idx": idx, "j": j}, block) for j in idx
        ]
        out.append(Candidate(f"{block}:scale{g}:log_norm", "group", {"what": "log_norm", "idx": idx}, block))
    return out


def combo_block(w1, w2, block: str) -> list[Candidate]:
    return [
        Candidate(f"{block}:{op}", "hsml_binary", {"op": op, "w1": list(w1), "w2": list(w2)}, block) for op in "+-*/"
    ]


def dihedral_block(i: int, j: int, block: str, use_r4: bool = False) -> list[Candidate]:
    powers = (1, 2) if use_r4 else (1,)
    return [Candidate(f"{block}:r{2 * p}", "radius", {"i": i, "j": j, "power": p}, block) for p in powers]

"""Expression graphs over the registry operators: seeds, products, and their description length.

A node is an input position or ``[op, params, [parents…]]``; a graph is its list of output nodes. Equal sub-expressions
are one node.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlaw.functions.atoms import REGISTRY
from gramlaw.operators.catalog import Candidate

SEED_OPS = ["sin", "cos", "tanh", "square", "x_over_one_plus_beta_abs"]  # fixed values
PARAM_BITS = 12  # fixed value


class Node(list):
    """A computed node that remembers its key, its column and the keys inside it: a search asks for them again and again."""

    __slots__ = ("_key", "_column", "_inside")

    def __reduce__(self):
        return list, (list(self),)

    @property
    def key(self) -> str:
        try:
            return self._key
        except AttributeError:
            parents = ", ".join(str(p) if isinstance(p, int) else key_of(p) for p in self[2])
            self._key = f"[{json.dumps(self[0])}, {json.dumps(self[1])}, [{parents}]]"
            return self._key

    @property
    def column(self) -> Candidate:
        try:
            return self._column
        except AttributeError:
            self._column = Candidate(f"graph:{label_of(self)}", "graph", {"node": self})
            return self._column

    @property
    def inside(self) -> frozenset:
        """Keys of the node and of all it is computed from."""
        try:
            return self._inside
        except AttributeError:
            self._inside = frozenset({self.key}).union(*[p.inside if isinstance(p, Node) else {key_of(p)} for p in self[2]])
            return self._inside


def noted(node):
    """The node and all nodes inside it as ``Node``."""
    return node if isinstance(node, (int, Node)) else Node([node[0], node[1], [noted(p) for p in node[2]]])


def key_of(node) -> str:
    if isinstance(node, Node):
        return node.key
    return f"x{node}" if isinstance(node, int) else json.dumps(node)


def label_of(node) -> str:
    if isinstance(node, int):
        return f"x{node}"
    op, params, parents = node
    args = [label_of(p) for p in parents] + [f"{k}={v:.6g}" for k, v in params.items()]
    return f"{op}({','.join(args)})"


@dataclass(frozen=True)
class Graph:
    inputs: int
    outputs: tuple
    history: tuple[str, ...] = field(default=())

    @staticmethod
    def from_nodes(outputs: list, inputs: int | None = None) -> "Graph":
        found: set[int] = set()

        def walk(node):
            if isinstance(node, int):
                found.add(node)
            else:
                for p in node[2]:
                    walk(p)

        for o in outputs:
            walk(o)
        return Graph(inputs if inputs is not None else max(found) + 1, tuple(outputs))

    def nodes(self) -> list[tuple[int, str, list[int], dict]]:
        """Rows (id, op, parent ids, params): inputs first, then every distinct sub-expression, parents before users."""
        ids = {f"x{i}": i for i in range(self.inputs)}
        rows = [(i, "id", [i], {}) for i in range(self.inputs)]

        def place(node) -> int:
            if isinstance(node, int):
                return node
            key = key_of(node)
            if key not in ids:
                parents = [place(p) for p in node[2]]
                ids[key] = len(ids)
                rows.append((ids[key], node[0], parents, dict(node[1])))
            return ids[key]

        for o in self.outputs:
            place(o)
        return rows

    def bits(self) -> float:
        """Description length: operator costs, parent references, parameters, and outputs charged once per node."""
        total, charge = float(self.inputs), 2.0 * len(self.outputs)
        ids: dict[str, int] = {}

        def place(node) -> int:
            nonlocal total
            if isinstance(node, int):
                return node
            at = ids.get(node.key)
            if at is None:
                refs = 0.5 * sum([max(1.0, math.log2(1 + place(p))) for p in node[2]])
                at = ids[node.key] = self.inputs + len(ids)
                total += REGISTRY[node[0]].bits + refs + PARAM_BITS * len(node[1]) + charge
            return at

        for o in self.outputs:
            place(o)
        return total

    def outputs_as_candidates(self) -> list[Candidate]:
        return [node_candidate(o) for o in self.outputs]

    def __post_init__(self):
        object.__setattr__(self, "outputs", tuple(noted(o) for o in self.outputs))

    def key(self) -> str:
        return self._key

    @cached_property
    def _key(self) -> str:
        return json.dumps(sorted(key_of(o) for o in self.outputs))

    def grown(self, node, step: str) -> "Graph":
        return Graph(self.inputs, (*self.outputs, node), (*self.history, step))

    def replaced(self, old, new, step: str) -> "Graph":
        """Swap one sub-expression everywhere."""
        target, new = key_of(old), noted(new)

        def swap(node):
            if key_of(node) == target:
                return new
            if isinstance(node, int) or target not in node.inside:
                return node
            return Node([node[0], node[1], [swap(p) for p in node[2]]])

        return Graph(self.inputs, tuple(swap(o) for o in self.outputs), (*self.history, step))

    def tunable(self) -> list:
        """Distinct sub-expressions that carry parameters."""
        return self._tunable

    @cached_property
    def _tunable(self) -> list:
        seen: dict[str, list] = {}

        def walk(node):
            if isinstance(node, int):
                return
            if node[1]:
                seen.setdefault(key_of(node), node)
            for p in node[2]:
                walk(p)

        for o in self.outputs:
            walk(o)
        return list(seen.values())

    @cached_property
    def pool(self) -> list:
        """Every distinct computed node, parents before users."""
        seen: dict[str, list] = {}

        def walk(node):
            if isinstance(node, int) or node.key in seen:
                return
            for p in node[2]:
                walk(p)
            seen[node.key] = node

        for o in self.outputs:
            walk(o)
        return list(seen.values())


def node_candidate(node) -> Candidate:
    if isinstance(node, Node):
        return node.column
    return Candidate(f"graph:{label_of(node)}", "graph", {"node": node})


def seed_graph(d: int) -> Graph:
    """Five starting features per input."""
    outputs = [[op, REGISTRY[op].defaults, [i]] for i in range(d) for op in SEED_OPS]
    return Graph(d, tuple(outputs))


def product_of(graph: Graph, rng: np.random.Generator):
    """Product of two different computed nodes."""
    pool = graph_pool(graph)
    a, b = rng.choice(len(pool), size=2, replace=False)
    return Node(["mul", {}, [pool[int(a)], pool[int(b)]]])


def graph_pool(graph: Graph) -> list:
    return graph.pool


def product_nodes(graph: Graph, count: int, seed: int = 42) -> list[Candidate]:
    """``count`` different product proposals of one graph, as candidate columns."""
    rng = np.random.default_rng(seed)
    found: dict[str, list] = {}
    while len(found) < count:
        node = product_of(graph, rng)
        found.setdefault(key_of(node), node)
    return [node_candidate(n) for n in found.values()]


def nodes_frame(spark: SparkSession, graphs: list[Graph]) -> DataFrame:
    """Node table of several graphs: (state_id, node_id, op, parents, params, is_input, outputs)."""
    rows = [
        (s, i, op, parents, params, i < g.inputs, len(g.outputs)) for s, g in enumerate(graphs) for i, op, parents, params in g.nodes()
    ]
    return spark.createDataFrame(
        rows, "state_id int, node_id int, op string, parents array<int>, params map<string,double>, is_input boolean, outputs int"
    )


def description_bits(nodes: DataFrame) -> DataFrame:
    """Description length per graph from its node table."""
    cost = F.create_map(*[F.lit(v) for name, a in REGISTRY.items() for v in (name, a.bits)])
    refs = F.aggregate("parents", F.lit(0.0), lambda s, p: s + F.greatest(F.lit(1.0), F.log2(p + 1.0)))
    inner = F.try_element_at(cost, F.col("op")) + refs * 0.5 + F.size("params") * float(PARAM_BITS) + F.col("outputs") * 2.0
    return nodes.groupBy("state_id").agg(F.sum(F.when(F.col("is_input"), 1.0).otherwise(inner)).alias("bits"))

"""Queries: sources, column preparation, atoms, blocks, expression graphs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gramlaw.functions.atoms import REGISTRY, UNARY, apply_atom, finite, finite_sql
from gramlaw.operators import catalog
from gramlaw.operators.catalog import Candidate, GroupSpec, build_bank, combo_block, dihedral_block, group_block, perm_block, unit_vector
from gramlaw.operators.gram import Design, gram, profile_inputs
from gramlaw.operators.graphs import Graph, product_nodes, seed_graph
from gramlaw.operators.ranks import median_of
from gramlaw.operators.residual import Step, add_chain
from gramlaw.operators.sparse import key_pairs, key_targets, score_maps
from gramlaw.operators.telemetry import FEATURES, Sensors, design_matrix, feature_map, feature_names, select_features
from gramlaw.queries.common import (
    FOLD_SQL,
    LINE_FEATURES,
    LINE_SQL,
    ORDER_FEATURES,
    ORDER_SQL,
    TELEMETRY_SQL,
    folded_orders,
    label_sql,
    labelled,
    line,
    orders,
    query,
    rnd,
    rounded,
    table,
    telemetry,
)
from gramlaw.operators.noise import variance_weight
from gramlaw.operators.telemetry import with_features
from gramlaw.session import materialise, shared_path
from gramlaw.sources.tables import check_shapes, read_basis_csv, regression_table, sigma_entries

# --------------------------------------------------------------------------------------------------------------
# Sources


@query(
    "named_dataset",
    f"WITH {ORDER_SQL} SELECT id, round(x0,9) AS x0, round(x1,9) AS x1, round(x2,9) AS x2, round(x3,9) AS x3, round(y,6) AS y FROM ord",
)
def _(spark, sf):
    """A table as inputs and target in doubles."""
    out = regression_table(orders(spark, sf), ORDER_FEATURES, "y", "id")
    return out.select("id", *[rnd(f"x{j}", 9).alias(f"x{j}") for j in range(4)], rnd("y", 6).alias("y"))


@query("csv_basis", "SELECT c_custkey AS i, c_acctbal AS b0, CAST(c_nationkey AS DOUBLE) AS b1 FROM customer")
def _(spark, sf):
    """Write a headerless basis, read it back with a fixed schema, and check its shape against target and covariance."""
    src = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("b0"), F.col("c_nationkey").cast("double").alias("b1"))
    path = shared_path(spark, "basis")
    src.write.mode("overwrite").csv(path, header=False)
    basis = read_basis_csv(spark, path, 2)
    diagonal = basis.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v"))
    check_shapes(basis, src.select(F.col("c_custkey").cast("long").alias("i")), diagonal)
    return basis


@query(
    "sigma_json",
    """WITH m AS (SELECT n_nationkey, CAST((SELECT count(*) FROM customer WHERE c_nationkey=n_nationkey) AS DOUBLE) AS a,
 CAST((SELECT count(*) FROM supplier WHERE s_nationkey=n_nationkey) AS DOUBLE) AS b FROM nation)
SELECT n_nationkey, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, a AS v FROM m UNION ALL SELECT n_nationkey,0,1,0.5 FROM m
UNION ALL SELECT n_nationkey,1,0,0.5 FROM m UNION ALL SELECT n_nationkey,1,1,b FROM m""",
)
def _(spark, sf):
    """Covariance documents (plain and wrapped form) as (i, j, v) entries."""
    count = lambda t, k, n: table(spark, sf, t).groupBy(F.col(k).alias("n_nationkey")).agg(F.count("*").cast("double").alias(n))
    m = table(spark, sf, "nation").select("n_nationkey")
    m = m.join(count("customer", "c_nationkey", "a"), "n_nationkey", "left").join(count("supplier", "s_nationkey", "b"), "n_nationkey", "left").na.fill(0.0)
    matrix = F.to_json(F.array(F.array("a", F.lit(0.5)), F.array(F.lit(0.5), F.col("b"))))
    doc = F.when(F.col("n_nationkey") % 2 == 0, matrix).otherwise(F.concat(F.lit('{"Sigma": '), matrix, F.lit("}")))
    return sigma_entries(m.select("n_nationkey", doc.alias("value")))


# --------------------------------------------------------------------------------------------------------------
# Map-shaped features


def _partial_records(spark, sf):
    """Labelled records whose every third row lacks two sensors."""
    lab = labelled(spark, sf)
    full = feature_map()
    reduced = select_features(full, Sensors("reduced", remove=("packets_dropped", "last_processed")))
    return lab.withColumn("feature_map", F.when(F.col("record_id") % 3 == 0, reduced).otherwise(full))


_NAMES = "[" + ",".join(f"'{f}'" for f in FEATURES) + "]"


@query(
    "feature_names",
    f"""WITH k AS (SELECT DISTINCT unnest(CASE WHEN event_id%3=0 THEN list_filter({_NAMES}, lambda x: x NOT IN ('packets_dropped','last_processed'))
 ELSE {_NAMES} END) AS key FROM events), a AS (SELECT key AS name, 0 AS part FROM k UNION ALL SELECT key||'__present', 1 FROM k)
SELECT name, part FROM a""",
)
def _(spark, sf):
    return feature_names(_partial_records(spark, sf))


_PRESENT = ", ".join(
    (f"CASE WHEN record_id%3=0 THEN 0.0 ELSE round({f},6) END AS {f}, CASE WHEN record_id%3=0 THEN 0.0 ELSE 1.0 END AS {f}__present")
    if f in ("packets_dropped", "last_processed")
    else f"round({f},6) AS {f}, CAST(1.0 AS DOUBLE) AS {f}__present"
    for f in sorted(FEATURES)
)


@query(
    "design_matrix",
    f"WITH {TELEMETRY_SQL}, {label_sql()} SELECT record_id, {_PRESENT}, CAST(throttle AS DOUBLE) AS y_throttle, CAST(boost AS DOUBLE) AS y_boost, CAST(reduce_clock AS DOUBLE) AS y_reduce_clock FROM lab",
)
def _(spark, sf):
    """Map features to a dense table with presence flags and one target per action bit."""
    rows = _partial_records(spark, sf)
    names = [*sorted(FEATURES), *[f"{f}__present" for f in sorted(FEATURES)]]
    return rounded(design_matrix(rows, names, ["record_id"], "executed_action"), keep=names[len(FEATURES) :])


# One row per key that a record holds, values in hundreds; every third record lacks two sensors.
_KEYS_SQL = "WITH " + TELEMETRY_SQL + ", " + label_sql() + ", held AS (" + " UNION ALL ".join(
    f"SELECT record_id, '{f}' AS key, {f}/100.0 AS v, CAST(throttle AS DOUBLE) AS t, CAST(boost AS DOUBLE) AS b, CAST(reduce_clock AS DOUBLE) AS r FROM lab"
    + (" WHERE record_id%3<>0" if f in ("packets_dropped", "last_processed") else "")
    for f in FEATURES
) + ")"
_BIT_NAMES = {"t": "throttle", "b": "boost", "r": "reduce_clock"}


def _hundreds(spark, sf):
    """Partial records with their values in hundreds."""
    return _partial_records(spark, sf).withColumn("feature_map", F.transform_values("feature_map", lambda _, v: v / 100.0))


@query(
    "sparse_pairs",
    _KEYS_SQL + " SELECT l.key AS a, r.key AS b, count(*) AS n, round(sum(l.v*r.v)/count(*),6) AS vv, round(sum(l.v)/count(*),6) AS vp, round(sum(r.v)/count(*),6) AS pv FROM held l JOIN held r ON l.record_id=r.record_id AND l.key<=r.key GROUP BY l.key, r.key",
)
def _(spark, sf):
    """Moments of every two keys of the feature maps that occur together, from the keys a record holds."""
    n = F.col("n")
    return key_pairs(_hundreds(spark, sf)).select("a", "b", "n", *[rnd(F.col(c) / n).alias(c) for c in ("vv", "vp", "pv")])


@query(
    "sparse_targets",
    _KEYS_SQL + " SELECT key, count(*) AS n, round(sum(v)/count(*),6) AS v, round(sum(v*v)/count(*),6) AS vv, "
    + ", ".join(f"round(sum(v*{c})/count(*),6) AS vy_{n}, round(sum({c})/count(*),6) AS py_{n}" for c, n in _BIT_NAMES.items()) + " FROM held GROUP BY key",
)
def _(spark, sf):
    """Moments of every key of the feature maps with the action bits."""
    bits = {n: F.col("executed_action")[k] for k, n in enumerate(_BIT_NAMES.values())}
    out = key_targets(_hundreds(spark, sf), bits)
    return out.select("key", "n", *[rnd(F.col(c) / F.col("n")).alias(c) for c in out.columns if c not in ("key", "n")])


@query(
    "sparse_scores",
    _KEYS_SQL + ", w AS (SELECT key, sum(v*b)/(sum(v*v)+1.0) AS vw, sum(b)/count(*) AS pw FROM held GROUP BY key) SELECT record_id, round(sum(v*vw+pw),6) AS score FROM held JOIN w USING (key) GROUP BY record_id",
)
def _(spark, sf):
    """Every record scored by one weight per key: the ridge slope of the boost bit on that key alone, and its mean there."""
    rows = _hundreds(spark, sf)
    sums = materialise(key_targets(rows, {"b": F.col("executed_action")[1]}), "key-sums")
    weights = sums.select("key", (F.col("vy_b") / (F.col("vv") + 1.0)).alias("value_weight"), (F.col("py_b") / F.col("n")).alias("presence_weight"))
    return score_maps(rows, ["record_id"], weights).select("record_id", rnd("score").alias("score"))


@query(
    "feature_subset",
    "SELECT event_id AS record_id, 17 AS n_keys, false AS has_drops, true AS has_pressure FROM events",
)
def _(spark, sf):
    sensors = Sensors("reduced", add=("thermal_pressure",), remove=("packets_dropped", "last_processed"))
    rows = labelled(spark, sf).select("record_id", select_features(feature_map(), sensors).alias("m"))
    return rows.select(
        "record_id",
        F.size("m").alias("n_keys"),
        F.map_contains_key("m", "packets_dropped").alias("has_drops"),
        F.map_contains_key("m", "thermal_pressure").alias("has_pressure"),
    )


_ODD = """odd AS (SELECT event_id AS record_id, CASE WHEN event_id%101=0 THEN CAST('NaN' AS DOUBLE) WHEN event_id%103=0 THEN CAST('Infinity' AS DOUBLE)
 WHEN event_id%107=0 THEN CAST('-Infinity' AS DOUBLE) WHEN event_id%109=0 THEN NULL ELSE value END AS v FROM events)"""


def _odd(spark, sf):
    k = F.col("event_id")
    v = (
        F.when(k % 101 == 0, float("nan")).when(k % 103 == 0, float("inf")).when(k % 107 == 0, float("-inf"))
        .when(k % 109 == 0, F.lit(None)).otherwise(F.col("value"))
    )
    return table(spark, sf, "events").select(k.alias("record_id"), v.alias("v"))


@query(
    "finite_scale",
    f"WITH {_ODD}, s AS (SELECT record_id, {finite_sql('v')} AS safe FROM odd), m AS (SELECT avg(safe) AS mu, CASE WHEN stddev_pop(safe)<1e-12 THEN 1.0 ELSE stddev_pop(safe) END AS sd FROM s) SELECT record_id, round(safe,6) AS safe, round((safe-mu)/sd,6) AS scaled FROM s, m",
)
def _(spark, sf):
    """Missing and infinite values made finite, then scaled by population mean and deviation."""
    s = _odd(spark, sf).select("record_id", finite(F.col("v")).alias("safe"))
    mu, sd = s.agg(F.avg("safe"), F.stddev_pop("safe")).first()
    sd = sd if sd >= 1e-12 else 1.0
    return s.select("record_id", rnd("safe", 6).alias("safe"), rnd((F.col("safe") - mu) / sd, 6).alias("scaled"))


# --------------------------------------------------------------------------------------------------------------
# Bank moments through the Arrow pass


def _moment_frame(spark, g):
    m = g.total()
    sd = np.sqrt(np.maximum(np.diag(m.covariance()), 0.0))[1 : 1 + m.p]
    mean = g.centre + g.scale * m.means()[1 : 1 + m.p]
    return [(c.name, c.kind, float(mu), float(s * k), bool(s > 1e-9)) for c, mu, s, k in zip(g.cands, mean, sd, g.scale)]


def _profile_sql(cands, names, cte, source):
    parts = [
        f"SELECT '{c.name}' AS name, '{c.kind}' AS kind, round(avg(v),6) AS mean, round(CASE WHEN stddev_pop(v)<1e-12 THEN 0.0 ELSE stddev_pop(v) END,6) AS sd, stddev_pop(v)>1e-9 AS kept FROM (SELECT {catalog.sql(c, names)} AS v FROM {source})"
        for c in cands
    ]
    return f"WITH {cte} " + " UNION ALL ".join(parts)


_RAW_BANK = [Candidate(f"{f}[x{i}]", "unary", {"f": f, "i": i}) for f in UNARY for i in range(5)]
_LINE5 = LINE_SQL + ", line5 AS (SELECT x0, x1, x2, x3, 1.5 AS x4, y FROM line)"


@query("atom_moments", _profile_sql(_RAW_BANK, ["x0", "x1", "x2", "x3", "x4"], _LINE5, "line5"))
def _(spark, sf):
    """Mean, deviation and constant-column flag of every raw atom from one moment pass."""
    df = line(spark, sf).withColumn("x4", F.lit(1.5))
    g = gram(Design(df, [*LINE_FEATURES, "x4"], ["y"]), _RAW_BANK)
    rows = _moment_frame(spark, g)
    return rounded(spark.createDataFrame(rows, "name string, kind string, mean double, sd double, kept boolean"))


_PAIR_CORR = np.array([[1, 0.9, 0, 0], [0.9, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1.0]])


@query("candidate_bank", _profile_sql(build_bank(_PAIR_CORR, 42, 4, 3), ORDER_FEATURES, ORDER_SQL, "ord"))
def _(spark, sf):
    """A small bank drawn from the data's own correlations: axes, random projections, pairs; with moments."""
    design = Design(orders(spark, sf), ORDER_FEATURES, ["y"])
    prof = profile_inputs(design)
    g = gram(design, build_bank(prof.corr(4), 42, 4, 3), prof)
    return rounded(spark.createDataFrame(_moment_frame(spark, g), "name string, kind string, mean double, sd double, kept boolean"))


_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]


@query(
    "corr_matrix",
    f"WITH {ORDER_SQL} " + " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, " + ("max(1.0)" if i == j else f"round(corr(x{i},x{j})*count(*)/(count(*)-1.0),6)") + " AS r FROM ord" for i, j in _PAIRS
    ),
)
def _(spark, sf):
    """Correlations with population deviations and n-1 covariance."""
    R = profile_inputs(Design(orders(spark, sf), ORDER_FEATURES, ["y"])).corr(4)
    return rounded(spark.createDataFrame([(i, j, float(R[i, j])) for i, j in _PAIRS], "i int, j int, r double"))


@query(
    "corr_offset",
    f"WITH {ORDER_SQL} " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, round(corr(x{i}+1e9,x{j}+1e9)*count(*)/(count(*)-1.0),5) AS r FROM ord" for i, j in _PAIRS if i != j),
)
def _(spark, sf):
    """Correlations of inputs that stand far from zero."""
    far = orders(spark, sf).withColumns({c: F.col(c) + 1e9 for c in ORDER_FEATURES})
    R = profile_inputs(Design(far, ORDER_FEATURES, ["y"])).corr(4)
    return rounded(spark.createDataFrame([(i, j, float(R[i, j])) for i, j in _PAIRS if i != j], "i int, j int, r double"), 5)


@query(
    "projection_pair",
    f"WITH {ORDER_SQL}, c AS (" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, abs(corr(x{i},x{j})) AS r FROM ord" for i, j in _PAIRS if i != j)
    + ") SELECT i, j, 'proj[ei:'||i||']' AS first_name, 'proj[ej:'||j||']' AS second_name FROM c ORDER BY r DESC LIMIT 1",
)
def _(spark, sf):
    """Axes of the most correlated input pair."""
    R = profile_inputs(Design(orders(spark, sf), ORDER_FEATURES, ["y"])).corr(4)
    (n1, w1), (n2, w2) = catalog.projections(R, np.random.default_rng(42), 2)
    return spark.createDataFrame([(int(np.argmax(w1)), int(np.argmax(w2)), n1, n2)], "i int, j int, first_name string, second_name string")


@query(
    "gram_small",
    f"WITH {LINE_SQL} " + " UNION ALL ".join(
        f"SELECT {a} AS i, {b} AS j, count(*) AS n, round(avg({u}*{v}),6) AS m FROM line"
        for a, u in enumerate(["1.0", "x0", "x1", "x2", "x3", "y"]) for b, v in enumerate(["1.0", "x0", "x1", "x2", "x3", "y"]) if a <= b
    ),
)
def _(spark, sf):
    """Second moments of (1, x, y) by distributed partial sums."""
    m = profile_inputs(Design(line(spark, sf), LINE_FEATURES, ["y"])).moments
    rows = [(i, j, m.n, float(m.M[i, j] / m.n)) for i in range(6) for j in range(i, 6)]
    return rounded(spark.createDataFrame(rows, "i int, j int, n long, m double"))


# --------------------------------------------------------------------------------------------------------------
# Atoms row by row

_ATOM_X = "c_acctbal/2000.0"


@query(
    "atoms_unary",
    "SELECT c_custkey, " + ", ".join(f"round({finite_sql(a.sql.format(x='(' + _ATOM_X + ')'))},6) AS a{k}" for k, a in enumerate(list(UNARY.values())[:24])) + " FROM customer",
)
def _(spark, sf):
    """All 24 bank atoms as built-in expressions."""
    x = F.col("c_acctbal") / 2000.0
    return table(spark, sf, "customer").select("c_custkey", *[rnd(apply_atom(f, x), 6).alias(f"a{k}") for k, f in enumerate(list(UNARY)[:24])])


_VEC = [unit_vector(np.random.default_rng(s), 64).tolist() for s in (1, 2)]
_DOT = ["(" + "+".join(f"CAST(embedding[{j + 1}] AS DOUBLE)*({w!r})" for j, w in enumerate(v)) + ")" for v in _VEC]
_PROJ_ATOMS = ["tanh", "x^2", "gelu", "sgn*sqrt|x|"]


@query(
    "projected_atoms",
    "SELECT vec_id, " + ", ".join(f"round({UNARY[f].sql.format(x=_DOT[0])},6) AS p{k}" for k, f in enumerate(_PROJ_ATOMS)) + " FROM embeddings",
)
def _(spark, sf):
    """Atoms of a random projection of an array column."""
    z = F.aggregate(F.zip_with("embedding", F.array(*[F.lit(w) for w in _VEC[0]]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    base = table(spark, sf, "embeddings").select("vec_id", z.alias("z"))
    return base.select("vec_id", *[rnd(apply_atom(f, F.col("z")), 6).alias(f"p{k}") for k, f in enumerate(_PROJ_ATOMS)])


_W = [unit_vector(np.random.default_rng(s), 4).tolist() for s in (11, 12, 13)]
_COMBO = combo_block(_W[0], _W[1], "combo")


def _columns_query(name, cands, names, cte, source, key):
    sql = f"WITH {cte} SELECT {key}, " + ", ".join(f"round({catalog.sql(c, names)},6) AS c{k}" for k, c in enumerate(cands)) + f" FROM {source}"

    @query(name, sql)
    def run(spark, sf):
        cols = [F.col(n) for n in names]
        return orders(spark, sf).select(key, *[rnd(catalog.column(c, cols), 6).alias(f"c{k}") for k, c in enumerate(cands)])

    return run


_columns_query("paired_atoms", _COMBO, ORDER_FEATURES, ORDER_SQL, "ord", "id")
_columns_query(
    "grammar_blocks",
    [
        Candidate("bilinear", "bilinear", {"i": 0, "j": 2}),
        Candidate("sinproj", "sinproj", {"w": _W[1], "b": 0.7}),
        Candidate("fct", "fct", {"w": _W[2], "b0": -0.4, "kappa": 1.3}),
        *dihedral_block(0, 3, "dihedral", use_r4=True),
        Candidate("relu", "relu_proj", {"w": _W[0], "t": 0.25}),
    ],
    ORDER_FEATURES,
    ORDER_SQL,
    "ord",
    "id",
)
_columns_query(
    "group_invariants",
    [*group_block(GroupSpec(((0, 3),), ((0, 1, 2),), ((2, 3),), ((1, 2, 3),)), "g", d=4, include_raw=True), *perm_block((1, 2, 3), "perm")],
    ORDER_FEATURES,
    ORDER_SQL,
    "ord",
    "id",
)
_REG = [Candidate(n, "graph", {"node": [n, {}, [0, 2] if a.arity == 2 else [0]]}) for n, a in REGISTRY.items()]
_REG += [Candidate("b", "graph", {"node": ["x_over_one_plus_beta_abs", {"beta": 0.35}, [0]]}), Candidate("s", "graph", {"node": ["sin_affine", {"omega": 1.7, "phi": 0.2}, [3]]})]
_columns_query("registry_ops", _REG, ORDER_FEATURES, ORDER_SQL, "ord", "id")
_columns_query("seed_features", seed_graph(4).outputs_as_candidates(), ORDER_FEATURES, ORDER_SQL, "ord", "id")
_columns_query(
    "expression_graph",
    Graph.from_nodes([["mul", {}, [["sin_affine", {"omega": 0.5, "phi": 1.0}, [0]], ["add", {}, [1, ["square", {}, [2]]]]]], ["max", {}, [["tanh", {}, [3]], ["abs", {}, [0]]]]]).outputs_as_candidates(),
    ORDER_FEATURES,
    ORDER_SQL,
    "ord",
    "id",
)
_columns_query("product_expansion", product_nodes(seed_graph(4), 12, seed=42), ORDER_FEATURES, ORDER_SQL, "ord", "id")


@query(
    "safe_division",
    "WITH v AS (SELECT event_id, value-100.0 AS a, CASE WHEN event_id%5=0 THEN 0.0 WHEN event_id%5=1 THEN -1e-10*(1+event_id%3) ELSE (event_id%11)-5.5 END AS b FROM events) SELECT event_id, CASE WHEN b=0 THEN CASE WHEN a>0 THEN 1e6 WHEN a<0 THEN -1e6 ELSE 0.0 END ELSE round(a/(sign(b)*greatest(abs(b),1e-8)),3) END AS q FROM v",
)
def _(spark, sf):
    """Guarded division: tiny divisors are floored, a zero divisor follows floating-point rules before capping."""
    k = F.col("event_id")
    b = F.when(k % 5 == 0, 0.0).when(k % 5 == 1, -1e-10 * (1 + k % 3)).otherwise(k % 11 - 5.5)
    q = finite(REGISTRY["safe_div"].column(F.col("a"), F.col("b")))
    return table(spark, sf, "events").select(k, (F.col("value") - 100.0).alias("a"), b.alias("b")).select("event_id", rnd(q, 3).alias("q"))


_MED = "(" + "+".join(f"({w!r})*x{j}" for j, w in enumerate(_W[0])) + ")"


@query(
    "relu_median",
    f"WITH {ORDER_SQL}, z AS (SELECT id, {_MED} AS z FROM ord), t AS (SELECT median(z) AS t FROM z) SELECT id, round(greatest(z-t,0.0),6) AS relu FROM z, t",
)
def _(spark, sf):
    """Hinge at the exact median of a projection; the median is found by counting, not sorting."""
    z = orders(spark, sf).select("id", catalog.dot(_W[0], [F.col(n) for n in ORDER_FEATURES]).alias("z"))
    t = median_of(z, F.col("z"))
    return z.select("id", rnd(F.greatest(F.col("z") - t, F.lit(0.0)), 6).alias("relu"))


_STEPS = [
    Step(Candidate("tanh", "unary", {"f": "tanh", "i": 0}), 0.1, 0.8),
    Step(Candidate("sq", "unary", {"f": "x^2", "i": 1}), 0.5, 0.3, (0.25,), 0.02, 0.9),
    Step(Candidate("pair", "hsml_binary", {"op": "*", "w1": _W[0], "w2": _W[1]}), 0.0, 1.5, (-0.4, 0.15), -0.05, 1.1),
]


@query(
    "residual_features",
    f"WITH {ORDER_SQL}, a AS (SELECT *, ({catalog.sql(_STEPS[0].cand, ORDER_FEATURES)}-0.1)/0.8 AS f0 FROM ord), b AS (SELECT *, (({catalog.sql(_STEPS[1].cand, ORDER_FEATURES)}-0.5)/0.3-0.25*f0-0.02)/0.9 AS f1 FROM a), c AS (SELECT *, ({catalog.sql(_STEPS[2].cand, ORDER_FEATURES)}/1.5+0.4*f0-0.15*f1+0.05)/1.1 AS f2 FROM b) SELECT id, round(f0,6) AS f0, round(f1,6) AS f1, round(f2,6) AS f2 FROM c",
)
def _(spark, sf):
    """Chained residualized features."""
    out = add_chain(orders(spark, sf), _STEPS, [F.col(n) for n in ORDER_FEATURES])
    return out.select("id", *[rnd(f"f{k}", 6).alias(f"f{k}") for k in range(3)])


@query(
    "fold_subset_weights",
    f"WITH {ORDER_SQL}, {FOLD_SQL}, k AS (SELECT unnest([0,1,2,3,4]) AS k) SELECT k, count(*) AS n_train, round(sum(1.0/variance)/count(*),6) AS mean_weight FROM k, folded WHERE fold<>k GROUP BY k",
)
def _(spark, sf):
    """Training weights of each fold: the noise is restricted to the fold's rows before it is inverted."""
    per = folded_orders(spark, sf).groupBy("fold").agg(F.count("*").alias("n"), F.sum(variance_weight(F.col("variance"))).alias("w"))
    n, w = per.agg(F.sum("n"), F.sum("w")).first()
    return per.select(F.col("fold").alias("k"), (n - F.col("n")).alias("n_train"), rnd((w - F.col("w")) / (n - F.col("n")), 6).alias("mean_weight"))


@query(
    "telemetry_features",
    f"WITH {TELEMETRY_SQL} SELECT record_id, episode, tick, " + ", ".join(f"round({f},6) AS {f}" for f in FEATURES) + " FROM feats",
)
def _(spark, sf):
    """The nineteen telemetry features, with previous value, position and running drops per episode."""
    return rounded(with_features(telemetry(spark, sf)).select("record_id", "episode", "tick", *FEATURES))


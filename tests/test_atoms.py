import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gramlaw.functions.atoms import REGISTRY, UNARY, apply_atom, apply_atom_array, finite, finite_array, forget, register_atom
from gramlaw.operators import catalog
from gramlaw.operators.catalog import Candidate, GroupSpec, build_bank, evaluate, group_block

EDGE = [0.0, -0.0, 1.0, -1.0, 3.5, -3.5, 25.0, -25.0, 1e-12, 1e300, -1e300, math.inf, -math.inf, math.nan]


def test_column_and_array_forms_agree(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(EDGE)], "k int, v double").coalesce(1)
    rows = df.select("k", *[apply_atom(f, F.col("v")).alias(f"a{i}") for i, f in enumerate(UNARY)]).orderBy("k").collect()
    x = np.array(EDGE)
    for i, f in enumerate(UNARY):
        np.testing.assert_allclose([r[f"a{i}"] for r in rows], apply_atom_array(f, x), rtol=1e-12, atol=1e-300, err_msg=f)


def test_null_counts_as_missing(spark):
    row = spark.createDataFrame([(None,)], "v double").select(*[apply_atom(f, F.col("v")).alias(f"a{i}") for i, f in enumerate(UNARY)]).first()
    assert set(row) == {0.0}


def test_registry_forms_agree(spark):
    pairs = [(a, b) for a in (-2.0, 0.0, 1.5) for b in (-3.0, 0.0, 1e-12, 2.0)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a double, b double").coalesce(1)
    A, B = np.array(pairs).T
    for name, op in REGISTRY.items():
        args = [F.col("a"), F.col("b")][: op.arity]
        got = [r[0] for r in df.orderBy("k").select(finite(op.column(*args))).collect()]
        with np.errstate(all="ignore"):
            want = finite_array(np.asarray(op.array(*[A, B][: op.arity]), float))
        np.testing.assert_allclose(got, want, rtol=1e-12, err_msg=name)


def test_user_atom_joins_the_bank():
    register_atom("x^4", lambda c: c * c * c * c, lambda a: a**4, "({x}*{x}*{x}*{x})")
    try:
        assert any(c.name == "x^4[x0]" for c in build_bank(np.eye(2), 1, 3, 1))
        assert apply_atom_array("x^4", np.array([2.0]))[0] == 16.0
    finally:
        forget("x^4")
    assert "x^4" not in UNARY


def test_bank_layout_and_determinism():
    a, b = build_bank(np.eye(4), 42), build_bank(np.eye(4), 42)
    assert [c.name for c in a] == [c.name for c in b]
    assert len(a) == 24 * 4 + 24 * 24 + 24 * 4
    assert len(build_bank(np.eye(1), 42)) == 24 + 24
    one_off = build_bank(np.eye(4), 42, skip_inputs=frozenset({2}))
    assert not any(c.kind == "unary" and c.args["i"] == 2 for c in one_off)


def _all_kinds():
    w = [0.5, -0.5, 0.5]
    spec = GroupSpec(((0, 1),), ((0, 1, 2),), ((0, 2),), ((1, 2),))
    return [
        *build_bank(np.eye(3), 5, 4, 2),
        Candidate("relu", "relu_proj", {"w": w, "t": 0.1}),
        Candidate("sin", "sinproj", {"w": w, "b": 0.3}),
        Candidate("fct", "fct", {"w": w, "b0": 0.2, "kappa": 1.4}),
        Candidate("bi", "bilinear", {"i": 0, "j": 2}),
        Candidate("r4", "radius", {"i": 0, "j": 1, "power": 2}),
        Candidate("g", "graph", {"node": ["mul", {}, [["sin_affine", {"omega": 2.0, "phi": 0.1}, [0]], ["safe_div", {}, [1, 2]]]]}),
        *group_block(spec, "grp", d=3, include_raw=True),
    ]


def test_batch_column_and_text_forms_agree(spark):
    cands = _all_kinds()
    X = np.random.default_rng(3).normal(size=(40, 3))
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(X)], "k int, x0 double, x1 double, x2 double").coalesce(1)
    want = evaluate(cands, X)
    for lo in range(0, len(cands), 20):
        part = cands[lo : lo + 20]
        rows = df.orderBy("k").select(*[catalog.column(c, [F.col(f"x{j}") for j in range(3)]).alias(f"c{i}") for i, c in enumerate(part)]).collect()
        np.testing.assert_allclose(np.array(rows), want[:, lo : lo + 20], rtol=1e-9, atol=1e-9)
        texts = df.orderBy("k").select(*[F.expr(catalog.sql(c, ["x0", "x1", "x2"])).cast("double").alias(f"c{i}") for i, c in enumerate(part)]).collect()
        np.testing.assert_allclose(np.array(texts), want[:, lo : lo + 20], rtol=1e-9, atol=1e-9)


def test_candidate_json_round_trip():
    for c in _all_kinds():
        back = Candidate.from_json(c.to_json())
        assert (back.name, back.kind, back.args) == (c.name, c.kind, c.args)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(allow_nan=True, allow_infinity=True), min_size=1, max_size=20))
def test_every_atom_is_finite(values):
    for f in UNARY:
        assert np.isfinite(apply_atom_array(f, np.array(values))).all() or f in ("x^2", "x^3", "gelu", "x/(1+x^2)", "swish", "x", "|x|", "sgn*x", "lrelu", "relu", "elu") and np.isfinite(
            finite_array(apply_atom_array(f, np.array(values)))
        ).all()


@pytest.mark.parametrize("kind", ["nonsense"])
def test_unknown_kind_is_an_error(kind):
    with pytest.raises(ValueError):
        evaluate([Candidate("q", kind, {})], np.zeros((2, 2)))

"""Tiled Gram and selection from its rows, against the dense form."""

import numpy as np
import pytest

from gramlaw.functions.atoms import UNARY
from gramlaw.operators import select, tiles
from gramlaw.operators.algebra import split_views, whole_view
from gramlaw.operators.catalog import Candidate, build_bank
from gramlaw.operators.gram import Design, gram, profile_inputs
from gramlaw.plans.options import Options


def frame(spark, n=600, d=4, parts=5):
    rng = np.random.default_rng(6)
    X = rng.normal(size=(n, d)) + 3.0
    y = 10.0 + np.sin(X[:, 0]) + 0.5 * X[:, 1] * X[:, 2] + 0.05 * rng.normal(size=n)
    rows = [(*map(float, x), float(t), float(t) ** 0.5, 0.2 + 0.1 * (k % 5), k % 3) for k, (x, t) in enumerate(zip(X, y))]
    df = spark.createDataFrame(rows, ", ".join(f"x{j} double" for j in range(d)) + ", y double, z double, w double, fold int")
    return df.repartition(parts)


def test_patches_hold_each_tile_once():
    for strips, sums, budget in ((1, 1, 1), (7, 2, 8 * 16 * 4 * 4), (20, 3, 10**6)):
        groups = tiles.patches(strips, 4, sums, budget)
        flat = [t for g in groups for t in g]
        assert sorted(flat) == [(a, b) for a in range(strips) for b in range(a, strips)]
        assert max(map(len, groups)) * 8 * 16 * sums <= max(budget, 8 * 16 * sums)


@pytest.mark.parametrize("weight", [None, "w"])
def test_selection_equals_the_dense_form(spark, weight):
    design = Design(frame(spark), [f"x{j}" for j in range(4)], ["y", "z"], leaf="fold", weight=weight)
    prof = profile_inputs(design)
    cands = build_bank(prof.corr(4), 42, 12, 18)
    assert len(cands) > 400
    names, opt = [c.name for c in cands], Options(max_ops=5)
    dense = gram(design, cands, prof)
    sums = 3 * (2 if weight else 1)
    tiled = tiles.tiled_gram(design, cands, prof, width=48, budget=8 * 48 * 48 * sums * 9)
    for t in (0, 1):
        pairs = list(zip(split_views(dense, t), tiles.tiled_views(tiled, t), strict=True))
        pairs.append(((None, whole_view(dense, t)), (None, tiles.tiled_whole(tiled, t))))
        for (k, want), (k2, got) in pairs:
            assert k == k2 and (want.n_tr, want.n_va) == (got.n_tr, got.n_va)
            np.testing.assert_array_equal(want.live, got.live)
            np.testing.assert_allclose(got.tr.diagonal(), want.tr.diagonal(), rtol=1e-7, atol=1e-6)
            for row in (0, 1, 200, want.y):
                np.testing.assert_allclose(got.va[row], want.va[row], rtol=1e-6, atol=1e-5)
            a, b = select.operator_set(want, names, opt), select.operator_set(got, names, opt)
            assert [o.name for o in a.ops] == [o.name for o in b.ops] and len(a.ops) > 2
            np.testing.assert_allclose([(o.coeff, o.stderr, o.bits) for o in b.ops], [(o.coeff, o.stderr, o.bits) for o in a.ops], rtol=1e-4)
            few = opt.patched(max_atoms=5)
            a, b = select.forward_atoms(want, few), select.forward_atoms(got, few)
            assert [names[j] for j in a.chosen] == [names[j] for j in b.chosen]
            np.testing.assert_allclose(b.score, a.score, rtol=1e-6)
    assert len({k for _, _, k in tiled.read}) < 100  # rows, not the matrix


def test_five_thousand_columns_in_bounded_tasks(spark):
    """209 inputs and 24 atoms of each: no task or driver holds a sum of more than the budget."""
    rng = np.random.default_rng(7)
    n, d = 500, 209
    X = rng.normal(size=(n, d))
    y = np.tanh(X[:, 17]) + 0.3 * X[:, 140] ** 2 + 0.01 * rng.normal(size=n)
    df = spark.createDataFrame([(x.tolist(), float(t)) for x, t in zip(X, y)], "x array<double>, y double").repartition(2)
    cands = [Candidate(f"{f}[x{i}]", "unary", {"f": f, "i": i}) for i in range(d) for f in UNARY]
    assert len(cands) > 5000
    budget = 16 << 20
    P = 2 + len(cands)
    strips = -(-P // 256)
    groups = tiles.patches(strips, 256, 1, budget)
    assert max(len(g) * 8 * 256 * 256 for g in groups) <= budget < 8 * P * P / 2
    tiled = tiles.tiled_gram(Design(df, "x", ["y"], dim=d), cands, width=256, budget=budget)
    og = select.operator_set(tiles.tiled_whole(tiled), [c.name for c in cands], Options(max_ops=3))
    assert {o.name.split("[")[1] for o in og.ops[:2]} == {"x17]", "x140]"} and len({k for _, _, k in tiled.read}) <= 8

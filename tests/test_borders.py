"""Graph moments gathered by borders against passes over all columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlaw.operators.algebra import split_views
from gramlaw.operators.gram import Design, gram, profile_inputs
from gramlaw.operators.graphs import graph_pool, node_candidate, seed_graph
from gramlaw.operators.refine import Generations, Scorer, columns_of, proposal, search_graphs, tune, view_of
from gramlaw.plans.options import Options

XS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(900, 3))
    y = 5e3 + np.sin(X[:, 0]) * X[:, 1] / (1 + 1.7 * np.abs(X[:, 1])) + 0.1 * rng.normal(size=900)
    data = [(k, *map(float, x), float(t), float(-t + x[0]), float(0.5 + k % 3)) for k, (x, t) in enumerate(zip(X, y))]
    df = spark.createDataFrame(data, "id long, a double, b double, c double, y double, z double, w double").repartition(3)
    return df.withColumn("fold", (F.col("id") % 4).cast("int")).cache()


def direct(design, prof, graph, key, opt, whole):
    """Energy of one graph from a pass over all its columns."""
    cands = columns_of([graph], opt)
    return Scorer(view_of(gram(design, cands, prof), *key, whole), {c.name: j for j, c in enumerate(cands)}, opt).energy(graph)


@pytest.mark.parametrize("weight", [None, "w"])
@pytest.mark.parametrize("whole", [False, True])
def test_generations_have_the_energies_of_full_passes(rows, weight, whole):
    """Three generations of products and parameter moves, two targets, with flipped inputs."""
    opt = Options(flip_inputs=(1,))
    design = Design(rows, XS, ["y", "z"], weight=weight, leaf="fold")
    origin, prof = profile_inputs(design).about_means()
    design = Design(rows, XS, ["y", "z"], weight=weight, leaf="fold", origin=origin)
    over = Generations.of(design, prof, opt, whole)
    rng = np.random.default_rng(8)
    front = [seed_graph(3)]
    over.gather([(g, None) for g in front])
    for _ in range(3):
        pairs = [(proposal(g, rng, True), g) for g in front for _ in range(4)]
        over.gather(pairs)
        graphs = [g for g, _ in pairs]
        assert {h.split(":")[0] for g in graphs for h in g.history} == {"add_mul", "opt"}
        for g in (graphs[0], graphs[-1]):
            for key in ((0, 0), (0, 1)) if whole else ((0, 1), (3, 0)):
                np.testing.assert_allclose(over.scorer(g, key).energy(g), direct(design, prof, g, key, opt, whole), rtol=1e-8)
        front = graphs[-3:]
        over.sums.keep(front)


def test_a_generation_gathers_a_small_part_of_all_products(spark):
    """A default generation of one fold from graphs that have grown already: a task holds at most a tenth of the products that
    a full pass over its columns holds (its square, of which half is shuffled)."""
    rng = np.random.default_rng(4)
    names = [f"x{j}" for j in range(8)]
    data = [(*map(float, x), float(x[0] * x[1]), k % 2) for k, x in enumerate(rng.normal(size=(300, 8)))]
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names) + ", y double, fold int")
    opt = Options()
    design = Design(df, names, ["y"], leaf="fold")
    over = Generations.of(design, profile_inputs(design), opt, False)
    start = seed_graph(8)
    over.gather([(start, None)])
    front = list({g.key(): g for g in (proposal(start, rng, True) for _ in range(opt.refine_frontier))}.values())
    over.gather([(g, start) for g in front])
    pairs = list({g.key(): (g, p) for p in front for g in (proposal(p, rng, True) for _ in range(opt.refine_proposals))}.values())
    over.gather(pairs)
    columns = len(columns_of([g for g, _ in pairs], opt))
    assert over.sums.numbers * 10 < (columns + 2) ** 2


def test_products_alone_give_the_graphs_of_full_passes(rows):
    """Without tuning, the beam keeps what a beam over full passes keeps."""
    opt = Options(refine_tune=False, refine_depth=2, refine_proposals=3, refine_frontier=2, folds=4)
    design = Design(rows, XS, ["y"], leaf="fold")
    prof = profile_inputs(design)
    keys = [(0, 0), (2, 0)]
    got = search_graphs(design, keys, prof, opt, False)
    for key in keys:
        assert direct(design, prof, got[key], key, opt, False) <= direct(design, prof, seed_graph(3), key, opt, False)
    over = Generations.of(design, prof, opt, False)
    again = search_graphs(design, keys, prof, opt, False, over)
    assert {k: g.key() for k, g in again.items()} == {k: g.key() for k, g in got.items()}


def test_tuning_lowers_the_loss_and_moves_towards_the_planted_parameter(rows):
    opt = Options(folds=4)
    design = Design(rows, XS, ["y"], leaf="fold")
    prof = profile_inputs(design)
    start = seed_graph(3)
    over = Generations.of(design, prof, opt, False)
    tuned = tune(design, {(1, 0): start}, prof, opt, False, over)[1, 0]

    def loss(g):
        cands = columns_of([g], opt)
        view = dict(split_views(gram(design, cands, prof)))[1]
        at = {c.name: j for j, c in enumerate(cands)}
        return Scorer(view, at, opt).loss([at[node_candidate(o).name] for o in g.outputs])

    assert loss(tuned) < loss(start)
    assert all(h.startswith("opt:") for h in tuned.history) and len(graph_pool(tuned)) == len(graph_pool(start))


def test_a_column_that_overflows_is_the_same_in_both(spark):
    """Infinite and missing inputs are capped alike in the shared dictionary."""
    data = [(k, float("inf") if k % 17 == 0 else float(k % 5) * 1e170, None if k % 11 == 0 else float(k % 7), 1.0 * (k % 3)) for k in range(200)]
    df = spark.createDataFrame(data, "id long, a double, b double, y double").withColumn("fold", (F.col("id") % 2).cast("int"))
    design = Design(df, ["a", "b"], ["y"], leaf="fold")
    prof = profile_inputs(design)
    opt = Options()
    over = Generations.of(design, prof, opt, False)
    g = seed_graph(2)
    big = g.grown(["mul", {}, [g.outputs[0], g.outputs[8]]], "add_mul")
    over.gather([(g, None)])
    over.gather([(big, g)])
    with np.errstate(all="ignore"):
        np.testing.assert_allclose(over.scorer(big, (0, 0)).energy(big), direct(design, prof, big, (0, 0), opt, False), rtol=1e-8)


def test_a_pass_makes_one_product_a_parent_and_none_a_graph(rows, monkeypatch):
    """The squares and pairs of new columns are summed together, and products of the same two columns in either order are one."""
    from gramlaw.operators import borders

    forms = []
    inner = borders.partial_moments
    monkeypatch.setattr(borders, "partial_moments", lambda *args, form: forms.append(form) or inner(*args, form=form))
    opt = Options()
    design = Design(rows, XS, ["y"], leaf="fold")
    prof = profile_inputs(design)
    over = Generations.of(design, prof, opt, False)
    start = seed_graph(3)
    over.gather([(start, None)])
    a, b = start.outputs[0], start.outputs[6]
    grown = [start.grown(["mul", {}, pair], "add_mul") for pair in ([a, b], [b, a])] + [start.grown(["mul", {}, [a, o]], "add_mul") for o in start.outputs[1:6]]
    over.gather([(g, start) for g in grown])
    assert len(forms[-1].pieces) <= 1 + 1  # what all parents share, and each parent's own part
    assert forms[-1].columns == 1 + len(start.outputs) + 6 + 1
    for g in grown:
        np.testing.assert_allclose(over.scorer(g, (1, 0)).energy(g), direct(design, prof, g, (1, 0), opt, False), rtol=1e-8)


def test_a_table_written_evenly_is_not_dealt_out_again(rows):
    from gramlaw.operators.gram import partial_moments, working_scale
    from gramlaw.session import materialise_evenly

    written = materialise_evenly(rows, "even")
    cands = columns_of([seed_graph(3)], Options())
    shuffles = []
    for even in (False, True):
        design = Design(written, XS, ["y"], leaf="fold", even=even)
        prof = profile_inputs(design)
        plan = partial_moments(design, cands, *working_scale(cands, prof))._jdf.queryExecution().executedPlan().toString()
        shuffles.append("Exchange" in plan)
    assert shuffles == [True, False]

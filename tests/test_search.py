from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlaw.functions.atoms import forget, register_atom, register_op
from gramlaw.operators.bagging import bag_buckets
from gramlaw.operators.gram import Design, gram
from gramlaw.operators.graphs import Graph, description_bits, node_candidate, nodes_frame, seed_graph
from gramlaw.operators.medians import training_medians
from gramlaw.operators.probe import Probe, probe_scores, probe_shifts, probes_for
from gramlaw.operators.catalog import GroupSpec
from gramlaw.operators.refine import diverse_best, move_distances
from gramlaw.plans.law import Law, score_laws
from gramlaw.plans.options import Options
from gramlaw.plans.search import search
from gramlaw.plans.stability import consensus, inclusion_counts, operator_stability, repeated_summary
from test_moments import frame

LIGHT = Options(n_proj=4, n_pairs=2, folds=4, bag_boots=4, bag_buckets=5, max_grammar=2, refine=False)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    n = 1500
    z = rng.normal(size=(n, 5))
    f = 1.3 * np.sin(z[:, 0] + 0.25) + 0.8 * np.maximum(0, z[:, 1] - 0.1) - 0.9 * z[:, 2] * z[:, 3] + 0.55 / (1 + np.abs(z[:, 4]))
    y = f + 0.2 * rng.normal(size=n)
    rows = [(k, *map(float, z[k]), float(y[k]), float(y[k] > 0)) for k in range(n)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"x{j} double" for j in range(5)) + ", y double, up double").repartition(4).cache()


XS = [f"x{j}" for j in range(5)]


def test_planted_law_is_found_and_scores_match_moments(planted):
    r = search(planted, XS, "y", "id", LIGHT)["y"]
    assert r.metrics["R2_OOF"] > 0.75
    names = {row[2] for row in r.op_log}
    assert any("x1" in n for n in names)
    from gramlaw.operators.splits import hashed_folds

    df = hashed_folds(planted, "id", LIGHT.folds, LIGHT.seed, "fold")
    scored = r.score_oof(df).select("y", "yhat").toPandas()
    mse = float(((scored.y - scored.yhat) ** 2).mean())
    np.testing.assert_allclose(mse, r.metrics["MSE_OOF"], rtol=1e-6)
    r2 = 1 - ((scored.y - scored.yhat) ** 2).sum() / ((scored.y - scored.y.mean()) ** 2).sum()
    np.testing.assert_allclose(r2, r.metrics["R2_OOF"], rtol=1e-6)


def test_a_large_offset_of_the_target_changes_nothing(planted):
    opt = LIGHT.patched(bag_boots=0, max_grammar=1)
    near = search(planted, XS, "y", "id", opt)["y"]
    for offset in (1e6, 1e9):
        far = search(planted.withColumn("y", F.col("y") + offset), XS, "y", "id", opt)["y"]
        assert [r[2] for r in far.op_log] == [r[2] for r in near.op_log] and far.consensus == near.consensus
        np.testing.assert_allclose(far.metrics["R2_OOF"], near.metrics["R2_OOF"], rtol=1e-4)
        np.testing.assert_allclose(far.metrics["MSE_OOF"], near.metrics["MSE_OOF"], rtol=1e-4)
        np.testing.assert_allclose(far.model.intercept - offset, near.model.intercept, atol=1e-3)


def test_missing_targets_cost_only_their_own_rows(planted):
    gaps = planted.withColumn("half", F.when(F.col("id") % 2 == 0, F.col("y"))).withColumn("y", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("y")))
    opt = LIGHT.patched(bag_boots=0, max_grammar=0)
    both = search(gaps, XS, ["y", "half"], "id", opt, consensus=False)
    assert [both[t].metrics["n"] for t in ("y", "half")] == [1499, 750]


def test_one_fold_is_no_cross_validation(planted):
    with pytest.raises(ValueError, match="at least two folds"):
        search(planted.withColumn("f", F.lit(0)), XS, "y", "id", LIGHT, fold="f")


def test_probe_forms_agree_for_two_flips_and_many_draws(planted):
    from gramlaw.operators.catalog import Candidate

    law = Law(0.5, ((1.0, Candidate("x", "unary", {"f": "x", "i": 0})), (2.0, Candidate("y", "unary", {"f": "tanh", "i": 1}))), tuple(XS))
    probes = [Probe("flip", (0,), p=0.1), Probe("flip", (0, 1), p=0.9), Probe("perm", (0, 1, 2))]
    key = lambda r: (r["sampler"], r["draw"])
    for draws in (3, 70):
        one, two = ({key(r): r["shift"] for r in probe_shifts(planted.limit(200), law, probes[: 3 if draws < 9 else 1], "id", draws, batches=b).collect()} for b in (False, True))
        assert one.keys() == two.keys()
        np.testing.assert_allclose([one[k] for k in sorted(one)], [two[k] for k in sorted(one)], rtol=1e-9)


def test_missing_and_infinite_inputs_mean_the_same_in_every_form(spark):
    import duckdb
    from gramlaw.operators.catalog import Candidate
    from gramlaw.plans.law import score_array

    nan, inf = float("nan"), float("inf")
    values = [(0, 2.0, None), (1, None, 3.0), (2, nan, 1.0), (3, 1.0, inf), (4, -inf, nan), (5, 0.5, -0.25), (6, None, None)]
    df = spark.createDataFrame(values, "id int, a double, b double")
    kinds = [
        Candidate("p", "hsml_unary", {"f": "x", "w": [1.0, 0.0]}),
        Candidate("q", "hsml_unary", {"f": "tanh", "w": [0.6, 0.8]}),
        Candidate("r", "relu_proj", {"w": [0.0, 1.0], "t": 0.1}),
        Candidate("s", "sinproj", {"w": [0.0, 2.0], "b": 0.3}),
        Candidate("f", "fct", {"w": [1.0, 0.0], "b0": 0.2, "kappa": 1.5}),
        Candidate("m", "hsml_binary", {"op": "*", "w1": [1.0, 0.0], "w2": [0.0, 1.0]}),
    ]
    db = duckdb.connect()
    db.sql("create table t(id int, a double, b double)")
    db.executemany("insert into t values (?, ?, ?)", values)
    for c in kinds:
        law = Law(0.25, ((1.5, c),), ("a", "b"))
        rows = df.select("id", law.column().alias("c"), F.element_at(score_array([law]), 1).alias("n")).orderBy("id").collect()
        sql = [v for (v,) in db.sql(f"select {law.sql()} from t order by id").fetchall()]
        np.testing.assert_allclose([r["c"] for r in rows], [r["n"] for r in rows], rtol=1e-12, err_msg=c.name)
        np.testing.assert_allclose([r["c"] for r in rows], sql, rtol=1e-12, err_msg=c.name)


def test_targets_share_moments_without_changing_results(planted):
    opt = LIGHT.patched(bag_boots=0, max_grammar=0)
    both = search(planted, XS, ["y", "up"], "id", opt, consensus=False)
    alone = search(planted, XS, "up", "id", opt, consensus=False)["up"]
    np.testing.assert_allclose(both["up"].metrics["MSE_OOF"], alone.metrics["MSE_OOF"], rtol=1e-7)
    assert [r[2] for r in both["up"].op_log] == [r[2] for r in alone.op_log]


def test_repetition_counts_equal_real_copies(planted):
    counted = planted.withColumn("times", (F.col("id") % 3 + 1).cast("double"))
    copied = counted.withColumn("c", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    opt = LIGHT.patched(max_atoms=3, max_ops=4, max_grammar=1, linear_lock=2.0)
    a = search(counted, XS, "y", "id", opt, copies="times", consensus=False)["y"]
    b = search(copied, XS, "y", "id", opt, consensus=False)["y"]
    assert [f.view.n_tr for f in a.folds] == [f.view.n_tr for f in b.folds]
    assert [(r[1], r[2], r[9]) for r in a.op_log] == [(r[1], r[2], r[9]) for r in b.op_log]
    assert [f.blocks for f in a.folds] == [f.blocks for f in b.folds]
    np.testing.assert_allclose(a.metrics["MSE_OOF"], b.metrics["MSE_OOF"], rtol=1e-6)


def test_pairs_that_differ_by_rounding_are_equal():
    from gramlaw.operators.catalog import closest_pair

    corr = np.array([[1.0, 0.2, 1.0 - 3e-16, 0.1], [0.2, 1.0, 0.3, -1.0], [1.0 - 3e-16, 0.3, 1.0, 0.4], [0.1, -1.0, 0.4, 1.0]])
    assert closest_pair(corr) == (0, 2) and closest_pair(np.where(corr < 0, 0.5, corr)) == (0, 2)
    assert closest_pair(np.array([[1.0, 1e-12, 0.0], [1e-12, 1.0, 3e-12], [0.0, 3e-12, 1.0]])) == (1, 2)


def test_known_sums_give_the_same_law_also_where_the_bank_is_another(planted):
    opt = LIGHT.patched(bag_boots=0, max_atoms=3, max_ops=4, max_grammar=1, linear_lock=2.0)
    counted = planted.withColumn("times", F.when(F.col("id") % 3 == 0, 4.0).otherwise(1.0))
    known = search(planted, XS, "y", "id", opt, consensus=False)["y"].gathered
    assert search(counted, XS, "y", "id", opt, copies="times", consensus=False)["y"].gathered is None
    a = search(counted, XS, "y", "id", opt, copies="times")["y"]
    other = replace(known, table=replace(known.table, cands=known.table.cands[:-1]))
    for some in (known, other):
        b = search(counted, XS, "y", "id", opt, copies="times", known=some)["y"]
        assert [(r[1], r[2]) for r in a.op_log] == [(r[1], r[2]) for r in b.op_log] and [f.blocks for f in a.folds] == [f.blocks for f in b.folds]
        assert [f.view.n_tr for f in a.folds] == [f.view.n_tr for f in b.folds]
        np.testing.assert_allclose(a.metrics["MSE_OOF"], b.metrics["MSE_OOF"], rtol=1e-7)
        np.testing.assert_allclose([w for w, _ in a.model.terms], [w for w, _ in b.model.terms], rtol=1e-5)
    once = planted.withColumn("times", F.lit(1.0))  # nothing to add
    b = search(once, XS, "y", "id", opt, copies="times", known=known, consensus=False)["y"]
    assert b.metrics["n"] == planted.count()


def test_grammar_and_refiner_improve_an_unlocked_law(planted):
    base = LIGHT.patched(bag_boots=0, max_atoms=2, max_ops=1, max_grammar=0, linear_lock=2.0)
    plain = search(planted, XS, "y", "id", base, consensus=False)["y"]
    grown = search(planted, XS, "y", "id", base.patched(max_grammar=3), consensus=False)["y"]
    assert grown.metrics["MSE_OOF"] < plain.metrics["MSE_OOF"]
    assert any(f.blocks for f in grown.folds)
    opt = base.patched(refine=True, refine_depth=1, refine_proposals=2, refine_frontier=2, refine_tune=False)
    refined = search(planted, XS, "y", "id", opt, consensus=True)["y"]
    assert refined.metrics["MSE_OOF"] < plain.metrics["MSE_OOF"]
    back = Law.from_json(refined.model.to_json())
    a, b = (score_laws(planted, {"p": law}).agg(F.sum("p")).first()[0] for law in (refined.model, back))
    np.testing.assert_allclose(a, b, rtol=1e-12)


def test_law_saves_and_loads(spark, planted, tmp_path):
    law = search(planted, XS, "y", "id", LIGHT.patched(bag_boots=0, max_atoms=3, max_ops=2, max_grammar=0))["y"].model
    law.save(spark, str(tmp_path / "law"))
    again = Law.load(spark, str(tmp_path / "law"))
    one = score_laws(planted, {"a": law, "b": again}).select((F.col("a") - F.col("b")).alias("d"), F.expr(law.sql(XS)).alias("t"), "a")
    worst = one.agg(F.max(F.abs("d")), F.max(F.abs(F.col("t") - F.col("a")))).first()
    assert worst[0] == 0.0 and worst[1] < 1e-9


def test_reports_are_tables(spark, planted):
    r = search(planted, XS, "y", "id", LIGHT.patched(max_grammar=0))["y"]
    ops, folds = r.ops_frame(spark), r.fold_frame(spark)
    s = operator_stability(ops, LIGHT.folds)
    assert s.where("fold_freq > 1 or sign_stability > 1").count() == 0
    assert sorted(x["name"] for x in consensus(s).collect()) == sorted(r.consensus)
    assert folds.count() == LIGHT.folds and inclusion_counts(folds).count() > 0
    assert repeated_summary(folds).first()["fits"] == LIGHT.folds
    assert ops.where("bag_freq < 0.6").count() == 0


def test_bags_keep_their_share_of_buckets():
    bags = bag_buckets(Options())
    assert len(bags) == 8 and all(len(set(b)) == 8 for b in bags)


def test_several_passes_give_the_same_law(planted, monkeypatch):
    import gramlaw.plans.search as module

    opt = LIGHT.patched(max_grammar=0)
    a = search(planted, XS, "y", "id", opt, consensus=False)["y"]
    monkeypatch.setattr(module, "ACCUMULATOR_BYTES", 1)
    b = search(planted, XS, "y", "id", opt, consensus=False)["y"]
    assert [(r[1], r[2], r[9]) for r in a.op_log] == [(r[1], r[2], r[9]) for r in b.op_log]
    np.testing.assert_allclose(a.metrics["MSE_OOF"], b.metrics["MSE_OOF"], rtol=1e-8)


def test_training_medians(spark):
    df, X, y, _ = frame(spark, n=501)
    W = [[1.0, 0.0, 0.0], [0.5, -0.5, 0.7]]
    got = training_medians(Design(df, ["x0", "x1", "x2"], ["y"], leaf="fold"), W, [0, 3], False)
    fold = np.arange(501) % 5
    for k in (0, 3):
        for r, w in enumerate(W):
            np.testing.assert_allclose(got[k, r], np.median((X @ np.array(w))[fold != k]), rtol=1e-12)
    tied = spark.range(30000).select((F.col("id") % 3).cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(0).alias("f"))
    assert training_medians(Design(tied, ["x"], ["y"], leaf="f"), [[1.0]], [0], True)[0, 0] == 1.0


def test_single_input(spark):
    df, X, y, _ = frame(spark, n=300)
    df = df.withColumn("t", F.tanh("x0") * 2 + 1)
    r = search(df, ["x0"], "t", "id", LIGHT.patched(bag_boots=0))["t"]
    assert r.metrics["R2_OOF"] > 0.999


def test_graph_tables(spark):
    g = seed_graph(2)
    bigger = g.grown(["mul", {}, [g.outputs[0], g.outputs[7]]], "add_mul")
    rows = {r["state_id"]: r["bits"] for r in description_bits(nodes_frame(spark, [g, bigger])).collect()}
    np.testing.assert_allclose([rows[0], rows[1]], [g.bits(), bigger.bits()])
    swapped = g.replaced(g.outputs[4], [g.outputs[4][0], {"beta": 2.0}, [0]], "opt")
    assert swapped.outputs[4][1] == {"beta": 2.0} and swapped.outputs[:4] == g.outputs[:4]
    a, b = Graph(1, (0,), ("p", "q", "r")), Graph(1, (0,), ("p", "q"))
    assert move_distances([a, b, g]).tolist() == [[0.0, 0.5, 1.0], [0.5, 0.0, 1.0], [1.0, 1.0, 0.0]]
    assert [s for _, s in diverse_best([(a, 2.0), (b, 1.0), (a, 3.0)], 2)] == [1.0, 2.0]


def test_probe_of_invariant_law_is_zero(spark):
    df, X, y, _ = frame(spark, n=200)
    from gramlaw.operators.catalog import Candidate

    even = Law(0.0, ((1.0, Candidate("sq", "unary", {"f": "x^2", "i": 0})),), ("x0", "x1", "x2"))
    spec = GroupSpec(((0, 1, 2),), (), ((1, 2),), ((1, 2),))
    scores = {r["kind"]: r["score"] for r in probe_scores(probe_shifts(df, even, probes_for(spec), "id", 3)).collect()}
    assert scores == {"flip": 0.0, "rotate": 0.0, "scale": 0.0}
    moved = probe_scores(probe_shifts(df, even, [Probe("scale", (0,)), Probe("rotate", (0, 1))], "id", 3)).collect()
    assert all(r["score"] > 0 for r in moved)


def test_staged_input_changes_nothing(planted):
    opt = LIGHT.patched(bag_boots=0, max_grammar=0, max_atoms=4)
    a = search(planted, XS, "y", "id", opt, consensus=False)["y"]
    b = search(planted.withColumn("unused", F.lit("z")), XS, "y", "id", opt, consensus=False, stage=True)["y"]
    np.testing.assert_allclose(a.metrics["MSE_OOF"], b.metrics["MSE_OOF"], rtol=1e-9)


def test_ar1_folds_keep_series_together(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(12):
        e = 0.0
        for t in range(60):
            x = float(rng.normal())
            e = 0.9 * e + float(rng.normal()) * 0.3
            rows.append((s, t, s * 60 + t, x, float(np.tanh(x) + e)))
    df = spark.createDataFrame(rows, "series int, t int, id int, x double, y double").repartition(4)
    from gramlaw.operators.noise import Ar1

    opt = LIGHT.patched(bag_boots=3, max_grammar=0, max_atoms=4, folds=3)
    r = search(df, ["x"], "y", "id", opt, ar1=Ar1("series", "t", 0.9, 0.7), consensus=False, stage=True)["y"]
    assert r.metrics["R2_OOF_GLS"] > 0.5 and r.op_log
    assert sum(f.view.n_va for f in r.folds) == 720 and all(f.view.n_va % 60 == 0 for f in r.folds)


def test_user_atoms_operators_and_groups_reach_the_executors(spark):
    """A law of a user's atom and a user's graph operator, and a group spec given by the user."""
    register_atom("bump", lambda c: F.exp(-c * c), lambda a: np.exp(-a * a), "exp(-({x}*{x}))")
    register_op("wave", lambda c, rate=2.0: F.sin(c * rate) * c, lambda a, rate=2.0: np.sin(rate * a) * a, params={"rate": 2.0}, sql="(sin({rate}*{x})*{x})")
    try:
        rng = np.random.default_rng(12)
        X = rng.normal(size=(400, 3))
        y = 2.0 * np.exp(-X[:, 0] ** 2) + 0.3 + 0.01 * rng.normal(size=400)
        df = spark.createDataFrame([(k, *map(float, x), float(t)) for k, (x, t) in enumerate(zip(X, y))], "id long, x0 double, x1 double, x2 double, y double").repartition(4)
        opt = LIGHT.patched(bag_boots=3, max_grammar=1, linear_lock=2.0)
        spec = GroupSpec(((0, 1, 2),), (), ((1, 2),), ((1, 2),))
        report = search(df, ["x0", "x1", "x2"], "y", "id", opt, spec=spec)["y"]
        assert "og:bump[x0]" in report.consensus and report.metrics["R2_OOF"] > 0.99
        scored = report.model.score(df).select("y", "yhat").toPandas()
        assert np.abs(scored["y"] - scored["yhat"]).max() < 0.2
        node = node_candidate(["wave", {"rate": 2.0}, [1]])
        g = gram(Design(df, ["x0", "x1", "x2"], ["y"]), [node])
        z = np.sin(2.0 * X[:, 1]) * X[:, 1]
        np.testing.assert_allclose(g.total().means()[1] * g.scale[0] + g.centre[0], z.mean(), rtol=1e-9)
    finally:
        forget("bump")
        forget("wave")


def test_dataset_summary_searches_every_table_with_all_options(spark, monkeypatch):
    """No table has fewer projections, pairs, atoms, bags or stages than the defaults."""
    from types import SimpleNamespace

    from gramlaw.queries import QUERIES, searches

    seen = []

    def record(df, features, target, key, opt=Options(), **extra):
        seen.append((opt, df.count(), extra.get("dim", len(features))))
        return {target: SimpleNamespace(metrics={"n": 1, "R2_OOF": 0.0, "MSE_OOF": 0.0}, op_log=[])}

    monkeypatch.setattr(searches, "search", record)
    sf = "/root/testdata/sf0.001"
    assert QUERIES["dataset_summary"](spark, sf).count() == 4
    assert [opt for opt, _, _ in seen] == [Options()] * 4
    assert seen[3][1:] == (spark.read.parquet(f"{sf}/embeddings.parquet").count(), 64)


def test_a_wide_bank_sends_the_sums_of_each_leaf_once(spark):
    """Rows dealt by leaf: as many sums as a leaf has tasks, not one a task and leaf, and the moments of a plain pass."""
    from gramlaw.operators.catalog import Candidate
    from gramlaw.operators.gram import Design, dealt_moments, partial_moments, profile_inputs, unpack, working_scale

    rng = np.random.default_rng(3)
    data = [(int(k % 40), float(v), float(v * v + k % 3)) for k, v in enumerate(rng.normal(size=4000))]
    df = spark.createDataFrame(data, "leaf int, x double, y double").repartition(8)
    design = Design(df, ["x"], ["y"], leaf="leaf")
    cands = [Candidate(f, "unary", {"f": f, "i": 0}) for f in ("x", "sin", "tanh")]
    centre, scale = working_scale(cands, profile_inputs(design))
    dealt = dealt_moments(design, cands, centre, scale, 40).collect()
    each = -(-2 * spark.sparkContext.defaultParallelism // 40)
    assert len(dealt) <= 40 * each < partial_moments(design, cands, centre, scale).count()
    total = []
    for one in (dealt, partial_moments(design, cands, centre, scale).collect()):
        sums = {}
        for r in one:
            (M, n), = unpack([r], 5).values()
            sums[r["leaf"]] = sums.get(r["leaf"], 0) + np.append(M, n)
        total.append(np.array([sums[k] for k in range(40)]))
    np.testing.assert_allclose(*total, rtol=1e-9, atol=1e-9)

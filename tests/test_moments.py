import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlaw.operators.algebra import fold_view, orthonormal_map, residualize, ridge, split_views, whole_view
from gramlaw.operators.catalog import Candidate, build_bank, evaluate
from gramlaw.operators.gram import PLAIN, WEIGHTED, Design, gram, profile_inputs, salted_sum, sum_partials, working_scale
from gramlaw.operators.noise import Ar1, ar1_frame, sparse_chi2, variance_weight, whiten_blocks
from gramlaw.plans.basis import evaluate_basis, evaluate_external, raw_moments


def frame(spark, n=600, d=3, seed=1):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d)) * [1.0, 2.0, 0.5][:d] + [0.0, 5.0, -1.0][:d]
    y = np.sin(X[:, 0]) + 0.3 * X[:, 1] * X[:, -1] + 0.05 * rng.normal(size=n)
    s = 0.2 + rng.random(n)
    s[:7] = -1.0
    rows = [(k, *map(float, X[k]), float(y[k]), float(s[k]), int(k % 5)) for k in range(n)]
    cols = "id long, " + ", ".join(f"x{j} double" for j in range(d)) + ", y double, s double, fold int"
    return spark.createDataFrame(rows, cols).repartition(6), X, y, s


def dense(cands, X, y, w=None):
    U = np.hstack([np.ones((len(X), 1)), evaluate(cands, X), y[:, None]])
    return U.T @ (U if w is None else U * w[:, None])


def in_raw_units(g, m):
    P = 1 + m.p + m.t
    T = np.eye(P)
    T[1 : 1 + m.p, 0] = g.centre
    T[np.arange(1, 1 + m.p), np.arange(1, 1 + m.p)] = g.scale
    return T @ m.M @ T.T


def test_gram_equals_dense(spark):
    df, X, y, s = frame(spark)
    df = df.withColumn("w", variance_weight(F.col("s")))
    cands = build_bank(np.eye(3), 7, 4, 2)
    g = gram(Design(df, ["x0", "x1", "x2"], ["y"], weight="w", leaf="fold"), cands)
    w = np.where(s > 0, 1 / np.maximum(s, 1e-12), 0)
    for kind, weight in ((PLAIN, None), (WEIGHTED, w)):
        got = in_raw_units(g, g.total(kind))
        want = dense(cands, X, y, weight)
        np.testing.assert_allclose(got, want, rtol=1e-8, atol=1e-6 * np.abs(want).max())
    assert g.total().n == 600
    one = g.leaves[2, PLAIN]
    rows = np.arange(600) % 5 == 2
    want = dense(cands, X[rows], y[rows])
    np.testing.assert_allclose(in_raw_units(g, one), want, rtol=1e-8, atol=1e-6 * np.abs(want).max())


def test_salted_levels_give_the_same_sum(spark):
    df, X, y, _ = frame(spark)
    from gramlaw.operators.gram import partial_moments, unpack

    cands = build_bank(np.eye(3), 7, 3, 1)
    parts = partial_moments(Design(df, ["x0", "x1", "x2"], ["y"], leaf="fold"), cands, np.zeros(len(cands) + 1), np.ones(len(cands) + 1)).cache()
    P = len(cands) + 2
    a = unpack(sum_partials(parts, 4, 1).collect(), P)
    b = unpack(sum_partials(parts, 4, 3).collect(), P)
    assert a.keys() == b.keys() and salted_sum(parts, 4, 1) is parts
    for k in a:
        np.testing.assert_allclose(a[k][0], b[k][0], rtol=1e-10)
        assert a[k][1] == b[k][1]


def test_array_column_input(spark):
    df, X, y, _ = frame(spark)
    arr = df.select("y", F.array("x0", "x1", "x2").alias("v"))
    cands = build_bank(np.eye(3), 7, 3, 1)
    g = gram(Design(arr, "v", ["y"], dim=3), cands)
    want = dense(cands, X, y)
    np.testing.assert_allclose(in_raw_units(g, g.total()), want, rtol=1e-8, atol=1e-6 * np.abs(want).max())


def test_missing_and_infinite_inputs(spark):
    rows = [(1.0, 1.0), (float("nan"), 2.0), (float("inf"), 3.0), (None, 4.0), (2.0, None)]
    df = spark.createDataFrame(rows, "x double, y double")
    g = gram(Design(df, ["x"], ["y"]), [Candidate("x", "unary", {"f": "x", "i": 0})])
    M = in_raw_units(g, g.total())
    assert g.total().n == 4
    np.testing.assert_allclose(M[0, 1], 1.0 + 0.0 + 1e6 + 0.0)


def test_constant_and_duplicate_columns(spark):
    df, X, y, _ = frame(spark)
    df = df.withColumn("c", F.lit(4.0)).withColumn("twin", F.col("x0"))
    cands = [Candidate(n, "unary", {"f": "x", "i": j}) for j, n in enumerate(["x0", "c", "twin"])]
    view = whole_view(gram(Design(df, ["x0", "c", "twin"], ["y"]), cands))
    assert view.live.tolist() == [True, False, True]


def test_fold_scaling_matches_rows(spark):
    df, X, y, _ = frame(spark)
    cands = build_bank(np.eye(3), 7, 3, 1)
    g = gram(Design(df, ["x0", "x1", "x2"], ["y"], leaf="fold"), cands)
    k, view = split_views(g)[3]
    rows = np.arange(600) % 5 != k
    Z = evaluate(cands, X)
    live = view.live
    np.testing.assert_allclose(view.shift[live], Z[rows].mean(0)[live], rtol=1e-7, atol=1e-7)
    np.testing.assert_allclose(view.scale[live], Z[rows].std(0)[live], rtol=1e-7)
    assert (view.n_tr, view.n_va) == (480, 120)


def test_ar1_moments_equal_dense_whitening(spark):
    rng = np.random.default_rng(5)
    rows, blocks = [], []
    for series in range(4):
        steps = np.sort(rng.choice(60, size=25, replace=False))
        x = rng.normal(size=25)
        y = np.tanh(x) + rng.normal(size=25) * 0.1
        rows += [(series, int(t), float(a), float(b)) for t, a, b in zip(steps, x, y)]
        S = 0.49 * 0.8 ** np.abs(np.subtract.outer(steps, steps))
        blocks.append((x, y, np.linalg.inv(S)))
    df = ar1_frame(spark.createDataFrame(rows, "series int, t int, x double, y double"), Ar1("series", "t", 0.8, 0.7), ["x", "y"])
    cands = [Candidate("x", "unary", {"f": "x", "i": 0}), Candidate("tanh", "unary", {"f": "tanh", "i": 0})]
    g = gram(Design(df, ["x"], ["y"], lagged=True), cands)
    want = np.zeros((4, 4))
    for x, y, W in blocks:
        U = np.column_stack([np.ones(25), x, np.tanh(x), y])
        want += U.T @ W @ U
    np.testing.assert_allclose(in_raw_units(g, g.total(WEIGHTED)), want, rtol=1e-9)


def test_block_whitening_equals_dense(spark):
    rng = np.random.default_rng(6)
    rows, entries, want = [], [], {}
    for b in range(5):
        n = 2 + b
        A = rng.normal(size=(n, n))
        S = A @ A.T + np.eye(n)
        x = rng.normal(size=(n, 2))
        rows += [(b, i, float(x[i, 0]), float(x[i, 1])) for i in range(n)]
        entries += [(b, i, j, float(S[i, j])) for i in range(n) for j in range(n)]
        want[b] = x.T @ np.linalg.inv(S) @ x
    df = spark.createDataFrame(rows, "b int, i int, p double, q double")
    out = whiten_blocks(df, "b", "i", ["p", "q"], spark.createDataFrame(entries, "b int, i int, j int, v double")).collect()
    for b in want:
        V = np.array([(r["white_p"], r["white_q"]) for r in out if r["b"] == b])
        np.testing.assert_allclose(V.T @ V, want[b], rtol=1e-9)
    with pytest.raises(ValueError):
        whiten_blocks(df, "b", "i", ["p"], spark.createDataFrame(entries, "b int, i int, j int, v double"), max_block=3)


def test_ridge_and_residualization_on_moments(spark):
    df, X, y, s = frame(spark)
    K, n = raw_moments(Design(df, ["x0", "x1", "x2"], ["y"]))
    w, b0 = ridge(K, 1e-3)
    Xc, yc = X - X.mean(0), y - y.mean()
    want = np.linalg.solve(Xc.T @ Xc + 1e-3 * np.eye(3), Xc.T @ yc)
    np.testing.assert_allclose(w, want, rtol=1e-8)
    np.testing.assert_allclose(b0, y.mean() - X.mean(0) @ want, rtol=1e-8)
    gamma = residualize(K[1:3, 1:3], K[1:3, 3:4], 0.0)
    R = X[:, 2] - X[:, :2] @ gamma[:, 0]
    np.testing.assert_allclose(X[:, :2].T @ R, 0, atol=1e-8)
    T = orthonormal_map(K[1:4, 1:4])
    np.testing.assert_allclose(T.T @ K[1:4, 1:4] @ T, np.eye(3), atol=1e-10)


def test_singular_systems_fall_back():
    G = np.ones((2, 2))
    assert np.isfinite(residualize(G, np.ones((2, 1)), 0.0)).all()
    assert np.isfinite(orthonormal_map(G)).all()


def test_external_basis_reports_all_criteria(spark):
    df, X, y, s = frame(spark)
    fit = evaluate_basis(Design(df.where("s > 0"), ["x0", "x2"], ["y"]), 2e-3, "s")
    rows = {r["model"]: r for r in fit.comparison(spark).collect()}
    assert rows["basis"]["aicc"] < rows["intercept"]["aicc"] and rows["basis"]["delta_bic_bits"] > 0
    amps = [abs(r["amplitude"]) for r in fit.amplitudes(spark).collect()]
    assert amps == sorted(amps, reverse=True)


def test_empty_table_is_an_error(spark):
    with pytest.raises(ValueError):
        profile_inputs(Design(spark.createDataFrame([], "x double, y double"), ["x"], ["y"]))


def test_external_basis_with_dense_and_diagonal_covariance(spark):
    rng = np.random.default_rng(9)
    n = 30
    B = rng.normal(size=(n, 2))
    y = B @ [1.0, -0.5] + 0.3 + 0.1 * rng.normal(size=n)
    basis = spark.createDataFrame([(i, *map(float, B[i])) for i in range(n)], "i long, b0 double, b1 double")
    target = spark.createDataFrame([(i, float(y[i])) for i in range(n)], "i long, y double")
    full = 0.3 * 0.6 ** np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    for S in (full, np.diag(0.5 + rng.random(n))):
        entries = spark.createDataFrame([(i, j, float(S[i, j])) for i in range(n) for j in range(n)], "i long, j long, v double")
        fit = evaluate_external(basis, target, entries, 2)
        W = np.linalg.inv(S)
        one = np.ones(n)
        mu, my = one @ W @ B / (one @ W @ one), one @ W @ y / (one @ W @ one)
        w = np.linalg.solve((B - mu).T @ W @ (B - mu) + 2e-3 * np.eye(2), (B - mu).T @ W @ (y - my))
        np.testing.assert_allclose(fit.weights, w, rtol=1e-7)
        r = y - B @ w - (my - mu @ w)
        np.testing.assert_allclose(fit.checks["chi2"], r @ W @ r, rtol=1e-7)
    with pytest.raises(ValueError):
        evaluate_external(basis.where("i < 5"), target, entries, 2)


def test_sparse_chi2_with_a_heavy_column(spark):
    rng = np.random.default_rng(10)
    r = rng.normal(size=60)
    W = [(i, 0 if rng.random() < 0.4 else int(rng.integers(0, 60)), float(rng.normal())) for i in range(60) for _ in range(5)]
    res = spark.createDataFrame([(k, float(v)) for k, v in enumerate(r)], "k long, r double")
    prec = spark.createDataFrame(W, "i long, j long, w double")
    want = sum(w * r[i] * r[j] for i, j, w in W)
    for limit in (20, 10**6):
        np.testing.assert_allclose(sparse_chi2(res, "k", "r", prec, limit).first()[0], want, rtol=1e-10)


def test_bags_equal_selection_on_the_kept_rows(spark):
    from gramlaw.operators import select
    from gramlaw.operators.bagging import bag_buckets, bag_picks
    from gramlaw.plans.options import Options
    from gramlaw.plans.search import leaf_table

    df, X, y, _ = frame(spark, n=600)
    opt = Options(bag_boots=3, bag_buckets=5)
    cands = build_bank(np.eye(3), 7, 4, 2)
    design = Design(df, ["x0", "x1", "x2"], ["y"], leaf="fold")
    prof = profile_inputs(design)
    gt, sums = leaf_table(design, cands, prof, opt, ["id"], True)
    views = dict(split_views(gt))
    scales = {k: ((v.shift - gt.centre) / gt.scale, v.scale / gt.scale, v.live) for k, v in views.items()}
    got = {(r["fold"], r["bag"], r["idx"]) for r in bag_picks(sums, PLAIN, len(cands), 1, scales, {(k, 0): 4 for k in views}, opt).collect()}
    bucket = dict(df.select("id", F.pmod(F.xxhash64("id", F.lit(opt.seed), F.lit("bag")), F.lit(5)).alias("b")).collect())
    Z = evaluate(cands, X)
    want = set()
    for k, v in views.items():
        for b, kept in enumerate(bag_buckets(opt)):
            rows = np.array([i % 5 != k and bucket[i] in kept for i in range(600)])
            U = np.column_stack([np.ones(rows.sum()), (Z[rows] - v.shift) / v.scale, y[rows]])
            picks, *_ = select.greedy_operators(U.T @ U, int(rows.sum()), v.live, opt, limit=4)
            want |= {(k, b, j) for j in picks}
    assert got == want


@pytest.mark.parametrize("few", [1000, 3])
def test_exact_bags_equal_selection_on_their_rows(spark, monkeypatch, few):
    from gramlaw.operators import bags, select
    from gramlaw.operators.bagging import bag_picks
    from gramlaw.plans.options import Options
    from gramlaw.plans.search import leaf_table

    monkeypatch.setattr(bags, "FEW", few)
    df, X, y, _ = frame(spark, n=600)
    opt = Options(bag_boots=3, bag_exact=True, bag_frac=0.8)
    cands = build_bank(np.eye(3), 7, 4, 2)
    design = Design(df, ["x0", "x1", "x2"], ["y"], leaf="fold")
    prof = profile_inputs(design)
    gt, sums = leaf_table(design, cands, prof, opt, ["id"], True)
    views = dict(split_views(gt))
    scales = {k: ((v.shift - gt.centre) / gt.scale, v.scale / gt.scale, v.live) for k, v in views.items()}
    got = {(r["fold"], r["bag"], r["idx"]) for r in bag_picks(sums, PLAIN, len(cands), 1, scales, {(k, 0): 4 for k in views}, opt).collect()}
    hashes = np.array([[r[b + 1] for b in range(3)] for r in df.select("id", *[bags.bag_hash(["id"], opt.seed, b) for b in range(3)]).orderBy("id").collect()])
    ends = bags.bag_thresholds(df, ["id"], "fold", opt)
    Z, want, fold = evaluate(cands, X), set(), np.arange(600) % 5
    for k, v in views.items():
        for b in range(3):
            train = np.flatnonzero(fold != k)
            rows = train[np.argsort(hashes[train, b])[: int(0.8 * len(train))]]
            assert ends[k, b] == hashes[rows, b].max() and len(rows) == 384
            U = np.column_stack([np.ones(len(rows)), (Z[rows] - v.shift) / v.scale, y[rows]])
            picks, *_ = select.greedy_operators(U.T @ U, len(rows), v.live, opt, limit=4)
            want |= {(k, b, j) for j in picks}
    assert got == want


def test_bags_of_few_and_equal_keys(spark):
    from gramlaw.operators.bags import bag_hash, bag_thresholds
    from gramlaw.plans.options import Options

    opt = Options(bag_boots=2)
    three = spark.createDataFrame([(i, 0) for i in range(3)], "id long, fold int")
    assert all(three.where(bag_hash(["id"], opt.seed, b) <= end).count() == 3 for (_, b), end in bag_thresholds(three, ["id"], "fold", opt).items())
    equal = spark.createDataFrame([(i // 50, 0) for i in range(200)], "id long, fold int")  # 160 rows do not divide by 50
    for (_, b), end in bag_thresholds(equal, ["id"], "fold", opt).items():
        assert equal.where(bag_hash(["id"], opt.seed, b) <= end).count() == 150


def test_partial_sums_are_bounded_by_the_cluster_not_by_the_pieces_of_the_input(spark):
    from gramlaw.operators.gram import partial_moments

    df = spark.range(0, 400, 1, 100).select((F.col("id") / 400.0).alias("x0"), (F.col("id") % 7).alias("y"), F.col("id").alias("id"))
    cands = [Candidate("x0", "unary", {"f": "x", "i": 0})]
    far = spark.createDataFrame(df.rdd, df.schema)  # of unknown size, so left as read
    parts = partial_moments(Design(far, ["x0"], ["y"]), cands, np.zeros(2), np.ones(2))
    assert far.rdd.getNumPartitions() == 100 and parts.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert gram(Design(far, ["x0"], ["y"]), cands).total().n == 400


def test_stacked_whiteners_equal_single_ones():
    from gramlaw.operators.noise import _whitener, _whiteners

    stack = np.array([[[2.0, 0.5], [0.5, 1.0]], [[1.0, 1.0], [1.0, 1.0]], [[0.0, 0.0], [0.0, 3.0]]])
    for some in (stack, stack[:1]):
        assert np.allclose(_whiteners(some), [_whitener(S) for S in some], atol=1e-12)


def test_equal_columns_are_summed_once(spark, monkeypatch):
    from gramlaw.operators import gram as module
    from gramlaw.operators.catalog import distinct_columns, evaluate

    corr = np.array([[1.0, 0.2, 0.9], [0.2, 1.0, 0.1], [0.9, 0.1, 1.0]])
    cands = build_bank(corr, 7, 5, 3)
    first, at = distinct_columns(cands)
    odd = np.array([[0.5, -2.0, 3.0], [np.nan, 1.0, -0.0], [-1.0, np.inf, np.nan], [-np.inf, -1e200, 2.0], [0.0, 0.25, -4.0]])
    values = evaluate(cands, odd)
    assert np.array_equal(values, values[:, first][:, at]) and len(cands) - len(first) == 2 * 8 + 2 * 24 - 4  # two atoms, two axes

    df, _, _, _ = frame(spark)
    df = df.withColumns({"c": F.lit(2.0), "w": variance_weight(F.col("s"))})
    design = Design(df, ["x0", "x1", "x2"], ["y"], weight="w", leaf="fold", copies="c")
    centre, scale = working_scale(cands, profile_inputs(design))
    whole = module.collect_moments(module.leaf_moments(design, cands, centre, scale), len(cands), 1, centre, scale)
    gathered = []
    passing = module.leaf_moments
    monkeypatch.setattr(module, "leaf_moments", lambda d, some, *rest: (gathered.append(len(some)), passing(d, some, *rest))[1])
    once = module.distinct_moments(design, cands, centre, scale)
    assert gathered == [len(first)] and once.keys() == whole.keys()
    for key, m in once.items():
        assert (m.n, m.p, m.t) == (whole[key].n, whole[key].p, whole[key].t)
        np.testing.assert_allclose(m.M, whole[key].M, rtol=1e-9, atol=1e-9 * np.abs(whole[key].M).max())

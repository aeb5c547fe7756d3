"""Sums and scores from feature maps against the dense table of the same maps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlaw.operators.sparse import key_pairs, key_targets, row_totals, score_maps
from gramlaw.operators.telemetry import design_matrix

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    data = []
    for k in range(300):
        m = {n: float(v) for n, v in zip(NAMES, rng.normal(size=4)) if rng.random() < 0.6}
        if k % 9 == 0:
            m["a"] = None
        data.append((k, None if k == 5 else {} if k == 6 else m, float("nan") if k == 7 else None if k == 8 else float(k % 3)))
    return spark.createDataFrame(data, "id long, feature_map map<string,double>, y double").repartition(3).cache()


def dense(rows):
    names = [*NAMES, *[f"{n}__present" for n in NAMES]]
    shown = design_matrix(rows.where("feature_map is not null"), names, ["id", "y"]).orderBy("id").toPandas()
    return shown[NAMES].to_numpy(), shown[names[4:]].to_numpy(), shown["y"].to_numpy()


def test_sums_equal_the_dense_table(rows):
    V, P, y = dense(rows)
    got = {(r["a"], r["b"]): r for r in key_pairs(rows).collect()}
    assert len(got) == 10
    for i, a in enumerate(NAMES):
        for j, b in enumerate(NAMES[i:], i):
            r = got[a, b]
            want = [P[:, i] @ P[:, j], V[:, i] @ V[:, j], V[:, i] @ P[:, j], P[:, i] @ V[:, j]]
            np.testing.assert_allclose([r["n"], r["vv"], r["vp"], r["pv"]], want, atol=1e-10)
    known = np.where(np.isnan(y), 0.0, y)
    for r in key_targets(rows, {"y": F.col("y")}).collect():
        i = NAMES.index(r["key"])
        np.testing.assert_allclose([r["n"], r["v"], r["vv"], r["vy_y"], r["py_y"]], [P[:, i].sum(), V[:, i].sum(), V[:, i] @ V[:, i], V[:, i] @ known, P[:, i] @ known], atol=1e-10)
    total = row_totals(rows, {"y": F.col("y")}).first()
    assert total["n"] == 300 and total["yy_y"] == sum((k % 3) ** 2 for k in range(300) if k not in (7, 8))


@pytest.mark.parametrize("sent", [10, 1])
def test_scores_equal_the_dense_table(spark, rows, sent):
    """By sent weights and by dealt copies; one key has no weight, one weight is null."""
    w = spark.createDataFrame([("a", 1.5, 0.25), ("b", None, -2.0), ("d", 0.5, None), ("unused", 9.0, 9.0)], "key string, value_weight double, presence_weight double")
    got = dict(score_maps(rows, ["id"], w, sent_keys=sent).collect())
    V, P, _ = dense(rows)
    want = V @ [1.5, 0.0, 0.0, 0.5] + P @ [0.25, -2.0, 0.0, 0.0]
    ids = [k for k in range(300) if k != 5]
    np.testing.assert_allclose([got[k] for k in ids], want, atol=1e-12)
    assert len(got) == 300 and got[5] == 0.0 and got[6] == 0.0


def test_fifty_thousand_keys(spark):
    """Each row holds three of 50 000 keys and one that all rows hold."""
    n = 50_000
    key = lambda k: F.concat(F.lit("k"), F.pmod(k, F.lit(n)).cast("string"))
    ids = spark.range(100_000)
    maps = ids.select("id", F.create_map(key(F.col("id")), F.lit(1.0), key(F.col("id") * 7 + 1), F.lit(2.0), key(F.col("id") * 31 + 2), F.lit(3.0), F.lit("all"), F.col("id") % 5 * 1.0).alias("feature_map"))
    clear = maps.where(F.size("feature_map") == 4)
    keys = key_targets(clear, {"y": F.col("id") % 2})
    assert keys.count() == n + 1
    rows = clear.count()
    hot = keys.where("key = 'all'").first()
    assert hot["n"] == rows
    pairs = key_pairs(clear)
    diagonal = pairs.where("a = b").agg(F.sum("n"), F.sum("vv")).first()
    assert diagonal[0] == 4 * rows
    assert pairs.where("a <> b").agg(F.sum("n")).first()[0] == 6 * rows
    assert pairs.where("a = 'all' or b = 'all'").count() == n + 1


def test_empty_table(spark):
    none = spark.createDataFrame([], "id long, feature_map map<string,double>, y double")
    assert key_pairs(none).count() == 0 and key_targets(none, {"y": F.col("y")}).count() == 0
    assert row_totals(none, {"y": F.col("y")}).first()["n"] == 0

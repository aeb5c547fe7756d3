import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gramlaw.operators import ranks
from gramlaw.operators.ranks import first_rows, median_of, rank_select
from gramlaw.operators.scan import ordered_scan
from gramlaw.operators.splits import exact_folds, fold_sizes, hashed_folds, holdout, positional_split


def numbers(spark, values):
    return spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "id long, v double").repartition(5)


@pytest.mark.parametrize(
    "values",
    [
        np.random.default_rng(0).normal(size=3000),
        np.random.default_rng(1).integers(0, 4, size=3000),
        np.exp(np.random.default_rng(2).normal(size=3000) * 20),
        np.full(50, 7.0),
        [1.0],
    ],
)
def test_ranks_match_sorting(spark, values, monkeypatch):
    import gramlaw.operators.ranks as module

    monkeypatch.setattr(module, "SMALL", 10)
    monkeypatch.setattr(module, "BINS", 16)
    values = np.asarray(values, float)
    ranks = sorted({1, len(values), (len(values) + 1) // 2, max(1, len(values) // 7)})
    ordered = np.sort(values)
    for rank, (v, less, equal) in zip(ranks, rank_select(numbers(spark, values), F.col("v"), ranks)):
        assert v == ordered[rank - 1]
        assert less == (values < v).sum() and equal == (values == v).sum()
    assert median_of(numbers(spark, values), F.col("v")) == np.median(values)


def test_large_integers_closer_than_a_double_resolves(spark):
    base = 1 << 60
    df = spark.createDataFrame([(base + k,) for k in range(50)], "v long")
    assert [r[0] for r in rank_select(df, F.col("v"), [1, 25, 50])] == [base, base + 24, base + 49]


def test_rank_outside_is_an_error(spark):
    with pytest.raises(ValueError):
        rank_select(numbers(spark, [1.0]), F.col("v"), [2])
    with pytest.raises(ValueError):
        rank_select(numbers(spark, []), F.col("v"), [1])


def test_first_rows_settles_ties_by_the_next_column(spark):
    df = numbers(spark, np.random.default_rng(3).integers(0, 3, size=500))
    conditions = first_rows(df, [-F.col("v"), F.col("id")], [0, 1, 137, 500])
    rows = df.select("id", "v", *[c.alias(f"c{k}") for k, c in enumerate(conditions)]).collect()
    ranked = sorted(rows, key=lambda r: (-r["v"], r["id"]))
    for k, count in enumerate((0, 1, 137, 500)):
        assert [r[f"c{k}"] for r in ranked] == [i < count for i in range(500)]


def test_repeated_keys_cannot_be_cut(spark):
    df = spark.createDataFrame([(1,)] * 4, "v int")
    with pytest.raises(ValueError):
        first_rows(df, [F.col("v")], [2])


def test_folds(spark):
    df = numbers(spark, range(103))
    sizes = [r["count"] for r in exact_folds(df, "id", 5).groupBy("fold").count().orderBy("fold").collect()]
    assert sizes == fold_sizes(103, 5) == [20, 20, 21, 21, 21]
    first = [r["count"] for r in exact_folds(df, "id", 5, larger_last=False).groupBy("fold").count().orderBy("fold").collect()]
    assert first == [21, 21, 21, 20, 20]
    copies = df.unionByName(df)
    assert hashed_folds(copies, "id", 5).groupBy("id").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


def test_holdout_sizes(spark):
    count = lambda df: df.where("is_val").count()
    assert count(holdout(numbers(spark, range(12)), "id", 0.2)) == 2
    assert count(holdout(numbers(spark, range(25)), "id", 0.1)) == 2  # 2.5 rounds to even
    assert count(holdout(numbers(spark, range(3)), "id", 0.1)) == 1
    assert count(holdout(numbers(spark, range(19)), "id", 0.2, rounding="floor")) == 3
    rows = positional_split(numbers(spark, range(11)), "id", 0.7).orderBy("id").collect()
    assert [r["is_train"] for r in rows] == [k < 7 for k in range(11)]


def test_hot_key_slices_equal_a_plain_window(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(3000):
        key = 0 if rng.random() < 0.4 else int(rng.integers(1, 30))
        when = int(rng.integers(0, 10)) if rng.random() < 0.5 else int(rng.integers(0, 100000))
        rows.append((key, when, k, float(rng.normal()), None if rng.random() < 0.1 else float(k)))
    df = spark.createDataFrame(rows, "key int, t long, id long, v double, w double").repartition(6)
    args = dict(previous={"pv": "v", "pw": "w"}, running={"total": F.lit(1).cast("long") * F.col("id")}, position="pos")
    hot = ordered_scan(df, "key", ["t", "id"], hot_rows=50, **args)
    w = Window.partitionBy("key").orderBy("t", "id")
    plain = df.select(
        "*", F.lag("v").over(w).alias("pv"), F.lag("w").over(w).alias("pw"), F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"),
        (F.row_number().over(w) - 1).cast("long").alias("pos"),
    )
    cols = ["key", "t", "id", "v", "w", "pv", "pw", "total", "pos"]
    assert sorted(map(tuple, hot.select(cols).collect()), key=lambda r: r[2]) == sorted(map(tuple, plain.select(cols).collect()), key=lambda r: r[2])
    cold = ordered_scan(df, "key", ["t", "id"], **args)
    assert sorted(map(tuple, cold.select(cols).collect()), key=lambda r: r[2]) == sorted(map(tuple, plain.select(cols).collect()), key=lambda r: r[2])


def test_ranks_and_medians_with_infinities(spark):
    inf = float("inf")
    values = [-inf, -inf, *range(2000), 1e308, -1e308, inf, float("nan"), None]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    order = sorted(v for v in values if v is not None and v == v)
    for small in (20000, 10):
        ranks.SMALL, before = small, ranks.SMALL
        try:
            got = ranks.rank_select(df, F.col("v"), [1, 2, 3, 4, 1000, len(order) - 1, len(order)])
        finally:
            ranks.SMALL = before
        assert [g[0] for g in got] == [order[r - 1] for r in (1, 2, 3, 4, 1000, len(order) - 1, len(order))]
        assert got[0][1:] == (0, 2) and got[-1][1:] == (len(order) - 1, 1)
    only = df.where(F.col("v") == -inf)
    assert ranks.median_of(only, F.col("v")) == -inf


def test_hot_keys_by_row_counts_with_nulls_and_bursts(spark):
    # almost all rows of the hot key lie in a short burst after one early row; some have no order value
    rows = [(k, "hot", None if k < 10 else 0.0 if k == 10 else 1e6 + k, 1) for k in range(1000)] + [(5000 + k, f"k{k}", float(k), 1) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, key string, t double, one long").repartition(7)
    args = dict(previous={"before": "id"}, running={"total": F.col("one")}, position="place")
    plain = ordered_scan(df, "key", ["t", "id"], hot_rows=10**9, **args)
    hot = ordered_scan(df, "key", ["t", "id"], hot_rows=50, **args)
    assert sorted(map(str, hot.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert hot.agg(F.max("total")).first()[0] == 1000
    from gramlaw.operators.scan import _slices

    sizes = [r["count"] for r in _slices(df, "key", "t", 50)[0].where("key = 'hot'").groupBy("__slice").count().collect()]
    assert len(sizes) > 50 and max(sizes) <= 40

import numpy as np
import pyarrow as pa
from helpers import ODD

from gramlaw.llm import ranking


def corpus():
    good = [(i, f"An ordinary sentence number {i} with several words. It goes on for a while, as prose does.\nA new line {i * 7}.") for i in range(60)]
    bad = [(100 + i, "BUY!! NOW!! " * (10 + i % 5) + f"### {i} $$$ ***") for i in range(30)]
    return good + bad


def test_pairs_rank_held_out_rows(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(30)]
    train = spark.createDataFrame([x for x in labels if x[0] % 3 != 1] + [(0, None, 0), (999, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    model = ranking.fit(docs, train)
    got = {r.doc_id: r.score for r in ranking.scored(docs, model).collect()}
    held = [x for x in labels if x[0] % 3 == 1]
    assert np.mean([(got[d] >= 0.5) == bool(q) for d, q, _ in held]) >= 0.95


def test_learned_from_preferences_only():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(4000, 3))
    good = draw.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))
    m = ranking.learn(x, good)
    assert abs(m.weights[0] / m.weights[1] + 2) < 0.3 and abs(m.weights[2]) < 0.15
    # the cut is a quantile that balances the classes
    assert abs(np.mean(m.strength(x) >= m.cut) - 0.5) < 0.12


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = ranking.fit(odd, labels)
    got = ranking.scored(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert ranking.scored(none, model).count() == 0
    for labels in (spark.createDataFrame([], "doc_id long, quality int"), spark.createDataFrame([(4, 1)], "doc_id long, quality int")):
        assert {r.score for r in ranking.scored(odd, ranking.fit(odd, labels)).collect()} == {0.5}


def test_measures_do_not_depend_on_neighbours():
    texts = ["One two.\nOne two.\n", None, "a a a a", "## !! ||", "x" * 5000]
    whole = ranking.measures(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], ranking.measures(pa.array([t], pa.string()))[0])

import pytest
from pyspark.sql import functions as F

from gramlaw.operators.distill import Gate, action_templates, best_regime, hamming, mine, mining_stats, replay_rows, replay_weights, with_gate
from gramlaw.operators.telemetry import (
    FEATURES,
    Sensors,
    Topology,
    design_matrix,
    events_as_telemetry,
    feature_map,
    label,
    regime_label,
    scenario_matrix,
    select_features,
    shield_level,
    turbo_policy,
    with_policy,
    with_shield,
)
from gramlaw.plans.options import Options
from gramlaw.plans.rounds import distill_rounds
from gramlaw.sources.tables import RECORD_SCHEMA, check_shapes, content_mark, fingerprint, read_records, reuse_or_build, sigma_entries, telemetry_records, write_records
from gramlaw.session import prepare

SENSOR = "temp double, pred_temp double, temp_slope double, clock_speed double, data_load double, packets_dropped double, p_throttle boolean, p_boost boolean, p_reduce_clock boolean"


def row(temp=50.0, pred=50.0, slope=0.0, clock=1.0, load=0.0, drops=0.0, t=False, b=False, r=False):
    return (temp, pred, slope, clock, load, drops, t, b, r)


LEVELS = [
    (row(), "GREEN"), (row(temp=72.0), "YELLOW"), (row(temp=71.999), "GREEN"), (row(pred=72.0), "YELLOW"),
    (row(slope=1.75), "YELLOW"), (row(load=33.0), "YELLOW"), (row(load=32.9), "GREEN"), (row(temp=84.0), "ORANGE"),
    (row(pred=82.0), "ORANGE"), (row(slope=3.0), "ORANGE"), (row(drops=800.0), "ORANGE"), (row(drops=799.0), "GREEN"),
    (row(temp=95.0), "RED"), (row(pred=92.0), "RED"), (row(drops=1200.0), "RED"),
]


def test_level_thresholds_are_inclusive(spark):
    df = spark.createDataFrame([r for r, _ in LEVELS], SENSOR).coalesce(1)
    got = [r[0] for r in df.select(shield_level(F.col("pred_temp"), F.col("temp_slope"))).collect()]
    assert got == [want for _, want in LEVELS]


OVERRIDES = [
    (row(t=True, b=False, r=True), (1, 0, 1), 0),  # green keeps the proposal
    (row(temp=72.0), (0, 1, 0), 1),
    (row(temp=72.0, b=True), (0, 1, 0), 0),
    (row(temp=72.0, pred=78.0, b=True), (0, 1, 0), 0),  # overrides are strict
    (row(temp=72.0, pred=78.1, b=True), (1, 1, 0), 1),
    (row(temp=72.0, pred=80.1, t=True, b=True, r=True), (1, 1, 1), 0),
    (row(temp=72.0, slope=2.3, b=True), (0, 1, 1), 1),
    (row(temp=72.0, load=31.5, b=True), (0, 1, 0), 0),
    (row(temp=72.0, load=31.6, b=True), (1, 1, 0), 1),
    (row(temp=84.0), (0, 1, 1), 2),
    (row(temp=84.0, b=True, r=True), (0, 1, 1), 1),
    (row(temp=84.0, pred=86.1, b=True, r=True), (1, 1, 1), 2),
    (row(temp=95.0), (1, 1, 1), 3),
]


def test_overrides(spark):
    df = with_shield(spark.createDataFrame([r for r, _, _ in OVERRIDES], SENSOR).coalesce(1))
    got = [(tuple(r["executed_action"]), r["override_code"]) for r in df.collect()]
    assert got == [(a, c) for _, a, c in OVERRIDES]


def test_regime_rules(spark):
    cases = [
        ((False, False, False, "GREEN", 0, 50.0, 50.0, 0.5), "relaxed"), ((False, False, False, "GREEN", 0, 60.0, 50.0, 0.5), "efficiency"),
        ((False, True, False, "GREEN", 0, 50.0, 50.0, 0.5), "efficiency"), ((True, False, False, "GREEN", 0, 50.0, 50.0, 0.5), "congestion_caution"),
        ((False, True, True, "YELLOW", 0, 50.0, 50.0, 0.5), "thermal_caution"), ((True, True, True, "GREEN", 0, 50.0, 50.0, 0.5), "brake"),
        ((False, False, False, "ORANGE", 0, 50.0, 50.0, 0.5), "brake"), ((False, False, False, "GREEN", 2, 50.0, 50.0, 0.5), "brake"),
        ((True, False, True, "GREEN", 0, 50.0, 50.0, 0.5), "efficiency"),
    ]
    schema = "throttle boolean, boost boolean, reduce_clock boolean, shield_level string, override_code int, temp double, pred_temp double, queue_ratio double"
    got = [r[0] for r in spark.createDataFrame([c for c, _ in cases], schema).coalesce(1).select(regime_label()).collect()]
    assert got == [w for _, w in cases]


@pytest.fixture(scope="module")
def events(spark):
    return events_as_telemetry(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).cache()


def test_first_tick_and_short_label_form(spark, events):
    lab = label(events)
    first = lab.where("tick = 0")
    assert first.where("pred_temp <> temp or temp_slope <> 0").count() == 0
    assert lab.where(F.col("regime") != regime_label()).count() == 0
    stock = label(events, "stock", Topology("hot", ambient=28.0, capacity_scale=28.0))
    assert stock.where(F.col("regime") != regime_label()).count() == 0
    assert {r[0] for r in lab.select("regime").distinct().collect()} >= {"relaxed", "brake"}


def test_feature_maps(spark, events):
    lab = label(events)
    with pytest.raises(Exception, match="not computed"):
        lab.select(F.map_filter(select_features(feature_map(), Sensors("s", add=("missing",))), lambda k, v: k == "temp")).collect()
    with pytest.raises(ValueError):
        scenario_matrix(events, "turbo", sensors=[Sensors("s", add=("missing",))])
    with pytest.raises(ValueError):
        design_matrix(spark.createDataFrame([], "feature_map map<string,double>"))
    one = spark.createDataFrame([({"a": 2.0},), ({"b": 3.0},)], "feature_map map<string,double>").coalesce(1)
    assert [tuple(r) for r in design_matrix(one).collect()] == [(2.0, 0.0, 1.0, 0.0), (0.0, 3.0, 0.0, 1.0)]
    assert [tuple(r) for r in design_matrix(one, ["c", "c__present"]).collect()] == [(0.0, 0.0)] * 2
    assert scenario_matrix(events, "turbo").count() == 15 * events.count()
    mine_ = with_policy(lab.drop(*[f"p_{b}" for b in ("throttle", "boost", "reduce_clock")]), turbo_policy)
    assert mine_.where("p_boost").count() == lab.where("p_boost").count()


def test_records_round_trip(spark, events, tmp_path):
    records = telemetry_records(label(events))
    assert [f.name for f in records.schema] == [c.strip().split()[0] for c in RECORD_SCHEMA.split(", ")]
    write_records(records, str(tmp_path / "r"))
    back = read_records(spark, str(tmp_path / "r"))
    assert back.count() == records.count()
    assert set(back.first()["feature_map"]) == set(FEATURES)


def test_templates_ties_and_unseen_regimes(spark):
    rows = [(1, "relaxed", [0, 0, 0]), (2, "relaxed", [1, 0, 0]), (3, "brake", [1, 1, 1]), (4, "brake", [1, 1, 1])]
    got = {r["regime"]: (r["template"], r["purity"]) for r in action_templates(spark.createDataFrame(rows, "record_id int, regime string, executed_action array<int>")).collect()}
    assert got["relaxed"] == ([0, 0, 0], 0.5) and got["brake"] == ([1, 1, 1], 1.0)
    assert got["efficiency"] == ([1, 1, 1], 0.0) and len(got) == 5


def test_argmax_ties_and_hamming(spark):
    r = spark.range(1).select(best_regime([F.lit(v) for v in (0.2, 0.7, 0.7, 0.1, 0.7)]), hamming(F.array(F.lit(1), F.lit(0), F.lit(1)), F.array(F.lit(0), F.lit(0), F.lit(0)))).first()
    assert tuple(r) == ("efficiency", 2)


MINED = "record_id int, executed_action array<int>, pred_action array<int>, regime string, pred_regime string, override_code int, reward_like double, shield_level string"


def test_nothing_hard_when_all_agree(spark):
    rows = [(k, [0, 0, 0], [0, 0, 0], "relaxed", "relaxed", 0, -0.5, "GREEN") for k in range(10)]
    m = mine(spark.createDataFrame(rows, MINED), stage=False)
    s = mining_stats(m).first()
    assert (s["num_hard_examples"], s["mean_hard_score"], s["replay_size"]) == (0, 0.0, 10)


def test_mining_order_copies_and_weights(spark):
    rows = [(k, [1, 1, 1], [1, 1, 1 if k % 2 else 0], "brake", "brake" if k % 3 else "relaxed", k % 4, 0.2, "YELLOW" if k % 5 else "RED") for k in range(40)]
    m = mine(spark.createDataFrame(rows, MINED).repartition(3), stage=False).cache()
    ranked = sorted(m.collect(), key=lambda r: (-r["hard_score"], r["record_id"]))
    assert [r["chosen"] for r in ranked] == [k < 8 for k in range(40)]
    sizes = {r["record_id"]: r["n"] for r in replay_rows(m).groupBy("record_id").agg(F.count("*").alias("n")).collect()}
    weights = {r["record_id"]: r["replay_weight"] for r in replay_weights(m).collect()}
    assert sizes == {k: int(w) for k, w in weights.items()} and max(sizes.values()) == 6
    assert mining_stats(m).first()["replay_size"] == sum(sizes.values())


def test_gate(spark):
    good = dict(regime_accuracy=0.9, exact_agreement=0.9, avg_hamming=0.15, mean_num_ops=12.0, mean_median_bits=128.0, mean_template_purity=0.9)
    assert with_gate(spark.createDataFrame([good])).first()["all_pass"]
    for name, bad in [("regime_accuracy", 0.89), ("avg_hamming", 0.16), ("mean_num_ops", 13.0), ("mean_median_bits", 129.0), ("mean_template_purity", 0.5), ("exact_agreement", 0.1)]:
        assert not with_gate(spark.createDataFrame([good | {name: bad}]), Gate()).first()["all_pass"]


def test_rounds_with_counts_and_with_copies_agree(spark, events):
    opt = Options(n_proj=3, n_pairs=1, max_atoms=3, max_ops=3, max_grammar=0, refine=False, bag_boots=2, bag_buckets=4, folds=3)
    done = {
        replay: distill_rounds(label(events), "regimes", ["temp", "pred_temp", "queue_ratio", "temp_slope"], opt, rounds=1, replay=replay)
        for replay in ("weights", "copies")
    }
    d = done["weights"]
    assert len(d.rounds) == 2 and d.evaluation["regime_accuracy"] > 0.6
    assert d.metrics(spark).count() == 1 and d.history(spark).count() == 2 and d.compactness(spark).count() == 5
    for key, value in d.evaluation.items():
        other = done["copies"].evaluation[key]
        assert value == other or abs(value - other) < 1e-6 * max(1.0, abs(value)), key


def test_replay_adds_only_the_repeated_rows_to_the_moments(spark, events, monkeypatch):
    from gramlaw.plans import search as plan

    read, whole, adding, passing = [], [], plan.table_with, plan.leaf_table
    monkeypatch.setattr(plan, "table_with", lambda known, more, prof: (read.append(more.df.count()), adding(known, more, prof))[1])
    monkeypatch.setattr(plan, "leaf_table", lambda design, *rest: (whole.append(design.df.count()), passing(design, *rest))[1])
    opt = Options(n_proj=3, n_pairs=1, max_atoms=3, max_ops=3, max_grammar=0, refine=False, bag_boots=0, folds=3)
    inputs = ["temp", "pred_temp", "queue_ratio", "temp_slope"]
    done = {replay: distill_rounds(label(events), "regimes", inputs, opt, rounds=2, replay=replay) for replay in ("weights", "copies")}
    rows = [int(r["n_eval"]) for r in done["weights"].rounds]
    assert whole[:2] == [rows[0], rows[0]] and len(whole) == 4  # the counts read all rows once, the copies in every round
    assert read == [int(r["num_hard_examples"]) for r in done["weights"].rounds[:2]]
    for a, b in zip([*done["weights"].rounds, done["weights"].evaluation], [*done["copies"].rounds, done["copies"].evaluation]):
        assert a.keys() == b.keys()
        for key, value in a.items():
            assert value == b[key] or abs(value - b[key]) < 1e-6 * max(1.0, abs(value)), key
    assert [o[:4] for r in done["weights"].student.reports.values() for o in r.op_log] == [o[:4] for r in done["copies"].student.reports.values() for o in r.op_log]


def test_sigma_documents_and_shapes(spark):
    docs = spark.createDataFrame([(0, "[[1.0, 0.5], [0.5, 2.0]]"), (1, '{"Sigma": [[3.0]]}')], "k int, value string")
    keys = lambda *ids: spark.createDataFrame([(i,) for i in ids], "i long")
    got = sorted(tuple(r) for r in sigma_entries(docs).collect())
    assert got == [(0, 0, 0, 1.0), (0, 0, 1, 0.5), (0, 1, 0, 0.5), (0, 1, 1, 2.0), (1, 0, 0, 3.0)]
    with pytest.raises(ValueError, match="shape mismatch"):
        check_shapes(keys(0, 1, 2), keys(0, 1, 2), sigma_entries(docs.where("k = 0")))
    two = sigma_entries(docs.where("k = 0"))
    assert check_shapes(keys(0, 1), keys(1, 0), two) == {"rows": 2}
    for basis, target in ((keys(0, 2), keys(0, 2)), (keys(0, 0), keys(0, 1)), (keys(0, 1), keys(0, None))):
        with pytest.raises(ValueError, match="shape mismatch"):
            check_shapes(basis, target, two)


def test_stage_reuse(spark, tmp_path):
    path = str(tmp_path / "stage")
    built = []

    def build(n):
        def run():
            built.append(n)
            return spark.range(n)

        return run

    assert reuse_or_build(spark, path, fingerprint(3, ["a"]), build(3)).count() == 3
    assert reuse_or_build(spark, path, fingerprint(3, ["a"]), build(9)).count() == 3
    assert reuse_or_build(spark, path, fingerprint(4, ["a"]), build(4)).count() == 4
    assert built == [3, 4]


def test_content_marks(spark):
    a = spark.createDataFrame([(1, {"x": 1.0, "y": 2.0}), (2, None)], "k int, m map<string,double>")
    assert content_mark(a) == content_mark(a.repartition(3)) == content_mark(spark.createDataFrame([(2, None), (1, {"y": 2.0, "x": 1.0})], a.schema))
    assert len({content_mark(a), content_mark(a.withColumn("k", F.col("k") + 1)), content_mark(a.withColumnRenamed("k", "j")), content_mark(a, {"v": 1}), content_mark(a.union(a))}) == 5


def test_generated_code_of_wide_rows_is_short_enough_to_be_compiled(spark):
    prepare(spark)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000


def test_replay_rounds_runs_every_round_with_all_options(spark, monkeypatch):
    """Two rounds of replay after the first fit, with bags, grammar rounds and the graph stage."""
    import inspect

    from gramlaw.plans.options import Options
    from gramlaw.queries import QUERIES, searches

    calls = []

    class Done:
        def history(self, spark):
            return spark.range(1)

    def record(*args, **kwargs):
        bound = inspect.signature(distill_rounds).bind(*args, **kwargs)
        bound.apply_defaults()
        calls.append(bound.arguments)
        return Done()

    monkeypatch.setattr(searches, "distill_rounds", record)
    sf = "/root/testdata/sf0.001"
    QUERIES["replay_rounds"](spark, sf).collect()
    (call,) = calls
    assert call["opt"] == Options() and call["rounds"] == 2 and call["replay"] == "weights"
    assert call["labelled"].count() == spark.read.parquet(f"{sf}/events.parquet").count()

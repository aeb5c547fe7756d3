"""Queries: telemetry labels, policy distillation, mining and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from gramlaw.operators.distill import (
    Gate,
    action_templates,
    agreement,
    best_regime,
    bit_prediction,
    compactness,
    hardest,
    mine,
    mining_stats,
    regime_targets,
    replay_rows,
    replay_weights,
    with_gate,
    with_template,
)
from gramlaw.operators.splits import positional_split
from gramlaw.operators.telemetry import BITS, FEATURES, REGIMES, level_counts, regime_label, scenario_matrix, with_features, with_policy
from gramlaw.queries.common import TELEMETRY_SQL, label_sql, labelled, query, rnd, rounded, table, telemetry
from gramlaw.session import materialise, shared_path
from gramlaw.sources.tables import content_mark, read_records, reuse_or_build, telemetry_records, write_records, write_report

LAB = f"WITH {TELEMETRY_SQL}, {label_sql()}"
_BIT_SQL = "CAST(throttle AS INTEGER) AS throttle, CAST(boost AS INTEGER) AS boost, CAST(reduce_clock AS INTEGER) AS reduce_clock"


@query(
    "shield",
    f"{LAB} SELECT record_id, shield_level, round(risk_score,6) AS risk_score, override_code, {_BIT_SQL} FROM lab",
)
def _(spark, sf):
    """Safety level, risk, override and executed bits."""
    out = labelled(spark, sf)
    return out.select("record_id", "shield_level", rnd("risk_score").alias("risk_score"), "override_code", *[F.col(b).cast("int").alias(b) for b in BITS])


@query(
    "level_counts",
    f"{LAB} SELECT episode, " + ", ".join(f"count(*) FILTER (WHERE shield_level='{v}') AS {v}" for v in ("GREEN", "YELLOW", "ORANGE", "RED")) + " FROM lab GROUP BY episode",
)
def _(spark, sf):
    return level_counts(labelled(spark, sf))


def _policy_query(policy):
    sql = f"WITH {TELEMETRY_SQL}, {label_sql(policy)} SELECT record_id, CAST(p0 AS INTEGER) AS p_throttle, CAST(p1 AS INTEGER) AS p_boost, CAST(p2 AS INTEGER) AS p_reduce_clock FROM prop"

    @query(f"policy_{policy}", sql)
    def run(spark, sf):
        """Proposed bits of a threshold policy."""
        out = with_policy(with_features(telemetry(spark, sf)), policy)
        return out.select("record_id", *[F.col(f"p_{b}").cast("int").alias(f"p_{b}") for b in BITS])

    return run


_policy_query("turbo")
_policy_query("stock")


@query("policy_custom", f"WITH {TELEMETRY_SQL} SELECT count(*) FILTER (WHERE queue_ratio>0.9) AS throttle, count(*) FILTER (WHERE temp>65) AS boost, count(*) FILTER (WHERE pred_temp>75) AS reduce_clock FROM feats")
def _(spark, sf):
    """A user policy: three boolean columns by bit name."""
    own = lambda: {"throttle": F.col("queue_ratio") > 0.9, "boost": F.col("temp") > 65, "reduce_clock": F.col("pred_temp") > 75}
    out = with_policy(with_features(telemetry(spark, sf)), own)
    return out.agg(*[F.count_if(F.col(f"p_{b}")).alias(b) for b in BITS])


@query("regimes", f"{LAB} SELECT record_id, regime, round(reward_like,6) AS reward_like FROM lab")
def _(spark, sf):
    return labelled(spark, sf).select("record_id", "regime", rnd("reward_like").alias("reward_like"))


@query("regimes_recorded", f"{LAB} SELECT record_id, regime FROM lab")
def _(spark, sf):
    """Regime label from the recorded level, override and action alone."""
    out = labelled(spark, sf)
    return out.select("record_id", regime_label().alias("regime"))


@query("regimes_stock", f"WITH {TELEMETRY_SQL}, {label_sql('stock')} SELECT regime, shield_level, count(*) AS n FROM lab GROUP BY regime, shield_level")
def _(spark, sf):
    return labelled(spark, sf, "stock").groupBy("regime", "shield_level").agg(F.count("*").alias("n"))


@query("positional_split", "SELECT event_id AS record_id, row_number() OVER (ORDER BY event_id) <= floor(0.7*count(*) OVER ()) AS is_train FROM events")
def _(spark, sf):
    """First 70 % of the records in order; the cut is a rank threshold."""
    return positional_split(table(spark, sf, "events").select(F.col("event_id").alias("record_id")), "record_id", 0.7)


_TOPO_SQL = """combos AS (SELECT unnest([22.0,22.0,22.0,22.0,28.0]) AS amb, unnest([30.0,28.0,30.0,30.0,30.0]) AS cap, unnest(['base_topology','denser_compute','better_cooling','thermal_lag','warmer_room']) AS topology_scenario),
wide AS (SELECT f.* EXCLUDE (queue_ratio, temp_minus_ambient, throughput_margin, thermal_pressure), combos.*, data_load/greatest(1.0,clock_speed*cap) AS queue_ratio, temp-amb AS temp_minus_ambient, greatest(1.0,clock_speed*cap)-data_load AS throughput_margin, (pred_temp-amb)*greatest(data_load/greatest(1.0,clock_speed*cap),0.0) AS thermal_pressure FROM feats f, combos)"""


@query(
    "scenario_matrix",
    f"WITH {TELEMETRY_SQL}, {_TOPO_SQL}, {label_sql('turbo', 'wide')}, sens AS (SELECT unnest(['base','extra_thermal_features','reduced_sensor_set']) AS sensor_scenario, unnest([19,19,17]) AS n_keys) "
    "SELECT sensor_scenario, topology_scenario, regime, count(*) AS n, max(n_keys) AS n_keys, round(avg(queue_ratio),6) AS queue_ratio, round(avg(temp_minus_ambient),6) AS above_ambient, round(avg(reward_like),6) AS reward FROM lab, sens GROUP BY ALL",
)
def _(spark, sf):
    """Every record under three sensor and five topology variants, labelled and summarised."""
    wide = scenario_matrix(telemetry(spark, sf), "turbo")
    out = wide.groupBy("sensor_scenario", "topology_scenario", "regime").agg(
        F.count("*").alias("n"), F.max(F.size("feature_map")).alias("n_keys"), F.avg("queue_ratio").alias("queue_ratio"),
        F.avg("temp_minus_ambient").alias("above_ambient"), F.avg("reward_like").alias("reward"),
    )
    return rounded(out)


@query(
    "records_json",
    f"{LAB} SELECT 'turbo' AS mode, episode, tick, shield_level, override_code, regime AS regime_label, round(reward_like,6) AS reward_like, round(temp,6) AS temp, 19 AS n_keys, CAST(throttle AS INTEGER) AS throttle FROM lab",
)
def _(spark, sf):
    """Telemetry records written as JSON lines and read back with a fixed schema."""
    path = shared_path(spark, "records")
    write_records(telemetry_records(labelled(spark, sf)), path)
    back = read_records(spark, path)
    return back.select(
        "mode", "episode", "tick", "shield_level", "override_code", "regime_label", rnd("reward_like").alias("reward_like"),
        rnd(F.col("feature_map")["temp"]).alias("temp"), F.size("feature_map").alias("n_keys"), F.col("executed_action")[0].alias("throttle"),
    )


@query("stage_reuse", f"{LAB} SELECT regime, count(*) AS n FROM lab GROUP BY regime")
def _(spark, sf):
    """A stage table is reused only under the same fingerprint; a different one rebuilds it."""
    lab = labelled(spark, sf).select("record_id", "regime")
    path = shared_path(spark, "stage")
    # as many rows of the same names, other contents
    reuse_or_build(spark, path, content_mark(lab.withColumn("regime", F.lit("none")), {"features": FEATURES}), lambda: lab.limit(0))
    mark = content_mark(lab, {"features": FEATURES})
    reuse_or_build(spark, path, mark, lambda: lab)
    again = reuse_or_build(spark, path, mark, lambda: lab.limit(0))
    return again.groupBy("regime").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------------------------------------------------
# Distillation with fixed scores (laws fitted from data are in the search queries)

_SCORES = {
    "relaxed": ((0.9, -0.008, -0.05), 0.2),
    "efficiency": ((0.5, -0.004, 0.0), 0.2),
    "thermal_caution": ((-0.9, 0.02, 0.0), 0.0),
    "congestion_caution": ((0.1, 0.0, 0.25), 0.0),
    "brake": ((-1.2, 0.025, 0.1), 0.1),
}


def _score_columns():
    out = []
    for r in REGIMES:
        (a, b, c), d = _SCORES[r]
        out.append(F.col("pred_temp") * b + F.col("queue_ratio") * c + F.col("drop_ratio") * d + a)
    return out


_SCORE_SQL = [f"({a!r}+({b!r})*pred_temp+({c!r})*queue_ratio+({d!r})*drop_ratio)" for (a, b, c), d in (_SCORES[r] for r in REGIMES)]
_TOP = "greatest(" + ",".join(_SCORE_SQL) + ")"
_PRED = "CASE " + " ".join(f"WHEN {s}={_TOP} THEN '{r}'" for r, s in zip(REGIMES, _SCORE_SQL)) + " END"
_ACT = "(CAST(throttle AS INTEGER)||','||CAST(boost AS INTEGER)||','||CAST(reduce_clock AS INTEGER))"
_TPL = f"""pr AS (SELECT *, {_PRED} AS pred_regime, {_ACT} AS act FROM lab),
cnt AS (SELECT regime, act, count(*) AS c, min(record_id) AS seen FROM pr GROUP BY regime, act),
best AS (SELECT regime, act, c*1.0/sum(c) OVER (PARTITION BY regime) AS purity, row_number() OVER (PARTITION BY regime ORDER BY c DESC, seen) AS rk FROM cnt),
maj AS (SELECT act FROM cnt GROUP BY act ORDER BY sum(c) DESC, min(seen) LIMIT 1),
names AS (SELECT unnest({REGIMES!r}) AS regime),
tpl AS (SELECT n.regime, coalesce(b.act, maj.act) AS template, coalesce(b.purity, 0.0) AS purity FROM names n LEFT JOIN best b ON b.regime=n.regime AND b.rk=1, maj),
done AS (SELECT pr.*, tpl.template AS pred_act, CAST(substr(act,1,1)<>substr(template,1,1) AS INTEGER)+CAST(substr(act,3,1)<>substr(template,3,1) AS INTEGER)+CAST(substr(act,5,1)<>substr(template,5,1) AS INTEGER) AS ham FROM pr JOIN tpl ON tpl.regime=pr.pred_regime)"""


def _predicted(spark, sf):
    lab = labelled(spark, sf)
    lab = lab.withColumn("pred_regime", best_regime(_score_columns()))
    return with_template(lab, action_templates(lab))


@query("regime_argmax", f"{LAB} SELECT record_id, {_PRED} AS pred_regime FROM lab")
def _(spark, sf):
    """Regime of the largest score, ties to the earlier one."""
    return labelled(spark, sf).select("record_id", best_regime(_score_columns()).alias("pred_regime"))


@query("regime_targets", f"{LAB} SELECT " + ", ".join(f"sum(CASE WHEN regime='{r}' THEN 1.0 ELSE 0.0 END) AS is_{r}" for r in REGIMES) + " FROM lab")
def _(spark, sf):
    """One-vs-rest targets."""
    wide = labelled(spark, sf).withColumns(regime_targets())
    return wide.agg(*[F.sum(f"is_{r}").alias(f"is_{r}") for r in REGIMES])


@query("bit_predictions", f"{LAB} SELECT record_id, CAST({_SCORE_SQL[4]}>=0.5 AS INTEGER) AS brake_bit FROM lab")
def _(spark, sf):
    return labelled(spark, sf).select("record_id", bit_prediction(_score_columns()[4]).alias("brake_bit"))


@query("templates", f"{LAB}, {_TPL} SELECT regime, template, round(purity,6) AS purity FROM tpl")
def _(spark, sf):
    """Most common action per regime with its share."""
    t = action_templates(labelled(spark, sf))
    return t.select("regime", F.array_join(F.transform("template", lambda b: b.cast("string")), ",").alias("template"), rnd("purity").alias("purity"))


@query(
    "templates_missing_regime",
    f"{LAB}, {_TPL.replace('FROM lab)', 'FROM lab WHERE regime NOT IN (' + chr(39) + 'thermal_caution' + chr(39) + '))')} SELECT regime, template, round(purity,6) AS purity FROM tpl",
)
def _(spark, sf):
    """A regime without records takes the overall majority and purity 0."""
    t = action_templates(labelled(spark, sf).where("regime <> 'thermal_caution'"))
    return t.select("regime", F.array_join(F.transform("template", lambda b: b.cast("string")), ",").alias("template"), rnd("purity").alias("purity"))


_AGREE = "avg(CASE WHEN regime=pred_regime THEN 1.0 ELSE 0.0 END) AS regime_accuracy, avg(CASE WHEN ham=0 THEN 1.0 ELSE 0.0 END) AS exact_agreement, avg(CAST(ham AS DOUBLE)) AS avg_hamming, count(*) AS n_eval"


@query("agreement", f"{LAB}, {_TPL}, a AS (SELECT {_AGREE} FROM done) SELECT round(regime_accuracy,6) AS regime_accuracy, round(exact_agreement,6) AS exact_agreement, round(avg_hamming,6) AS avg_hamming, n_eval FROM a")
def _(spark, sf):
    """Regime accuracy, exact agreement and mean Hamming distance."""
    return rounded(agreement(_predicted(spark, sf)))


@query("report_json", f"{LAB}, {_TPL}, a AS (SELECT {_AGREE} FROM done) SELECT round(exact_agreement,6) AS exact_agreement, round(avg_hamming,6) AS avg_hamming, n_eval FROM a")
def _(spark, sf):
    """A metric report written as JSON and read back."""
    path = shared_path(spark, "report")
    write_report(agreement(_predicted(spark, sf)), path)
    back = spark.read.schema("exact_agreement double, avg_hamming double, n_eval long").json(path)
    return rounded(back)


@query(
    "compactness",
    f"{LAB}, u AS (SELECT pmod AS fold, name, CAST(count(*) FILTER (WHERE hit) AS DOUBLE) AS bits, regime AS target FROM (SELECT record_id%5 AS pmod, regime, unnest(['throttle','boost','reduce_clock']) AS name, unnest([throttle,boost,reduce_clock]) AS hit FROM lab) q GROUP BY ALL), m AS (SELECT target, name, min(bits) AS b FROM u GROUP BY target, name) SELECT target, count(*) AS num_consensus_ops, median(b) AS median_op_bits FROM m GROUP BY target",
)
def _(spark, sf):
    """Operators and median evidence floor per law, on a log counted from the records."""
    bits = F.array(*[F.struct(F.lit(b).alias("name"), F.col(b).alias("hit")) for b in BITS])
    long = labelled(spark, sf).select((F.col("record_id") % 5).alias("fold"), F.col("regime").alias("target"), F.inline(bits))
    log = long.groupBy("fold", "name", "target").agg(F.count_if("hit").cast("double").alias("bits"))
    return compactness(log)


@query(
    "gate",
    f"{LAB}, {_TPL}, a AS (SELECT {_AGREE} FROM done), p AS (SELECT avg(purity) AS mean_template_purity, count(*)*2.0 AS mean_num_ops, 100.0 AS mean_median_bits FROM tpl), f AS (SELECT regime_accuracy>=0.9 AS regime_accuracy_pass, exact_agreement>=0.5 AS exact_agreement_pass, avg_hamming<=0.15 AS avg_hamming_pass, mean_num_ops<=12 AS mean_num_ops_pass, mean_median_bits<=128 AS mean_median_bits_pass, mean_template_purity>=0.9 AS template_purity_pass FROM a, p) SELECT *, regime_accuracy_pass AND exact_agreement_pass AND avg_hamming_pass AND mean_num_ops_pass AND mean_median_bits_pass AND template_purity_pass AS all_pass FROM f",
)
def _(spark, sf):
    """Threshold flags of a distilled policy."""
    lab = materialise(labelled(spark, sf).withColumn("pred_regime", best_regime(_score_columns())), "predicted")
    tpl = action_templates(lab)
    extra = tpl.agg(F.avg("purity").alias("mean_template_purity"), (F.count("*") * 2.0).alias("mean_num_ops"), F.lit(100.0).alias("mean_median_bits"))
    one = agreement(with_template(lab, tpl)).withColumn("k", F.lit(1)).join(extra.withColumn("k", F.lit(1)), "k")
    flags = with_gate(one, Gate(min_exact_agreement=0.5))
    return flags.select(*[c for c in flags.columns if c.endswith("_pass")])


_MINE = f"""{LAB}, {_TPL}, sc AS (SELECT *, ham+0.75*CAST(pred_regime<>regime AS INTEGER)+0.35*override_code+0.15*greatest(reward_like,0.0)+CASE WHEN shield_level='YELLOW' THEN 0.5 WHEN shield_level IN ('ORANGE','RED') THEN 1.0 ELSE 0.0 END AS hard_score FROM done),
rk AS (SELECT *, row_number() OVER (ORDER BY hard_score>0 DESC, round(hard_score,9) DESC, record_id) AS rk, count(*) OVER () AS n FROM sc),
mined AS (SELECT *, hard_score>0 AND rk<=greatest(1,CAST(floor(n*0.2) AS BIGINT)) AS chosen FROM rk),
cp AS (SELECT *, CASE WHEN chosen THEN 1+least(4,CAST(ceil(hard_score) AS INTEGER)) ELSE 0 END AS extra FROM mined)"""


@query("mining", f"{_MINE} SELECT record_id, ham AS mismatch_bits, round(hard_score,6) AS hard_score, chosen FROM cp")
def _(spark, sf):
    """Hardness of every record and the hardest fifth."""
    m = mine(_predicted(spark, sf))
    return m.select("record_id", "mismatch_bits", rnd("hard_score").alias("hard_score"), "chosen")


@query("mining_stats", f"{_MINE} SELECT count(*) FILTER (WHERE chosen) AS num_hard_examples, round(avg(hard_score) FILTER (WHERE chosen),6) AS mean_hard_score, round(max(hard_score) FILTER (WHERE chosen),6) AS max_hard_score, CAST(sum(extra+1) AS BIGINT) AS replay_size FROM cp")
def _(spark, sf):
    return rounded(mining_stats(mine(_predicted(spark, sf))))


@query("hardest_records", f"{_MINE} SELECT record_id, round(hard_score,6) AS hard_score, pred_regime, regime, ham AS mismatch_bits FROM cp WHERE chosen ORDER BY round(hard_score,9) DESC, record_id LIMIT 10")
def _(spark, sf):
    """Report sample of the ten hardest records."""
    h = hardest(mine(_predicted(spark, sf)))
    return h.select("record_id", rnd("hard_score").alias("hard_score"), "pred_regime", "regime", "mismatch_bits")


@query("replay", f"{_MINE} SELECT record_id, regime, copy FROM (SELECT record_id, regime, unnest(generate_series(0, extra)) AS copy FROM cp) q")
def _(spark, sf):
    """Training table with copies of the chosen records."""
    return replay_rows(mine(_predicted(spark, sf))).select("record_id", "regime", F.col("copy").cast("long").alias("copy"))


@query("replay_weights", f"{_MINE} SELECT regime, CAST(sum(extra+1) AS DOUBLE) AS weight, count(*) AS n FROM cp GROUP BY regime")
def _(spark, sf):
    """Replay as row weights: the same totals without copying."""
    w = replay_weights(mine(_predicted(spark, sf)))
    return w.groupBy("regime").agg(F.sum("replay_weight").alias("weight"), F.count("*").alias("n"))


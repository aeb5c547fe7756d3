"""Policy distillation: predictions from laws, action templates, agreement, compactness gate, mining, replay."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gramlaw.operators.ranks import first_rows
from gramlaw.operators.telemetry import REGIMES
from gramlaw.session import materialise


def regime_targets(regime: str = "regime") -> dict[str, Column]:
    """One 0/1 target per regime."""
    return {f"is_{r}": (F.col(regime) == r).cast("int").cast("double") for r in REGIMES}


def bit_prediction(score: Column) -> Column:
    return (score >= 0.5).cast("int")


def best_regime(scores: list[Column], names: list[str] = REGIMES) -> Column:
    """Name of the largest score; ties go to the earlier regime."""
    top = F.greatest(*scores)
    out = F.lit(names[-1])
    for name, s in reversed(list(zip(names, scores))[:-1]):
        out = F.when(s == top, name).otherwise(out)
    return out


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, v: s + v)


def action_templates(
    df: DataFrame, order: str = "record_id", regime: str = "regime", action: str = "executed_action", copies: str | None = None
) -> DataFrame:
    """Most common action per regime (ties to the one seen first) and its share; a regime never seen gets the overall
    majority with share 0. Only one row per (regime, action) leaves the map side. ``copies`` names repetition counts."""
    n = F.sum(copies) if copies else F.count("*")
    counts = df.groupBy(regime, action).agg(n.alias("n"), F.min(order).alias("seen")).withColumnRenamed(regime, "regime")
    mine = Window.partitionBy("regime").orderBy(F.desc("n"), "seen")
    ranked = counts.select(
        "regime",
        F.col(action).alias("template"),
        F.row_number().over(mine).alias("rank"),
        (F.col("n") / F.sum("n").over(Window.partitionBy("regime"))).alias("purity"),
    ).where("rank = 1")
    overall = counts.groupBy(action).agg(F.sum("n").alias("n"), F.min("seen").alias("seen"))
    overall = overall.orderBy(F.desc("n"), "seen").limit(1).select(F.col(action).alias("majority"), F.lit(1).alias("one"))
    listed = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(r) for r in REGIMES])).alias("pos", "regime"), F.lit(1).alias("one"))
    return (
        listed.join(ranked, "regime", "left")
        .join(F.broadcast(overall), "one", "left")
        .select("pos", "regime", F.coalesce("template", "majority").alias("template"), F.coalesce("purity", F.lit(0.0)).alias("purity"))
    )


def with_template(df: DataFrame, templates: DataFrame, predicted: str = "pred_regime") -> DataFrame:
    """Predicted action = template of the predicted regime (five rows, broadcast)."""
    small = templates.select(F.col("regime").alias(predicted), F.col("template").alias("pred_action"))
    return df.join(F.broadcast(small), predicted, "left")


def agreement(df: DataFrame, true_action: str = "executed_action", pred_action: str = "pred_action", by: list[str] = ()) -> DataFrame:
    distance = hamming(F.col(true_action), F.col(pred_action))
    aggs = [
        F.avg((distance == 0).cast("double")).alias("exact_agreement"),
        F.avg(distance.cast("double")).alias("avg_hamming"),
        F.count("*").alias("n_eval"),
    ]
    if "pred_regime" in df.columns and "regime" in df.columns:
        aggs.insert(0, F.avg((F.col("regime") == F.col("pred_regime")).cast("double")).alias("regime_accuracy"))
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def compactness(op_log: DataFrame, by: str = "target") -> DataFrame:
    """Per law: distinct operators over folds and the median of their lowest evidence."""
    floor = op_log.groupBy(by, "name").agg(F.min("bits").alias("min_bits"))
    return floor.groupBy(by).agg(F.count("*").alias("num_consensus_ops"), F.median("min_bits").alias("median_op_bits"))


@dataclass(frozen=True)
class Gate:
    """Thresholds a distilled policy has to meet."""

    min_regime_accuracy: float = 0.90
    min_exact_agreement: float = 0.90
    max_avg_hamming: float = 0.15
    max_mean_num_ops: float = 12.0
    max_mean_median_bits: float = 128.0
    min_mean_template_purity: float = 0.90


def with_gate(metrics: DataFrame, gate: Gate = Gate()) -> DataFrame:
    flags = {
        "regime_accuracy_pass": F.col("regime_accuracy") >= gate.min_regime_accuracy,
        "exact_agreement_pass": F.col("exact_agreement") >= gate.min_exact_agreement,
        "avg_hamming_pass": F.col("avg_hamming") <= gate.max_avg_hamming,
        "mean_num_ops_pass": F.col("mean_num_ops") <= gate.max_mean_num_ops,
        "mean_median_bits_pass": F.col("mean_median_bits") <= gate.max_mean_median_bits,
        "template_purity_pass": F.col("mean_template_purity") >= gate.min_mean_template_purity,
    }
    every = F.lit(True)
    for name in flags:
        every = every & F.col(name)
    return metrics.withColumns(flags).withColumn("all_pass", every)


# --------------------------------------------------------------------------------------------------------------
# Mining and replay


def hardness(df: DataFrame) -> DataFrame:
    """Mismatch bits and hardness score of each record."""
    boundary = F.when(F.col("shield_level") == "YELLOW", 0.5).when(F.col("shield_level").isin("ORANGE", "RED"), 1.0).otherwise(0.0)
    miss = hamming(F.col("executed_action"), F.col("pred_action"))
    regime_miss = (F.col("pred_regime") != F.col("regime")).cast("int")
    score = miss + regime_miss * 0.75 + F.col("override_code") * 0.35 + F.greatest(F.col("reward_like"), F.lit(0.0)) * 0.15 + boundary
    return df.withColumns({"mismatch_bits": miss, "hard_score": score})


def mine(df: DataFrame, order: str = "record_id", top_frac: float = 0.2, stage: bool = True) -> DataFrame:
    """Mark the hardest ``max(1, floor(top_frac·n))`` records with a positive score; equal scores in record order.

    The cut is found by counting, not by a global sort: the limit grows with the table.
    """
    scored = materialise(hardness(df), "hardness") if stage else hardness(df)
    n, hard = scored.agg(F.count("*"), F.count_if(F.col("hard_score") > 0)).first()
    k = min(max(1, int(n * top_frac)), hard)
    positive = F.col("hard_score") > 0
    chosen = positive & first_rows(scored.where(positive), [-F.col("hard_score"), F.col(order)], [k])[0] if k else F.lit(False)
    return scored.withColumn("chosen", chosen)


def copies(strength: int = 4) -> Column:
    """Extra copies of a chosen record."""
    return F.when(F.col("chosen"), F.least(F.lit(strength), F.ceil("hard_score").cast("int")) + 1).otherwise(0)


def replay_weights(mined: DataFrame, strength: int = 4) -> DataFrame:
    """Replay as a row weight: the moments equal those of the copied table, and a record stays in one fold."""
    return mined.withColumn("replay_weight", (copies(strength) + 1).cast("double"))


def replay_rows(mined: DataFrame, strength: int = 4) -> DataFrame:
    """Replay as real copies: every record once, plus the extra copies of the chosen ones."""
    return mined.withColumn("copy", F.explode(F.sequence(F.lit(0), copies(strength))))


def mining_stats(mined: DataFrame, strength: int = 4) -> DataFrame:
    chosen = F.col("chosen")
    return mined.agg(
        F.count_if(chosen).alias("num_hard_examples"),
        F.coalesce(F.avg(F.when(chosen, F.col("hard_score"))), F.lit(0.0)).alias("mean_hard_score"),
        F.max(F.when(chosen, F.col("hard_score"))).alias("max_hard_score"),
        F.sum(copies(strength) + 1).alias("replay_size"),
    )


def hardest(mined: DataFrame, order: str = "record_id", k: int = 10) -> DataFrame:
    """The ``k`` hardest records, as a report sample."""
    cols = [order, "hard_score", "pred_regime", "regime", "pred_action", "executed_action", "mismatch_bits"]
    return mined.where("chosen").orderBy(F.desc("hard_score"), order).limit(k).select(*cols)

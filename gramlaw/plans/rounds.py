"""Distilling a policy into laws: fit, evaluate, mine disagreements, refit with replay."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlaw.operators.distill import (
    Gate,
    action_templates,
    agreement,
    best_regime,
    bit_prediction,
    mine,
    mining_stats,
    regime_targets,
    replay_rows,
    replay_weights,
    with_gate,
    with_template,
)
from gramlaw.operators.splits import positional_split
from gramlaw.operators.telemetry import BITS, FEATURES, REGIMES
from gramlaw.plans.law import score_laws
from gramlaw.plans.options import Options
from gramlaw.plans.search import Gathered, Report, search
from gramlaw.session import materialise

READ = ["regime", "executed_action", "shield_level", "override_code", "reward_like"]  # beside inputs and the record's id


@dataclass
class Student:
    """Laws per target, with action templates when regimes are predicted."""

    kind: str
    reports: dict[str, Report]
    templates: DataFrame | None

    def predict(self, df: DataFrame) -> DataFrame:
        temporary = {t: f"__s_{t}" for t in self.reports}
        scored = score_laws(df, {temporary[t]: r.model for t, r in self.reports.items()})
        if self.kind == "bits":
            bits = F.array(*[bit_prediction(F.col(temporary[f"y_{b}"])) for b in BITS])
            return scored.withColumn("pred_action", bits).drop(*temporary.values())
        named = scored.withColumn("pred_regime", best_regime([F.col(temporary[f"is_{r}"]) for r in REGIMES]))
        return with_template(named.drop(*temporary.values()), self.templates)

    def law_rows(self) -> list[tuple]:
        """Per law: distinct operators over folds, median of their lowest evidence, out-of-fold scores."""
        rows = []
        for t, r in self.reports.items():
            floors: dict[str, float] = {}
            for entry in r.op_log:
                floors[entry[2]] = min(entry[6], floors.get(entry[2], np.inf))
            median = float(np.median(list(floors.values()))) if floors else 0.0
            rows.append((t, float(len(floors)), median, float(r.metrics["R2_OOF"]), float(r.metrics["MSE_OOF"])))
        return rows


@dataclass
class Distilled:
    student: Student
    evaluation: dict
    rounds: list[dict] = field(default_factory=list)

    def metrics(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([self.evaluation])

    def history(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rounds)

    def compactness(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.student.law_rows(), "target string, num_consensus_ops double, median_op_bits double, r2_oof double, mse_oof double")


def fit_student(
    train: DataFrame, kind: str, features: list[str], opt: Options, key: str = "record_id", copies: str | None = None, known: Gathered | None = None
) -> Student:
    if kind == "bits":
        df = train.withColumns({f"y_{b}": F.col("executed_action")[i].cast("double") for i, b in enumerate(BITS)})
        targets, templates = [f"y_{b}" for b in BITS], None
    else:
        df = train.withColumns(regime_targets())
        targets, templates = [f"is_{r}" for r in REGIMES], materialise(action_templates(train, key, copies=copies), "templates")
    return Student(kind, search(df, features, targets, key, opt, copies=copies, known=known), templates)


def evaluate_student(student: Student, predicted: DataFrame, gate: Gate | None = Gate()) -> dict:
    """Agreement, compactness and gate flags of the student's predictions as one record."""
    laws = student.law_rows()
    out = agreement(predicted).first().asDict()
    out["mean_num_ops"] = float(np.mean([r[1] for r in laws]))
    out["mean_median_bits"] = float(np.mean([r[2] for r in laws]))
    if student.kind == "regimes":
        out["mean_template_purity"] = student.templates.agg(F.avg("purity")).first()[0]
        if gate:
            out = with_gate(predicted.sparkSession.createDataFrame([out]), gate).first().asDict()
    return out


def distill_rounds(
    labelled: DataFrame,
    kind: str = "regimes",
    features: list[str] = FEATURES,
    opt: Options = Options(),
    rounds: int = 2,
    frac: float = 0.7,
    top_frac: float = 0.2,
    strength: int = 4,
    replay: str = "weights",
    gate: Gate | None = Gate(),
) -> Distilled:
    """``rounds`` + 1 fits. Mining always looks at the original training rows; replay enters as repetition counts or as
    real copies, with the same result: copies keep their record's fold because folds are hashed by record id. With counts
    the moments of a later round are those of the first plus what the repeated rows add."""
    used = dict.fromkeys(["record_id", *features, *[c for c in READ if c in labelled.columns]])
    rows = materialise(positional_split(labelled.select(*used), "record_id", frac), "labelled")
    train, test = rows.where("is_train"), rows.where("NOT is_train")
    current, times = train, None
    history = []
    student = known = None
    for r in range(rounds + 1):
        student = fit_student(current, kind, features, opt, copies=times, known=known)
        known = known or next(iter(student.reports.values())).gathered
        predicted = student.predict(train)
        if r < rounds:
            predicted = mined = mine(predicted, top_frac=top_frac)
        record = {"round": r, **evaluate_student(student, predicted, gate)}
        if r < rounds:
            record |= mining_stats(mined, strength).first().asDict()
            if replay == "weights":
                current, times = replay_weights(mined, strength), "replay_weight"
            else:
                current, times = replay_rows(mined, strength), None
        history.append(record)
    full = sorted({k for h in history for k in h})
    history = [{k: (float(h[k]) if isinstance(h.get(k), (int, float)) and not isinstance(h.get(k), bool) else h.get(k)) for k in full} for h in history]
    return Distilled(student, evaluate_student(student, student.predict(test), gate), history)


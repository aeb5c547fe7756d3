"""Tables behind a cross-validation report: operator stability, consensus, repeated runs, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlaw.operators.groups import groups_from_moments
from gramlaw.operators.gram import Design, profile_inputs
from gramlaw.operators.probe import probe_median, probe_scores, probe_shifts, probes_for
from gramlaw.operators.splits import hashed_folds
from gramlaw.plans.options import Options
from gramlaw.plans.search import search


def operator_stability(op_log: DataFrame, folds: int, by: list[str] = ()) -> DataFrame:
    """Per operator: share of folds, agreement with the majority sign, and the lowest evidence over folds."""
    pos, neg = F.count_if(F.col("sign") > 0), F.count_if(F.col("sign") < 0)
    return op_log.groupBy(*by, "name").agg(
        (F.count("*") / folds).alias("fold_freq"),
        (F.greatest(pos, neg) / F.count("*")).alias("sign_stability"),
        F.min("bits").alias("min_bits"),
    )


def consensus(stability: DataFrame, min_freq: float = 0.60, min_sign: float = 0.90, min_bits: float = 6.0) -> DataFrame:
    return stability.where((F.col("fold_freq") >= min_freq) & (F.col("sign_stability") >= min_sign) & (F.col("min_bits") >= min_bits))


def inclusion_counts(fold_reports: DataFrame, column: str = "atoms") -> DataFrame:
    """How often each atom (or block kind) was used over repeated runs."""
    return fold_reports.select(F.explode(column).alias("name")).groupBy("name").count().orderBy(F.desc("count"), "name")


def repeated_search(df: DataFrame, features: list[str], target: str, key: str, seeds: list[int], opt: Options, draws: int = 8) -> DataFrame:
    """Fold reports over several seeds, each with the invariance score of its law on its validation rows."""
    prof = profile_inputs(Design(df, features, [target]))
    spec = groups_from_moments(prof.corr(len(features)), prof.variances(len(features)))
    out = None
    for seed in seeds:
        o = opt.patched(seed=seed)
        folded = hashed_folds(df, key, o.folds, seed, "__fold")
        report = search(folded, features, target, key, o, fold="__fold", consensus=False)[target]
        scores = []
        for f in report.folds:
            shifts = probe_shifts(folded.where(F.col("__fold") == f.fold), f.law(features), probes_for(spec), key, draws, seed)
            scores.append((f.fold, probe_median(probe_scores(shifts)).first()["median"]))
        spark = df.sparkSession
        rows = report.fold_frame(spark).join(spark.createDataFrame(scores, "fold int, invariance double"), "fold").withColumn("seed", F.lit(seed))
        out = rows if out is None else out.unionByName(rows)
    return out


def repeated_summary(fold_reports: DataFrame) -> DataFrame:
    """Mean and deviation of R² and error over seeds and folds, and the mean invariance score where present."""
    score = F.avg("invariance") if "invariance" in fold_reports.columns else F.lit(None).cast("double")
    return fold_reports.agg(
        F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("sd_r2"), F.avg("mse").alias("mean_mse"), F.stddev_pop("mse").alias("sd_mse"),
        score.alias("mean_invariance"), F.count("*").alias("fits"),
    )

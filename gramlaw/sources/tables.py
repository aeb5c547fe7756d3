"""Reading inputs and writing results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gramlaw.operators.telemetry import FEATURES

RECORD_SCHEMA = (
    "mode string, sensor_scenario string, topology_scenario string, episode long, tick long, "
    "feature_map map<string,double>, proposed_action array<int>, executed_action array<int>, shield_level string, "
    "override_code int, reward_like double, regime_label string"
)


def regression_table(df: DataFrame, features: list[str], target: str, key: str | None = None) -> DataFrame:
    """A named dataset as doubles: ``x0 … x{d-1}, y`` and the key."""
    keep = [F.col(key)] if key else []
    xs = [F.col(f"`{c}`").cast("double").alias(f"x{j}") for j, c in enumerate(features)]
    return df.select(*keep, *xs, F.col(f"`{target}`").cast("double").alias("y"))


def read_basis_csv(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Headerless numeric CSV whose first column is the row position, then ``width`` basis columns ``b0 …``."""
    fields = [T.StructField("i", T.LongType())] + [T.StructField(f"b{j}", T.DoubleType()) for j in range(width)]
    return spark.read.schema(T.StructType(fields)).csv(path, header=False, mode="FAILFAST")


def sigma_entries(df: DataFrame, column: str = "value") -> DataFrame:
    """Covariance documents, ``[[…]]`` or ``{"Sigma": [[…]]}``, as entries (i, j, v); other columns are kept."""
    nested = "array<array<double>>"
    wrapped = F.from_json(column, f"struct<Sigma:{nested}>")["Sigma"]
    matrix = F.when(F.ltrim(column).startswith("{"), wrapped).otherwise(F.from_json(column, nested))
    rest = [c for c in df.columns if c != column]
    rows = df.select(*rest, F.posexplode(matrix).alias("i", "row"))
    return rows.select(*rest, F.col("i").cast("long").alias("i"), F.posexplode("row").alias("j", "v")).withColumn("j", F.col("j").cast("long"))


def read_sigma_json(spark: SparkSession, path: str) -> DataFrame:
    return sigma_entries(spark.read.text(path, wholetext=True))


def check_shapes(basis: DataFrame, target: DataFrame, sigma: DataFrame) -> dict[str, int]:
    """Basis, target and covariance must have the same rows ``i``, each once, and the covariance all of its diagonal and
    nothing else; raises ``ValueError`` otherwise."""

    def keys(df: DataFrame, table: int) -> DataFrame:
        return df.select("i", *[F.lit(1 if k == table else 0).alias(f"n{k}") for k in range(3)])

    both = keys(basis, 0).unionByName(keys(target, 1)).unionByName(keys(sigma.where("i = j"), 2))
    each = both.groupBy("i").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(3)])
    good = F.col("i").isNotNull() & (F.col("n0") == 1) & (F.col("n1") == 1) & (F.col("n2") == 1)
    n, bad = each.agg(F.count("*"), F.count_if(~good)).first()
    ends = sigma.where("i != j").select(F.explode(F.array("i", "j")).alias("i")).distinct()
    strange = ends.join(each.where(good), "i", "left_anti")
    if bad or not n or not strange.isEmpty():
        raise ValueError(f"shape mismatch: {bad} of {n} rows are not once in basis, target and covariance diagonal, or covariance entries name other rows")
    return {"rows": n}


def telemetry_records(labelled: DataFrame) -> DataFrame:
    """Labelled telemetry in the exchange schema."""
    fmap = F.col("feature_map") if "feature_map" in labelled.columns else F.create_map(
        *[v for n in FEATURES for v in (F.lit(n), F.col(n).cast("double"))]
    )
    scenario = lambda c, default: F.col(c) if c in labelled.columns else F.lit(default)
    return labelled.select(
        scenario("mode", "turbo").alias("mode"),
        scenario("sensor_scenario", "base").alias("sensor_scenario"),
        scenario("topology_scenario", "base_topology").alias("topology_scenario"),
        "episode", "tick", fmap.alias("feature_map"), "proposed_action", "executed_action", "shield_level", "override_code",
        "reward_like", F.col("regime").alias("regime_label"),
    )


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD_SCHEMA).json(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def fingerprint(n_rows: int, names: list[str], extra: dict | None = None) -> str:
    return json.dumps({"n": n_rows, "names": names, **(extra or {})}, sort_keys=True)


def content_mark(df: DataFrame, extra: dict | None = None) -> str:
    """A fingerprint of what a table holds, in any order: rows, names and the sum of the rows' hashes. Columns that have no
    hash (maps) are hashed by their entries in key order."""
    hashed = [F.array_sort(F.map_entries(f"`{c}`")) if kind.startswith("map") else F.col(f"`{c}`") for c, kind in df.dtypes]
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(*hashed).cast("decimal(38,0)"))).first()
    return fingerprint(n, df.columns, {"content": str(total), **(extra or {})})


def reuse_or_build(spark: SparkSession, path: str, mark: str, build) -> DataFrame:
    """Reuse a stage table only if it carries the same fingerprint; otherwise build and write it."""
    try:
        stored = spark.read.parquet(path)
        first = stored.select("__fingerprint").first()
        if first is not None and first[0] == mark:
            return stored.drop("__fingerprint")
    except Exception as missing:  # absent or unreadable stage
        if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing) and "UNRESOLVED_COLUMN" not in str(missing):
            raise
    build().withColumn("__fingerprint", F.lit(mark)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).drop("__fingerprint")

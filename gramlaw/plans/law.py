"""A fitted law: intercept plus weighted candidate columns. Scores rows as one Column expression or SQL text."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlaw.operators import catalog
from gramlaw.operators.catalog import Candidate


COLUMN_TERMS = 24  # beyond this a generated expression outgrows what the JVM compiles well


@dataclass(frozen=True)
class Law:
    """``y ≈ intercept + Σ weight·f(x)``. Residualized features are linear in the candidates, so every search result
    folds into this flat form and scoring needs no chained columns."""

    intercept: float
    terms: tuple[tuple[float, Candidate], ...]
    features: tuple[str, ...]

    def column(self, cols: list[Column] | None = None) -> Column:
        cols = cols if cols is not None else [F.col(f"`{n}`").cast("double") for n in self.features]
        total = F.lit(self.intercept)
        for weight, cand in self.terms:
            total = total + catalog.column(cand, cols) * F.lit(weight)
        return total

    def sql(self, names: list[str] | None = None) -> str:
        names = names or list(self.features)
        parts = [repr(self.intercept)] + [f"({w!r})*({catalog.sql(c, names)})" for w, c in self.terms]
        return " + ".join(parts)

    def score(self, df: DataFrame, name: str = "yhat") -> DataFrame:
        """Add the prediction: one JVM expression, or the Arrow form when the law has very many terms."""
        if len(self.terms) <= COLUMN_TERMS:
            return df.withColumn(name, self.column())
        return df.withColumn(name, F.element_at(score_array([self]), 1))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(-1, "1", "intercept", "{}", self.intercept)]
        rows += [(k, c.name, c.kind, json.dumps(c.args), w) for k, (w, c) in enumerate(self.terms)]
        return spark.createDataFrame(rows, "pos int, name string, kind string, args string, weight double")

    def to_json(self) -> str:
        terms = [{"weight": w, "candidate": json.loads(c.to_json())} for w, c in self.terms]
        return json.dumps({"intercept": self.intercept, "features": list(self.features), "terms": terms})

    @staticmethod
    def from_json(text: str) -> "Law":
        d = json.loads(text)
        terms = tuple((t["weight"], Candidate.from_json(json.dumps(t["candidate"]))) for t in d["terms"])
        return Law(d["intercept"], terms, tuple(d["features"]))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "law string").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Law":
        return Law.from_json(spark.read.parquet(path).first()["law"])


def score_array(laws: list[Law]) -> Column:
    """Scores of several laws over the same inputs as one array column.

    Shared candidate columns are evaluated once per Arrow batch; only the inputs travel to Python.
    """
    features = laws[0].features
    pool: dict[str, Candidate] = {}
    for law in laws:
        for _, c in law.terms:
            pool.setdefault(c.name, c)
    at = {n: j for j, n in enumerate(pool)}
    cands = list(pool.values())
    W = np.zeros((len(cands), len(laws)))
    for q, law in enumerate(laws):
        for w, c in law.terms:
            W[at[c.name], q] += w
    b0 = np.array([law.intercept for law in laws])

    @F.arrow_udf("array<double>")
    def scores(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in batches:
            X = np.column_stack([a.to_numpy(zero_copy_only=False).astype(float) for a in arrays])
            Y = np.ascontiguousarray(catalog.evaluate(cands, X) @ W + b0)
            offsets = pa.array(np.arange(0, Y.size + 1, len(laws), dtype=np.int32))
            yield pa.ListArray.from_arrays(offsets, pa.array(Y.ravel()))

    return scores(*[F.col(f"`{n}`").cast("double") for n in features])


def score_laws(df: DataFrame, laws: dict[str, Law]) -> DataFrame:
    """Add one prediction column per law."""
    if sum(len(law.terms) for law in laws.values()) <= COLUMN_TERMS:
        return df.withColumns({n: law.column() for n, law in laws.items()})
    scored = df.withColumn("__scores", score_array(list(laws.values())))
    return scored.withColumns({n: F.col("__scores")[q] for q, n in enumerate(laws)}).drop("__scores")


def flatten(A, w, b0: float, shift, scale, cands: list[Candidate], features) -> Law:
    """Fold features given as rows over scaled candidates, with weights ``w``, into raw candidate weights."""
    p = len(cands)
    combined = np.asarray(w) @ np.asarray(A) if len(w) else np.zeros(p + 2)
    raw = combined[1 : 1 + p] / scale
    used = np.flatnonzero(combined[1 : 1 + p])
    intercept = float(b0 + combined[0] - raw[used] @ shift[used])
    return Law(intercept, tuple((float(raw[j]), cands[j]) for j in used), tuple(features))

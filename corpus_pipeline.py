"""A training corpus from raw documents: language, quality, near-duplicates, personal data, packing.

Each stage works on all that the one before it kept and, but for the last, returns the columns of its input. Columns
that the operators do not know travel in a struct, so that extra columns may have any name. Every stage takes null ids,
texts, languages and sources, repeated rows and empty tables as its operator's docstring says.
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gramlaw.llm import langid, minhash, packing, pii, rules  # noqa: E402
from gramlaw.llm.text import WRITTEN, cut, packed, release, unpacked  # noqa: E402

MIN_EVIDENCE = 0.25  # least share of a text's n-grams that its language explains


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters and those that no learned language explains. A table without any language given has
    none to learn; it keeps all texts that have a letter."""
    rows = packed(docs)
    model = langid.fit(rows)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = langid.predict(rows, model, rows.columns)
    return unpacked(judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("evidence") >= MIN_EVIDENCE)), docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that fail the fixed rules or a fence of their language and source."""
    table = cut(rules.measured(packed(docs)), "measured")
    return unpacked(rules.judged(table, rules.thresholds(table)).where("rules.kept"), docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group."""
    return unpacked(minhash.deduplicated(packed(docs)), docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; ``n_chars`` follows the new text."""
    out = pii.masked(packed(docs))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return unpacked(out, docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("personal_data", without_personal_data),
    ("packing", sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. Once a stage is written, what it read and wrote on its way is deleted from the shared folder."""
    since = len(WRITTEN)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
            release(spark, since)
    return docs

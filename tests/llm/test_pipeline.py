import os
import random
import re

import corpus_pipeline as cp
from helpers import ODD, SCHEMA
from pyspark.sql import functions as F

from gramlaw.llm.text import WRITTEN, cut


def prose(i, words=70):
    draw = random.Random(i)
    return " ".join("".join(draw.choice(["ta", "re", "mo", "lin", "sa", "vi", "do", "ken"]) for _ in range(draw.randint(1, 4))) for _ in range(words))


def documents(spark):
    rows = [(i, prose(i) + f" mail me at name{i}@site.org today", "en", f"s{i % 3}", 0) for i in range(1, 40)]
    rows += [(100 + i, rows[i][1] + " end", "en", "s0", 0) for i in range(5)]  # near copies
    rows += [(200, "123 456 " * 60, "en", "s1", 0), (201, prose(3).upper() + " BUY!!! " * 40, "en", "s1", 0)]
    odd = [(300 + k if r[0] is not None else None, *r[1:]) for k, r in enumerate(ODD)]
    df = spark.createDataFrame(rows + odd + rows[:1], SCHEMA)
    return df.withColumn("score", F.lit(1)).withColumn("th", F.lit("x")).withColumn("rules", F.array(F.lit(2))).withColumn("a.b", F.lit(None).cast("string"))


def test_stages_take_effect(spark):
    docs, seen = documents(spark), {}
    for k, (name, stage) in enumerate(cp.STAGES):
        out = cut(stage(spark, docs, "unused"), name)
        assert k + 1 == len(cp.STAGES) or out.columns == docs.columns and out.dtypes == docs.dtypes
        seen[name], docs = out, out
    ids = {k: [r.doc_id for r in v.select("doc_id").collect()] for k, v in seen.items()}
    assert 200 not in ids["language"] and set(range(1, 40)) <= set(ids["language"])
    assert 201 not in ids["quality"] and set(range(1, 40)) <= set(ids["quality"])
    assert not {100, 101, 102, 103, 104} & set(ids["near_duplicates"]) and len(ids["near_duplicates"]) == len(set(ids["near_duplicates"]))
    assert sorted(ids["personal_data"], key=str) == sorted(ids["near_duplicates"], key=str)
    for r in seen["personal_data"].where("doc_id < 100").collect():
        assert "[EMAIL]" in r.text and not re.search("@", r.text) and r.n_chars == len(r.text)
    assert set(ids["packing"]) == set(ids["personal_data"])


def test_empty_table(spark, none):
    docs = none
    for name, stage in cp.STAGES:
        docs = cut(stage(spark, docs, "unused"), name)
    assert docs.count() == 0


def test_consumed_tables_are_deleted(spark, tmp_path):
    """A run leaves the last stage's input and what that stage wrote; another table of the session stays."""
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    kept, before = cut(spark.range(3), "other"), list(WRITTEN)
    out = cp.run(spark, str(tmp_path))
    assert out.count() > 0 and kept.count() == 3 and WRITTEN[: len(before)] == before
    left = [os.path.isdir(p) for p in WRITTEN]
    assert len(left) - len(before) <= 3 and all(left[len(before) :])

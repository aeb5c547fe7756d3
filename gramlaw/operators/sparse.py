"""Designs from feature maps without a column per key.

A map is a sparse row: for each key it holds there are two entries, its value (a null value counts as 0) and its presence
(1); all other entries are 0. Sums of products are gathered from the keys of a row alone, so their number is that of key
pairs that occur together, and keys are never collected. A null map has no keys but counts as a row. Keys of almost every
row are no problem: sums meet in the map tasks before they are shuffled, and rows are never sent to their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENT_KEYS = 1_000_000  # weights of at most so many keys are sent to every executor
SALTS = 32  # copies of a weight that meet the rows of its key otherwise


def entries(fmap: str) -> Column:
    """The row's (key, value) pairs in the order of keys."""
    pairs = F.transform(F.map_entries(fmap), lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["value"].cast("double"), F.lit(0.0)).alias("v")))
    return F.array_sort(F.coalesce(pairs, F.array().cast("array<struct<key:string,v:double>>")))


def key_pairs(df: DataFrame, fmap: str = "feature_map") -> DataFrame:
    """Sums of products of the columns of each two keys ``a <= b`` that occur together.

    ``n``: rows with both (presence times presence), ``vv``: value times value, ``vp``: value of a times presence of b,
    ``pv``: presence of a times value of b. A key with itself is its own row; there ``vp`` is the sum of its values.
    """
    rows = df.select(entries(fmap).alias("__e"))
    first = rows.select(F.posexplode("__e").alias("__at", "__a"), "__e")
    both = first.select("__a", F.explode(F.slice("__e", F.col("__at") + 1, F.size("__e"))).alias("__b"))
    va, vb = F.col("__a.v"), F.col("__b.v")
    return both.groupBy(F.col("__a.key").alias("a"), F.col("__b.key").alias("b")).agg(
        F.count("*").alias("n"), F.sum(va * vb).alias("vv"), F.sum(va).alias("vp"), F.sum(vb).alias("pv")
    )


def key_targets(df: DataFrame, targets: dict[str, Column], fmap: str = "feature_map") -> DataFrame:
    """Per key its products with each target: ``vy_<name>`` of its value, ``py_<name>`` of its presence, beside ``n``, the
    sum ``v`` and the square ``vv`` of its values. A row whose target is null or NaN adds nothing to that target."""
    known = {k: F.when(~F.isnan(c.cast("double")), c.cast("double")) for k, c in targets.items()}
    long = df.select(F.explode(entries(fmap)).alias("__e"), *[c.alias(f"__y_{k}") for k, c in known.items()])
    v = F.col("__e.v")
    sums = [f(k) for k in targets for f in (lambda k: F.sum(v * F.col(f"__y_{k}")).alias(f"vy_{k}"), lambda k: F.sum(f"__y_{k}").alias(f"py_{k}"))]
    return long.groupBy(F.col("__e.key").alias("key")).agg(F.count("*").alias("n"), F.sum(v).alias("v"), F.sum(v * v).alias("vv"), *sums)


def row_totals(df: DataFrame, targets: dict[str, Column]) -> DataFrame:
    """Products of the constant and the targets: one row with ``n``, ``y_<name>`` and ``yy_<name>``."""
    y = {k: F.when(~F.isnan(c.cast("double")), c.cast("double")) for k, c in targets.items()}
    return df.agg(F.count("*").alias("n"), *[F.sum(c).alias(f"y_{k}") for k, c in y.items()], *[F.sum(c * c).alias(f"yy_{k}") for k, c in y.items()])


def score_maps(df: DataFrame, row: list[str], weights: DataFrame, fmap: str = "feature_map", sent_keys: int = SENT_KEYS) -> DataFrame:
    """Per row key: ``score``, the sum of ``value_weight`` times value plus ``presence_weight`` over the row's keys.

    ``weights`` has one row per key; null weights and keys without a row count as 0, and a row without keys scores 0. A
    bounded number of keys is sent to the executors; beyond it a weight is copied ``SALTS`` times and the row's entries are
    dealt to the copies, so that a key of every row is no hot partition. Rows of equal row keys are scored together.
    """
    w = weights.select(F.col("key").alias("__k"), F.coalesce("value_weight", F.lit(0.0)).alias("__vw"), F.coalesce("presence_weight", F.lit(0.0)).alias("__pw"))
    long = df.select(*row, F.explode_outer(entries(fmap)).alias("__e"))
    if w.limit(sent_keys + 1).count() <= sent_keys:
        met = long.join(F.broadcast(w), F.col("__e.key") == F.col("__k"), "left")
    else:
        salt = F.pmod(F.xxhash64(*row), F.lit(SALTS)).cast("int")
        copies = w.withColumn("__salt", F.explode(F.array(*[F.lit(s) for s in range(SALTS)])))
        dealt = long.withColumn("__own", salt)
        met = dealt.join(copies, (F.col("__e.key") == F.col("__k")) & (F.col("__own") == F.col("__salt")), "left")
    term = F.coalesce(F.col("__e.v") * F.col("__vw") + F.col("__pw"), F.lit(0.0))
    return met.groupBy(*row).agg(F.sum(term).alias("score"))

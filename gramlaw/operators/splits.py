"""Folds, hold-outs and positional splits as row conditions; none of them sorts or shuffles the table."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlaw.operators.ranks import first_rows
from gramlaw.session import materialise


def hash_order(key: Column, seed: int) -> Column:
    """Reproducible shuffle position of a unique key: the first 60 bits of its MD5 with the seed."""
    text = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(text, 1, 15), 16, 10).cast("long")


def fold_sizes(n: int, folds: int, larger_last: bool = True) -> list[int]:
    """Sizes differing by at most one; the surplus goes to the last folds, or to the first ones."""
    sizes = [(n + i) // folds for i in range(folds)]
    return sizes if larger_last else sizes[::-1]


def exact_folds(df: DataFrame, key: str, folds: int, seed: int = 1337, larger_last: bool = True, name: str = "fold") -> DataFrame:
    """Folds of exact size in hash order. The key must be unique. The hashes are written once to find the cuts."""
    order = [hash_order(F.col(key), seed), F.col(key)]
    hashes = materialise(df.select(order[0].alias("__h"), order[1].alias("__key")), "hashes")
    n = hashes.count()
    cuts = list(accumulate(fold_sizes(n, folds, larger_last)[:-1]))
    value = F.lit(0)
    for inside in first_rows(hashes, [F.col("__h"), F.col("__key")], cuts, order):
        value = value + (~inside).cast("int")
    return df.withColumn(name, value)


def hashed_folds(df: DataFrame, key: str | list[str], folds: int, seed: int = 1337, name: str = "fold") -> DataFrame:
    """Folds of nearly equal size from a hash alone: no extra pass, and copies of a key stay together."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn(name, F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(folds)).cast("int"))


def holdout(df: DataFrame, key: str, frac: float = 0.2, seed: int = 1337, rounding: str = "half_even", name: str = "is_val") -> DataFrame:
    """Mark ``max(1, frac·n)`` rows, first in hash order, as validation; rounding is "half_even" or "floor"."""
    n = df.count()
    if rounding == "floor":
        k = int(frac * n)
    else:
        k = int(Decimal(frac * n).quantize(Decimal(1), rounding=ROUND_HALF_EVEN))
    return df.withColumn(name, first_rows(df, [hash_order(F.col(key), seed), F.col(key)], [max(1, k)])[0])


def positional_split(df: DataFrame, order: str, frac: float = 0.7, name: str = "is_train") -> DataFrame:
    """The first ``floor(frac·n)`` rows in record order train, the rest evaluate."""
    return df.withColumn(name, first_rows(df, [F.col(order)], [int(frac * df.count())])[0])

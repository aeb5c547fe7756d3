"""Ordered per-key scans (previous value, running sum, position) that survive one key holding much of the table.

Ordinary keys use a window. A key above ``hot_rows`` is cut into slices of about equal row counts, at quantiles of its
first order column: the window runs within slices, and the carry from slice to slice comes from a second window over one
summary row per slice. There are at most rows / ``hot_rows`` such keys, a bound for their broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 2_000_000
SLICES = 128


def _slices(df: DataFrame, key: str, first: str, hot_rows: int) -> tuple[DataFrame, bool]:
    """Add ``__slice``: 0 for ordinary keys, a range of the first order column for hot ones; and whether there are any."""
    axis = F.col(first).cast("timestamp").cast("double") if dict(df.dtypes)[first].startswith("timestamp") else F.col(first).cast("double")
    hot = df.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows).select(key)
    if hot.isEmpty():
        return df.withColumn("__slice", F.lit(0).cast("long")), False
    cuts = F.percentile_approx(axis, [k / SLICES for k in range(1, SLICES)], 10_000).alias("__cuts")
    table = df.join(F.broadcast(hot), key, "left_semi").groupBy(key).agg(F.coalesce(cuts, F.array().cast("array<double>")).alias("__cuts"))
    out = df.withColumn("__axis", axis).join(F.broadcast(table), key, "left")
    # equal values share a slice; rows without one come first
    place = F.size(F.filter("__cuts", lambda c: c < F.col("__axis"))) + 1
    slice_ = F.when(F.col("__cuts").isNull(), 0).when(F.col("__axis").isNull(), 1).otherwise(place)
    return out.withColumn("__slice", slice_.cast("long")).drop("__cuts", "__axis"), True


def ordered_scan(
    df: DataFrame,
    key: str,
    order: list[str],
    previous: dict[str, str] | None = None,
    running: dict[str, Column] | None = None,
    position: str | None = None,
    hot_rows: int = HOT_ROWS,
    latest: dict[str, str] | None = None,
) -> DataFrame:
    """Per key in order: previous values (``new name → column``), running sums (``new name → expression``), the 0-based
    position, and the last value before the row that is not null (``latest``: ``new name → column``)."""
    previous, running, latest = dict(previous or {}), dict(running or {}), dict(latest or {})
    if position:
        running[f"__{position}"] = F.lit(1).cast("long")
    sliced, any_hot = _slices(df, key, order[0], hot_rows)
    local = Window.partitionBy(key, "__slice").orderBy(*order)
    to_here = local.rowsBetween(Window.unboundedPreceding, 0)
    sliced = sliced.withColumns({f"__s_{n}": e for n, e in running.items()}) if running else sliced
    out = sliced.withColumns(
        {n: F.lag(c).over(local) for n, c in previous.items()}
        | {n: F.sum(f"__s_{n}").over(to_here) for n in running}
        | {n: F.last(c, ignorenulls=True).over(local.rowsBetween(Window.unboundedPreceding, -1)) for n, c in latest.items()}
        | {"__first": F.row_number().over(local) == 1}
    )
    if any_hot:
        place = F.struct(*order)
        summary = sliced.where("__slice > 0").groupBy(key, "__slice").agg(
            F.lit(1).alias("__one"),
            *[F.max_by(F.struct(F.col(c)), place).alias(f"__l_{n}") for n, c in previous.items()],
            *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(f"__n_{n}") for n, c in latest.items()],
            *[F.sum(f"__s_{n}").alias(f"__t_{n}") for n in running],
        )
        across = Window.partitionBy(key).orderBy("__slice")
        before = across.rowsBetween(Window.unboundedPreceding, -1)
        carry = summary.select(
            key,
            "__slice",
            *[F.lag(f"__l_{n}").over(across).alias(f"__c_{n}") for n in previous],
            *[F.sum(f"__t_{n}").over(before).alias(f"__b_{n}") for n in running],
            *[F.last(f"__n_{n}", ignorenulls=True).over(before).alias(f"__k_{n}") for n in latest],
        )
        out = out.join(carry, [key, "__slice"], "left")
        fixes = {n: F.when(F.col("__first") & F.col(f"__c_{n}").isNotNull(), F.col(f"__c_{n}.{c}")).otherwise(F.col(n)) for n, c in previous.items()}
        fixes |= {n: F.col(n) + F.coalesce(F.col(f"__b_{n}"), F.lit(0)) for n in running}
        fixes |= {n: F.coalesce(n, f"__k_{n}") for n in latest}
        out = out.withColumns(fixes)
    if position:
        out = out.withColumn(position, (F.col(f"__{position}") - 1).cast("long")).drop(f"__{position}")
    return out.drop("__first", "__slice", *[c for c in out.columns if c.startswith(("__s_", "__c_", "__b_", "__k_"))])


def with_previous(df: DataFrame, key: str, order: list[str], cols: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``prev_c`` for each column."""
    return ordered_scan(df, key, order, previous={f"prev_{c}": c for c in cols}, hot_rows=hot_rows)

"""Exact order statistics without sorting: histogram narrowing that moves only bin counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 4096
SMALL = 20000


def rank_select(df: DataFrame, value: Column, ranks: list[int]) -> list[tuple[float, int, int]]:
    """For each 1-based rank: the value there, how many rows are smaller, and how many are equal.

    Each round counts rows per bin inside the open brackets (one map-side-combined aggregation whatever the row count
    or skew) and narrows every bracket to the extremes of the bin that holds its rank. Nulls and NaN are left out;
    infinities are counted apart, at either end.
    """
    v = value.alias("v")
    rows = df.select(v).where(F.col("v").isNotNull())
    floating = dict(rows.dtypes)["v"] in ("double", "float")
    if floating:
        rows = rows.where(~F.isnan("v"))
    cell_type = "double" if floating else "long"
    ends = (F.col("v") == F.lit(float("-inf")), F.col("v") == F.lit(float("inf"))) if floating else (F.lit(False), F.lit(False))
    inner = F.when(~(ends[0] | ends[1]), F.col("v"))
    lo, hi, n, low_n, high_n = rows.agg(F.min(inner), F.max(inner), F.count("v"), F.count_if(ends[0]), F.count_if(ends[1])).first()
    if not n:
        raise ValueError("no values to rank")
    if any(r < 1 or r > n for r in ranks):
        raise ValueError(f"rank outside 1..{n}")
    done: dict[int, tuple] = {r: (float("-inf"), 0, low_n) for r in ranks if r <= low_n}
    done |= {r: (float("inf"), n - high_n, high_n) for r in ranks if r > n - high_n}
    left = [r for r in ranks if r not in done]
    open_ = {(lo, hi, low_n, n - low_n - high_n): left} if left else {}
    while open_:
        brackets = list(open_)
        ident = F.lit(None).cast("int")
        bin_of = F.lit(None).cast(cell_type)
        for b, (low, high, _, size) in reversed(list(enumerate(brackets))):
            inside = (F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high))
            ident = F.when(inside, b).otherwise(ident)
            offset = F.col("v") - F.lit(low)  # exact for integers, where a double would merge neighbours
            width = float(high) - float(low)
            if floating:  # halves, so that the difference of two large numbers of either sign is finite
                offset, width = F.col("v") * 0.5 - F.lit(low * 0.5), high * 0.5 - low * 0.5
            if size <= SMALL or width < 1e-290:
                cell = (F.col("v") if floating else offset).cast(cell_type)
            else:
                cell = F.floor(offset.cast("double") * (BINS / width)).cast(cell_type)
            bin_of = F.when(inside, cell).otherwise(bin_of)
        counted = (
            rows.select("v", ident.alias("b"), bin_of.alias("cell"))  # rows outside all brackets form one null group
            .groupBy("b", "cell")
            .agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .collect()
        )
        nxt: dict[tuple, list[int]] = {}
        for b, bracket in enumerate(brackets):
            cells = sorted((r for r in counted if r["b"] == b), key=lambda r: r["lo"])
            for rank in open_[bracket]:
                seen = bracket[2]
                for c in cells:
                    if rank <= seen + c["n"]:
                        if c["lo"] == c["hi"]:
                            done[rank] = (c["lo"], seen, c["n"])
                        else:
                            nxt.setdefault((c["lo"], c["hi"], seen, c["n"]), []).append(rank)
                        break
                    seen += c["n"]
        open_ = nxt
    return [done[r] for r in ranks]


def first_rows(df: DataFrame, order: list[Column], ks: list[int], shown: list[Column] | None = None) -> list[Column]:
    """For each k a condition that is true for exactly the first ``k`` rows in the ascending order of ``order`` tuples.

    All cuts are found together; ties at a cut are settled by the next order column, so no global sort and no
    single-partition limit is needed. ``shown`` are the same values as columns of another frame, for conditions on its rows.
    """
    shown = shown or order
    inner = sorted({k for k in ks if k > 0})
    found = dict(zip(inner, rank_select(df, order[0], inner))) if inner else {}
    out = []
    for k in ks:
        if k <= 0:
            out.append(F.lit(False))
            continue
        value, less, equal = found[k]
        head, tie = shown[0] < F.lit(value), shown[0] == F.lit(value)
        if less + equal == k:
            out.append(head | tie)
        elif len(order) == 1:
            raise ValueError("order columns do not identify rows")
        else:
            out.append(head | (tie & first_rows(df.where(order[0] == F.lit(value)), order[1:], [k - less], shown[1:])[0]))
    return out


def median_of(df: DataFrame, value: Column, n: int | None = None) -> float:
    """Exact median (mean of the two middle values for an even count)."""
    v = value.cast("double")
    if n is None:
        n = df.where(v.isNotNull() & ~F.isnan(v)).count()
    found = rank_select(df, v, sorted({(n + 1) // 2, n // 2 + 1}))
    return float(sum(f[0] for f in found) / len(found))

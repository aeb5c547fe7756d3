"""Bags of an exact number of rows, without replacement, for the training rows of every fold at once.

A row has one hash a bag; the bag of fold k is the m rows outside fold k with the least hashes, m = max(4, ⌊frac·n⌋). The
hash that ends each bag is found by narrowing: counts by leading bits, then by the next ones inside the bracket of each
bag, until few values are left. The folds' thresholds of one bag lie close together, so that the rows of all training bags
are sums of few leaves: a fold as a whole, what the bag leaves out of it (beyond the highest threshold), and what only a
single fold's bag leaves out (between its threshold and the highest). Rows with equal keys are in or out together, and a
bag then takes as many as fit.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlaw.plans.options import Options

BITS, FEW = 12, 1000
WHOLE_BITS = 63


def bag_hash(keys: list[str], seed: int, bag: int) -> Column:
    """63 bits of a row's hash for one bag."""
    return F.shiftrightunsigned(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed), F.lit("bag"), F.lit(bag)), 1)


def bag_size(n: int, opt: Options) -> int:
    return min(n, max(4, int(opt.bag_frac * n)))


def bag_thresholds(df: DataFrame, keys: list[str], fold: str, opt: Options) -> dict[tuple[int, int], int]:
    """Per (fold, bag) the greatest hash inside the bag; -1 for a bag without rows."""
    each = F.array(*[F.struct(F.lit(b).alias("b"), bag_hash(keys, opt.seed, b).alias("h")) for b in range(opt.bag_boots)])
    rows = df.select(F.col(fold).cast("int").alias("f"), F.inline(each))
    sizes = {r["f"]: r["n"] for r in df.groupBy(F.col(fold).cast("int").alias("f")).agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    left = {(k, b): bag_size(total - sizes[k] if len(sizes) > 1 else total, opt) for k in sizes for b in range(opt.bag_boots)}
    seen = lambda f, k: f != k or len(sizes) == 1
    prefix = {key: 0 for key in left}
    done: dict[tuple[int, int], int] = {key: -1 for key, m in left.items() if m == 0}
    bits, inside = 0, None
    while len(done) < len(left):
        open_ = {key for key in left if key not in done}
        codes = sorted({(b, prefix[k, b]) for k, b in open_})
        near = rows if bits == 0 else rows.where(F.struct("b", F.shiftright("h", WHOLE_BITS - bits)).isin([F.struct(F.lit(b), F.lit(p).cast("long")) for b, p in codes]))
        last = bits + BITS >= WHOLE_BITS or (inside is not None and max(inside[key] for key in open_) <= FEW)
        width = WHOLE_BITS if last else bits + BITS
        found = defaultdict(dict)
        for r in near.groupBy("f", "b", F.shiftright("h", WHOLE_BITS - width).alias("p")).agg(F.count("*").alias("n")).collect():
            found[r["b"]].setdefault(r["p"], {})[r["f"]] = r["n"]
        inside = {}
        for k, b in open_:
            place = sorted(p for p in found[b] if bits == 0 or p >> (width - bits) == prefix[k, b])
            before = None
            for p in place:
                n = sum(c for f, c in found[b][p].items() if seen(f, k))
                if last and n > left[k, b]:  # rows of equal hash that do not all fit stay out
                    break
                if not last and n >= left[k, b]:
                    prefix[k, b], inside[k, b] = p, n
                    break
                left[k, b] -= n
                before = p if n else before
                if last and left[k, b] == 0:
                    break
            if last:
                done[k, b] = before if before is not None else (prefix[k, b] << (WHOLE_BITS - bits)) - 1
        bits = width
    return done


def bag_leaves(keys: list[str], fold: str, thresholds: dict[tuple[int, int], int], opt: Options) -> Column:
    """The leaves of a row: fold·slots for the fold, + 1 + b for what bag b leaves out of it, and (of another fold k)
    k·slots + 1 + boots + b for what only the bag of fold k leaves out."""
    boots, slots = opt.bag_boots, 2 * opt.bag_boots + 1
    f, folds = F.col(fold).cast("int"), sorted({k for k, _ in thresholds})
    out = [f * slots]
    for b in range(boots):
        h, top = bag_hash(keys, opt.seed, b), max(thresholds[k, b] for k in folds)
        out.append(F.when(h > top, f * slots + 1 + b))
        for k in folds:
            if thresholds[k, b] < top:
                other = F.lit(len(folds) == 1) | (f != k)
                out.append(F.when((h <= top) & (h > thresholds[k, b]) & other, F.lit(k * slots + 1 + boots + b)))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def bag_plan(folds: list[int], opt: Options) -> list[tuple[int, int, float]]:
    """(leaf, fold·boots + bag, sign): how leaves add up to training bags."""
    boots, slots = opt.bag_boots, 2 * opt.bag_boots + 1
    plan = []
    for k in folds:
        for b in range(boots):
            for f in folds:
                if f != k or len(folds) == 1:
                    plan += [(f * slots, k * boots + b, 1.0), (f * slots + 1 + b, k * boots + b, -1.0)]
            plan.append((k * slots + 1 + boots + b, k * boots + b, -1.0))
    return plan

"""Stability of the operator set under subsampling, run on the executors from leaf moments.

Rows fall into hash buckets; a bag leaves some buckets out, so its moments are sums of leaf moments and no row is read
again. Each task adds up its (fold, bag) pairs as a stream and repeats the selection there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlaw.operators.bags import bag_plan
from gramlaw.operators.gram import PARTIAL_SCHEMA, affine, block_rows, record, salted_sum
from gramlaw.operators.select import greedy_operators
from gramlaw.plans.options import Options

PICK_SCHEMA = "fold int, target int, bag int, idx int"


def bag_buckets(opt: Options) -> list[list[int]]:
    """Buckets kept by each bag: drawn without replacement, ``bag_frac`` of them."""
    keep = max(1, int(round(opt.bag_frac * opt.bag_buckets)))
    out = []
    for b in range(opt.bag_boots):
        rng = np.random.default_rng([opt.seed, 7919, b])
        out.append(sorted(rng.choice(opt.bag_buckets, size=keep, replace=False).tolist()))
    return out


def bag_sums(partials: DataFrame, opt: Options, groups: int, fan_in: int) -> DataFrame:
    """From partial moments with leaf = fold·buckets + bucket to sums with leaf = fold·(boots + 1) + slot.

    Slot 0 adds all buckets of a fold, slot b + 1 those of bag b. One reducer sees all buckets of a block, so the bags
    are formed while adding and bucket sums never leave it.
    """
    B, slots = opt.bag_buckets, opt.bag_boots + 1
    slots_of = {q: [0, *(b + 1 for b, kept in enumerate(bag_buckets(opt)) if q in kept)] for q in range(B)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple, list] = {}
        for batch in batches:
            cols = batch.to_pydict()
            for leaf, kind, block, n, data in zip(*(cols[c] for c in ("leaf", "kind", "block", "n", "data"))):
                fold, bucket = divmod(leaf, B)
                part = np.frombuffer(data)
                for slot in slots_of[bucket]:
                    key = (fold * slots + slot, kind, block)
                    if key in acc:
                        acc[key][0] += part
                        acc[key][1] += n
                    else:
                        acc[key] = [part.copy(), n]
        for (leaf, kind, block), (data, n) in acc.items():
            yield record([(leaf, kind, block, n, data.tobytes())])

    # buckets are added up apart first: a fold's buckets of all tasks would meet in one of few reducers
    first = salted_sum(partials, groups, max(2, fan_in)).withColumn("fold", F.floor(F.col("leaf") / B))
    return first.repartition(groups, "fold", "kind", "block").drop("fold").mapInArrow(run, PARTIAL_SCHEMA)


def bag_picks(
    sums: DataFrame, kind: int, p: int, targets: int, scales: dict[int, tuple], limits: dict[tuple[int, int], int], opt: Options
) -> DataFrame:
    """Picks of every bag: rows (fold, target, bag, idx).

    ``sums`` comes from ``bag_sums``, or holds the leaves of ``bag_leaves`` if bags are exact. ``scales`` gives each fold's column shift, scale and live mask in working units,
    ``limits`` how many operators a (fold, target) may pick. A training bag of fold k adds that bag over the other folds.
    """
    boots, folds = opt.bag_boots, sorted(scales)
    slots = boots + 1
    plan = bag_plan(folds, opt) if opt.bag_exact else [
        (f * slots + 1 + b, k * boots + b, 1.0) for k in folds for f in folds if f != k or len(folds) == 1 for b in range(boots)
    ]
    parts = sums.sparkSession.createDataFrame(plan, "leaf int, bag int, sign double")  # at most 3·folds²·boots rows
    spread = (
        sums.where(F.col("kind") == kind)
        .join(F.broadcast(parts), "leaf")
        .select(F.col("bag").alias("leaf"), "kind", "block", "n", "data", "sign")
        .repartition(max(8, len(folds) * boots), "leaf")
    )
    P = 1 + p + targets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, list] = {}
        step = block_rows(P)
        for batch in batches:
            cols = batch.to_pydict()
            for leaf, block, n, data, sign in zip(cols["leaf"], cols["block"], cols["n"], cols["data"], cols["sign"]):
                M, rows = acc.setdefault(leaf, [np.zeros((P, P)), {}])
                lo = block * step
                hi = min(lo + step, P)
                M[lo:hi, lo:] += sign * np.frombuffer(data).reshape(hi - lo, P - lo)
                rows[block] = rows.get(block, 0) + int(sign) * n
        out = []
        for leaf, (M, rows) in acc.items():
            fold, bag = divmod(leaf, boots)
            n = rows[0]
            upper = np.triu_indices(P, 1)
            M.T[upper] = M[upper]
            shift, scale, live = scales[fold]
            S = affine(M, np.concatenate([[0.0], shift, np.zeros(targets)]), np.concatenate([[1.0], 1.0 / scale, np.ones(targets)]))
            for t in range(targets):
                limit = limits.get((fold, t), 0)
                if limit and n >= 4:
                    keep = [*range(1 + p), 1 + p + t]
                    picks, *_ = greedy_operators(S[np.ix_(keep, keep)], n, live, opt, limit=limit)
                    out += [(fold, t, bag, j) for j in picks]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32()) for c in zip(*out)], names=["fold", "target", "bag", "idx"]
            )

    return spread.mapInArrow(run, PICK_SCHEMA)


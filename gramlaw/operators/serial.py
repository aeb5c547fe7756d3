"""Folds that cut through one correlated series: marginal AR(1) covariance of each fold's training and validation rows.

Under AR(1) noise the marginal covariance of any subset of a series is again AR(1) over the gaps between the rows that are
left. So a row is whitened by the row of the same role before it. With F folds that seems to need 2F passes, but a row of
fold f whose predecessor has fold g meets only three different predecessors: the row just before it (for training sets
without f and g, and for all others if f = g), the last row of fold f (as a validation row of f) and the last row not in g
(for the training set without g). Each row is therefore entered at most three times, under the leaves

* ``pair`` {f, g}: whitened by the row just before,
* ``valid`` f: by the last row of its own fold,
* ``bridge`` g: across the gap that leaving out fold g opens,

and every fold's training and validation sums are sums of leaves.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramlaw.operators.gram import PLAIN, WEIGHTED, Design, GramTable, Moments
from gramlaw.operators.noise import Ar1
from gramlaw.operators.scan import HOT_ROWS, ordered_scan

ROLES = "__roles"


def pair_leaf(f, g, folds: int):
    return (f * folds + g) if f <= g else (g * folds + f)


def serial_frame(df: DataFrame, noise: Ar1, cols: list[str], fold: str, folds: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with ``ROLES``: per row its leaves, each with ``phi``, ``gain`` and the predecessor's ``cols`` there.
    ``fold`` numbers the folds from 0. Rows of a series need different steps."""
    itself = F.struct(F.col(noise.step).alias("step"), F.col(fold).cast("int").alias("fold"), *[F.col(c).cast("double").alias(c) for c in cols])
    of = [f"__of_{k}" for k in range(folds)]
    out = df.withColumn("__self", itself)
    own = {f"__in_{k}": F.when(F.col("__self.fold") == k, F.col("__self")) for k in range(folds)}
    # one scan: the row before, and the last row of each fold; all other predecessors are among them
    out = ordered_scan(out.withColumns(own), noise.series, [noise.step], previous={"__near": "__self"}, latest={o: f"__in_{k}" for k, o in enumerate(of)}, hot_rows=hot_rows)
    near = F.col("__near.fold")
    others = [F.when(near != k, F.col(o)) for k, o in enumerate(of)]
    out = out.withColumns({"__other": F.greatest(*others) if folds > 1 else others[0], "__same": F.element_at(F.array(*of), F.col("__self.fold") + 1)})
    f, g, n = F.col("__self.fold"), F.col("__near.fold"), folds

    def role(leaf, before: str):
        gap = (F.col("__self.step") - F.col(f"{before}.step")).cast("double")
        phi = F.when(gap.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(noise.rho), gap))
        gain = 1.0 / (noise.sigma * F.sqrt(1.0 - phi * phi))
        return F.struct(leaf.cast("int").alias("leaf"), phi.alias("phi"), gain.alias("gain"), *[F.col(f"{before}.{c}").alias(f"prev_{c}") for c in cols])

    alike = g.isNull() | (f == g)
    pair = F.when(alike, f * n + f).otherwise(F.least(f, g) * n + F.greatest(f, g))
    three = F.array(role(pair, "__near"), role(f + n * n, "__same"), role(g + n * n + n, "__other"))
    roles = F.when(alike, F.array(role(pair, "__near"))).otherwise(three)
    return out.withColumn(ROLES, roles).drop("__self", "__near", "__other", "__same", *of, *own)


def entered(design: Design) -> Design:
    """Every row once for each of its roles, as a lagged design over the leaves."""
    cols = [*design.features, *design.targets]
    role = F.col("__role")
    df = design.df.withColumn("__role", F.explode(ROLES))
    df = df.withColumns({"__leaf": role["leaf"], "phi": role["phi"], "gain": role["gain"], **{f"prev_{c}": role[f"prev_{c}"] for c in cols}})
    return replace(design, df=df, leaf="__leaf", lagged=True, serial=0)


def by_fold(table: GramTable, folds: int) -> GramTable:
    """The sums of leaves as those of each fold: its validation rows, its training rows, and all rows."""
    some = next(iter(table.leaves.values()))
    none = Moments(some.M * 0.0, 0, some.p, some.t)

    def total(leaves, kind: int) -> Moments:
        out = none
        for leaf in leaves:
            if (leaf, kind) in table.leaves:
                out = out + table.leaves[leaf, kind]
        return out

    every = range(folds)
    own = {k: [pair_leaf(k, k, folds), folds * folds + k] for k in every}
    pairs = {(f, g): pair_leaf(f, g, folds) for f in every for g in range(f, folds)}
    there = [k for k in every if total(own[k], PLAIN).n]
    valid = {(k, kind): total(own[k], kind) for k in there for kind in (PLAIN, WEIGHTED)}
    trained = {}
    for k in there:
        trained[k, PLAIN] = total([leaf for f in there if f != k for leaf in own[f]], PLAIN)
        without = [leaf for fg, leaf in pairs.items() if k not in fg]
        trained[k, WEIGHTED] = total([*without, folds * folds + folds + k], WEIGHTED)
    whole = {PLAIN: total([leaf for f in there for leaf in own[f]], PLAIN), WEIGHTED: total(pairs.values(), WEIGHTED)}
    return replace(table, leaves=valid, trained=trained, whole=whole)

"""Queries: noise, scores, regression, selection steps, splits, stability, probes."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from gramlaw.functions.scores import TYPE_BITS, criterion_column, ebic_bits_column, mdl_bits_column
from gramlaw.operators import catalog, qr, select
from gramlaw.operators.algebra import orthonormal_map, split_views, whole_view
from gramlaw.operators.catalog import Candidate
from gramlaw.operators.gram import PLAIN, Design, gram, profile_inputs
from gramlaw.operators.groups import groups_from_moments
from gramlaw.operators.noise import sparse_chi2, variance_weight, weight_diagnostics, whiten_ar1, whiten_blocks, whiten_diagonal
from gramlaw.operators.probe import Probe, draw_numbers, probe_median, probe_scores, probe_shifts
from gramlaw.operators.residual import residualize_columns
from gramlaw.operators.tiles import RowMatrix, tiled_gram
from gramlaw.operators.splits import exact_folds, hashed_folds, holdout
from gramlaw.plans.basis import evaluate_basis, evaluate_external, raw_moments
from gramlaw.plans.law import Law, flatten, score_array
from gramlaw.plans.options import Options
from gramlaw.plans.search import bank_for
from gramlaw.plans.stability import consensus, operator_stability
from gramlaw.queries.common import FOLD_SQL, LINE_SQL, ORACLES, ORDER_FEATURES, ORDER_SQL, folded_orders, line, orders, query, rnd, rounded, table
from gramlaw.session import shared_path

LN2 = math.log(2.0)
_W = "(CASE WHEN variance>0 THEN 1.0/greatest(variance,1e-12) ELSE 0.0 END)"

# --------------------------------------------------------------------------------------------------------------
# Noise


@query(
    "weights_diag",
    "SELECT event_id, round(CASE WHEN value-5.0>0 THEN 1.0/greatest(value-5.0,1e-12) ELSE 0.0 END,6) AS w FROM events",
)
def _(spark, sf):
    """Weights from variances; non-positive variances weigh nothing."""
    return table(spark, sf, "events").select("event_id", rnd(variance_weight(F.col("value") - 5.0)).alias("w"))


@query(
    "weight_diagnostics",
    f"WITH {ORDER_SQL} SELECT round(greatest(min({_W}),0.0),6) AS min_eig, round(max({_W}),6) AS max_eig, round(max({_W})/greatest(min({_W}),1e-16),6) AS cond FROM ord",
)
def _(spark, sf):
    return rounded(weight_diagnostics(orders(spark, sf), variance_weight(F.col("variance"))))


@query(
    "whiten_diag",
    f"WITH {LINE_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(x0*sqrt({_W}),6) AS white_x0, round(y*sqrt({_W}),6) AS white_y FROM line",
)
def _(spark, sf):
    out = whiten_diagonal(line(spark, sf), ["x0", "y"], "variance")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rnd("white_x0").alias("white_x0"), rnd("white_y").alias("white_y"))


@query(
    "ar1_whiten",
    """WITH l AS (SELECT event_id, user_id, value, lag(value) OVER w AS pv, power(0.99, event_id-lag(event_id) OVER w) AS phi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, round(CASE WHEN pv IS NULL THEN value/0.7 ELSE (value-phi*pv)/(0.7*sqrt(1.0-phi*phi)) END,5) AS white_value FROM l""",
)
def _(spark, sf):
    """AR(1) whitening on an irregular grid: the correlation decays with the gap to the previous observation."""
    out = whiten_ar1(table(spark, sf, "events").select("event_id", "user_id", "value"), "user_id", "event_id", ["value"], 0.99, 0.7)
    return out.select("event_id", rnd("white_value", 5).alias("white_value"))


@query(
    "block_whiten",
    f"""WITH {ORDER_SQL}, p AS (SELECT id//2 AS block, id%2 AS pos, y, id FROM ord),
q AS (SELECT block, max(CASE WHEN pos=0 THEN y END) AS y0, max(CASE WHEN pos=1 THEN y END) AS y1, count(*) AS c, 1.0+block%3 AS a, 2.0+block%2 AS b FROM p GROUP BY block),
l AS (SELECT *, a*b-0.25 AS det FROM q), m AS (SELECT *, sqrt(b/det) AS l11, -0.5/det/sqrt(b/det) AS l21 FROM l)
SELECT p.block, p.pos, round(CASE WHEN m.c=1 THEN p.y/sqrt(CASE WHEN p.pos=0 THEN m.a ELSE m.b END) WHEN p.pos=0 THEN l11*y0+l21*y1 ELSE sqrt(a/det-l21*l21)*y1 END,6) AS white_y FROM p JOIN m USING (block)""",
)
def _(spark, sf):
    """Joint whitening within blocks of correlated rows."""
    rows = orders(spark, sf).select(F.expr("id div 2").alias("block"), (F.col("id") % 2).alias("pos"), "y")
    blocks = rows.select("block").distinct()
    a, b = F.col("block") % 3 + 1.0, F.col("block") % 2 + 2.0
    entry = lambda i, j, v: F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), v.alias("v"))
    cells = F.array(entry(0, 0, a), entry(0, 1, F.lit(0.5)), entry(1, 0, F.lit(0.5)), entry(1, 1, b))
    sigma = blocks.select("block", F.inline(cells))
    return rounded(whiten_blocks(rows, "block", "pos", ["y"], sigma))


@query(
    "sparse_chi2",
    f"""WITH {ORDER_SQL}, r AS (SELECT id, y-0.4 AS r FROM ord), w AS (SELECT id AS i, id AS j, 1.25 AS w FROM r UNION ALL SELECT id, id+1, -0.5 FROM r UNION ALL SELECT id+1, id, -0.5 FROM r)
SELECT round(sum(w.w*a.r*b.r)/count(DISTINCT a.id),6) AS chi2_per_row FROM w JOIN r a ON a.id=w.i JOIN r b ON b.id=w.j""",
)
def _(spark, sf):
    """Quadratic form with a sparse precision table."""
    r = orders(spark, sf).select("id", (F.col("y") - 0.4).alias("r"))
    cell = lambda i, j, w: F.struct(i.alias("i"), j.alias("j"), F.lit(w).alias("w"))
    k = F.col("id")
    cells = F.array(cell(k, k, 1.25), cell(k, k + 1, -0.5), cell(k + 1, k, -0.5))
    chi = sparse_chi2(r, "id", "r", r.select(F.inline(cells)))
    n = r.count()
    return chi.select(rnd(F.col("chi2") / n).alias("chi2_per_row"))


# --------------------------------------------------------------------------------------------------------------
# Scores

_HAT = "(0.2+0.5*x0+0.4*x2)"


def _with_hat(spark, sf):
    return orders(spark, sf).withColumn("yhat", F.col("x0") * 0.5 + F.col("x2") * 0.4 + 0.2)


@query(
    "r2_scores",
    f"""WITH {ORDER_SQL}, w AS (SELECT *, {_HAT} AS yhat, {_W} AS w FROM ord), m AS (SELECT avg(y) AS my, sum(w*y)/(sum(w)+1e-12) AS wy FROM w)
SELECT round(1-sum((y-yhat)*(y-yhat))/(sum((y-my)*(y-my))+1e-12),6) AS r2, round(1-sum(w*(y-yhat)*(y-yhat))/(sum(w*(y-wy)*(y-wy))+1e-12),6) AS r2_gls,
 round(avg((y-yhat)*(y-yhat)),6) AS mse, round(sum(w*(y-yhat)*(y-yhat))/count(*),6) AS chi2_per_row FROM w, m""",
)
def _(spark, sf):
    """R², weighted R², mean square error and χ², from one aggregation of sums."""
    w, y, r = variance_weight(F.col("variance")), F.col("y"), F.col("y") - F.col("yhat")
    s = _with_hat(spark, sf).agg(
        F.count("*").alias("n"), F.var_pop(y).alias("v"), F.sum(r * r).alias("sse"), F.sum(w * r * r).alias("chi2"),
        F.sum(w).alias("sw"), F.sum(w * y).alias("swy"), F.sum(w * y * y).alias("swyy"),
    )
    mean = F.col("swy") / (F.col("sw") + 1e-12)
    around = F.col("swyy") - mean * F.col("swy") * 2.0 + mean * mean * F.col("sw")
    return rounded(
        s.select(
            (1.0 - F.col("sse") / (F.col("v") * F.col("n") + 1e-12)).alias("r2"),
            (1.0 - F.col("chi2") / (around + 1e-12)).alias("r2_gls"),
            (F.col("sse") / F.col("n")).alias("mse"),
            (F.col("chi2") / F.col("n")).alias("chi2_per_row"),
        )
    )


_CRIT = "n*ln({r}/greatest(1,n)+1e-9)"
_C0, _C1 = _CRIT.format(r="r0"), _CRIT.format(r="r1")


@query(
    "criteria",
    f"""WITH {ORDER_SQL}, m AS (SELECT avg(y) AS my FROM ord), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum((y-{_HAT})*(y-{_HAT})) AS r1, sum((y-my)*(y-my)) AS r0 FROM ord, m)
SELECT round({_C1}+6.0+24.0/(n-4.0),4) AS aicc, round({_C1}+3*ln(n+1e-9),4) AS bic, round({_C1}+1.25*6.25,4) AS mdl,
 round((({_C0}+1*ln(n+1e-9))-({_C1}+3*ln(n+1e-9)))/ln(2.0),4) AS delta_bits, round((({_C0}+1*ln(n+1e-9))-({_C1}+3*ln(n+1e-9)))/(2*ln(2.0)),4) AS half_bits,
 round(-(n*ln(greatest(r1/n,1e-300))+ln(n)*3+2*0.25*3*ln(40.0))/ln(2.0),4) AS ebic_bits FROM s""",
)
def _(spark, sf):
    """AICc, BIC, MDL, evidence differences in both bit conventions, and EBIC bits."""
    y, r = F.col("y"), F.col("y") - F.col("yhat")
    s = _with_hat(spark, sf).agg(F.count("*").cast("double").alias("n"), F.sum(r * r).alias("r1"), (F.var_pop(y) * F.count("*")).alias("r0"))
    n = F.col("n")
    c = lambda rss, k, which, **kw: criterion_column(F.col(rss), n, k, which, **kw)
    change = c("r0", 1, "BIC") - c("r1", 3, "BIC")
    return rounded(
        s.select(
            c("r1", 3, "AICc").alias("aicc"),
            c("r1", 3, "BIC").alias("bic"),
            c("r1", 3, "MDL", bits=6.25, bit_weight=1.25).alias("mdl"),
            (change / LN2).alias("delta_bits"),
            (change / (2 * LN2)).alias("half_bits"),
            ebic_bits_column(F.col("r1"), n, 3, 40, 0.25).alias("ebic_bits"),
        ),
        4,
    )


_KINDS = [*TYPE_BITS, "unlisted"]


@query(
    "mdl_bits",
    "SELECT p_partkey, "
    + "CASE p_partkey%13 " + " ".join(f"WHEN {k} THEN {TYPE_BITS.get(v, 8.0)}" for k, v in enumerate(_KINDS)) + " END + 0.75*(p_partkey%5) + 1.5*p_size AS bits FROM part",
)
def _(spark, sf):
    """Description length by kind, columns and real parameters."""
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("p_partkey") % 13 + 1).cast("int"))
    bits = mdl_bits_column(kind, F.col("p_size"), F.col("p_partkey") % 5)
    return table(spark, sf, "part").select("p_partkey", bits.alias("bits"))


@query(
    "weighted_mean_std",
    f"""WITH {ORDER_SQL}, w AS (SELECT *, {_W} AS w FROM ord), m AS (SELECT """
    + ", ".join(f"sum(w*x{j})/(sum(w)+1e-12) AS m{j}" for j in range(4))
    + " FROM w) " + " UNION ALL ".join(f"SELECT 'x{j}' AS name, round(max(m{j}),6) AS mean, round(sqrt(greatest(sum(w*(x{j}-m{j})*(x{j}-m{j}))/(sum(w)+1e-12),1e-12)),6) AS sd FROM w, m" for j in range(4)),
)
def _(spark, sf):
    """Weighted means and deviations from the weighted moments."""
    df = orders(spark, sf).withColumn("w", variance_weight(F.col("variance")))
    K, _ = raw_moments(Design(df, ORDER_FEATURES, ["y"], weight="w"))
    mu = K[0, 1:5] / (K[0, 0] + 1e-12)
    var = (np.diag(K)[1:5] - 2 * mu * K[0, 1:5] + mu**2 * K[0, 0]) / (K[0, 0] + 1e-12)
    rows = [(f"x{j}", float(mu[j]), float(math.sqrt(max(var[j], 1e-12)))) for j in range(4)]
    return rounded(spark.createDataFrame(rows, "name string, mean double, sd double"))


# --------------------------------------------------------------------------------------------------------------
# Regression


def _centred_sql(w: str, source: str, cols: list[str]) -> str:
    means = ", ".join(f"sum({w}*{c})/(sum({w})+1e-12) AS m_{c}" for c in cols)
    pairs = [(a, b) for k, a in enumerate(cols) for b in cols[k:]]
    sums = ", ".join(f"sum({w}*({a}-m_{a})*({b}-m_{b})) AS s_{a}_{b}" for a, b in pairs)
    return f"mm AS (SELECT {means} FROM {source}), ss AS (SELECT {sums}, " + ", ".join(f"max(m_{c}) AS m_{c}" for c in cols) + f" FROM {source}, mm)"


@query(
    "ridge_1d",
    f"WITH {ORDER_SQL}, {_centred_sql('1.0', 'ord', ['x0', 'y'])}, f AS (SELECT s_x0_y/(s_x0_x0+0.001) AS w, m_y-m_x0*s_x0_y/(s_x0_x0+0.001) AS b0 FROM ss) SELECT id, round(b0+w*x0,6) AS yhat FROM ord, f",
)
def _(spark, sf):
    """One-input ridge with a free intercept, scored over the table."""
    from gramlaw.operators.algebra import ridge

    df = orders(spark, sf)
    K, _ = raw_moments(Design(df, ["x0"], ["y"]))
    w, b0 = ridge(K, 1e-3)
    law = Law(b0, ((float(w[0]), Candidate("x", "unary", {"f": "x", "i": 0})),), ("x0",))
    return law.score(df).select("id", rnd("yhat").alias("yhat"))


@query(
    "ridge_offset",
    f"WITH {ORDER_SQL}, far AS (SELECT x0, y+100000000.0 AS y FROM ord), {_centred_sql('1.0', 'far', ['x0', 'y'])} SELECT round(s_x0_y/(s_x0_x0+0.001),6) AS w, round(m_y-m_x0*s_x0_y/(s_x0_x0+0.001),3) AS b0, round((s_y_y-2*s_x0_y*s_x0_y/(s_x0_x0+0.001)+s_x0_x0*s_x0_y*s_x0_y/((s_x0_x0+0.001)*(s_x0_x0+0.001)))/s_y_y,6) AS unexplained FROM ss",
)
def _(spark, sf):
    """One-input ridge of a target that stands far from zero: its origin is taken off before any sum."""
    from gramlaw.operators.algebra import residual_square, ridge, small, total_square, whole_view

    design = Design(orders(spark, sf).withColumn("y", F.col("y") + 1e8), ["x0"], ["y"])
    origin, prof = profile_inputs(design).about_means()
    view = whole_view(gram(replace(design, origin=origin), [Candidate("x", "unary", {"f": "x", "i": 0})], prof))
    K = small(view.tr_plain, view.raw(0)[None, :], view.y)
    w, b0 = ridge(K, 1e-3)
    row = (float(w[0]), b0 + origin[0], residual_square(K, w, b0) / total_square(K))
    out = spark.createDataFrame([row], "w double, b0 double, unexplained double")
    return out.select(rnd("w").alias("w"), rnd("b0", 3).alias("b0"), rnd("unexplained").alias("unexplained"))


@query(
    "ridge_2d_weighted",
    f"WITH {ORDER_SQL}, {_centred_sql(_W, 'ord', ['x0', 'x2', 'y'])}, d AS (SELECT *, (s_x0_x0+0.001)*(s_x2_x2+0.001)-s_x0_x2*s_x0_x2 AS det FROM ss), f AS (SELECT ((s_x2_x2+0.001)*s_x0_y-s_x0_x2*s_x2_y)/det AS w0, ((s_x0_x0+0.001)*s_x2_y-s_x0_x2*s_x0_y)/det AS w1, m_y, m_x0, m_x2 FROM d) SELECT round(w0,6) AS w0, round(w1,6) AS w1, round(m_y-m_x0*w0-m_x2*w1,6) AS b0 FROM f",
)
def _(spark, sf):
    """Two-input ridge in the noise geometry."""
    from gramlaw.operators.algebra import ridge

    df = orders(spark, sf).withColumn("w", variance_weight(F.col("variance")))
    K, _ = raw_moments(Design(df, ["x0", "x2"], ["y"], weight="w"))
    w, b0 = ridge(K, 1e-3)
    return rounded(spark.createDataFrame([(float(w[0]), float(w[1]), b0)], "w0 double, w1 double, b0 double"))


def _rdmp(name, weight_sql, weighted):
    sql = f"WITH {ORDER_SQL}, g AS (SELECT sum({weight_sql}*x0*x2)/(sum({weight_sql}*x0*x0)+0.0001) AS g FROM ord) SELECT id, round(x2-g*x0,6) AS res_x2 FROM ord, g"

    @query(name, sql)
    def run(spark, sf):
        """Residualize a column on another."""
        df = orders(spark, sf).withColumn("w", variance_weight(F.col("variance")))
        return residualize_columns(df, ["x0"], ["x2"], 1e-4, "w" if weighted else None).select("id", rnd("res_x2").alias("res_x2"))

    return run


_rdmp("residualize_gls", _W, True)
_rdmp("residualize_ols", "1.0", False)


@query(
    "basis_comparison",
    f"""WITH {ORDER_SQL}, {_centred_sql(_W, 'ord', ['x0', 'y'])}, f AS (SELECT s_x0_y/(s_x0_x0+0.002) AS w, s_y_y AS c0, s_y_y-2*s_x0_y/(s_x0_x0+0.002)*s_x0_y+power(s_x0_y/(s_x0_x0+0.002),2)*s_x0_x0 AS c1, (SELECT CAST(count(*) AS DOUBLE) FROM ord) AS n FROM ss),
b AS (SELECT *, n*ln(c0/n+1e-9) AS l0, n*ln(c1/n+1e-9) AS l1 FROM f)
SELECT 'intercept' AS model, 1 AS k, round(l0+2+4.0/(n-2),4) AS aicc, round(l0+ln(n+1e-9),4) AS bic, round(l0,4) AS mdl, CAST(NULL AS DOUBLE) AS delta_bic_bits, CAST(NULL AS DOUBLE) AS delta_mdl_bits, CAST(NULL AS DOUBLE) AS half_bits FROM b
UNION ALL SELECT 'basis', 2, round(l1+4+12.0/(n-3),4), round(l1+2*ln(n+1e-9),4), round(l1,4), round((l0-l1-ln(n+1e-9))/ln(2.0),4), round((l0-l1)/ln(2.0),4), round((l0-l1-ln(n+1e-9))/(2*ln(2.0)),4) FROM b""",
)
def _(spark, sf):
    """A given basis against the intercept under a noise model."""
    return rounded(evaluate_basis(Design(orders(spark, sf), ["x0"], ["y"]), 2e-3, "variance").comparison(spark), 4)


@query(
    "basis_checks",
    f"""WITH {ORDER_SQL}, {_centred_sql(_W, 'ord', ['x0', 'y'])}, f AS (SELECT s_x0_y/(s_x0_x0+0.002) AS w, m_y-m_x0*s_x0_y/(s_x0_x0+0.002) AS b0 FROM ss)
SELECT round(stddev_pop((y-b0-w*x0)/sqrt(variance)),6) AS white_std, round(max(variance)/min(variance),6) AS cond, round(max(w),6) AS amplitude FROM ord, f""",
)
def _(spark, sf):
    """Noise calibration: deviation of the whitened residual, conditioning, amplitude."""
    fit = evaluate_basis(Design(orders(spark, sf), ["x0"], ["y"]), 2e-3, "variance")
    return rounded(spark.createDataFrame([(fit.checks["white_std"], fit.checks["cond"], float(fit.weights[0]))], "white_std double, cond double, amplitude double"))


@query("external_basis")
def _(spark, sf):
    """A basis table, a target table and covariance entries, matched by row, checked and compared."""
    df = orders(spark, sf)
    row = F.col("id").cast("long").alias("i")
    sigma = df.select(row, F.col("id").cast("long").alias("j"), F.col("variance").alias("v"))
    fit = evaluate_external(df.select(row, F.col("x0").alias("b0")), df.select(row, "y"), sigma, 1)
    return rounded(fit.comparison(spark), 4)


ORACLES["external_basis"] = ORACLES["basis_comparison"]

_UV = [("one", "one"), ("one", "x0"), ("one", "y"), ("x0", "x0"), ("x0", "y"), ("y", "y")]


@query(
    "external_basis_blocks",
    f"""WITH {ORDER_SQL}, u AS (SELECT id, 1.0 AS one, x0, y, id//8 AS block, id%8 AS part, 1.0+(id%5)*0.25 AS d FROM ord),
single AS (SELECT {", ".join(f"sum({a}*{b}/d) AS {a}_{b}" for a, b in _UV)} FROM u WHERE part IN (1, 2)),
each AS (SELECT block, count(*) AS m, {", ".join(f"sum({a}) AS s_{a}" for a in ("one", "x0", "y"))}, {", ".join(f"sum({a}*{b}) AS q_{a}_{b}" for a, b in _UV)} FROM u WHERE part NOT IN (1, 2, 3) GROUP BY block),
equal AS (SELECT {", ".join(f"sum((q_{a}_{b}-0.4/(1.0+(m-1)*0.4)*s_{a}*s_{b})/(1.5*0.6)) AS {a}_{b}" for a, b in _UV)} FROM each),
star AS (SELECT *, id=min(id) OVER () AS hub, 0.5/sqrt(count(*) OVER ()) AS link FROM u WHERE part=3),
leaves AS (SELECT {", ".join(f"sum(CASE WHEN hub THEN 0.0 ELSE {a}*{b}/d END) AS q_{a}_{b}" for a, b in _UV)}, {", ".join(f"sum(CASE WHEN hub THEN {a} ELSE -link*{a}/d END) AS h_{a}" for a in ("one", "x0", "y"))}, 2.0-sum(CASE WHEN hub THEN 0.0 ELSE link*link/d END) AS rest FROM star),
k AS (SELECT {", ".join(f"single.{a}_{b}+equal.{a}_{b}+q_{a}_{b}+h_{a}*h_{b}/rest AS {a}_{b}" for a, b in _UV)}, (SELECT CAST(count(*) AS DOUBLE) FROM ord) AS n FROM single, equal, leaves),
ss AS (SELECT n, x0_x0-one_x0*one_x0/one_one AS xx, x0_y-one_x0*one_y/one_one AS xy, y_y-one_y*one_y/one_one AS yy FROM k),
f AS (SELECT n, yy AS c0, yy-2*xy/(xx+0.002)*xy+power(xy/(xx+0.002),2)*xx AS c1 FROM ss),
b AS (SELECT n, n*ln(c0/n+1e-9) AS l0, n*ln(c1/n+1e-9) AS l1 FROM f)
SELECT 'intercept' AS model, 1 AS k, round(l0+2+4.0/(n-2),3) AS aicc, round(l0+ln(n+1e-9),3) AS bic, round(l0,3) AS mdl, CAST(NULL AS DOUBLE) AS delta_bic_bits, CAST(NULL AS DOUBLE) AS delta_mdl_bits, CAST(NULL AS DOUBLE) AS half_bits FROM b
UNION ALL SELECT 'basis', 2, round(l1+4+12.0/(n-3),3), round(l1+2*ln(n+1e-9),3), round(l1,3), round((l0-l1-ln(n+1e-9))/ln(2.0),3), round((l0-l1)/ln(2.0),3), round((l0-l1-ln(n+1e-9))/(2*ln(2.0)),3) FROM b""",
)
def _(spark, sf):
    """A basis under a covariance of three kinds of blocks: single rows, rows of equal correlation, and one large block in
    which every row is linked with the first."""
    df = orders(spark, sf).select(F.col("id").cast("long").alias("i"), "x0", "y")
    block, part, d = F.expr("i div 8"), F.col("i") % 8, F.col("i") % 5 * 0.25 + 1.0
    hub, many = df.where(part == 3).agg(F.min("i"), F.count("*")).first()
    grouped = ~part.isin(1, 2, 3)
    own = F.when(grouped, 1.5).when(F.col("i") == hub, 2.0).otherwise(d)
    diagonal = df.select("i", F.col("i").alias("j"), own.alias("v"))
    near = df.where(grouped).select(block.alias("block"), "i")
    equal = near.join(near.withColumnRenamed("i", "j"), "block").where("i != j").select("i", "j", F.lit(0.6).alias("v"))  # five rows a block
    links = F.array(*[F.struct(a.alias("i"), b.alias("j")) for a, b in ((F.lit(hub), F.col("i")), (F.col("i"), F.lit(hub)))])
    star = df.where((part == 3) & (F.col("i") != hub)).select(F.inline(links)).withColumn("v", F.lit(0.5 / math.sqrt(many)))
    sigma = diagonal.unionByName(equal).unionByName(star)
    fit = evaluate_external(df.select("i", F.col("x0").alias("b0")), df.select("i", "y"), sigma, 1, max_block=64)
    return rounded(fit.comparison(spark), 3)


_TILED = {"one": "1.0", "a": "x0", "b": "x1", "c": "x0*x0", "d": "sin(x1)", "e": "x2*x2", "f": "sin(x3)", "y": "y"}
_TILED_PAIRS = [(u, v) for k, u in enumerate(_TILED) for v in list(_TILED)[k:]]


@query(
    "tiled_sums",
    f"WITH {ORDER_SQL}, {FOLD_SQL} SELECT CAST(fold AS INTEGER) AS fold, {', '.join(f'round(avg(({_TILED[u]})*({_TILED[v]})),6) AS {u}_{v}' for u, v in _TILED_PAIRS)} FROM folded GROUP BY fold",
)
def _(spark, sf):
    """Cross moments of each fold from a Gram kept as a table of tiles."""
    design = Design(folded_orders(spark, sf), ORDER_FEATURES, ["y"], leaf="fold")
    unary = lambda f, i: Candidate(f"{f}[x{i}]", "unary", {"f": f, "i": i})
    g = tiled_gram(design, [unary("x", 0), unary("x", 1), unary("x^2", 0), unary("sin", 1), unary("x^2", 2), unary("sin", 3)], width=3)
    shift, factor = np.concatenate([[0.0], -g.centre / g.scale]), np.concatenate([[1.0], g.scale])
    rows = []
    for k, n in sorted(g.counts.items()):
        M = RowMatrix(g, [k], PLAIN, np.arange(g.P), shift, factor)
        at = {u: i for i, u in enumerate(_TILED)}
        rows.append((k, *[float(M[at[u], at[v]] / n) for u, v in _TILED_PAIRS]))
    return rounded(spark.createDataFrame(rows, "fold int, " + ", ".join(f"{u}_{v} double" for u, v in _TILED_PAIRS)))


@query(
    "superfeatures_near_equal",
    f"""WITH {ORDER_SQL}, u AS (SELECT id, x0 AS a, x0+x2/4096.0 AS b, {_W} AS w FROM ord), g AS (SELECT sum(w*a*a) AS aa, sum(w*a*b) AS ab FROM u),
r AS (SELECT id, a/sqrt(aa) AS q0, w, b-a-(ab-aa)/aa*a AS r FROM u, g), r2 AS (SELECT id, q0, w, r-q0*(SELECT sum(w*q0*r) FROM r) AS r FROM r)
SELECT id, round(1000*q0,3) AS s0, round(1000*r/sqrt((SELECT sum(w*r*r) FROM r2)),3) AS s1 FROM r2""",
)
def _(spark, sf):
    """Orthonormal export of two columns that agree in three digits, by a tree of QR factors (times 1000)."""
    df = orders(spark, sf).select("id", F.col("x0").alias("a"), (F.col("x0") + F.col("x2") / 4096.0).alias("b"), variance_weight(F.col("variance")).alias("w"))
    out, _ = qr.superfeatures(df, ["a", "b"], F.col("w"))
    return out.select("id", rnd(F.col("s0") * 1000, 3).alias("s0"), rnd(F.col("s1") * 1000, 3).alias("s1"))


_INPUT_PAIRS = [(i, j) for i in range(4) for j in range(i + 1, 4)]


@query(
    "fold_pairs",
    f"""WITH {ORDER_SQL}, {FOLD_SQL}, c AS (SELECT k AS fold, {", ".join(f"corr(x{i},x{j})*count(*)/(count(*)-1.0) AS c{i}{j}" for i, j in _INPUT_PAIRS)} FROM folded, (SELECT unnest(range(5)) AS k) WHERE fold<>k GROUP BY k),
p AS ({" UNION ALL ".join(f"SELECT fold, {i} AS i, {j} AS j, c{i}{j} AS corr FROM c" for i, j in _INPUT_PAIRS)})
SELECT CAST(fold AS INTEGER) AS fold, i, j, round(corr,6) AS corr, row_number() OVER (PARTITION BY fold ORDER BY abs(corr) DESC)=1 AS projected FROM p""",
)
def _(spark, sf):
    """Correlations of the inputs over each fold's training rows, and the pair whose axes its bank projects on."""
    prof = profile_inputs(Design(folded_orders(spark, sf), ORDER_FEATURES, ["y"], leaf="fold"))
    rows = []
    for k in range(5):
        corr = prof.training(k).corr(4)
        own = {n for n in (c.name for c in bank_for(prof.training(k), 4, Options())) if "(proj[ei:" in n or "(proj[ej:" in n}
        rows += [(k, i, j, float(corr[i, j]), f"hsml:x(proj[ei:{i}])" in own and f"hsml:x(proj[ej:{j}])" in own) for i, j in _INPUT_PAIRS]
    return rounded(spark.createDataFrame(rows, "fold int, i int, j int, corr double, projected boolean"))


@query(
    "superfeatures",
    f"WITH {ORDER_SQL}, g AS (SELECT sum({_W}*x0*x0) AS a, sum({_W}*x0*x2) AS b, sum({_W}*x2*x2) AS c FROM ord) SELECT id, round(1000*x0/sqrt(a),6) AS s0, round(1000*(x2-b/a*x0)/sqrt(c-b*b/a),6) AS s1 FROM ord, g",
)
def _(spark, sf):
    """Orthonormal export in the noise geometry, applied to every row (times 1000)."""
    df = orders(spark, sf).withColumn("w", variance_weight(F.col("variance")))
    K, _ = raw_moments(Design(df, ["x0", "x2"], ["y"], weight="w"))
    T = orthonormal_map(K[1:3, 1:3])
    cols = [F.col("x0"), F.col("x2")]
    return df.select("id", *[rnd(catalog.dot((T[:, k] * 1000).tolist(), cols)).alias(f"s{k}") for k in range(2)])


# --------------------------------------------------------------------------------------------------------------
# Selection steps

_FEW = [Candidate(f"{f}[x{i}]", "unary", {"f": f, "i": i}) for f in ("x", "x^2", "sin", "tanh") for i in range(4)]
_FEW += [Candidate("hsml2:(x1*x2)", "hsml_binary", {"op": "*", "w1": [0.0, 1.0, 0.0, 0.0], "w2": [0.0, 0.0, 1.0, 0.0]})]


def _std_values(cands, where="1=1", cte=""):
    """CTEs: raw candidate values ``v0…`` and their standardised form ``z0…`` (population moments of the ``where`` rows)."""
    raw = "v AS (SELECT *, " + ", ".join(f"{catalog.sql(c, ORDER_FEATURES)} AS v{k}" for k, c in enumerate(cands)) + f" FROM {cte or 'ord'})"
    mom = "vm AS (SELECT " + ", ".join(f"avg(v{k}) AS a{k}, stddev_pop(v{k}) AS d{k}" for k in range(len(cands))) + f" FROM v WHERE {where})"
    std = "z AS (SELECT v.*, " + ", ".join(f"(v{k}-a{k})/d{k} AS z{k}" for k in range(len(cands))) + " FROM v, vm)"
    return f"{raw}, {mom}, {std}"


@query(
    "first_operator",
    f"WITH {ORDER_SQL}, {_std_values(_FEW)}, m AS (SELECT sum({_W}*y)/sum({_W}) AS mu, CAST(count(*) AS DOUBLE) AS n FROM z), r AS (SELECT max(n) AS n, sum({_W}*(y-mu)*(y-mu)) AS rss0, "
    + ", ".join(f"power(sum({_W}*z{k}*(y-mu)),2)/sum({_W}*z{k}*z{k}) AS g{k}" for k in range(len(_FEW)))
    + " FROM z, m) " + " UNION ALL ".join(f"SELECT '{c.name}' AS name, round((n*ln(rss0/n)+ln(n)-n*ln((rss0-g{k})/n)-2*ln(n))/ln(2.0),4) AS gain_bits FROM r" for k, c in enumerate(_FEW)),
)
def _(spark, sf):
    """Evidence gain of every candidate at the first step, in the noise geometry."""
    df = orders(spark, sf).withColumn("w", variance_weight(F.col("variance")))
    view = whole_view(gram(Design(df, ORDER_FEATURES, ["y"], weight="w"), _FEW))
    rows = []
    for j, c in enumerate(_FEW):
        only = np.zeros(len(_FEW), bool)
        only[j] = True
        opt = Options(bits_threshold=-1e18, ebic_gamma=0.0)
        _, _, path, _, _ = select.greedy_operators(view.tr, view.n_tr, only, opt, limit=1)
        n, rss0, rss1 = view.n_tr, path[0], path[-1] if len(path) > 1 else None
        if rss1 is None:
            norm = view.tr[1 + j, 1 + j]
            b = view.tr[1 + j, -1] - view.tr[0, -1] / view.tr[0, 0] * view.tr[1 + j, 0]
            rss1 = rss0 - b * b / norm
        rows.append((c.name, (n * math.log(rss0 / n) - n * math.log(rss1 / n) - math.log(n)) / LN2))
    return rounded(spark.createDataFrame(rows, "name string, gain_bits double"), 4)


_TWO = [_FEW[0], _FEW[2], _FEW[16]]
_P2 = [(a, b) for a in range(3) for b in range(3)]


@query(
    "operator_pair",
    f"WITH {ORDER_SQL}, {_std_values(_TWO)}, m AS (SELECT avg(y) AS mu, CAST(count(*) AS DOUBLE) AS n FROM z), s AS (SELECT max(n) AS n, sum((y-mu)*(y-mu)) AS rss0, "
    + ", ".join(f"sum(z{k}*(y-mu)) AS b{k}" for k in range(3)) + ", " + ", ".join(f"sum(z{a}*z{b}) AS g{a}{b}" for a, b in _P2) + " FROM z, m), one AS ("
    + " UNION ALL ".join(f"SELECT {k} AS j, '{c.name}' AS name, n, rss0-b{k}*b{k}/g{k}{k} AS rss, rss0 FROM s" for k, c in enumerate(_TWO))
    + "), first AS (SELECT * FROM one ORDER BY rss LIMIT 1), two AS ("
    + " UNION ALL ".join(
        f"SELECT {a} AS i, {b} AS j, '{_TWO[b].name}' AS name, rss0-b{a}*b{a}/g{a}{a}-power(b{b}-g{a}{b}*b{a}/g{a}{a},2)/(g{b}{b}-g{a}{b}*g{a}{b}/g{a}{a}) AS rss FROM s"
        for a, b in _P2 if a != b
    )
    + "), second AS (SELECT two.name, two.rss, first.n, first.rss AS before FROM two, first WHERE two.i=first.j ORDER BY two.rss LIMIT 1) "
    "SELECT 1 AS sel_rank, name, round((n*ln(rss0/n)-n*ln(rss/n)-ln(n))/ln(2.0),4) AS bits FROM first UNION ALL SELECT 2, name, round((n*ln(before/n)-n*ln(rss/n)-ln(n))/ln(2.0),4) FROM second",
)
def _(spark, sf):
    """First two picks of the greedy evidence search and their gains."""
    view = whole_view(gram(Design(orders(spark, sf), ORDER_FEATURES, ["y"]), _TWO))
    og = select.operator_set(view, [c.name for c in _TWO], Options(max_ops=2, bits_threshold=0.6, ebic_gamma=0.0))
    return rounded(spark.createDataFrame([(o.rank, o.name, o.bits) for o in og.ops], "sel_rank int, name string, bits double"), 4)


_NV = "count(*) FILTER (WHERE fold=0)"


@query(
    "first_atom",
    f"WITH {ORDER_SQL}, {FOLD_SQL}, {_std_values(_FEW, 'fold<>0', 'folded')}, m AS (SELECT avg(y) AS mu FROM z WHERE fold<>0), w AS (SELECT max(mu) AS mu, "
    + ", ".join(f"sum(z{k}*(y-mu))/(sum(z{k}*z{k})+0.001) AS w{k}" for k in range(len(_FEW)))
    + " FROM z, m WHERE fold<>0), e AS (SELECT CAST(count(*) AS DOUBLE) AS n, " + ", ".join(f"sum(power(y-mu-w{k}*z{k},2)) AS e{k}" for k in range(len(_FEW)))
    + " FROM z, w WHERE fold=0) " + " UNION ALL ".join(f"SELECT '{c.name}' AS name, round(n*ln(e{k}/n+1e-9)+1.25*4.75,4) AS score FROM e" for k, c in enumerate(_FEW)),
)
def _(spark, sf):
    """Validation description length of every candidate as the first atom."""
    g = gram(Design(folded_orders(spark, sf), ORDER_FEATURES, ["y"], leaf="fold"), _FEW)
    view = dict(split_views(g))[0]
    rows = []
    for j, c in enumerate(_FEW):
        one = select.Options().patched(max_atoms=1)
        _, _, chi2, _ = select.fit_with(view, np.array([view.unit(j)]), one)
        rows.append((c.name, select.criterion(chi2, view.n_va, 2, "MDL", select.mdl_bits("atomic", 0, 1), one.bit_weight)))
    return rounded(spark.createDataFrame(rows, "name string, score double"), 4)


_GROUP_CTE = ORDER_SQL + ", six AS (SELECT *, x0+0.001*x1 AS x4, -x0+0.002*x2 AS x5 FROM ord)"
_G2 = [(i, j) for i in range(6) for j in range(i + 1, 6)]


@query(
    "discover_groups",
    f"WITH {_GROUP_CTE}, p AS (" + " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, abs(corr(x{i},x{j})*count(*)/(count(*)-1.0)) AS r, var_pop(x{i}) AS vi, var_pop(x{j}) AS vj FROM six" for i, j in _G2
    ) + """), perm AS (SELECT 'perm' AS kind, i||','||string_agg(CAST(j AS VARCHAR), ',' ORDER BY j) AS members FROM p WHERE r>=0.98 AND i=0 GROUP BY i HAVING count(*)>=2),
rot AS (SELECT 'rot' AS kind, i||','||j AS members FROM p WHERE r<0.1 AND abs(vi-vj)/(0.5*(vi+vj))<0.1 ORDER BY i, j LIMIT 12)
SELECT 'sign' AS kind, '0,1,2,3,4,5' AS members UNION ALL SELECT * FROM perm UNION ALL SELECT * FROM rot""",
)
def _(spark, sf):
    """Symmetry groups from correlations and variances."""
    df = orders(spark, sf).withColumns({"x4": F.col("x0") + F.col("x1") * 0.001, "x5": F.col("x2") * 0.002 - F.col("x0")})
    prof = profile_inputs(Design(df, [f"x{j}" for j in range(6)], ["y"]))
    spec = groups_from_moments(prof.corr(6), prof.variances(6))
    groups = [("sign", g) for g in spec.sign_groups] + [("perm", g) for g in spec.perm_groups] + [("rot", g) for g in spec.rot2d_pairs]
    return spark.createDataFrame([(k, ",".join(map(str, g))) for k, g in groups], "kind string, members string")


# --------------------------------------------------------------------------------------------------------------
# Splits and stability


@query("kfold_md5", f"WITH {ORDER_SQL}, {FOLD_SQL} SELECT id, fold FROM folded")
def _(spark, sf):
    """Exact folds in hash order, found by rank thresholds."""
    return folded_orders(spark, sf).select("id", "fold")


_RANK7 = "ranked AS (SELECT *, row_number() OVER (ORDER BY substr(md5(CAST(id AS VARCHAR)||':7'),1,15), id) AS rk, count(*) OVER () AS n FROM ord)"


@query(
    "kfold_larger_first",
    f"WITH {ORDER_SQL}, {_RANK7} SELECT id, CASE WHEN rk<=(n+6)//7 THEN 0 WHEN rk<=(n+6)//7+(n+5)//7 THEN 1 WHEN rk<=(n+6)//7+(n+5)//7+(n+4)//7 THEN 2 WHEN rk<=(n+6)//7+(n+5)//7+(n+4)//7+(n+3)//7 THEN 3 WHEN rk<=n-(n+1)//7-n//7 THEN 4 WHEN rk<=n-n//7 THEN 5 ELSE 6 END AS fold FROM ranked",
)
def _(spark, sf):
    """Seven folds whose surplus rows go to the first folds."""
    return exact_folds(orders(spark, sf), "id", 7, 7, larger_last=False).select("id", "fold")


@query("kfold_hash")
def _(spark, sf):
    """Hash folds: sizes per fold, no extra pass over the keys."""
    return hashed_folds(orders(spark, sf), "id", 5, 1337).groupBy("fold").agg(F.count("*").alias("n"))


@query(
    "holdout",
    f"WITH {ORDER_SQL}, {_RANK7} SELECT id, rk<=greatest(1,CAST(round_even(0.2*n,0) AS BIGINT)) AS is_val FROM ranked",
)
def _(spark, sf):
    return holdout(orders(spark, sf), "id", 0.2, 7).select("id", "is_val")


@query("holdout_floor", f"WITH {ORDER_SQL}, {_RANK7} SELECT id, rk<=greatest(1,CAST(floor(0.15*n) AS BIGINT)) AS is_val FROM ranked")
def _(spark, sf):
    return holdout(orders(spark, sf), "id", 0.15, 7, rounding="floor").select("id", "is_val")


@query(
    "oof_mean_model",
    f"WITH {ORDER_SQL}, {FOLD_SQL}, t AS (SELECT sum(y) AS s, count(*) AS n, avg(y) AS my FROM folded), f AS (SELECT fold, sum(y) AS s, count(*) AS n FROM folded GROUP BY fold), p AS (SELECT o.y, (t.s-f.s)/(t.n-f.n) AS yhat, t.my FROM folded o JOIN f USING (fold), t) SELECT round(1-sum((y-yhat)*(y-yhat))/(sum((y-my)*(y-my))+1e-12),6) AS r2_oof, round(avg((y-yhat)*(y-yhat)),6) AS mse_oof FROM p",
)
def _(spark, sf):
    """Out-of-fold scores of the intercept model, from fold sums alone."""
    y = F.col("y")
    per = folded_orders(spark, sf).groupBy("fold").agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q")).collect()
    n, s, q = (sum(r[c] for r in per) for c in ("n", "s", "q"))
    sse = 0.0
    for r in per:
        m = (s - r["s"]) / (n - r["n"])
        sse += r["q"] - 2 * m * r["s"] + m * m * r["n"]
    return rounded(spark.createDataFrame([(1 - sse / (q - s * s / n + 1e-12), sse / n)], "r2_oof double, mse_oof double"))


@query(
    "oof_ridge_1d",
    f"WITH {ORDER_SQL}, {FOLD_SQL}, k AS (SELECT unnest([0,1,2,3,4]) AS k), m AS (SELECT k, avg(x0) AS mx, avg(y) AS my FROM k, folded WHERE fold<>k GROUP BY k), w AS (SELECT k, mx, my, sum((x0-mx)*(y-my))/(sum((x0-mx)*(x0-mx))+0.001*stddev_pop(x0)*stddev_pop(x0)) AS w FROM m JOIN folded ON fold<>k GROUP BY k, mx, my) SELECT id, fold, round(my+w*(x0-mx),6) AS yhat FROM folded JOIN w ON fold=k",
)
def _(spark, sf):
    """Out-of-fold predictions of a one-term law per fold (the term is scaled on the training rows before the ridge)."""
    df = folded_orders(spark, sf)
    cand = Candidate("x[x0]", "unary", {"f": "x", "i": 0})
    g = gram(Design(df, ["x0"], ["y"], leaf="fold"), [cand])
    yhat = F.lit(None).cast("double")
    for k, view in split_views(g):
        A = np.array([view.unit(0)])
        w, b0, _, _ = select.fit_with(view, A, Options())
        yhat = F.when(F.col("fold") == k, flatten(A, w, b0, view.shift, view.scale, [cand], ["x0"]).column()).otherwise(yhat)
    return df.select("id", "fold", rnd(yhat).alias("yhat"))


_LOG_SQL = f"""{ORDER_SQL}, {FOLD_SQL}, k AS (SELECT unnest([0,1,2,3,4]) AS k), u AS (SELECT id, fold, y, unnest(['x0','x1','x2','x3']) AS name, unnest([x0,x1,x2,x3]) AS x FROM folded),
st AS (SELECT k, name, CAST(count(*) AS DOUBLE) AS n, covar_pop(x,y)/var_pop(x) AS coeff, var_pop(y) AS v0, var_pop(y)-covar_pop(x,y)*covar_pop(x,y)/var_pop(x) AS v1 FROM k JOIN u ON fold<>k GROUP BY k, name),
lg AS (SELECT k AS fold, name, coeff, sign(coeff) AS sign, (n*ln(v0)-n*ln(v1)-ln(n))/ln(2.0) AS bits FROM st), op AS (SELECT * FROM lg WHERE bits>=0.6)"""


def _op_log(spark, sf):
    """One-term laws per training fold and input, as an operator log: fold sums, then totals minus the fold."""
    df = folded_orders(spark, sf)
    long = df.select("fold", "y", F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("x")) for c in ORDER_FEATURES])))
    x, y = F.col("x"), F.col("y")
    sums = {"n": F.count("*"), "sx": F.sum(x), "sy": F.sum(y), "sxx": F.sum(x * x), "sxy": F.sum(x * y), "syy": F.sum(y * y)}
    per = long.groupBy("fold", "name").agg(*[e.alias(c) for c, e in sums.items()])
    total = per.groupBy("name").agg(*[F.sum(c).alias(f"t_{c}") for c in sums])
    # four rows, one per input
    tr = per.join(F.broadcast(total), "name").select("fold", "name", *[(F.col(f"t_{c}") - F.col(c)).cast("double").alias(c) for c in sums])
    n = F.col("n")
    mean = lambda c: F.col(c) / n
    vx, vy = mean("sxx") - mean("sx") ** 2, mean("syy") - mean("sy") ** 2
    cxy = mean("sxy") - mean("sx") * mean("sy")
    bits = (n * F.log(vy) - n * F.log(vy - cxy * cxy / vx) - F.log(n)) / LN2
    log = tr.select("fold", "name", (cxy / vx).alias("coeff"), F.signum(cxy).cast("int").alias("sign"), bits.alias("bits"))
    return log.where(F.col("bits") >= 0.6)


@query("op_log", f"WITH {_LOG_SQL} SELECT fold, name, round(coeff,6) AS coeff, CAST(sign AS INTEGER) AS sign, round(bits,4) AS bits FROM op")
def _(spark, sf):
    log = _op_log(spark, sf)
    return log.select("fold", "name", rnd("coeff").alias("coeff"), "sign", rnd("bits", 4).alias("bits"))


_STAB = "stab AS (SELECT name, count(*)/5.0 AS fold_freq, greatest(count(*) FILTER (WHERE sign>0), count(*) FILTER (WHERE sign<0))/CAST(count(*) AS DOUBLE) AS sign_stability, min(bits) AS min_bits FROM op GROUP BY name)"


@query("op_stability", f"WITH {_LOG_SQL}, {_STAB} SELECT name, round(fold_freq,6) AS fold_freq, round(sign_stability,6) AS sign_stability, round(min_bits,4) AS min_bits FROM stab")
def _(spark, sf):
    s = operator_stability(_op_log(spark, sf), 5)
    return s.select("name", rnd("fold_freq").alias("fold_freq"), rnd("sign_stability").alias("sign_stability"), rnd("min_bits", 4).alias("min_bits"))


@query("consensus_ops", f"WITH {_LOG_SQL}, {_STAB} SELECT name, round(min_bits,4) AS min_bits FROM stab WHERE fold_freq>=0.6 AND sign_stability>=0.9 AND min_bits>=6.0")
def _(spark, sf):
    s = consensus(operator_stability(_op_log(spark, sf), 5))
    return s.select("name", rnd("min_bits", 4).alias("min_bits"))


# --------------------------------------------------------------------------------------------------------------
# Laws and probes

FIXED_LAW = Law(
    0.35,
    (
        (0.8, Candidate("sin[x0]", "unary", {"f": "sin", "i": 0})),
        (-0.25, Candidate("hsml:tanh(p)", "hsml_unary", {"f": "tanh", "w": [0.5, -0.5, 0.5, 0.5]})),
        (0.4, Candidate("hsml2:(x1*x2)", "hsml_binary", {"op": "*", "w1": [0.0, 1.0, 0.0, 0.0], "w2": [0.0, 0.0, 1.0, 0.0]})),
        (0.15, Candidate("relu", "relu_proj", {"w": [0.0, 0.0, 1.0, 1.0], "t": 0.2})),
        (0.05, Candidate("g", "group", {"what": "sum_abs", "idx": [0, 3]})),
        (0.07, Candidate("e", "graph", {"node": ["mul", {}, [["cos", {}, [0]], ["x_over_one_plus_beta_abs", {"beta": 0.8}, [3]]]]})),
    ),
    tuple(ORDER_FEATURES),
)


@query("law_scores", f"WITH {ORDER_SQL} SELECT id, round({FIXED_LAW.sql()},6) AS yhat FROM ord")
def _(spark, sf):
    """A stored law of every candidate kind, loaded back and scored as one expression."""
    path = shared_path(spark, "law")
    FIXED_LAW.save(spark, path)
    return Law.load(spark, path).score(orders(spark, sf)).select("id", rnd("yhat").alias("yhat"))


@query("law_scores_bulk", f"WITH {ORDER_SQL} SELECT id, round({FIXED_LAW.sql()},6) AS yhat FROM ord")
def _(spark, sf):
    """The same law through the Arrow form."""
    return orders(spark, sf).select("id", rnd(score_array([FIXED_LAW])[0]).alias("yhat"))


@query("law_sql_text", f"WITH {ORDER_SQL} SELECT id, round({FIXED_LAW.sql()},6) AS yhat FROM ord")
def _(spark, sf):
    """The same law as exported SQL text, run by Spark SQL."""
    return orders(spark, sf).select("id", F.expr(FIXED_LAW.sql()).alias("yhat")).select("id", rnd("yhat").alias("yhat"))


_DRAWS = 4


def _probe_sql(columns_sql):
    """``columns_sql(draw)`` gives the four transformed inputs."""
    base = FIXED_LAW.sql(["x0", "x1", "x2", "x3"])
    moved = lambda r: FIXED_LAW.sql([f"y{r}_{j}" for j in range(4)])
    inputs = ", ".join(f"{c} AS y{r}_{j}" for r in range(_DRAWS) for j, c in enumerate(columns_sql(r)))
    shifts = ", ".join(f"avg(abs(({base})-({moved(r)}))) AS s{r}" for r in range(_DRAWS))
    return f"WITH {ORDER_SQL}, t AS (SELECT *, {inputs} FROM ord), s AS (SELECT {shifts} FROM t), d AS (SELECT unnest([{', '.join(f's{r}' for r in range(_DRAWS))}]) AS s FROM s) SELECT median(s) AS score FROM d"


def _probe_query(name, probe, columns_sql):
    @query(name, f"SELECT round(score,6) AS score FROM ({_probe_sql(columns_sql)}) q")
    def run(spark, sf):
        """Median shift of the prediction over draws of one symmetry."""
        shifts_ = probe_shifts(orders(spark, sf), FIXED_LAW, [probe], "id", _DRAWS, 42)
        return probe_scores(shifts_).select(rnd("score").alias("score"))

    return run


_X = ["x0", "x1", "x2", "x3"]


def _flip_sql(r):
    heads = f"(CAST('0x'||substr(md5(id||':{r}:42'),1,7) AS BIGINT)<{16**7 // 2})"
    return [f"CASE WHEN {heads} THEN -{c} ELSE {c} END" if c in ("x0", "x3") else c for c in _X]


def _perm_sql(r, which=0):
    order = draw_numbers(Probe("perm", (0, 1, 2)), which, r, 42).permutation((0, 1, 2))
    return [f"x{int(order[j])}" if j < 3 else "x3" for j in range(4)]


def _rotate_sql(r, which=0):
    a = draw_numbers(Probe("rotate", (2, 3)), which, r, 42).uniform(0.0, 2.0 * math.pi)
    return ["x0", "x1", f"x2*({math.cos(a)!r})-x3*({math.sin(a)!r})", f"x2*({math.sin(a)!r})+x3*({math.cos(a)!r})"]


def _scale_sql(r, which=0):
    f = math.exp(draw_numbers(Probe("scale", (0, 1)), which, r, 42).normal(0.0, 0.2))
    return [f"x0*{f!r}", f"x1*{f!r}", "x2", "x3"]


_probe_query("sign_probe", Probe("flip", (0, 3)), _flip_sql)
_probe_query("permutation_probe", Probe("perm", (0, 1, 2)), _perm_sql)
_probe_query("rotation_probe", Probe("rotate", (2, 3)), _rotate_sql)
_probe_query("scale_probe", Probe("scale", (0, 1)), _scale_sql)


_EACH = [_flip_sql, lambda r: _perm_sql(r, 1), lambda r: _rotate_sql(r, 2), lambda r: _scale_sql(r, 3)]
_ALL_PROBES = [Probe("flip", (0, 3)), Probe("perm", (0, 1, 2)), Probe("rotate", (2, 3)), Probe("scale", (0, 1))]
_SCORE_SQL = "SELECT round(median(score),6) AS median FROM (" + " UNION ALL ".join(f"SELECT score FROM ({_probe_sql(c)}) q{k}" for k, c in enumerate(_EACH)) + ") u"


@query("invariance_score", _SCORE_SQL)
def _(spark, sf):
    """Median over samplers of the median shift."""
    return rounded(probe_median(probe_scores(probe_shifts(orders(spark, sf), FIXED_LAW, _ALL_PROBES, "id", _DRAWS, 42))))


@query("invariance_score_expression", _SCORE_SQL)
def _(spark, sf):
    """The same score with every draw as a JVM expression, one probe at a time."""
    df = orders(spark, sf)
    scores = None
    for k, probe in enumerate(_ALL_PROBES):
        padded = [Probe("scale", ())] * k + [probe]
        one = probe_scores(probe_shifts(df, FIXED_LAW, padded, "id", _DRAWS, 42, batches=False).where(F.col("sampler") == k))
        scores = one if scores is None else scores.unionByName(one)
    return rounded(probe_median(scores))

"""Registration of queries with their SQL twins, and the shared input views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramlaw.operators.splits import exact_folds
from gramlaw.operators.telemetry import events_as_telemetry, label
from gramlaw.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


TIE = 0.037  # share of the last digit added before rounding, so that exact halves do not round differently per engine


def rnd(c, digits: int = 6):
    """Round after a tiny nudge off exact ties (the tables hold exact decimals, so ties are common)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + TIE * 10.0**-digits, digits)


def nudged(sql: str) -> str:
    """The same nudge in every ``round(expr, digits)`` of an SQL text."""
    out, at = [], 0
    while (hit := sql.find("round(", at)) >= 0:
        depth, comma, k = 1, -1, hit + 6
        while depth:
            ch = sql[k]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = k
            k += 1
        inner, digits = sql[hit + 6 : comma], int(sql[comma + 1 : k - 1])
        out += [sql[at:hit], f"round(({nudged(inner)})+{TIE * 10.0**-digits!r},{digits})"]
        at = k
    return "".join([*out, sql[at:]])


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = nudged(sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Inputs scaled to order one; the target is derived because the tables hold no natural numeric signal.
LINE_FEATURES = ["x0", "x1", "x2", "x3"]
LINE_SQL = """line AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity/50.0 AS x0,
 l_extendedprice/50000.0 AS x1, l_discount*10.0 AS x2, l_tax*10.0 AS x3,
 l_extendedprice*(1.0-l_discount)/50000.0 AS y, 0.5+l_discount*10.0 AS variance FROM lineitem)"""
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def line(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        *LINE_KEY,
        (F.col("l_quantity") / 50.0).alias("x0"),
        (F.col("l_extendedprice") / 50000.0).alias("x1"),
        (F.col("l_discount") * 10.0).alias("x2"),
        (F.col("l_tax") * 10.0).alias("x3"),
        (F.col("l_extendedprice") * (1.0 - F.col("l_discount")) / 50000.0).alias("y"),
        (F.col("l_discount") * 10.0 + 0.5).alias("variance"),
    )


ORDER_FEATURES = ["x0", "x1", "x2", "x3"]
ORDER_SQL = """ord AS (SELECT id, x0, x1, x2, x3, sin(2.0*x0)+0.5*x1*x2+0.3*abs(x3) AS y,
 0.5+(id%7)*0.25 AS variance FROM (SELECT o_orderkey AS id, o_totalprice/100000.0-2.0 AS x0,
 month(o_orderdate)/12.0+o_totalprice/1000000.0 AS x1, day(o_orderdate)/31.0 AS x2,
 (o_custkey%97)/48.5-1.0 AS x3 FROM orders) q)"""


def orders(spark, sf_dir) -> DataFrame:
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_totalprice") / 100000.0 - 2.0).alias("x0"),
        (F.month("o_orderdate") / 12.0 + F.col("o_totalprice") / 1000000.0).alias("x1"),
        (F.dayofmonth("o_orderdate") / 31.0).alias("x2"),
        (F.col("o_custkey") % 97 / 48.5 - 1.0).alias("x3"),
    )
    y = F.sin(F.col("x0") * 2.0) + F.col("x1") * F.col("x2") * 0.5 + F.abs("x3") * 0.3
    return raw.withColumns({"y": y, "variance": F.col("id") % 7 * 0.25 + 0.5})


FOLD_SQL = """ranked AS (SELECT *, row_number() OVER (ORDER BY substr(md5(CAST(id AS VARCHAR)||':1337'),1,15), id) AS rk,
 count(*) OVER () AS n FROM ord),
folded AS (SELECT *, CASE WHEN rk <= n//5 THEN 0 WHEN rk <= n//5+(n+1)//5 THEN 1
 WHEN rk <= n//5+(n+1)//5+(n+2)//5 THEN 2 WHEN rk <= n//5+(n+1)//5+(n+2)//5+(n+3)//5 THEN 3 ELSE 4 END AS fold FROM ranked)"""


def folded_orders(spark, sf_dir) -> DataFrame:
    return exact_folds(orders(spark, sf_dir), "id", 5, 1337)


# --------------------------------------------------------------------------------------------------------------
TELEMETRY_SQL = """raw AS (SELECT event_id AS record_id, user_id AS episode, ts, 40.0+value/8 AS temp,
 1.0+(event_id%9)*0.5 AS clock_speed, 0.1+(event_id%10)*0.1 AS cooling_valve, 10.0+value AS data_load,
 sum(CASE WHEN event_type='error' THEN 60.0 ELSE 0.0 END) OVER w AS packets_dropped,
 row_number() OVER w - 1 AS tick, lag(40.0+value/8) OVER w AS prev_temp
 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
feat AS (SELECT *, least(data_load, clock_speed*30.0) AS last_processed,
 coalesce(temp+1.5*(temp-prev_temp), temp) AS pred_temp, coalesce(temp-prev_temp, 0.0) AS temp_slope,
 data_load/greatest(1.0, clock_speed*30.0) AS queue_ratio, packets_dropped/1500.0 AS drop_ratio,
 temp-22.0 AS temp_minus_ambient, temp*data_load AS temp_x_load, 1.0-cooling_valve AS cooling_margin,
 greatest(1.0, clock_speed*30.0)-data_load AS throughput_margin FROM raw),
feats AS (SELECT *, pred_temp-temp AS pred_minus_temp, 72.0-pred_temp AS dist_to_yellow, 82.0-pred_temp AS dist_to_orange,
 92.0-pred_temp AS dist_to_red, (pred_temp-22.0)*greatest(queue_ratio, 0.0) AS thermal_pressure FROM feat)"""

_POLICY = {
    "turbo": """queue_ratio>1.18 AS p0, (pred_temp>71.0 OR (temp>70.0 AND temp_slope>0.8)) AS p1,
 ((pred_temp>83.5 AND temp_slope>0.5) OR temp>86.0) AS p2""",
    "stock": """(queue_ratio>1.05 OR pred_temp>78.0) AS p0, (pred_temp>68.0 OR temp>66.0 OR temp_minus_ambient>42.0) AS p1,
 (pred_temp>76.0 OR (temp>74.0 AND temp_slope>0.6)) AS p2""",
}


def label_sql(policy: str = "turbo", source: str = "feats") -> str:
    """CTE ``lab`` with proposals, level, executed bits, override code, regime and reward."""
    return f"""prop AS (SELECT *, {_POLICY[policy]}, CASE
 WHEN temp>=95 OR pred_temp>=92 OR packets_dropped>=1200 THEN 'RED'
 WHEN temp>=84 OR pred_temp>=82 OR temp_slope>=3 OR packets_dropped>=800 THEN 'ORANGE'
 WHEN temp>=72 OR pred_temp>=72 OR temp_slope>=1.75 OR data_load/greatest(1.0,clock_speed*30.0)>=1.10 THEN 'YELLOW'
 ELSE 'GREEN' END AS shield_level, data_load/greatest(1.0,clock_speed*30.0) AS sq FROM {source}),
exec AS (SELECT *, CASE shield_level WHEN 'RED' THEN true WHEN 'ORANGE' THEN p0 OR sq>0.95 OR pred_temp>86
 WHEN 'YELLOW' THEN p0 OR sq>1.05 OR pred_temp>78 ELSE p0 END AS throttle,
 CASE WHEN shield_level='GREEN' THEN p1 ELSE true END AS boost,
 CASE WHEN shield_level IN ('RED','ORANGE') THEN true WHEN shield_level='YELLOW'
 THEN p2 OR pred_temp>80 OR temp_slope>2.2 ELSE p2 END AS reduce_clock,
 greatest((temp-60)/35.0,(pred_temp-62)/28.0,temp_slope/4.0,(sq-0.95)/0.5,packets_dropped/1500.0/0.75) AS risk_score
 FROM prop),
coded AS (SELECT *, CASE WHEN shield_level='RED' THEN 3
 WHEN shield_level='ORANGE' THEN CASE WHEN throttle=p0 AND boost=p1 AND reduce_clock=p2 THEN 1 ELSE 2 END
 WHEN shield_level='YELLOW' THEN CASE WHEN throttle=p0 AND boost=p1 AND reduce_clock=p2 THEN 0 ELSE 1 END
 ELSE 0 END AS override_code FROM exec),
lab AS (SELECT *, CASE WHEN shield_level IN ('ORANGE','RED') OR override_code>=2 OR (throttle AND boost AND reduce_clock) THEN 'brake'
 WHEN reduce_clock AND boost THEN 'thermal_caution' WHEN throttle AND NOT reduce_clock THEN 'congestion_caution'
 WHEN NOT throttle AND NOT boost AND NOT reduce_clock AND temp<60 AND pred_temp<68 AND queue_ratio<0.95 THEN 'relaxed'
 ELSE 'efficiency' END AS regime, last_processed/150.0-0.08*least(1.0,packets_dropped/1500.0) AS reward_like FROM coded)"""


def telemetry(spark, sf_dir) -> DataFrame:
    return events_as_telemetry(table(spark, sf_dir, "events"))


def labelled(spark, sf_dir, policy: str = "turbo") -> DataFrame:
    return label(telemetry(spark, sf_dir), policy)


def rounded(df: DataFrame, digits: int = 6, keep: list[str] = ()) -> DataFrame:
    """Round the double columns; summation order differs between engines."""
    return df.select(
        *[rnd(c, digits).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes]
    )


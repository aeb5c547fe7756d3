"""Telemetry columns: derived features, safety level, override, policies, regime label, and map-shaped features."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramlaw.operators.scan import HOT_ROWS, ordered_scan

# Fixed values (must equal the reference's for equal results).
RAW_SENSORS = ["temp", "clock_speed", "cooling_valve", "data_load", "packets_dropped", "last_processed"]
DERIVED = [
    "pred_temp", "temp_slope", "queue_ratio", "drop_ratio", "temp_minus_ambient", "pred_minus_temp", "dist_to_yellow",
    "dist_to_orange", "dist_to_red", "temp_x_load", "thermal_pressure", "cooling_margin", "throughput_margin",
]
FEATURES = RAW_SENSORS + DERIVED
LEVELS = ["GREEN", "YELLOW", "ORANGE", "RED"]
REGIMES = ["relaxed", "efficiency", "thermal_caution", "congestion_caution", "brake"]
BITS = ["throttle", "boost", "reduce_clock"]
SHIELD_CAPACITY, DROP_LIMIT, AMBIENT = 30.0, 1500.0, 22.0
YELLOW_AT, ORANGE_AT, RED_AT = 72.0, 82.0, 92.0


@dataclass(frozen=True)
class Topology:
    name: str = "base_topology"
    ambient: float = AMBIENT
    capacity_scale: float = SHIELD_CAPACITY
    drop_limit: float = DROP_LIMIT


@dataclass(frozen=True)
class Sensors:
    name: str = "base"
    add: tuple[str, ...] = ()
    remove: tuple[str, ...] = ()


SENSOR_SCENARIOS = [
    Sensors("base"),
    Sensors("extra_thermal_features", add=("temp_x_load", "thermal_pressure", "cooling_margin")),
    Sensors("reduced_sensor_set", remove=("packets_dropped", "last_processed")),
]
TOPOLOGIES = [
    Topology("base_topology"),
    Topology("denser_compute", capacity_scale=28.0),
    Topology("better_cooling"),
    Topology("thermal_lag"),
    Topology("warmer_room", ambient=28.0),
]


def events_as_telemetry(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Read an event table as sensor records: one episode per user, ticks in time order."""
    base = events.select(
        F.col("event_id").alias("record_id"),
        F.col("user_id").alias("episode"),
        "ts",
        (F.col("value") / 8 + 40.0).alias("temp"),
        (F.col("event_id") % 9 * 0.5 + 1.0).alias("clock_speed"),
        (F.col("event_id") % 10 * 0.1 + 0.1).alias("cooling_valve"),
        (F.col("value") + 10.0).alias("data_load"),
        F.when(F.col("event_type") == "error", 60.0).otherwise(0.0).alias("drop_step"),
    )
    out = ordered_scan(
        base,
        "episode",
        ["ts", "record_id"],
        previous={"prev_temp": "temp"},
        running={"packets_dropped": F.col("drop_step")},
        position="tick",
        hot_rows=hot_rows,
    )
    return out.withColumn("last_processed", F.least("data_load", F.col("clock_speed") * SHIELD_CAPACITY)).drop("drop_step")


# --------------------------------------------------------------------------------------------------------------
# Features


def predicted_temp(temp: Column, previous: Column) -> Column:
    return F.coalesce(temp + (temp - previous) * 1.5, temp)


def temp_slope(temp: Column, previous: Column) -> Column:
    return F.coalesce(temp - previous, F.lit(0.0))


def with_features(df: DataFrame, ambient=AMBIENT, capacity_scale=SHIELD_CAPACITY, drop_limit=DROP_LIMIT) -> DataFrame:
    """The thirteen derived features; topology constants are numbers or columns."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    ambient, scale, limit = lit(ambient), lit(capacity_scale), lit(drop_limit)
    temp, load = F.col("temp"), F.col("data_load")
    capacity = F.greatest(F.lit(1.0), F.col("clock_speed") * scale)
    first = {
        "pred_temp": predicted_temp(temp, F.col("prev_temp")),
        "temp_slope": temp_slope(temp, F.col("prev_temp")),
        "queue_ratio": load / capacity,
        "drop_ratio": F.col("packets_dropped") / limit,
        "temp_minus_ambient": temp - ambient,
        "temp_x_load": temp * load,
        "cooling_margin": 1.0 - F.col("cooling_valve"),
        "throughput_margin": capacity - load,
    }
    pred = F.col("pred_temp")
    second = {
        "pred_minus_temp": pred - temp,
        "dist_to_yellow": YELLOW_AT - pred,
        "dist_to_orange": ORANGE_AT - pred,
        "dist_to_red": RED_AT - pred,
        "thermal_pressure": (pred - ambient) * F.greatest(F.col("queue_ratio"), F.lit(0.0)),
    }
    return df.withColumns(first).withColumns(second)


def feature_map(names: list[str] = FEATURES) -> Column:
    return F.create_map(*[v for n in names for v in (F.lit(n), F.col(n).cast("double"))])


def select_features(fmap: Column, sensors: Sensors) -> Column:
    """Drop removed keys; asking for an added key that was not computed is an error."""
    out = fmap
    for key in sensors.add:
        message = F.lit(f"requested feature '{key}' is not computed")
        out = F.when(F.map_contains_key(fmap, key), out).otherwise(F.raise_error(message).cast("map<string,double>"))
    return F.map_filter(out, lambda k, _: ~k.isin(list(sensors.remove))) if sensors.remove else out


def feature_names(df: DataFrame, fmap: str = "feature_map") -> DataFrame:
    """Sorted union of the map keys, then a presence name for each, with their positions."""
    keys = df.select(F.explode(F.map_keys(fmap)).alias("key")).distinct()
    both = keys.select(F.col("key").alias("name"), F.lit(0).alias("part")).unionByName(
        keys.select(F.concat("key", F.lit("__present")).alias("name"), F.lit(1).alias("part"))
    )
    return both.orderBy("part", "name")


def name_list(df: DataFrame, fmap: str = "feature_map") -> list[str]:
    """Feature names as a list (bounded by the number of distinct keys)."""
    return [r["name"] for r in feature_names(df, fmap).collect()]


def design_columns(names: list[str], fmap: str = "feature_map") -> list[Column]:
    """One column per name: the map value or 0, and 1/0 for presence names."""
    out = []
    for n in names:
        if n.endswith("__present"):
            base = n[: -len("__present")]
            out.append(F.map_contains_key(F.col(fmap), base).cast("int").cast("double").alias(n))
        else:
            out.append(F.coalesce(F.try_element_at(F.col(fmap), F.lit(n)), F.lit(0.0)).alias(n))
    return out


def design_matrix(df: DataFrame, names: list[str] | None = None, keep: list[str] = (), actions: str | None = None) -> DataFrame:
    """Records as a numeric table, optionally with one 0/1 target per action bit."""
    if names is None:
        names = name_list(df)
        if not names:
            raise ValueError("no records provided")
    targets = [F.col(actions)[i].cast("double").alias(f"y_{b}") for i, b in enumerate(BITS)] if actions else []
    return df.select(*keep, *design_columns(names), *targets)


# --------------------------------------------------------------------------------------------------------------
# Shield


def shield_queue_ratio() -> Column:
    return F.col("data_load") / F.greatest(F.lit(1.0), F.col("clock_speed") * SHIELD_CAPACITY)


def risk_score(pred: Column, slope: Column) -> Column:
    return F.greatest(
        (F.col("temp") - 60.0) / 35.0,
        (pred - 62.0) / 28.0,
        slope / 4.0,
        (shield_queue_ratio() - 0.95) / 0.50,
        F.col("packets_dropped") / DROP_LIMIT / 0.75,
    )


def shield_level(pred: Column, slope: Column) -> Column:
    temp, drops = F.col("temp"), F.col("packets_dropped")
    return (
        F.when((temp >= 95.0) | (pred >= RED_AT) | (drops >= 1200.0), "RED")
        .when((temp >= 84.0) | (pred >= ORANGE_AT) | (slope >= 3.0) | (drops >= 800.0), "ORANGE")
        .when((temp >= 72.0) | (pred >= YELLOW_AT) | (slope >= 1.75) | (shield_queue_ratio() >= 1.10), "YELLOW")
        .otherwise("GREEN")
    )


def with_shield(df: DataFrame) -> DataFrame:
    """Level, risk score, executed action bits and override code for proposed bits ``p_throttle`` … ."""
    pred, slope, q = F.col("pred_temp"), F.col("temp_slope"), shield_queue_ratio()
    df = df.withColumns({"shield_level": shield_level(pred, slope), "risk_score": risk_score(pred, slope)})
    level = F.col("shield_level")
    yes = F.lit(True)
    t, b, r = (F.col(f"p_{n}") for n in BITS)
    orange_t = t | (q > 0.95) | (pred > 86.0)
    yellow_t = t | (q > 1.05) | (pred > 78.0)
    yellow_r = r | (pred > 80.0) | (slope > 2.2)
    df = df.withColumns(
        {
            "throttle": F.when(level == "RED", yes).when(level == "ORANGE", orange_t).when(level == "YELLOW", yellow_t).otherwise(t),
            "boost": F.when(level == "GREEN", b).otherwise(yes),
            "reduce_clock": F.when(level.isin("RED", "ORANGE"), yes).when(level == "YELLOW", yellow_r).otherwise(r),
        }
    )
    same = (F.col("throttle") == t) & (F.col("boost") == b) & (F.col("reduce_clock") == r)
    code = (
        F.when(level == "RED", 3)
        .when(level == "ORANGE", F.when(same, 1).otherwise(2))
        .when(level == "YELLOW", F.when(same, 0).otherwise(1))
        .otherwise(0)
    )
    return df.withColumns(
        {
            "override_code": code,
            "proposed_action": F.array(*[F.col(f"p_{n}").cast("int") for n in BITS]),
            "executed_action": F.array(*[F.col(n).cast("int") for n in BITS]),
        }
    )


def level_counts(df: DataFrame, key: str = "episode") -> DataFrame:
    return df.groupBy(key).agg(*[F.count_if(F.col("shield_level") == v).alias(v) for v in LEVELS])


# --------------------------------------------------------------------------------------------------------------
# Policies and labels


def turbo_policy() -> dict[str, Column]:
    q, pred, temp, slope = (F.col(c) for c in ("queue_ratio", "pred_temp", "temp", "temp_slope"))
    return {
        "throttle": q > 1.18,
        "boost": (pred > 71.0) | ((temp > 70.0) & (slope > 0.8)),
        "reduce_clock": ((pred > 83.5) & (slope > 0.5)) | (temp > 86.0),
    }


def stock_policy() -> dict[str, Column]:
    q, pred, temp, slope = (F.col(c) for c in ("queue_ratio", "pred_temp", "temp", "temp_slope"))
    return {
        "throttle": (q > 1.05) | (pred > 78.0),
        "boost": (pred > 68.0) | (temp > 66.0) | (F.col("temp_minus_ambient") > 42.0),
        "reduce_clock": (pred > 76.0) | ((temp > 74.0) & (slope > 0.6)),
    }


POLICIES: dict[str, Callable[[], dict[str, Column]]] = {"turbo": turbo_policy, "stock": stock_policy}


def with_policy(df: DataFrame, policy: str | Callable[[], dict[str, Column]]) -> DataFrame:
    """Proposed bits of a policy, built in or user-supplied (three boolean columns by bit name)."""
    bits = (POLICIES[policy] if isinstance(policy, str) else policy)()
    return df.withColumns({f"p_{b}": bits[b] for b in BITS})


def regime_label() -> Column:
    t, b, r = (F.col(n).cast("boolean") for n in BITS)
    brake = F.col("shield_level").isin("ORANGE", "RED") | (F.col("override_code") >= 2) | (t & b & r)
    calm = (F.col("temp") < 60.0) & (F.col("pred_temp") < 68.0) & (F.col("queue_ratio") < 0.95)
    return (
        F.when(brake, "brake")
        .when(r & b, "thermal_caution")
        .when(t & ~r, "congestion_caution")
        .when(~t & ~b & ~r & calm, "relaxed")
        .otherwise("efficiency")
    )


def regime_of_proposal() -> Column:
    """Same label as ``regime_label`` after ``with_shield``, written over the proposal and the sensor values.

    The shield turns ORANGE and RED into brake whatever was proposed, so only GREEN and YELLOW need their actions spelt
    out. A filter on the label is pushed down to the scan with the whole expression in it; the long form repeats the
    level in every branch and outgrows generated code, this one does not.
    """
    pred, slope, temp, q = F.col("pred_temp"), F.col("temp_slope"), F.col("temp"), shield_queue_ratio()
    drops = F.col("packets_dropped")
    severe = (temp >= 84.0) | (pred >= ORANGE_AT) | (slope >= 3.0) | (drops >= 800.0)
    yellow = (temp >= 72.0) | (pred >= YELLOW_AT) | (slope >= 1.75) | (q >= 1.10)
    t = F.col("p_throttle") | (yellow & ((q > 1.05) | (pred > 78.0)))
    b = F.col("p_boost") | yellow
    r = F.col("p_reduce_clock") | (yellow & ((pred > 80.0) | (slope > 2.2)))
    calm = (temp < 60.0) & (pred < 68.0) & (F.col("queue_ratio") < 0.95)
    return (
        F.when(severe | (t & b & r), "brake")
        .when(r & b, "thermal_caution")
        .when(t & ~r, "congestion_caution")
        .when(~t & ~b & ~r & calm, "relaxed")
        .otherwise("efficiency")
    )


def reward() -> Column:
    return F.col("last_processed") / 150.0 - F.least(F.lit(1.0), F.col("packets_dropped") / DROP_LIMIT) * 0.08


def label(df: DataFrame, policy: str | Callable = "turbo", topology: Topology = Topology()) -> DataFrame:
    """Sensor records to fully labelled records: features, proposal, shield, regime, reward. Row-local."""
    out = with_features(df, topology.ambient, topology.capacity_scale, topology.drop_limit)
    out = with_shield(with_policy(out, policy))
    return out.withColumns({"regime": regime_of_proposal(), "reward_like": reward()})


def scenario_matrix(
    df: DataFrame, policy: str, sensors: list[Sensors] = SENSOR_SCENARIOS, topologies: list[Topology] = TOPOLOGIES
) -> DataFrame:
    """Every record under every sensor and topology variant, with its feature map. The variants are literal arrays unfolded
    in place, so nothing is joined or shuffled; policy, shield and features do not depend on the sensor variant and are
    computed once for each topology."""
    missing = [k for s in sensors for k in s.add if k not in FEATURES]
    if missing:
        raise ValueError(f"requested features are not computed: {missing}")
    each = lambda name, value, kind: F.lit(value).cast(kind).alias(name)
    places = F.array(*[F.struct(each("topology_scenario", t.name, "string"), each("ambient", t.ambient, "double"), each("capacity_scale", t.capacity_scale, "double"), each("drop_limit", t.drop_limit, "double")) for t in topologies])
    wide = with_features(df.select("*", F.inline(places)), F.col("ambient"), F.col("capacity_scale"), F.col("drop_limit"))
    wide = with_shield(with_policy(wide, policy))
    wide = wide.withColumns({"regime": regime_of_proposal(), "reward_like": reward(), "feature_map": feature_map(), "mode": F.lit(policy)})
    views = F.array(*[F.struct(each("sensor_scenario", s.name, "string"), F.array(*[F.lit(v) for v in s.remove]).cast("array<string>").alias("removed")) for s in sensors])
    out = wide.select("*", F.inline(views))
    seen = F.map_filter("feature_map", lambda k, _: ~F.array_contains(F.col("removed"), k))
    return out.withColumn("feature_map", seen).drop("removed", "ambient", "capacity_scale", "drop_limit")

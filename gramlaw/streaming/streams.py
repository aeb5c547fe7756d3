"""Streaming forms: law scoring, a stateful shield, incremental moments, and windowed level counts."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gramlaw.operators.catalog import Candidate
from gramlaw.operators.gram import PARTIAL_SCHEMA, Design, Moments, leaf_moments, sum_partials, unpack
from gramlaw.operators.telemetry import SHIELD_CAPACITY, with_policy, with_features, with_shield, regime_of_proposal
from gramlaw.plans.law import Law


def read_stream(spark: SparkSession, folder: str, pattern: str, per_batch: int | None = None) -> DataFrame:
    """A folder of parquet files as a stream with the schema of what lies there now."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(folder)


def score_stream(stream: DataFrame, law: Law, name: str = "yhat") -> DataFrame:
    """Stateless scoring: the law is one expression."""
    return law.score(stream, name)


# --------------------------------------------------------------------------------------------------------------
# Stateful shield

STATE_SCHEMA = "last_temp double, drops double, tick long, waiting binary"
TRACK_SCHEMA = "episode long, record_id long, ts timestamp, tick long, temp double, prev_temp double, clock_speed double, cooling_valve double, data_load double, packets_dropped double"
SENSOR_COLUMNS = ["record_id", "ts", "temp", "clock_speed", "cooling_valve", "data_load", "drop_step"]


def track_episodes(sensors: DataFrame, idle: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Previous temperature, tick number and running drops per episode, kept as state between batches.

    ``sensors`` has columns episode, record_id, ts, temp, clock_speed, cooling_valve, data_load, drop_step. Rows are
    held until the watermark has passed them and then emitted in time order, so late rows inside the delay are placed
    correctly; rows later than that are dropped by the watermark. An episode goes on for ever, however long it pauses,
    unless ``idle`` is given: a pause of that length then ends it, and what follows starts a new one at tick 0.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, drops, tick, held = state.get if state.exists else (float("nan"), 0.0, 0, b"")
        parts = [_unpacked(held)] if held else []
        parts += [_columns(f) for f in frames]
        rows = {c: np.concatenate([part[c] for part in parts]) for c in SENSOR_COLUMNS} if parts else {}
        at = rows["ts"].astype("int64") // 1_000_000 if rows else np.zeros(0, dtype=np.int64)
        mark = state.getCurrentWatermarkMs()
        due = np.flatnonzero(at < mark)
        late = np.flatnonzero(at >= mark)
        if len(due):
            due = due[np.lexsort((rows["record_id"][due], rows["ts"][due]))]
            ready = {c: v[due] for c, v in rows.items()}
            temp = ready["temp"]
            cum = drops + ready["drop_step"].cumsum()
            yield pd.DataFrame(
                {
                    "episode": key[0],
                    "record_id": ready["record_id"],
                    "ts": ready["ts"],
                    "tick": tick + np.arange(len(due)),
                    "temp": temp,
                    "prev_temp": np.concatenate([[last], temp[:-1]]),
                    "clock_speed": ready["clock_speed"],
                    "cooling_valve": ready["cooling_valve"],
                    "data_load": ready["data_load"],
                    "packets_dropped": cum,
                }
            )
            last, drops, tick = float(temp[-1]), float(cum[-1]), tick + len(due)
        if state.hasTimedOut and not len(late):
            state.remove()
            return
        state.update((last, drops, tick, _packed({c: v[late] for c, v in rows.items()}) if len(late) else b""))
        if len(late):
            then = int(at[late].min()) + 1
        elif idle_ms is not None:
            then = mark + idle_ms
        else:
            return
        state.setTimeoutTimestamp(max(then, mark + 1))

    marked = sensors.withWatermark("ts", delay)
    return marked.groupBy("episode").applyInPandasWithState(step, TRACK_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.EventTimeTimeout)


def _columns(frame: pd.DataFrame) -> dict[str, np.ndarray]:
    """Rows as plain arrays; an id column that is all null counts as one of missing numbers."""
    out = {c: frame[c].to_numpy(float) for c in SENSOR_COLUMNS[2:]}
    ids = frame["record_id"].to_numpy()
    return {"record_id": ids.astype(float) if ids.dtype == object else ids, "ts": frame["ts"].to_numpy("datetime64[ns]"), **out}


def _packed(rows: dict[str, np.ndarray]) -> bytes:
    """Rows as one array in NumPy's file format, which keeps every digit."""
    table = np.empty(len(rows["ts"]), dtype=[(c, rows[c].dtype) for c in SENSOR_COLUMNS])
    for c in SENSOR_COLUMNS:
        table[c] = rows[c]
    sink = io.BytesIO()
    np.save(sink, table, allow_pickle=False)
    return sink.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    table = np.load(io.BytesIO(bytes(data)), allow_pickle=False)
    return {c: table[c] for c in SENSOR_COLUMNS}


def shield_stream(sensors: DataFrame, policy: str = "turbo", idle: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Level, override and regime per record of a sensor stream."""
    tracked = track_episodes(sensors, idle, delay)
    tracked = tracked.withColumn("last_processed", F.least("data_load", F.col("clock_speed") * SHIELD_CAPACITY))
    out = with_shield(with_policy(with_features(tracked), policy))
    return out.withColumn("regime", regime_of_proposal())


# --------------------------------------------------------------------------------------------------------------
# Incremental moments


class MomentSink:
    """``foreachBatch`` target that keeps summed moments in a folder, as a log of merged generations.

    A batch writes a table of its own. ``FAN`` tables of a level are added up into one of the next level, and a manifest
    then names the merged tables and the last batch in them; it is written beside its place and renamed, so that it is there
    whole or not at all. What counts is the newest manifest and the finished tables of later batches. So a crash leaves
    either the old tables in force or the new ones, with some that nothing names; a replayed batch overwrites its own table,
    or is passed over if it has been merged. After n batches about ``FAN``·log n tables are left. One writer at a time;
    readers need no lock, but start again if tables they have just listed were merged away.
    """

    FAN = 4

    def __init__(self, path: str, features: list[str], targets: list[str], cands: list[Candidate], centre=None, scale=None):
        self.path, self.features, self.targets, self.cands = path.rstrip("/"), list(features), list(targets), cands
        width = len(cands) + len(targets)
        self.centre = np.zeros(width) if centre is None else np.asarray(centre)
        self.scale = np.ones(width) if scale is None else np.asarray(scale)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id <= self._manifest(spark)["upto"]:
            return
        sums = leaf_moments(Design(batch, self.features, self.targets), self.cands, self.centre, self.scale)
        sums.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        self.compact(spark)

    def compact(self, spark: SparkSession) -> None:
        """Merge while a level has ``FAN`` tables."""
        while True:
            log = self._manifest(spark)
            tables = log["tables"] + [{"level": 0, "path": f"{self.path}/batch={k}"} for k in self._batches(spark, log["upto"])]
            full = [level for level in sorted({t["level"] for t in tables}) if sum(t["level"] == level for t in tables) >= self.FAN]
            if not full:
                return
            old = [t for t in tables if t["level"] == full[0]]
            number = log["number"] + 1
            merged = f"{self.path}/merged/{number}-{uuid.uuid4().hex}"
            self._sum(spark, [t["path"] for t in old]).write.option("compression", "none").parquet(merged)
            upto = max([log["upto"], *(self._batches(spark, log["upto"]) if full[0] == 0 else [])])
            kept = [t for t in log["tables"] if t not in old]
            self._publish(spark, {"number": number, "upto": upto, "tables": [*kept, {"level": full[0] + 1, "path": merged}]})
            for t in old:
                self._delete(spark, t["path"])

    def tables(self, spark: SparkSession) -> list[str]:
        """The tables that count now."""
        log = self._manifest(spark)
        return [t["path"] for t in log["tables"]] + [f"{self.path}/batch={k}" for k in self._batches(spark, log["upto"])]

    def total(self, spark: SparkSession) -> Moments:
        """Moments of ``(1, candidates, targets)`` in the sink's shift and scale."""
        P = 1 + len(self.cands) + len(self.targets)
        (M, n), *_ = unpack(self._sum(spark, self.tables(spark)).collect(), P).values()
        return Moments(M, n, len(self.cands), len(self.targets))

    def _sum(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        return sum_partials(spark.read.schema(PARTIAL_SCHEMA).parquet(*paths).select("leaf", "kind", "block", "n", "data"), groups=8)

    def _files(self, spark: SparkSession, path: str):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, spark: SparkSession, path: str) -> list[str]:
        place, files = self._files(spark, path)
        return [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []

    def _batches(self, spark: SparkSession, upto: int) -> list[int]:
        """Finished batches that no manifest has merged."""
        found = sorted(int(n.split("=")[1]) for n in self._names(spark, self.path) if n.startswith("batch="))
        done = lambda k: (lambda place, files: files.exists(place))(*self._files(spark, f"{self.path}/batch={k}/_SUCCESS"))
        return [k for k in found if k > upto and done(k)]

    def _manifest(self, spark: SparkSession) -> dict:
        numbers = [int(n) for n in self._names(spark, f"{self.path}/manifests") if n.isdigit()]
        if not numbers:
            return {"number": 0, "upto": -1, "tables": []}
        place, files = self._files(spark, f"{self.path}/manifests/{max(numbers)}")
        stream = files.open(place)
        try:
            return json.loads(stream.readUTF())
        finally:
            stream.close()

    def _publish(self, spark: SparkSession, log: dict) -> None:
        folder = f"{self.path}/manifests"
        draft, files = self._files(spark, f"{folder}/.{log['number']}-{uuid.uuid4().hex}")
        stream = files.create(draft)
        stream.writeUTF(json.dumps(log))
        stream.close()
        if not files.rename(draft, self._files(spark, f"{folder}/{log['number']}")[0]):
            raise RuntimeError(f"manifest {log['number']} of {self.path} has another writer")
        for n in self._names(spark, folder):
            if n.isdigit() and int(n) < log["number"] - 1:
                self._delete(spark, f"{folder}/{n}")

    def _delete(self, spark: SparkSession, path: str) -> None:
        place, files = self._files(spark, path)
        files.delete(place, True)


# --------------------------------------------------------------------------------------------------------------
# Windowed counts


def level_windows(labelled: DataFrame, window: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """Records per tumbling window and level; late rows within the delay still count."""
    return (
        labelled.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "shield_level").count()
        .select(F.col("w.start").alias("start"), "shield_level", F.col("count").alias("n"))
    )


END = "2200-01-01 00:00:00"  # the time of a closing row; rows are expected to be earlier


def closable(stream: DataFrame, folder: str) -> DataFrame:
    """``stream`` together with closing rows, which lie in ``folder`` once the input has ended. To be applied before the
    watermark is set. A closing row has a time and is null else, so it forms groups of its own that never come out."""
    spark = stream.sparkSession
    spark.createDataFrame([], "ts timestamp").write.mode("ignore").parquet(folder)
    marks = spark.readStream.schema("ts timestamp").parquet(folder)
    return stream.unionByName(marks.select(*[F.col("ts") if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in stream.dtypes]))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, closing: str | None = None) -> DataFrame:
    """Process everything available now into a parquet table and read it back.

    With the folder of a ``closable`` input the run ends it: a closing row moves the watermark past all that waits, and a
    second run from the same checkpoint puts it out. What comes after is late and dropped. If the driver is lost in between,
    the same call goes on where it stopped, and a second closing row changes nothing."""
    spark = stream.sparkSession

    def run() -> None:
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    if closing:
        spark.sql(f"SELECT TIMESTAMP'{END}' AS ts").write.mode("append").parquet(closing)
        run()
    return spark.read.schema(stream.schema).parquet(path)

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gramlaw.operators.catalog import Candidate
from gramlaw.operators.telemetry import label
from gramlaw.streaming import streams
from gramlaw.streaming.streams import MomentSink, closable, level_windows, read_stream, run_to_table, shield_stream, track_episodes


def test_late_rows_inside_the_delay_keep_their_place(spark, tmp_path):
    """Two batches whose rows are out of order: results equal the batch computation over time order."""
    rng = np.random.default_rng(8)
    start = dt.datetime(2024, 1, 1)
    rows = [
        (int(e), i * 7 + int(e), start + dt.timedelta(minutes=2 * i), float(45 + 40 * rng.random()), 1.0 + i % 4, 0.5, float(20 + 60 * rng.random()), float(60 * (i % 6 == 0)))
        for e in range(3)
        for i in range(40)
    ]
    cols = ["episode", "record_id", "ts", "temp", "clock_speed", "cooling_valve", "data_load", "drop_step"]
    pdf = pd.DataFrame(rows, columns=cols)
    pdf["noise"] = pdf["ts"] + pd.to_timedelta(rng.integers(0, 8, len(pdf)), unit="min")
    pdf = pdf.sort_values("noise").drop(columns="noise")
    schema = "episode long, record_id long, ts timestamp, temp double, clock_speed double, cooling_valve double, data_load double, drop_step double"
    src = tmp_path / "src"
    src.mkdir()
    for k, part in enumerate(np.array_split(pdf, 4)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(src / f"p{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
    keep = ["record_id", "tick", "shield_level", "override_code", "regime", "pred_temp", "packets_dropped"]
    shield = shield_stream(closable(stream, str(tmp_path / "ends")), delay="20 minutes").select(*keep)
    out = run_to_table(shield, str(tmp_path / "out"), str(tmp_path / "check"), str(tmp_path / "ends"))
    got = {r["record_id"]: tuple(r) for r in out.collect()}

    from pyspark.sql import Window

    w = Window.partitionBy("episode").orderBy("ts", "record_id")
    base = spark.createDataFrame(pdf, schema).select(
        "*", F.lag("temp").over(w).alias("prev_temp"), F.sum("drop_step").over(w).alias("packets_dropped"), (F.row_number().over(w) - 1).alias("tick"),
        F.least("data_load", F.col("clock_speed") * 30.0).alias("last_processed"),
    )
    want = {r["record_id"]: tuple(r) for r in label(base).select(*keep).collect()}
    assert set(got) == set(want) and out.count() == len(want)
    for k, v in got.items():
        assert v[:5] == want[k][:5]
        np.testing.assert_allclose(v[5:], want[k][5:], rtol=1e-9)


def test_pauses_of_days_do_not_restart_an_episode(spark, tmp_path):
    """Rows days apart in batches of their own, doubles with all digits, another episode moving the watermark."""
    day = dt.timedelta(days=1)
    start = dt.datetime(2024, 1, 1)
    rows = [(7, k, start + at * day, 50.0 + 1 / 3 + k, 1.0, 0.5, 20.0, 60.0) for k, at in enumerate((0, 0.1, 6, 13))]
    rows += [(8, 100 + k, start + at * day, 40.0, 1.0, 0.5, 20.0, 0.0) for k, at in enumerate((0.05, 3, 8, 15, 30))]
    rows.sort(key=lambda r: r[2])
    schema = "episode long, record_id long, ts timestamp, temp double, clock_speed double, cooling_valve double, data_load double, drop_step double"
    src = tmp_path / "src"
    src.mkdir()
    for k, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(str(src / f"p{k:02}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
    tracked = track_episodes(stream, delay="10 minutes").select("episode", "record_id", "tick", "prev_temp", "temp", "packets_dropped")
    got = {r["record_id"]: r for r in run_to_table(tracked, str(tmp_path / "out"), str(tmp_path / "check")).collect()}
    assert [(got[k]["tick"], got[k]["packets_dropped"]) for k in range(4)] == [(0, 60.0), (1, 120.0), (2, 180.0), (3, 240.0)]
    assert [got[k]["prev_temp"] for k in range(4)] == [None, *(50.0 + 1 / 3 + k for k in range(3))]
    assert [got[k]["temp"] for k in range(4)] == [50.0 + 1 / 3 + k for k in range(4)]


def test_replayed_batch_is_not_counted_twice(spark, tmp_path):
    df = spark.range(100).select((F.col("id") / 10.0).alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    sink = MomentSink(str(tmp_path / "m"), ["x"], ["y"], [Candidate("x", "unary", {"f": "x", "i": 0})])
    sink(df.where("x < 4"), 0)
    sink(df.where("x >= 4"), 1)
    sink(df.where("x >= 4"), 1)
    m = sink.total(spark)
    x, y = np.arange(100) / 10.0, np.arange(100) % 7
    U = np.column_stack([np.ones(100), x, y])
    assert m.n == 100
    np.testing.assert_allclose(m.M, U.T @ U, rtol=1e-12)


def _sink_of(df, path):
    sink = MomentSink(path, ["x"], ["y"], [Candidate("x", "unary", {"f": "x", "i": 0})])
    return sink, lambda k: df.where(F.col("id") % 40 == k)


def _whole(m):
    x, y = np.arange(400) / 10.0, np.arange(400) % 7
    U = np.column_stack([np.ones(400), x, y])
    return m.n == 400 and np.allclose(m.M, U.T @ U, rtol=1e-12)


def test_many_batches_leave_few_tables(spark, tmp_path):
    df = spark.range(0, 400, 1, 1).select("id", (F.col("id") / 10.0).alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    sink, part = _sink_of(df, str(tmp_path / "m"))
    most = 0
    for k in range(40):
        sink(part(k), k)
        if k in (11, 12, 39):
            sink(part(k), k)  # a replay, merged or not
        most = max(most, len(sink.tables(spark)))
    assert most <= 9 and _whole(sink.total(spark))
    left = [p for p in (tmp_path / "m").iterdir() if p.name.startswith("batch=")] + list((tmp_path / "m" / "merged").iterdir())
    assert len(left) == len(sink.tables(spark)) and len(list((tmp_path / "m" / "manifests").glob("[0-9]*"))) <= 2


def test_a_crash_between_steps_counts_nothing_twice(spark, tmp_path, monkeypatch):
    """The writer dies after the merged table, after the manifest, or in the middle of a batch; a new one goes on."""
    df = spark.range(0, 400, 1, 1).select("id", (F.col("id") / 10.0).alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    path = str(tmp_path / "m")

    def dies(*_):
        raise KeyboardInterrupt

    for k in range(40):
        sink, part = _sink_of(df, path)
        broken = {3: "_publish", 7: "_delete", 15: "_publish", 19: "_delete"}.get(k)
        if broken:
            with monkeypatch.context() as m:
                m.setattr(MomentSink, broken, dies)
                try:
                    sink(part(k), k)
                except KeyboardInterrupt:
                    pass
        if k == 30:
            part(5).select("id").write.parquet(f"{path}/batch={k}")  # a half-written batch
            (tmp_path / "m" / f"batch={k}" / "_SUCCESS").unlink()
            assert f"{path}/batch={k}" not in sink.tables(spark)
        sink(part(k), k)
    assert _whole(sink.total(spark))


def test_stream_reader_takes_the_folder_schema(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t"))
    s = read_stream(spark, str(tmp_path / "t"), "*.parquet")
    assert s.isStreaming and s.columns == ["id"]


def test_last_windows_come_out_once(spark, tmp_path):
    """Batches of any size give the counts of the whole table; ending the input a second time adds nothing."""
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(hours=5 * i), "RED" if i % 3 else "GREEN") for i in range(40)]
    src = tmp_path / "src"
    src.mkdir()
    for k, part in enumerate((rows[:7], rows[7:8], rows[8:39], rows[39:])):
        spark.createDataFrame(part, "ts timestamp, shield_level string").coalesce(1).write.parquet(str(src / f"p{k}"))
    stream = spark.readStream.schema("ts timestamp, shield_level string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
    ends = str(tmp_path / "ends")
    want = {}
    for ts, level in rows:
        want[ts.date(), level] = want.get((ts.date(), level), 0) + 1
    for _ in range(2):
        out = run_to_table(level_windows(closable(stream, ends)), str(tmp_path / "out"), str(tmp_path / "check"), ends)
        got = out.collect()
        assert {(r["start"].date(), r["shield_level"]): r["n"] for r in got} == want and len(got) == len(want)


def test_waiting_rows_are_kept_as_plain_arrays():
    frame = pd.DataFrame({"record_id": [2**53 + 1, 7], "ts": pd.to_datetime(["2024-01-01 00:00:00.123456", "2024-01-02 00:00:00"], format="ISO8601"), "temp": [0.1, float("nan")], "clock_speed": 1.0, "cooling_valve": 0.5, "data_load": 3.0, "drop_step": 60.0})
    rows = streams._columns(frame)
    back = streams._unpacked(streams._packed(rows))
    assert all(back[c].dtype == rows[c].dtype and np.array_equal(back[c], rows[c], equal_nan=c == "temp") for c in rows)
    assert back["record_id"][0] == 2**53 + 1

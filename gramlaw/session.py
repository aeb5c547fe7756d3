"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's ``spark.checkpoint.dir``. A temporary one only where it is unset and the
    driver runs everything, as in tests: on a cluster each executor would write to its own disk."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gramlaw.local.dir", None)
    if not configured:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="spark-gramlaw-")
        spark.conf.set("gramlaw.local.dir", configured)
    return configured.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gramlaw/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage", compression: str = "snappy") -> DataFrame:
    """Write a result once and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_evenly(df: DataFrame, name: str = "stage") -> DataFrame:
    """As ``materialise``, in even parts for all cores: passes over the table then read it as it is (``Design.even``)."""
    return materialise(df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism), name)


def plan_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of a plan, used to prove a bound before broadcasting; ``None`` if unknown."""
    try:
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except AttributeError:  # no JVM plan behind a remote session
        return None


def spread(df: DataFrame, small_bytes_per_core: int = 32 << 20) -> DataFrame:
    """Give compute-heavy passes one task per core when the input is too small to split; large inputs stay as read."""
    prepare(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = plan_bytes(df)
    if size is not None and size < small_bytes_per_core * cores:
        return df.repartition(cores)
    return df


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_DEFAULT = 64 << 20


def _bytes(spark: SparkSession, text: str) -> int:
    """A size as Spark writes it (``64m``, ``8388608b``), by Spark's own parser."""
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(text))


HUGE_METHOD, JIT_BYTES = "spark.sql.codegen.hugeMethodLimit", 8000


def prepare(spark: SparkSession) -> None:
    """Once per session: make this package importable in Python workers, keep Arrow batches of packed sums small, and keep
    generated code short enough to be compiled.

    Sums travel as rows of about 1 MB; at the default 64 MB per batch, and twice that while a buffer grows, the tasks of
    an executor could exceed its direct memory. The JVM only interprets methods above 8000 bytes, as the generated code of
    wide rows has; with that limit Spark splits it up instead. A value set by the user is left alone.
    """
    if spark.conf.get("gramlaw.prepared", None):
        return
    if _bytes(spark, spark.conf.get(ARROW_BYTES, str(ARROW_DEFAULT))) == ARROW_DEFAULT:
        spark.conf.set(ARROW_BYTES, str(8 << 20))
    if int(spark.conf.get(HUGE_METHOD)) == 65535:
        spark.conf.set(HUGE_METHOD, str(JIT_BYTES))
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="spark-gramlaw-zip-"), "gramlaw"), "zip", os.path.dirname(here), "gramlaw")
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("gramlaw.prepared", "true")

"""A session with the settings that the engine expects; callers may bring their own."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive plans and skew joins; settings override. Partition counts are left to the cluster and AQE."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | settings
    builder = SparkSession.builder.appName("quillmesh")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local master may leave the setting out (as tests do); a folder is then made for the session.
    """
    context = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if place is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="quillmesh-")
        context.setCheckpointDir(place)
    return place.rstrip("/")


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches hold some 8 MB at most from now on: the session's setting is lowered to that, never raised."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)b?", spark.conf.get(name, "64m").strip().lower()).groups()
    if int(digits) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit] > most:
        spark.conf.set(name, str(most))


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """df computed once: written as Parquet to the shared folder and read back, so that its plan is cut and lost executors do
    no harm."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of tables that kept() gave, once nothing reads them any more; other tables are left alone."""
    for df in frames:
        path = getattr(df, "_kept_at", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

"""Spark session defaults and the shared folder for written intermediates."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this library relies on.  Values a cluster already sets win.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "glossaline") -> SparkSession:
    """Session for tests and the bench; on a cluster use the session you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("GLOSSALINE_DRIVER_MEMORY", "12g"))
    )
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``, else a local one (tests only)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-glossaline-"))
    return context.getCheckpointDir().rstrip("/")


def new_shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts lineage in a way that survives lost executors, computes the input a single time, and
    gives later joins a real size to plan with.  ``compression``: for long texts ``zstd`` takes less disk than the default.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, label)
    writer = df.write if compression is None else df.write.option("compression", compression)
    writer.parquet(path)
    held = spark.read.schema(df.schema).parquet(path)
    held.written_to = path
    return held


def discard(*held: DataFrame) -> None:
    """Delete what :func:`materialize` wrote for these tables, once nothing will read them again."""
    for df in held:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of few splits one task per core.

    A table of one small file is one task, whatever work each row needs.  A table that already has
    enough splits, as any large one has, is returned as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    return df.repartition(cores) if splits < cores else df

"""Live job progress from checkpoint events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.jobs import progress_counters
from ..schemas import CHECKPOINTS


def read_checkpoint_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(CHECKPOINTS).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", max_files).json(path)


def live_progress(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Running counters per job.

    With ``delay`` a repeated event (same job, segment and name) inside that time counts once and
    its state is dropped afterwards; without it every row counts.
    """
    if delay:
        events = events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["job_id", "segment_id", "event"])
    return events.groupBy("job_id").agg(*progress_counters(), F.max("timestamp").alias("updated_at"))


def write_live(progress: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Each batch overwrites its own folder, so a replayed batch never counts twice."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")

    return (
        progress.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def latest_progress(spark: SparkSession, path: str) -> DataFrame:
    """Newest counters of every job from the written updates."""
    updates = spark.read.option("recursiveFileLookup", True).parquet(path)
    columns = [c for c in updates.columns if c not in ("job_id", "batch_id", "batch")]
    return updates.groupBy("job_id").agg(F.max_by(F.struct(*columns), "batch_id").alias("_s")).select("job_id", "_s.*")

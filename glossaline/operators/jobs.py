"""Jobs: progress, summaries, resume and retry sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V

COMPLETED = ["segment_completed", "segment_completed_after_retry"]


def is_resumable(status: Column) -> Column:
    return F.coalesce(status.isin(V.RESUMABLE_STATUSES), F.lit(False))


def is_valid_status(status: Column) -> Column:
    return F.coalesce(status.isin(V.JOB_STATUSES), F.lit(False))


def is_valid_event(event: Column) -> Column:
    return F.coalesce(event.isin(V.CHECKPOINT_EVENTS), F.lit(False))


def progress_counters() -> list[Column]:
    """Counters over checkpoint events, shared by the batch and the streaming form."""
    event = F.col("event")
    return [
        F.count_if(event.isin(COMPLETED)).alias("completed_segments"),
        F.count_if(event == "segment_failed").alias("failed_segments"),
        F.count_if(event == "segment_skipped").alias("skipped_segments"),
        F.count_if(event == "tm_hit").alias("tm_hits"),
        F.count_if(event.isin("provider_success", "provider_fail")).alias("provider_calls"),
    ]


def percent_done(done: Column, total: Column, status: Column | None = None) -> Column:
    """``round(min(100, done / total * 100), 2)``; an empty job counts 0, or 100 once completed."""
    empty = F.when(status == "completed", 100.0).otherwise(0.0) if status is not None else F.lit(0.0)
    return F.when(total > 0, F.round(F.least(F.lit(100.0), done / F.nullif(total, F.lit(0)) * 100.0), 2)).otherwise(empty)


def progress(jobs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Counters and percent per job.

    Counting is a hash aggregate with partial combine: one huge job costs one row per task.
    """
    counted = checkpoints.groupBy("job_id").agg(*progress_counters())
    joined = jobs.select("job_id", "status", "total_segments").join(counted, "job_id", "left")
    names = ["completed_segments", "failed_segments", "skipped_segments", "tm_hits", "provider_calls"]
    filled = joined.fillna(0, subset=names)
    done = F.col("completed_segments") + F.col("failed_segments") + F.col("skipped_segments")
    total = F.greatest(F.coalesce("total_segments", F.lit(0)), F.lit(0))
    return filled.withColumn("total_segments", total).withColumn(
        "percent", percent_done(done, total, F.col("status"))
    )


def apply_deltas(deltas: DataFrame) -> DataFrame:
    """Counters from delta rows, floored at zero: job_id, counter, delta.

    The floor applies to the summed deltas; logs hold non-negative deltas, where both agree.
    """
    return deltas.groupBy("job_id", "counter").agg(F.greatest(F.sum("delta"), F.lit(0)).alias("value"))


def failed_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("job_id").agg(F.count(F.lit(1)).alias("failed_item_count"))


def summary(jobs: DataFrame, checkpoints: DataFrame, errors: DataFrame) -> DataFrame:
    """Job, progress, number of failed items, and whether it can be resumed."""
    counted = progress(jobs, checkpoints).drop("status", "total_segments")
    return (
        jobs.join(counted, "job_id", "left")
        .join(failed_counts(errors), "job_id", "left")
        .fillna(0, subset=["failed_item_count"])
        .withColumn("can_resume", is_resumable(F.col("status")))
    )


def newest_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "job_id").limit(limit)


def segments_to_resume(segments: DataFrame, jobs: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Segments of resumable jobs without a completed event."""
    resumable = jobs.filter(is_resumable(F.col("status"))).select("job_id")
    completed = checkpoints.filter(F.col("event").isin(COMPLETED)).select("job_id", "segment_id").distinct()
    return segments.join(resumable, "job_id", "left_semi").join(completed, ["job_id", "segment_id"], "left_anti")


def retry_items(errors: DataFrame) -> DataFrame:
    """Failed items with the retry count of the next attempt; the stored rows stay."""
    return errors.withColumn("retry_count", F.greatest(F.coalesce("retry_count", F.lit(0)), F.lit(0)) + 1)

"""Caching translations as they arrive: a stream of saves into the translation memory.

Every micro-batch writes one small delta (its last save per key, with the order of the first); nothing rewrites the memory
while the stream runs.  ``fold`` merges the deltas into the memory when it suits, in one upsert.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.memory import KEY, acceptable, upsert, with_key

SAVES = (
    "source_lang STRING, target_lang STRING, source_text STRING, translated_text STRING, provider STRING, model STRING, "
    "saved_at TIMESTAMP, save_no STRING"
)
DELTAS = SAVES + ", first_saved_at TIMESTAMP, first_save_no STRING"


def last_saves(batch: DataFrame) -> DataFrame:
    """One row per key: the latest save, and when the first came, which decides ids and creation times later."""
    columns = ["source_text", "translated_text", "provider", "model", "saved_at", "save_no"]
    keyed = with_key(acceptable(batch), "source_text")
    latest = keyed.groupBy(*KEY).agg(
        F.max_by(F.struct(*columns), F.struct("saved_at", "save_no")).alias("_s"), F.min(F.struct("saved_at", "save_no")).alias("_f")
    )
    return latest.select(
        "source_lang", "target_lang", *[F.col(f"_s.{c}").alias(c) for c in columns],
        F.col("_f.saved_at").alias("first_saved_at"), F.col("_f.save_no").alias("first_save_no"),
    )


def save_stream(incoming: DataFrame, deltas: str, checkpoint: str, trigger: dict | None = None):
    """A replayed batch overwrites its own delta, so running it twice changes nothing."""

    def save(batch: DataFrame, batch_id: int) -> None:
        last_saves(batch).write.mode("overwrite").parquet(f"{deltas}/batch={batch_id:012d}")

    return (
        incoming.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_deltas(spark: SparkSession, deltas: str) -> DataFrame:
    return spark.read.schema(DELTAS).option("recursiveFileLookup", True).parquet(deltas)


def fold(tm: DataFrame, deltas: DataFrame) -> DataFrame:
    return upsert(tm, deltas)

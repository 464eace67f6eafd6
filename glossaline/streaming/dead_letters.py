"""A stream of JSON Lines in which nothing is lost: good rows to one table, lines that are no JSON to another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CORRUPT, FILE = "_corrupt", "_file"


def read_lines(spark: SparkSession, path: str, schema: str, max_files: int = 1000) -> DataFrame:
    """Rows of new files; a malformed line keeps its text in ``_corrupt``, and every row the name of its file in ``_file``."""
    stream = (
        spark.readStream.schema(f"{schema}, {CORRUPT} STRING").option("columnNameOfCorruptRecord", CORRUPT).option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).json(path)
    )
    return stream.withColumn(FILE, F.col("_metadata.file_name"))


def split(lines: DataFrame, good: str, bad: str, checkpoint: str, trigger: dict | None = None):
    """Start writing good rows and dead letters; a micro-batch that runs again overwrites what it wrote, in both."""

    def save(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()  # both sinks read it
        try:
            where = f"batch={batch_id:012d}"
            held.filter(F.col(CORRUPT).isNull()).drop(CORRUPT, FILE).write.mode("overwrite").parquet(f"{good}/{where}")
            held.filter(F.col(CORRUPT).isNotNull()).select(FILE, F.col(CORRUPT).alias("line")).write.mode("overwrite").parquet(f"{bad}/{where}")
        finally:
            held.unpersist()

    return (
        lines.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def read_good(spark: SparkSession, good: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(good)


def read_bad(spark: SparkSession, bad: str) -> DataFrame:
    """(file, line) of every dead letter."""
    return spark.read.schema(f"{FILE} STRING, line STRING").option("recursiveFileLookup", True).parquet(bad).withColumnRenamed(FILE, "file")

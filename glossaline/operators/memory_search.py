"""Substring search in a large memory by a stored trigram index, instead of reading every text.

``postings/part=k`` holds (gram, id) for every letter trigram of an entry's texts, ASCII letters in lower
case, ordered by gram; ``sizes/part=k`` how many entries hold a gram; ``entries/part=k`` the entries by id.
A search reads the partitions of its own grams only: first their sizes, then the postings of the rarest
few, meets them by id, and reads the partitions of the entries found to test the pattern itself.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import materialize
from .memory import _ascii_lower, search

GRAM = 3
RAREST = 4  # postings met by a search


def _part(value: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(parts)).cast("int")


def _grams(text: Column) -> Column:
    # A look ahead from every place: linear, where substrings by place would count characters from the start each time.
    return F.array_distinct(F.regexp_extract_all(_ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))


def build(tm: DataFrame, path: str, parts: int = 256) -> None:
    """Write the index of a memory."""
    entries = tm.withColumn("part", _part(F.col("id"), parts))
    entries.repartition("part").sortWithinPartitions("part", "id").write.partitionBy("part").parquet(f"{path}/entries")
    grams = F.array_union(_grams(F.col("source_text")), _grams(F.col("translated_text")))
    found = tm.select("id", F.explode(grams).alias("gram")).withColumn("part", _part(F.col("gram"), parts))
    # A gram that most entries hold is spread over tasks by its ids; each keeps its rows in order.
    held = materialize(found.repartition(F.col("part"), F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("part", "gram", "id"), "postings")
    held.write.partitionBy("part").parquet(f"{path}/postings")
    held.groupBy("part", "gram").agg(F.count("*").alias("n")).repartition("part").sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{path}/sizes")
    layout = tm.sparkSession.range(1).select(F.lit(parts).alias("parts"), F.lit(tm.schema.json()).alias("entry"))
    layout.coalesce(1).write.parquet(f"{path}/layout")


def literal_grams(query: str) -> list[str]:
    """Trigrams that every match holds: those of the stretches between wildcards."""
    lowered = "".join(c.lower() if c.isascii() else c for c in query).replace("_", "%")
    return sorted({piece[i : i + GRAM] for piece in lowered.split("%") for i in range(len(piece) - GRAM + 1)})


def _layout(spark: SparkSession, path: str) -> tuple[int, T.StructType]:
    row = spark.read.parquet(f"{path}/layout").first()
    return row["parts"], T.StructType.fromJson(json.loads(row["entry"]))


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """(id, part) of the entries that hold the query's rarest grams; None where it has none."""
    grams = literal_grams(query)
    if not grams:
        return None
    parts = _layout(spark, path)[0]
    asked = spark.createDataFrame([(g,) for g in grams], "gram string").select("gram", _part(F.col("gram"), parts).alias("part"))
    of = {r["gram"]: r["part"] for r in asked.collect()}

    def stored(name: str, wanted: list[str]) -> DataFrame:
        return spark.read.schema("gram STRING, id BIGINT, n BIGINT, part INT").parquet(f"{path}/{name}").filter(F.col("part").isin(sorted({of[g] for g in wanted})) & F.col("gram").isin(wanted))

    sizes = {r["gram"]: r["n"] for r in stored("sizes", grams).collect()}  # one row for each gram of the query
    if len(sizes) < len(grams):
        return spark.createDataFrame([], "id long, part int")
    rarest = sorted(grams, key=lambda g: (sizes[g], g))[:RAREST]
    met = stored("postings", rarest).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(rarest))
    return met.select("id", _part(F.col("id"), parts).alias("part"))


def indexed_search(spark: SparkSession, path: str, query: str = "", source_lang: str | None = None, target_lang: str | None = None, limit: int = 100) -> DataFrame:
    """The same rows as :func:`memory.search`, from the index."""
    # With a known schema only files that are asked for are opened.
    entries = spark.read.schema(T.StructType([*_layout(spark, path)[1], T.StructField("part", T.IntegerType())])).parquet(f"{path}/entries")
    found = candidates(spark, path, query)
    if found is None:
        return search(entries.drop("part"), query, source_lang, target_lang, limit)
    held = materialize(found, "found-entries")
    where = [r["part"] for r in held.select("part").distinct().collect()]  # at most one row for each partition
    some = entries.filter(F.col("part").isin(where)).join(held.select("id"), "id", "left_semi").drop("part")
    return search(some, query, source_lang, target_lang, limit)

"""Indexed substring search equals the scan and leaves the rest of the index unread."""

import glob

import pytest
from pyspark.sql import functions as F

from glossaline.operators import memory, memory_search

TM = "id long, source_lang string, target_lang string, source_text string, translated_text string, updated_at timestamp"


@pytest.fixture
def tm(spark):
    rows = spark.range(400).select(
        "id", F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("source_lang"), F.lit("vi").alias("target_lang"),
        F.concat(F.lit("Common words "), F.md5(F.col("id").cast("string")), F.when(F.col("id") % 100 == 7, " Needle in 100% hay_stack").otherwise("")).alias("source_text"),
        F.when(F.col("id") % 50 == 3, None).otherwise(F.concat(F.lit("Dịch é "), F.col("id"))).alias("translated_text"), F.timestamp_seconds(F.col("id") * 7919 % 1000).alias("updated_at"),
    )
    return rows.unionByName(spark.createDataFrame([(900, "en", "vi", "", None, None), (901, "en", "vi", "ab", "NEEDLE back\\slash", None)], TM))


def test_same_rows_as_the_scan(spark, tm, tmp_path):
    path = str(tmp_path / "index")
    memory_search.build(tm, path, parts=16)
    for query in ("needle", "NEEDLE in", "ed%y_st", "Dịch é 39", "common", "ab", "", "zzz", "back\\slash", "words 1", "É 3", "0%s"):
        for lang in (None, "de"):
            got = [r["id"] for r in memory_search.indexed_search(spark, path, query, source_lang=lang, limit=30).collect()]
            want = [r["id"] for r in memory.search(tm, query, source_lang=lang, limit=30).collect()]
            assert got == want, (query, lang)


def test_only_the_grams_and_entries_asked_for_are_read(spark, tm, tmp_path):
    path = str(tmp_path / "index")
    memory_search.build(tm, path, parts=64)
    found = memory_search.candidates(spark, path, "needle in 1").collect()
    assert sorted(r["id"] for r in found) == [7, 107, 207, 307]
    parts = {r["part"] for r in found}
    grams = memory_search.literal_grams("needle in 1")
    of = {r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(memory_search._part(F.col("gram"), 64)).collect()}
    broken = 0
    for name, kept in (("entries", parts), ("postings", of), ("sizes", of)):
        for folder in glob.glob(f"{path}/{name}/part=*"):
            if int(folder.rsplit("=", 1)[1]) not in kept:
                for file in glob.glob(f"{folder}/*.parquet"):  # a file that cannot be read
                    with open(file, "wb") as f:
                        f.write(b"broken")
                    broken += 1
    assert broken > 60
    got = memory_search.indexed_search(spark, path, "needle in 1", limit=10).collect()
    assert sorted(r["id"] for r in got) == [7, 107, 207, 307]

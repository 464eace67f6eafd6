"""The stored memory: small deltas, merge on read, compaction of touched buckets only."""

import datetime
import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from glossaline.operators import memory, memory_store

SAVES = "source_lang string, target_lang string, source_text string, translated_text string, provider string, model string, saved_at timestamp, save_no long"
NOON = datetime.datetime(2024, 5, 1, 12, tzinfo=datetime.timezone.utc)


def saves(spark, rows):
    return spark.createDataFrame([("en", "vi", s, t, p, None, NOON + datetime.timedelta(seconds=n), n) for n, (s, t, p) in enumerate(rows)], SAVES)


@pytest.fixture
def store(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, source_lang string, target_lang string, source_text_hash string, source_text string, translated_text string, provider string, "
                                      "model string, created_at timestamp, updated_at timestamp, hit_count long")
    tm = memory.upsert(empty, saves(spark, [(f"text number {i}", f"bản {i}", "p") for i in range(400)]))
    path = str(tmp_path / "store")
    memory_store.create(tm, path, buckets=64)
    return path


def seen(spark, path):
    return {r["source_text"]: r for r in memory_store.read(spark, path).collect()}


def files(path):
    return {f: (os.path.getsize(f), os.stat(f).st_mtime_ns) for f in glob.glob(f"{path}/base/bucket=*/*.parquet")}


def test_one_per_cent_rewrites_its_buckets_only(spark, store):
    before, plain = files(store), memory_store.read(spark, store)
    change = saves(spark, [(f"text number {i}", f"mới {i}", "") for i in (3, 70, 150)] + [("brand new", "mới", "q")])
    want = {r["source_text"]: r for r in memory.upsert(plain, change).collect()}
    memory_store.save(change, store, 1)
    assert files(store) == before
    written = sum(os.path.getsize(f) for f in glob.glob(f"{store}/deltas/**/*.parquet", recursive=True))
    assert 0 < written < sum(n for n, _ in before.values()) / 10
    assert seen(spark, store) == want and len(want) == 401 and want["brand new"]["id"] == 401 and want["text number 3"]["provider"] == "unknown"
    touched = memory_store.compact(spark, store)
    after = files(store)
    assert 1 <= len(touched) <= 4
    kept = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert all(after[f] == before[f] for f in kept) and len(kept) > 40
    assert sum(n for f, (n, _) in after.items() if f not in kept) < sum(n for n, _ in before.values()) / 4
    assert seen(spark, store) == want and not glob.glob(f"{store}/deltas/batch=*")
    assert memory_store.compact(spark, store) == []


def test_tombstones_hits_and_ids(spark, store):
    entry = seen(spark, store)["text number 7"]
    hits = spark.createDataFrame([(*[entry[k] for k in memory.KEY], entry["id"], NOON + datetime.timedelta(days=k)) for k in (1, 2)], "source_lang string, target_lang string, source_text_hash string, tm_id long, looked_up_at timestamp")
    memory_store.hit(hits, store, 1)
    got = seen(spark, store)["text number 7"]
    assert got["hit_count"] == 2 and got["updated_at"] == (NOON + datetime.timedelta(days=2)).replace(tzinfo=None) and got["id"] == entry["id"]
    memory_store.remove(spark, store, spark.createDataFrame([(entry["id"],), (400,), (12345,)], "id long"), 2)
    assert not {"text number 7", "text number 399"} & set(seen(spark, store))
    memory_store.hit(hits, store, 3)  # of an entry that is gone
    memory_store.save(saves(spark, [("text number 7", "lại", "p")]), store, 4)
    again = seen(spark, store)["text number 7"]
    assert (again["id"], again["hit_count"], again["translated_text"]) == (401, 0, "lại")
    memory_store.remove(spark, store, spark.createDataFrame([(401,)], "id long"), 5)
    memory_store.compact(spark, store)
    memory_store.save(saves(spark, [("text number 7", "ba", "p"), ("text number 399", "bốn", "p")]), store, 6)
    last = seen(spark, store)
    assert (last["text number 7"]["id"], last["text number 399"]["id"]) == (402, 403)  # 401 is never given again


def test_a_broken_compaction_and_a_repeated_batch_change_nothing(spark, store, tmp_path):
    memory_store.save(saves(spark, [("new one", "x", "p"), ("text number 5", "y", "p")]), store, 1)
    memory_store.remove(spark, store, memory_store.read(spark, store).filter("source_text = 'text number 9'").select("id"), 2)
    want = seen(spark, store)
    shutil.copytree(f"{store}/deltas", tmp_path / "left")
    memory_store.compact(spark, store)
    shutil.copytree(tmp_path / "left", f"{store}/deltas", dirs_exist_ok=True)  # stopped before the deltas went
    assert seen(spark, store) == want
    memory_store.save(saves(spark, [("third", "z", "p")]), store, 3)
    memory_store.save(saves(spark, [("third", "z", "p")]), store, 3)
    got = seen(spark, store)
    assert {k: v for k, v in got.items() if k != "third"} == want and got["third"]["id"] == 402


def test_empty_changes(spark, store):
    memory_store.save(saves(spark, [(" ", "x", "p"), ("a", "", "p")]), store, 1)
    assert len(seen(spark, store)) == 400
    assert memory_store.read(spark, store).agg(F.max("id")).first()[0] == 400

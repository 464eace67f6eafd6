"""Calls in flight: time limits, retries, order, and the log that spares calls."""

import glob
import time

from pyspark.sql import functions as F

from glossaline.operators import memory, translator

SCHEMA = "source_lang string, target_lang string, text string, n int"


def rows(spark, texts):
    return spark.createDataFrame([("en", "vi", t, i) for i, t in enumerate(texts)], SCHEMA)


def test_hanging_calls_cost_one_timeout(spark):
    def fn(text, source, target):
        if text.startswith("hang"):
            time.sleep(60)
        time.sleep(0.05)
        return {"text": text.upper(), "provider": "p", "latency_ms": 50}

    texts = [f"hang {i}" if i in (3, 4) else f"t {i}" for i in range(40)]
    start = time.monotonic()
    got = translator.translate_rows(rows(spark, texts), fn, parallelism=1, in_flight=8, timeout=2.0).orderBy("n").collect()
    assert time.monotonic() - start < 12
    assert [r["text"] for r in got] == texts
    assert all((r["status"], r["error_type"], r["translated_text"]) == (("failed", "timeout", None) if r["n"] in (3, 4) else ("success", None, r["text"].upper())) for r in got)


def test_failed_calls_are_tried_again_and_originals_stay(spark):
    def fn(text, source, target):
        seen = fn.__dict__.setdefault("seen", {})
        seen[text] = seen.get(text, 0) + 1
        if text == "never" or (text == "second" and seen[text] < 2):
            raise ValueError("no")
        return {"text": f"{text} {seen[text]}"}

    got = {r["text"]: r for r in translator.translate_rows(rows(spark, ["first", "second", "never"]), fn, parallelism=1, retries=2, backoff=0.01).collect()}
    assert (got["first"]["translated_text"], got["second"]["translated_text"]) == ("first 1", "second 2")
    assert (got["never"]["status"], got["never"]["error_type"], got["never"]["translated_text"]) == ("failed", "ValueError", None)

    segments = spark.createDataFrame([(i, "en", "vi", t) for i, t in enumerate(["slow one", "fine"])], "seg_id long, source_lang string, target_lang string, text string").withColumn("requested_at", F.timestamp_seconds(F.col("seg_id")))
    empty = spark.createDataFrame([], "id long, source_lang string, target_lang string, source_text_hash string, source_text string, translated_text string, provider string, model string, created_at timestamp, updated_at timestamp, hit_count long")

    def slow(text, source, target):
        time.sleep(30 if text.startswith("slow") else 0)
        return {"text": "dịch"}

    out, _ = memory.translate_cached(segments, empty, slow, parallelism=1, timeout=1.0)
    assert {r["text"]: (r["translated_text"], r["status"]) for r in out.collect()} == {"slow one": ("slow one", "failed"), "fine": ("dịch", "success")}


def test_a_task_that_runs_again_repeats_no_logged_call(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def fn(text, source, target, stop_at=None):
        (calls / f"{text}-{time.monotonic_ns()}").touch()
        return {"text": text[::-1]}

    texts = [f"text{i % 150}" for i in range(300)]
    df = rows(spark, texts)
    log = str(tmp_path / "log")
    whole = translator.translate_rows(df.filter("n < 100"), fn, parallelism=3, log=log).collect()
    assert len(whole) == 100 and len(list(calls.iterdir())) == 100
    got = translator.translate_rows(df, fn, parallelism=3, log=log).orderBy("n").collect()
    assert [r["translated_text"] for r in got] == [t[::-1] for t in texts] and got[0].asDict().keys() == {"source_lang", "target_lang", "text", "n", *translator.RESULT}
    assert len(list(calls.iterdir())) == 150  # 50 more texts, each called once whatever its repeats
    assert glob.glob(f"{log}/task=*/*.parquet") and not glob.glob(f"{log}/task=*/*.tmp")


def test_failed_calls_are_called_again_by_a_new_run(spark, tmp_path):
    mark = tmp_path / "up"

    def fn(text, source, target):
        return {"text": "ok"} if mark.exists() else {"status": "failed", "error_type": "provider_5xx"}

    log = str(tmp_path / "log")
    assert {r["status"] for r in translator.translate_rows(rows(spark, ["a", "b"]), fn, parallelism=2, log=log).collect()} == {"failed"}
    mark.touch()
    assert {r["status"] for r in translator.translate_rows(rows(spark, ["a", "b"]), fn, parallelism=2, log=log).collect()} == {"success"}
    assert translator.translate_rows(rows(spark, []), fn, parallelism=2, log=log).count() == 0


def test_a_batch_is_worked_on_in_slices(spark):
    import pyarrow as pa

    texts = ["x" * 10] * 1300 + ["y" * 1_500_000, None, "z" * 1_500_000, "w" * 3_000_000, "v"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], ["text", "n"])
    parts = list(translator.slices(batch))
    assert [n for p in parts for n in p.column("n").to_pylist()] == list(range(len(texts)))
    assert max(p.num_rows for p in parts) == 512
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= translator.SLICE_CHARS for p in parts)
    assert not list(translator.slices(batch.slice(0, 0)))

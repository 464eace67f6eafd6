from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from glossaline import schemas
from glossaline.operators import catalog as C
from glossaline.operators import jobs as J
from glossaline.operators import providers as P
from glossaline.operators import segments as S
from glossaline.plans.ordered import freeze_order, number_rows, unfreeze, with_previous, with_running
from glossaline.sources import files

T0 = datetime(2024, 1, 1)
LOG = "provider STRING, model STRING, key_index INT, ts TIMESTAMP, attempt_no BIGINT, status STRING, error_type STRING, latency_ms DOUBLE"


def attempts(spark, *rows):
    return spark.createDataFrame(
        [(p, "m", 0, T0 + timedelta(seconds=i), i, status, error, float(ms)) for i, (p, status, error, ms) in enumerate(rows)], LOG
    )


def test_latency_fold(spark):
    log = attempts(spark, *[("a", "success", None, ms) for ms in (100, 200, 0, 50)])
    for n, want in ((1, 100.0), (2, 120.0), (3, 120.0), (4, 106.0)):
        row = P.provider_states(log.filter(F.col("attempt_no") < n), "2024-01-01 00:01:00").first()
        assert row["latency_score"] == pytest.approx(want)


def test_streak_cooldown_and_health(spark):
    log = attempts(spark, ("a", "success", None, 5), ("a", "failed", "429 quota", 5), ("a", "failed", "timeout", 5), ("b", "failed", "401", 0), ("b", "success", None, 9), ("c", "failed", "weird", 0))
    rows = {r["provider"]: r for r in P.provider_states(log, "2024-01-01 00:01:00").collect()}
    assert (rows["a"]["consecutive_failures"], rows["a"]["health_status"], rows["a"]["on_cooldown"]) == (2, "degraded", True)
    assert (rows["b"]["consecutive_failures"], rows["b"]["health_status"], rows["b"]["is_available"], rows["b"]["last_error_class"]) == (0, "healthy", True, "auth_failure")
    assert (rows["c"]["health_status"], rows["c"]["on_cooldown"]) == ("healthy", True)
    later = {r["provider"]: r["on_cooldown"] for r in P.provider_states(log, "2024-01-01 01:00:00").collect()}
    assert not any(later.values())


def test_ranking(spark):
    log = attempts(spark, ("gemini", "failed", "quota exceeded", 0), ("groq", "success", None, 200), ("cerebras", "success", None, 100))
    ranked = P.rank_providers(P.provider_states(log, "2024-01-01 00:01:00")).orderBy("rank").collect()
    assert [r["provider"] for r in ranked] == ["cerebras", "groq", "gemini"]
    healthy = attempts(spark, *[(p, "success", None, 0) for p in ("google", "groq", "gemini")])
    ranked = P.rank_providers(P.provider_states(healthy, "2024-01-01 00:01:00")).orderBy("rank").collect()
    assert [r["provider"] for r in ranked] == ["gemini", "groq", "google"]


def test_rounded_latencies_that_are_equal_rank_by_name(spark):
    rows = [("b", 10.00001), ("a", 10.00002), ("d", 3.00005), ("c", 1.0), ("c", 2.0), ("c", 3.0)]
    states = spark.createDataFrame(rows, "provider STRING, latency_score DOUBLE").selectExpr(
        "*", "true AS state_available", "false AS on_cooldown", "'healthy' AS health_status")
    ranked = P.rank_providers(states, decimals=4).orderBy("rank").collect()
    assert [(r["provider"], r["latency"]) for r in ranked] == [("c", 2.0), ("d", 3.0001), ("a", 10.0), ("b", 10.0)]


def test_waterfall(spark):
    rows = [("r1", 0, "groq", "failed"), ("r1", 1, "x", "skipped"), ("r1", 2, "cerebras", "success"), ("r1", 3, "late", "success")]
    rows += [("r2", i, f"p{i}", "failed") for i in range(4)] + [("r2", 4, "p4", "success")]
    log = spark.createDataFrame([(r, o, p, "m", s, "timeout" if s == "failed" else None, 1) for r, o, p, s in rows],
                                "request_id STRING, ord INT, provider STRING, model STRING, status STRING, error_type STRING, latency_ms INT")
    got = {r["request_id"]: r for r in P.waterfall_outcomes(log).collect()}
    assert (got["r1"]["provider"], got["r1"]["fallback_count"], got["r1"]["attempts"]) == ("cerebras", 1, 2)
    assert (got["r2"]["status"], got["r2"]["provider"], got["r2"]["attempts"], got["r2"]["error_type"]) == ("error", "p2", 3, "timeout")


def test_ordered_plans_match_windows_on_a_hot_key(spark):
    """A third of all rows in one key, spread over several chunks."""
    rows = [(0 if i % 3 == 0 else i % 50, i, (i * 7919) % 1000) for i in range(6000)]
    df = spark.createDataFrame(rows, "k INT, o INT, v INT")
    # Small partitions would be merged into one chunk; keep them apart.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frozen = freeze_order(df, ["k"], ["o"])
        numbered = number_rows(df, [], ["k", "o"], "n")
        state = P.provider_states(
            df.select(F.col("k").cast("string").alias("provider"), F.lit("m").alias("model"), F.lit(0).alias("key_index"), F.timestamp_seconds("o").alias("ts"), F.col("o").alias("attempt_no"),
                      F.lit("success").alias("status"), F.lit(None).cast("string").alias("error_type"), F.col("v").cast("double").alias("latency_ms")), "2024-01-01",
        ).filter("provider = '0'").first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    score = 0.0
    for k, _, v in rows:
        if k == 0 and v > 0:
            score = float(v) if score <= 0 else 0.8 * score + 0.2 * v
    assert state["latency_score"] == pytest.approx(score)
    assert frozen.filter("k = 0").select("_chunk").distinct().count() > 1
    out = unfreeze(with_running(with_previous(frozen, ["k"], {"p": "v"}), ["k"], {"s": F.col("v").cast("bigint"), "n": F.lit(1).cast("bigint")}))
    from pyspark.sql import Window

    w = Window.partitionBy("k").orderBy("o")
    want = df.withColumn("p", F.lag("v").over(w)).withColumn("s", F.sum("v").over(w)).withColumn("n", F.row_number().over(w).cast("bigint"))
    columns = ["k", "o", "v", "p", "s", "n"]
    assert out.select(*columns).exceptAll(want.select(*columns)).count() == 0 and out.count() == 6000
    assert numbered.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()[:] == (1, 6000, 6000)


def test_progress(spark):
    jobs = spark.createDataFrame([("j", "running", 10), ("e", "running", 0), ("d", "completed", 0)], "job_id STRING, status STRING, total_segments INT")
    events = ["segment_completed"] * 3 + ["segment_failed"] * 2 + ["tm_hit"] + ["provider_success"] * 3 + ["provider_fail"]
    log = spark.createDataFrame([("j", str(i), e) for i, e in enumerate(events)], "job_id STRING, segment_id STRING, event STRING")
    got = {r["job_id"]: r for r in J.progress(jobs, log).collect()}
    assert (got["j"]["percent"], got["j"]["tm_hits"], got["j"]["provider_calls"]) == (50.0, 1, 4)
    assert (got["e"]["percent"], got["d"]["percent"]) == (0.0, 100.0)


def test_resume_and_retry(spark):
    statuses = ["pending", "running", "paused", "failed", "completed", "cancelled"]
    df = spark.createDataFrame([(s,) for s in statuses], "s STRING")
    assert [r[0] for r in df.select(J.is_resumable(F.col("s"))).collect()] == [True] * 4 + [False] * 2
    errors = spark.createDataFrame([("Sheet1!A1", 1), ("x", None)], "segment_id STRING, retry_count INT")
    assert [r["retry_count"] for r in J.retry_items(errors).collect()] == [2, 1]


def test_jsonl_round_trip_and_bad_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    events = spark.createDataFrame([(T0, "j", "segment_failed", "key AIzaSy1234567890"), (T0, "j", "odd_event", "")], "timestamp TIMESTAMP, job_id STRING, event STRING, error_message STRING")
    files.append_jsonl(files.prepare_checkpoints(events), path)
    (tmp_path / "log" / "more.json").write_text('\n{"job_id": "k", "event": "job_failed"}\nnot json\n{"job_id": \n')
    rows = files.read_jsonl(spark, path, schemas.CHECKPOINTS).orderBy("job_id").collect()
    assert [(r["job_id"], r["event"]) for r in rows] == [("j", "segment_failed"), ("k", "job_failed")]
    assert rows[0]["error_message"] == "key [REDACTED_API_KEY]"


def test_job_folders_skip_corrupt(spark, tmp_path):
    for name, body in (("job_1", '{"job_id": "job_1",\n "status": "paused", "created_at": "2024-01-01T00:00:00Z"}'), ("job_2", "{oops")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "job.json").write_text(body)
        (tmp_path / name / "progress.json").write_text('{"job_id": "no"}')
    assert [r["job_id"] for r in files.read_jobs(spark, str(tmp_path)).collect()] == ["job_1"]


def test_encodings(spark, tmp_path):
    contents = {"a": "héllo\r\nx".encode("utf-8"), "b": "﻿bom".encode("utf-8"), "c": "日本語".encode("cp932"), "d": b"caf\xe9 \x93q\x94", "e": b"\xff\xfe\x81\xfd\x81"}
    for name, raw in contents.items():
        (tmp_path / name).write_bytes(raw)
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["encoding_used"]) for r in files.read_text_files(spark, str(tmp_path)).collect()}
    assert got["a"] == ("héllo\nx", "utf-8-sig") and got["b"] == ("bom", "utf-8-sig") and got["c"] == ("日本語", "cp932")
    for name in ("d", "e"):
        for codec in ("utf-8-sig", "utf-8", "cp932", "shift_jis", "cp1252"):
            try:
                want = (contents[name].decode(codec), codec)
                break
            except UnicodeDecodeError:
                want = (contents[name].decode("utf-8", errors="replace"), "utf-8-replace")
        assert got[name] == want
    out = str(tmp_path / "out")
    files.write_text(spark.createDataFrame([("a\nb",)], "text STRING"), out)
    assert spark.read.text(out, wholetext=True).first()[0] == "a\nb\n"


def entry(spark, *rows):
    full = [(p, o, i, label, True, source, vis, None, None, None, None, None) for p, o, i, label, source, vis in rows]
    return spark.createDataFrame(full, schemas.MODELS)


def test_catalog_merge_keeps_user_entry(spark):
    base = entry(spark, ("deepseek", 0, "custom-user-model", "My Custom Model", "user", "unverified"))
    found = entry(spark, ("deepseek", 0, "deepseek-chat", None, "api_discovered", "current_key_visible"), ("deepseek", 1, "custom-user-model", None, "api_discovered", "current_key_visible"))
    rows = C.merge(base, found).orderBy("ordinal").collect()
    assert [(r["id"], r["label"], r["source"], r["visibility"]) for r in rows] == [
        ("custom-user-model", "My Custom Model", "user", "current_key_visible"), ("deepseek-chat", "deepseek-chat", "api_discovered", "current_key_visible"),
    ]


def test_cells(spark):
    rows = [("s", 1, 1, "=A1", "string", True, False), ("s", 1, 2, "5", "number", False, False), ("s", 1, 3, "text", "string", False, False), ("s", 1, 4, "x", "string", False, True), ("s", 1, 5, " ", "string", False, False)]
    df = spark.createDataFrame(rows, "sheet STRING, row INT, col INT, value STRING, value_type STRING, is_formula BOOLEAN, is_merged_child BOOLEAN")
    assert [r["segment_id"] for r in S.translatable_cells(df).collect()] == ["s!R1C3"]


def test_super_batch_mismatch_keeps_originals(spark):
    df = spark.createDataFrame([(1, 0, "a"), (1, 1, "nan"), (1, 2, "b"), (2, 0, "c")], "k INT, pos INT, text STRING")
    good = S.translate_super_batches(df, ["k"], "pos", 10, lambda t, s, d: {"text": t.upper()}, "en", "vi")
    assert {(r["k"], r["position"], r["result"]) for r in good.collect()} == {(1, 0, "A"), (1, 2, "B"), (2, 0, "C")}
    bad = S.translate_super_batches(df, ["k"], "pos", 10, lambda t, s, d: {"text": "one"}, "en", "vi")
    assert {(r["k"], r["result"]) for r in bad.collect()} == {(1, "a"), (1, "b"), (2, "one")}


def test_ordering_counts_null_keys_across_chunks(spark):
    rows = [(None if i % 3 else i % 2, i, i % 5) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, o int, v int").repartition(4)
    got = {(r["k"], r["o"]): r["n"] for r in number_rows(df, ["k"], ["o"], "n").collect()}
    want, seen = {}, {}
    for k, o, _ in sorted(rows, key=lambda r: r[1]):
        seen[k] = seen.get(k, 0) + 1
        want[k, o] = seen[k]
    assert got == want


def test_health_with_missing_key_index_over_several_states(spark):
    rows = [
        (f"p{i % 2}", f"m{i % 3}", None if i % 5 else 0, T0 + timedelta(seconds=i), i, "failed" if i % 7 == 0 else "success", "Timeout" if i % 7 == 0 else None, float(100 + i % 40))
        for i in range(400)
    ]
    want = {}
    for provider, model, key, _, _, status, _, ms in rows:
        n, score = want.get((provider, model, key), (0, None))
        want[provider, model, key] = (n + (status == "success"), ms if score is None else score * 0.8 + ms * 0.2)
    got = {
        (r["provider"], r["model"], r["key_index"]): (r["success_count"], pytest.approx(r["latency_score"]))
        for r in P.provider_states(spark.createDataFrame(rows, LOG).repartition(4), "2024-01-02 00:00:00").collect()
    }
    assert got == want

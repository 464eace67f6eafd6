"""Live health: records merge, event time gives the batch result, cooldowns end by themselves."""

import datetime
import random

import numpy as np
from pyspark.sql import functions as F

from glossaline import fixed_values as V
from glossaline.operators.providers import provider_states
from glossaline.streaming import health

SCHEMA = "provider string, model string, attempt_no long, ts timestamp, status string, error_type string, latency_ms double"
START = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)
ERRORS = ["HTTP 429 quota exceeded", "request timed out", "401 Unauthorized", "strange"]


def attempt(n, seconds, provider="p", model="m", r=None, status=None, latency=None):
    r = r or random.Random(n)
    status = status or r.choice(["success", "success", "failed", "skipped"])
    return (provider, model, n, START + datetime.timedelta(seconds=seconds), status, r.choice(ERRORS) if status == "failed" else None, r.choice([None, 0.0, 120.0, 900.0]) if latency is None else latency)


def plain_fold(a):
    """Attempts one by one, as a router would see them."""
    state = dict(ok=0, bad=0, streak=0, score=0.0)
    for row in np.sort(a, order=["seconds", "attempt_no"]):
        if row["code"]:
            state["bad"] += 1
            state["streak"] += 1
        else:
            state["ok"] += 1
            state["streak"] = 0
        if row["latency"] > 0:
            state["score"] = row["latency"] if state["score"] <= 0 else V.LATENCY_KEEP * state["score"] + V.LATENCY_NEW * row["latency"]
    return state


def test_records_of_stretches_merge_to_the_fold_of_all():
    r = np.random.default_rng(2)
    for n in (1, 2, 7, 300):
        a = np.zeros(n, health.ATTEMPT)
        a["seconds"], a["attempt_no"] = r.integers(0, n, n), r.permutation(n)
        a["latency"], a["code"] = r.choice([0, 0, 50, 700], n), r.choice([0, 0, 1, 5, 9], n)
        ordered = np.sort(a, order=["seconds", "attempt_no"])
        cuts = sorted(r.integers(0, n + 1, 4))
        whole = None
        for lo, hi in zip([0, *cuts], [*cuts, n]):
            if hi > lo:
                part = health.reduced(r.permutation(ordered[lo:hi]))
                whole = part if whole is None else health.merged(whole, part)
        want = plain_fold(a)
        assert (whole.success_count, whole.failure_count, whole.streak) == (want["ok"], want["bad"], want["streak"])
        assert abs((whole.power * whole.seed + whole.weighted if whole.timed else 0.0) - want["score"]) < 1e-9
        assert whole._replace(power=0, weighted=0) == health.reduced(a)._replace(power=0, weighted=0)


def run(spark, tmp_path, files, **options):
    for k, rows in enumerate(files):  # one after the other, as a log grows
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", health.STORE)
    health.save_health(health.live_health(stream, **options), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    return spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out")


def test_event_time_equals_the_batch_form_whatever_the_files(spark, tmp_path):
    r = random.Random(4)
    rows = [attempt(n, r.uniform(0, 7200), r.choice("pppq"), r.choice("mn"), r) for n in range(1500)]
    files = [[] for _ in range(4)]
    for row in rows:  # up to ten minutes late, so files overlap
        files[min(3, int(((row[3] - START).total_seconds() + r.uniform(0, 600)) // 1950))].append(row)
    keys = ["provider", "model"]
    got = health.latest_health(run(spark, tmp_path, files, delay="20 minutes", keys=keys), keys)
    newest = max((x[3] - START).total_seconds() for x in rows if x[4] != "skipped")
    as_of = (newest // 60 + 1) * 60 - 1200
    seen = [x for x in rows if ((x[3] - START).total_seconds() // 60 + 1) * 60 <= as_of]
    at = START + datetime.timedelta(seconds=as_of)
    want = provider_states(spark.createDataFrame(seen, SCHEMA), F.timestamp_seconds(F.lit(at.timestamp())), keys=keys)

    def rows_of(df, until):
        names = [*keys, "success_count", "failure_count", "consecutive_failures", F.round("latency_score", 6), "last_error_type", "health_status", until, "on_cooldown"]
        return sorted(map(tuple, df.select(*names).collect()))

    assert rows_of(got, F.round("cooldown_until", 3)) == rows_of(want, F.round(F.coalesce(F.col("cooldown_until").cast("double"), F.lit(0.0)), 3))


def test_cooldowns_end_by_a_timer_and_late_attempts_are_dropped(spark, tmp_path):
    files = [
        [attempt(1, 10, status="failed", latency=100.0), attempt(2, 20, "q", status="success", latency=100.0)],
        [attempt(3, 200, "q", status="success", latency=100.0)],
        [attempt(7, 300, "q", status="success", latency=100.0)],
        [attempt(4, 900, "q", status="success", latency=100.0), attempt(5, 15, status="success", latency=100.0)],  # the last one far too late
        [attempt(6, 2000, "q", status="success", latency=100.0)],
    ]
    updates = run(spark, tmp_path, files, delay="1 minute", cooldown_seconds=300)
    p = [tuple(x) for x in updates.filter("provider = 'p'").orderBy("changes").select("changes", "success_count", "failure_count", "on_cooldown").collect()]
    assert p == [(1, 0, 1, True), (2, 0, 1, False)]
    q = updates.filter("provider = 'q'").orderBy("changes").select("success_count").collect()
    assert [x[0] for x in q] == [1, 2, 3, 4]  # the newest stretch is still open


def test_empty_stream_and_null_provider(spark, tmp_path):
    files = [[(None, "m", 1, START, "success", None, 5.0), (None, "m", 2, START, "failed", "strange", None)], []]
    got = health.latest_health(run(spark, tmp_path, files))
    assert [tuple(x) for x in got.select("provider", "success_count", "failure_count", "latency_score").collect()] == [(None, 1, 1, 5.0)]


def test_a_micro_batch_costs_a_provider_one_update_whatever_its_stretches(spark, tmp_path):
    rows = [attempt(n, 7 * n, "p", status="failed" if n % 5 == 0 else "success", latency=100.0 + n) for n in range(600)]
    got = run(spark, tmp_path, [rows, [attempt(9000, 10**6, "q", status="success", latency=1.0)]], delay="1 minute").filter("provider = 'p'").orderBy("changes").collect()
    # Once when the first file's watermark passes all but its end, once for that end; before, once for each of 70 stretches.
    assert len(got) <= 3
    assert (got[-1]["success_count"], got[-1]["failure_count"]) == (480, 120)

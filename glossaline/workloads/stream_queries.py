"""Streaming queries over the events and documents tables, run to the end of their input.

The SQL states what the batch form gives: a stream must end at the same result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators.jobs import progress_counters
from ..session import new_shared_path
from ..streaming import dead_letters, health, memory_sink, progress
from .base import any_of, query, seg_hash, strip, table
from .memory_queries import TM_SQL, memory_table
from .work_queries import _LOG_EVENT, _MESSAGES, ATTEMPTS_SQL, _case, _pick


def stream_of(spark, sf, name):
    """The table as a file stream, whether it is one file or a folder of them: a pattern that names it alone finds both."""
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


@query("stream_progress", f"""
WITH e AS (SELECT user_id AS job_id, {_case('event_type', _LOG_EVENT)} AS event, ts FROM events)
SELECT job_id, count(*) FILTER (WHERE event = 'segment_completed') AS completed_segments, count(*) FILTER (WHERE event = 'segment_failed') AS failed_segments, 0::BIGINT AS skipped_segments,
  count(*) FILTER (WHERE event = 'tm_hit') AS tm_hits, count(*) FILTER (WHERE event = 'provider_success') AS provider_calls, max(ts) AS updated_at FROM e GROUP BY job_id
""")
def stream_progress(spark, sf):
    events = stream_of(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), _pick(F.col("event_type"), _LOG_EVENT).alias("event"), F.col("event_id").alias("segment_id"), F.col("ts").cast("timestamp").alias("timestamp")
    )
    out = new_shared_path(spark, "progress")
    progress.write_live(progress.live_progress(events, "2 hours"), out, new_shared_path(spark, "progress-state")).awaitTermination()
    return progress.latest_progress(spark, out)


@query("batch_progress", f"""
WITH e AS (SELECT user_id AS job_id, {_case('event_type', _LOG_EVENT)} AS event FROM events)
SELECT job_id, count(*) FILTER (WHERE event = 'segment_completed') AS completed_segments, count(*) FILTER (WHERE event = 'segment_failed') AS failed_segments, 0::BIGINT AS skipped_segments,
  count(*) FILTER (WHERE event = 'tm_hit') AS tm_hits, count(*) FILTER (WHERE event = 'provider_success') AS provider_calls FROM e GROUP BY job_id
""")
def batch_progress(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), _pick(F.col("event_type"), _LOG_EVENT).alias("event"))
    return events.groupBy("job_id").agg(*progress_counters())


@query("stream_health", f"""
WITH {ATTEMPTS_SQL} SELECT provider, success_count, failure_count, consecutive_failures, latency_score, last_error_type, health_status,
  CASE WHEN cooldown_until IS NULL THEN 0.0 ELSE round(epoch_us(cooldown_until) / 1000000.0::DOUBLE, 3) END AS cooldown_until FROM states
""")
def stream_health(spark, sf):
    updates = _health_updates(spark, health.live_health(_attempts(stream_of(spark, sf, "events"))))
    names = ["provider", "success_count", "failure_count", "consecutive_failures", "latency_score", "last_error_type", "health_status", "cooldown_until"]
    return updates.select(*names).withColumn("latency_score", F.round("latency_score", 6)).withColumn("cooldown_until", F.round("cooldown_until", 3))


def _attempts(events):
    kind = F.col("event_type")
    message = F.get(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col("event_id") % 6).cast("int"))
    return events.select(
        F.col("user_id").cast("string").alias("provider"), F.col("event_id").alias("attempt_no"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(kind == "error", "failed").when(kind == "signup", "skipped").otherwise("success").alias("status"), F.when(kind == "error", message).alias("error_type"),
        F.when(kind == "view", 0.0).otherwise(F.floor(F.col("value")).cast("double")).alias("latency_ms"),
    )


def _health_updates(spark, updates):
    out = new_shared_path(spark, "health")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", health.STORE)
    health.save_health(updates, out, new_shared_path(spark, "health-state")).awaitTermination()
    return health.latest_health(spark.read.option("recursiveFileLookup", True).parquet(out))


_PARTS = 4
_LATE = 6 * 3600  # attempts reach their file up to half of this late


@query("stream_health_event_time", f"""
WITH w AS (SELECT (floor(epoch_us(max(ts)) / 60e6) + 1) * 60 - {_LATE} AS as_of FROM events WHERE event_type <> 'signup'),
passed AS (SELECT events.* FROM events, w WHERE (floor(epoch_us(ts) / 60e6) + 1) * 60 <= as_of),
{ATTEMPTS_SQL.replace("FROM events)", "FROM passed)")}
SELECT provider, success_count, failure_count, consecutive_failures, latency_score, last_error_type, health_status,
  CASE WHEN cooldown_until IS NULL THEN 0.0 ELSE round(epoch_us(cooldown_until) / 1000000.0::DOUBLE, 3) END AS cooldown_until,
  coalesce(epoch_us(cooldown_until) / 1000000.0::DOUBLE > as_of, false) AS on_cooldown FROM states, w
""")
def stream_health_event_time(spark, sf):
    """Attempts in files of which each holds some that belong to the time of the one before."""
    events = table(spark, sf, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    late = F.pmod(F.xxhash64("event_id"), F.lit(_LATE // 2))
    step = ((last - first).total_seconds() + _LATE) / _PARTS if first else 1.0
    part = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit(first).cast("timestamp")) + late) / step)
    folder, out, state = (new_shared_path(spark, label) for label in ("attempt-files", "health", "health-state"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", health.STORE)
    for n in range(_PARTS):
        # As a log grows: the stream takes up where it stopped, and what came meanwhile is one micro-batch, however many files hold it.
        events.filter(part == n).write.parquet(f"{folder}/part={n}")
        stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(folder)
        health.save_health(health.live_health(_attempts(stream), delay=f"{_LATE} seconds"), out, state).awaitTermination()
    updates = health.latest_health(spark.read.option("recursiveFileLookup", True).parquet(out))
    names = ["provider", "success_count", "failure_count", "consecutive_failures", "latency_score", "last_error_type", "health_status", "cooldown_until", "on_cooldown"]
    return updates.select(*names).withColumn("latency_score", F.round("latency_score", 6)).withColumn("cooldown_until", F.round("cooldown_until", 3))


@query("stream_dead_letters", f"""
WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS job_id, {_case('event_type', _LOG_EVENT)} AS event FROM events),
l AS (SELECT *, '{{"job_id":"' || job_id || '","event":"' || event || '","segment_id":"' || event_id || '"' AS line FROM e)
SELECT CASE WHEN event_id % 7 <> 3 THEN job_id END AS job_id, CASE WHEN event_id % 7 <> 3 THEN event END AS event, CASE WHEN event_id % 7 <> 3 THEN CAST(event_id AS VARCHAR) END AS segment_id,
  CASE WHEN event_id % 7 = 3 THEN line END AS line FROM l WHERE event IS NOT NULL
""")
def stream_dead_letters(spark, sf):
    """A log in several files, some of its lines cut short: good rows and dead letters of the stream."""
    event = _pick(F.col("event_type"), _LOG_EVENT)
    cut = F.concat(F.lit('{"job_id":"'), F.col("user_id"), F.lit('","event":"'), event, F.lit('","segment_id":"'), F.col("event_id"), F.lit('"'))
    lines = table(spark, sf, "events").filter(event.isNotNull()).select(F.when(F.col("event_id") % 7 == 3, cut).otherwise(F.concat(cut, F.lit("}"))).alias("value"))
    log, good, bad = (new_shared_path(spark, label) for label in ("log-files", "log-good", "log-bad"))
    lines.repartition(5).write.text(log)
    schema = "job_id STRING, event STRING, segment_id STRING"
    dead_letters.split(dead_letters.read_lines(spark, log, schema, max_files=2), good, bad, new_shared_path(spark, "log-state")).awaitTermination()
    none = F.lit(None).cast("string")
    kept = dead_letters.read_good(spark, good, schema).withColumn("line", none)
    return kept.unionByName(dead_letters.read_bad(spark, bad).select(none.alias("job_id"), none.alias("event"), none.alias("segment_id"), "line"))


@query("stream_memory", f"""
WITH {TM_SQL}, i AS (SELECT doc_id, lang, text, {seg_hash('lang', "'vi'", 'text')} AS h, CASE WHEN n_chars % 50 = 0 THEN ' ' ELSE 'new ' || text END AS translated FROM documents),
s AS (SELECT lang, h, arg_max(translated, doc_id) AS translated, min(doc_id) AS first_no, max(doc_id) AS last_no FROM i
  WHERE {strip('translated')} <> '' AND {strip('text')} <> '' AND NOT {any_of('lower(translated)', V.FAILED_TRANSLATION_MARKS)} GROUP BY 1, 2),
m AS (SELECT tm.id, coalesce(tm.source_lang, s.lang) AS source_lang, coalesce(tm.h, s.h) AS h, coalesce(s.translated, tm.translated_text) AS translated, first_no,
  coalesce(TIMESTAMP '2024-01-01' + to_seconds(tm.id), TIMESTAMP '2024-03-01' + to_seconds(first_no)) AS created_at,
  coalesce(TIMESTAMP '2024-03-01' + to_seconds(last_no), tm.updated_at) AS updated_at FROM tm FULL OUTER JOIN s ON tm.source_lang = s.lang AND tm.h = s.h)
SELECT coalesce(id, (SELECT max(id) FROM tm) + row_number() OVER (PARTITION BY id IS NULL ORDER BY first_no)) AS id, source_lang, h AS source_text_hash, md5(translated) AS digest,
  0::BIGINT AS hit_count, created_at, updated_at FROM m
""")
def stream_memory(spark, sf):
    docs = stream_of(spark, sf, "documents")
    saves = docs.select(
        F.col("lang").alias("source_lang"), F.lit("vi").alias("target_lang"), F.col("text").alias("source_text"),
        F.when(F.col("n_chars") % 50 == 0, " ").otherwise(F.concat(F.lit("new "), F.col("text"))).alias("translated_text"), F.lit("p").alias("provider"), F.lit("m").alias("model"),
        F.timestamp_seconds(F.lit(1709251200) + F.col("doc_id")).alias("saved_at"), F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("save_no"),
    )
    deltas = new_shared_path(spark, "memory-deltas")
    memory_sink.save_stream(saves, deltas, new_shared_path(spark, "memory-state")).awaitTermination()
    memory = memory_sink.fold(memory_table(spark, sf), memory_sink.read_deltas(spark, deltas))
    return memory.select("id", "source_lang", "source_text_hash", F.md5("translated_text").alias("digest"), "hit_count", "created_at", "updated_at")

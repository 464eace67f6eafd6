"""Segment, job and provider queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs as J
from ..operators import providers as P
from ..operators import segments as S
from ..sources import files
from .base import LINES, query, strip, table, text, texts
from .text_queries import _skip_sql, document_lines, error_class_sql

# --- segments -----------------------------------------------------------------------------

_CELL_SQL = (
    "cells AS (SELECT l_orderkey AS file, l_returnflag AS sheet, l_linenumber AS r, CAST(l_suppkey AS INTEGER) AS c, "
    "CASE WHEN l_tax = 0 THEN NULL WHEN l_tax = 0.01 THEN '  ' WHEN l_tax = 0.02 THEN '=SUM(A1)' ELSE l_linestatus || ' text ' || l_partkey END AS v, "
    "CASE WHEN l_discount = 0.05 THEN 'number' ELSE 'string' END AS t, l_discount = 0.06 AS f, l_discount = 0.07 AS m FROM lineitem)"
)


@query("translatable_cells", f"""
WITH {_CELL_SQL}
SELECT file, sheet || '!R' || r || 'C' || c AS segment_id, v AS value FROM cells
WHERE t = 'string' AND v IS NOT NULL AND NOT f AND NOT m AND v[1] <> '=' AND trim(v) <> ''
""")
def translatable_cells(spark, sf):
    lines = table(spark, sf, "lineitem")
    value = (
        F.when(F.col("l_tax") == 0, F.lit(None).cast("string")).when(F.col("l_tax") == 0.01, "  ").when(F.col("l_tax") == 0.02, "=SUM(A1)")
        .otherwise(F.concat(F.col("l_linestatus"), F.lit(" text "), F.col("l_partkey")))
    )
    cells = lines.select(
        F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("sheet"), F.col("l_linenumber").alias("row"),
        F.col("l_suppkey").cast("int").alias("col"), value.alias("value"),
        F.when(F.col("l_discount") == 0.05, "number").otherwise("string").alias("value_type"),
        (F.col("l_discount") == 0.06).alias("is_formula"), (F.col("l_discount") == 0.07).alias("is_merged_child"),
    )
    return S.translatable_cells(cells).select("file", "segment_id", "value")


@query("page_batches", f"""
WITH {LINES}, pages_of AS (SELECT DISTINCT doc_id, ln // 5 AS page_index FROM doc_lines),
b AS (SELECT doc_id, page_index // 4 AS batch_no, count(*) AS pages, min(page_index) AS first_page, max(page_index) AS last_page FROM pages_of GROUP BY 1, 2)
SELECT *, CASE WHEN pages = 1 THEN 1 WHEN pages <= 4 THEN 2 ELSE 3 END AS grid_cols,
  CASE WHEN pages <= 2 THEN 1 WHEN pages <= 6 THEN 2 ELSE 3 END AS grid_rows FROM b
""")
def page_batches(spark, sf):
    pages = document_lines(spark, sf).select("doc_id", F.floor(F.col("ln") / 5).alias("page_index")).distinct()
    return S.page_batches(pages, ["doc_id"], 4)


@query("latest_n_per_folder", """
WITH m AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS rank
  FROM events WHERE value >= 10)
SELECT event_id AS message_id, user_id AS owner, event_type AS folder, ts AS received, CAST(rank AS INTEGER) AS rank FROM m WHERE rank <= 5
""")
def latest_n_per_folder(spark, sf):
    messages = table(spark, sf, "events").select(
        F.col("event_id").alias("message_id"), F.col("user_id").alias("owner"), F.col("event_type").alias("folder"),
        (F.col("value") >= 10).alias("unread"), F.col("ts").alias("received"),
    )
    return S.newest_unread(messages, 5, ("owner", "folder")).drop("unread")


_LOCATIONS = ["body", "table", "nested_table", "header", "footer", "textbox", "unsupported"]


@query("coverage_report", f"""
WITH {LINES}, s AS (SELECT doc_id, {text(str(_LOCATIONS)).replace("'[", "[").replace("]'", "]").replace("''", "'")}[CAST(ln % 7 AS INTEGER) + 1] AS location, {strip('line')} AS s FROM doc_lines),
r AS (SELECT *, {_skip_sql('word')} AS reason, length(s) % 3 <> 0 AS good FROM s),
loc AS (SELECT doc_id, string_agg(location || '=' || n, ',' ORDER BY location) AS by_location FROM (SELECT doc_id, location, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1),
why AS (SELECT doc_id, string_agg(reason || '=' || n, ',' ORDER BY reason) AS skip_reasons FROM (SELECT doc_id, reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, count(*) AS total_candidates, count(*) FILTER (WHERE reason IS NULL AND good) AS translated_candidates,
  count(*) FILTER (WHERE reason IS NOT NULL) AS skipped_candidates, count(*) FILTER (WHERE reason IS NULL AND NOT good) AS failed_candidates,
  any_value(by_location) AS by_location, coalesce(any_value(skip_reasons), '') AS skip_reasons
FROM r LEFT JOIN loc USING (doc_id) LEFT JOIN why USING (doc_id) GROUP BY doc_id
""")
def coverage_report(spark, sf):
    from ..functions.linguistic import skip_reason
    from ..functions.text import strip as strip_text

    locations = F.array(*[F.lit(x) for x in _LOCATIONS])
    targets = document_lines(spark, sf).select(
        "doc_id", F.get(locations, F.col("ln") % 7).alias("location"), skip_reason(F.col("line")).alias("skip_reason"),
        F.when(F.length(strip_text(F.col("line"))) % 3 != 0, "translated").otherwise("failed").alias("outcome"),
    ).withColumn("can_translate", F.col("skip_reason").isNull())
    return S.coverage(targets, ["doc_id"]).withColumn("by_location", labels(F.col("by_location"))).withColumn("skip_reasons", labels(F.col("skip_reasons")))


def labels(counts):
    """A count map as text, so that both engines show it the same way."""
    entries = F.transform(F.map_entries(F.coalesce(counts, F.create_map().cast("map<string,bigint>"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(entries), ",")


@query("fragmented_runs", f"""
WITH {LINES}, runs AS (SELECT doc_id, ln, unnest(string_split(line, ',')) AS run FROM doc_lines), s AS (SELECT doc_id, ln, {strip('run')} AS s FROM runs),
r AS (SELECT *, {_skip_sql('word')} AS reason FROM s)
SELECT doc_id, ln, count(*) AS runs, count(*) FILTER (WHERE reason IS NULL) AS eligible_runs,
  count(*) FILTER (WHERE reason IS NULL) >= 2 AND NOT bool_or(s <> '' AND reason IS NOT NULL)
    AND coalesce(sum(length(s)) FILTER (WHERE reason IS NULL), 0) >= 20 AS as_block
FROM r GROUP BY doc_id, ln
""")
def fragmented_runs(spark, sf):
    runs = document_lines(spark, sf).select("doc_id", "ln", F.explode(F.split("line", ",", -1)).alias("text"), F.lit(False).alias("has_field"))
    grouped = S.fragmented_paragraphs(runs, ["doc_id", "ln"])
    return grouped.select("doc_id", F.col("ln").cast("bigint").alias("ln"), "runs", "eligible_runs", "as_block")


def batch_stub(text_: str, source: str, target: str) -> dict:
    """Drops one delimiter when the request is long, as a careless translator would."""
    out = text_.replace("e", "E")
    return {"text": out.replace("|||TXSEP|||", " ", 1) if len(text_) > 3000 else out}


@query("super_batch_split", f"""
WITH t AS (SELECT conv_id, turn, turn // 4 AS batch_no, {strip('text')} AS text FROM conversations WHERE {strip('text')} <> '' AND lower(text) NOT IN ('nan', 'none')),
b AS (SELECT conv_id, batch_no, count(*) AS n, sum(length(text)) + 11 * (count(*) - 1) AS chars FROM t GROUP BY 1, 2)
SELECT conv_id, batch_no, turn AS position, NOT (n > 1 AND chars > 3000) AS split_ok,
  md5(CASE WHEN n > 1 AND chars > 3000 THEN text ELSE replace(text, 'e', 'E') END) AS digest FROM t JOIN b USING (conv_id, batch_no)
""")
def super_batch_split(spark, sf):
    turns = texts(spark, sf, "conversations").select("conv_id", "turn", "text")
    out = S.translate_super_batches(turns, ["conv_id"], "turn", 4, batch_stub, "auto", "vi")
    return out.select("conv_id", "batch_no", "position", "split_ok", F.md5("result").alias("digest"))


@query("restore_originals", """
SELECT c.conv_id, c.turn, md5(CASE WHEN c.role = 'user' THEN 'ok ' || c.text ELSE c.text END) AS digest FROM conversations c
""")
def restore_originals(spark, sf):
    turns = texts(spark, sf, "conversations")
    results = turns.filter("role = 'user'").select("conv_id", "turn", F.concat(F.lit("ok "), F.col("text")).alias("result"))
    out = S.restore_originals(turns, results, ["conv_id", "turn"])
    return out.select("conv_id", "turn", F.md5("result").alias("digest"))


# --- jobs: an order is a job, its lines are segments -----------------------------------------

_STATUS = {"F": "completed", "O": "running", "P": "failed"}
_EVENT = {"A": "segment_completed", "R": "segment_failed", "N": "segment_started"}


def _pick(column, entries):
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])[column]


def orders_as_jobs(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"), _pick(F.col("o_orderstatus"), _STATUS).alias("status"),
        (F.col("o_custkey") % 9).cast("int").alias("total_segments"), F.col("o_orderpriority").alias("job_type"),
    )


def lines_as_checkpoints(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("segment_id"), _pick(F.col("l_returnflag"), _EVENT).alias("event"),
        F.col("l_shipdate").alias("timestamp"), F.col("l_quantity").alias("quantity"),
    )


def _case(x, entries):
    return "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in entries.items()) + " END"


JOBS_SQL = f"""
jobs AS (SELECT o_orderkey AS job_id, o_orderdate AS created_at, {_case('o_orderstatus', _STATUS)} AS status, CAST(o_custkey % 9 AS INTEGER) AS total_segments, o_orderpriority AS job_type FROM orders),
cp AS (SELECT l_orderkey AS job_id, l_linenumber AS segment_id, {_case('l_returnflag', _EVENT)} AS event, l_quantity AS quantity FROM lineitem),
counted AS (SELECT job_id, count(*) FILTER (WHERE event = 'segment_completed') AS completed, count(*) FILTER (WHERE event = 'segment_failed') AS failed FROM cp GROUP BY 1),
progress AS (SELECT j.*, coalesce(completed, 0) AS completed_segments, coalesce(failed, 0) AS failed_segments,
  CASE WHEN total_segments > 0 THEN round(least(100.0::DOUBLE, (coalesce(completed, 0) + coalesce(failed, 0))::DOUBLE / total_segments * 100.0::DOUBLE), 2)
       WHEN status = 'completed' THEN 100.0 ELSE 0.0 END AS percent FROM jobs j LEFT JOIN counted USING (job_id))
"""


@query("job_progress", f"WITH {JOBS_SQL} SELECT job_id, status, total_segments, completed_segments, failed_segments, percent FROM progress")
def job_progress(spark, sf):
    out = J.progress(orders_as_jobs(spark, sf), lines_as_checkpoints(spark, sf))
    return out.select("job_id", "status", "total_segments", "completed_segments", "failed_segments", "percent")


@query("job_summary", f"""
WITH {JOBS_SQL}, e AS (SELECT job_id, count(*) AS n FROM cp WHERE event = 'segment_failed' AND quantity >= 10 GROUP BY 1)
SELECT job_id, status, percent, coalesce(n, 0) AS failed_item_count, status IN ('pending', 'running', 'paused', 'failed') AS can_resume
FROM progress LEFT JOIN e USING (job_id)
""")
def job_summary(spark, sf):
    cp = lines_as_checkpoints(spark, sf)
    failed = cp.filter("event = 'segment_failed' AND quantity >= 10")
    return J.summary(orders_as_jobs(spark, sf), cp, failed).select("job_id", "status", "percent", "failed_item_count", "can_resume")


@query("job_deltas", """
SELECT l_orderkey AS job_id, l_returnflag AS counter, greatest(CAST(sum(CAST(l_quantity AS BIGINT) - 20) AS BIGINT), 0) AS value FROM lineitem GROUP BY 1, 2
""")
def job_deltas(spark, sf):
    deltas = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_returnflag").alias("counter"), (F.col("l_quantity").cast("bigint") - 20).alias("delta")
    )
    return J.apply_deltas(deltas)


@query("resume_set", f"""
WITH {JOBS_SQL}, done AS (SELECT DISTINCT job_id, segment_id FROM cp WHERE event = 'segment_completed')
SELECT DISTINCT cp.job_id, cp.segment_id FROM cp JOIN jobs USING (job_id) LEFT JOIN done ON done.job_id = cp.job_id AND done.segment_id = cp.segment_id
WHERE status IN ('pending', 'running', 'paused', 'failed') AND done.job_id IS NULL
""")
def resume_set(spark, sf):
    cp = lines_as_checkpoints(spark, sf)
    segments = cp.select("job_id", "segment_id").distinct()
    return J.segments_to_resume(segments, orders_as_jobs(spark, sf), cp)


@query("retry_set", """
SELECT l_orderkey AS job_id, l_linenumber AS segment_id, greatest(CAST(l_quantity AS INTEGER) - 10, 0) + 1 AS retry_count, l_extendedprice AS price
FROM lineitem WHERE l_returnflag = 'R'
""")
def retry_set(spark, sf):
    errors = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("segment_id"), (F.col("l_quantity").cast("int") - 10).alias("retry_count"),
        F.col("l_extendedprice").alias("price"),
    )
    return J.retry_items(errors)


@query("newest_jobs", f"WITH {JOBS_SQL} SELECT job_id, created_at, status FROM jobs ORDER BY created_at DESC, job_id LIMIT 50")
def newest_jobs(spark, sf):
    return J.newest_jobs(orders_as_jobs(spark, sf)).select("job_id", "created_at", "status")


@query("jsonl_log", """
WITH l AS (SELECT event_id, CASE WHEN event_id % 10 = 3 THEN left(props, 4) WHEN event_id % 10 = 7 THEN '  ' ELSE props END AS value FROM events)
SELECT event_id, CAST(regexp_extract(value, '"k": ([0-9]+)\\}', 1) AS INTEGER) AS k FROM l WHERE regexp_matches(value, '^\\{"k": [0-9]+\\}$')
""")
def jsonl_log(spark, sf):
    events = table(spark, sf, "events")
    line = F.when(F.col("event_id") % 10 == 3, F.left("props", F.lit(4))).when(F.col("event_id") % 10 == 7, "  ").otherwise(F.col("props"))
    return files.parse_jsonl(events.select("event_id", line.alias("value")), "k INT")


_LOG_EVENT = {"signup": "segment_started", "click": "segment_completed", "error": "segment_failed", "view": "tm_hit", "purchase": "provider_success"}


@query("checkpoint_log", f"""
SELECT event_id, user_id AS job_id, {_case('event_type', _LOG_EVENT)} AS event,
  left(regexp_replace('api_key=' || props || ' AIzaSyA' || event_id || 'BCDEFGH tail', '(?i)\\b(?:gemini|google)?[_-]?api[_-]?key\\b\\s*[:=]\\s*[^\\s,;]+', '[REDACTED_API_KEY]', 'g')
     .regexp_replace('AIza[0-9A-Za-z\\-_]{{8,}}', '[REDACTED_API_KEY]', 'g'), 500) AS error_message, '' AS model
FROM events WHERE event_type <> 'view'
""")
def checkpoint_log(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("job_id"), _pick(F.col("event_type"), _LOG_EVENT).alias("event"),
        F.concat(F.lit("api_key="), F.col("props"), F.lit(" AIzaSyA"), F.col("event_id"), F.lit("BCDEFGH tail")).alias("error_message"),
        F.lit(None).cast("string").alias("model"),
    )
    return files.prepare_checkpoints(events)


@query("failed_item_log", """
SELECT doc_id AS segment_id, source AS job_id, left(text, 500) AS error_message, CASE WHEN n_chars % 3 = 0 THEN 0 ELSE CAST(n_chars % 3 AS INTEGER) - 1 END AS retry_count,
  CAST(n_chars AS INTEGER) AS source_length FROM documents
""")
def failed_item_log(spark, sf):
    items = texts(spark, sf).select(
        F.col("doc_id").alias("segment_id"), F.col("source").alias("job_id"), F.col("text").alias("error_message"),
        (F.col("n_chars") % 3 - 1).cast("int").alias("retry_count"), F.col("n_chars").cast("int").alias("source_length"),
    )
    return files.prepare_failed_items(items)


# --- providers: a user is a provider, an event is an attempt ----------------------------------

_MESSAGES = ["HTTP 429 quota exceeded", "request timed out", "401 Unauthorized", "503 service unavailable", "context length exceeded", "strange"]


def attempts_of(spark, sf):
    kind = F.col("event_type")
    message = F.get(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col("event_id") % 6).cast("int"))
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("provider"), F.col("event_id").alias("attempt_no"), "ts",
        F.when(kind == "error", "failed").when(kind == "signup", "skipped").otherwise("success").alias("status"),
        F.when(kind == "error", message).alias("error_type"),
        F.when(kind == "view", 0.0).otherwise(F.floor(F.col("value")).cast("double")).alias("latency_ms"),
    )


ATTEMPTS_SQL = f"""
attempts AS (SELECT CAST(user_id AS VARCHAR) AS provider, event_id AS attempt_no, ts,
   CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'success' END AS status,
   CASE WHEN event_type = 'error' THEN lower({_MESSAGES}[CAST(event_id % 6 AS INTEGER) + 1]) END AS m,
   CASE WHEN event_type = 'view' THEN 0.0 ELSE floor(value) END AS latency_ms FROM events),
real AS (SELECT *, CASE WHEN status = 'failed' THEN {error_class_sql('m')} END AS class, row_number() OVER (PARTITION BY provider ORDER BY ts, attempt_no) AS n FROM attempts WHERE status <> 'skipped'),
ewma AS (SELECT provider, list_reduce(list(CAST(latency_ms AS DOUBLE) ORDER BY n), lambda acc, x: acc * 0.8 + x * 0.2) AS score FROM real WHERE latency_ms > 0 GROUP BY provider),
fold AS (SELECT provider, count(*) FILTER (WHERE status = 'success') AS success_count, count(*) FILTER (WHERE status = 'failed') AS failure_count,
   max(n) - coalesce(max(n) FILTER (WHERE status = 'success'), 0) AS consecutive_failures, arg_max(status, n) AS last_status, arg_max(coalesce(class, ''), n) AS last_class,
   max(ts) AS last_ts, arg_max(class, n) FILTER (WHERE status = 'failed') AS last_error_class, arg_max(latency_ms, n) AS last_latency_ms,
   arg_max(coalesce(class, 'healthy'), n) FILTER (WHERE status = 'success' OR class IN ('auth_failure', 'quota_rate_limit', 'token_limit', 'timeout', 'provider_5xx')) AS health_class
   FROM real GROUP BY provider),
states AS (SELECT provider, success_count, failure_count, consecutive_failures, last_class AS last_error_type, coalesce(last_error_class, '') AS last_error_class,
   CAST(last_latency_ms AS DOUBLE) AS last_latency_ms, round(coalesce(score, 0), 6) AS latency_score,
   CASE WHEN health_class IS NULL OR health_class = 'healthy' THEN 'healthy' WHEN health_class = 'auth_failure' THEN 'dead' WHEN health_class IN ('quota_rate_limit', 'token_limit') THEN 'cooldown' ELSE 'degraded' END AS health_status,
   CASE WHEN last_status = 'failed' THEN last_ts + INTERVAL 300 SECOND END AS cooldown_until,
   coalesce(last_status = 'failed' AND last_ts + INTERVAL 300 SECOND > TIMESTAMP '2024-01-30 20:00:00', FALSE) AS on_cooldown,
   NOT (last_status = 'failed' AND last_class = 'auth_failure') AS state_available FROM fold LEFT JOIN ewma USING (provider))
"""

AS_OF = "2024-01-30 20:00:00"


def states_of(spark, sf):
    return P.provider_states(attempts_of(spark, sf), AS_OF, keys=["provider"])


@query("attempt_health", f"WITH {ATTEMPTS_SQL} SELECT *, state_available AND NOT on_cooldown AS is_available FROM states")
def attempt_health(spark, sf):
    return states_of(spark, sf).withColumn("latency_score", F.round("latency_score", 6))


_MODELS_SQL = ATTEMPTS_SQL.replace("CAST(user_id AS VARCHAR) AS provider", "user_id || '/' || event_id % 3 || '/' || event_id // 3 % 2 AS provider")
_STATE_PARTS = "split_part(provider, '/', 1) AS provider, CASE WHEN split_part(provider, '/', 2) <> '0' THEN 'm' || split_part(provider, '/', 2) END AS model, CAST(split_part(provider, '/', 3) AS INTEGER) AS key_index"


def model_states(spark, sf):
    """States per provider, model and key; a third of the attempts name no model."""
    attempts = attempts_of(spark, sf)
    model, key = F.col("attempt_no") % 3, F.floor(F.col("attempt_no") / 3) % 2
    return P.provider_states(attempts.withColumns({"model": F.when(model != 0, F.concat(F.lit("m"), model)), "key_index": key.cast("int")}), AS_OF)


@query("attempt_health_models", f"WITH {_MODELS_SQL} SELECT {_STATE_PARTS}, * EXCLUDE (provider), state_available AND NOT on_cooldown AS is_available FROM states")
def attempt_health_models(spark, sf):
    return model_states(spark, sf).withColumn("latency_score", F.round("latency_score", 6))


@query("provider_rank_models", f"""
WITH {_MODELS_SQL}, s AS (SELECT {_STATE_PARTS}, * EXCLUDE (provider) FROM states),
r AS (SELECT provider, bool_or(state_available) AS any_available, bool_and(on_cooldown) AS all_cooling, CASE WHEN bool_or(health_status = 'healthy') THEN 'healthy' WHEN bool_or(health_status = 'degraded') THEN 'degraded'
   WHEN bool_or(health_status = 'cooldown') THEN 'cooldown' ELSE 'dead' END AS health_status, 5.0::DOUBLE AS quality, round(coalesce(avg(latency_score) FILTER (WHERE latency_score > 0), 500.0), 4) AS latency FROM s GROUP BY provider),
q AS (SELECT *, CASE WHEN NOT any_available THEN 4 WHEN all_cooling THEN 3 WHEN health_status = 'degraded' THEN 1 ELSE 0 END AS status_rank FROM r)
SELECT *, row_number() OVER (ORDER BY status_rank, quality DESC, latency, provider) AS rank FROM q
""")
def provider_rank_models(spark, sf):
    """Several states per provider roll up into its rank."""
    states = model_states(spark, sf).withColumn("latency_score", F.round("latency_score", 6))
    return P.rank_providers(states, decimals=4)


@query("latency_ewma", """
SELECT event_type, round(list_reduce(list(value ORDER BY ts, event_id), lambda acc, x: acc * 0.8 + x * 0.2), 6) AS latency_score, count(*) AS attempts FROM events GROUP BY event_type
""")
def latency_ewma(spark, sf):
    """Few keys with very many rows each: every key spans several chunks."""
    attempts = table(spark, sf, "events").select(
        F.col("event_type").alias("provider"), F.col("event_id").alias("attempt_no"), "ts", F.lit("success").alias("status"),
        F.lit(None).cast("string").alias("error_type"), F.col("value").alias("latency_ms"),
    )
    out = P.provider_states(attempts, AS_OF, keys=["provider"])
    return out.select(F.col("provider").alias("event_type"), F.round("latency_score", 6).alias("latency_score"), F.col("success_count").alias("attempts"))


@query("cooldown_reset", f"""
WITH {ATTEMPTS_SQL} SELECT provider, success_count, failure_count, 0::BIGINT AS consecutive_failures, 'healthy' AS health_status, true AS is_available FROM states
""")
def cooldown_reset(spark, sf):
    out = P.reset_cooldowns(states_of(spark, sf))
    return P.health_snapshot(out.withColumn("model", F.lit(""))).select(
        "provider", "success_count", "failure_count", "consecutive_failures", "health_status", "is_available"
    )


@query("provider_rank", f"""
WITH {ATTEMPTS_SQL}, r AS (SELECT provider, state_available AS any_available, on_cooldown AS all_cooling, health_status,
  CASE WHEN NOT state_available THEN 4 WHEN on_cooldown THEN 3 WHEN provider = '7' THEN 2 WHEN health_status = 'degraded' THEN 1 ELSE 0 END AS status_rank,
  5.0::DOUBLE AS quality, CASE WHEN latency_score > 0 THEN latency_score ELSE 500.0 END AS latency FROM states)
SELECT *, row_number() OVER (ORDER BY status_rank, quality DESC, latency, provider) AS rank FROM r
""")
def provider_rank(spark, sf):
    # Scores are rounded first, so that both engines see the same order.
    states = states_of(spark, sf).withColumn("latency_score", F.round("latency_score", 6))
    return P.rank_providers(states, last_resort="7")


@query("attempt_events", f"""
WITH a AS (SELECT CAST(user_id AS VARCHAR) AS request_id, event_id AS ord, event_type AS provider, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'm' || event_id % 3 END AS model,
   CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'success' END AS status, {_MESSAGES}[CAST(event_id % 6 AS INTEGER) + 1] AS message, CAST(floor(value) AS INTEGER) AS latency_ms FROM events),
r AS (SELECT * FROM a WHERE status <> 'skipped')
SELECT request_id, ord, provider, 'en' AS source_lang, 'vi' AS target_lang, 0 AS event_no, 'provider_call' AS event, NULL AS model, NULL AS key_index, NULL AS error_type, NULL AS error_message, NULL AS latency_ms FROM r
UNION ALL SELECT request_id, ord, provider, 'en', 'vi', 1, CASE WHEN status = 'failed' THEN 'provider_fail' ELSE 'provider_success' END, coalesce(model, ''), -1,
   CASE WHEN status = 'failed' THEN '' END, CASE WHEN status = 'failed' THEN message END, CASE WHEN status = 'success' THEN latency_ms END FROM r
""")
def attempt_events(spark, sf):
    kind, message = F.col("event_type"), F.get(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col("event_id") % 6).cast("int"))
    attempts = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("request_id"), F.col("event_id").alias("ord"), kind.alias("provider"),
        F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("m"), F.col("event_id") % 3)).alias("model"), F.lit(None).cast("int").alias("key_index"),
        F.when(kind.isin("error", "view"), "failed").when(kind == "signup", "skipped").otherwise("success").alias("status"), F.lit(None).cast("string").alias("error_type"),
        message.alias("message"), F.floor("value").cast("int").alias("latency_ms"), F.lit("en").alias("source_lang"), F.lit("vi").alias("target_lang"),
    )
    return P.attempt_events(attempts)


@query("waterfall_outcome", """
WITH a AS (SELECT user_id || '/' || CAST(ts AS DATE) AS request_id, event_id AS ord, event_type AS provider,
   CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'success' END AS status, CAST(floor(value) AS INTEGER) AS latency_ms FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ord) AS attempt FROM a WHERE status <> 'skipped'),
k AS (SELECT *, min(attempt) FILTER (WHERE status = 'success') OVER (PARTITION BY request_id) AS won, max(attempt) OVER (PARTITION BY request_id) AS last FROM t WHERE attempt <= 3)
SELECT request_id, CASE WHEN max(won) IS NULL THEN 'error' ELSE 'success' END AS status, max(provider) FILTER (WHERE attempt = coalesce(won, last)) AS provider,
  max(latency_ms) FILTER (WHERE attempt = coalesce(won, last)) AS latency_ms, CAST(count(*) FILTER (WHERE attempt <= coalesce(won, last)) AS INTEGER) AS attempts,
  CAST(count(*) FILTER (WHERE status = 'failed' AND attempt <= coalesce(won, last)) AS INTEGER) AS fallback_count,
  string_agg(provider, '>' ORDER BY attempt) FILTER (WHERE attempt <= coalesce(won, last)) AS log
FROM k GROUP BY request_id
""")
def waterfall_outcome(spark, sf):
    kind = F.col("event_type")
    attempts = table(spark, sf, "events").select(
        F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("request_id"), F.col("event_id").alias("ord"), kind.alias("provider"),
        F.lit("m").alias("model"), F.when(kind.isin("error", "view"), "failed").when(kind == "signup", "skipped").otherwise("success").alias("status"),
        F.lit(None).cast("string").alias("error_type"), F.floor("value").cast("int").alias("latency_ms"),
    )
    out = P.waterfall_outcomes(attempts)
    log = F.array_join(F.transform("attempt_log", lambda a: a["provider"]), ">")
    return out.select("request_id", "status", "provider", "latency_ms", "attempts", "fallback_count", log.alias("log"))


@query("latest_health_checks", """
SELECT user_id AS provider_id, event_type AS model_id, arg_max(event_id, (ts, event_id)) AS check_no, arg_max(value, (ts, event_id)) AS latency_ms, max(ts) AS checked_at
FROM events GROUP BY 1, 2
""")
def latest_health_checks(spark, sf):
    checks = table(spark, sf, "events").select(
        F.col("user_id").alias("provider_id"), F.col("event_type").alias("model_id"), F.col("event_id").alias("check_no"),
        F.col("value").alias("latency_ms"), F.col("ts").alias("checked_at"),
    )
    return P.latest_checks(checks)


@query("first_models", """
SELECT * FROM (SELECT p_brand AS provider, p_partkey AS ordinal, p_name AS id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey, p_name) AS INTEGER) AS rank FROM part) WHERE rank <= 3
""")
def first_models(spark, sf):
    models = table(spark, sf, "part").select(F.col("p_brand").alias("provider"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("id"))
    return P.first_models(models, 3)


_POOL = ["gemini", "google", "groq", "mistral", "cohere"]


@query("provider_order", f"""
WITH o AS (SELECT o_orderkey, {_POOL} AS pool, [{_POOL}[CAST(o_orderkey % 5 AS INTEGER) + 1], {_POOL}[CAST(o_orderkey // 5 % 5 AS INTEGER) + 1], 'unknown', {_POOL}[CAST(o_orderkey // 7 % 5 AS INTEGER) + 1]] AS preferred FROM orders),
a AS (SELECT *, list_filter(pool, lambda x, i: (o_orderkey >> (i - 1)) & 1 = 1) AS allowed FROM o),
k AS (SELECT *, list_filter(preferred, lambda x, i: list_position(preferred, x) = i AND list_contains(allowed, x)) AS kept FROM a)
SELECT o_orderkey, array_to_string(list_concat(kept, list_filter(allowed, lambda x: NOT list_contains(kept, x))), ',') AS provider_order FROM k
""")
def provider_order(spark, sf):
    key, pool = F.col("o_orderkey"), F.array(*[F.lit(n) for n in _POOL])

    def pick(number):
        return F.get(pool, (number % 5).cast("int"))

    preferred = F.array(pick(key), pick(F.floor(key / 5)), F.lit("unknown"), pick(F.floor(key / 7)))
    allowed = F.filter(pool, lambda x, i: F.expr("o_orderkey").bitwiseAND(F.pow(F.lit(2), i).cast("bigint")) != 0)
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(P.provider_order(preferred, allowed), ",").alias("provider_order"))




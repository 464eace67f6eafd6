"""Schemas of the tables the operators take."""

from __future__ import annotations

GLOSSARY = (
    "id BIGINT, source_term STRING, target_term STRING, source_lang STRING, target_lang STRING, "
    "domain STRING, note STRING, is_active BOOLEAN"
)
TM = (
    "id BIGINT, source_lang STRING, target_lang STRING, source_text_hash STRING, source_text STRING, "
    "translated_text STRING, provider STRING, model STRING, created_at TIMESTAMP, updated_at TIMESTAMP, hit_count BIGINT"
)
SEGMENTS = "seg_id STRING, job_id STRING, source_lang STRING, target_lang STRING, text STRING"
ATTEMPTS = (
    "request_id STRING, ord INT, ts TIMESTAMP, provider STRING, model STRING, key_index INT, status STRING, "
    "error_type STRING, message STRING, latency_ms INT"
)
JOBS = (
    "job_id STRING, created_at TIMESTAMP, updated_at TIMESTAMP, status STRING, source_lang STRING, target_lang STRING, "
    "strategy STRING, input_files ARRAY<STRING>, job_type STRING, notes STRING, total_segments INT"
)
CHECKPOINTS = (
    "timestamp TIMESTAMP, job_id STRING, event STRING, file STRING, sheet STRING, cell STRING, segment_id STRING, "
    "provider STRING, model STRING, error_type STRING, error_message STRING, status STRING"
)
ERRORS = (
    "timestamp TIMESTAMP, job_id STRING, file STRING, sheet STRING, cell STRING, segment_id STRING, source_lang STRING, "
    "target_lang STRING, error_type STRING, error_message STRING, retry_count INT, source_hash STRING, source_length INT"
)
CAPABILITIES = "STRUCT<text: BOOLEAN, vision: BOOLEAN, embedding: BOOLEAN, rerank: BOOLEAN, unknown: BOOLEAN>"
MODELS = (
    f"provider STRING, ordinal INT, id STRING, label STRING, enabled BOOLEAN, source STRING, visibility STRING, "
    f"capabilities {CAPABILITIES}, discovered_at TIMESTAMP, last_validated_at TIMESTAMP, display_name STRING, "
    f"raw_metadata STRING"
)
SPAN = "STRUCT<text: STRING, font: STRING, size: DOUBLE, x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE>"
LINE = f"STRUCT<text: STRING, x0: DOUBLE, y0: DOUBLE, x1: DOUBLE, y1: DOUBLE, spans: ARRAY<{SPAN}>>"
BLOCKS = (
    "doc_id STRING, page_index INT, block_id STRING, ordinal INT, kind STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, "
    f"text STRING, lines ARRAY<{LINE}>, flags ARRAY<STRING>"
)
PAGES = "doc_id STRING, page_index INT, width DOUBLE, height DOUBLE, rotation INT"
PAGE_SAMPLES = "doc_id STRING, side STRING, page_index INT, width INT, height INT, samples ARRAY<INT>"
MESSAGES = "message_id STRING, folder STRING, unread BOOLEAN, received TIMESTAMP, subject STRING, body STRING"
TRANSLATIONS = (
    "status STRING, translated_text STRING, provider STRING, model STRING, error_type STRING, error_message STRING, "
    "latency_ms INT"
)

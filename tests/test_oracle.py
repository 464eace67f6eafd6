"""Queries give the same rows as their SQL on the smallest tables.

A selection by default; GLOSSALINE_ALL=1 runs every query with SQL (several minutes).
"""

import os

import pytest
from compare import difference, duck

from glossaline.workloads import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
SELECTED = [
    "segment_normalize_hash", "segment_duplicates", "language_signals", "skip_text_reasons", "mojibake_scan", "redact_profiles", "chunk_documents", "error_classify",
    "tm_lookup", "tm_upsert", "translate_cached", "glossary_match_topk", "glossary_edits", "super_batch_split", "coverage_report", "job_summary", "resume_set", "checkpoint_log",
    "attempt_health", "latency_ewma", "provider_rank", "waterfall_outcome", "catalog_merge", "catalog_edits", "file_manifest", "caption_links", "translation_plan", "style_runs",
    "visual_verdict", "report_merge_visual", "stream_progress", "stream_health",
]
NAMES = sorted(ORACLES) if os.environ.get("GLOSSALINE_ALL") else SELECTED


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], ORACLES[name], FOLDER) is None


def test_every_query_has_a_function():
    assert set(ORACLES) <= set(QUERIES)

"""Visual comparison and quality-report queries.

Embeddings stand for page samples: components become gray values, and consecutive vectors are a
page before and after.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as V
from ..operators import qa as Q
from ..session import new_shared_path
from .base import any_of, query, table, text
from .work_queries import labels


def page_samples(spark, sf):
    key = F.col("vec_id")
    gray = F.transform("embedding", lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 1.0) * 127.5))).cast("int"))
    pair = F.floor(key / 2)
    return table(spark, sf, "embeddings").select(
        F.floor(pair / 5).cast("string").alias("doc_id"), F.when(key % 2 == 0, "before").otherwise("after").alias("side"), (pair % 5).cast("int").alias("page_index"),
        F.when(key % 23 == 1, 4).otherwise(8).alias("width"), F.lit(8).alias("height"), gray.alias("samples"),
    )


SAMPLES_SQL = """
samples AS (SELECT CAST(vec_id // 2 // 5 AS VARCHAR) AS doc_id, CASE WHEN vec_id % 2 = 0 THEN 'before' ELSE 'after' END AS side, CAST(vec_id // 2 % 5 AS INTEGER) AS page_index,
  CASE WHEN vec_id % 23 = 1 THEN 4 ELSE 8 END AS width, 8 AS height, list_transform(embedding, lambda e: CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 1.0::DOUBLE) * 127.5::DOUBLE))) AS INTEGER)) AS s FROM embeddings),
pages_ AS (SELECT b.doc_id, b.page_index, b.width = a.width AND b.height = a.height AS dimensions_match, CASE WHEN b.width <> a.width OR len(b.s) <> len(a.s) THEN 1.0::DOUBLE WHEN len(b.s) = 0 THEN 0.0::DOUBLE
   ELSE list_sum(list_transform(list_zip(b.s, a.s), lambda p: abs(p[1] - p[2])))::DOUBLE / (len(b.s) * 255.0::DOUBLE) END AS diff_ratio,
   len(list_filter(b.s, lambda v: v < 250))::DOUBLE / (b.width * b.height) AS before_ink, len(list_filter(a.s, lambda v: v < 250))::DOUBLE / (a.width * a.height) AS after_ink
   FROM samples b JOIN samples a ON b.side = 'before' AND a.side = 'after' AND a.doc_id = b.doc_id AND a.page_index = b.page_index),
counts AS (SELECT doc_id, count(*) FILTER (WHERE side = 'before') AS page_count_before, count(*) FILTER (WHERE side = 'after') AS page_count_after FROM samples GROUP BY 1),
diffs AS (SELECT doc_id, page_count_before, page_count_after, page_count_before = page_count_after AS page_count_match, coalesce(count(p.page_index), 0) AS pages_compared, count(*) FILTER (WHERE NOT dimensions_match) AS dimension_mismatches,
   coalesce(avg(diff_ratio), 0) AS mean_diff_ratio, coalesce(max(diff_ratio), 0) AS max_diff_ratio, avg(before_ink) AS ink_before, avg(after_ink) AS ink_after FROM counts LEFT JOIN pages_ p USING (doc_id) GROUP BY 1, 2, 3),
reasons AS (SELECT *, CASE WHEN NOT page_count_match THEN 'page_count_mismatch' END AS f1, CASE WHEN dimension_mismatches > 0 THEN 'page_dimension_mismatch' END AS f2, CASE WHEN mean_diff_ratio >= 0.08 THEN 'high_mean_visual_diff' END AS f3,
   CASE WHEN mean_diff_ratio < 0.08 AND mean_diff_ratio >= 0.06 THEN 'high_mean_visual_diff' END AS w1, CASE WHEN max_diff_ratio >= 0.6 THEN 'high_max_visual_diff' END AS f4, CASE WHEN max_diff_ratio < 0.6 AND max_diff_ratio >= 0.075 THEN 'high_max_visual_diff' END AS w2 FROM diffs),
verdicts AS (SELECT *, list_filter([f1, f2, f3, f4], lambda x: x IS NOT NULL) AS failures, list_filter([w1, w2], lambda x: x IS NOT NULL) AS warns FROM reasons),
judged AS (SELECT *, CASE WHEN len(failures) > 0 THEN 'fail' WHEN len(warns) > 0 THEN 'warning' ELSE 'pass' END AS visual_status FROM verdicts)
"""


@query("page_diffs", f"WITH {SAMPLES_SQL} SELECT doc_id, page_index, dimensions_match, round(diff_ratio, 6) AS diff_ratio, before_ink AS before_non_white_ratio, after_ink AS after_non_white_ratio FROM pages_")
def page_diffs(spark, sf):
    out = Q.page_diffs(page_samples(spark, sf))
    return out.select("doc_id", "page_index", "dimensions_match", F.round("diff_ratio", 6).alias("diff_ratio"), "before_non_white_ratio", "after_non_white_ratio")


@query("visual_diff", f"""
WITH {SAMPLES_SQL} SELECT doc_id, page_count_before, page_count_after, page_count_match, pages_compared, dimension_mismatches, round(mean_diff_ratio, 6) AS mean_diff_ratio, round(max_diff_ratio, 6) AS max_diff_ratio,
  round(ink_before, 6) AS ink_before, array_to_string(list_filter([CASE WHEN NOT page_count_match THEN 'page_count_mismatch' END, CASE WHEN dimension_mismatches > 0 THEN 'page_dimension_mismatch' END], lambda x: x IS NOT NULL), ',') AS warnings FROM diffs
""")
def visual_diff(spark, sf):
    out = Q.document_diffs(page_samples(spark, sf))
    return out.select(
        "doc_id", "page_count_before", "page_count_after", "page_count_match", "pages_compared", "dimension_mismatches", F.round("mean_diff_ratio", 6).alias("mean_diff_ratio"),
        F.round("max_diff_ratio", 6).alias("max_diff_ratio"), F.round("mean_non_white_ratio_before", 6).alias("ink_before"), F.array_join("warnings", ",").alias("warnings"),
    )


_LIMITS = {"warning_mean": 0.06, "fail_mean": 0.08, "warning_max": 0.075}


def verdicts_of(spark, sf):
    return Q.evaluate(Q.document_diffs(page_samples(spark, sf)), **_LIMITS)


@query("visual_verdict", f"WITH {SAMPLES_SQL} SELECT doc_id, visual_status, array_to_string(failures, ',') AS visual_failures, array_to_string(warns, ',') AS visual_warnings FROM judged")
def visual_verdict(spark, sf):
    out = verdicts_of(spark, sf)
    return out.select("doc_id", "visual_status", F.array_join("visual_failures", ",").alias("visual_failures"), F.array_join("visual_warnings", ",").alias("visual_warnings"))


# Reports: one per pair of page sides, with counters from the orders of a customer.
def reports(spark, sf):
    """A report per customer: counters and labels from its orders."""
    orders = table(spark, sf, "orders")
    per_label = orders.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    per_doc = per_label.groupBy("o_custkey").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("w "), F.col("o_orderpriority")), "n")))).alias("warnings_by_type"),
        F.sum("n").alias("warning_count"),
    )
    key = F.col("c_custkey")
    rows = table(spark, sf, "customer").join(per_doc, F.col("o_custkey") == key, "left").drop("o_custkey")
    return rows.select(
        key.cast("string").alias("doc_id"), F.concat(F.lit("/in/"), F.col("c_mktsegment"), F.lit("/"), F.col("c_name"), F.lit(".pdf")).alias("input_file"),
        F.concat(F.lit("C:\\out\\"), F.col("c_name"), F.lit("_translated.pdf")).alias("output_file"), F.lit("experimental").alias("mode"),
        (key % 7).alias("overflow_units"), (key % 5).alias("overflow_blocks"), F.coalesce("warnings_by_type", F.create_map().cast("map<string,bigint>")).alias("warnings_by_type"),
        F.coalesce("warning_count", F.lit(0)).alias("warning_count"), F.create_map(F.lit("paragraph"), key % 3, F.lit("prompt_kind"), key % 2).alias("unit_types_by_kind"),
        F.create_map(F.lit("table"), F.lit(1).cast("bigint")).alias("protected_regions_by_kind"), F.lit(None).cast("string").alias("visual_status"),
        F.array().cast("array<string>").alias("visual_warnings"), F.array().cast("array<string>").alias("visual_failures"),
        F.lit(None).cast("double").alias("mean_diff_ratio"), F.lit(None).cast("double").alias("max_diff_ratio"),
        F.when(key % 4 == 0, F.concat(F.lit("leaked with Bearer "), F.col("c_name"))).when(key % 4 == 1, F.col("c_mktsegment")).alias("rejection_reason"),
    )


def fit_counts(spark, sf):
    """Fit summaries of the suppliers' documents."""
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        key.cast("string").alias("doc_id"), (key % 9).alias("overflow_count"),
        F.create_map(F.lit("text_overflow"), key % 9, F.lit("w 1-URGENT"), F.lit(2).cast("bigint")).alias("warning_counts"),
    )


REPORTS_SQL = """
rl AS (SELECT CAST(o_custkey AS VARCHAR) AS doc_id, 'w ' || o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1, 2),
fit AS (SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, s_suppkey % 9 AS overflow_count FROM supplier),
fl AS (SELECT doc_id, 'text_overflow' AS label, overflow_count AS n FROM fit UNION ALL SELECT doc_id, 'w 1-URGENT', 2 FROM fit),
cust AS (SELECT CAST(c_custkey AS VARCHAR) AS doc_id, * FROM customer)
"""


def _merged(*parts: str) -> str:
    union = " UNION ALL ".join(f"SELECT doc_id, label, n FROM {p}" for p in parts)
    return (
        f"summed AS (SELECT doc_id, label, CAST(sum(n) AS BIGINT) AS n FROM ({union}) GROUP BY 1, 2), "
        "tot AS (SELECT doc_id, string_agg(label || '=' || n, ',' ORDER BY label || '=' || n) AS warnings_by_type, CAST(sum(n) AS BIGINT) AS warning_count FROM summed GROUP BY 1)"
    )


@query("report_merge_fit", f"""
WITH {REPORTS_SQL}, {_merged('rl', 'fl')}
SELECT c.doc_id, greatest(c_custkey % 5, coalesce(overflow_count, 0)) AS overflow_blocks, greatest(c_custkey % 7, coalesce(overflow_count, 0)) AS overflow_units, coalesce(warnings_by_type, '') AS warnings_by_type,
  coalesce(warning_count, 0) AS warning_count FROM cust c LEFT JOIN fit USING (doc_id) LEFT JOIN tot ON tot.doc_id = c.doc_id
""")
def report_merge_fit(spark, sf):
    out = Q.merge_fit(reports(spark, sf), fit_counts(spark, sf))
    return out.select("doc_id", "overflow_blocks", "overflow_units", labels(F.col("warnings_by_type")).alias("warnings_by_type"), "warning_count")


VISUAL_LABELS = """
vl AS (SELECT doc_id, unnest(warns) AS label, 1 AS n FROM judged), vf AS (SELECT doc_id, 'visual_fail:' || unnest(failures) AS label, 1 AS n FROM judged)
"""


@query("report_merge_visual", f"""
WITH {SAMPLES_SQL}, {REPORTS_SQL}, {VISUAL_LABELS}, {_merged('rl', 'vl', 'vf')}
SELECT c.doc_id, visual_status, round(mean_diff_ratio, 6) AS mean_diff_ratio, coalesce(warnings_by_type, '') AS warnings_by_type, coalesce(warning_count, 0) AS warning_count
FROM cust c LEFT JOIN judged j USING (doc_id) LEFT JOIN tot ON tot.doc_id = c.doc_id
""")
def report_merge_visual(spark, sf):
    out = Q.merge_evaluation(reports(spark, sf), verdicts_of(spark, sf))
    return out.select("doc_id", "visual_status", F.round("mean_diff_ratio", 6).alias("mean_diff_ratio"), labels(F.col("warnings_by_type")).alias("warnings_by_type"), "warning_count")


@query("report_merge_diff_and_protection", f"""
WITH {SAMPLES_SQL}, {REPORTS_SQL}, dl AS (SELECT doc_id, 'page_count_mismatch' AS label, 1 AS n FROM diffs WHERE NOT page_count_match UNION ALL SELECT doc_id, 'page_dimension_mismatch', 1 FROM diffs WHERE dimension_mismatches > 0), {_merged('rl', 'dl')}
SELECT c.doc_id, coalesce(warnings_by_type, '') AS warnings_by_type, coalesce(warning_count, 0) AS warning_count, CASE WHEN s_suppkey IS NOT NULL THEN 'chart=' || (s_suppkey % 4) ELSE 'table=1' END AS protected_regions_by_kind
FROM cust c LEFT JOIN tot ON tot.doc_id = c.doc_id LEFT JOIN supplier ON s_suppkey = c_custkey
""")
def report_merge_diff_and_protection(spark, sf):
    protection = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("doc_id"), F.create_map(F.lit("chart"), F.col("s_suppkey") % 4).alias("counts_by_kind")
    )
    out = Q.merge_protection(Q.merge_visual_diff(reports(spark, sf), Q.document_diffs(page_samples(spark, sf))), protection)
    return out.select("doc_id", labels(F.col("warnings_by_type")).alias("warnings_by_type"), "warning_count", labels(F.col("protected_regions_by_kind")).alias("protected_regions_by_kind"))


_HIDE = f"CASE WHEN {any_of('lower(x)', [m.lower() for m in V.REPORT_MARKS])} THEN {text(V.REPORT_MASK)} ELSE x END"


@query("report_sanitize", f"""
WITH r AS (SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_name || '.pdf' AS input_file, c_name || '_translated.pdf' AS output_file, CASE WHEN c_custkey % 4 = 0 THEN 'leaked with Bearer ' || c_name WHEN c_custkey % 4 = 1 THEN c_mktsegment END AS x,
  '[redacted]=' || (c_custkey % 2) || ',paragraph=' || (c_custkey % 3) AS unit_types_by_kind FROM customer)
SELECT doc_id, input_file, output_file, {_HIDE} AS rejection_reason, unit_types_by_kind FROM r
""")
def report_sanitize(spark, sf):
    out = Q.sanitize_reports(reports(spark, sf))
    return out.select("doc_id", "input_file", "output_file", "rejection_reason", labels(F.col("unit_types_by_kind")).alias("unit_types_by_kind"))


@query("regression_bundle", f"""
WITH {SAMPLES_SQL}, r AS (SELECT CAST(c_custkey AS VARCHAR) AS doc_id, c_name || '.pdf' AS input_file, CASE WHEN c_custkey % 4 = 0 THEN 'leaked with Bearer ' || c_name WHEN c_custkey % 4 = 1 THEN c_mktsegment END AS x FROM customer)
SELECT doc_id, 'pdf_regression_report' AS report_type, input_file, {_HIDE} AS rejection_reason, visual_status, pages_compared FROM r LEFT JOIN judged USING (doc_id)
""")
def regression_bundle(spark, sf):
    diffs = Q.document_diffs(page_samples(spark, sf))
    out = Q.regression_bundle(reports(spark, sf), diffs=diffs, verdicts=Q.evaluate(diffs, **_LIMITS))
    return out.select(
        "doc_id", "report_type", F.col("qa_report.input_file").alias("input_file"), F.col("qa_report.rejection_reason").alias("rejection_reason"),
        F.col("visual_evaluation.visual_status").alias("visual_status"), F.col("visual_diff.pages_compared").alias("pages_compared"),
    )


@query("regression_bundle_json", f"""
WITH {SAMPLES_SQL}, r AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS doc_id, c_name, c_name || '.pdf' AS input_file, CASE WHEN c_custkey % 4 = 0 THEN 'leaked with Bearer ' || c_name WHEN c_custkey % 4 = 1 THEN c_mktsegment END AS x FROM customer)
SELECT doc_id, CASE WHEN c_custkey % 3 = 0 THEN 'nightly' ELSE 'pdf_regression_report' END AS report_type, '1' AS schema_version, '2024-05-01T12:30:00.000000+00:00' AS created_at,
  input_file AS input_label, CASE WHEN c_custkey % 2 = 0 THEN 'out ' || c_custkey || '.pdf' ELSE c_name || '_translated.pdf' END AS output_label, {_HIDE} AS rejection_reason, visual_status, pages_compared FROM r LEFT JOIN judged USING (doc_id)
""")
def regression_bundle_json(spark, sf):
    """Bundles with metadata, written as JSON and read again."""
    diffs = Q.document_diffs(page_samples(spark, sf))
    key = F.col("c_custkey")
    metadata = table(spark, sf, "customer").select(
        key.cast("string").alias("doc_id"), F.when(key % 3 == 0, "nightly").alias("report_type"), F.when(key % 2 == 0, F.concat(F.lit("C:\\jobs/out "), key, F.lit(".pdf"))).alias("output_file"), F.lit("batch").alias("run")
    )
    at = F.to_timestamp(F.lit("2024-05-01 12:30:00"))
    bundles = Q.regression_bundle(reports(spark, sf), diffs=diffs, verdicts=Q.evaluate(diffs, **_LIMITS), metadata=metadata, created_at=at)
    path = new_shared_path(spark, "bundles")
    Q.write_bundles(bundles, path)
    out = Q.read_bundles(spark, path, bundles.schema)
    return out.select(
        "doc_id", "report_type", "schema_version", "metadata.created_at", F.col("metadata.input_file").alias("input_label"), F.col("metadata.output_file").alias("output_label"),
        F.col("qa_report.rejection_reason").alias("rejection_reason"), F.col("visual_evaluation.visual_status").alias("visual_status"), F.col("visual_diff.pages_compared").alias("pages_compared"),
    )

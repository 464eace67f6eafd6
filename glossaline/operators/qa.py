"""Quality reports: visual comparison, verdicts, report building and merging, bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from .. import fixed_values as V
from ..functions.redaction import redact_whole, sanitize_bundle
from ..functions.text import file_label

PAIR = ["doc_id", "page_index"]


def page_diffs(samples: DataFrame) -> DataFrame:
    """Before / after pages paired by index, with gray difference and non-white share.

    ``samples``: doc_id, side (before / after), page_index, width, height, samples.  Pages only
    one side has drop out of the pairing, as the shorter document ends it.
    """
    pixels = F.greatest(F.col("width") * F.col("height"), F.lit(1))
    inked = F.size(F.filter("samples", lambda v: v < V.WHITE_PIXEL)) / pixels
    measured = samples.withColumn("ink", inked)

    def side(name: str) -> DataFrame:
        kept = measured.filter(F.col("side") == name)
        return kept.select(*PAIR, *[F.col(c).alias(f"{name}_{c}") for c in ("width", "height", "samples", "ink")])

    pairs = side("before").join(side("after"), PAIR)
    same_size = (F.col("before_width") == F.col("after_width")) & (F.col("before_height") == F.col("after_height"))
    same_length = F.size("before_samples") == F.size("after_samples")
    total = F.aggregate(
        F.zip_with("before_samples", "after_samples", lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda s, d: s + d
    )
    diff = (
        F.when(~same_size | ~same_length, 1.0).when(F.size("before_samples") == 0, 0.0)
        .otherwise(total / (F.size("before_samples") * 255.0))
    )
    return pairs.select(
        *PAIR, same_size.alias("dimensions_match"), diff.alias("diff_ratio"), "before_width", "before_height", "after_width",
        "after_height", F.col("before_ink").alias("before_non_white_ratio"), F.col("after_ink").alias("after_non_white_ratio"),
    )


def document_diffs(samples: DataFrame) -> DataFrame:
    """Per document: page counts, mismatches, mean and largest difference."""
    counts = samples.groupBy("doc_id").agg(
        F.count_if(F.col("side") == "before").alias("page_count_before"), F.count_if(F.col("side") == "after").alias("page_count_after")
    )
    diffs = page_diffs(samples).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages_compared"), F.count_if(~F.col("dimensions_match")).alias("dimension_mismatches"),
        F.avg("diff_ratio").alias("mean_diff_ratio"), F.max("diff_ratio").alias("max_diff_ratio"),
        F.avg("before_non_white_ratio").alias("mean_non_white_ratio_before"),
        F.avg("after_non_white_ratio").alias("mean_non_white_ratio_after"),
    )
    joined = counts.join(diffs, "doc_id", "left").fillna(0)
    matched = F.col("page_count_before") == F.col("page_count_after")
    warnings = F.array_compact(F.array(
        F.when(~matched, "page_count_mismatch"), F.when(F.col("dimension_mismatches") > 0, "page_dimension_mismatch")
    ))
    return joined.withColumn("page_count_match", matched).withColumn("warnings", warnings)


def evaluate(diffs: DataFrame, **thresholds) -> DataFrame:
    """Verdict pass / warning / fail with its reasons."""
    limit = {**V.VISUAL_THRESHOLDS, **thresholds}
    count_bad, size_bad = ~F.col("page_count_match"), F.col("dimension_mismatches") > 0
    broken = F.array_contains("warnings", "render_failed")
    mean, peak = F.col("mean_diff_ratio"), F.col("max_diff_ratio")

    def reasons(failing: bool) -> Column:
        def level(value: Column, name: str) -> Column:
            high = value >= limit[f"fail_{name}"]
            return high if failing else (value >= limit[f"warning_{name}"]) & ~high

        def allowed(name: str) -> Column:
            return F.lit(limit[name] != failing)

        return F.array_compact(F.array(
            F.when(broken & F.lit(failing), "render_failed"),
            F.when(count_bad & allowed("allow_page_count_mismatch"), "page_count_mismatch"),
            F.when(size_bad & allowed("allow_dimension_mismatch"), "page_dimension_mismatch"),
            F.when(level(mean, "mean"), "high_mean_visual_diff"),
            F.when(level(peak, "max"), "high_max_visual_diff"),
        ))

    judged = diffs.withColumn("visual_failures", reasons(True)).withColumn("visual_warnings", reasons(False))
    status = F.when(F.size("visual_failures") > 0, "fail").when(F.size("visual_warnings") > 0, "warning").otherwise("pass")
    return judged.withColumn("visual_status", status)


def _entries(df: DataFrame, counts: str) -> DataFrame:
    return df.select("doc_id", F.explode(counts).alias("label", "n")).select("doc_id", "label", F.col("n").cast("bigint").alias("n"))


def _labels(df: DataFrame, labels: Column) -> DataFrame:
    return df.select("doc_id", F.explode(labels).alias("label")).select("doc_id", "label", F.lit(1).cast("bigint").alias("n"))


def clean_label(label: Column) -> Column:
    return F.coalesce(redact_whole(label), F.lit(V.REPORT_MASK))


def build_reports(
    runs: DataFrame, selection: DataFrame, protection: DataFrame | None = None, fit: DataFrame | None = None,
    engine_version: str | None = None, created_at=None,
) -> DataFrame:
    """A quality report per document from the summaries of its plan, protection and fit.

    ``runs``: doc_id, input_file, output_file, mode, page_count, and what the run knows of
    translated_units, translated_blocks, overflow_units, overflow_blocks, rejected, rejection_reason.
    ``selection`` comes from the plan and may carry its warnings_by_type; the fit's warnings add to those.
    """
    empty = F.create_map().cast("map<string,bigint>")
    out = runs
    for name in ("translated_units", "translated_blocks", "overflow_units", "overflow_blocks"):
        out = out.withColumn(name, F.coalesce(name, F.lit(0)).cast("bigint") if name in runs.columns else F.lit(0).cast("bigint"))
    rejected = F.coalesce("rejected", F.lit(False)) if "rejected" in runs.columns else F.lit(False)
    reason = F.col("rejection_reason") if "rejection_reason" in runs.columns else F.lit(None).cast("string")
    out = out.withColumn("rejected", rejected).withColumn("rejection_reason", redact_whole(reason))
    out = out.withColumn("input_file", file_label(F.col("input_file"))).withColumn("output_file", file_label(F.col("output_file")))
    chosen = selection.select("doc_id", "skipped_units", "skipped_protected_blocks", "skipped_noisy_blocks", "unit_types_by_kind")
    out = out.join(chosen, "doc_id", "left").fillna(0, subset=["skipped_units", "skipped_protected_blocks", "skipped_noisy_blocks"])
    parts = [_entries(selection, "warnings_by_type")] if "warnings_by_type" in selection.columns else []
    parts += [_entries(fit, "warning_counts")] if fit is not None else []
    if parts:
        out = out.join(sum_labels(*parts), "doc_id", "left")
    else:
        out = out.withColumn("warnings_by_type", empty).withColumn("warning_count", F.lit(0).cast("bigint"))
    if protection is not None:
        out = out.join(protection.select("doc_id", F.col("counts_by_kind").alias("protected_regions_by_kind")), "doc_id", "left")
    else:
        out = out.withColumn("protected_regions_by_kind", empty)
    for name in ("warnings_by_type", "unit_types_by_kind", "protected_regions_by_kind"):
        out = out.withColumn(name, F.coalesce(name, empty))
    none = F.array().cast("array<string>")
    return out.withColumns({
        "warning_count": F.coalesce("warning_count", F.lit(0)).cast("bigint"), "visual_status": F.lit(None).cast("string"), "visual_warnings": none, "visual_failures": none,
        "mean_diff_ratio": F.lit(None).cast("double"), "max_diff_ratio": F.lit(None).cast("double"), "engine_version": F.lit(engine_version).cast("string"),
        "created_at": F.lit(created_at).cast("timestamp") if created_at is not None else F.current_timestamp(),
    })


def sum_labels(*parts: DataFrame) -> DataFrame:
    """(doc_id, warnings_by_type, warning_count) from (doc_id, label, n) rows."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    summed = rows.groupBy("doc_id", "label").agg(F.sum("n").alias("n"))
    # One entry per kind of warning.
    return summed.groupBy("doc_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("warnings_by_type"),
        F.sum("n").alias("warning_count"),
    )


def merge_fit(reports: DataFrame, fit: DataFrame) -> DataFrame:
    """Add the fit warnings to the report's and raise its overflow counts."""
    labels = sum_labels(_entries(reports, "warnings_by_type"), _entries(fit, "warning_counts"))
    kept = reports.drop("warnings_by_type", "warning_count")
    joined = kept.join(labels, "doc_id", "left").join(fit.select("doc_id", "overflow_count"), "doc_id", "left")
    return _filled(
        joined.withColumn("overflow_blocks", F.greatest("overflow_blocks", F.coalesce("overflow_count", F.lit(0))))
        .withColumn("overflow_units", F.greatest("overflow_units", F.coalesce("overflow_count", F.lit(0))))
        .drop("overflow_count"),
        reports,
    )


def _filled(df: DataFrame, like: DataFrame) -> DataFrame:
    empty = F.create_map().cast("map<string,bigint>")
    out = df.withColumn("warnings_by_type", F.coalesce("warnings_by_type", empty)).withColumn(
        "warning_count", F.coalesce("warning_count", F.lit(0))
    )
    return out.select(*like.columns, *[c for c in out.columns if c not in like.columns])


def merge_protection(reports: DataFrame, protection: DataFrame) -> DataFrame:
    found = protection.select("doc_id", F.col("counts_by_kind").alias("_kinds"))
    return reports.join(found, "doc_id", "left").withColumn(
        "protected_regions_by_kind", F.coalesce("_kinds", "protected_regions_by_kind")
    ).drop("_kinds")


def merge_visual_diff(reports: DataFrame, diffs: DataFrame) -> DataFrame:
    """Count the comparison's warnings in the report."""
    labels = sum_labels(_entries(reports, "warnings_by_type"), _labels(diffs, F.transform("warnings", clean_label)))
    return _filled(reports.drop("warnings_by_type", "warning_count").join(labels, "doc_id", "left"), reports)


def merge_evaluation(reports: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Put the verdict into the report; failures count under ``visual_fail:``."""
    failed = F.transform("visual_failures", lambda f: F.concat(F.lit("visual_fail:"), f))
    labels = sum_labels(
        _entries(reports, "warnings_by_type"), _labels(verdicts, F.col("visual_warnings")), _labels(verdicts, failed)
    )
    fields = ["visual_status", "visual_warnings", "visual_failures", "mean_diff_ratio", "max_diff_ratio"]
    kept = reports.drop("warnings_by_type", "warning_count", *fields)
    return _filled(kept.join(labels, "doc_id", "left").join(verdicts.select("doc_id", *fields), "doc_id", "left"), reports)


def sanitize_reports(reports: DataFrame) -> DataFrame:
    """Reports for publishing: file names only, marked texts and labels hidden."""
    out = reports
    for name in ("input_file", "output_file"):
        if name in out.columns:
            out = out.withColumn(name, file_label(F.col(name)))
    for name in ("rejection_reason", "visual_status"):
        if name in out.columns:
            out = out.withColumn(name, redact_whole(F.col(name)))
    for name in ("visual_warnings", "visual_failures"):
        if name in out.columns:
            out = out.withColumn(name, F.transform(name, clean_label))
    for name in ("warnings_by_type", "unit_types_by_kind", "protected_regions_by_kind"):
        if name in out.columns:
            # Labels that become equal keep the last count, as with any keyed overwrite.
            entries = F.transform(F.map_entries(name), lambda e: F.struct(clean_label(e["key"]).alias("key"), e["value"].alias("value")))
            later = F.filter(
                entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda other: other["key"] == e["key"])
            )
            out = out.withColumn(name, F.map_from_entries(later))
    return out


def regression_bundle(
    reports: DataFrame, diffs: DataFrame | None = None, verdicts: DataFrame | None = None, plans: DataFrame | None = None,
    protection: DataFrame | None = None, metadata: DataFrame | None = None, created_at: Column | None = None,
) -> DataFrame:
    """One nested, publishable row per document from all its parts.

    ``metadata``: a row of further facts per document.  Its report_type, schema_version and created_at win
    over the usual ones; its input_file and output_file over those of the report.  Of files only the
    names are kept.
    """
    out = reports.select("doc_id", F.struct(*[c for c in reports.columns if c != "doc_id"]).alias("qa_report"))
    parts = {"visual_diff": diffs, "visual_evaluation": verdicts, "translation_plan_summary": plans, "protection_summary": protection}
    for name, part in parts.items():
        if part is not None:
            nested = part.select("doc_id", F.struct(*[c for c in part.columns if c != "doc_id"]).alias(name))
            out = out.join(nested, "doc_id", "left")
    own = [] if metadata is None else [c for c in metadata.columns if c != "doc_id"]
    if own:
        out = out.join(metadata.select("doc_id", F.struct(*own).alias("_metadata")), "doc_id", "left")

    def known(name: str, usual: Column) -> Column:
        given = F.col(f"_metadata.{name}").cast("string") if name in own else F.lit(None).cast("string")
        return F.coalesce(given, usual)

    def label(name: str) -> Column:
        reported = F.col(f"qa_report.{name}") if name in reports.columns else F.lit(None).cast("string")
        return file_label(F.nullif(known(name, reported), F.lit(""))).alias(name)

    now = created_at if created_at is not None else F.current_timestamp()
    moment = F.date_format(F.to_utc_timestamp(now, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    header = [known("report_type", F.lit("pdf_regression_report")).alias("report_type"), known("schema_version", F.lit("1")).alias("schema_version")]
    named = ("report_type", "schema_version", "created_at", "input_file", "output_file")
    facts = F.struct(
        known("created_at", moment).alias("created_at"), label("input_file"), label("output_file"), *[F.col(f"_metadata.{c}").alias(c) for c in own if c not in named]
    ).alias("metadata")
    return sanitize_bundle(out.select("doc_id", *header, facts, *[c for c in out.columns if c not in ("doc_id", "_metadata")]))


def write_bundles(bundles: DataFrame, path: str) -> None:
    """Write bundles as JSON, an object a line for each document; fields without a value are written as null."""
    bundles.write.option("ignoreNullFields", False).json(path)


def read_bundles(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Written bundles, with the schema they were written from."""
    return spark.read.schema(schema).json(path)

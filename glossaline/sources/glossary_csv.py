"""Glossary as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import fixed_values as V
from ..functions.text import strip
from ..operators.glossary import list_terms
from ..plans.ordered import number_rows


def parse_rows(rows: DataFrame) -> DataFrame:
    """String columns under any header case -> glossary columns plus ``reject_reason``."""
    by_name: dict[str, str] = {}
    for column in rows.columns:
        by_name[column.strip().lower()] = column

    def field(name: str, default: str = ""):
        column = by_name.get(name)
        return strip(F.coalesce(F.col(f"`{column}`"), F.lit(default))) if column else F.lit(default)

    active = ~F.lower(field("is_active", "1")).isin(V.INACTIVE_MARKS)
    parsed = rows.select(
        field("source_term").alias("source_term"), field("target_term").alias("target_term"),
        F.lower(field("source_lang")).alias("source_lang"), F.lower(field("target_lang")).alias("target_lang"),
        field("domain").alias("domain"), field("note").alias("note"), active.alias("is_active"),
        *[F.col(c) for c in ("row_no",) if c in rows.columns],
    )
    missing = F.coalesce(*[
        F.when(F.col(c) == "", f"missing_{c}") for c in ("source_term", "target_term", "source_lang", "target_lang")
    ])
    return parsed.withColumn("reject_reason", missing)


def read_glossary_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", True).option(
        "escape", '"'
    ).csv(path)
    return parse_rows(raw)


def import_result(parsed: DataFrame) -> DataFrame:
    """Accepted and refused rows, and the refusal reasons."""
    reason = F.coalesce("reject_reason", F.lit("accepted"))
    return parsed.groupBy(reason.alias("outcome")).agg(F.count(F.lit(1)).alias("rows"))


def accepted_terms(parsed: DataFrame, order: str = "row_no") -> DataFrame:
    """Accepted rows with ids in file order."""
    good = parsed.filter(F.col("reject_reason").isNull())
    return number_rows(good, [], [order], "id").select("id", *V.GLOSSARY_CSV_HEADER)


def export_rows(glossary: DataFrame) -> DataFrame:
    """All terms, longest first, as CSV text columns in the fixed header order."""
    listed = list_terms(glossary, active_only=False)
    return listed.select(
        *[c for c in V.GLOSSARY_CSV_HEADER if c != "is_active"], F.when(F.col("is_active"), 1).otherwise(0).alias("is_active")
    )


def write_glossary_csv(glossary: DataFrame, path: str, mode: str = "errorifexists") -> None:
    export_rows(glossary).write.mode(mode).option("header", True).option("lineSep", "\n").option("escape", '"').option(
        "emptyValue", ""
    ).csv(path)

"""Model catalog as nested JSON: {"version": n, "providers": {name: {default_model, models: [...]}}}."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.catalog import ENTRY

MODEL = (
    "struct<id:string,label:string,enabled:boolean,source:string,visibility:string,"
    "capabilities:struct<text:boolean,vision:boolean,embedding:boolean,rerank:boolean,unknown:boolean>,"
    "discovered_at:timestamp,last_validated_at:timestamp,display_name:string,raw_metadata:string>"
)
CATALOG = f"struct<version:int,providers:map<string,struct<default_model:string,models:array<{MODEL}>>>>"


def parse_catalogs(documents: DataFrame, text: str = "text") -> DataFrame:
    """Flat entries (plus default_model) of catalogs held as JSON text; other columns are kept."""
    kept = [c for c in documents.columns if c != text]
    parsed = documents.select(*kept, F.from_json(text, CATALOG).alias("_c"))
    providers = parsed.select(*kept, F.explode("_c.providers").alias("provider", "_p"))
    models = providers.select(*kept, "provider", F.col("_p.default_model").alias("default_model"), F.posexplode("_p.models").alias("ordinal", "_m"))
    fields = [F.col(f"_m.{c}").alias(c) for c in ENTRY if c not in ("provider", "ordinal")]
    return models.select(*kept, "provider", "default_model", "ordinal", *fields)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return parse_catalogs(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))


def provider_json(entries: DataFrame, defaults: DataFrame) -> DataFrame:
    """One JSON object per provider with its models in order; providers stay separate rows."""
    fields = [c for c in ENTRY if c not in ("provider", "ordinal")]
    listed = entries.groupBy("provider").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ordinal", "id", F.struct(*fields).alias("m")))), lambda e: e["m"]
        ).alias("models")
    )
    joined = listed.join(defaults.select("provider", "default_model"), "provider", "left")
    return joined.select("provider", F.to_json(F.struct("default_model", "models")).alias("json"))


__all__ = ["CATALOG", "parse_catalogs", "provider_json", "read_catalog"]

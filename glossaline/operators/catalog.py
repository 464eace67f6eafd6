"""Model catalog: merging, refresh, edits, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.redaction import redact_catalog_error
from ..functions.text import contains_any, strip
from ..plans.ordered import number_rows

FLAGS = ["text", "vision", "embedding", "rerank", "unknown"]
ENTRY = [
    "provider", "ordinal", "id", "label", "enabled", "source", "visibility", "capabilities", "discovered_at",
    "last_validated_at", "display_name", "raw_metadata",
]


def _priority(value: Column, table: dict[str, int]) -> Column:
    entries = [F.lit(item) for pair in table.items() for item in pair]
    return F.coalesce(F.create_map(*entries)[value], F.lit(0))


def capability_struct(**flags: Column) -> Column:
    return F.struct(*[F.coalesce(flags.get(f, F.lit(None)), F.lit(f == "text")).alias(f) for f in FLAGS])


def normalize_entries(entries: DataFrame, default_source: str = "user") -> DataFrame:
    """Trimmed entries with every default filled in; rows without an id drop out."""
    blank = F.lit("")
    model_id = strip(F.coalesce("id", blank))
    label = strip(F.coalesce(F.nullif("label", blank), F.nullif("display_name", blank), "id", blank))
    label = F.coalesce(F.nullif(label, blank), model_id)
    source = strip(F.coalesce(F.nullif("source", blank), F.lit(default_source)))
    source = F.coalesce(F.nullif(source, blank), F.lit(default_source))
    display = strip(F.coalesce(F.nullif("display_name", blank), label))
    return entries.filter(model_id != "").select(
        "provider",
        "ordinal",
        model_id.alias("id"),
        label.alias("label"),
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.when(source.isin("default", "seed"), "seed").otherwise(source).alias("source"),
        strip(F.coalesce(F.nullif("visibility", blank), F.lit("unverified"))).alias("visibility"),
        capability_struct(**{f: F.col(f"capabilities.{f}") for f in FLAGS}).alias("capabilities"),
        "discovered_at",
        "last_validated_at",
        F.coalesce(F.nullif(display, blank), label).alias("display_name"),
        "raw_metadata",
    )


def concatenate(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Both lists in order: incoming entries come after all base entries."""
    first = base.withColumn("_list", F.lit(0))
    second = incoming.withColumn("_list", F.lit(1))
    return first.unionByName(second)


def merge(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge two entry lists per provider, one aggregate for all the field rules.

    Label: last one that is not just the id.  Enabled: last.  Source and visibility: highest
    priority, the later entry on ties.  Capabilities: any.  Other fields: last present value.
    The entry keeps the position of its first occurrence.
    """
    rows = concatenate(normalize_entries(base), normalize_entries(incoming))
    place = F.struct("_list", "ordinal")

    def last_present(name: str) -> Column:
        value = F.col(name)
        present = value.isNotNull()
        if name == "raw_metadata":
            present = present & (value != "")
        return F.max_by(value, F.when(present, place)).alias(name)

    def strongest(name: str, table: dict[str, int]) -> Column:
        return F.max_by(F.col(name), F.struct(_priority(F.col(name), table), "_list", "ordinal")).alias(name)

    merged = rows.groupBy("provider", "id").agg(
        F.min(place).alias("_first"),
        F.coalesce(F.max_by("label", F.when(F.col("label") != F.col("id"), place)), F.first("id")).alias("label"),
        F.max_by("enabled", place).alias("enabled"),
        strongest("source", V.SOURCE_PRIORITY),
        strongest("visibility", V.VISIBILITY_PRIORITY),
        F.struct(*[F.bool_or(F.col(f"capabilities.{f}")).alias(f) for f in FLAGS]).alias("capabilities"),
        last_present("discovered_at"),
        last_present("last_validated_at"),
        last_present("display_name"),
        last_present("raw_metadata"),
    )
    spread = merged.withColumn("_list", F.col("_first._list")).withColumn("_old", F.col("_first.ordinal")).drop("_first")
    numbered = number_rows(spread, ["provider"], ["_list", "_old", "id"], "_nth")
    return numbered.withColumn("ordinal", (F.col("_nth") - 1).cast("int")).select(*ENTRY)


def mark_missing(merged: DataFrame, discovered: DataFrame) -> DataFrame:
    """After a refresh: entries not found again become unavailable, or unverified if not discovered."""
    found = discovered.select("provider", "id").distinct().withColumn("_found", F.lit(True))
    missing = F.when(F.col("source") == "api_discovered", "unavailable").otherwise("unverified")
    joined = merged.join(found, ["provider", "id"], "left")
    return joined.withColumn("visibility", F.when(F.col("_found"), F.col("visibility")).otherwise(missing)).select(*ENTRY)


def keep_allowed(entries: DataFrame, allowed: DataFrame, key: str = "id") -> DataFrame:
    return entries.join(allowed.select(key).distinct(), key, "left_semi").select(*entries.columns)


def append_missing(entries: DataFrame, defaults: DataFrame, keys: list[str]) -> DataFrame:
    """Defaults whose key is absent are appended after the present entries."""
    absent = defaults.join(entries.select(*keys).distinct(), keys, "left_anti")
    top = entries.agg(F.coalesce(F.max("ordinal"), F.lit(-1)).alias("top"))
    return entries.unionByName(
        absent.withColumn("ordinal", (F.col("ordinal") + top.scalar() + 1).cast("int")).select(*entries.columns)
    )


def elect_defaults(entries: DataFrame, current: DataFrame) -> DataFrame:
    """Default model per provider: the current one while enabled, else the first enabled one."""
    first = entries.filter("enabled").groupBy("provider").agg(F.min_by("id", F.struct("ordinal", "id")).alias("_first"))
    enabled = entries.filter("enabled").select("provider", F.col("id").alias("default_model"), F.lit(True).alias("_ok"))
    providers = entries.select("provider").distinct()
    return (
        providers.join(current.select("provider", "default_model"), "provider", "left")
        .join(enabled, ["provider", "default_model"], "left")
        .join(first, "provider", "left")
        .select("provider", F.when(F.col("_ok"), F.col("default_model")).otherwise(F.coalesce("_first", F.lit(""))).alias("default_model"))
    )


def edit_entries(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Add if absent, remove, enable / disable, move one step up or down.

    ``changes``: change_no, op (add / remove / enable / disable / toggle / move_up / move_down),
    provider, id, label.  One edit per entry; a provider moves at most one entry at a time.
    """
    key = ["provider", "id"]
    per_entry = changes.groupBy(*key).agg(F.max_by(F.struct("op", "label", "change_no"), "change_no").alias("_c"))
    edits = per_entry.select(*key, F.col("_c.op").alias("op"), F.col("_c.label").alias("new_label"), F.col("_c.change_no").alias("change_no"))
    present = entries.join(edits, key, "left")
    kept = present.filter(F.coalesce(F.col("op") != "remove", F.lit(True)))
    enabled = (
        F.when(F.col("op") == "enable", True).when(F.col("op") == "disable", False)
        .when(F.col("op") == "toggle", ~F.col("enabled")).otherwise(F.col("enabled"))
    )
    # A moved entry steps over its neighbour: one and a half places, then positions close up.
    step = F.when(F.col("op") == "move_up", -1.5).when(F.col("op") == "move_down", 1.5).otherwise(0.0)
    dense = number_rows(kept, ["provider"], ["ordinal", "id"], "_nth")
    kept = dense.withColumn("enabled", enabled).withColumn("_place", F.col("_nth") + step)
    added = (
        edits.filter(F.col("op") == "add").join(entries.select(*key), key, "left_anti")
        .select(
            "provider", F.lit(None).cast("int").alias("ordinal"), "id",
            F.coalesce(F.nullif(strip(F.col("new_label")), F.lit("")), F.col("id")).alias("label"),
            F.lit(True).alias("enabled"), F.lit("user").alias("source"), F.lit("unverified").alias("visibility"),
            capability_struct().alias("capabilities"), F.lit(None).cast("timestamp").alias("discovered_at"),
            F.lit(None).cast("timestamp").alias("last_validated_at"), F.col("id").alias("display_name"),
            F.lit(None).cast("string").alias("raw_metadata"), (F.lit(1e12) + F.col("change_no")).alias("_place"),
        )
    )
    both = kept.select(*ENTRY, "_place").unionByName(added.select(*ENTRY, "_place"))
    numbered = number_rows(both, ["provider"], ["_place", "id"], "_new")
    return numbered.withColumn("ordinal", (F.col("_new") - 1).cast("int")).select(*ENTRY)


def fits_profile(model_id: Column, profile: str) -> Column:
    lowered = F.lower(model_id)
    media = contains_any(lowered, V.MEDIA_WORDS)
    if profile == "text":
        fits = model_id.isin(V.TEXT_MODELS)
    elif profile == "vision":
        named = contains_any(lowered, V.VISION_WORDS)
        excluded = F.contains(lowered, F.lit("gemini")) & F.contains(lowered, F.lit("pro"))
        fits = F.when(named, ~excluded).otherwise(model_id.isin(V.VISION_MODELS))
    else:
        fits = F.lit(True)
    return ~media & fits


def capabilities_of(model_id: Column) -> Column:
    """Capability flags guessed from the words of a discovered id."""
    lowered = F.lower(model_id)
    embedding = F.contains(lowered, F.lit("embed"))
    rerank = F.contains(lowered, F.lit("rerank"))
    return F.struct(
        (~(embedding | rerank)).alias("text"),
        contains_any(lowered, V.VISION_WORDS).alias("vision"),
        embedding.alias("embedding"),
        rerank.alias("rerank"),
        F.lit(False).alias("unknown"),
    )


def discovered_entries(listing: DataFrame, at: Column) -> DataFrame:
    """Catalog entries for a fetched model list (provider, ordinal, id, raw_metadata)."""
    return listing.filter(strip(F.coalesce("id", F.lit(""))) != "").select(
        "provider", "ordinal", "id", F.col("id").alias("label"), F.lit(True).alias("enabled"),
        F.lit("api_discovered").alias("source"), F.lit("current_key_visible").alias("visibility"),
        capabilities_of(F.col("id")).alias("capabilities"), at.alias("discovered_at"), at.alias("last_validated_at"),
        F.col("id").alias("display_name"), "raw_metadata",
    )


def refresh_due(
    provider: Column, supports_refresh: Column, base_url: Column, has_key: Column, last_refreshed: Column, as_of: Column,
    ttl_hours: int = V.REFRESH_TTL_HOURS,
) -> Column:
    """Whether a provider's model list should be fetched again at ``as_of``.

    ``last_refreshed`` is text; a missing or unreadable time means due.
    """
    when = F.try_to_timestamp(last_refreshed)
    stale = F.coalesce(as_of >= when + F.make_dt_interval(hours=F.lit(ttl_hours)), F.lit(True))
    usable = (provider != "google") & supports_refresh & (strip(F.coalesce(base_url, F.lit(""))) != "") & has_key
    return F.coalesce(usable, F.lit(False)) & stale


def refresh_state(log: DataFrame) -> DataFrame:
    """Current refresh state per provider from the appended outcomes (provider, ts, log_no, status, count, error)."""
    status = F.when(F.col("status").isin(V.REFRESH_STATUSES), F.col("status")).otherwise("error")
    rows = log.withColumn("status", status).withColumn("error", redact_catalog_error(F.col("error")))
    return rows.groupBy("provider").agg(
        F.max_by(F.struct("ts", "status", "count", "error"), F.struct("ts", "log_no")).alias("_s")
    ).select(
        "provider", F.col("_s.ts").alias("last_refreshed_at"), F.col("_s.status").alias("last_status"),
        F.col("_s.count").alias("last_count"), F.col("_s.error").alias("last_error"),
    )


def _default_first(models: Column, default: Column) -> Column:
    others = F.filter(models, lambda m: m != default)
    return F.when(F.coalesce(default, F.lit("")) != "", F.concat(F.array(default), others)).otherwise(models)


def provider_profiles(providers: DataFrame, entries: DataFrame, defaults: DataFrame) -> DataFrame:
    """Profiles with their model pool: enabled catalog models, the default one in front.

    The pool is a list by nature; it holds one provider's enabled models.
    """
    pool = entries.filter("enabled").groupBy("provider").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id"))), lambda m: m["id"]).alias("_catalog")
    )
    joined = (
        providers.join(pool, F.col("name") == pool["provider"], "left").drop("provider")
        .join(defaults.select("provider", F.col("default_model").alias("_default")), F.col("name") == F.col("provider"), "left")
        .drop("provider")
    )
    own = F.coalesce("models", F.array().cast("array<string>"))
    models = F.when(F.size("_catalog") > 0, F.col("_catalog")).otherwise(own)
    default = F.coalesce(F.nullif("_default", F.lit("")), F.when(F.size("_catalog").isNull() | (F.size("_catalog") <= 0), F.get(own, 0)))
    models = _default_first(models, default)
    return joined.select(
        "name", F.lower(strip(F.coalesce("type", "name"))).alias("type"), F.coalesce("enabled", F.lit(False)).alias("enabled"),
        "base_url", "api_keys", models.alias("models"), F.coalesce(default, F.get(models, 0), F.lit("")).alias("default_model"),
        F.coalesce("supports_glossary", F.col("type") != "google_translate").alias("supports_glossary"),
    )


def public_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles without keys, with refresh support stated."""
    refreshable = (F.col("type") == "openai_compatible") & (strip(F.coalesce("base_url", F.lit(""))) != "")
    return profiles.withColumn("api_keys", F.transform("api_keys", lambda _: F.lit(V.KEY_MASK))).withColumn(
        "supports_refresh", refreshable
    )


def distinct_in_order(models: Column) -> Column:
    """Trimmed, blank-free, first occurrence kept."""
    trimmed = F.transform(models, lambda m: strip(F.coalesce(m, F.lit(""))))
    return F.array_distinct(F.filter(trimmed, lambda m: m != ""))

"""Provider health from attempt logs: folds, cooldown, ranking, fallback outcomes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.errors import error_class
from ..plans.ordered import number_rows
from ..plans.scan import scan

STATE_KEY = ["provider", "model", "key_index"]


def provider_states(attempts: DataFrame, as_of, cooldown_seconds: int = V.COOLDOWN_SECONDS, keys: list[str] | None = None) -> DataFrame:
    """State of every (provider, model, key) after its attempts, seen at time ``as_of``.

    ``attempts``: keys, ts, attempt_no (unique order within a key), status, error_type,
    latency_ms.  Instead of walking the attempts one by one, each row gets its place in its
    key from a chunked scan, and the folds become plain sums with map-side combine:

    * latency: the weight of a value is a power of the keep factor, by its distance to the end;
      the first value seeds, so it carries the whole remaining weight;
    * failure streak: attempts after the last success.
    """
    keys = keys or STATE_KEY
    real = attempts.filter(F.col("status").isin("success", "failed"))
    timed = F.coalesce(F.col("latency_ms") > 0, F.lit(False))
    # Newest first: one scan gives an attempt's place from the end among all, and among the timed ones.
    placed = scan(
        real.withColumn("_class", F.when(F.col("status") == "failed", error_class(F.col("error_type")))).withColumn("_timed_one", timed.cast("bigint")),
        keys, [F.desc("ts"), F.desc("attempt_no")], ["_from_end", "_timed_from_end"],
        lambda rows, before, same: {"_from_end": np.ones(len(rows), np.int64), "_timed_from_end": rows["_timed_one"].to_numpy(np.int64)}, ["_timed_one"],
    )
    success = F.col("status") == "success"
    failed = ~success
    recent = F.struct("ts", "attempt_no")
    weight = F.pow(F.lit(V.LATENCY_KEEP), F.col("_timed_from_end") - 1)
    grouped = placed.groupBy(*keys).agg(
        F.count_if(success).alias("success_count"),
        F.count_if(failed).alias("failure_count"),
        F.min(F.when(success, F.col("_from_end"))).alias("_last_success"),
        F.count(F.lit(1)).alias("_attempts"),
        F.max_by(F.struct("status", "_class", "latency_ms", "ts"), recent).alias("_last"),
        F.max_by("_class", F.when(failed, recent)).alias("last_error_class"),
        F.max_by("_class", F.when(success | F.col("_class").isin(
            "auth_failure", "quota_rate_limit", "token_limit", "timeout", "provider_5xx"), recent)).alias("_health_class"),
        F.max(F.when(success, recent)).alias("_success_at"),
        F.sum(F.when(timed, F.col("latency_ms") * weight * V.LATENCY_NEW)).alias("_weighted"),
        F.max(F.when(timed, F.col("_timed_from_end"))).alias("_timed"),
        F.max_by("latency_ms", F.when(timed, F.col("_timed_from_end"))).alias("_seed"),
    )
    last_failed = F.col("_last.status") == "failed"
    until = F.when(last_failed, F.col("_last.ts") + F.make_dt_interval(secs=F.lit(cooldown_seconds)))
    as_of = F.lit(as_of).cast("timestamp") if not isinstance(as_of, Column) else as_of
    score = F.col("_weighted") + F.pow(F.lit(V.LATENCY_KEEP), F.col("_timed")) * F.col("_seed")
    health = (
        F.when(F.col("_health_class").isNull(), "healthy")
        .when(F.col("_health_class") == "auth_failure", "dead")
        .when(F.col("_health_class").isin("quota_rate_limit", "token_limit"), "cooldown")
        .otherwise("degraded")
    )
    state = grouped.select(
        *keys,
        "success_count",
        "failure_count",
        F.coalesce(F.col("_last_success") - 1, F.col("_attempts")).alias("consecutive_failures"),
        F.when(last_failed, F.col("_last._class")).otherwise("").alias("last_error_type"),
        F.coalesce("last_error_class", F.lit("")).alias("last_error_class"),
        F.greatest(F.coalesce("_last.latency_ms", F.lit(0)), F.lit(0)).alias("last_latency_ms"),
        F.coalesce(score, F.lit(0.0)).alias("latency_score"),
        health.alias("health_status"),
        until.alias("cooldown_until"),
        F.coalesce(until > as_of, F.lit(False)).alias("on_cooldown"),
        (~(last_failed & (F.col("_last._class") == "auth_failure"))).alias("state_available"),
    )
    return state.withColumn("is_available", F.col("state_available") & ~F.col("on_cooldown"))


def health_snapshot(states: DataFrame) -> DataFrame:
    return states.orderBy("provider", "model")


def reset_cooldowns(states: DataFrame) -> DataFrame:
    """States as after a manual reset."""
    return (
        states.withColumn("cooldown_until", F.lit(None).cast("timestamp"))
        .withColumn("on_cooldown", F.lit(False))
        .withColumn("state_available", F.lit(True))
        .withColumn("is_available", F.lit(True))
        .withColumn("consecutive_failures", F.lit(0).cast("bigint"))
        .withColumn("last_error_type", F.lit(""))
        .withColumn("health_status", F.lit("healthy"))
    )


def quality_score(provider: Column) -> Column:
    entries = [F.lit(item) for pair in V.QUALITY_SCORES.items() for item in pair]
    return F.coalesce(F.create_map(*entries)[provider], F.lit(V.DEFAULT_QUALITY))


def rank_providers(states: DataFrame, last_resort: str | None = None, quality: Column | None = None, decimals: int | None = None) -> DataFrame:
    """Providers in the order to try them: availability, then quality, then latency.

    Equal ranks are ordered by name.  With ``decimals`` the latencies are rounded half up to so many before they
    are compared; they are then averaged as decimals, so the order in which states arrive changes no digit.
    """
    quality = quality if quality is not None else quality_score(F.col("provider"))
    timed = F.when(F.col("latency_score") > 0, F.col("latency_score"))
    latency = F.avg(timed) if decimals is None else F.round(F.avg(timed.cast("decimal(20,6)")), decimals).cast("double")
    rolled = states.withColumn("_quality", quality).groupBy("provider").agg(
        F.bool_or("state_available").alias("any_available"),
        F.bool_and("on_cooldown").alias("all_cooling"),
        F.bool_or(F.col("health_status") == "healthy").alias("_healthy"),
        F.bool_or(F.col("health_status") == "degraded").alias("_degraded"),
        F.bool_or(F.col("health_status") == "cooldown").alias("_cooldown"),
        F.max("_quality").alias("quality"),
        F.coalesce(latency, F.lit(V.DEFAULT_LATENCY)).alias("latency"),
    )
    best = (
        F.when(F.col("_healthy"), "healthy").when(F.col("_degraded"), "degraded").when(F.col("_cooldown"), "cooldown")
        .otherwise("dead")
    )
    is_last = F.col("provider") == last_resort if last_resort else F.lit(False)
    status_rank = (
        F.when(~F.col("any_available"), 4).when(F.col("all_cooling"), 3).when(is_last, 2).when(best == "degraded", 1).otherwise(0)
    )
    ranked = rolled.select(
        "provider", "any_available", "all_cooling", best.alias("health_status"), status_rank.alias("status_rank"),
        "quality", "latency",
    )
    return number_rows(ranked, [], ["status_rank", F.desc("quality"), "latency", "provider"], "rank")


def waterfall_outcomes(attempts: DataFrame, max_retries: int = V.MAX_RETRIES) -> DataFrame:
    """Outcome per request: the first success among the first ``max_retries + 1`` real attempts.

    ``attempts``: request_id, ord, provider, model, status, error_type, latency_ms.  Skipped
    candidates do not count.  Only the first few attempts of a request pass the rank limit, which
    runs before the shuffle, so a request with very many logged attempts is no burden.
    """
    order = Window.partitionBy("request_id").orderBy("ord")
    tried = (
        attempts.filter(F.col("status") != "skipped")
        .withColumn("attempt", F.row_number().over(order))
        .filter(F.col("attempt") <= max_retries + 1)
    )
    success = F.col("status") == "success"
    entry = F.struct("attempt", "provider", "model", "status", "error_type", "latency_ms")
    grouped = tried.groupBy("request_id").agg(
        F.min_by(entry, F.when(success, F.col("attempt"))).alias("_won"),
        F.max_by(entry, "attempt").alias("_last"),
        F.array_sort(F.collect_list(entry)).alias("_attempts"),
    )
    # Attempts after the success were never made.
    made = F.when(
        F.col("_won").isNotNull(), F.slice("_attempts", F.lit(1), F.col("_won.attempt"))
    ).otherwise(F.col("_attempts"))
    final = F.coalesce("_won", "_last")
    return grouped.select(
        "request_id",
        F.when(F.col("_won").isNotNull(), "success").otherwise("error").alias("status"),
        final["provider"].alias("provider"),
        final["model"].alias("model"),
        F.when(F.col("_won").isNull(), final["error_type"]).alias("error_type"),
        final["latency_ms"].alias("latency_ms"),
        F.size(made).alias("attempts"),
        F.size(F.filter(made, lambda a: a["status"] == "failed")).alias("fallback_count"),
        made.alias("attempt_log"),
    )


def attempt_events(attempts: DataFrame) -> DataFrame:
    """Runtime events of logged attempts: every real attempt is a call, then a success or a failure.

    ``attempts``: request_id, ord, provider, model, key_index, status, error_type, message, latency_ms, source_lang,
    target_lang.  Skipped candidates give none.  ``event_no`` orders an attempt's events.
    """
    none = F.lit(None)
    failed = F.col("status") == "failed"

    def event(no: int, name: Column, **own: Column) -> Column:
        fields = {"model": "string", "key_index": "int", "error_type": "string", "error_message": "string", "latency_ms": "int"}
        return F.struct(F.lit(no).alias("event_no"), name.alias("event"), *[own.get(f, none).cast(t).alias(f) for f, t in fields.items()])

    called = event(0, F.lit("provider_call"))
    ended = event(
        1, F.when(failed, "provider_fail").otherwise("provider_success"), model=F.coalesce("model", F.lit("")), key_index=F.coalesce("key_index", F.lit(-1)),
        error_type=F.when(failed, F.coalesce("error_type", F.lit(""))), error_message=F.when(failed, F.coalesce("message", F.lit(""))),
        latency_ms=F.when(~failed, F.coalesce("latency_ms", F.lit(0))),
    )
    real = attempts.filter(F.col("status").isin("failed", "success"))
    return real.select(
        "request_id", "ord", F.coalesce("provider", F.lit("")).alias("provider"), "source_lang", "target_lang", F.explode(F.array(called, ended)).alias("e")
    ).select("request_id", "ord", "provider", "source_lang", "target_lang", "e.*")


def latest_checks(checks: DataFrame) -> DataFrame:
    """Newest health check per provider and model, as an aggregate instead of a sort."""
    columns = [c for c in checks.columns if c not in ("provider_id", "model_id")]
    return checks.groupBy("provider_id", "model_id").agg(
        F.max_by(F.struct(*columns), F.struct("checked_at", "check_no")).alias("_row")
    ).select("provider_id", "model_id", *[F.col(f"_row.{c}").alias(c) for c in columns])


def first_models(models: DataFrame, limit: int) -> DataFrame:
    """The first models per provider, by position; the rank limit runs before the shuffle."""
    order = Window.partitionBy("provider").orderBy("ordinal", "id")
    return models.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def provider_order(preferred: Column, allowed: Column) -> Column:
    """Preferred names that are allowed, completed with the other allowed ones."""
    kept = F.filter(F.array_distinct(preferred), lambda p: F.array_contains(allowed, p))
    return F.array_union(kept, allowed)

"""Provider errors: class by text and status, user-facing status, refinement."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V
from .text import contains_any


def error_class(detail: Column, status_code: Column | None = None) -> Column:
    """One of the error classes, by ordered hints; the first match wins.

    A text that already is a class name passes through, so classifying twice changes nothing.
    """
    text = F.lower(F.coalesce(detail, F.lit("")))
    model_error = contains_any(text, V.MODEL_ERROR_HINTS)
    unavailable = contains_any(text, V.MODEL_UNAVAILABLE_HINTS)
    by_text = (
        F.when(contains_any(text, V.AUTH_HINTS), "auth_failure")
        .when(contains_any(text, V.QUOTA_HINTS), "quota_rate_limit")
        .when(F.contains(text, F.lit("400")) & model_error, "model_error")
        .when(contains_any(text, V.TOKEN_LIMIT_HINTS), "token_limit")
        .when(contains_any(text, V.TIMEOUT_HINTS), "timeout")
        .when(contains_any(text, V.TRANSPORT_HINTS), "transport_error")
        .when(model_error, "model_error")
        .when(unavailable, "model_unavailable")
        .when(contains_any(text, V.SERVER_ERROR_HINTS), "provider_5xx")
        .otherwise("unknown_transport_error")
    )
    result = F.when(text.isin(V.ERROR_CLASSES), text).otherwise(by_text)
    if status_code is None:
        return result
    return (
        F.when(status_code.isin(401, 403), "auth_failure")
        .when(status_code == 429, "quota_rate_limit")
        .when((status_code == 400) & model_error, "model_error")
        .when(status_code.isin(404, 410) & (model_error | unavailable), "model_unavailable")
        .when(status_code.between(500, 599), "provider_5xx")
        .otherwise(result)
    )


def health_status(error_name: Column) -> Column:
    entries = [F.lit(item) for pair in V.HEALTH_STATUS_BY_ERROR.items() for item in pair]
    return F.coalesce(F.create_map(*entries)[error_name], F.lit("unknown_error"))


def refined_health_status(error_name: Column, message: Column) -> Column:
    """Status shown for a failed check: an ``HTTP nnn`` in the message refines the class."""
    text = F.lower(F.coalesce(message, F.lit("")))
    code = F.regexp_extract(F.coalesce(message, F.lit("")), r"(?U)HTTP\s+(\d+)", 1)
    base = health_status(F.coalesce(error_name, F.lit("")))
    first = (
        F.when(code == "404", F.when(contains_any(text, V.MODEL_HINTS_404), "model_not_found").otherwise("endpoint_not_found"))
        .when(code == "400", F.when(contains_any(text, V.MODEL_HINTS_400), "model_not_found").otherwise("payload_error"))
        .otherwise(base)
    )
    second = (
        F.when(contains_any(text, V.RECHECK_AUTH), "auth_error")
        .when(contains_any(text, V.RECHECK_QUOTA), "quota_or_rate_limited")
        .when(contains_any(text, V.RECHECK_MODEL), "model_not_found")
        .when(contains_any(text, V.RECHECK_WRAPPER), "provider_wrapper_error")
        .otherwise(first)
    )
    return F.when(first.isin("unknown_error", "network_error", "endpoint_not_found"), second).otherwise(first)

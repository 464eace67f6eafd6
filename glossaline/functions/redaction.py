"""Masking secrets in strings and, schema-driven, in whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import fixed_values as V
from .text import contains_any, file_label, strip


def redact_secrets(text: Column) -> Column:
    for pattern in V.SECRET_PATTERNS:
        text = F.regexp_replace(text, pattern, V.KEY_MASK)
    return text


def redact_error(text: Column) -> Column:
    """Error text as stored in the job log: redacted, then cut."""
    return F.substring(redact_secrets(F.coalesce(text, F.lit(""))), 1, V.ERROR_MESSAGE_CHARS)


def redact_provider_error(detail: Column, api_key: Column | None = None) -> Column:
    s = F.coalesce(detail, F.lit(""))
    if api_key is not None:
        s = F.when(F.length(api_key) > 0, F.replace(s, api_key, F.lit(V.KEY_MASK))).otherwise(s)
    s = F.regexp_replace(s, V.AUTH_HEADER_PATTERN, V.AUTH_HEADER_MASK)
    s = F.regexp_replace(s, V.BEARER_PATTERN, V.BEARER_MASK)
    s = F.regexp_replace(s, V.GOOGLE_KEY_PATTERN, V.KEY_MASK)
    return F.substring(s, 1, 500)


def redact_catalog_error(detail: Column, api_key: Column | None = None) -> Column:
    s = F.coalesce(detail, F.lit(""))
    if api_key is not None:
        s = F.when(F.length(api_key) > 0, F.replace(s, api_key, F.lit(V.KEY_MASK))).otherwise(s)
    s = F.regexp_replace(s, V.AUTH_HEADER_PATTERN, V.AUTH_HEADER_MASK)
    s = F.regexp_replace(s, V.GOOGLE_KEY_PATTERN, V.KEY_MASK)
    return F.substring(F.translate(s, "\r\n", "  "), 1, 400)


def redact_router_error(text: Column) -> Column:
    """Short display form; any banned word hides the whole message."""
    stripped = strip(F.coalesce(text, F.lit("")))
    s = F.regexp_replace(stripped, V.GOOGLE_KEY_PATTERN, V.KEY_MASK)
    s = F.regexp_replace(s, V.ROUTER_BEARER_PATTERN, V.ROUTER_BEARER_MASK)
    s = F.regexp_replace(s, V.ROUTER_SK_PATTERN, V.KEY_MASK)
    return (
        F.when(stripped == "", "None")
        .when(contains_any(F.lower(s), V.ROUTER_BANNED_WORDS), V.ROUTER_BANNED_MASK)
        .when(F.length(s) > 80, F.concat(F.substring(s, 1, 80), F.lit("...")))
        .otherwise(s)
    )


def redact_whole(text: Column, marks: list[str] = V.REPORT_MARKS) -> Column:
    """Replace the whole value when it carries any mark, ignoring case."""
    return F.when(contains_any(F.lower(text), [m.lower() for m in marks]), V.REPORT_MASK).otherwise(text)


def mask_key(key: Column) -> Column:
    s = strip(F.coalesce(key, F.lit("")))
    return F.when(s == "", "").when(F.length(s) <= 4, "***").otherwise(F.concat(F.lit("****"), F.right(s, F.lit(4))))


def _rewrite(value: Column, data_type: T.DataType, on_string, keep_field, on_field) -> Column:
    """Walk a schema and rebuild the value with every string passed through ``on_string``."""
    if isinstance(data_type, T.StringType):
        return on_string(value)
    if isinstance(data_type, T.ArrayType):
        return F.transform(value, lambda item: _rewrite(item, data_type.elementType, on_string, keep_field, on_field))
    if isinstance(data_type, T.MapType):
        rewritten = F.transform_values(
            value, lambda _, item: _rewrite(item, data_type.valueType, on_string, keep_field, on_field)
        )
        if keep_field is None or not isinstance(data_type.keyType, T.StringType):
            return rewritten
        return F.map_filter(rewritten, lambda k, _: ~contains_any(F.lower(k), V.BUNDLE_SENSITIVE_KEYS))
    if isinstance(data_type, T.StructType):
        fields = []
        for field in data_type.fields:
            if keep_field is not None and not keep_field(field.name):
                continue
            special = on_field(field) if on_field else None
            inner = value.getField(field.name)
            rebuilt = special(inner) if special else _rewrite(inner, field.dataType, on_string, keep_field, on_field)
            fields.append(rebuilt.alias(field.name))
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def redact_rows(df: DataFrame) -> DataFrame:
    """Secrets masked in every string of every column, at any depth; the schema stays."""
    return df.select(
        *[_rewrite(F.col(f.name), f.dataType, redact_secrets, None, None).alias(f.name) for f in df.schema.fields]
    )


def _safe_bundle_field(name: str) -> bool:
    return not any(part in name.lower() for part in V.BUNDLE_SENSITIVE_KEYS)


def _bundle_path_field(field: T.StructField):
    if field.name in V.BUNDLE_PATH_KEYS and isinstance(field.dataType, T.StringType):
        return file_label
    return None


def sanitize_bundle(df: DataFrame) -> DataFrame:
    """Report rows fit for publishing: sensitive fields dropped, paths cut, marked strings hidden."""

    def hide(text):
        return redact_whole(text, V.BUNDLE_MARKS)

    out = []
    for field in df.schema.fields:
        if not _safe_bundle_field(field.name):
            continue
        special = _bundle_path_field(field)
        value = F.col(field.name)
        rebuilt = special(value) if special else _rewrite(value, field.dataType, hide, _safe_bundle_field, _bundle_path_field)
        out.append(rebuilt.alias(field.name))
    return df.select(*out)

"""Language codes, pair checks and script signals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V
from .text import count_chars, strip


def _lookup(table: dict[str, str], key: Column) -> Column:
    entries = [F.lit(item) for pair in table.items() for item in pair]
    return F.create_map(*entries)[key]


def normalize_code(code: Column) -> Column:
    lowered = F.lower(code)
    return F.when(lowered == "auto", F.lit("auto")).otherwise(F.coalesce(_lookup(V.LANGUAGE_CODE_MAP, lowered), code))


def ocr_code(code: Column) -> Column:
    lowered = F.lower(code)
    return F.when(lowered == "auto", F.lit(V.OCR_AUTO)).otherwise(
        F.coalesce(_lookup(V.OCR_LANGUAGE_MAP, lowered), F.lit(V.OCR_DEFAULT))
    )


def is_supported(code: Column) -> Column:
    return F.lower(code).isin([c for c in V.SUPPORTED_LANGUAGES if c == c.lower()])


def pair_reject_reason(source: Column, target: Column) -> Column:
    """Null for a usable pair, else why it is refused."""
    missing_source = F.coalesce(source, F.lit("")) == ""
    missing_target = F.coalesce(target, F.lit("")) == ""
    auto = F.lower(source) == "auto"
    return (
        F.when(missing_source, "missing_source")
        .when(missing_target, "missing_target")
        .when(auto & (F.lower(target) == "auto"), "auto_to_auto")
        .when(auto & is_supported(target), F.lit(None))
        .when(~auto & ~is_supported(source), "unsupported_source")
        .when(~is_supported(target), "unsupported_target")
        .when(~auto & (source == target), "same_language")
    )


def script_signals(text: Column) -> dict[str, Column]:
    """The evidence the source-language check looks at, one column per signal."""
    words = F.split(F.lower(text), f"[{V.WHITESPACE_CLASS}]+")
    ascii_ratio = count_chars(text, r"A-Za-z\t-\r\x1c-\x20") / F.greatest(F.length(text), F.lit(1))
    return {
        "has_vietnamese": text.rlike(f"[{V.VIETNAMESE_LETTERS}]")
        | F.arrays_overlap(words, F.array(*[F.lit(w) for w in V.VIETNAMESE_WORDS])),
        "has_japanese": text.rlike(r"[぀-ヿ一-龯]"),
        "has_han": text.rlike(r"[一-鿿]"),
        "ascii_ratio": ascii_ratio,
    }


def language_evidence(text: Column, code: Column) -> Column:
    """True / false when the signals support / do not support the language; null if none apply."""
    signals = script_signals(text)
    lowered = F.lower(code)
    return (
        F.when(lowered.isin(V.LANGUAGE_NAMES["vi"]), signals["has_vietnamese"])
        .when(lowered.isin(V.LANGUAGE_NAMES["ja"]), signals["has_japanese"])
        .when(lowered.isin(V.LANGUAGE_NAMES["zh"]), signals["has_han"])
        .when(lowered.isin(V.LANGUAGE_NAMES["en"]), signals["ascii_ratio"] > 0.8)
    )


def is_source_language(text: Column) -> Column:
    """The check itself: only texts under two characters are refused; without evidence, translate."""
    return F.coalesce(F.length(strip(text)) >= 2, F.lit(False))


def is_text_clear(text: Column) -> Column:
    """Recognized text is usable: 3+ letters/digits/spaces and at least 30 % letters or digits."""
    s = strip(F.coalesce(text, F.lit("")))
    readable = count_chars(s, V.ALNUM_CLASS + V.WHITESPACE_CLASS)
    valid = count_chars(s, V.ALNUM_CLASS)
    return (F.length(s) > 0) & (readable >= 3) & (valid >= F.length(s) * 0.3)

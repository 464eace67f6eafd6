"""Which texts hold language at all, and which translations may stay unchanged."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V
from .text import is_blank, strip


def is_code_like(stripped: Column) -> Column:
    """Flight codes, numbers with punctuation, and short ASCII tokens next to digits."""
    has_digit = stripped.rlike("[0-9]")
    # Words of three or more letters would make it language; at least one word must be there.
    short_words = stripped.rlike("[A-Za-z]") & ~stripped.rlike("[A-Za-z]{3}")
    ascii_only = ~stripped.rlike(r"[^\x00-\x7f]")
    return (
        stripped.rlike(V.FLIGHT_CODE_PATTERN)
        | (has_digit & stripped.rlike(V.NUMERIC_PATTERN))
        | (ascii_only & has_digit & short_words)
    )


def skip_reason(text: Column, flavor: str = "word") -> Column:
    """Null for text worth translating, else the first rule that skips it."""
    if flavor not in ("word", "slides"):
        raise ValueError(f"unknown flavor: {flavor}")
    s = strip(F.coalesce(text, F.lit("")))
    reason = F.when(s == "", "blank")
    if flavor == "word":
        reason = reason.when(~s.rlike(f"[{V.ALNUM_CLASS}]"), "no_alphanumeric")
    path = V.DOCUMENT_PATH_PATTERN if flavor == "word" else V.SLIDE_PATH_PATTERN
    return (
        reason.when(s.rlike(V.URL_PATTERN), "url")
        .when(s.rlike(V.EMAIL_PATTERN), "email")
        .when(s.rlike(path), "path")
        .when(s.rlike(V.FIELD_HINT_PATTERN), "field")
        .when(is_code_like(s), "code")
    )


def unchanged_is_fine(text: Column) -> Column:
    """An untouched translation is acceptable for blanks, codes and single letters."""
    s = strip(F.coalesce(text, F.lit("")))
    return (s == "") | is_code_like(s) | s.rlike("^[A-Za-z]$")


def is_translatable(text: Column, min_chars: int = 1) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) >= min_chars


def table_value_counts(value: Column) -> Column:
    """Table values that count as text: present, not blank, not a printed null."""
    return ~is_blank(value) & ~F.lower(value).isin("nan", "none")


def translatable_cell(value: Column, value_type: Column, is_formula: Column, is_merged_child: Column) -> Column:
    return (
        (value_type == "string")
        & value.isNotNull()
        & ~F.coalesce(is_formula, F.lit(False))
        & ~F.coalesce(is_merged_child, F.lit(False))
        & ~F.startswith(value, F.lit("="))
        & ~is_blank(value)
    )


def is_failed_translation(translated: Column) -> Column:
    """Blank, or carrying an error phrase: such text never enters the memory."""
    lowered = F.lower(F.coalesce(translated, F.lit("")))
    marks = F.lit(False)
    for mark in V.FAILED_TRANSLATION_MARKS:
        marks = marks | F.contains(lowered, F.lit(mark))
    return is_blank(translated) | marks

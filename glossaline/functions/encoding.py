"""Mis-decoded text: detection, first pattern, repair."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .. import fixed_values as V


def _quoted(pattern: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", pattern)


# A pattern holding another one adds nothing to a yes/no test.
_SHORTEST = [p for p in V.MOJIBAKE_PATTERNS if not any(q in p and q != p for q in V.MOJIBAKE_PATTERNS)]
MOJIBAKE_REGEX = "|".join(_quoted(p) for p in dict.fromkeys([V.REPLACEMENT_CHARACTER, *_SHORTEST]))


def has_mojibake(text: Column) -> Column:
    return F.coalesce(text.rlike(MOJIBAKE_REGEX), F.lit(False))


def first_mojibake_pattern(text: Column) -> Column:
    """The first listed pattern that occurs; evaluated only where the cheap test already hit."""
    found = F.coalesce(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in dict.fromkeys(V.MOJIBAKE_PATTERNS)])
    return F.when(has_mojibake(text), found)


def _redecode(latin: Column, allowed: Column) -> Column:
    """Characters to bytes one to one, bytes to text as UTF-8; null unless valid and clean."""
    raw = F.when(allowed, F.encode(F.when(allowed, latin), "ISO-8859-1"))
    decoded = F.try_validate_utf8(raw.cast("string"))
    return F.when(~has_mojibake(decoded), decoded)


def repair_mojibake(text: Column) -> Column:
    """Undo UTF-8 read as cp1252, else as latin-1; keep the text when neither gives clean text."""
    cp1252_only = ~text.rlike(f"[^\\x00-\\x7f\\xa0-\\xff{V.CP1252_SPECIALS}]")
    latin_only = ~text.rlike(r"[^\x00-\xff]")
    via_cp1252 = _redecode(F.translate(text, V.CP1252_SPECIALS, V.CP1252_BYTES), cp1252_only)
    via_latin = _redecode(text, latin_only)
    return F.when(has_mojibake(text), F.coalesce(via_cp1252, via_latin, text)).otherwise(text)

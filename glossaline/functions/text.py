"""Text expressions: normalizing, keys, previews, chunking."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as V


# Line ends other than the plain one.
ODD_LINE_ENDS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]

# What a text must hold for normalizing to change more than its ends.
UNTIDY = [
    "  ", "\t", " \n", "\n ", *ODD_LINE_ENDS, "\x1f", "\xa0", "\u1680", *[chr(c) for c in range(0x2000, 0x200B)], "\u202f", "\u205f", "\u3000",
]
# Blanks within a line; what most characters are is refused first.
INLINE_FAST = f"[[^!-~]&&[{V.INLINE_SPACE_CLASS}]]"


def strip(text: Column) -> Column:
    """Trim Unicode white space on both ends (plain ``trim`` removes spaces only)."""
    return F.btrim(text, F.lit(V.WHITESPACE))


def strip_mostly_clean(text: Column) -> Column:
    """:func:`strip` for a column of texts of which few end in white space: trimming on the right walks through the whole text, so it is
    done only where the last character asks for it."""
    dirty = F.lit(False)
    for space in V.WHITESPACE:
        dirty = dirty | F.endswith(text, F.lit(space))
    return F.ltrim(F.when(dirty, F.rtrim(text, F.lit(V.WHITESPACE))).otherwise(text), F.lit(V.WHITESPACE))


def is_short(text: Column, chars: int) -> Column:
    """Whether the stripped text has at most so many characters; looks no further than it must."""
    rest = F.substring(F.ltrim(text, F.lit(V.WHITESPACE)), chars + 1, 2**31 - 1)
    return (F.length(text) <= chars) | (F.ltrim(rest, F.lit(V.WHITESPACE)) == "")


def contains_any(text: Column, words: list[str]) -> Column:
    """True when any of the words occurs; one ``contains`` per word keeps this in codegen."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def normalize(text: Column) -> Column:
    """Collapse blanks and tabs, strip every line, keep inner newlines, strip the ends.

    Written as a chain of regular expressions instead of an array transform, so that the
    whole expression stays inside generated code.
    """
    s = F.coalesce(text, F.lit(""))
    whole = F.regexp_replace(s, r"[ \t]+", " ")
    whole = F.regexp_replace(whole, V.LINE_END, "\n")
    whole = F.regexp_replace(whole, f"{INLINE_FAST}*\n{INLINE_FAST}*", "\n")
    # Most texts hold nothing that the patterns would change.
    return strip(F.when(contains_any(s, UNTIDY), whole).otherwise(s))


def language_key(code: Column) -> Column:
    return F.lower(strip(F.coalesce(code, F.lit(""))))


def segment_hash(source_lang: Column, target_lang: Column, text: Column) -> Column:
    """SHA-256 of ``source:target:normalized``, the translation-memory key."""
    key = F.concat(language_key(source_lang), F.lit(":"), language_key(target_lang), F.lit(":"), normalize(text))
    return F.sha2(key, 256)


def is_blank(text: Column) -> Column:
    # Trimming on the left stops at the first other character.
    return F.coalesce(F.ltrim(text, F.lit(V.WHITESPACE)) == "", F.lit(True))


def clean_extracted(text: Column) -> Column:
    """Drop ``(cid:n)`` marks and control characters, collapse white space, strip."""
    s = F.regexp_replace(text, r"\(cid:\d+\)", "")
    s = F.regexp_replace(s, r"[\x00-\x08\x0b-\x0c\x0e-\x1f\x7f-\x9f]", "")
    s = F.regexp_replace(s, f"[{V.WHITESPACE_CLASS}]+", " ")
    return strip(s)


def preview(text: Column, limit: int = V.PREVIEW_CHARS, ellipsis: bool = False) -> Column:
    head = F.substring(text, 1, limit)
    if not ellipsis:
        return head
    return F.when(F.length(text) > limit, F.concat(head, F.lit("..."))).otherwise(text)


def file_label(path: Column) -> Column:
    """Last path component, for either kind of separator; null for a missing path."""
    return F.when(F.length(path) > 0, F.regexp_extract(path, r"([^/\\]+)[/\\]*$", 1))


def lines(text: Column) -> Column:
    """Array of lines; a trailing line end adds no empty line."""
    # Nearly every text has plain line ends only, which need no pattern.
    parts = F.when(contains_any(text, ODD_LINE_ENDS), F.split(text, V.LINE_END, -1)).otherwise(F.split(text, "\n", -1))
    # As the one element of an array the parts are worked out once, however often they are named.
    return F.element_at(
        F.transform(F.array(parts), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)), 1
    )


def line_count(text: Column) -> Column:
    """Size of :func:`lines` without making them."""
    plain = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(F.endswith(text, F.lit("\n")) | (text == ""), 0).otherwise(1)
    return F.when(contains_any(text, ODD_LINE_ENDS), F.size(lines(text))).otherwise(plain)


def chunks(text: Column, size: int = V.MAX_CHUNK_CHARS) -> Column:
    """Consecutive pieces of at most ``size`` characters, in one linear pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def count_chars(text: Column, char_class: str) -> Column:
    """Number of characters of the class (regular-expression class body)."""
    return F.length(F.regexp_replace(text, f"[^{char_class}]+", ""))


def prompt_value(value: Column) -> Column:
    """Flatten a glossary value to one line: line parts stripped, joined by one space."""
    s = F.regexp_replace(F.coalesce(value, F.lit("")), V.LINE_END, "\n")
    s = F.regexp_replace(s, f"[{V.WHITESPACE_CLASS}]*\n[{V.WHITESPACE_CLASS}]*", " ")
    return strip(s)


def version_parts(version: Column) -> Column:
    """Dotted version as comparable integers; anything else counts as 0."""
    parts = F.transform(F.split(version, r"\."), lambda p: F.trim(p).try_cast("int"))
    return F.when(F.exists(parts, lambda p: p.isNull()), F.array(F.lit(0))).otherwise(parts)


def is_newer_version(candidate: Column, current: Column) -> Column:
    """Compare as tuples: missing parts sort before present ones."""
    return F.coalesce(version_parts(candidate) > version_parts(current), F.lit(False))


def overflow_mentions(text: Column) -> Column:
    """How often ``overflow fallback`` occurs in the text, ignoring case."""
    return F.regexp_count(F.lower(text), F.lit("overflow fallback"))

"""Registry of the queries over the given tables, and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import fixed_values as V
from ..session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under a name, with its SQL twin."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # Times in the tables carry no zone; both engines must read them as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    """A table of long texts, where the work per row outweighs the scan."""
    return spread(table(spark, folder, name))


# --- pieces of SQL ------------------------------------------------------------------------


def _plain(pattern: str) -> str:
    """Character class with its escapes written out, for the other regular-expression dialect."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and pattern[i + 1] in "tr":
            out.append({"t": "\t", "r": "\r"}[pattern[i + 1]])
            i += 2
        elif c == "\\" and pattern[i + 1] == "x":
            out.append(chr(int(pattern[i + 2 : i + 4], 16)))
            i += 4
        elif c == "\\" and pattern[i + 1] == "u":
            out.append(chr(int(pattern[i + 2 : i + 6], 16)))
            i += 6
        else:
            out.append(c)
            i += 1
    return "".join(out)


SPACE = _plain(V.WHITESPACE_CLASS)
INLINE = _plain(V.INLINE_SPACE_CLASS)
NEWLINES = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
DIGIT_VALUES = _plain(V.DIGIT_VALUE_CLASS)


def text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """SQL literal of a fixed pattern; the Unicode-class switch does not exist there."""
    return text(pattern.replace("(?iU)", "(?i)").replace("(?U)", ""))


def strip(x: str) -> str:
    return f"trim({x}, {text(V.WHITESPACE)})"


def norm(x: str) -> str:
    s = f"regexp_replace({x}, '[ \t]+', ' ', 'g')"
    s = f"regexp_replace({s}, {text(NEWLINES)}, chr(10), 'g')"
    s = f"regexp_replace({s}, {text(f'[{INLINE}]*' + chr(10) + f'[{INLINE}]*')}, chr(10), 'g')"
    return strip(s)


def seg_hash(source: str, target: str, x: str) -> str:
    return f"sha256({source} || ':' || {target} || ':' || {norm(x)})"


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {text(w)})" for w in words) + ")"


def count_class(x: str, char_class: str) -> str:
    return f"length(regexp_replace({x}, {text(f'[^{char_class}]+')}, '', 'g'))"


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(text(w) for w in words) + ")"


def mapped(x: str, entries: dict, default: str = "NULL") -> str:
    cases = " ".join(
        f"WHEN {text(k)} THEN {text(v) if isinstance(v, str) else v}" for k, v in entries.items()
    )
    return f"CASE {x} {cases} ELSE {default} END"


# Lines of every document with their 0-based number; a trailing line end adds no line.
LINES = (
    "doc_lines AS (SELECT doc_id, lang, source, unnest(range(len(parts))) AS ln, unnest(parts) AS line FROM "
    "(SELECT doc_id, lang, source, CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS parts FROM "
    f"(SELECT doc_id, lang, source, string_split(regexp_replace(text, {text(NEWLINES)}, chr(10), 'g'), chr(10)) AS parts "
    "FROM documents)))"
)

"""Fitting text into boxes: greedy wrapping at shrinking font sizes, inside each row."""

from __future__ import annotations

import math
import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .. import fixed_values as V
from ..functions.text import count_chars
from ..session import materialize
from .segments import count_map

STEP = 0.5


def _class(letters: str) -> str:
    return "".join("\\" + c if c in "\\[]^-/&" else c for c in letters)


SPECIAL = V.NARROW_LETTERS + V.WIDE_LETTERS + V.POINT_MARKS + V.BRACKET_MARKS + V.SIGN_MARKS
ASCII_UPPER = "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in SPECIAL)


def width_units(text: Column) -> Column:
    """Width in hundredths of the font size; whole numbers, so sums are exact in any order.

    Plain ASCII, nearly every token, is counted by character deletion; other text by character
    classes.
    """
    return F.when(text.rlike(r"[^\x21-\x7e]"), _any_width(text)).otherwise(_ascii_width(text)).cast("int")


def _ascii_width(text: Column) -> Column:
    groups = [
        ("0123456789", V.WIDTH_DIGIT), (V.NARROW_LETTERS, V.WIDTH_NARROW), (V.WIDE_LETTERS, V.WIDTH_WIDE), (V.POINT_MARKS, V.WIDTH_POINT),
        (V.BRACKET_MARKS, V.WIDTH_BRACKET), (V.SIGN_MARKS, V.WIDTH_SIGN), (ASCII_UPPER, V.WIDTH_UPPER),
    ]
    # Each character counts as ordinary, corrected by what deleting a group removes.
    corrections = sum(width - V.WIDTH_OTHER for _, width in groups)
    total = F.length(text) * (V.WIDTH_OTHER + corrections)
    for letters, width in groups:
        total = total - F.length(F.translate(text, letters, "")) * (width - V.WIDTH_OTHER)
    return total


def _any_width(text: Column) -> Column:
    upper = r"\p{Lu}&&[^" + _class(SPECIAL) + "]"
    extra = [
        (V.WHITESPACE_CLASS, V.WIDTH_SPACE),
        (V.CJK_CLASS, V.WIDTH_CJK),
        (V.DIGIT_VALUE_CLASS, V.WIDTH_DIGIT),
        (_class(V.NARROW_LETTERS), V.WIDTH_NARROW),
        (_class(V.WIDE_LETTERS), V.WIDTH_WIDE),
        (_class(V.POINT_MARKS), V.WIDTH_POINT),
        (_class(V.BRACKET_MARKS), V.WIDTH_BRACKET),
        (_class(V.SIGN_MARKS), V.WIDTH_SIGN),
    ]
    total = F.length(text) * V.WIDTH_OTHER
    for char_class, width in extra:
        total = total + count_chars(text, char_class) * (width - V.WIDTH_OTHER)
    upper_count = F.length(text) - F.length(F.regexp_replace(text, f"[{upper}]+", ""))
    return total + upper_count * (V.WIDTH_UPPER - V.WIDTH_OTHER)


class Flow:
    """A text as tokens with prefix sums of their widths, for wrapping at many capacities.

    A wrap takes a search per line instead of a step per token: from the first token of a line, the
    prefix sums tell the last one that still fits.
    """

    def __init__(self, text: str, hint: str | None, widths: dict[str, int]) -> None:
        self.widths = widths
        self.lines: list[tuple[list[str], list[int]]] = []  # tokens of a source line, and where each begins; a gap behind each
        hinted = (hint or "").lower() in V.CJK_HINTS
        for line in source_lines(text):
            whole = " " not in line and (hinted or CJK.search(line) is not None)
            tokens = [line] if whole else GAPS.sub(" ", line).strip(" ").split(" ")
            starts = [0]
            for token in tokens:
                starts.append(starts[-1] + self.width(token) + V.WIDTH_SPACE)
            self.lines.append((tokens, starts))

    def width(self, text: str) -> int:
        widths = self.widths
        return sum([widths[c] for c in text])

    def wrap(self, capacity: int, out: list[str] | None = None) -> tuple[int, int]:
        """(number of lines, widest line) of the greedy wrap; ``out`` takes the lines."""
        count, widest = 0, 0
        for tokens, starts in self.lines:
            at, n = 0, len(tokens)
            while at < n:
                head, lead = "", 0  # the end of a token cut by characters, and its width
                first, base = at, starts[at]
                if starts[at + 1] - base - V.WIDTH_SPACE > capacity:
                    chunks = self.cut(tokens[at], capacity)
                    widest = max(widest, *(w for _, w in chunks))
                    count += len(chunks) - 1
                    if out is not None:
                        out.extend(c for c, _ in chunks[:-1])
                    head, lead = chunks[-1]
                    first, base = at + 1, starts[at + 1] - V.WIDTH_SPACE - lead
                # Tokens up to ``stop`` end within the capacity.
                stop = max(first if head or lead else first + 1, bisect_right(starts, base + capacity + V.WIDTH_SPACE, first) - 1)
                widest = max(widest, starts[stop] - base - V.WIDTH_SPACE)
                count += 1
                if out is not None:
                    out.append(" ".join([head, *tokens[first:stop]] if first > at else tokens[first:stop]))
                at = stop
        return count, widest

    def cut(self, token: str, capacity: int) -> list[tuple[str, int]]:
        chunks, start, width = [], 0, 0
        for i, c in enumerate(token):
            u = self.widths[c]
            if width > 0 and width + u > capacity:
                chunks.append((token[start:i], width))
                start, width = i, 0
            width += u
        return [*chunks, (token[start:], width)]


CJK, GAPS, ENDS = re.compile(f"[{V.CJK_CLASS}]"), re.compile(f"[{V.WHITESPACE_CLASS}]+"), re.compile(V.LINE_END)


class Widths(dict):
    """Hundredths of the font size of each character, worked out when it is first met."""

    def __missing__(self, c: str) -> int:
        groups = [
            (V.NARROW_LETTERS, V.WIDTH_NARROW), (V.WIDE_LETTERS, V.WIDTH_WIDE), (V.POINT_MARKS, V.WIDTH_POINT),
            (V.BRACKET_MARKS, V.WIDTH_BRACKET), (V.SIGN_MARKS, V.WIDTH_SIGN),
        ]
        if c.isspace():
            width = V.WIDTH_SPACE
        elif CJK.match(c):
            width = V.WIDTH_CJK
        elif c.isdigit():
            width = V.WIDTH_DIGIT
        else:
            width = next((w for letters, w in groups if c in letters), V.WIDTH_UPPER if c.isupper() else V.WIDTH_OTHER)
        self[c] = width
        return width


def source_lines(text: str) -> list[str]:
    parts = ENDS.split(text)
    return parts[:-1] if parts[-1] == "" else parts


def fit(text: str, width: float, height: float, original: float, smallest: float, ratio: float, hint: str | None, widths: dict[str, int]) -> tuple[list[str], float, bool]:
    """(lines, font size, overflow) of one text.

    A smaller size never needs more lines nor a larger box, so the first size that is as good as the
    smallest, by overflowing height and then width, is found by halving.
    """
    flat = width <= 0 or original <= 0
    if flat:
        # Without a width nothing wraps: the lines that hold text, as they are.
        raw = [line for line in source_lines(text) if line] or [text]
        measured = len(raw), max(sum(widths[c] for c in line) for line in raw)
    else:
        flow = Flow(text, hint, widths)

    def size_of(step: int) -> float:
        return round(original - step * STEP, 2)

    def capacity_of(step: int) -> int:
        return math.floor(width * 100.0 / size_of(step) + 1e-9)

    def over(step: int) -> tuple[float, float]:
        count, widest = measured if flat else flow.wrap(capacity_of(step))
        return max(0.0, count * size_of(step) * ratio - height), max(0.0, widest * size_of(step) / 100.0 - width)

    low, best = 0, over(0)
    if best != (0.0, 0.0):
        high = math.floor((original - smallest + 1e-6) / STEP)
        if high > 0:
            best = over(high)
            while low < high:
                middle = (low + high) // 2
                if over(middle) <= best:
                    high = middle
                else:
                    low = middle + 1
    if flat:
        return raw, size_of(low), best != (0.0, 0.0)
    out: list[str] = []
    flow.wrap(capacity_of(low), out)
    return out, size_of(low), best != (0.0, 0.0)


def _fit_udf():
    @pandas_udf("lines array<string>, size double, overflow boolean")
    def run(text: pd.Series, width: pd.Series, height: pd.Series, original: pd.Series, smallest: pd.Series, ratio: pd.Series, hint: pd.Series) -> pd.DataFrame:
        widths = Widths()
        rows = [([], o, False) if not t else fit(t, w, h, o, s, r, c, widths) for t, w, h, o, s, r, c in zip(text, width, height, original, smallest, ratio, hint)]
        return pd.DataFrame(rows, columns=["lines", "size", "overflow"])

    return run


def fit_units(requests: DataFrame) -> DataFrame:
    """Lines, font size and overflow of every request.

    ``requests``: unit_id, text, width, height, font_size, min_font_size, line_height_ratio,
    language_hint.  Sizes go down in half points; the first that fits wins, else the one with the
    least overflow (height, then width).  All sizes are tried inside the row: no shuffle.
    """
    text = F.coalesce("text", F.lit(""))
    doubles = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("width", "height")]
    fitted = requests.withColumn("_original", F.greatest("font_size", "min_font_size").cast("double")).withColumn(
        "_fit", _fit_udf()(text, *doubles, F.col("_original"), F.col("min_font_size").cast("double"), F.col("line_height_ratio").cast("double"), F.col("language_hint"))
    )
    empty, size, overflow = text == "", F.col("_fit.size"), F.col("_fit.overflow")
    scale = F.when(F.col("_original") != 0, size / F.nullif("_original", F.lit(0.0))).otherwise(1.0)
    small = ~empty & ((F.col("width") <= 40) | (F.col("height") <= 12))
    warnings = F.array_compact(F.array(
        F.when(small, "bbox_too_small"), F.when(~empty & ~overflow & (size < F.col("_original")), "font_shrunk"),
        F.when(overflow, "text_overflow"),
    ))
    return fitted.select(
        *requests.columns, F.col("_fit.lines").alias("lines"),
        size.alias("fitted_size"), (size * F.col("line_height_ratio")).alias("line_height"), overflow.alias("overflow"),
        scale.alias("scale_ratio"), warnings.alias("warnings"),
    )


def fit_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    # Written once: the texts would be fitted anew for each of the two counts.
    results = materialize(results.select(*keys, "overflow", "scale_ratio", "warnings"), "fitted")
    counts = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("result_count"),
        F.count_if("overflow").alias("overflow_count"),
        F.count_if(F.col("scale_ratio") < 0.999).alias("shrunk_count"),
    )
    warned = results.select(*keys, F.explode("warnings").alias("warning")).withColumn("_one", F.lit(1))
    return counts.join(count_map(warned, keys, "warning", "_one", "warning_counts"), keys, "left")

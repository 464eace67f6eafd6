"""Page blocks: flags, candidates, flat views, metrics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.text import contains_any, preview, strip

PAGE = ["doc_id", "page_index"]
Y_BAND = 12


def line_text(lines: Column) -> Column:
    """Block text: its non-empty lines."""
    return strip(F.array_join(F.filter(F.transform(lines, lambda l: l["text"]), lambda t: t != ""), "\n"))


# What every formula holds: one of the pattern's signs, the bracket of a call or the colon of a range.
FORMULA_GUARD = [*V.FORMULA_PATTERN[V.FORMULA_PATTERN.index("[") + 1 : V.FORMULA_PATTERN.index("]")], "(", ":"]
# Two or more white-space characters, two digits, and a delimiter followed by content.  A class of many ranges is slow to say no, so what
# most characters are is refused first.
RARE_SPACE = f"[[^ -~]&&[{V.WHITESPACE_CLASS}]]"
DIGIT_FAST = f"[[^ -/:-~]&&[{V.DIGIT_VALUE_CLASS}]]"
# Two blanks are looked for plainly; so the pattern needs to stop at white space only that is not a blank.
RARE_GAP = f"{RARE_SPACE}(?:[{V.WHITESPACE_CLASS}]|(?<=[{V.WHITESPACE_CLASS}]{{2}}))"
TWO_DIGITS = f"(?s){DIGIT_FAST}.*?{DIGIT_FAST}"
DELIMITER = f"[|;,][{V.WHITESPACE_CLASS}]*[^{V.WHITESPACE_CLASS}]"


# What the patterns below look for is told from cheap looks first, for few texts hold any of it: a sign of a formula, a digit, white space
# other than blanks and plain line ends.  In ASCII these are one class of single characters; beyond it they are all no letters.
ODD_ASCII = f"[\\t\\x0b-\\r\\x1c-\\x1f0-9{''.join(re.escape(c) for c in FORMULA_GUARD if c.isascii())}]"
ODD_BEYOND = r"[^\x00-\x7f\p{L}]"
PLAIN_GAPS = ["  ", "\n\n", " \n", "\n "]
# A letter or digit and another visible character: no noise, whatever follows.
PLAINLY_TEXT = f"[{V.ALNUM_CLASS}][{V.WHITESPACE_CLASS}]*[^{V.WHITESPACE_CLASS}]"
HEAD_CHARS = 24


def is_odd(text: Column) -> Column:
    """Whether a text holds what digits, formulas or rare gaps are made of; one without bytes beyond ASCII is looked through once."""
    return F.when(text.rlike(ODD_ASCII), True).when(F.octet_length(text) == F.length(text), False).otherwise(text.rlike(ODD_BEYOND))


def has_gap(text: Column) -> Column:
    """Two white-space characters in a row."""
    return F.contains(text, F.lit("  ")) | text.rlike(RARE_GAP)


def looks_like_formula(text: Column) -> Column:
    """The whole pattern, tried only where one of its signs or the punctuation of a reference occurs."""
    return F.when(contains_any(text, FORMULA_GUARD), text.rlike(V.FORMULA_PATTERN)).otherwise(F.when(text.isNotNull(), False))


def has_flag(flag: str) -> Column:
    return F.array_contains("flags", flag)


def union_flags(*arrays: Column) -> Column:
    return F.array_distinct(F.concat(*arrays))


def flags_when(*pairs: tuple[Column, list[str]]) -> Column:
    """Array of the flags whose condition holds."""
    parts = [F.when(cond, F.array(*[F.lit(f) for f in flags])).otherwise(F.array().cast("array<string>")) for cond, flags in pairs]
    return F.concat(*parts)


def is_noisy_text(text: Column) -> Column:
    """Fewer than two visible characters, or no letter and no digit; both tests stop early."""
    text = F.coalesce(text, F.lit(""))
    space = V.WHITESPACE_CLASS
    return ~text.rlike(f"[^{space}][{space}]*[^{space}]") | ~text.rlike(f"[{V.ALNUM_CLASS}]")


def is_small(df_min_width: float = 20.0, min_height: float = 8.0) -> Column:
    width = F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0))
    height = F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0))
    return (width < df_min_width) | (height < min_height)


def line_texts() -> Column:
    return F.transform(F.coalesce("lines", F.array()), lambda l: l["text"])


def _wide_or_numeric(texts: Column, may_count: Column) -> Column:
    text = F.col("text")
    numeric = (F.size(F.filter(texts, lambda t: t.rlike(r"\p{Nd}"))) >= 2) & (F.size(F.filter(texts, lambda t: t != "")) >= 3)
    wide = F.when(F.col("_odd") | contains_any(text, PLAIN_GAPS), has_gap(strip(text))).otherwise(False)
    return wide | F.when(may_count, numeric).otherwise(False)


def judge_blocks(blocks: DataFrame) -> DataFrame:
    """What the patterns say of each text, worked out once and before the blocks travel; the first half of :func:`flag_blocks`.

    Nothing after it looks at ``lines``, which may stay behind.  Blocks that hold the texts of their lines as
    ``joined_lines``, which but for white space at the ends are their text, need no nested lines at all.
    """
    is_text = F.col("kind") == "text"
    text, odd = F.col("text"), F.col("_odd")
    looked = blocks.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_odd", is_odd(text))
    if "joined_lines" in blocks.columns:  # digits of the lines are digits of the text
        of_lines, may_count = F.split("joined_lines", "\n", -1), odd
    else:
        of_lines, may_count = line_texts(), F.lit(True)
    plain = F.substring(text, 1, HEAD_CHARS).rlike(PLAINLY_TEXT)
    return looked.withColumns({
        "_formula": is_text & F.when(odd, looks_like_formula(text)).otherwise(False), "_noisy_text": F.when(plain, False).otherwise(is_noisy_text(text)),
        "_wide": is_text & _wide_or_numeric(of_lines, may_count), "_digit": F.when(odd, text.rlike(r"\p{Nd}")).otherwise(False),
    })


def flag_blocks(blocks: DataFrame) -> DataFrame:
    """Add the content flags: noisy, translatable, formula_like, protected, table_like, image_like."""
    return flag_judged(judge_blocks(blocks))


def flag_judged(judged: DataFrame) -> DataFrame:
    """Flags of judged blocks.

    Table-like bands (three blocks or more on one text line of the page, two or more with digits)
    come from one aggregate over bands joined back, not from a window over a page.
    """
    is_text = F.col("kind") == "text"
    banded = judged.withColumn("_band", band())
    bands = (
        banded.filter(is_text)
        .groupBy(*PAGE, "_band")
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if("_digit").alias("_digits"))
        .filter((F.col("_n") >= 3) & (F.col("_digits") >= 2))
        .select(*PAGE, "_band", F.lit(True).alias("_row_of_table"))
    )
    return _with_flags(banded.join(bands, [*PAGE, "_band"], "left"))


def band() -> Column:
    return F.when(F.col("kind") == "text", F.bround(F.col("y0") / Y_BAND, 0))


def flag_judged_pages(judged: DataFrame) -> DataFrame:
    """:func:`flag_judged` for blocks whose pages lie whole in a partition and are of bounded size: nothing is shuffled."""
    of_band = Window.partitionBy(*PAGE, "_band")
    row_of_table = F.col("_band").isNotNull() & (F.count(F.lit(1)).over(of_band) >= 3) & (F.count_if("_digit").over(of_band) >= 2)
    return _with_flags(judged.withColumn("_band", band()).withColumn("_row_of_table", row_of_table))


def _with_flags(joined: DataFrame) -> DataFrame:
    is_text = F.col("kind") == "text"
    noisy_text = F.col("_noisy_text")
    noisy = is_text & (is_small() | noisy_text)
    table = is_text & (F.col("_wide") | F.coalesce("_row_of_table", F.lit(False)))
    added = flags_when(
        (noisy, ["noisy"]),
        (is_text & ~noisy_text & ~noisy, ["translatable"]),
        (F.col("_formula"), ["formula_like", "protected"]),
        (table, ["table_like"]),
        (F.col("kind").isin("image", "drawing"), ["image_like", "protected"]),
        ((F.col("kind") == "unknown") & ~((F.col("x0") == 0) & (F.col("y0") == 0) & (F.col("x1") == 0) & (F.col("y1") == 0)), ["protected"]),
    )
    given = F.coalesce("flags", F.array().cast("array<string>"))
    return joined.withColumn("flags", union_flags(given, added)).drop("_band", "_row_of_table", "_formula", "_noisy_text", "_wide", "_digit", "_odd")


# White space and what is a letter or a number without being a digit; the commonest first, since alternatives are tried in order.
LETTERS_AND_SPACE = f"[a-zA-Z {V.WHITESPACE_CLASS}[{V.ALNUM_CLASS}&&[^{V.DIGIT_VALUE_CLASS}]]]+"


def symbol_digit_ratio(text: Column) -> Column:
    """Share of signs and digits among the visible characters.

    Each pass is written once: inside a condition Spark evaluates every occurrence anew.  Words with the blanks between
    them go as one match, and plain blanks go before the pattern of rarer ones.
    """
    text = F.coalesce(text, F.lit(""))
    signs = F.length(F.regexp_replace(text, LETTERS_AND_SPACE, "")).cast("double")
    visible = F.length(F.regexp_replace(F.replace(text, F.lit(" "), F.lit("")), f"[{V.WHITESPACE_CLASS}]+", ""))
    return F.coalesce(F.try_divide(signs, visible), F.lit(0.0))


def _candidate(confidence: float, reason: str) -> Column:
    return F.struct(F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))


def formula_candidate() -> Column:
    """Struct (confidence, reason), or null."""
    is_short = F.length(strip(F.col("text"))) <= 20
    short = F.when(is_short, symbol_digit_ratio(F.col("text")) >= 0.35).otherwise(False)
    return (
        F.when(has_flag("formula_like"), _candidate(0.95, V.FORMULA_FLAG_REASON))
        .when(looks_like_formula(F.col("text")), _candidate(0.9, V.FORMULA_TOKEN_REASON))
        .when(short, _candidate(0.72, V.FORMULA_SHORT_REASON))
    )


def table_candidate() -> Column:
    return F.when(has_flag("table_like"), _candidate(0.88, V.TABLE_FLAG_REASON)).when(
        F.col("text").rlike(TWO_DIGITS) & (has_gap(F.col("text")) | F.col("text").rlike(DELIMITER)),
        _candidate(0.7, V.TABLE_DELIMITER_REASON),
    )


def is_content_text() -> Column:
    return (F.col("kind") == "text") & (F.coalesce("text", F.lit("")) != "")


def flat_text_blocks(ordered: DataFrame) -> DataFrame:
    """Text blocks with preview, length and sorted flags."""
    return ordered.filter(is_content_text()).select(
        *PAGE, "block_id", "text", preview(F.col("text")).alias("text_preview"), F.length("text").alias("length"),
        F.sort_array("flags").alias("flags"), "reading_order", "column_index", "x0", "y0", "x1", "y1",
    )


def span_text(lines: Column) -> Column:
    """All span texts of a block, joined by blanks."""
    return strip(F.array_join(F.flatten(F.transform(lines, lambda l: F.transform(l["spans"], lambda s: s["text"]))), " "))


def document_metrics(blocks: DataFrame) -> DataFrame:
    """Block counts by kind and flag per document."""

    def count_flag(flag: str) -> Column:
        return F.count_if(has_flag(flag))

    image, drawing = F.col("kind") == "image", F.col("kind") == "drawing"
    return blocks.groupBy("doc_id").agg(
        F.countDistinct("page_index").alias("page_count"),
        F.count_if(is_content_text()).alias("text_block_count"),
        F.count_if(image).alias("image_block_count"),
        F.count_if(drawing).alias("drawing_block_count"),
        F.count_if(image | drawing).alias("protected_object_count"),
        count_flag("protected").alias("protected_block_count"),
        count_flag("formula_like").alias("formula_like_block_count"),
        count_flag("table_like").alias("table_like_block_count"),
        count_flag("noisy").alias("noisy_block_count"),
        count_flag("translatable").alias("translatable_block_count"),
        count_flag("caption_like").alias("caption_like_block_count"),
    )


def scanned_documents(pages: DataFrame) -> DataFrame:
    """Documents with little text on their first pages: doc_id, page_index, text."""
    first = pages.filter(F.col("page_index") < V.SCANNED_PAGES)
    return first.groupBy("doc_id").agg(
        F.coalesce(F.sum(F.length(strip(F.coalesce("text", F.lit(""))))), F.lit(0)).alias("text_chars")
    ).withColumn("is_scanned", F.col("text_chars") < V.SCANNED_MAX_CHARS)


def merge_table_detections(tables: DataFrame) -> DataFrame:
    """Keep every lattice table, and of the stream tables the first of a page and shape not found yet.

    ``tables``: doc_id, page, rows, cols, method, table_no.
    """
    shape = ["doc_id", "page", "rows", "cols"]
    lattice = tables.filter(F.col("method") == "lattice")
    stream = tables.filter(F.col("method") == "stream").join(lattice.select(*shape).distinct(), shape, "left_anti")
    others = [c for c in tables.columns if c not in shape]
    first = stream.groupBy(*shape).agg(F.min_by(F.struct(*others), "table_no").alias("_first"))
    picked = first.select(*shape, *[F.col(f"_first.{c}").alias(c) for c in others])
    return lattice.unionByName(picked.select(*tables.columns))


def style_runs(spans: Column) -> Column:
    """Spans of a line folded into runs of one style; the array is one line, already in its row.

    A span joins the open run when its font equals the run's, its size is within half a point of
    the run's first span, and the gap is small.
    """
    run_type = "struct<text:string,x0:double,y0:double,x1:double,y1:double,font:string,size:double,span_count:int>"

    def as_run(s: Column) -> Column:
        return F.struct(
            s["text"].alias("text"), s["x0"].alias("x0"), s["y0"].alias("y0"), s["x1"].alias("x1"), s["y1"].alias("y1"),
            s["font"].alias("font"), s["size"].alias("size"), F.lit(1).alias("span_count"),
        ).cast(run_type)

    def step(runs: Column, s: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        joins = (
            (last["font"] == s["font"])
            & (F.abs(last["size"] - s["size"]) <= 0.5)
            & (s["x0"] - last["x1"] <= F.greatest(F.lit(8.0), last["size"] * 0.8))
        )
        grown = F.struct(
            strip(F.concat_ws(" ", last["text"], s["text"])).alias("text"),
            F.least(last["x0"], s["x0"]).alias("x0"), F.least(last["y0"], s["y0"]).alias("y0"),
            F.greatest(last["x1"], s["x1"]).alias("x1"), F.greatest(last["y1"], s["y1"]).alias("y1"),
            last["font"].alias("font"), last["size"].alias("size"), (last["span_count"] + 1).alias("span_count"),
        ).cast(run_type)
        return F.when(
            F.coalesce(joins, F.lit(False)), F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), F.array(grown))
        ).otherwise(F.concat(runs, F.array(as_run(s))))

    return F.aggregate(spans, F.array().cast(f"array<{run_type}>"), step)


def position_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Movement of block centers, blocks paired by their place in the document.

    Both sides: doc_id, position (0-based place), x0, y0, x1, y1.
    """
    pair = before.alias("b").join(after.alias("a"), ["doc_id", "position"])

    def center(side: str, axis: str) -> Column:
        return (F.col(f"{side}.{axis}0") + F.col(f"{side}.{axis}1")) / 2.0

    drift = F.hypot(center("b", "x") - center("a", "x"), center("b", "y") - center("a", "y"))
    return pair.select("doc_id", drift.alias("drift")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("compared_blocks"), F.avg("drift").alias("avg_center_drift"), F.max("drift").alias("max_center_drift")
    )

"""Columns, reading order and paragraphs of page blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..plans.ordered import number_rows
from ..plans.scan import scan
from ..session import materialize
from .blocks import PAGE, is_content_text


def column_of(page_width: Column) -> Column:
    """0 left, 1 right, null when a block fits no column."""
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    gutter = F.greatest(F.lit(24.0), page_width * 0.04)
    middle = page_width / 2.0
    center = (F.col("x0") + F.col("x1")) / 2.0
    return (
        F.when((width <= 0) | (height <= 0), F.lit(None).cast("int"))
        .when(F.col("x1") <= middle - gutter / 2.0, 0)
        .when(F.col("x0") >= middle + gutter / 2.0, 1)
        .when(width <= page_width * 0.45, F.when(center < middle, 0).otherwise(1))
    )


def _place(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Only what the order depends on: ids, boxes, the column. Texts do not travel."""
    slim = blocks.select(*PAGE, "block_id", "x0", "y0", "x1", "y1", is_content_text().alias("_content"))
    return slim.join(pages.select(*PAGE, "width"), PAGE).withColumn("_column", column_of(F.col("width"))).drop("width", "x1", "y1")


def _page_columns(placed: DataFrame) -> DataFrame:
    counted = placed.groupBy(*PAGE).agg(*[count.alias(name) for name, count in _column_counts().items()])
    return counted.select(*PAGE, *[told.alias(name) for name, told in _column_facts().items()])


def _column_counts() -> dict[str, Column]:
    content = F.col("_content")
    return {
        "_texts": F.count_if(content),
        "_left": F.count_if(content & (F.col("_column") == 0)),
        "_right": F.count_if(content & (F.col("_column") == 1)),
        "_ambiguous": F.count_if(content & F.col("_column").isNull()),
        "_leftover": F.count_if(F.col("_column").isNull()),
    }


def _column_facts() -> dict[str, Column]:
    sides = (F.col("_texts") >= 2) & (F.col("_left") > 0) & (F.col("_right") > 0)
    split = sides & (F.col("_ambiguous") == 0)
    two = split & (F.col("_leftover") == 0)
    return {
        "column_count": F.when(two, 2).otherwise(1),
        "reading_order_strategy": F.when(two, "layout_aware").otherwise("legacy"),
        "reading_order_warning": F.when(sides & ~two, "ambiguous_reading_order"),
        # Where only non-text blocks fit no column, the others keep the column they were given.
        "_keeps_columns": split,
    }


def _column_index() -> Column:
    return F.when(F.col("_keeps_columns"), F.coalesce("_column", F.lit(0))).otherwise(0)


def _order_keys() -> dict[str, Column]:
    return {"_group": F.when(F.col("column_count") == 2, F.col("column_index")).otherwise(0), "_y": F.bround("y0", 3), "_x": F.bround("x0", 3)}


def order_pages(blocks: DataFrame) -> DataFrame:
    """Blocks with the columns of :func:`block_order` and ``paragraph_no`` (null outside paragraphs), for documents that lie whole in a partition.

    ``blocks`` carry flags, ``font_size`` and ``page_width``.  The order of a page, its paragraphs and their running number share one sort.
    """
    page = Window.partitionBy(*PAGE)
    placed = blocks.withColumn("_column", column_of(F.col("page_width")))
    placed = placed.withColumns({name: count.over(page) for name, count in _column_counts().items()}).withColumns(_column_facts())
    placed = placed.withColumn("column_index", _column_index()).withColumns(_order_keys())
    order = ["_group", "_y", "_x", "block_id"]
    in_page, in_document = page.orderBy(*order), Window.partitionBy("doc_id").orderBy("page_index", *order)
    seen = F.struct("column_index", "x0", "y0", "x1", "y1", F.col("font_size").alias("_font"), can_be_paragraph(F.col("_content")).alias("_ok"))
    earlier = in_page.rowsBetween(Window.unboundedPreceding, -1)
    met = placed.withColumns({
        "reading_order": (F.row_number().over(in_page) - 1).cast("int"), "_ok": can_be_paragraph(F.col("_content")),
        "_before": F.last(F.when(F.col("_content"), seen), ignorenulls=True).over(earlier),
    })
    opened = F.sum(F.when(F.col("_ok") & ~_joins_the_one_before(), 1).otherwise(0)).over(in_document.rowsBetween(Window.unboundedPreceding, 0))
    numbered = met.withColumn("_opened", opened).withColumn("paragraph_no", F.when(F.col("_ok"), F.col("_opened") - 1))
    return numbered.drop("_column", *_column_counts(), "_keeps_columns", *_order_keys(), "_ok", "_before", "_opened")


def _joins_the_one_before() -> Column:
    """What :func:`_openings` asks, of a row with the page's text block before it."""
    one, font, last_font = F.col("_before"), F.col("font_size"), F.col("_before._font")
    gap = F.col("y0") - one["y1"]
    smaller = F.least(F.when(last_font > 0, last_font).otherwise(12.0), F.when(font > 0, font).otherwise(12.0))
    shared = horizontal_overlap(one["x0"], one["x1"], F.col("x0"), F.col("x1"))
    whole = F.col("x0").isNotNull() & F.col("x1").isNotNull() & one["x0"].isNotNull() & one["x1"].isNotNull()
    joins = (
        one["_ok"] & (one["column_index"] == F.col("column_index")) & (gap >= -4.0) & ~((font > 0) & (last_font > 0) & (F.abs(last_font - font) > 2.5))
        & (gap <= F.greatest(F.lit(16.0), smaller * 1.8)) & ((F.abs(one["x0"] - F.col("x0")) <= 24.0) | (whole & (shared >= 0.5)))
    )
    return F.coalesce(joins, F.lit(False))


def page_columns(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Per page: column_count, strategy, warning; one aggregate over its blocks."""
    return _page_columns(_place(blocks, pages)).drop("_keeps_columns")


def reading_order(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Add column_index and reading_order (0-based within the page); the blocks with their texts join the order once."""
    return blocks.join(block_order(blocks, pages), [*PAGE, "block_id"])


def block_order(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, page, block) with the page's columns, column_index and reading_order.

    A page may hold any share of all rows, so the numbering is the chunked one.  It runs on ids
    and boxes.
    """
    placed = _place(blocks, pages)
    keyed = (
        placed.join(_page_columns(placed), PAGE)
        .withColumn("column_index", _column_index())
        .withColumns(_order_keys())
        .drop("x0", "y0", "_content", "_column", "_keeps_columns")
    )
    # Written first: the range sort reads its rows twice, once to find the borders.
    numbered = number_rows(materialize(keyed, "placed"), PAGE, ["_group", "_y", "_x", "block_id"], "_nth")
    return numbered.withColumn("reading_order", (F.col("_nth") - 1).cast("int")).drop("_group", "_y", "_x", "_nth")


def font_size(lines: Column) -> Column:
    """Smallest span size of a block, 0 without spans."""
    sizes = F.flatten(F.transform(lines, lambda l: F.transform(l["spans"], lambda s: s["size"])))
    return F.coalesce(F.array_min(F.filter(sizes, lambda s: s > 0)), F.lit(0.0))


def font_name(lines: Column) -> Column:
    """First font name of a block's spans, null if none has one."""
    names = F.flatten(F.transform(lines, lambda l: F.transform(l["spans"], lambda s: s["font"])))
    return F.try_element_at(F.filter(names, lambda n: n != ""), F.lit(1))


def horizontal_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    overlap = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return overlap / F.greatest(F.least(a1 - a0, b1 - b0), F.lit(1.0))


def can_be_paragraph(content: Column | None = None) -> Column:
    barred = F.arrays_overlap("flags", F.array(*[F.lit(f) for f in [*V.NO_PARAGRAPH_FLAGS, "caption_like"]]))
    return (is_content_text() if content is None else content) & ~barred


def paragraph_members(ordered: DataFrame) -> DataFrame:
    """(doc, page, block) of the paragraphs with ``paragraph_no`` (document-wide, from 0).

    ``ordered``: blocks with reading order, flags and ``font_size``.

    A block opens a paragraph when it cannot join the text block before it, so the paragraph is a
    running count of openings over (document, page, reading order): one sort of slim rows, which looks
    at each row and the one before it, and no task per document.
    """
    slim = ordered.filter(is_content_text()).select(
        *PAGE, "block_id", "reading_order", "column_index", "x0", "y0", "x1", "y1", can_be_paragraph().alias("_ok"),
        F.col("font_size").alias("_font"),
    )
    used = ["page_index", "column_index", "x0", "y0", "x1", "y1", "_font", "_ok"]
    counted = scan(slim, ["doc_id"], ["page_index", "reading_order", "block_id"], ["_opened"], _openings, used)
    return counted.filter("_ok").select(*PAGE, "block_id", (F.col("_opened") - 1).alias("paragraph_no"))


def _openings(rows: pd.DataFrame, before: pd.DataFrame, same: np.ndarray) -> dict[str, np.ndarray]:
    """1 where a block opens a paragraph, 0 where it joins the one before it or belongs to none."""

    def numbers(frame: pd.DataFrame, name: str) -> np.ndarray:
        return frame[name].to_numpy(float, na_value=np.nan)

    def true(frame: pd.DataFrame) -> np.ndarray:
        return frame["_ok"].eq(True).to_numpy(bool)

    font, last_font = numbers(rows, "_font"), numbers(before, "_font")
    gap = numbers(rows, "y0") - numbers(before, "y1")
    x0, x1, last_x0, last_x1 = numbers(rows, "x0"), numbers(rows, "x1"), numbers(before, "x0"), numbers(before, "x1")
    known = (font > 0) & (last_font > 0)
    smaller = np.minimum(np.where(last_font > 0, last_font, 12.0), np.where(font > 0, font, 12.0))
    shared = np.maximum(0.0, np.minimum(x1, last_x1) - np.maximum(x0, last_x0)) / np.maximum(np.minimum(x1 - x0, last_x1 - last_x0), 1.0)
    joins = (
        same & true(before)
        & (numbers(before, "page_index") == numbers(rows, "page_index"))
        & (numbers(before, "column_index") == numbers(rows, "column_index"))
        & (gap >= -4.0)
        & ~(known & (np.abs(last_font - font) > 2.5))
        & (gap <= np.maximum(16.0, smaller * 1.8))
        & ((np.abs(last_x0 - x0) <= 24.0) | (shared >= 0.5))
    )
    return {"_opened": (true(rows) & ~joins).astype(np.int64)}


def box_of(*extra: Column) -> list[Column]:
    """Aggregates for the union box."""
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), *extra]


def paragraphs(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per paragraph, its text in reading order."""
    return paragraphs_of(members.join(
        blocks.select(*PAGE, "block_id", "text", "flags", "reading_order", "column_index", "x0", "y0", "x1", "y1"), [*PAGE, "block_id"]
    ))


def paragraphs_of(members: DataFrame) -> DataFrame:
    """:func:`paragraphs` of blocks that know their paragraph_no."""
    ordered = F.array_sort(F.collect_list(F.struct("reading_order", "block_id", "text")))
    grouped = members.groupBy(*PAGE, "paragraph_no").agg(
        *box_of(
            ordered.alias("_parts"),
            F.min("reading_order").alias("reading_order"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"),
            F.sort_array(F.collect_set("column_index")).alias("column_indexes"),
        )
    )
    return grouped.select(
        *PAGE,
        F.format_string("p%d-para-%d", "page_index", "paragraph_no").alias("paragraph_id"),
        F.transform("_parts", lambda p: p["block_id"]).alias("block_ids"),
        "x0", "y0", "x1", "y1",
        F.array_join(F.transform("_parts", lambda p: p["text"]), "\n").alias("text"),
        "reading_order", "flags", "column_indexes",
        F.when(F.size("_parts") > 1, 0.9).otherwise(0.7).alias("confidence"),
    )


def paragraph_summary(paras: DataFrame) -> DataFrame:
    """Per document: number of paragraphs, their pages, and each paragraph's facts in reading order."""
    fact = F.struct(
        "page_index", "reading_order", "paragraph_id", F.size("block_ids").alias("block_count"),
        F.struct("x0", "y0", "x1", "y1").alias("bbox"), F.round("confidence", 3).alias("confidence"), F.array_sort("flags").alias("flags"),
    )
    return paras.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("paragraph_candidate_count"), F.array_sort(F.collect_set("page_index")).alias("pages"),
        F.array_sort(F.collect_list(fact)).alias("paragraphs"),
    )


def reading_summary(ordered: DataFrame, links: DataFrame, paras: DataFrame) -> DataFrame:
    """Per document: pages, ambiguous pages, captions, paragraphs, and page details in page order."""
    page = ordered.groupBy(*PAGE).agg(
        F.any_value("column_count").alias("column_count"), F.any_value("reading_order_strategy").alias("strategy"),
        F.any_value("reading_order_warning").alias("warning"),
    )
    docs = page.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.count_if(F.col("warning") == "ambiguous_reading_order").alias("ambiguous_page_count"),
        F.array_sort(F.collect_list(F.struct("page_index", "column_count", "strategy", "warning"))).alias("pages"),
    )
    captions = links.groupBy("doc_id").agg(F.count(F.lit(1)).alias("caption_relationship_count"))
    counts = paras.groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraph_candidate_count"))
    return docs.join(captions, "doc_id", "left").join(counts, "doc_id", "left").fillna(
        0, subset=["caption_relationship_count", "paragraph_candidate_count"]
    )

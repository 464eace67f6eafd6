"""Segments: ids, chunking and reassembly, batches, super-batches, coverage, run grouping, mail."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.linguistic import skip_reason, table_value_counts, translatable_cell
from ..functions.text import chunks, is_blank, strip
from ..session import materialize
from .translator import translate_rows


def translatable_cells(cells: DataFrame) -> DataFrame:
    """Cells worth translating, with their segment id ``sheet!RrCc``."""
    keep = translatable_cell(F.col("value"), F.col("value_type"), F.col("is_formula"), F.col("is_merged_child"))
    segment_id = F.format_string("%s!R%dC%d", F.col("sheet"), F.col("row"), F.col("col"))
    return cells.filter(keep).withColumn("segment_id", segment_id)


def explode_chunks(segments: DataFrame, size: int = V.MAX_CHUNK_CHARS) -> DataFrame:
    """One row per chunk; ``passes_through`` marks chunks too short to translate.

    A generator next to the scan: no shuffle, and rows stay below the chunk size.
    """
    exploded = segments.select(
        *[c for c in segments.columns if c != "text"], F.posexplode(chunks(F.col("text"), size)).alias("chunk_no", "chunk")
    )
    return exploded.withColumn("passes_through", F.length(strip(F.col("chunk"))) < 2)


def sub_chunks(df: DataFrame, size: int = V.SUB_CHUNK_CHARS) -> DataFrame:
    """Split chunks a translator refused as too long."""
    return df.select(
        *[c for c in df.columns if c != "chunk"], F.posexplode(chunks(F.col("chunk"), size)).alias("sub_no", "chunk")
    )


def rejoin(pieces: DataFrame, keys: list[str], order: list[str], text: str, separator: str = "") -> DataFrame:
    """Ordered concatenation per key: the inverse of chunking, or a document from its parts.

    The group is one output value, so its size is the size of that text.
    """
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_piece"))))
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p["_piece"]), separator).alias("text"))


def restore_originals(batch: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Results put back by position; the original stays where none came back."""
    found = results.select(*keys, F.col("result"))
    return batch.join(found, keys, "left").withColumn("result", F.coalesce("result", "text", F.lit("")))


def assign_batches(df: DataFrame, position: str, size: int) -> DataFrame:
    """Requests of ``size`` consecutive pages or texts."""
    return df.withColumn("batch_no", F.floor(F.col(position) / size))


def grid_shape(pages: Column) -> Column:
    """Columns x rows of the contact sheet for a batch of pages."""

    def shape(columns: int, rows: int) -> Column:
        return F.struct(F.lit(columns).alias("grid_cols"), F.lit(rows).alias("grid_rows"))

    return (
        F.when(pages == 1, shape(1, 1)).when(pages == 2, shape(2, 1)).when(pages <= 4, shape(2, 2))
        .when(pages <= 6, shape(3, 2)).otherwise(shape(3, 3))
    )


def page_batches(pages: DataFrame, keys: list[str], size: int) -> DataFrame:
    batched = assign_batches(pages, "page_index", size).groupBy(*keys, "batch_no").agg(
        F.count(F.lit(1)).alias("pages"), F.min("page_index").alias("first_page"), F.max("page_index").alias("last_page")
    )
    return batched.withColumn("_grid", grid_shape(F.col("pages"))).select(
        *keys, "batch_no", "pages", "first_page", "last_page", "_grid.grid_cols", "_grid.grid_rows"
    )


def super_batches(texts: DataFrame, keys: list[str], position: str, size: int) -> DataFrame:
    """Join up to ``size`` texts into one request; drops blank and printed-null values.

    ``position`` numbers the texts of a key without gaps, so a batch holds at most ``size`` of
    them, however large its key is.
    """
    usable = texts.filter(table_value_counts(F.col("text"))).withColumn("text", strip(F.col("text")))
    members = F.array_sort(F.collect_list(F.struct(F.col(position).alias("position"), F.col("text").alias("original"))))
    batched = assign_batches(usable, position, size).groupBy(*keys, "batch_no").agg(members.alias("members"))
    return batched.withColumn(
        "text", F.array_join(F.transform("members", lambda m: m["original"]), V.BATCH_DELIMITER)
    )


def split_super_batches(translated: DataFrame, keys: list[str]) -> DataFrame:
    """One row per member: its part, or its original when the parts do not add up."""
    quoted = re.escape(V.BATCH_DELIMITER)
    parts = F.when(F.col("status") == "success", F.split("translated_text", quoted, -1))
    whole = F.coalesce(F.size(parts) == F.size("members"), F.lit(False))
    pieces = F.zip_with(
        "members",
        F.when(whole, parts).otherwise(F.transform("members", lambda m: m["original"])),
        lambda m, p: F.struct(m["position"].alias("position"), m["original"].alias("original"),
                              F.when(p != "", p).otherwise(m["original"]).alias("result")),
    )
    return translated.select(*keys, "batch_no", whole.alias("split_ok"), F.inline(pieces))


def translate_super_batches(
    texts: DataFrame, keys: list[str], position: str, size: int, fn: Callable[[str, str, str], dict],
    source_lang: str, target_lang: str, parallelism: int | None = None,
) -> DataFrame:
    requests = super_batches(texts, keys, position, size).withColumn("source_lang", F.lit(source_lang)).withColumn(
        "target_lang", F.lit(target_lang)
    )
    return split_super_batches(materialize(translate_rows(requests, fn, parallelism), "super-batches"), keys)


def coverage(targets: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of a document's targets by outcome, with maps by location and skip reason.

    ``targets``: location, can_translate, skip_reason, outcome (translated / failed).
    """
    skipped = ~F.col("can_translate")
    reason = F.when(skipped, F.coalesce("skip_reason", F.lit("unknown")))
    # Two hash aggregates; the second one folds a handful of labels per document.
    counted = targets.groupBy(*keys, "location", reason.alias("_reason")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(skipped).alias("skipped"),
        F.count_if(~skipped & (F.col("outcome") == "translated")).alias("translated"),
        F.count_if(~skipped & (F.col("outcome") != "translated")).alias("failed"),
    )
    totals = counted.groupBy(*keys).agg(
        F.sum("n").alias("total_candidates"), F.sum("translated").alias("translated_candidates"),
        F.sum("skipped").alias("skipped_candidates"), F.sum("failed").alias("failed_candidates"),
    )
    by_location = count_map(counted, keys, "location", "n", "by_location")
    by_reason = count_map(counted.filter(F.col("_reason").isNotNull()), keys, "_reason", "n", "skip_reasons")
    return totals.join(by_location, keys, "left").join(by_reason, keys, "left")


def count_map(df: DataFrame, keys: list[str], label: str, count: str, name: str) -> DataFrame:
    """Map label -> sum of counts per key, labels in order."""
    summed = df.groupBy(*keys, F.col(label).alias("_label")).agg(F.sum(count).alias("_n"))
    return summed.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("_label", "_n")))).alias(name)
    )


def fragmented_paragraphs(runs: DataFrame, keys: list[str], flavor: str = "word") -> DataFrame:
    """Per paragraph: is it one sentence cut into runs that should be translated as a block?

    ``runs``: text, has_field.  A single hash aggregate.
    """
    text = F.coalesce("text", F.lit(""))
    field = F.coalesce("has_field", F.lit(False)) if flavor == "word" else F.lit(False)
    skipped = skip_reason(text, flavor).isNotNull()
    eligible = ~skipped & ~field
    blocked = ~is_blank(text) & (field | skipped)
    grouped = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(eligible).alias("eligible_runs"),
        F.bool_or(blocked).alias("has_blocked_run"),
        F.coalesce(F.sum(F.when(eligible, F.length(strip(text)))), F.lit(0)).alias("eligible_chars"),
    )
    return grouped.withColumn(
        "as_block",
        (F.col("eligible_runs") >= V.FRAGMENTED_MIN_RUNS) & ~F.col("has_blocked_run")
        & (F.col("eligible_chars") >= V.FRAGMENTED_MIN_CHARS),
    )


def newest_unread(messages: DataFrame, limit: int, keys: tuple[str, ...] = ("folder",)) -> DataFrame:
    """The newest unread messages of every folder.

    The rank limit also runs before the shuffle, so a huge folder ships ``limit`` rows per task.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc("received"), "message_id")
    return messages.filter("unread").withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= limit)

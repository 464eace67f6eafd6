"""Translation units: the plan made from paragraphs, captions and single blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as V
from ..functions.text import is_blank
from .blocks import PAGE, has_flag, is_content_text
from .reading import box_of
from .segments import count_map

UNIT = [
    "doc_id", "unit_id", "page_index", "source_block_ids", "source_span_ids", "x0", "y0", "x1", "y1", "text", "reading_order",
    "unit_type", "flags", "confidence", "is_skipped", "metadata",
]
FONTS = ["font_size", "font_name"]
REGION_ORDER = ["page_index", "y0", "x0", "region_id"]
# What a unit keeps of where it came from: the first three for units of a paragraph, the others for units of a block.
METADATA = (
    "struct<block_count:int,paragraph_candidate_id:string,column_indexes:array<int>,column_index:int,related_block_ids:array<string>,"
    "caption_for_block_id:string,region_kinds:array<string>>"
)


def span_ids() -> Column:
    """Ids of the non-empty spans of a block, in order."""
    lines = F.coalesce("lines", F.array())
    return F.flatten(F.transform(
        lines,
        lambda line, i: F.array_compact(F.transform(
            line["spans"],
            lambda s, j: F.when(s["text"] != "", F.concat(F.col("block_id"), F.lit("-l"), i, F.lit("-s"), j)),
        )),
    ))


def _barred() -> Column:
    return F.arrays_overlap("region_kinds", F.array(*[F.lit(k) for k in V.UNTRANSLATABLE_KINDS]))


def build_plan(protected: DataFrame, members: DataFrame, spans: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """Accepted and skipped units.

    ``protected``: blocks after region flags, with reading order.  ``members``: (doc, page, block,
    paragraph_no) of the paragraphs found before.  ``spans``: (doc, page, block, span_ids).  ``related``: (doc, page, block,
    related_block_ids) of blocks that captions join.  A paragraph is used when all its blocks are safe; every
    other block becomes a caption unit, a single unit, or a skipped unit.

    Blocks meet once, by paragraph or alone; a paragraph that cannot be used comes apart again in its row.
    """
    at = [*PAGE, "block_id"]
    blocks = protected.join(members.select(*at, "paragraph_no"), at, "left").join(spans.select(*at, F.col("span_ids").alias("_spans")), at)
    if related is not None:
        blocks = blocks.join(related.select(*at, F.col("related_block_ids").alias("_related")), at, "left")
    else:
        blocks = blocks.withColumn("_related", F.lit(None).cast("array<string>"))
    return plan_of(blocks)


def plan_of(blocks: DataFrame) -> DataFrame:
    """:func:`build_plan` of blocks that know their paragraph_no, ``_spans`` and ``_related``."""
    none = F.array().cast("array<string>")
    safe = is_content_text() & has_flag("translatable") & ~_barred() & ~has_flag("caption_like")
    part = F.struct(
        "reading_order", "block_id", F.coalesce("text", F.lit("")).alias("text"), "_spans", "x0", "y0", "x1", "y1",
        F.col("column_index").alias("column"), F.struct(*_single_unit()).alias("single"),
        F.struct(
            F.lit(None).cast("int").alias("block_count"), F.lit(None).cast("string").alias("paragraph_candidate_id"), F.lit(None).cast("array<int>").alias("column_indexes"),
            F.col("column_index"), F.coalesce("_related", none).alias("related_block_ids"), F.col("caption_for_block_id"), F.sort_array("region_kinds").alias("region_kinds"),
        ).cast(METADATA).alias("metadata"),
    )
    alone = F.when(F.col("paragraph_no").isNull(), F.col("block_id"))
    grouped = blocks.groupBy(*PAGE, "paragraph_no", alone.alias("_alone")).agg(
        *box_of(F.array_sort(F.collect_list(part)).alias("_parts"), F.bool_and(safe).alias("_safe"), F.min("reading_order").alias("reading_order"))
    ).withColumn("text", F.array_join(F.transform("_parts", lambda p: p["text"]), "\n"))
    whole = F.col("paragraph_no").isNotNull() & F.col("_safe") & ~is_blank(F.col("text"))
    several = F.size("_parts") > 1
    paragraph_id = F.format_string("p%d-para-%d", "page_index", "paragraph_no")

    def unit(**values: Column) -> Column:
        return F.struct(*[values[c].alias(c) for c in UNIT if c not in PAGE])

    flag = F.array(F.lit("translatable"))
    one = unit(
        unit_id=paragraph_id, source_block_ids=F.transform("_parts", lambda p: p["block_id"]), source_span_ids=F.flatten(F.transform("_parts", lambda p: p["_spans"])),
        x0=F.col("x0"), y0=F.col("y0"), x1=F.col("x1"), y1=F.col("y1"), text=F.col("text"), reading_order=F.col("reading_order"),
        unit_type=F.when(several, "paragraph").otherwise("single_block"), flags=flag, confidence=F.when(several, 0.9).otherwise(0.7), is_skipped=F.lit(False),
        metadata=F.struct(
            F.size("_parts").alias("block_count"), paragraph_id.alias("paragraph_candidate_id"),
            F.sort_array(F.array_distinct(F.transform("_parts", lambda p: F.coalesce(p["column"], F.lit(0))))).alias("column_indexes"), F.lit(None).cast("int").alias("column_index"),
            F.lit(None).cast("array<string>").alias("related_block_ids"), F.lit(None).cast("string").alias("caption_for_block_id"), F.lit(None).cast("array<string>").alias("region_kinds"),
        ).cast(METADATA),
    )

    def own(p: Column) -> Column:
        s = p["single"]
        return unit(
            unit_id=s["unit_id"], source_block_ids=F.array(p["block_id"]), source_span_ids=p["_spans"], x0=p["x0"], y0=p["y0"], x1=p["x1"], y1=p["y1"], text=s["text"],
            reading_order=p["reading_order"], unit_type=s["unit_type"], flags=s["flags"], confidence=s["confidence"], is_skipped=s["is_skipped"],
            # Only skipped units tell what shields them.
            metadata=F.when(s["is_skipped"], p["metadata"]).otherwise(p["metadata"].withField("region_kinds", F.lit(None).cast("array<string>"))),
        )

    units = F.when(whole, F.array(one)).otherwise(F.transform("_parts", own))
    return grouped.select(*PAGE, F.explode(units).alias("u")).select(*[F.col(c) if c in PAGE else F.col(f"u.{c}").alias(c) for c in UNIT])


def build_facts(protected: DataFrame, members: DataFrame) -> DataFrame:
    """The units of :func:`build_plan` as far as counts and checks look at them: no text, span or metadata travels.

    Blocks of a paragraph meet as ids and boxes; a block outside every paragraph is a unit at once.
    """
    at = [*PAGE, "block_id"]
    return facts_of(protected.join(members.select(*at, "paragraph_no"), at, "left"))


def facts_of(blocks: DataFrame, apart: bool = True) -> DataFrame:
    """:func:`build_facts` of blocks that know their paragraph_no; ``apart``: blocks outside every paragraph are told first, and do not travel."""
    at = [*PAGE, "block_id"]
    content, blank = (F.col("_content"), F.col("_blank")) if "_content" in blocks.columns else (is_content_text(), is_blank(F.col("text")))
    safe = content & has_flag("translatable") & ~_barred() & ~has_flag("caption_like")
    unit_id, _, unit_type, flags, _, is_skipped = _single_unit(content)
    fonts = [c for c in FONTS if set(FONTS) <= set(blocks.columns)]
    facts = ["unit_id", "unit_type", "flags", "is_skipped", *fonts]
    slim = blocks.select(
        *at, "x0", "y0", "x1", "y1", "reading_order", safe.alias("_safe"), blank.alias("_blank"), unit_id, unit_type, flags, is_skipped, "paragraph_no", *fonts
    )
    corners = ["x0", "y0", "x1", "y1"]
    columns = [*PAGE, "unit_id", "source_block_ids", *corners, "reading_order", "unit_type", "flags", "is_skipped", *fonts]
    common_font = {"font_size": F.array_min(F.filter("_parts.font_size", lambda s: s > 0)), "font_name": F.try_element_at(F.filter("_parts.font_name", lambda n: n.isNotNull()), F.lit(1))} if fonts else {}
    part = F.struct("reading_order", "block_id", *corners, *facts)
    lone = F.when(F.col("paragraph_no").isNull(), F.col("block_id"))
    met = slim.filter(F.col("paragraph_no").isNotNull()).groupBy(*PAGE, "paragraph_no") if apart else slim.groupBy(*PAGE, "paragraph_no", lone.alias("_alone"))
    grouped = met.agg(
        # A joined text is blank if all its parts are.
        *box_of(F.array_sort(F.collect_list(part)).alias("_parts"), F.bool_and("_safe").alias("_safe"), F.bool_and("_blank").alias("_blank"))
    )
    several = F.size("_parts") > 1

    def unit(**values: Column) -> Column:
        return F.struct(*[values[c].alias(c) for c in columns if c not in PAGE])

    one = unit(
        unit_id=F.format_string("p%d-para-%d", "page_index", "paragraph_no"), source_block_ids=F.transform("_parts", lambda p: p["block_id"]), **{c: F.col(c) for c in corners},
        reading_order=F.col("_parts")[0]["reading_order"], unit_type=F.when(several, "paragraph").otherwise("single_block"), flags=F.array(F.lit("translatable")), is_skipped=F.lit(False), **common_font,
    )
    own = F.transform("_parts", lambda p: unit(source_block_ids=F.array(p["block_id"]), **{c: p[c] for c in [*corners, "reading_order", *facts]}))
    together = grouped.select(*PAGE, F.inline(F.when(F.col("paragraph_no").isNotNull() & F.col("_safe") & ~F.col("_blank"), F.array(one)).otherwise(own)))
    if not apart:
        return together.select(*columns)
    alone = slim.filter(F.col("paragraph_no").isNull()).withColumn("source_block_ids", F.array("block_id"))
    return alone.select(*columns).unionByName(together.select(*columns))


def _single_unit(content: Column | None = None) -> list[Column]:
    """What a block becomes where it stands alone."""
    content = is_content_text() if content is None else content
    caption = content & has_flag("caption_like")
    single = content & has_flag("translatable") & ~_barred()
    case = F.when(caption, "caption").when(single, "single").otherwise("skipped")
    skipped_flags = F.array_compact(F.array(
        F.lit("protected_skipped"),
        F.when(F.array_contains("region_kinds", "formula") | has_flag("formula_like"), "formula_skipped"),
        F.when(F.array_contains("region_kinds", "table") | has_flag("table_like"), "table_skipped"),
        F.when(F.array_contains("region_kinds", "noisy") | has_flag("noisy"), "noisy_skipped"),
        F.when(
            F.col("kind").isin("image", "drawing")
            | F.arrays_overlap("region_kinds", F.array(F.lit("image"), F.lit("drawing"), F.lit("chart"))),
            "image_skipped",
        ),
        F.when(F.array_contains("region_kinds", "scanned_page") | has_flag("page_scanned"), "scanned_skipped"),
    ))
    flags = (
        F.when(caption, F.array(F.lit("translatable"), F.lit("caption")))
        .when(single, F.array(F.lit("translatable")))
        .otherwise(skipped_flags)
    )
    confidence = F.when(caption, 0.75).when(single, 0.7).when(F.col("kind") != "text", 0.95).otherwise(0.8)
    return [
        F.concat(F.col("block_id"), F.lit("-"), case).alias("unit_id"), F.when(F.col("kind") == "text", F.coalesce("text", F.lit(""))).otherwise("").alias("text"),
        F.when(caption, "caption").otherwise("single_block").alias("unit_type"), F.sort_array(flags).alias("flags"), confidence.alias("confidence"),
        (~caption & ~single).alias("is_skipped"),
    ]


def in_reading_order(units: DataFrame) -> DataFrame:
    return units.orderBy("doc_id", "page_index", "reading_order", "unit_id")


def regions_in_order(regions: DataFrame) -> DataFrame:
    """Protected regions by page, place on it, and id."""
    return regions.orderBy("doc_id", *REGION_ORDER)


def validation_errors(units: DataFrame) -> DataFrame:
    """(doc_id, error) rows: repeated ids, empty boxes, units without sources.

    Repeats come from a count per id; n occurrences give n - 1 errors.
    """
    repeats = units.groupBy("doc_id", "unit_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    repeated = repeats.select(
        "doc_id", F.explode(F.array_repeat(F.concat(F.lit("duplicate_unit_id:"), F.col("unit_id")), (F.col("n") - 1).cast("int"))).alias("error")
    )
    found = F.array_compact(F.array(
        F.when((F.col("x1") <= F.col("x0")) | (F.col("y1") <= F.col("y0")), F.concat(F.lit("missing_or_invalid_bbox:"), F.col("unit_id"))),
        F.when(F.size(F.coalesce("source_block_ids", F.array())) == 0, F.concat(F.lit("missing_source_blocks:"), F.col("unit_id"))),
    ))
    return repeated.unionByName(units.select("doc_id", F.explode(found).alias("error")))


def plan_warnings(units: DataFrame, page_info: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, warning) rows: unclear order, nothing to translate, validation errors."""
    unclear = page_info.filter(F.col("reading_order_warning") == "ambiguous_reading_order").select("doc_id").distinct()
    unclear = unclear.withColumn("warning", F.lit("ambiguous_reading_order"))
    scanned = regions.filter(F.col("kind") == "scanned_page").select("doc_id").distinct().withColumn("_scanned", F.lit(True))
    empty = (
        units.groupBy("doc_id").agg(F.count_if(~F.col("is_skipped")).alias("_open")).filter("_open = 0")
        .join(scanned, "doc_id", "left")
        .select("doc_id", F.when(F.col("_scanned"), "scanned_or_image_only_pdf").otherwise("no_translatable_units").alias("warning"))
    )
    return unclear.unionByName(empty).unionByName(validation_errors(units).withColumnRenamed("error", "warning"))


def plan_summary(units: DataFrame, warnings: DataFrame) -> DataFrame:
    """Public counts of a plan per document; holds no text."""
    open_unit = ~F.col("is_skipped")
    counts = units.groupBy("doc_id").agg(
        F.count_if(open_unit).alias("unit_count"),
        F.count_if(~open_unit).alias("skipped_unit_count"),
        F.count_if(open_unit & has_flag("translatable")).alias("translatable_unit_count"),
        F.count_if(open_unit & has_flag("caption")).alias("caption_unit_count"),
    )
    one = units.withColumn("_one", F.lit(1))
    types = count_map(one.filter(open_unit), ["doc_id"], "unit_type", "_one", "unit_type_counts")
    skipped_types = count_map(one.filter(~open_unit), ["doc_id"], "unit_type", "_one", "skipped_unit_type_counts")
    flags = count_map(
        one.filter(~open_unit).select("doc_id", F.explode("flags").alias("flag"), "_one"), ["doc_id"], "flag", "_one", "skipped_flag_counts"
    )
    warned = warnings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("warning_count"))
    out = counts
    for part in (types, skipped_types, flags, warned):
        out = out.join(part, "doc_id", "left")
    return out.fillna(0, subset=["warning_count"])


def selection_summary(units: DataFrame) -> DataFrame:
    """Skipped units and how many protected or noisy blocks they hold."""

    def blocks_with(flag: str) -> Column:
        held = F.when(F.col("is_skipped") & has_flag(flag), F.size("source_block_ids"))
        return F.coalesce(F.sum(held), F.lit(0))

    counts = units.groupBy("doc_id").agg(
        F.count_if("is_skipped").alias("skipped_units"),
        blocks_with("protected_skipped").alias("skipped_protected_blocks"),
        blocks_with("noisy_skipped").alias("skipped_noisy_blocks"),
    )
    kinds = count_map(
        units.filter(~F.col("is_skipped")).withColumn("_one", F.lit(1)), ["doc_id"], "unit_type", "_one", "unit_types_by_kind"
    )
    return counts.join(kinds, "doc_id", "left")


def fonts_of(facts: DataFrame) -> DataFrame:
    """:func:`unit_fonts` of units whose blocks told their fonts: smallest span size (0: none) and first font name."""
    size = F.when(F.col("font_size") > 0, F.col("font_size"))
    return facts.select(
        "doc_id", "unit_id", F.greatest(F.lit(8.0), F.coalesce(size, F.lit(11.0))).alias("font_size"), F.coalesce("font_name", F.lit("helv")).alias("font_name"),
    )


def unit_fonts(units: DataFrame, blocks: DataFrame) -> DataFrame:
    """Font of each unit: smallest span size (11 without spans, never under 8), first font name."""
    sources = units.select("doc_id", "unit_id", F.posexplode("source_block_ids").alias("block_place", "block_id"))
    spans = blocks.select(
        "doc_id", "block_id",
        F.flatten(F.transform(F.coalesce("lines", F.array()), lambda l: l["spans"])).alias("_spans"),
    )
    flat = sources.join(spans, ["doc_id", "block_id"]).select(
        "doc_id", "unit_id", "block_place", F.posexplode_outer("_spans").alias("span_place", "span")
    )
    grouped = flat.groupBy("doc_id", "unit_id").agg(
        F.min(F.when(F.col("span.size") > 0, F.col("span.size"))).alias("_size"),
        F.min_by("span.font", F.when(F.col("span.font") != "", F.struct("block_place", "span_place"))).alias("_font"),
    )
    return grouped.select(
        "doc_id", "unit_id", F.greatest(F.lit(8.0), F.coalesce("_size", F.lit(11.0))).alias("font_size"),
        F.coalesce("_font", F.lit("helv")).alias("font_name"),
    )

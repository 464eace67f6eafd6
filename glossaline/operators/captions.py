"""Captions: which text block belongs to which visual block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from .blocks import PAGE, has_flag, is_content_text, union_flags
from .reading import horizontal_overlap

MIN_SCORE = 0.85
MAX_CAPTION_CHARS = 180
SHORT_CAPTION_CHARS = 140
BAND = 80  # height of a page band; the closeness rules look less far than that


# Only at a letter that a cue begins with is the pattern tried.
CUE = "(?=[fFtTcChHbB図表])" + V.CAPTION_CUE_PATTERN


def is_visual() -> Column:
    return F.col("kind").isin("image", "drawing") | has_flag("table_like")


def _box(prefix: str) -> list[Column]:
    return [F.col(c).alias(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")]


def _bands(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / BAND), F.floor(high / BAND))


def score(t: dict[str, Column] | None = None, v: dict[str, Column] | None = None) -> Column:
    """Overlap plus closeness plus bonuses, over the boxes ``t`` and ``v`` (columns t_* and v_*, if not given) and the bonuses t_*."""
    t, v = ({c: F.col(f"{side}_{c}") for c in ("x0", "y0", "x1", "y1")} if box is None else box for side, box in (("t", t), ("v", v)))
    overlap = horizontal_overlap(t["x0"], t["x1"], v["x0"], v["x1"])
    below, above = t["y0"] - v["y1"], v["y0"] - t["y1"]
    zero = F.lit(0.0)
    near_below = F.when(below.between(-8.0, 72.0), F.lit(1.0) - F.greatest(below, zero) / 72.0).otherwise(0.0)
    near_above = F.when(above.between(-8.0, 40.0), F.lit(0.8) - F.greatest(above, zero) / 80.0).otherwise(0.0)
    return overlap + F.greatest(zero, near_below, near_above) + F.col("t_cue") + F.col("t_flagged") + F.col("t_short")


def _other_bonuses(chars: Column) -> list[Column]:
    return [
        F.when(has_flag("caption_like"), 0.15).otherwise(0.0).alias("t_flagged"),
        F.when(chars <= SHORT_CAPTION_CHARS, 0.1).otherwise(0.0).alias("t_short"),
    ]


def link_pages(blocks: DataFrame) -> DataFrame:
    """Blocks with ``caption_for_block_id``, ``caption_score`` and the caption flag, as :func:`caption_links` and :func:`apply_captions` give them.

    Pages lie whole in a partition and are of bounded size, so each text looks at all visuals of its page.  Texts are not
    looked at: :func:`judge_regions` has told what is asked of them.
    """
    corners = ["x0", "y0", "x1", "y1"]
    visual = F.when(is_visual(), F.struct("block_id", "ordinal", "kind", *corners))
    page = Window.partitionBy(*PAGE)
    t = {c: F.col(c) for c in corners}

    def rated(v: Column) -> Column:
        return F.struct(score(t, {c: v[c] for c in corners}).alias("score"), (-v["ordinal"]).alias("place"), v["block_id"].alias("id"), v["kind"].alias("kind"))

    others = F.filter("_visuals", lambda v: v["block_id"] != F.col("block_id"))
    may_caption = F.col("_content") & (F.col("_chars") <= MAX_CAPTION_CHARS)
    met = blocks.withColumns({
        "_visuals": F.collect_list(visual).over(page), "t_cue": F.when(F.col("_cue"), 0.25).otherwise(0.0),
        **{name: bonus for name, bonus in zip(("t_flagged", "t_short"), _other_bonuses(F.col("_chars")))},
    }).withColumn("_best", F.when(may_caption, F.array_max(F.transform(others, rated))))
    linked = (F.col("_best.score") >= MIN_SCORE) & ((F.col("_best.kind") != "text") | (F.col("t_cue") > 0))
    named = met.withColumns({"caption_for_block_id": F.when(linked, F.col("_best.id")), "caption_score": F.when(linked, F.col("_best.score"))})
    return _with_caption_flag(named).drop("_visuals", "t_cue", "t_flagged", "t_short", "_best")


def caption_links(blocks: DataFrame) -> DataFrame:
    """(doc, page, text block, visual block, score) for every linked caption.

    The score is the sum of a part that depends on the horizontal interval and a part that is
    positive only close by.  So the best visual of a text is either close, found through page
    bands, or the first visual of its horizontal interval.  Visuals are therefore reduced to the
    first two of each interval (two, because a text never captions itself) and to the first two
    of each exact box inside a band, before texts meet them: copies of a visual cost nothing.
    """
    texts = blocks.filter(is_content_text() & (F.length("text") <= MAX_CAPTION_CHARS)).select(
        *PAGE, F.col("block_id").alias("t_id"), *_box("t_"),
        F.when(F.col("text").rlike(CUE), 0.25).otherwise(0.0).alias("t_cue"), *_other_bonuses(F.length("text"))
    )
    visuals = blocks.filter(is_visual()).select(
        *PAGE, F.col("block_id").alias("v_id"), F.col("ordinal").alias("v_ordinal"), F.col("kind").alias("v_kind"), *_box("v_")
    )

    def first_two(df: DataFrame, *group: str) -> DataFrame:
        place = Window.partitionBy(*PAGE, *group).orderBy("v_ordinal")
        return df.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= 2).drop("_place")

    by_interval = first_two(visuals, "v_x0", "v_x1")
    by_box = first_two(visuals, "v_x0", "v_y0", "v_x1", "v_y1")
    banded_visuals = by_box.withColumn(
        "_spot", F.explode(F.array(
            F.struct(F.lit("below").alias("side"), F.floor(F.col("v_y1") / BAND).alias("band")),
            F.struct(F.lit("above").alias("side"), F.floor(F.col("v_y0") / BAND).alias("band")),
        ))
    ).select("*", "_spot.side", "_spot.band").drop("_spot")

    def spots(side: str, low: Column, high: Column) -> Column:
        return F.transform(_bands(low, high), lambda b: F.struct(F.lit(side).alias("side"), b.alias("band")))

    banded_texts = texts.withColumn("_spot", F.explode(F.concat(
        spots("below", F.col("t_y0") - 72, F.col("t_y0") + 8), spots("above", F.col("t_y1") - 8, F.col("t_y1") + 40)
    ))).select("*", "_spot.side", "_spot.band").drop("_spot")
    not_itself = F.col("t_id") != F.col("v_id")
    far = texts.join(by_interval, PAGE).filter(not_itself)
    close = banded_texts.join(banded_visuals, [*PAGE, "side", "band"]).filter(not_itself).drop("side", "band")
    scored = far.unionByName(close).select(*PAGE, "t_id", "t_cue", "v_id", "v_ordinal", "v_kind", score().alias("score"))
    # Highest score, the earlier visual on ties.
    best = scored.groupBy(*PAGE, "t_id").agg(
        F.max_by(F.struct("v_id", "v_kind", "score", "t_cue"), F.struct("score", -F.col("v_ordinal"))).alias("_b")
    )
    linked = best.filter(
        (F.col("_b.score") >= MIN_SCORE) & ((F.col("_b.v_kind") != "text") | (F.col("_b.t_cue") > 0))
    )
    return linked.select(
        *PAGE, F.col("t_id").alias("block_id"), F.col("_b.v_id").alias("caption_for_block_id"), F.col("_b.score").alias("score")
    )


def apply_captions(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """Add ``caption_for_block_id`` and the caption flag."""
    return _with_caption_flag(blocks.join(links.select("doc_id", "block_id", "caption_for_block_id"), ["doc_id", "block_id"], "left"))


def _with_caption_flag(blocks: DataFrame) -> DataFrame:
    flags = F.when(
        F.col("caption_for_block_id").isNotNull(), union_flags(F.col("flags"), F.array(F.lit("caption_like")))
    ).otherwise(F.col("flags"))
    return blocks.withColumn("flags", flags)


def related_blocks(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """(doc, page, block_id, caption_block_ids, related_block_ids) of the blocks that captions join.

    A visual block lists its captions in block order.  A caption is related to its visual; one that is
    a visual itself then also to its own captions further down.
    """
    at = blocks.select(*PAGE, "block_id", "ordinal")
    placed = links.select(*PAGE, "block_id", "caption_for_block_id").join(at, [*PAGE, "block_id"])
    captions = placed.groupBy(*PAGE, F.col("caption_for_block_id").alias("block_id")).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", F.col("block_id").alias("id")))).alias("_captions")
    )
    both = at.join(captions, [*PAGE, "block_id"], "left").join(
        links.select(*PAGE, "block_id", "caption_for_block_id"), [*PAGE, "block_id"], "left"
    ).filter(F.col("_captions").isNotNull() | F.col("caption_for_block_id").isNotNull())
    return both.select(*PAGE, "block_id", *_related())


def related_pages(blocks: DataFrame) -> DataFrame:
    """Linked blocks whose pages lie whole in a partition, with what :func:`related_blocks` tells of them; null where no caption joins a block."""
    link = F.when(F.col("caption_for_block_id").isNotNull(), F.struct("ordinal", F.col("block_id").alias("id"), F.col("caption_for_block_id").alias("of")))
    own = F.array_sort(F.transform(F.filter("_links", lambda l: l["of"] == F.col("block_id")), lambda l: F.struct(l["ordinal"].alias("ordinal"), l["id"].alias("id"))))
    met = blocks.withColumn("_links", F.collect_list(link).over(Window.partitionBy(*PAGE))).withColumn("_captions", own)
    joined = (F.size("_captions") > 0) | F.col("caption_for_block_id").isNotNull()
    return met.withColumns({name: F.when(joined, told) for name, told in zip(("caption_block_ids", "related_block_ids"), _related())}).drop("_links", "_captions")


def _related() -> list[Column]:
    none = F.array().cast("array<struct<ordinal:bigint,id:string>>")
    all_captions = F.coalesce("_captions", none)
    ids = lambda list_: F.transform(list_, lambda c: c["id"])
    later = F.filter(all_captions, lambda c: (c["ordinal"] > F.col("ordinal")) & (c["id"] != F.col("caption_for_block_id")))
    own = F.when(F.col("caption_for_block_id").isNotNull(), F.concat(F.array("caption_for_block_id"), ids(later))).otherwise(ids(all_captions))
    return [ids(all_captions).alias("caption_block_ids"), own.alias("related_block_ids")]


def nearby_captions(blocks: DataFrame) -> DataFrame:
    """For each visual block its caption: a linked one first, else one close below.

    ``blocks`` carry reading_order and caption_for_block_id.  Linked pairs meet on the id, close
    ones on page bands; the best is an aggregate.
    """
    captions = blocks.filter(is_content_text() & has_flag("caption_like")).select(
        *PAGE, F.col("block_id").alias("c_id"), F.col("caption_for_block_id").alias("v_id"), F.col("text").alias("c_text"),
        "reading_order", F.col("y0").alias("c_y0"), F.col("x0").alias("c_x0"),
    )
    visuals = blocks.filter(F.col("kind").isin("image", "drawing") | has_flag("image_like")).select(
        *PAGE, F.col("block_id").alias("v_id"), F.col("y1").alias("v_y1"), F.col("x1").alias("v_x1")
    )
    linked = captions.join(visuals.select(*PAGE, "v_id"), [*PAGE, "v_id"]).withColumn("_rank", F.lit(0))
    banded = captions.drop("v_id").withColumn("band", F.explode(_bands(F.col("c_y0") - 60, F.col("c_y0"))))
    # In a band the caption first in reading order wins for most visuals; every pair kept here is close.
    close = (
        banded.join(visuals.withColumn("band", F.floor(F.col("v_y1") / BAND)), [*PAGE, "band"])
        .filter((F.col("c_y0") - F.col("v_y1")).between(0, 60) & (F.col("c_x0") <= F.col("v_x1") + 40))
        .withColumn("_rank", F.lit(1))
    )
    columns = [*PAGE, "v_id", "c_id", "c_text", "_rank", "reading_order", "c_y0", "c_x0"]
    pairs = linked.select(*columns).unionByName(close.select(*columns))
    best = pairs.groupBy(*PAGE, "v_id").agg(
        F.min_by(F.struct("c_id", "c_text"), F.struct("_rank", "reading_order", "c_y0", "c_x0", "c_id")).alias("_c")
    )
    return best.select(*PAGE, F.col("v_id").alias("block_id"), F.col("_c.c_id").alias("caption_id"), F.col("_c.c_text").alias("caption_text"))

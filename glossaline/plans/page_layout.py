"""The page-layout chain as a set of tables, each built from the ones before.

Two plans give the same tables.  Where a document and its pages are of ordinary size its blocks meet once, in one partition, and
all steps look at whole pages there.  A crowded document goes through joins and chunked scans, which hold no page together.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..operators.blocks import PAGE, flag_judged, flag_judged_pages, judge_blocks
from ..operators.captions import apply_captions, caption_links, link_pages, related_blocks, related_pages
from ..operators.reading import block_order, font_name, font_size, order_pages, paragraph_members, paragraphs, paragraphs_of
from ..operators.regions import REGION_COLUMNS, apply_regions, detect_pages, detect_regions, judge_regions
from ..operators.units import build_facts, build_plan, facts_of, plan_of, span_ids
from ..session import materialize

#: Blocks of a page that may meet in one row's list, and blocks of a document that may lie in one partition.
PAGE_BLOCKS, DOCUMENT_BLOCKS = 400, 100_000


@dataclass
class JoinedLayout:
    """The chain by joins, for pages that may hold any share of all blocks.

    Tables several others read (flagged blocks, caption links, ordered blocks) are written once, so no
    step runs twice and a lost executor costs only its own task.
    """

    judged: DataFrame
    pages: DataFrame

    @cached_property
    def flagged(self) -> DataFrame:
        return materialize(flag_judged(self.judged), "flagged-blocks")

    @cached_property
    def links(self) -> DataFrame:
        return materialize(caption_links(self.flagged), "caption-links")

    @cached_property
    def captioned(self) -> DataFrame:
        return apply_captions(self.flagged, self.links)

    @cached_property
    def page_info(self) -> DataFrame:
        return self.ordered.select(*PAGE, "column_count", "reading_order_strategy", "reading_order_warning").distinct()

    @cached_property
    def ordered(self) -> DataFrame:
        return materialize(self.captioned.join(block_order(self.flagged, self.pages), [*PAGE, "block_id"]), "ordered-blocks")

    @cached_property
    def members(self) -> DataFrame:
        return paragraph_members(self.ordered)

    @cached_property
    def paragraphs(self) -> DataFrame:
        return paragraphs(self.members, self.ordered)

    @cached_property
    def regions(self) -> DataFrame:
        return materialize(detect_regions(self.ordered, self.pages), "regions")

    @cached_property
    def protected(self) -> DataFrame:
        return materialize(apply_regions(self.ordered, self.regions), "protected-blocks")

    @cached_property
    def unit_facts(self) -> DataFrame:
        """Units without texts, spans and metadata, for counts and checks, which read them several times."""
        return materialize(build_facts(self.protected, self.members), "unit-facts")

    @cached_property
    def units(self) -> DataFrame:
        return build_plan(self.protected, self.members, self.judged.select(*PAGE, "block_id", "span_ids"), self.related)

    @cached_property
    def related(self) -> DataFrame:
        return related_blocks(self.flagged, self.links)


@dataclass
class WholePages:
    """The chain over partitions that hold whole documents, of ordinary size: one shuffle, and windows over pages in place of joins.

    ``kept``: the laid-out blocks are written once, for those who read several tables; else each table is worked out from the judged blocks.
    Without ``texts`` they stay behind, for those who count.
    """

    judged: DataFrame
    kept: bool = True
    texts: bool = True
    together: bool = False

    @cached_property
    def flagged(self) -> DataFrame:
        return flag_judged_pages(self.judged if self.together else self.judged.repartition("doc_id"))

    @cached_property
    def captioned(self) -> DataFrame:
        return link_pages(self.flagged)

    @cached_property
    def rows(self) -> DataFrame:
        placed = self.captioned.filter(" and ".join(f"{c} is not null" for c in [*PAGE, "block_id"]))
        rows = detect_pages(related_pages(order_pages(placed)))
        rows = rows if self.texts else rows.drop("text", "span_ids")
        return materialize(rows, "laid-out-blocks") if self.kept else rows

    @cached_property
    def links(self) -> DataFrame:
        found = (self.rows if self.kept else self.captioned).filter("caption_for_block_id is not null")
        return found.select(*PAGE, "block_id", "caption_for_block_id", F.col("caption_score").alias("score"))

    @cached_property
    def ordered(self) -> DataFrame:
        return self.rows.withColumn("flags", F.col("own_flags")).drop("own_flags", "regions", "region_kinds", "caption_block_ids", "related_block_ids", "caption_score")

    @cached_property
    def members(self) -> DataFrame:
        return self.rows.filter("paragraph_no is not null").select(*PAGE, "block_id", "paragraph_no")

    @cached_property
    def paragraphs(self) -> DataFrame:
        return paragraphs_of(self.ordered.filter("paragraph_no is not null"))

    @cached_property
    def page_info(self) -> DataFrame:
        # The first block of a page tells of it.
        return self.rows.filter("reading_order = 0").select(*PAGE, "column_count", "reading_order_strategy", "reading_order_warning")

    @cached_property
    def regions(self) -> DataFrame:
        return self.rows.select(*PAGE, F.inline("regions"))

    @cached_property
    def protected(self) -> DataFrame:
        return self.rows.drop("own_flags", "regions", "caption_block_ids", "related_block_ids", "caption_score")

    @cached_property
    def unit_facts(self) -> DataFrame:
        facts = facts_of(self.protected, apart=False)
        return materialize(facts, "unit-facts") if self.kept else facts

    @cached_property
    def units(self) -> DataFrame:
        return plan_of(self.rows.withColumns({"_spans": F.col("span_ids"), "_related": F.col("related_block_ids")}))

    @cached_property
    def related(self) -> DataFrame:
        found = related_pages(self.captioned).filter("related_block_ids is not null")
        return found.select(*PAGE, "block_id", "caption_block_ids", "related_block_ids")


@dataclass
class PageLayout:
    """Blocks and pages in, layout tables out; a table is planned when first asked for.

    ``pages`` (doc, page, width, height), or the blocks say ``page_width`` and ``page_height``.  ``kept``, ``texts``: see :class:`WholePages`.
    ``page_blocks`` and ``document_blocks`` bound what meets in one place; beyond them a document is laid out by joins.  ``sizes`` (doc_id,
    page_blocks, all_blocks) tells how many blocks a document has in all and on a page at most, where that is known without counting.
    ``together``: the blocks of a document already lie in one partition, as they come.
    """

    blocks: DataFrame
    pages: DataFrame | None = None
    kept: bool = True
    texts: bool = True
    page_blocks: int = PAGE_BLOCKS
    document_blocks: int = DOCUMENT_BLOCKS
    sizes: DataFrame | None = None
    together: bool = False

    @cached_property
    def judged(self) -> DataFrame:
        blocks = self.blocks
        if "lines" in blocks.columns:
            # The nested lines and spans stay behind: the chain needs little of them.
            lines = F.col("lines")
            blocks = blocks.withColumns({"font_size": font_size(lines), "font_name": font_name(lines), "span_ids": span_ids()})
        elif "span_ids" not in blocks.columns:
            blocks = blocks.withColumn("span_ids", F.lit(None).cast("array<string>"))
        if self.pages is not None:
            size = self.pages.select(*PAGE, F.col("width").alias("page_width"), F.col("height").alias("page_height"))
            blocks = blocks.join(size, PAGE)
        return judge_regions(judge_blocks(blocks)).drop("lines", "joined_lines")

    @cached_property
    def _parts(self) -> list:
        """The ordinary documents and, if there are any, the crowded ones, each with the plan that suits them."""
        judged, sizes = self.judged, self.sizes
        if sizes is None:
            judged = materialize(judged, "judged-blocks")
            counted = judged.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("_n"))
            sizes = counted.groupBy("doc_id").agg(F.max("_n").alias("page_blocks"), F.sum("_n").alias("all_blocks"))
        crowded = sizes.filter((F.col("page_blocks") > self.page_blocks) | (F.col("all_blocks") > self.document_blocks))
        found = materialize(crowded.select("doc_id"), "crowded-documents")
        if found.isEmpty():
            # With their sizes known, blocks are judged and laid out in one go: what a query does not ask for is neither written nor worked out.
            return [WholePages(judged, self.kept, self.texts, self.together and self.sizes is not None)]
        judged = materialize(judged, "judged-blocks") if self.sizes is not None else judged
        same = judged["doc_id"].eqNullSafe(found["doc_id"])
        few, many = judged.join(found, same, "left_anti"), judged.join(found, same, "left_semi")
        sizes = many.select(*PAGE, F.col("page_width").alias("width"), F.col("page_height").alias("height")).distinct()
        return [WholePages(few, self.kept, self.texts), JoinedLayout(many.drop(*REGION_COLUMNS), sizes)]

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        tables = [getattr(part, name) for part in self._parts]
        if len(tables) == 1:
            out = tables[0]
        else:
            shared = [c for c in tables[1].columns if c in tables[0].columns]
            out = tables[0].select(*shared).unionByName(tables[1].select(*shared))
        self.__dict__[name] = out
        return out


TABLES = ("flagged", "links", "captioned", "page_info", "ordered", "members", "paragraphs", "regions", "protected", "unit_facts", "units", "related")

"""Main text of web pages: page furniture goes by element kind, and site templates by recurrence.

One pass over the pages cuts each into text blocks and hashes the subtree of every element that
could belong to the site's template.  Spark counts those hashes per host, and a block goes if a
subtree around it recurs on many pages of that host.  Pages of equal text count once, so copies of an
article do not turn its parts into a template.

What is kept: the blocks of ``<article>`` or ``<main>``, else of the body, without navigation,
headers, footers, sidebars, forms, scripts, notices, adverts and reader comments, told by tag, role,
or by name in class or id.  Paragraphs, headings and list items that stand in the article itself are
never template alone; other elements inside it (with all they hold) are, if most pages of the host have
them, as is what recurs around it on pages that mark no article.

Defined results: null and empty html give no blocks; a null url is a host of its own; broken and
unclosed markup is read as far as it goes; ``<br>`` is white space.  Repeated rows are repeated.
Each page is held by one task at a time; nothing else is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd figcaption td th tr tbody caption b i em strong span a".split())
PASSAGES = frozenset("ul ol dl table figure".split())  # and section and div with text of their own: parts of a text as prose is
HEADINGS = frozenset("h1 h2 h3".split())
# A start tag of the key ends an open element of the value, unless one of the last column stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
UNSEEN = frozenset("script style noscript template head title iframe object svg canvas audio video select textarea button datalist math".split())
FURNITURE = frozenset("nav footer aside dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
# Words of a class or id that name page furniture.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion banner nav navbar navigation navi menu breadcrumb"
    " breadcrumbs pagination pager header masthead footer sidebar aside widget widgets cookie cookies consent gdpr notice notices notification alert popup"
    " modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments respond disqus replies search skip toolbar".split()
)
STATE = frozenset("has no with is without show hide js".split())  # names that begin so describe the page, not the element
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
INSIDE_SHARE = 0.6  # an element with this share of the words holds the text of a page that marks no article
NAMED_SHARE = 0.9  # on such a page, an element with more of the words is no furniture, whatever its name


class Frame:
    __slots__ = ("tag", "start", "parts", "furniture", "named", "article", "holds_article", "heading", "bears")

    def __init__(self, tag: str, start: int, attrs: dict) -> None:
        name = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        role = attrs.get("role") or ""
        self.tag, self.start, self.parts = tag, start, [tag, name]
        self.article = tag in ("article", "main") or role in ("main", "article")
        self.furniture = tag in UNSEEN or tag in FURNITURE or role in ROLES or "hidden" in attrs or "display:none" in (attrs.get("style") or "").replace(" ", "")
        words = [SPLIT.split(x) for x in name.split()]
        self.named = tag == "form" or tag == "header" or (tag not in ("html", "body") and any(w[0] not in STATE and any(x.lower() in NAMES for x in w) for w in words))
        self.holds_article = self.heading = self.bears = False


class Page(HTMLParser):
    """Text blocks of one page and the elements around them, without building a tree."""

    def __init__(self) -> None:
        import xxhash

        super().__init__(convert_charrefs=True)
        self.hash = xxhash.xxh64_intdigest
        self.frames, self.blocks, self.buffer = [Frame("", 0, {})], [], []
        self.spans: list[tuple[int, int, int, Frame, bool]] = []  # start, end, hash, element, inside an article

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        if text:
            self.blocks.append(text)
            self.frames[-1].parts.append(text)
            self.frames[-1].bears = True

    def close_frame(self) -> None:
        if self.frames[-1].tag in BLOCKS or self.frames[-1].tag in UNSEEN:
            self.flush()
        frame = self.frames.pop()
        if len(self.blocks) > frame.start:
            value = self.hash("\x1f".join(frame.parts))
            self.frames[-1].parts.append(str(value))
            self.spans.append((frame.start, len(self.blocks), value - (1 << 63), frame, any(f.article for f in self.frames)))

    def close_open(self, tags: set, bounds: set) -> None:
        for at in range(len(self.frames) - 1, 0, -1):
            if self.frames[at].tag in bounds:
                return
            if self.frames[at].tag in tags:
                while len(self.frames) > at:
                    self.close_frame()
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            if tag in ENDS:
                self.close_open(*ENDS[tag])
            elif tag not in ("option", "html", "body"):
                self.close_open({"p"}, {"td", "th", "button", "table", "div", "li", "article", "section", "blockquote"} - {tag})
            self.flush()
        if tag in VOID:
            if tag in ("br", "hr", "img", "wbr"):
                self.buffer.append(" " if tag != "wbr" else "")
            return
        if tag in UNSEEN:
            self.flush()
        frame = Frame(tag, len(self.blocks), dict(attrs))
        if frame.article:
            for f in self.frames:
                f.holds_article = True
        if tag in HEADINGS:
            for f in self.frames:
                f.heading = True
        self.frames.append(frame)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # as browsers do, the slash is ignored but on void elements

    def handle_endtag(self, tag: str) -> None:
        inline = tag not in BLOCKS and tag not in UNSEEN
        for at in range(len(self.frames) - 1, 0, -1):
            if self.frames[at].tag == tag:
                while len(self.frames) > at:
                    self.close_frame()
                return
            if inline and self.frames[at].tag in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        self.buffer.append(data)

    def finish(self) -> tuple[list[tuple[str, list[int]]], int]:
        """The kept blocks with the marks of the elements around each (odd: only recurrence on most pages removes it), and a hash of their text."""
        self.close()
        while len(self.frames) > 1:
            self.close_frame()
        self.flush()
        n = len(self.blocks)
        words = [0]
        for text in self.blocks:
            words.append(words[-1] + text.count(" ") + 1)
        dropped = bytearray(n)
        for start, end, _, frame, _ in self.spans:
            if frame.furniture:
                dropped[start:end] = b"\1" * (end - start)
        seen = [0]
        for i in range(n):
            seen.append(seen[-1] + (words[i + 1] - words[i]) * (1 - dropped[i]))
        marked = any(f.article and seen[e] > seen[s] for s, e, _, f, _ in self.spans)
        for start, end, _, frame, inside in self.spans:
            if frame.named and not frame.holds_article and not (inside and frame.heading) and (marked or seen[end] - seen[start] <= NAMED_SHARE * seen[n]):
                dropped[start:end] = b"\1" * (end - start)
        articles = [(s, e) for s, e, _, f, inside in self.spans if f.article and not all(dropped[s:e])]
        tight = [(s, e) for s, e, _, f, _ in self.spans if f.tag == "article" and not all(dropped[s:e])]
        held = tight or articles
        left = [0]
        for i in range(n):
            left.append(left[-1] + (words[i + 1] - words[i]) * (1 - dropped[i]))
        if held:
            inside_text = bytearray(n)
            for s, e in held:
                inside_text[s:e] = b"\1" * (e - s)
            for i in range(n):
                dropped[i] |= 1 - inside_text[i]
        else:  # spans end from the inside out: the first large one is the deepest
            s, e = next(((s, e) for s, e, _, f, _ in self.spans if f.tag not in PROSE and left[e] - left[s] >= INSIDE_SHARE * left[n] > 0), (0, n))
            inside_text = bytearray(n)
            inside_text[s:e] = b"\1" * (e - s)
            held = [(s, e)]
        marks: list[list[int]] = [[] for _ in range(n)]
        for start, end, value, frame, _ in self.spans:
            if all(dropped[start:end]) or any(start <= s and e <= end for s, e in held):
                continue
            if not (frame.tag in PROSE and inside_text[start]):
                firm = inside_text[start] and (marked or frame.tag in PASSAGES or (frame.bears and frame.tag in ("section", "div")))
                for i in range(start, end):
                    marks[i].append(value & ~1 | bool(firm))
        kept = [(self.blocks[i], marks[i]) for i in range(n) if not dropped[i]]
        return kept, self.hash("\n".join(text for text, _ in kept)) - (1 << 63)


def read(html: str | None) -> tuple[list[tuple[str, list[int]]], int]:
    page = Page()
    page.feed(html or "")
    return page.finish()


def blocks(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The pages with ``_blocks``: array of (text, marks), ``_copy``: a hash of their text, and ``_host``."""

    @F.pandas_udf("blocks array<struct<text: string, marks: array<bigint>>>, copy bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [read(value) for value in batch]
            yield pd.DataFrame({"blocks": [[{"text": t, "marks": m} for t, m in b] for b, _ in found], "copy": [x for _, x in found]})

    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    return small_batches(pages, 256).withColumn("_page", run(F.col(html))).withColumns(
        {"_blocks": F.col("_page.blocks"), "_copy": F.col("_page.copy"), "_host": host}
    ).drop("_page")


def extract(
    pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id",), min_pages: int = 5, min_share: float = 0.01, inside_share: float = 0.5,
) -> DataFrame:
    """(keep..., url, host, blocks): the kept text blocks of each page in page order.

    A subtree is template if it stands on at least ``min_pages`` pages of its host
    that differ in text, and on the share ``min_share`` of them; inside a marked article, and for lists, tables,
    figures and passages in the text of other pages, on more than the share ``inside_share``.
    """
    parsed = blocks(pages.select(*keep, F.col(url).alias("url"), F.col(html).alias("_html")), "url", "_html").drop("_html")
    parsed = materialize(parsed.withColumn("_row", F.monotonically_increasing_id()), "page-blocks")
    marked = parsed.select("_row", "_host", "_copy", F.explode(F.array_distinct(F.flatten(F.col("_blocks.marks")))).alias("mark"))
    per_host = parsed.select("_host", "_copy").distinct().groupBy("_host").agg(F.count("*").alias("pages"))
    # Of a subtree that some pages hold firmly and others do not, all pages count: marks differ in the last bit alone.
    counted = marked.select("_host", F.shiftright("mark", 1).alias("tree"), "_copy").distinct().groupBy("_host", "tree").agg(F.count("*").alias("n"))
    recurring = (
        counted.filter(F.col("n") >= min_pages).join(per_host, "_host").filter(F.col("n") >= min_share * F.col("pages"))
        .select("_host", "tree", (F.col("n") > inside_share * F.col("pages")).alias("most"))
    )
    # One list per page, no longer than the page has elements.
    met = marked.withColumn("tree", F.shiftright("mark", 1)).join(recurring, ["_host", "tree"]).filter(F.col("most") | (F.col("mark").bitwiseAND(1) == 0))
    template = met.groupBy("_row").agg(F.collect_set("mark").alias("_template"))
    out = [*keep, "url", F.col("_host").alias("host")]
    # Texts of pages without any such element need not move to meet the list.
    none = F.size(F.flatten(F.col("_blocks.marks"))) == 0
    plain = parsed.filter(none).select(*out, F.col("_blocks.text").alias("blocks"))
    left = F.filter("_blocks", lambda b: ~F.coalesce(F.arrays_overlap(b["marks"], F.col("_template")), F.lit(False)))
    cleaned = parsed.filter(~none).join(template, "_row", "left").select(*out, F.transform(left, lambda b: b["text"]).alias("blocks"))
    return plain.unionByName(cleaned)

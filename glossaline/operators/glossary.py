"""Glossary: listing, term matching, prompts, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import fixed_values as V
from ..functions.text import is_blank, normalize, prompt_value
from ..plans.changes import apply_changes
from ..plans.substrings import BROADCAST_BYTES, offers

TERM_BYTES = 64  # of a broadcast term besides its texts


def list_terms(
    glossary: DataFrame,
    source_lang: str | None = None,
    target_lang: str | None = None,
    domain: str | None = None,
    active_only: bool = True,
) -> DataFrame:
    """Terms by filter, longest source term first."""
    out = glossary
    if active_only:
        out = out.filter(F.col("is_active"))
    if source_lang and source_lang.lower() != "auto":
        out = out.filter(F.col("source_lang") == source_lang.strip().lower())
    if target_lang:
        out = out.filter(F.col("target_lang") == target_lang.strip().lower())
    if domain:
        out = out.filter(F.col("domain") == domain.strip())
    return out.orderBy(F.desc(F.length("source_term")), "id")


def _bytes_of(terms: DataFrame) -> int:
    """Bound of the broadcast terms, four bytes a character."""
    chars = sum((F.length(F.coalesce(c, F.lit(""))) for c in ("_term", "source_term", "target_term")), F.lit(0))
    return terms.agg(F.coalesce(F.sum(4 * chars + TERM_BYTES), F.lit(0))).first()[0]


def _terms_and_offers(segments: DataFrame, glossary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms in use, and what every text of a language pair with terms offers to be one: seg_id, _source, _target, _term."""
    terms = glossary.filter(F.col("is_active") & ~is_blank(F.col("source_term"))).select(
        F.col("id").alias("_term_no"),
        F.lower("source_term").alias("_term"),
        "source_term",
        "target_term",
        F.lower(F.trim("source_lang")).alias("_term_source"),
        F.lower(F.trim("target_lang")).alias("_term_target"),
    )
    texts = segments.filter(~is_blank(F.col("text"))).select(
        "seg_id",
        F.lower(F.trim("source_lang")).alias("_source"),
        F.lower(F.trim("target_lang")).alias("_target"),
        "text",
    )
    # A few languages at most; texts that no term is for are not looked at.
    spoken = F.broadcast(terms.select("_term_source", "_term_target").distinct())
    texts = texts.join(spoken, _same_languages(), "left_semi")
    texts = texts.select("seg_id", "_source", "_target", F.lower(normalize(F.col("text"))).alias("_text"))
    return terms, offers(texts, "_text", terms, "_term")


def _same_languages() -> Column:
    return (F.col("_target") == F.col("_term_target")) & ((F.col("_source") == "auto") | (F.col("_source") == F.col("_term_source")))


def match_terms(segments: DataFrame, glossary: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(seg_id, term columns) for every active term a segment contains, ignoring case.

    ``segments``: seg_id (unique), source_lang, target_lang, text.  Source language ``auto``
    accepts terms of any source language.  Texts are searched where they are read.  Terms of up to
    ``broadcast_bytes`` are sent to every executor, and nothing is shuffled; else the ids of segments meet the terms
    on the term.
    """
    terms, offered = _terms_and_offers(segments, glossary)
    if _bytes_of(terms) <= broadcast_bytes:
        terms = F.broadcast(terms)
    met = offered.join(terms, "_term").filter(_same_languages())
    return met.select("seg_id", F.col("_term_no").alias("term_id"), "source_term", "target_term")


def count_matches(segments: DataFrame, glossary: DataFrame) -> DataFrame:
    """In how many segments each term stands: (term_id, source_term, segments) of the terms that :func:`match_terms` finds.

    What texts offer is counted before it meets the terms, so only counts travel, whatever the size of the glossary.
    """
    terms, offered = _terms_and_offers(segments, glossary)
    counted = offered.groupBy("_term", "_source", "_target").agg(F.count(F.lit(1)).alias("_segments"))
    met = counted.join(terms, "_term").filter(_same_languages())
    return met.groupBy(F.col("_term_no").alias("term_id"), "source_term").agg(F.sum("_segments").alias("segments"))


def top_terms(matches: DataFrame, limit: int = V.MAX_GLOSSARY_TERMS) -> DataFrame:
    """Keep at most ``limit`` terms per segment, longest first (``rank`` from 1).

    The rank limit is applied in every task before the shuffle, so a segment with very many
    matches sends only its best few.
    """
    longest = Window.partitionBy("seg_id").orderBy(F.desc(F.length("source_term")), "term_id")
    return matches.withColumn("rank", F.row_number().over(longest)).filter(F.col("rank") <= limit)


def prompt_lines(ranked: DataFrame, flatten: bool = True) -> DataFrame:
    """Per segment the prompt lines ``source => target`` in rank order; empty sides drop out.

    A term with line ends becomes one line, so that no glossary entry can add lines of its own to a prompt.
    Without ``flatten`` terms stand as stored: for glossaries that are trusted, or compared as they are.
    """
    source, target = (prompt_value(F.col(c)) if flatten else F.coalesce(c, F.lit("")) for c in ("source_term", "target_term"))
    lines = ranked.select("seg_id", "rank", source.alias("_s"), target.alias("_t")).filter("_s != '' AND _t != ''")
    # Bounded by the term limit per segment.
    return lines.groupBy("seg_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" => ", "_s", "_t").alias("line")))),
            lambda x: x["line"],
        ).alias("glossary_lines")
    )


def build_prompts(segments: DataFrame, lines: DataFrame) -> DataFrame:
    """Translation prompt per segment, with its glossary part when it has one."""
    joined = segments.join(lines, "seg_id", "left")
    part = F.when(
        F.size("glossary_lines") > 0,
        F.concat(F.lit(V.PROMPT_GLOSSARY), F.array_join("glossary_lines", "\n"), F.lit("\n")),
    ).otherwise("")
    prompt = F.concat(
        F.lit(V.PROMPT_TASK), F.col("source_lang"), F.lit(V.PROMPT_TO), F.col("target_lang"), F.lit(V.PROMPT_RULE), part,
        F.lit(V.PROMPT_TEXT), F.col("text"), F.lit(V.PROMPT_ANSWER),
    )
    return joined.select("seg_id", prompt.alias("prompt"))


def edit_terms(glossary: DataFrame, changes: DataFrame) -> DataFrame:
    """Insert, partially update and delete terms; inserts without both terms are refused."""
    return apply_changes(glossary, changes, "id", required=("source_term", "target_term"))

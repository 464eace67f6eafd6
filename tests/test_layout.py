import re

import pytest
from pyspark.sql import functions as F

from glossaline import schemas
from glossaline.operators import fit as FIT
from glossaline.operators import qa as Q
from glossaline.operators import units as U
from glossaline.plans.page_layout import PageLayout

CASES = {
    "single": [("Top block", 72, 72, 280, 105), ("Middle block", 72, 136, 280, 169), ("Bottom block", 72, 200, 280, 233)],
    "columns": [("LEFT A", 50, 60, 220, 96), ("RIGHT A", 320, 72, 520, 108), ("LEFT B", 50, 132, 220, 168), ("RIGHT B", 320, 144, 520, 180)],
    "ambiguous": [("LEFT BLOCK", 50, 60, 220, 96), ("CENTER WIDE BLOCK", 110, 116, 520, 168), ("RIGHT BLOCK", 320, 180, 520, 216)],
    "paragraphs": [("First paragraph line", 72, 72, 320, 102), ("Second paragraph line", 72, 104, 320, 134), ("Separate paragraph", 72, 220, 320, 250)],
    "formula": [("Intro text", 72, 72, 320, 102), ("E = mc^2", 72, 112, 320, 154), ("Outro text", 72, 160, 320, 190)],
    "table": [("Item   Qty   Price\nA   1   2", 72, 72, 360, 160), ("Table 1: Inventory sample", 72, 172, 360, 206)],
    "image": [("", 72, 72, 220, 220), ("Figure 1: Chart sample", 72, 236, 320, 280)],
    "scanned": [("", 20, 20, 575, 822)],
    "noisy": [("A", 72, 68, 75, 73), ("=", 92, 68, 95, 73), ("Stable text block", 72, 120, 320, 200)],
}


@pytest.fixture(scope="module")
def chain(spark):
    rows = []
    for doc, blocks in CASES.items():
        for i, (text, x0, y0, x1, y1) in enumerate(blocks):
            box = [float(v) for v in (x0, y0, x1, y1)]
            lines = [(line, *box, [(line, "helv", 12.0, *box)]) for line in text.split("\n")] if text else []
            rows.append((doc, 0, f"p0-b{i}", i, "text" if text else "image", *box, text, lines, []))
    blocks = spark.createDataFrame(rows, schemas.BLOCKS)
    pages = spark.createDataFrame([(doc, 0, 595.0, 842.0, 0) for doc in CASES], schemas.PAGES)
    return PageLayout(blocks, pages)


def of(df, doc):
    return df.filter(F.col("doc_id") == doc)


def test_reading_order(chain):
    def order(doc):
        return [r["text"] for r in of(chain.ordered, doc).orderBy("reading_order").collect()]

    assert order("single") == ["Top block", "Middle block", "Bottom block"]
    assert order("columns") == ["LEFT A", "LEFT B", "RIGHT A", "RIGHT B"]
    assert [r["column_index"] for r in of(chain.ordered, "columns").orderBy("reading_order").collect()] == [0, 0, 1, 1]
    assert order("ambiguous") == ["LEFT BLOCK", "CENTER WIDE BLOCK", "RIGHT BLOCK"]
    assert of(chain.page_info, "ambiguous").first()["reading_order_warning"] == "ambiguous_reading_order"


def test_paragraphs(chain):
    rows = of(chain.paragraphs, "paragraphs").orderBy("reading_order").collect()
    assert [len(r["block_ids"]) for r in rows] == [2, 1] and rows[0]["text"] == "First paragraph line\nSecond paragraph line"
    rows = of(chain.paragraphs, "formula").collect()
    assert len(rows) == 2 and all("p0-b1" not in r["block_ids"] for r in rows)


def test_captions_and_regions(chain):
    links = {(r["doc_id"], r["block_id"]): r["caption_for_block_id"] for r in chain.links.collect()}
    assert links[("table", "p0-b1")] == "p0-b0" and links[("image", "p0-b1")] == "p0-b0"
    kinds = {doc: {r["kind"] for r in of(chain.regions, doc).collect()} for doc in CASES}
    assert "chart" in kinds["image"] and "scanned_page" in kinds["scanned"] and "table" in kinds["table"] and "formula" in kinds["formula"]


def test_noisy_blocks_and_units(chain):
    flags = {r["block_id"]: set(r["flags"]) for r in of(chain.flagged, "noisy").collect()}
    assert "noisy" in flags["p0-b0"] and "noisy" in flags["p0-b1"] and flags["p0-b2"] == {"translatable"}
    units = {doc: of(chain.units, doc).collect() for doc in ("scanned", "noisy")}
    assert all(u["is_skipped"] for u in units["scanned"]) and [u["text"] for u in units["noisy"] if not u["is_skipped"]] == ["Stable text block"]
    warnings = {(r["doc_id"], r["warning"]) for r in U.plan_warnings(chain.units, chain.page_info, chain.regions).collect()}
    assert ("scanned", "scanned_or_image_only_pdf") in warnings


def test_plan_validation(spark):
    rows = [("d", "u1", 0.0, 0.0, 1.0, 1.0, ["b"]), ("d", "u1", 0.0, 0.0, 1.0, 1.0, ["b"]), ("d", "u2", 0.0, 0.0, 0.0, 0.0, ["b"])]
    units = spark.createDataFrame(rows, "doc_id STRING, unit_id STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, source_block_ids ARRAY<STRING>")
    assert {r["error"] for r in U.validation_errors(units).collect()} == {"duplicate_unit_id:u1", "missing_or_invalid_bbox:u2"}


REQUEST = "unit_id STRING, text STRING, width DOUBLE, height DOUBLE, font_size DOUBLE, min_font_size DOUBLE, line_height_ratio DOUBLE, language_hint STRING"


def fitted(spark, *requests):
    rows = [(str(i), t, float(w), float(h), float(s), 6.0, 1.2, hint) for i, (t, w, h, s, hint) in enumerate(requests)]
    return FIT.fit_units(spark.createDataFrame(rows, REQUEST)).orderBy("unit_id").collect()


LONG = "This is a long sentence that has to be wrapped over several lines to stay inside its box."


def test_fit_cases(spark):
    cjk = "日本語の文章を折り返すための例文です。"
    r = fitted(spark, ("Hello world", 240, 80, 14, None), (LONG, 150, 120, 12, None), (LONG[:60], 130, 36, 12, None), (LONG, 32, 10, 12, None), (cjk, 70, 120, 12, "ja"),
               ("supercalifragilisticexpialidocious", 60, 200, 12, None), ("", 10, 10, 12, None))
    assert (len(r[0]["lines"]), r[0]["overflow"], r[0]["scale_ratio"]) == (1, False, 1.0)
    assert len(r[1]["lines"]) > 1 and not r[1]["overflow"] and r[2]["fitted_size"] < 12
    assert r[3]["overflow"] and {"text_overflow", "bbox_too_small"} <= set(r[3]["warnings"])
    assert len(r[4]["lines"]) > 1 and "".join(r[4]["lines"]) == cjk
    assert len(r[5]["lines"]) > 1 and "".join(r[5]["lines"]) == "supercalifragilisticexpialidocious" and r[6]["lines"] == []


def test_fit_against_brute_force(spark):
    """Greedy wrapping at every size, stated independently on plain strings."""
    from test_text import reference_width

    texts = ["aa bb cc dd", "wide WORDS MMMM iiii", "x" * 40 + " yy", "a\n\nb c", "one two three four five six seven"]
    boxes = [(30, 20), (55, 40), (90, 15)]

    def wrap(text, cap):
        out = []
        for raw in text.split("\n"):
            words = re.sub(r"\s+", " ", raw.strip()).split(" ")
            line = ""
            for word in words:
                if line and sum(map(reference_width, line + " " + word)) <= cap:
                    line += " " + word
                    continue
                if line:
                    out.append(line)
                line = ""
                for ch in word:
                    if line and sum(map(reference_width, line + ch)) > cap:
                        out.append(line)
                        line = ""
                    line += ch
            out.append(line)
        return out

    requests = [(t, w, h, 10, None) for t in texts for w, h in boxes]
    for (text, w, h, size, _), row in zip(requests, sorted(fitted(spark, *requests), key=lambda r: int(r["unit_id"]))):
        best = None
        for step in range(9):
            s = size - step * 0.5
            lines = wrap(text, w * 100 / s)
            over = (max(0.0, len(lines) * s * 1.2 - h), max(0.0, max(sum(map(reference_width, x)) for x in lines) * s / 100 - w))
            if best is None or over < best[0]:
                best = (over, s, lines)
            if over == (0.0, 0.0):
                break
        assert (row["fitted_size"], row["lines"]) == (best[1], best[2]), (text, w, h)


def test_visual_verdicts(spark):
    page = list(range(16))
    rows = []
    for doc, after in (("same", [(4, page)]), ("pages", [(4, page), (4, page)]), ("width", [(5, page)])):
        rows.append((doc, "before", 0, 4, 4, page))
        rows += [(doc, "after", i, w, 4, s) for i, (w, s) in enumerate(after)]
    diffs = Q.document_diffs(spark.createDataFrame(rows, schemas.PAGE_SAMPLES))
    strict = {r["doc_id"]: (r["visual_status"], r["visual_failures"]) for r in Q.evaluate(diffs, fail_mean=2.0, fail_max=2.0, warning_mean=2.0, warning_max=2.0).collect()}
    assert strict == {"same": ("pass", []), "pages": ("fail", ["page_count_mismatch"]), "width": ("fail", ["page_dimension_mismatch"])}
    loose = Q.evaluate(diffs, fail_mean=2.0, fail_max=2.0, warning_mean=2.0, warning_max=2.0, allow_page_count_mismatch=True, allow_dimension_mismatch=True)
    assert {r["doc_id"]: r["visual_status"] for r in loose.collect()} == {"same": "pass", "pages": "warning", "width": "warning"}


def test_fit_without_width_keeps_lines(spark):
    schema = "unit_id INT, text STRING, width DOUBLE, height DOUBLE, font_size DOUBLE, min_font_size DOUBLE, line_height_ratio DOUBLE, language_hint STRING"
    rows = [(1, "hello world", 0.0, 50.0, 12.0, 6.0, 1.2, "en"), (2, "a b\n\nc", -3.0, 50.0, 12.0, 6.0, 1.2, "en"), (3, "", 0.0, 50.0, 12.0, 6.0, 1.2, "en"), (4, "hello", 200.0, 50.0, 12.0, 6.0, 1.2, "en")]
    got = {r["unit_id"]: r for r in FIT.fit_units(spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["lines"] == ["hello world"] and got[1]["overflow"] and got[2]["lines"] == ["a b", "c"] and got[3]["lines"] == [] and got[4]["lines"] == ["hello"]


def test_symbol_ratio_counts_signs_and_digits_of_what_is_visible(spark):
    from glossaline.operators.blocks import symbol_digit_ratio

    texts = ["a=1 ", "  ", "", None, "x\u00b2 \u2460\u216b", "\u00a0\u4e2d \t\u3000!", "two words", "\U0001d7d9\U00010400"]
    rows = spark.createDataFrame(list(enumerate(texts)), "n INT, text STRING").select("n", symbol_digit_ratio(F.col("text")).alias("r"))
    assert [r["r"] for r in rows.orderBy("n").collect()] == [2 / 3, 0.0, 0.0, 0.0, 0.5, 0.5, 0.0, 0.5]
    # A pattern over the whole text is written, and so run, once for the signs and once for the blanks.
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 2


def test_unit_facts_are_the_units_without_their_texts(chain):
    names = ["doc_id", "unit_id", "page_index", "source_block_ids", "x0", "y0", "x1", "y1", "reading_order", "unit_type", "flags", "is_skipped"]
    facts = sorted(map(str, chain.unit_facts.select(*names).collect()))
    assert facts == sorted(map(str, chain.units.select(*names).collect()))
    assert not {"text", "source_span_ids", "metadata"} & set(chain.unit_facts.columns)


def test_patterns_run_once_for_a_region(chain):
    from glossaline.operators.regions import detect_regions

    plan = detect_regions(chain.ordered, chain.pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("|;,") == 1


def test_texts_are_fitted_once_for_a_summary(spark):
    rows = [("d", "u1", "some words to wrap", 30.0, 10.0, 12.0, 6.0, 1.2, None), ("d", "u2", "x", 200.0, 50.0, 12.0, 6.0, 1.2, None)]
    names = "doc_id string, unit_id string, text string, width double, height double, font_size double, min_font_size double, line_height_ratio double, language_hint string"
    summary = FIT.fit_summary(FIT.fit_units(spark.createDataFrame(rows, names)), ["doc_id"])
    # What is counted twice is read as written, not fitted again.
    assert "ArrowEvalPython" not in summary._jdf.queryExecution().executedPlan().toString()
    assert [(r.result_count, r.overflow_count) for r in summary.collect()] == [(2, 1)]


def test_joins_give_the_tables_that_whole_pages_give(chain):
    crowded = PageLayout(chain.blocks, chain.pages, page_blocks=2)
    for name in ("flagged", "links", "captioned", "ordered", "members", "paragraphs", "regions", "protected", "unit_facts", "units", "related", "page_info"):
        one, other = getattr(chain, name), getattr(crowded, name)
        shared = [c for c in other.columns if c in one.columns]
        assert {"doc_id", "page_index"} <= set(shared) and sorted(map(str, one.select(*shared).collect())) == sorted(map(str, other.select(*shared).collect())), name


def test_blocks_of_a_page_are_shuffled_once(chain):
    lazy = PageLayout(chain.blocks, chain.pages, kept=False)
    for name in ("regions", "protected", "paragraphs", "unit_facts", "units"):
        plan = getattr(lazy, name)._jdf.queryExecution().sparkPlan().toString()
        assert "Join" not in plan, name
        prepared = getattr(lazy, name)._jdf.queryExecution().executedPlan().toString()
        assert prepared.count("Exchange ") + prepared.count("Exchange hash") <= 2 and prepared.count("hashpartitioning") == 1, name


def test_white_space_in_a_row(spark):
    from glossaline.operators.blocks import has_gap

    texts = {"a b": False, "a  b": True, "a \n": True, "\n a": True, "a\nb": False, "　 x": True, "x　y": False, "  ": True, "": False, "\x1c ": True, "a \x85": True}
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", has_gap(F.col("text")).alias("gap")).collect()
    assert {r["text"]: r["gap"] for r in rows} == texts

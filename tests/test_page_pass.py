"""Page queries judge and lay out ordinary documents in one pass, and cheap looks decide as the whole patterns do."""

import os
import random

import pytest
from pyspark.sql import functions as F

from glossaline.functions import text as T
from glossaline.operators import blocks as B
from glossaline.session import shared_dir
from glossaline.workloads import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["protected_flags", "unit_fonts", "translation_plan", "translation_plan_spans", "paragraph_summary"])
def test_judged_blocks_are_not_written(spark, name):
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = QUERIES[name](spark, FOLDER)
    assert out.limit(1).count() == 1
    assert not [made for made in set(os.listdir(folder)) - before if made.startswith("judged-blocks")]


def test_cheap_looks_agree_with_patterns(spark):
    rng = random.Random(5)
    signs = ["a", "Z", "ế", "図", " ", "\n", "\t", "\x1f", "\x85", " ", "　", "1", "٣", "²", "①", "𝟎", "=", "^", "∑", "(", ":", "|", ",", "é"]
    texts = ["", " ", "a", "1", *["".join(rng.choices(signs, k=rng.randint(1, 30))) for _ in range(3000)]]
    told = spark.createDataFrame([(t,) for t in texts], "text string")
    c = F.col("text")
    gap, digit = B.has_gap(c), c.rlike(B.DIGIT_FAST)
    seen = B.is_odd(c)
    wrong = told.filter(
        ((B.looks_like_formula(c) | digit) & ~seen) | (gap & ~(seen | T.contains_any(c, B.PLAIN_GAPS))) | (c.substr(1, B.HEAD_CHARS).rlike(B.PLAINLY_TEXT) & B.is_noisy_text(c))
        | (T.strip_mostly_clean(c) != T.strip(c)) | (T.is_blank(c) != (T.strip(c) == "")) | (T.is_short(c, 20) != (F.length(T.strip(c)) <= 20))
    )
    assert wrong.count() == 0


def test_joined_lines_are_judged_as_nested_ones(spark):
    lines = [["a 1", "b 2", "c"], [" ", "a 1", "b 2"], ["a", "b 2", "c"], ["x"], ["9  9"], ["a1", "b2"]]
    rows = [(i, "text", "\n".join(of), [(t,) for t in of], "\n".join(of)) for i, of in enumerate(lines)]
    nested = spark.createDataFrame(rows, "id int, kind string, text string, lines array<struct<text:string>>, joined_lines string").withColumn("text", T.strip(F.col("text")))
    told = [{r["id"]: r["_wide"] for r in B.judge_blocks(nested.drop(gone)).collect()} for gone in ("joined_lines", "lines")]
    assert told[0] == told[1] == {0: True, 1: True, 2: False, 3: False, 4: True, 5: False}

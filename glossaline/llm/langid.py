"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language would mean one probe per language and n-gram.  Here the filters are
bit-sliced: slot ``i`` of all filters is one machine word, bit ``l`` of it the slot of language
``l``.  The AND of an n-gram's slots is the set of all languages that contain it.  Per text, bits
are counted per language; a language that does not hold an n-gram still answers with probability
``fill ** 3``, so counts are corrected for that rate before the largest decides.

An n-gram belongs to a language if its rate there is at least ``keep_rate`` of its highest rate, so
wrong labels below that share do no harm.

Defined results: null texts and texts without a letter are ``und`` with score 0; a text of unknown
n-grams only gets the language with most training rows, score 0; ties go to the language first by
code point.  Texts are read whole, long ones in overlapping slices.  With no training row every text
is ``und``.  Repeated rows are repeated in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import scratch_name, small_batches

SLOT_BITS = 20  # 2**20 slots: 8 MB for up to 64 languages, whatever the size of the corpus
SIZES = (3, 4)  # letters of an n-gram, word edges counted
SLICE = 1 << 20  # characters of a long text worked on at once
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """True at each code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str, letters: np.ndarray) -> Iterator[np.ndarray]:
    """Mixed 64-bit hashes of a text's n-grams, slice by slice; a run of other characters is one word edge."""
    text = text.lower()
    for start in range(0, len(text), SLICE):
        # The overlap completes the n-grams that cross the border; a slice's own edges count only at the text's ends.
        points = np.frombuffer(text[max(0, start - 3) : start + SLICE].encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
        points[~letters[points]] = 0
        edge = np.zeros(1, np.uint64)
        points = np.concatenate([edge if start == 0 else edge[:0], points, edge if start + SLICE >= len(text) else edge[:0]])
        points = points[np.concatenate([[True], (points[1:] != 0) | (points[:-1] != 0)])]
        for size in SIZES:
            n = len(points) - size + 1
            if n <= 0:
                continue
            inside = np.ones(n, bool)
            for i in range(1, size - 1):
                inside &= points[i : i + n] != 0
            if start:  # not those that the slice before had whole
                inside[: max(0, 4 - size)] = False
            value = np.full(n, size, np.uint64)
            for i in range(size):
                value = value * np.uint64(0x9E3779B97F4A7C15) + points[i : i + n]
            value = value[inside]
            value ^= value >> np.uint64(29)
            value *= np.uint64(0xBF58476D1CE4E5B9)
            value ^= value >> np.uint64(32)
            yield value


def slots(value: np.ndarray) -> list[np.ndarray]:
    """The three slots of each hash, from separate bits."""
    low = np.uint64((1 << SLOT_BITS) - 1)
    return [((value >> np.uint64(i * SLOT_BITS)) & low).astype(np.int64) for i in range(3)]


@dataclass
class Filters:
    languages: list[str]
    masks: np.ndarray  # (words, slots) uint64
    wrong: np.ndarray  # chance that a language answers for an n-gram it does not hold
    common: int  # language with most training rows

    def counts(self, text: str, letters: np.ndarray) -> tuple[int, np.ndarray]:
        """Number of n-grams, and corrected count per language."""
        total, hits = 0, np.zeros(len(self.languages))
        for value in grams(text, letters):
            at = slots(value)
            total += len(value)
            for word, masks in enumerate(self.masks):
                found = masks[at[0]] & masks[at[1]] & masks[at[2]]
                for i in range(word * 64, min(len(self.languages), word * 64 + 64)):
                    hits[i] += np.count_nonzero(found & np.uint64(1 << (i % 64)))
        return total, (hits - total * self.wrong) / (1 - self.wrong)

    def decide(self, text: str | None, letters: np.ndarray) -> tuple[str, float, float]:
        """Language, its share of all languages' counts, and the share of the text's n-grams it holds."""
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        total, held = self.counts(text, letters)
        held = np.maximum(held, 0)
        if not held.any():
            return self.languages[self.common], 0.0, 0.0
        best = int(held.argmax())
        return self.languages[best], min(1.0, float(held[best] / held.sum())), min(1.0, float(held[best] / total))


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 2_000, keep_rate: float = 0.2) -> Filters:
    """Filters from labelled texts.

    ``per_language`` bounds the fit: about so many rows of each language, chosen by a hash of the
    text, are read whole, each distinct one once.  Counting runs on Spark; what comes to the driver is the filter itself,
    at most ``2**20`` slots for each 64 languages, and one row per language.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Filters([], np.zeros((1, 1 << SLOT_BITS), np.uint64), np.zeros(0), 0)
    share = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(min(1.0, per_language / sizes[name])))])
    number = F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i))])
    drawn = F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    # A text that stands on many rows is read once, so that the sample is bounded whatever repeats.
    sample = small_batches(rows).filter(drawn).select("text", number[F.col("lang")].alias("lang")).distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = letter_table()
        for batch in batches:
            for language, texts in batch.groupby("lang")["text"]:
                held: list[np.ndarray] = []
                for value in texts:
                    held += grams(value, letters)
                if held:
                    value, n = np.unique(np.concatenate(held), return_counts=True)
                    yield pd.DataFrame({"gram": value.view(np.int64), "lang": np.int32(language), "n": n})

    counted = sample.mapInPandas(count, "gram long, lang int, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "grams")
    totals = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    total = F.create_map(*[x for i in range(len(languages)) for x in (F.lit(i), F.lit(float(totals.get(i, 1))))])
    rated = counted.withColumn("rate", F.col("n") / total[F.col("lang")])
    highest = rated.groupBy("gram").agg(F.max("rate").alias("highest"))
    held = rated.join(highest, "gram").filter(F.col("rate") >= keep_rate * F.col("highest"))
    masks = held.groupBy("gram", F.floor(F.col("lang") / 64).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(lang % 64 as int))")).alias("mask")
    )
    slot = F.explode(F.array(*[F.shiftrightunsigned("gram", i * SLOT_BITS).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)) for i in range(3)]))
    found = masks.select("word", "mask", slot.alias("slot")).groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
    table = np.zeros(((len(languages) + 63) // 64, 1 << SLOT_BITS), np.uint64)
    table[found["word"].to_numpy(np.int64), found["slot"].to_numpy(np.int64)] = found["mask"].to_numpy(np.int64).view(np.uint64)
    fill = np.array([np.count_nonzero(table[i // 64] & np.uint64(1 << (i % 64))) / (1 << SLOT_BITS) for i in range(len(languages))])
    common = max(range(len(languages)), key=lambda i: (sizes[languages[i]], -i))
    return Filters(languages, table, np.minimum(fill**3, 0.999), common)


def predict(df: DataFrame, filters: Filters, text: str = "text", prefix: str = "lang_") -> DataFrame:
    """Add ``<prefix>pred``, ``<prefix>score`` and ``<prefix>coverage``; columns of those names are replaced."""
    # Plain values, so that executors need not have this package.
    shared = df.sparkSession.sparkContext.broadcast((filters.languages, filters.masks, filters.wrong, filters.common))

    @F.pandas_udf("pred string, score double, coverage double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, letters = Filters(*shared.value), letter_table()
        for batch in batches:
            yield pd.DataFrame([model.decide(value, letters) for value in batch], columns=["pred", "score", "coverage"])

    scratch = scratch_name(df, f"{prefix}found")
    out = small_batches(df).withColumn(scratch, run(F.col(text)))
    return out.withColumns({f"{prefix}{name}": F.col(scratch)[name] for name in ("pred", "score", "coverage")}).drop(scratch)

"""Which texts contain which terms, without comparing every text with every term and without sending any text.

Each text offers those of its own substrings that may be terms: a rolling hash tells, for every length that
terms have, which windows a table of the terms' hashes holds.  What a text offers meets the terms by an equi join
on the substring itself, so a wrong offer finds no term and no pair is ever missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

GRAM = 3
# A term table up to this many bytes may be sent to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024

# Slots of the table that tells which grams are looked for; of fixed size, whatever the number of terms.
SLOTS_LOG2 = 20


def _codes(text: str, size: int) -> np.ndarray:
    """The n-grams of one size as numbers: 21 bits a character."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = chars[: max(len(chars) - size + 1, 0)]
    for k in range(1, size):
        codes = (codes << 21) | chars[k : len(chars) - size + 1 + k]
    return codes


def _slots(codes: np.ndarray) -> np.ndarray:
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64)


def term_codes(term):
    """Codes of the n-grams a term may be anchored on: of full size, or the whole short term."""

    @pandas_udf("array<bigint>")
    def run(terms: pd.Series) -> pd.Series:
        return pd.Series([np.unique(_codes(t, min(len(t), GRAM))) for t in terms])

    return run(term)


def wanted_codes(text, wanted: DataFrame, column: str, sizes: list[int]):
    """Distinct codes of a text's n-grams that ``wanted`` may hold: a fixed table of hashed codes lets through what it holds and a few more.

    ``sizes``: of the n-grams in ``wanted``.
    """

    @pandas_udf("bigint")
    def slot(codes: pd.Series) -> pd.Series:
        return pd.Series(_slots(codes.to_numpy()))

    # At most as many numbers as there are slots.
    used = np.array([r[0] for r in wanted.select(slot(F.col(column))).distinct().collect()], np.int64)
    bits = np.zeros(1 << SLOTS_LOG2, bool)
    bits[used] = True
    packed = np.packbits(bits).tobytes()

    @pandas_udf("array<bigint>")
    def run(texts: pd.Series) -> pd.Series:
        table = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)

        def of(text: str) -> np.ndarray:
            codes = np.concatenate([np.zeros(0, np.int64), *[_codes(text, n) for n in sizes]])
            return np.unique(codes[table[_slots(codes)]])

        return pd.Series([of(t) for t in texts])

    return run(text)


BASE = 0x9E3779B97F4A7C15  # of the rolling hash, odd: it has an inverse modulo 2**64
UNBASE = pow(BASE, -1, 1 << 64)
PROBES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)  # a hash is held if the table holds all its slots
LONG = 32  # longer windows are looked at only where one of this length opens a longer term
BLOCK = 1 << 20  # windows of a text hashed at a time
OFFERED_ROWS = 100_000  # offers of a batch handed on


class Windows:
    """Rolling hashes of the windows of a text: the sum of characters times powers of the base, moved to the window's start."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, np.uint64)

    def read(self, text: str) -> None:
        self.chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = len(self.chars)
        if n > len(self.powers):
            self.powers, self.inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, x, np.uint64)])) for x in (BASE, UNBASE))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.chars + np.uint64(1)) * self.powers[:n])])

    def hashes(self, size: int, at: np.ndarray | None = None) -> np.ndarray:
        """Of the windows of a size: of all, or of those that start at given places."""
        if at is not None:
            return (self.sums[at + size] - self.sums[at]) * self.inverses[at]
        n = max(len(self.chars) - size + 1, 0)
        return (self.sums[size : size + n] - self.sums[:n]) * self.inverses[:n]


def _probe(hashes: np.ndarray, size: int, probe: int, log2: int) -> np.ndarray:
    return ((hashes + np.uint64(size)) * np.uint64(probe) >> np.uint64(64 - log2)).astype(np.int64)


def _held(hashes: np.ndarray, size: int, table: np.ndarray, log2: int) -> np.ndarray:
    """Places of the hashes that the table holds."""
    found = np.flatnonzero(table[_probe(hashes, size, PROBES[0], log2)])
    for probe in PROBES[1:]:
        found = found[table[_probe(hashes[found], size, probe, log2)]]
    return found


def _table_of(terms: DataFrame, term: str, log2: int) -> bytes:
    """The slots of all terms as packed bits; every task packs its own, and the driver gets few tables of bounded size."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table, windows = np.zeros(1 << log2, bool), Windows()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                windows.read(value)
                # A long term is found by its beginning first, which counts as a window of no size.
                for size, cut in ((len(value), len(value)), *([(0, LONG)] if len(value) > LONG else [])):
                    own = windows.hashes(cut, np.zeros(1, np.int64))
                    for probe in PROBES:
                        table[_probe(own, size, probe, log2)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(table).tobytes()], pa.binary())], ["bits"])

    packed = np.zeros((1 << log2) // 8, np.uint8)
    for row in terms.select(term).coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        packed |= np.frombuffer(row.bits, np.uint8)
    return packed.tobytes()


def offers(texts: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """The rows of ``texts`` without the text, one for each of its distinct substrings that may be a term, as ``term``.

    Every term that a text contains is among them; few others are.  ``terms`` holds no empty term.
    """
    lengths = {r[0]: r[1] for r in terms.groupBy(F.length(term)).count().collect()}  # at most as many as the longest term has characters
    sizes = sorted(lengths)
    log2 = min(max(256 * sum(lengths.values()), 1 << 16).bit_length(), 25)
    packed = _table_of(terms, term, log2)
    longest = max(sizes, default=1)

    def found(value: str, windows: Windows, table: np.ndarray) -> set[str]:
        out: set[str] = set()
        for start in range(0, len(value), BLOCK):
            piece = value[start : start + BLOCK + longest - 1]
            windows.read(piece)
            opening = _held(windows.hashes(LONG), 0, table, log2) if longest > LONG else None
            for size in sizes:
                if size > LONG:
                    at = opening[opening + size <= len(piece)]
                    at = at[_held(windows.hashes(size, at), size, table, log2)]
                else:
                    at = _held(windows.hashes(size), size, table, log2)
                if size <= GRAM and len(at):
                    # Short windows recur all the time: 21 bits a character tell them apart.
                    code = windows.chars[at]
                    for k in range(1, size):
                        code = (code << np.uint64(21)) | windows.chars[at + k]
                    at = at[np.unique(code, return_index=True)[1]]
                out.update([piece[i : i + size] for i in at.tolist()])
        return out

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table, windows = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool), Windows()
        for batch in batches:
            kept = [c for c in batch.schema.names if c != text]
            rows: list[int] = []
            offered: list[str] = []

            def handed() -> pa.RecordBatch:
                at = pa.array(rows, pa.int32())
                return pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in kept], pa.array(offered, pa.string())], [*kept, term])

            for n, value in enumerate(batch.column(text)):  # one text at a time
                own = found(value.as_py(), windows, table)
                rows += [n] * len(own)
                offered += own
                if len(offered) >= OFFERED_ROWS:
                    yield handed()
                    rows, offered = [], []
            if offered:
                yield handed()

    schema = T.StructType([*[f for f in texts.schema.fields if f.name != text], T.StructField(term, T.StringType())])
    return texts.mapInArrow(run, schema)

"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Token ids are packed as little-endian unsigned 32-bit integers in one binary value, the form a
training reader maps into memory.  Null texts encode as empty, empty texts as no ids; repeated rows
give repeated results; an empty table gives an empty one.  A result column that the input has
already is replaced, other columns pass through.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import small_batches

BLOCK_CHARS = 50_000  # texts beyond this are encoded in blocks


def read_ranks(rank_file: str) -> dict[bytes, int]:
    """Rank of each token's bytes, from lines of base64 and number."""
    with open(rank_file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Encoder:
    """One text to ids, equal to one call of the library on the whole text, in bounded time."""

    def __init__(self, rank_file: str, pattern: str) -> None:
        import regex
        import tiktoken

        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(rank_file), special_tokens={})
        # White space as Unicode defines it, which is what the library's engine means by it.
        self.match = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        # No match goes on from a letter or digit into a space or line end.
        self.boundary = regex.compile(r"(?<=[\p{L}\p{N}])(?=[ \n])")

    def blocks(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > BLOCK_CHARS:
            cut = self.boundary.search(text, start + BLOCK_CHARS, start + 2 * BLOCK_CHARS)
            if cut is None:  # cut at the end of some match; after a non-space it is safe
                stop = start
                for found in self.match.finditer(text, start):
                    stop = found.end()
                    if stop - start >= BLOCK_CHARS and not found.group()[-1].isspace():
                        break
                yield text[start:stop]
                start = stop
            else:
                yield text[start : cut.start()]
                start = cut.start()
        yield text[start:]

    def ids(self, text: str | None) -> np.ndarray:
        out: list[int] = []
        for block in self.blocks(text or ""):
            out += self.library.encode_ordinary(block)
        return np.array(out, dtype="<u4")


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the packed token ids of a text column.

    ``rank_file`` is a path that every executor has, like the library itself.
    """

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(rank_file, pattern)
        for batch in batches:
            yield pd.Series([encoder.ids(value).tobytes() for value in batch], dtype=object)

    return small_batches(df).withColumn(ids, run(F.col(text)))


def decode(df: DataFrame, rank_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the raw bytes of packed token ids; null ids decode as empty."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = {rank: value for value, rank in read_ranks(rank_file).items()}
        for batch in batches:
            yield pd.Series([b"".join(map(token.__getitem__, np.frombuffer(value or b"", "<u4").tolist())) for value in batch], dtype=object)

    return small_batches(df).withColumn(out, run(F.col(ids)))


def count(ids: str = "ids"):
    """Number of tokens of packed ids."""
    return (F.octet_length(F.col(ids)) / 4).cast("bigint")

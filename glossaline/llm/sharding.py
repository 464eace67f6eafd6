"""Sharding: a uniform random shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows lie in partitions of known size.  How many rows each partition sends to each shard is drawn first:
the matrix of a uniform permutation, whose rows sum to the partitions' sizes and whose columns sum to the
shards' sizes.  Each partition then permutes its rows and deals them out by its counts, rows change
place once, and each shard permutes what it received.  All arrangements are equally likely, and shard sizes
are exact: they differ by at most one.

The matrix is never in one place.  A tree halves the range of partitions again and again; at each node
the shards' open places are split between both halves by a multivariate hypergeometric draw whose seed is
the node's own, so every partition walks its path from the root and draws the same numbers as the others.
A walk needs the partitions' sizes in front of it: one number per partition.  Both permutations are
orders by a hash of the row's number under a seed, so lost tasks repeat them; the second one is a range
sort over (shard, hash), so a shard larger than a task's memory is no hindrance.

Defined results: rows stay as they are, repeated and null ones too, each in one place of its own; equal
rows are dealt apart like any others; shards beyond the number of rows stay empty; an empty table gives
an empty result.  A caller's columns named like the result's are replaced.  The same rows in the same
partitions get the same places; rows in other partitions another shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans import ordered
from ..session import materialize

PART, RANK, KEY, ENDS, ORDER = "_part", "_rank", "_row", "_ends", "_order"
SPREAD = 14  # standard deviations looked at; what lies beyond is below the last bit of a uniform number


def hypergeometric(r: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good ones among ``drawn`` of ``good + bad``, by inversion from the mode; for counts of any size.

    The probabilities' ratios are exact to rounding, and the window around the mode grows with the
    square root of the counts.
    """
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    total = good + bad
    deviation = math.sqrt(drawn * (good / total) * (bad / total) * ((total - drawn) / max(total - 1, 1)))
    mode = (drawn + 1) * (good + 1) // (total + 2)
    reach = int(SPREAD * deviation) + 40
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.float64)
    steps = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    chances = np.cumsum(np.exp(logs - logs.max()))
    return first + int(np.searchsorted(chances, r.random() * chances[-1], side="right"))


def split(r: np.random.Generator, places: list[int], drawn: int) -> list[int]:
    """How many of ``drawn`` uniformly drawn places lie in each shard."""
    rest, out = sum(places), []
    for open_ in places:
        got = hypergeometric(r, open_, rest - open_, drawn)
        out.append(got)
        rest -= open_
        drawn -= got
    return out


def counts(before: list[int], part: int, shards: int, seed: int) -> list[int]:
    """A partition's row of the matrix; ``before[p]`` rows lie in partitions before p, the last entry is all."""
    total = before[-1]
    places = [total // shards + (1 if s < total % shards else 0) for s in range(shards)]
    low, high = 0, len(before) - 1
    while high - low > 1:
        middle = (low + high) // 2
        left = split(np.random.default_rng([seed, low, high]), places, before[middle] - before[low])
        if part < middle:
            places, high = left, middle
        else:
            places, low = [a - b for a, b in zip(places, left)], middle
    return places


def matrix(sizes: DataFrame, shards: int, seed: int) -> DataFrame:
    """Where each shard's rows end among a partition's permuted rows.

    ``sizes`` holds (part, n) for every partition with rows; it has a row per partition, so its numbers
    are sent to the tasks that draw.
    """
    known = sorted((r[0], r[1]) for r in sizes.collect())
    parts = [p for p, _ in known]
    before = [0, *np.cumsum([n for _, n in known]).tolist()]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = {p: i for i, p in enumerate(parts)}
        for batch in batches:
            ends = [np.cumsum(counts(before, at[p], shards, seed)).tolist() for p in batch[PART]]
            yield pd.DataFrame({PART: batch[PART], ENDS: ends})

    return sizes.select(PART).mapInPandas(draw, f"{PART} bigint, {ENDS} array<bigint>")


def order_key(seed: int, turn: int, row: Column) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(turn), row)


def shuffle(df: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """The rows with ``shard`` (from 0) and ``slot`` (their place in it, gapless from 0)."""
    held = materialize(df.drop("shard", "slot").withColumn(KEY, F.monotonically_increasing_id()), "shard-rows")
    # The upper bits of the generated number are the partition that held the row.
    rows = held.withColumn(PART, F.shiftright(KEY, 33))
    ends = materialize(matrix(rows.groupBy(PART).agg(F.count("*").alias("n")), shards, seed), "shard-matrix")
    rank = F.row_number().over(Window.partitionBy(PART).orderBy(order_key(seed, 1, F.col(KEY)), KEY)) - 1
    dealt = rows.withColumn(RANK, rank).join(ends, PART)
    shard = F.size(F.filter(ENDS, lambda e: e <= F.col(RANK)))
    sent = dealt.withColumn("shard", shard).drop(ENDS, RANK, PART).withColumn(ORDER, order_key(seed, 2, F.col(KEY)))
    placed = ordered.number_rows(sent, ["shard"], [F.col(ORDER), F.col(KEY)], "slot")
    return placed.withColumn("slot", F.col("slot") - 1).drop(ORDER, KEY)

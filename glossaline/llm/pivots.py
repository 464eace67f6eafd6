"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its nearest reference points, in order.  An inverted list per pivot
holds the vectors that name it; vectors that share at least ``shared`` pivots are candidates, and
their cosine in double precision decides.  A pair that meets in several lists counts in the list of
its smallest common pivot only, so links can be counted without gathering pairs.

Lists are cut into blocks of bounded size and pairs of blocks are compared as matrices; what leaves a
task is a row per linked vector: its number of links there and one member of its group, enough to
join the groups.  No pair of a group is ever written out.  Equal vectors are one vector with a count
from the start.  Comparisons within a list grow with the square of its length; the number of pivots
grows with the square root of the number of vectors, up to ``max_pivots``.  Where few vectors stand
apart enough to be pivots (all in one cone), all pairs of the table are compared, in blocks.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another
length than most link with nothing, and are their own component.  An empty table gives an empty
result.  Rows that repeat an id repeat its result and count as copies; a null id has no component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import components
from .vectors import stack, valid

BLOCK = 1024  # vectors of a block of a list


def apart(x: np.ndarray, size: int) -> np.ndarray:
    """Up to ``size`` rows as unit vectors, each with a cosine below 0.7 to those before it.

    Pivots in the same tight group would be named in random order by the vectors near them.
    """
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x
    kept: list[int] = []
    for i in range(len(x)):
        if len(kept) < size and (not kept or (x[kept] @ x[i]).max() < 0.7):
            kept.append(i)
    return x[kept]


def compare(rows: pd.DataFrame, pivot: int, same: bool, threshold: float, shared: int) -> pd.DataFrame:
    """Links inside one block, or between two: each linked vector's count of links and its group's first member."""
    x = stack(rows["embedding"])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    names, at = np.unique(np.vstack(rows["pivots"].to_list()), return_inverse=True)
    hot = np.zeros((len(rows), len(names)), np.float32)
    np.put_along_axis(hot, at.reshape(len(rows), -1), 1, axis=1)
    side = rows["block"].to_numpy()
    a = np.arange(len(rows)) if same else np.flatnonzero(side == side.min())
    b = a if same else np.flatnonzero(side != side.min())
    met = hot[a] @ hot[b].T >= shared
    earlier = hot[:, names < pivot]
    met &= earlier[a] @ earlier[b].T == 0
    met &= x[a] @ x[b].T >= threshold
    if same:
        np.fill_diagonal(met, False)
    if not met.any():
        return pd.DataFrame({"vec_id": [], "n": [], "root": []}).astype("int64")
    copies = rows["copies"].to_numpy()
    links = np.zeros(len(rows), np.int64)
    links[a] += met @ copies[b]
    if not same:
        links[b] += met.T @ copies[a]
    # Smallest reachable row, by passing the minimum along links until nothing changes.
    label = np.arange(len(rows))
    while True:
        least = np.minimum(label[a], np.where(met, label[b][None, :], len(rows)).min(axis=1, initial=len(rows)))
        back = np.minimum(label[b], np.where(met, least[:, None], len(rows)).min(axis=0, initial=len(rows)))
        new = label.copy()
        new[a] = least
        new[b] = np.minimum(new[b], back)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = np.flatnonzero(links)
    ids = rows["vec_id"].to_numpy()
    return pd.DataFrame({"vec_id": ids[linked], "n": links[linked], "root": ids[label[linked]]})


def near_duplicates(
    df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.9, prefix: int = 12, shared: int = 2, max_pivots: int = 16_384,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    The pivots are vectors of the table, taken by smallest hash and kept apart from each other:
    ``2 * sqrt(n)`` of them, at most ``max_pivots``; they are all that the driver holds besides one count per pivot.
    """
    good = valid(df, vec_id, embedding)
    reps = materialize(good.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "vectors")
    n = reps.count()
    size = min(max_pivots, max(1, 2 * math.isqrt(n)))
    chosen = apart(stack(reps.orderBy(F.xxhash64("embedding", F.lit(5)), "vec_id").select("embedding").limit(2 * size).toPandas()["embedding"]), size)
    # Two vectors that each name ``prefix`` of so few pivots share ``shared`` at least, or name all there are: every
    # pair is a candidate, and one list compares it once.  It is so for a family of near copies or vectors in one cone.
    if len(chosen) <= 2 * prefix - shared:
        chosen = chosen[:1]
    shared = min(shared, len(chosen))
    points = df.sparkSession.sparkContext.broadcast(chosen)

    @F.pandas_udf("array<int>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = stack(batch)
            # Of equal distances the smaller number, by the stable sort.
            order = np.argsort(-np.round(x / np.linalg.norm(x, axis=1, keepdims=True) @ points.value.T, 12), axis=1, kind="stable")
            yield pd.Series(list(order[:, :prefix].astype(np.int32)))

    described = materialize(reps.withColumn("pivots", nearest("embedding")), "permutations")
    posted = described.withColumn("pivot", F.explode("pivots"))
    # One row per pivot, at most max_pivots: safe to broadcast.
    lengths = F.broadcast(described.select(F.explode("pivots").alias("pivot")).groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    blocked = posted.join(lengths, "pivot").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    paired = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "pivot", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "vec_id", "copies", "embedding", "pivots"
    )

    def task(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", ignore_index=True)
        return compare(rows, int(key[0]), key[1] == key[2], threshold, shared)

    found = materialize(paired.groupBy("pivot", "i", "j").applyInPandas(task, "vec_id long, n long, root long"), "pivot-links")
    links = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    told = described.select("vec_id", "embedding", "copies").join(links, "vec_id", "left").join(
        joined.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left"
    ).select("embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "vec_id").alias("component"))
    rows = df.select(F.col(vec_id).alias("vec_id"), F.when(F.col(vec_id).isNotNull(), F.col(embedding).cast("array<double>")).alias("embedding"))
    return rows.join(told, "embedding", "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )

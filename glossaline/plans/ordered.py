"""Ordered analytics that do not need a whole group in one task.

``row_number``, ``lag`` and running sums over ``partitionBy(key).orderBy(...)`` send every key to
one task.  When one key may hold a third of all rows that task never ends.  Here rows are
range-partitioned by (key, order), so a hot key spreads over many chunks of about equal size, and
each chunk is scanned on its own.  What a chunk needs from the ones before it (how many rows of
its first key came earlier, their sum, the last row) is one small record per chunk: that carry
table has at most as many rows as there are chunks, whatever the data size, so broadcasting it
is safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .scan import ones, scan

CHUNK = "_chunk"
POS = "_pos"


def freeze_order(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Sort by keys and order (which must be unique within a key) into written chunks."""
    sort_by = [F.col(k).asc() for k in keys] + list(order)
    tagged = (
        df.repartitionByRange(*sort_by)
        .sortWithinPartitions(*sort_by)
        .withColumn(POS, F.monotonically_increasing_id())
    )
    # Written once: chunk borders must not move between the passes that read them.
    frozen = materialize(tagged, "ordered")
    # The upper bits of the generated id are the partition, that is, the range chunk.
    return frozen.withColumn(CHUNK, F.shiftright(POS, 33))


def unfreeze(df: DataFrame) -> DataFrame:
    return df.drop(CHUNK, POS)


def _chunk_window(keys: list[str]):
    return Window.partitionBy(CHUNK, *keys).orderBy(POS)


def _join_carry(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    # A missing key is a key of its own, so nulls must meet nulls.
    columns = [CHUNK, *keys]
    named = carry.select(*[F.col(c).alias(f"_k_{c}") for c in columns], *[c for c in carry.columns if c not in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return df.join(F.broadcast(named), same, "left").drop(*[f"_k_{c}" for c in columns])


def with_running(frozen: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Running sums (current row included) within each key, in the frozen order."""
    out = frozen
    for name, value in sums.items():
        out = out.withColumn(f"_v_{name}", value)
    aggregates = [F.sum(f"_v_{name}").alias(f"_s_{name}") for name in sums]
    per_chunk = out.groupBy(CHUNK, *keys).agg(*aggregates)
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk
    for name in sums:
        carried = carried.withColumn(f"_c_{name}", F.sum(f"_s_{name}").over(earlier))
    # Only the first key of a chunk can have rows in earlier chunks: at most one row per chunk.
    has_carry = F.lit(False)
    for name in sums:
        has_carry = has_carry | F.col(f"_c_{name}").isNotNull()
    carried = carried.filter(has_carry).select(CHUNK, *keys, *[f"_c_{name}" for name in sums])
    window = _chunk_window(keys).rowsBetween(Window.unboundedPreceding, 0)
    local = out
    for name in sums:
        local = local.withColumn(f"_l_{name}", F.sum(f"_v_{name}").over(window))
    joined = _join_carry(local, carried, keys)
    for name in sums:
        joined = joined.withColumn(name, F.col(f"_l_{name}") + F.coalesce(F.col(f"_c_{name}"), F.lit(0)))
    scratch = [f"{p}{name}" for name in sums for p in ("_v_", "_c_", "_l_")]
    return joined.drop(*scratch)


def with_row_number(frozen: DataFrame, keys: list[str], name: str = "row_number") -> DataFrame:
    return with_running(frozen, keys, {name: F.lit(1).cast("bigint")})


def with_previous(frozen: DataFrame, keys: list[str], previous: dict[str, str]) -> DataFrame:
    """Value of the preceding row of the same key: ``{new column: source column}``."""
    sources = list(dict.fromkeys(previous.values()))
    tail = frozen.groupBy(CHUNK).agg(
        F.max_by(F.struct(*keys, *[c for c in sources if c not in keys]), POS).alias("_tail")
    )
    # One row per non-empty chunk; the window without a key runs over chunk records only.
    after = Window.orderBy(CHUNK)
    carried = tail.select(
        F.lead(CHUNK).over(after).alias(CHUNK),
        F.col("_tail").alias("_before"),
    ).filter(F.col(CHUNK).isNotNull())
    # Partitioned by the chunk alone: the first row of a chunk is the only one without a local
    # predecessor, and a following running sum reuses this exchange.
    window = Window.partitionBy(CHUNK).orderBy(POS)
    local = frozen.withColumn("_rn", F.row_number().over(window)).withColumn(
        "_local", F.lag(F.struct(*keys, *[c for c in sources if c not in keys])).over(window)
    )
    joined = local.join(F.broadcast(carried), [CHUNK], "left")
    before = F.when(F.col("_rn") == 1, F.col("_before")).otherwise(F.col("_local"))
    joined = joined.withColumn("_prev", before)
    same_key = F.col("_prev").isNotNull()
    for key in keys:
        same_key = same_key & F.col(f"_prev.{key}").eqNullSafe(F.col(key))
    for target, source in previous.items():
        joined = joined.withColumn(target, F.when(same_key, F.col(f"_prev.{source}")))
    return joined.drop("_rn", "_before", "_local", "_prev")


def number_rows(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "row_number") -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without a task per key."""
    return scan(df, keys, order, [name], ones(name))

"""Running sums within keys by one sort: a segmented prefix scan.

Rows are range-partitioned by (key, order), so a key may span any number of chunks.  The task that sorts
a chunk also scans it: it adds running sums that begin anew at every key, batch by batch, and marks the
rows of the chunk's first key, whose sums may lack what stood in earlier chunks.  What they lack is one
small record per chunk, worked out from the chunks' first and last rows and broadcast.  So a number costs
one shuffle, one sort and one write; nothing is shuffled or sorted again.

What is summed may look at the row before: ``derive`` gets the rows and the rows before them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import materialize

CHUNK, POS, HEAD = "_chunk", "_pos", "_head"

#: (rows, rows before, whether those are of the same key) -> values to sum, one array per name.
Derive = Callable[[pd.DataFrame, pd.DataFrame, np.ndarray], dict[str, np.ndarray]]


def ones(name: str) -> Derive:
    """Counts rows: the running sum is the row's number within its key."""
    return lambda rows, before, same: {name: np.ones(len(rows), np.int64)}


def _changed(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; nulls are equal to each other."""
    if pa.types.is_nested(column.type):
        values = column.to_pylist()
        return np.array([a != b for a, b in zip(values[1:], values)], bool)
    one, two = column[1:], column[:-1]
    differs = pc.fill_null(pc.not_equal(one, two), True)
    alike = pc.and_(pc.is_null(one, nan_is_null=True), pc.is_null(two, nan_is_null=True))
    return np.asarray(pc.and_(differs, pc.invert(alike)))


def running(batches: Iterator[pa.RecordBatch], keys: list[str], used: list[str], names: list[str], derive: Derive) -> Iterator[pa.RecordBatch]:
    """Sorted batches of one chunk with their running sums and the mark of the first key's rows."""
    last: pa.RecordBatch | None = None  # last row of the batch before
    totals = dict.fromkeys(names, 0)
    head = True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        seen = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
        first = 0 if last is None else 1
        starts = np.zeros(n, bool)
        for key in keys:
            column = seen.column(key).combine_chunks() if seen.column(key).num_chunks != 1 else seen.column(key).chunk(0)
            starts[1 - first :] |= _changed(column)
        rows = seen.select(used).to_pandas()
        here = rows.iloc[first:].reset_index(drop=True)
        before = rows.shift(1).iloc[first:].reset_index(drop=True) if used else pd.DataFrame(index=range(n))
        same = ~starts
        if last is None:
            same[0] = False  # the row before, if any, is in another chunk
        values = derive(here, before, same)
        # A batch's runs of one key: sums begin anew where a run starts.
        run = np.cumsum(starts)
        heads = head & (run == 0)
        arrays = list(batch.columns)
        for name in names:
            value = np.asarray(values[name])
            total = np.cumsum(value)
            base = np.where(run > 0, (total - value)[np.maximum.accumulate(np.where(starts, np.arange(n), 0))], -totals[name])
            summed = total - base
            totals[name] = summed[-1]
            arrays.append(pa.array(summed))
        head = bool(heads[-1])
        arrays.append(pa.array(heads))
        last = batch.slice(n - 1)
        yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *names, HEAD])


def carries(ends: pd.DataFrame, keys: list[str], used: list[str], names: list[str], derive: Derive) -> pd.DataFrame:
    """What the first key's rows of each chunk lack; ``ends`` holds every chunk's first and last row, in order."""
    out = []
    tail: dict | None = None
    for _, record in ends.iterrows():
        first, end = record["first"], record["end"]
        add = dict.fromkeys(names, 0)
        if tail is not None and all(_alike(first[k], tail[k]) for k in keys):
            rows, before = pd.DataFrame([{c: first[c] for c in used}]), pd.DataFrame([{c: tail[c] for c in used}])
            alone = derive(rows, before.shift(1), np.array([False]))
            joined = derive(rows, before, np.array([True]))
            add = {name: tail[f"_sum_{name}"] + joined[name][0] - alone[name][0] for name in names}
        out.append({CHUNK: record[CHUNK], **{f"_add_{name}": add[name] for name in names}})
        tail = {**{c: end[c] for c in {*keys, *used}}, **{f"_sum_{name}": end[name] + (add[name] if end[HEAD] else 0) for name in names}}
    return pd.DataFrame(out, columns=[CHUNK, *[f"_add_{name}" for name in names]])


def _alike(a, b) -> bool:
    return a == b or (a is None and b is None) or (a != a and b != b)


def scan(df: DataFrame, keys: list[str], order: list[Column | str], names: list[str], derive: Derive, used: list[str] | None = None) -> DataFrame:
    """The rows with running sums (the row's own value included) of whole numbers within each key.

    ``order`` must be unique within a key.  ``used`` are the columns that ``derive`` looks at.  A missing
    key is a key of its own.  Without keys all rows are one run.
    """
    used = used or []
    sort_by = [F.col(k).asc() for k in keys] + list(order)
    placed = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by).withColumn(POS, F.monotonically_increasing_id())
    schema = T.StructType(list(df.schema.fields)).add(POS, "long")
    for name in names:
        schema = schema.add(name, "long")
    schema = schema.add(HEAD, "boolean")
    scanned = placed.mapInArrow(lambda batches: running(batches, keys, used, names, derive), schema)
    # Written once: chunk borders must not move between the passes that read them.
    held = materialize(scanned, "scanned").withColumn(CHUNK, F.shiftright(POS, 33))
    kept = list(dict.fromkeys([*keys, *used]))
    ends = held.groupBy(CHUNK).agg(
        F.min_by(F.struct(*kept, F.lit(0).alias("_none")), POS).alias("first"), F.max_by(F.struct(*kept, *names, HEAD), POS).alias("end")
    )

    def worked_out(records: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [r for r in records]
        if every:
            yield carries(pd.concat(every).sort_values(CHUNK), keys, used, names, derive)

    # One row per chunk, in one small task.
    lacks = ends.coalesce(1).mapInPandas(worked_out, ", ".join([f"{CHUNK} bigint", *[f"_add_{name} bigint" for name in names]]))
    met = held.join(F.broadcast(lacks), CHUNK, "left")
    whole = {name: F.when(F.col(HEAD), F.col(name) + F.coalesce(F.col(f"_add_{name}"), F.lit(0))).otherwise(F.col(name)) for name in names}
    return met.withColumns(whole).select(*df.columns, *names)

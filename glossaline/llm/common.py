"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize


def small_batches(df: DataFrame, rows: int = 512) -> DataFrame:
    """Let Spark hand texts to Python in batches of few rows: the default of 10,000 long texts fills a worker's memory."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def scratch_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not use."""
    while name in df.columns:
        name += "_"
    return name


def fold(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number; null for a null id."""
    return F.crc32(F.col(id_column).cast("string")) % F.lit(modulus)


def in_fold(id_column: str, modulus: int, remainder: int) -> Column:
    """True for ids of that fold, false for others and for null ids."""
    return F.coalesce(fold(id_column, modulus) == F.lit(remainder), F.lit(False))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list, as (node, component): the smallest node reachable.

    Every round each node hooks to the neighbour whose hash of (node, round) is smallest, if that
    is below its own, and edges are carried over to the hooks.  Hash order makes long chains shrink
    by a constant factor a round, a star in one.  Each round is written to the shared folder, so the
    loop neither grows the lineage nor loses work with an executor.  Nodes without an edge to
    another node are not in the result.
    """
    current = materialize(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a") != F.col("b")).distinct(), "edges"
    )
    label: DataFrame | None = None
    turn = 0
    while not current.isEmpty():
        def key(node, turn=turn):
            return F.struct(F.xxhash64(F.col(node), F.lit(turn)).alias("h"), F.col(node).alias("id"))

        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(current.select("b", "a"))
        hooks = materialize(
            both.groupBy("u").agg(F.min(key("v")).alias("m")).select("u", F.least(F.col("m"), key("u"))["id"].alias("p")),
            "hooks",
        )
        one, two = hooks.select(F.col("u").alias("a"), F.col("p").alias("pa")), hooks.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        current = materialize(
            current.join(one, "a").join(two, "b").filter("pa != pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            "edges",
        )
        if label is None:
            label = hooks
        else:
            step = hooks.select(F.col("u").alias("p"), F.col("p").alias("q"))
            label = label.join(step, "p", "left").select("u", F.coalesce("q", "p").alias("p"))
        turn += 1
    if label is None:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = materialize(label, "labels")
    smallest = label.groupBy("p").agg(F.least(F.min("u"), F.col("p")).alias("component"))
    return label.join(smallest, "p").select(F.col("u").alias("node"), "component")


def slices(text: str, size: int = 1 << 20):
    """A long text in pieces cut before white space, so that words stay whole and memory bounded."""
    import re

    start = 0
    while len(text) - start > size:
        cut = re.compile(r"\s").search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]

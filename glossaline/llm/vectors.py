"""Helpers for tables of embedding vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def valid(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding double[]) of the vectors that can be compared.

    Left out: null ids, null or zero vectors, vectors with null or non-finite components, and vectors
    of another length than most.
    """
    v = df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).filter("vec_id is not null")
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = v.filter(~F.coalesce(broken, F.lit(True)) & F.exists("embedding", lambda x: x != 0))
    usual = good.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), "n").first()
    return good.filter(F.size("embedding") == (usual["n"] if usual else 0))


def stack(column: pd.Series) -> np.ndarray:
    """A column of vectors as one matrix."""
    return np.vstack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))

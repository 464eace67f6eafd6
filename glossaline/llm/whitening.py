"""Embedding whitening: leading principal directions by spectrum slicing, scaled to unit variance.

Entries become whole numbers (``floor(64 c) + 1000000``), so equal vectors are told exactly and sums
are exact.  The directions are fitted on each distinct whole-number vector once.  Spark finds the distinct
vectors, their sums and the covariance (each task sums its centred products in double precision and
gives back rows of a matrix of the vectors' dimension); what reaches the driver is a matrix whose size
the dimension bounds, not the data.

Eigenvalues are found one by one.  The factors LDL' of the shifted covariance have as many negative
pivots as there are eigenvalues below the shift (Sylvester), so halving an interval by such counts
isolates the k-th largest one; a few steps of Rayleigh quotient iteration then converge cubically.  A
pair is accepted only if the counts just below and just above its value number it k; else slicing
goes on.  Eigenvalues closer to each other than double precision tells apart are taken as a cluster:
their vectors are found one after the other, each orthogonal to those before it.

Defined results: rows whose vector is null or holds null or non-finite entries are left out, and so are
vectors of another length than most, empty ones, and entries beyond 2**46 (their whole number times
the row count would not be exact).  Zero vectors and rows with a null or repeated id stay.  Components
without variance (beyond the rank of the fitted vectors) have no scale and give no rows: a table of
one distinct vector gives none.  ``deviation`` is null where it exceeds a long.  Columns other than the
two named ones are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ..session import materialize

SCALE, OFFSET = 64, 1_000_000
LIMIT = float(1 << 46)
ROUND = 64 * np.finfo(float).eps  # eigenvalues closer than this share of the largest one are not told apart


def whole(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the vectors that take part."""
    v = df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LIMIT))
    good = v.filter(~F.coalesce(odd, F.lit(True)) & (F.size("v") > 0))
    usual = good.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), "n").first()
    same = good.filter(F.size("v") == (usual["n"] if usual else 0))
    return same.select("vec_id", F.transform("v", lambda c: F.floor(c * float(SCALE)).cast("bigint") + F.lit(OFFSET).cast("bigint")).alias("x"))


def rows_of(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_list()).astype(np.int64)


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - total / n with one rounding: the difference is taken in whole numbers."""
    if n * max(int(np.abs(x).max()), 1) < 1 << 62:
        return (n * x - total.astype(np.int64)) / n
    return ((n * x.astype(object) - total.astype(object)) / n).astype(float)


def sums(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of distinct vectors and their exact sum per dimension."""
    at = distinct.select(F.posexplode("x").alias("d", "c")).groupBy("d").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
    ordered = sorted(at, key=lambda r: r["d"])
    return (ordered[0]["n"], np.array([int(r["s"]) for r in ordered], dtype=object)) if ordered else (0, np.zeros(0, object))


def products(df: DataFrame, n: int, total: np.ndarray, move: np.ndarray | None = None) -> np.ndarray:
    """Sum of outer products of the centred vectors, or of what ``move`` makes of them, added up on Spark by matrix row."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if len(batch):
                z = centred(rows_of(batch["x"]), n, total)
                z = z if move is None else z @ move
                held = z.T @ z if held is None else held + z.T @ z
        if held is not None:
            yield pd.DataFrame({"i": np.repeat(np.arange(len(held)), held.shape[1]), "j": np.tile(np.arange(held.shape[1]), len(held)), "s": held.ravel()})

    out = np.zeros((len(total), len(total)) if move is None else (move.shape[1], move.shape[1]))
    for r in df.select("x").mapInPandas(partial, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r["i"], r["j"]] = r["s"]
    return (out + out.T) / 2


def below(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix below a shift: negative pivots of LDL' with symmetric pivoting."""
    m = a - shift * np.eye(len(a))
    negative, at, n = 0, 0, len(a)
    alpha = (1 + np.sqrt(17)) / 8
    while at < n:
        rest = m[at:, at:]
        column = np.abs(rest[:, 0])
        size = 1
        if len(rest) > 1:
            r = int(np.argmax(column[1:])) + 1
            if column[0] < alpha * column[r]:
                other = np.abs(rest[r].copy())
                other[r] = 0.0
                if column[0] * other.max() < alpha * column[r] ** 2:
                    if abs(rest[r, r]) >= alpha * other.max():
                        swap = [(0, r)]
                    else:
                        swap, size = [(1, r)], 2
                    for i, j in swap:
                        rest[[i, j]] = rest[[j, i]]
                        rest[:, [i, j]] = rest[:, [j, i]]
        block = rest[:size, :size]
        if size == 1:
            pivot = block[0, 0]
            negative += pivot < 0
            if len(rest) > 1 and pivot != 0:
                c = rest[1:, 0].copy()
                rest[1:, 1:] -= np.outer(c, c / pivot)
        else:
            # A pair pivot is taken only where its determinant is negative: one eigenvalue of each sign.
            negative += 1
            c = rest[2:, :2].copy()
            if len(c):
                rest[2:, 2:] -= c @ np.linalg.solve(block, c.T)
        at += size
    return int(negative)


def polish(a: np.ndarray, low: float, high: float, known: list[np.ndarray], fixed: bool, k: int) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the middle of an interval, kept orthogonal to the vectors known.

    ``fixed``: the interval is as narrow as precision allows, so its middle stays the shift.
    """

    def clear(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for u in known:
                v = v - (u @ v) * u
        return v / np.linalg.norm(v)

    size = np.abs(a).max()
    v = clear(np.random.default_rng(k).normal(size=len(a)))
    shift, last = (low + high) / 2, np.inf
    for turn in range(30):
        try:
            w = np.linalg.solve(a - shift * np.eye(len(a)), v)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            w = np.linalg.solve(a - (shift + ROUND * size) * np.eye(len(a)), v)
        v = clear(w / np.linalg.norm(w))
        if turn < 2:  # these steps turn the start towards the interval; then the quotient leads
            continue
        value = float(v @ a @ v)
        rest = float(np.linalg.norm(a @ v - value * v))
        if last <= 8 * ROUND * size and rest >= last / 2:
            return value, v
        shift, last = shift if fixed else value, rest
    return None


@dataclass
class Spectrum:
    values: np.ndarray  # falling
    vectors: np.ndarray  # a column each
    counts: int  # inertia counts used


def leading(a: np.ndarray, wanted: int) -> Spectrum:
    """The largest eigenvalues with positive value, numbered by inertia counts."""
    n = len(a)
    radius = float((np.abs(a).sum(axis=1)).max()) if n else 0.0
    size = np.abs(a).max() if n else 0.0
    least = n * ROUND * radius  # smaller ones are rounding
    known: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in known:
            known[shift] = n - below(a, shift)
        return known[shift]

    values: list[float] = []
    vectors: list[np.ndarray] = []
    if n == 0 or radius == 0.0:
        return Spectrum(np.zeros(0), np.zeros((n, 0)), 0)
    for k in range(1, min(wanted, n) + 1):
        # above(low) >= k > above(high): the k-th largest lies in [low, high).
        low = max((s for s, c in known.items() if c >= k), default=-radius)
        high = min((s for s, c in known.items() if c < k), default=2 * radius)
        tight = 4 * ROUND * radius * max(1.0, n / 64)
        found = None
        while found is None:
            alone, narrow = above(low) == k and above(high) == k - 1, high - low <= tight
            if alone or narrow:
                near = polish(a, low, high, [u for u, e in zip(vectors, values) if e - high <= 1e3 * tight], narrow, k)
                if near is not None and (
                    low - tight <= near[0] <= high + tight if narrow else above(near[0] - tight) >= k and above(near[0] + tight) < k
                ):
                    found = near
                elif high - low <= tight / 1024:
                    raise ArithmeticError("no eigenvector found in an isolated interval")
            if found is None:
                middle = (low + high) / 2
                low, high = (middle, high) if above(middle) >= k else (low, middle)
        if found[0] <= least:
            break
        values.append(found[0])
        vectors.append(found[1])
    return Spectrum(np.array(values), np.array(vectors).T.reshape(n, len(values)), len(known))


@dataclass
class Whitening:
    n: int
    total: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    move: np.ndarray  # projects a centred vector and scales it to unit variance
    identity_error: float


def fit(x: DataFrame, components: int = 16) -> Whitening:
    """The directions of a table of whole-number vectors, from its distinct ones."""
    distinct = materialize(x.select("x").distinct(), "distinct-vectors")
    n, total = sums(distinct)
    if n == 0:  # no vector
        return Whitening(0, total, np.zeros(0), np.zeros(0), np.zeros((0, 0)), 0.0)
    covariance = products(distinct, n, total) / n
    found = leading(covariance, components)
    move = found.vectors / np.sqrt(found.values)
    error = float(np.abs(products(distinct, n, total, move) / n - np.eye(len(found.values))).max()) if len(found.values) else 0.0
    return Whitening(n, total, found.values, found.values / np.trace(covariance) if len(found.values) else found.values, move, error)


def apply(x: DataFrame, model: Whitening) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    k = len(model.values)

    @pandas_udf("struct<deviation:bigint,whitened:array<double>>")
    def run(column: pd.Series) -> pd.DataFrame:
        if not len(column) or not k:
            return pd.DataFrame({"deviation": [None] * len(column), "whitened": [[]] * len(column)})
        rows = rows_of(column)
        largest = model.n * int(np.abs(rows).max()) + max(abs(int(t)) for t in model.total)
        off = model.n * rows - model.total.astype(np.int64) if largest < 1 << 62 else model.n * rows.astype(object) - model.total
        if int(np.abs(off).max()) ** 2 * rows.shape[1] >= 1 << 62:
            off = off.astype(object)
        deviation = [int(d) if d < 1 << 63 else None for d in (off * off).sum(axis=1)]
        return pd.DataFrame({"deviation": pd.array(deviation, dtype="Int64"), "whitened": list(centred(rows, model.n, model.total) @ model.move)})

    found = x.select("vec_id", run("x").alias("r")).select("vec_id", F.col("r.deviation").alias("deviation"), F.posexplode("r.whitened").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(e)) for e in model.explained])
    return found.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        (F.get(shares, F.col("at")) if k else F.lit(None).cast("double")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )

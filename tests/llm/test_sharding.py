"""Exact shard sizes, whole rows, and the laws of the shuffle."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaline.llm import queries, sharding

FOLDER = "/root/testdata/sf0.001"


def checked(rows, docs, shards):
    """Every document once, counts at most one apart, slots gapless."""
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    held = Counter(r["shard"] for r in rows)
    assert max(held[s] for s in range(shards)) - min(held[s] for s in range(shards)) <= 1 and set(held) <= set(range(shards))
    for shard, n in held.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)


def test_sharding_of_given_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.QUERIES["op13_sharding"](spark, FOLDER).collect()
    checked(rows, docs, 8)
    assert [tuple(r) for r in queries.QUERIES["op13_sharding"](spark, FOLDER).orderBy("shard", "slot").collect()] == sorted(map(tuple, rows), key=lambda r: (r[4], r[5]))
    # Neighbours of the table do not stay neighbours.
    by_place = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert sum(abs(a - b) == 1 for a, b in zip(by_place, by_place[1:])) < 15


@pytest.mark.parametrize("n", [0, 1, 5, 47])
def test_sharding_of_odd_rows(spark, tmp_path, n):
    docs = [(None if k % 7 == 3 else k % 11, [None, "", "same", "é" * 3, "long " * 50_000, "𝄞"][k % 6]) for k in range(n)]
    spark.createDataFrame([(*d, 9, "y") for d in docs], "doc_id long, text string, shard int, slot string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    checked(queries.QUERIES["op13_sharding"](spark, str(tmp_path)).collect(), docs, 8)


def test_other_columns_stay(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("slot"), F.lit("z").alias("ends"))
    rows = sharding.shuffle(df, 3, seed=4).collect()
    assert sorted(r["id"] for r in rows) == list(range(100)) and Counter(r["shard"] for r in rows) == {0: 34, 1: 33, 2: 33}
    assert {r["ends"] for r in rows} == {"z"}


def test_matrix_has_exact_margins():
    sizes = [0, 7, 1, 0, 1000, 12, 3, 3, 3_000_000_000, 5]
    before = [0, *itertools.accumulate(sizes)]
    for shards in (1, 3, 8):
        for seed in range(5):
            m = np.array([sharding.counts(before, p, shards, seed) for p in range(len(sizes))])
            assert (m >= 0).all() and m.sum(axis=1).tolist() == sizes
            assert m.sum(axis=0).max() - m.sum(axis=0).min() <= 1


def test_draws_follow_the_law():
    r = np.random.default_rng(5)
    got = Counter(sharding.hypergeometric(r, 7, 9, 6) for _ in range(40_000))
    for k in range(7):
        p = math.comb(7, k) * math.comb(9, 6 - k) / math.comb(16, 6)
        assert abs(got[k] / 40_000 - p) < 4 * math.sqrt(p * (1 - p) / 40_000) + 1e-4
    big = np.array([sharding.hypergeometric(r, 10**11, 10**11, 10**10) for _ in range(60)], float)
    deviation = math.sqrt(10**10 / 4 * (1.9 / 2))
    assert abs(big.mean() - 5 * 10**9) < 5 * deviation / math.sqrt(60) and 0.6 < big.std() / deviation < 1.5


def test_shuffle_mixes_partitions_and_places(spark):
    """Every partition meets every shard and every stretch of its slots as often as chance has it."""
    rows = sharding.shuffle(spark.range(0, 6000, 1, 6), 4, seed=11).collect()
    seen = Counter((r["shard"], r["slot"] // 300, r["id"] // 1000) for r in rows)
    chi = sum((seen[(s, t, p)] - 50) ** 2 / 50 for s in range(4) for t in range(5) for p in range(6))
    assert 50 < chi < 150  # about 95 degrees of freedom
    near = np.array([r["id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))], float)
    assert abs(np.corrcoef(near[:-1], near[1:])[0, 1]) < 0.05

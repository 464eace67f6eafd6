"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Equal vectors are one vector with the smallest ids that carry it.  Vectors fall into shards by hash,
each of about ``shard_size`` whatever the table's size; a task builds the graph of a shard and the
index is written as one row per shard: vectors, neighbour arrays of each level as flat integers, and
ids.  Queries come in blocks; each (shard, block) is one task's work, and the best of all shards are
merged by score, then id.

Largest inner product is nearest distance once every vector carries a further component that makes
all lengths of the shard equal; the graph is built on those, and scores are inner products of the
original vectors in double precision.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another
length than most, neither ask nor answer.  Ties go to the smaller id.  A query gets all other vectors
if fewer than ``k`` exist.  The search is approximate: tests measure its recall against brute force.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .vectors import stack, valid

LINKS = 12  # neighbours per node and level; twice as many on the lowest
BUILD, SEARCH = 64, 96  # nodes kept while inserting and while searching
INDEX = "shard long, n int, dim int, top int, entry int, vectors binary, ids binary, levels binary, links binary"


class Graph:
    """Neighbours of all nodes as flat arrays, one per level, -1 where there is none."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, links: list[np.ndarray] | None = None, entry: int = 0) -> None:
        norm = (x * x).sum(axis=1)
        # The last component makes all lengths equal; a query has 0 there.
        self.x = np.hstack([x, np.sqrt(np.maximum(norm.max(initial=0) - norm, 0))[:, None]]).astype(np.float32)
        self.levels, self.entry = levels, entry
        self.links = links or [np.full((len(x), LINKS * (1 if level else 2)), -1, np.int32) for level in range(int(levels.max(initial=0)) + 1)]
        self.seen, self.turn = np.zeros(len(x), np.int64), 0

    def near(self, q: np.ndarray, start: list[int], level: int, size: int) -> list[tuple[float, int]]:
        """The best ``size`` nodes found from ``start`` on, best first, as (-score, node)."""
        self.turn += 1
        links, x, seen, turn = self.links[level], self.x, self.seen, self.turn
        seen[start] = turn
        todo = [(-float(s), i) for s, i in zip(x[start] @ q, start)]
        heapq.heapify(todo)
        best = [(-s, i) for s, i in todo]
        heapq.heapify(best)
        while len(best) > size:
            heapq.heappop(best)
        while todo:
            s, i = heapq.heappop(todo)
            if len(best) == size and -s < best[0][0]:
                break
            around = links[i]
            around = around[around >= 0]
            around = around[seen[around] != turn]
            if not len(around):
                continue
            seen[around] = turn
            scores = x[around] @ q
            if len(best) == size:
                better = scores > best[0][0]
                around, scores = around[better], scores[better]
            for t, j in zip(scores.tolist(), around.tolist()):
                if len(best) < size:
                    heapq.heappush(best, (t, j))
                elif t > best[0][0]:
                    heapq.heapreplace(best, (t, j))
                else:
                    continue
                heapq.heappush(todo, (-t, j))
        return sorted((-s, i) for s, i in best)

    def spread(self, i: int, around: list[int], size: int) -> list[int]:
        """Neighbours of ``i`` from candidates, best first: those nearer to it than to one chosen before, then the rest."""
        if len(around) <= size:
            return around
        x = self.x[around]
        to_i, between = (x @ self.x[i]).tolist(), x @ x.T
        chosen: list[int] = []
        closest = np.full(len(around), -np.inf, np.float32)
        for at, score in enumerate(to_i):
            if score > closest[at]:
                chosen.append(at)
                if len(chosen) == size:
                    break
                np.maximum(closest, between[at], out=closest)
        if len(chosen) < size:
            taken = set(chosen)
            chosen += [at for at in range(len(around)) if at not in taken][: size - len(chosen)]
        return [around[at] for at in chosen]

    def insert(self, i: int) -> None:
        q, level, start = self.x[i], int(self.levels[i]), [self.entry]
        for high in range(int(self.levels[self.entry]), level, -1):
            start = [self.near(q, start, high, 1)[0][1]]
        for at in range(min(level, int(self.levels[self.entry])), -1, -1):
            found = [j for _, j in self.near(q, start, at, BUILD)]
            links, size = self.links[at], self.links[at].shape[1]
            chosen = self.spread(i, found, LINKS)
            links[i, : len(chosen)] = chosen
            for j in chosen:
                row = links[j]
                free = np.flatnonzero(row < 0)
                if len(free):
                    row[free[0]] = i
                else:
                    around = np.append(row, np.int32(i))
                    around = around[np.argsort(-(self.x[around] @ self.x[j]), kind="stable")]
                    kept = self.spread(j, around.tolist(), size)
                    row[:] = -1
                    row[: len(kept)] = kept
            start = found
        if level > self.levels[self.entry]:
            self.entry = i

    def search(self, q: np.ndarray, size: int) -> list[int]:
        start, q = [self.entry], np.append(q, 0).astype(np.float32)
        for high in range(int(self.levels[self.entry]), 0, -1):
            start = [self.near(q, start, high, 1)[0][1]]
        return [j for _, j in self.near(q, start, 0, size)]


def build(x: np.ndarray, seed: int) -> Graph:
    random = np.random.default_rng(seed)
    levels = np.minimum(np.floor(-np.log(1 - random.random(len(x))) / math.log(LINKS)), 12).astype(np.int8)
    graph = Graph(x, levels)
    for i in range(1, len(x)):
        graph.insert(i)
    return graph


def index(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", shard_size: int = 4_000, k: int = 20) -> DataFrame:
    """The written index, one row per shard; ``k`` bounds how many ids of an equal vector it holds."""
    good = valid(df, vec_id, embedding)
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    # A query's own id may be among them, hence one more; the limit of a rank runs before the shuffle.
    few = good.distinct().withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    one = materialize(few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    shards = max(1, math.ceil(one.count() / shard_size))
    spread = one.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)))

    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ids", key=lambda ids: ids.map(lambda a: a[0]), ignore_index=True)
        x = stack(rows["embedding"])
        graph = build(x, int(key[0]))
        ids = np.full((len(x), k + 1), -1, "<i8")
        held = np.zeros((len(x), k + 1), bool)
        for i, a in enumerate(rows["ids"]):
            ids[i, : len(a)], held[i, : len(a)] = a, True
        return pd.DataFrame([{
            "shard": key[0], "n": len(x), "dim": x.shape[1], "top": len(graph.links), "entry": graph.entry, "vectors": x.astype("<f8").tobytes(),
            "ids": ids.tobytes() + held.tobytes(), "levels": graph.levels.tobytes(), "links": b"".join(a.astype("<i4").tobytes() for a in graph.links),
        }])

    # A stated number of partitions: adaptive execution would merge shards by their few bytes, not by the work on them.
    return materialize(spread.repartition(4 * shards, "shard").groupBy("shard").applyInPandas(make, INDEX), "hnsw")


def restore(row: pd.Series) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """Graph, vectors, ids and which of them are set, from a row of the index."""
    n = int(row["n"])
    x = np.frombuffer(row["vectors"], "<f8").reshape(n, int(row["dim"]))
    flat, links, at = np.frombuffer(row["links"], "<i4"), [], 0
    for level in range(int(row["top"])):
        width = LINKS * (1 if level else 2)
        links.append(flat[at : at + n * width].reshape(n, width))
        at += n * width
    graph = Graph(x, np.frombuffer(row["levels"], np.int8), links, int(row["entry"]))
    width = len(row["ids"]) // (9 * n)
    ids = np.frombuffer(row["ids"], "<i8", n * width).reshape(n, width)
    return graph, x, ids, np.frombuffer(row["ids"], bool, offset=8 * n * width).reshape(n, width)


def search(index: DataFrame, queries: DataFrame, k: int = 20, block: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query in ``queries`` (query_id, embedding double[])."""
    blocks = max(1, math.ceil(queries.count() / block))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"block": key[0], "query_ids": rows["query_id"].to_numpy("<i8").tobytes(), "asked": stack(rows["embedding"]).astype("<f8").tobytes()}])

    packed = asked.groupBy("block").applyInPandas(pack, "block int, query_ids binary, asked binary")
    shards = index.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0]
    # The stated queries against every shard: one row of each side per task.
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = materialize(packed, "queries").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards).cast("bigint"))))
    top = max(k + 1, SEARCH)

    def answer(key: tuple, graphs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(graphs) and len(rows):
            graph, x, ids, held = restore(graphs.iloc[0])
            names = np.frombuffer(rows.iloc[0]["query_ids"], "<i8")
            for name, q in zip(names.tolist(), np.frombuffer(rows.iloc[0]["asked"], "<f8").reshape(len(names), -1)):
                found = np.array(graph.search(q, top))
                score = (x[found] * q).sum(axis=1)
                # Vectors that cannot be among the best k are not spelled out into their ids.
                order = np.argsort(-score, kind="stable")
                cut = score[order[min(k, len(order) - 1)]]
                answers = sorted((-s, i) for f, s in zip(found, score.tolist()) if s >= cut for i in ids[f][held[f]].tolist() if i != name)[:k]
                out["query_id"] += [name] * len(answers)
                out["vec_id"] += [i for _, i in answers]
                out["score"] += [-s for s, _ in answers]
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(answer, "query_id long, vec_id long, score double")
    rank: Column = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are lower-case words and their first four letters (``chll*``), which carry inflected and
compounded forms.  Those whose document frequency differs by label by a factor of ``lift`` or more,
and by ``sure`` standard errors of its logarithm, make the vocabulary, if the same holds when each is
counted once for each pair of neighbouring words (copies of a document are one case).  Text outside
the vocabulary says nothing about the label.  The labelled examples' TF-IDF
vectors lie in an inverted index whose postings are grouped in blocks of examples, each with its
largest weight.  A query adds up those maxima, visits blocks from the highest bound down and stops
when no block can beat the neighbours found: the result equals a full scan.  Votes weigh by
similarity and by how strongly each class was sampled; a leave-one-out run over the examples gives
the monotone map from votes to probabilities.

Defined results: a text without any vocabulary term (null and empty ones too) gets the toxic share
of the examples without one.  Ties among neighbours go to the smaller example number.  Rows with a
null text or label are no examples; without any example every score is 0.  Columns of the result's
names are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import scratch_name, slices, small_batches

WORD = re.compile(r"[^\W_]+")
BLOCK = 64  # examples of a block


def terms_of(text: str | None) -> Counter:
    found: Counter = Counter()
    for piece in slices((text or "").lower()):
        found.update(WORD.findall(piece))
    stems: Counter = Counter()
    for word, n in found.items():
        if len(word) > 4:
            stems[word[:4] + "*"] += n
    return found + stems


def vector(text: str | None, number: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers, ascending, and weights of length 1."""
    held = sorted((number[term], n) for term, n in terms_of(text).items() if term in number)
    terms = np.array([t for t, _ in held], np.int64)
    weights = (1 + np.log(np.array([n for _, n in held], float))) * idf[terms]
    return terms, weights / (np.linalg.norm(weights) or 1)


class Index:
    """Inverted lists cut into blocks of examples, each list entry with the block's largest weight."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> None:
        # Neighbours share their strongest term: in that order blocks hold like examples and bounds are tight.
        strongest = [terms[weights.argmax()] if len(terms) else n_terms for terms, weights in vectors]
        self.example = np.argsort(np.array(strongest, np.int64), kind="stable")
        place = np.empty(len(vectors), np.int64)
        place[self.example] = np.arange(len(vectors))
        term = np.concatenate([terms for terms, _ in vectors] or [np.zeros(0, np.int64)])
        at = np.repeat(place, [len(terms) for terms, _ in vectors])
        weight = np.concatenate([weights for _, weights in vectors] or [np.zeros(0)])
        order = np.lexsort((at, term))
        term, self.at, self.weight = term[order], at[order], weight[order]
        first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (self.at[1:] // BLOCK != self.at[:-1] // BLOCK)]) if len(term) else np.zeros(0, np.int64)
        self.start = np.r_[first, len(term)]
        self.block = self.at[first] // BLOCK
        self.largest = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)
        self.lists = np.searchsorted(term[first], np.arange(n_terms + 1))
        self.n_blocks = -(-len(vectors) // BLOCK)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The ``k`` examples of largest positive cosine as (cosine, example), but for ``skip``."""
        bound = np.zeros(self.n_blocks)
        entry: dict[int, list[tuple[int, float]]] = {}
        for t, w in zip(terms, weights):
            here = slice(self.lists[t], self.lists[t + 1])
            bound[self.block[here]] += w * self.largest[here]
            for e, b in enumerate(self.block[here].tolist(), int(self.lists[t])):
                entry.setdefault(b, []).append((e, w))
        best: list[tuple[float, int]] = []
        for b in sorted(entry, key=lambda b: -bound[b]):
            if len(best) == k and bound[b] < -best[-1][0] - 1e-9:
                break
            score = np.zeros(BLOCK)
            for e, w in entry[b]:
                here = slice(self.start[e], self.start[e + 1])
                score[self.at[here] - b * BLOCK] += w * self.weight[here]
            for i in np.flatnonzero(score):
                example = int(self.example[b * BLOCK + i])
                if example != skip:
                    # Rounded, so that equal texts tie whatever the order of summation.
                    best.append((-round(float(score[i]), 12), example))
            best = sorted(best)[:k]
        return [(-s, example) for s, example in best]


def monotone(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit of labels on votes, as points to interpolate."""
    points: list[list[float]] = []
    for x in np.unique(raw):
        here = raw == x
        points.append([x, float(weight[here].sum()), float((weight * label)[here].sum()), x])
        while len(points) > 1 and points[-2][2] / points[-2][1] >= points[-1][2] / points[-1][1]:
            last = points.pop()
            points[-1] = [points[-1][0], points[-1][1] + last[1], points[-1][2] + last[2], last[3]]
    return np.array([x for p in points for x in (p[0], p[3])]), np.array([p[2] / p[1] for p in points for _ in range(2)])


class Model:
    """Vocabulary, examples, index and calibration; made of plain arrays and dicts."""

    def __init__(self, state: dict) -> None:
        self.__dict__ |= state
        self.index = Index(self.vectors, len(self.number)) if state.get("index") is None else state["index"]

    def votes(self, text: str | None, skip: int = -1) -> tuple[float | None, list[tuple[float, int]]]:
        terms, weights = vector(text, self.number, self.idf)
        near = self.index.search(terms, weights, self.k, skip) if len(terms) else []
        if not near:
            return None, near
        example = [e for _, e in near]
        # Distance weight: the squared cosine.  The class weight undoes the sampling by label.
        weight = np.array([s for s, _ in near]) ** 2 * self.weight[example]
        return float((weight * self.label[example]).sum() / weight.sum()), near

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        raw, near = self.votes(text)
        evidence = [{"example": self.ids[e], "label": int(self.label[e]), "similarity": s} for s, e in near]
        return (self.silent if raw is None else float(np.interp(raw, *self.curve))), evidence


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    per_class: int = 5_000, max_terms: int = 20_000, lift: float = 5.0,
    sure: float = 3.3, k: int = 15,
) -> dict:
    """State of a :class:`Model` from labels joined to texts by id.

    ``per_class`` bounds the fit: about so many labelled rows of each class, chosen by a hash of the
    id, are examples, one text (the first in order) of each id.  What the driver gets is bounded by it: term counts are summed on Spark and
    only the vocabulary, at most ``max_terms``, and the examples' vectors come back.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    marked = marked.groupBy("id").agg(F.max("label").alias("label"))
    sizes = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rate = {c: min(1.0, per_class / sizes[c]) for c in sizes}
    drawn = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.when(F.col("label") == 1, rate.get(1, 0.0)).otherwise(rate.get(0, 0.0)) * 1_000_000
    # At most about 2 * per_class ids: safe to broadcast.
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter("text is not null").join(F.broadcast(marked.filter(drawn)), "id")
    # A fixed order of examples, so that ties resolve alike in every run.
    # An id that stands on many rows is one example, so that the sample is bounded whatever repeats.
    sample = small_batches(sample).groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    sample = materialize(sample, "toxicity-sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = [Counter(), Counter()]
            for value, y in zip(batch["text"], batch["label"]):
                n[y].update(terms_of(value).keys())
            terms = list(n[0] | n[1])
            yield pd.DataFrame({"term": terms, "clean": [n[0][t] for t in terms], "toxic": [n[1][t] for t in terms]})

    def telling(counts: DataFrame, clean: int, toxic: int) -> DataFrame:
        odds = F.abs(F.log(((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))))
        certain = odds / F.sqrt(1 / (F.col("clean") + 0.5) + 1 / (F.col("toxic") + 0.5))
        return counts.withColumn("certain", certain).filter((odds >= float(np.log(lift))) & (F.col("certain") >= sure))

    share = {r["label"]: (r["n"], r["w"]) for r in sample.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("w")).collect()}
    (clean, clean_size), (toxic, toxic_size) = share.get(0, (0, 0)), share.get(1, (0, 0))
    counts = sample.mapInPandas(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    wanted = telling(counts, clean, toxic).orderBy(F.col("certain").desc(), "term").limit(max_terms).toPandas()
    told = spark.sparkContext.broadcast(set(wanted["term"]))

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = set()
            for value, y in zip(batch["text"], batch["label"]):
                for piece in slices(value.lower()):
                    words = ["", *WORD.findall(piece), ""]
                    for i in range(1, len(words) - 1):
                        for term in (words[i], words[i][:4] + "*"):
                            if term in told.value:
                                seen.add((term, zlib.crc32(f"{words[i - 1]} {words[i + 1]}".encode()), y))
            yield pd.DataFrame(list(seen), columns=["term", "context", "label"])

    # A document copied many times is one case, not many: each term counts once for each pair of words around it.
    cases = sample.mapInPandas(contexts, "term string, context long, label int").distinct().groupBy("term").agg(
        F.sum(1 - F.col("label")).alias("clean"), F.sum("label").alias("toxic")
    )
    terms = telling(cases, clean_size, toxic_size).select("term").toPandas().merge(wanted, on="term").sort_values("term").reset_index(drop=True)
    number = {t: i for i, t in enumerate(terms["term"])}
    idf = np.log(1 + (clean + toxic) / (terms["clean"] + terms["toxic"]).to_numpy(float))
    shared = spark.sparkContext.broadcast((number, idf))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [vector(value, *shared.value) for value in batch["text"]]
            yield pd.DataFrame({
                "id": batch["id"], "label": batch["label"],
                "terms": [t.astype("<i8").tobytes() for t, _ in found], "weights": [w.astype("<f8").tobytes() for _, w in found],
            })

    rows = sample.mapInPandas(vectors, "id long, label int, terms binary, weights binary").toPandas()
    rows = rows.sort_values(["id", "label", "terms"], kind="stable")
    has_terms = rows["terms"].map(len).to_numpy(int) > 0
    voiced, silent = rows[has_terms], rows[~has_terms]
    of_class = {c: 1 / r for c, r in rate.items()}
    silent_weight = silent["label"].map(of_class).to_numpy(float)
    state = {
        "number": number, "idf": idf, "k": k, "index": None,
        "vectors": [(np.frombuffer(t, "<i8"), np.frombuffer(w, "<f8")) for t, w in zip(voiced["terms"], voiced["weights"])],
        "ids": voiced["id"].tolist(), "label": voiced["label"].to_numpy(float), "weight": voiced["label"].map(of_class).to_numpy(float),
        "silent": float((silent["label"] * silent_weight).sum() / silent_weight.sum()) if len(silent) else 0.0,
        "curve": (np.array([0.0, 1.0]), np.array([0.0, 1.0])),
    }
    if not len(voiced):
        return state
    # Leave-one-out votes of the examples, in blocks of them on Spark; at most 2 * per_class rows come back.
    model = spark.sparkContext.broadcast(state)

    def leave_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(model.value)
        for batch in batches:
            for i in batch["id"]:
                near = m.index.search(*m.vectors[i], m.k, i)
                example = [e for _, e in near]
                w = np.array([s for s, _ in near]) ** 2 * m.weight[example]
                yield pd.DataFrame({"i": [i], "raw": [float((w * m.label[example]).sum() / w.sum()) if near else None]})

    parts = spark.sparkContext.defaultParallelism
    raw = spark.range(0, len(voiced), 1, parts).mapInPandas(leave_out, "i long, raw double").toPandas().dropna().sort_values("i")
    if len(raw):
        at = raw["i"].to_numpy(np.int64)
        state["curve"] = monotone(raw["raw"].to_numpy(float), state["label"][at], state["weight"][at])
    return state


def score(df: DataFrame, state: dict, text: str = "text", prefix: str = "toxic_") -> DataFrame:
    """Add ``<prefix>score`` and ``<prefix>evidence``, the neighbours behind it, nearest first."""
    shared = df.sparkSession.sparkContext.broadcast(state)

    @F.pandas_udf("score double, evidence array<struct<example: bigint, label: int, similarity: double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(shared.value)
        for batch in batches:
            found = [model.score(value) for value in batch]
            yield pd.DataFrame({"score": [s for s, _ in found], "evidence": [e for _, e in found]})

    scratch = scratch_name(df, f"{prefix}found")
    out = small_batches(df).withColumn(scratch, run(F.col(text)))
    return out.withColumns({f"{prefix}score": F.col(scratch)["score"], f"{prefix}evidence": F.col(scratch)["evidence"]}).drop(scratch)

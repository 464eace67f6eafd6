"""Near-duplicate documents by consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five lower-case words.  A shingle weighs its count in the text times one plus
the mean inverse document frequency of its words (from 0 for a word of every document to 1 for a
word of one), so rare wording counts up to twice as much; weights lie on a grid of 1/16 in the
logarithm.  Document frequencies come from all documents, in a table of 2**18 hashed words whose
size does not grow.  Improved consistent weighted sampling draws 64 samples of each text, equal for
two texts with probability their weighted Jaccard similarity; four samples make a band.  Texts that
share a band are compared exactly and linked at similarity 0.8 or more; classes are the connected
components.

Groups of copies stay cheap: texts of the same words are one node from the start, and bands whose
buckets hold the same texts count once.  A bucket is compared inside a task, in pairs of blocks of
bounded size; pairs are never written out.  There a text is compared with all others of its blocks
until the texts not yet compared are all in one class, so a bucket of copies costs one comparison
per text, and no link that a band shows is lost.  A pair of similarity 0.8 shares no band with
probability 2e-4.  A bucket of many unlike texts costs the square of its size in comparisons.

Defined results: texts of fewer than five words are one shingle of all words; texts without a word
are copies of each other only if they are equal and not blank; null and blank texts are classes of
their own.  The class id is the smallest document id of the class (null ids last), and one row of
each class is kept: that of the smallest id, of rows with the same id any one.  Other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .common import components, slices, small_batches

WORDS = 5
BANDS, ROWS = 16, 4
POOL_BITS = 13  # variates are drawn once for 2**13 hash values: a table that stays in the cache
SLOTS = 1 << 18  # hashed words of the document-frequency table
GRID = 16
WORD = re.compile(r"[^\W_]+")
CHUNK = 256  # shingles sampled at once: the work stays in the cache
BLOCK = 512  # texts of a block of a bucket
KEPT_WORDS = 1 << 19  # words whose hash a task remembers


class Hashes(dict):
    """Hash of each word, remembered."""

    def __missing__(self, word: str) -> int:
        import xxhash

        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class Shingler:
    """Texts to word hashes, shingles and weights."""

    def __init__(self, idf: np.ndarray | None = None) -> None:
        import xxhash

        self.digest, self.known, self.idf = xxhash.xxh3_128_digest, Hashes(), idf

    def words(self, text: str) -> np.ndarray:
        parts = []
        for piece in slices(text.lower()):
            found = WORD.findall(piece)
            self.trim()
            parts.append(np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found)))
        return np.concatenate(parts)

    def trim(self) -> None:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()

    def fingerprint(self, text: str | None, words: np.ndarray) -> bytes | None:
        """Equal for texts of the same words; None for null and blank texts."""
        if len(words):
            return self.digest(words.tobytes())
        stripped = (text or "").strip()
        return self.digest(b"\0" + stripped.encode("utf-8", "replace")) if stripped else None

    def shingles(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingle hashes, ascending, and their weights' levels on the grid."""
        n = max(1, len(words) - WORDS + 1)
        size = min(WORDS, len(words))
        value, rarity = np.zeros(n, np.uint64), np.zeros(n, np.float32)
        by_word = self.idf[(words & np.uint64(SLOTS - 1)).astype(np.int64)]
        for i in range(size):
            value = value * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
            rarity += by_word[i : i + n]
        value ^= value >> np.uint64(32)
        value *= np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(32)
        value, first, n_times = np.unique(value, return_index=True, return_counts=True)
        weight = n_times * (1 + rarity[first] / size)
        return value, np.minimum(np.rint(GRID * np.log(weight)), 255).astype(np.uint8)


class Sampler:
    """Consistent weighted samples; the variates of a (hash, sample) pair come from a fixed pool."""

    def __init__(self) -> None:
        random = np.random.default_rng(20)
        n = 1 << POOL_BITS
        self.r, self.beta = random.gamma(2, 1, n), random.random(n)
        self.log_c = np.log(random.gamma(2, 1, n))
        self.multiplier = (random.integers(0, 1 << 31, (BANDS * ROWS, 1)) * 2 + 1).astype(np.uint32)
        self.values, self.steps = np.zeros((0, n), np.float32), np.zeros((0, n), np.int32)

    def reach(self, level: int) -> None:
        """Tables of ln a and t for all levels up to this one."""
        if level < len(self.values):
            return
        grid = np.arange(len(self.values), max(level + 1, len(self.values) + 32))[:, None] / GRID
        t = np.floor(grid / self.r + self.beta)
        self.values = np.vstack([self.values, (self.log_c - self.r * (t - self.beta + 1)).astype(np.float32)])
        self.steps = np.vstack([self.steps, t.astype(np.int32)])

    def bands(self, shingles: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """A hash of each band's samples."""
        self.reach(int(levels.max()))
        n = BANDS * ROWS
        best, where = np.full(n, np.inf, np.float32), np.zeros(n, np.int64)
        low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
        flat = self.values.ravel()
        base = levels.astype(np.uint32) << np.uint32(POOL_BITS)
        for start in range(0, len(shingles), CHUNK):
            here = slice(start, start + CHUNK)
            at = low[here] * self.multiplier
            at += high[here]
            at >>= np.uint32(32 - POOL_BITS)
            at += base[here]
            value = flat.take(at)
            least = value.argmin(axis=1)  # of equal values the smallest shingle
            found = value[np.arange(n), least]
            better = found < best
            best[better], where[better] = found[better], least[better] + start
        at = (low[where] * self.multiplier[:, 0] + high[where]) >> np.uint32(32 - POOL_BITS)
        t = self.steps[levels[where], at].astype(np.int64).view(np.uint64)
        sample = (shingles[where] ^ (t * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        out = np.arange(1, BANDS + 1, dtype=np.uint64)
        for i in range(ROWS):
            out = (out ^ (sample[i::ROWS] >> np.uint64(29)) ^ sample[i::ROWS]) * np.uint64(0xBF58476D1CE4E5B9)
        return (out ^ (out >> np.uint64(32))).view(np.int64)


def join_bucket(nodes: list[bytes], shingles: list[np.ndarray], levels: list[np.ndarray], threshold: float) -> list[tuple[bytes, bytes]]:
    """(node, root) for the nodes that links of at least the threshold join to another."""
    n = len(nodes)
    names, at = np.unique(np.concatenate(shingles), return_inverse=True)
    sizes = np.fromiter(map(len, shingles), np.int64, n)
    weight = np.exp(np.concatenate(levels) / GRID)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(n), sizes)
    total = np.bincount(owner, weight, n)
    order = np.argsort(at, kind="stable")
    listed, listed_weight = owner[order], weight[order]
    starts = np.searchsorted(at[order], np.arange(len(names) + 1))

    def similar(u: int) -> np.ndarray:
        mine = slice(ends[u] - sizes[u], ends[u])
        begin, length = starts[at[mine]], starts[at[mine] + 1] - starts[at[mine]]
        places = np.arange(length.sum()) + np.repeat(begin - (np.cumsum(length) - length), length)
        shared = np.bincount(listed[places], np.minimum(np.repeat(weight[mine], length), listed_weight[places]), n)
        return np.flatnonzero(shared >= threshold * (total + total[u] - shared) - 1e-9)

    label, left = np.arange(n), np.ones(n, bool)
    while True:
        classes, count = np.unique(label[left], return_counts=True)
        if len(classes) < 2:
            break
        u = int(np.flatnonzero(left & (label == classes[count.argmin()]))[0])
        left[u] = False
        joined = np.unique(label[similar(u)])
        label[np.isin(label, joined)] = joined[0]
    return [(nodes[i], nodes[label[i]]) for i in range(n) if label[i] != i]


def rarities(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Inverse document frequency of each hashed word over all documents, from 0 to 1; 1 MB, whatever their number."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, held, n = Shingler(), np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for value in batch["text"]:
                if value:
                    found = {w for piece in slices(value.lower()) for w in WORD.findall(piece)}
                    at = np.fromiter(map(shingler.known.__getitem__, found), np.uint64, len(found)) & np.uint64(SLOTS - 1)
                    held[np.unique(at.astype(np.int64))] += 1
                    shingler.trim()
                    n += 1
        slot = np.flatnonzero(held)
        yield pd.DataFrame({"slot": np.r_[slot, -1], "n": np.r_[held[slot], n]})

    counted = small_batches(docs).select(F.col(text).alias("text")).mapInPandas(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(SLOTS + 1)
    table[counted["slot"].to_numpy()] = counted["n"].to_numpy()  # -1, the number of documents, lands at the end
    total = table[-1]
    return (np.log((1 + total) / (1 + table[:-1])) / max(math.log(1 + total), 1e-9)).astype(np.float32)


def signatures(docs: DataFrame, idf: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, same, fingerprint, bands) of each row; ``same`` is a hash of id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    @F.pandas_udf("fingerprint binary, bands array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler, sampler = Shingler(shared.value), Sampler()
        for batch in batches:
            prints, bands = [], []
            for value in batch:
                words = shingler.words(value or "")
                prints.append(shingler.fingerprint(value, words))
                bands.append(sampler.bands(*shingler.shingles(words)) if len(words) else [])
            yield pd.DataFrame({"fingerprint": prints, "bands": bands})

    found = small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("same"), run(F.col(text)).alias("s"))
    return found.select("doc_id", "same", "s.fingerprint", "s.bands")


def vectors(docs: DataFrame, wanted: DataFrame, idf: np.ndarray, doc_id: str, text: str) -> DataFrame:
    """(node, shingles, levels) of the texts in ``wanted`` (node, same), 32 bits of each shingle, read again by the hash of id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(shared.value)
        for batch in batches:
            rows = []
            for node, value in zip(batch["node"], batch["text"]):
                words = shingler.words(value or "")
                if len(words) and shingler.fingerprint(value, words) == node:  # else another text of the same hash
                    shingles, levels = shingler.shingles(words)
                    rows.append((node, (shingles >> np.uint64(32)).astype(np.uint32).tobytes(), levels.tobytes()))
            yield pd.DataFrame(rows, columns=["node", "shingles", "levels"])

    # By the hash, not the id: rows of one id, whatever their number, meet no texts but their own.
    texts = small_batches(docs).select(F.xxhash64(doc_id, text).alias("same"), F.col(text).alias("text"))
    read = texts.join(wanted, "same").select("node", "text")
    found = read.mapInPandas(run, "node binary, shingles binary, levels binary")
    return materialize(found.groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("levels").alias("levels")), "shingles")


def links(members: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of nodes in the same class, enough to join all that share a bucket and are similar."""
    buckets = members.groupBy("key").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("node") % 1_000_000_007).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")
    ).filter("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    blocks = materialize(buckets.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "buckets")
    placed = members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"))
    # With two blocks or more every pair of different blocks is a task's work, each block's own pairs among it.
    met = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: j != F.col("block")))
    dealt = placed.withColumn("other", F.explode(met)).select(
        F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "node"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def joined(rows: list) -> pd.DataFrame:
            found = join_bucket([r.node for r in rows], [np.frombuffer(r.shingles, np.uint32) for r in rows], [np.frombuffer(r.levels, np.uint8) for r in rows], threshold)
            return pd.DataFrame(found, columns=["a", "b"])

        rows: list = []
        for batch in batches:
            for row in batch.itertuples():
                if rows and rows[0].task != row.task:
                    yield joined(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield joined(rows)

    together = dealt.join(held, "node").repartition("task").sortWithinPartitions("task", "node")
    return materialize(together.mapInPandas(run, "a binary, b binary"), "links")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id, kept) of each row of ``docs``."""
    return keyed_classes(docs, doc_id, text, threshold).drop("same")


def keyed_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(doc_id, same, class_id, kept): with the hash of id and text, by which rows are found again whatever their id."""
    idf = rarities(docs, text)
    signed = materialize(signatures(docs, idf, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "same"))
    nodes = materialize(
        signed.filter("fingerprint is not null").groupBy(F.col("fingerprint").alias("node")).agg(first.alias("first"), F.first("bands").alias("bands")), "nodes"
    )
    banded = nodes.select("node", F.explode("bands").alias("key"))
    shared = materialize(banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "shared-bands")
    members = materialize(banded.join(shared, "key"), "members")
    wanted = members.select("node").distinct().join(nodes, "node").select("node", F.col("first.same").alias("same"))
    held = vectors(docs, wanted, idf, doc_id, text)

    label = components(links(members, held, threshold))
    grouped = nodes.select("node", "first")
    grouped = materialize(grouped.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("c"), "first"), "grouped")
    best = materialize(grouped.groupBy("c").agg(F.min("first").alias("best")), "best")
    named = grouped.join(best, "c").select(F.col("node").alias("fingerprint"), "best")
    out = signed.select("doc_id", "same", "row", "fingerprint").join(named, "fingerprint", "left")
    single = F.col("best").isNull()
    return out.select(
        "doc_id", "same", F.when(single, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("class_id"), (single | (F.col("best.row") == F.col("row"))).alias("kept")
    )

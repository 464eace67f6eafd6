"""Language-model scoring with a hashed maximum-entropy model and a class-factored softmax.

P(word | context) = P(class | context) * P(word | class).  The class model is a softmax over sums of
weight rows that hashed features of the context select: the word before (n-gram), the two before
(n-gram), the one before that alone (skip), and the classes of the last three.  It is trained in
rounds, each over its share of all texts: tasks take gradient steps over their part of the share, and
the averaged change of the weights becomes the next round's start.  Every text trains, once.  Within a class, words follow their counts over the whole
training set, plus one, with one place per class for words never seen.

Classes come from the company words keep: frequent words are clustered by their neighbours, every
other word joins the class whose words it resembles in letter trigrams.  A word's class depends on its
letters and the fitted tables only, so unseen words have one too.

Counts cover all training texts and grow with the corpus: one row per word on Spark.  The most
frequent ``head`` words travel with the scoring tasks; the other words of each text meet their counts
in a join, as (text, word hash, times) rows.

Defined results: tokens are runs without white space, A-Z in lower case, then one end token; null
texts are empty and score as the end token alone.  Without training texts all counts are 0.  Words are
told apart by a 64-bit hash.  Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import discard, materialize
from .common import small_batches

CLASSES = 32  # the last is the end token's
END = b""
BUCKETS = 1 << 15  # hashed feature rows, at least
OFTEN = 8  # the rows grow with the number of words seen so often
BLOCK = 1024  # feature rows whose changes are averaged together
PACK = 1 << 10, 1 << 16  # tokens of a row of numbered words: a task's first one, and the most unless one text has more
FREQUENT, COMPANY = 4_096, 128  # clustered words; neighbours that describe them
TRIGRAMS = 1 << 12
COUNTED, TRAINED, SCORED = 1 << 20, 1 << 18, 1 << 19  # words a task remembers while counting, training, scoring
STRETCH = 1 << 16  # tokens scored together
PIECE = 1 << 20  # bytes of a long text tokenized at once


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in pieces, the end token last."""
    data, start = (text or "").encode("utf-8", "replace").lower(), 0  # of bytes, lower() changes A-Z only
    while len(data) - start > PIECE:
        cut = start + PIECE
        while cut < len(data) and data[cut] not in b" \t\n\v\f\r":
            cut += 1
        yield data[start:cut].split()
        start = cut
    yield [*data[start:].split(), END]


class Words(dict):
    """Numbers for words as they appear, with hash and class of each."""

    def __init__(self, classes: dict | None = None) -> None:
        super().__init__()
        self.classes, self.new = classes, []
        self.hash = np.zeros(0, np.int64)
        self.cls = np.zeros(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hash) + len(self.new)
        self.new.append(word)
        return n

    def number(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def settle(self) -> None:
        """Hash and class for the words that are new."""
        if self.new:
            import xxhash

            hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.new], np.uint64).view(np.int64)
            self.hash = np.concatenate([self.hash, hashes])
            self.cls = np.concatenate([self.cls, self.classify(self.new)])
            self.new = []

    def classify(self, words: list[bytes]) -> np.ndarray:
        if self.classes is None:
            return np.zeros(len(words), np.int64)
        out = (trigram_sums(words, self.classes["letters"]) + self.classes["prior"]).argmax(axis=1)
        known, is_end = self.classes["known"], CLASSES - 1
        return np.array([is_end if w == END else known.get(w, c) for w, c in zip(words, out.tolist())], np.int64)

    def full(self, limit: int) -> bool:
        return len(self) > limit


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter trigrams of words with marked ends, and where each word's begin."""
    data = np.frombuffer(b"".join(b"^" + w + b"$$" for w in words), np.uint8).astype(np.uint32)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(lengths + 2) - (lengths + 2)
    at = np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    value = (data[at] * 65_599 + data[at + 1]) * 65_599 + data[at + 2]
    return ((value * np.uint32(2_654_435_761)) >> np.uint32(20)).astype(np.int64), np.cumsum(lengths) - lengths


def trigram_sums(words: list[bytes], table: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), table.shape[1]), np.float32)
    for start in range(0, len(words), 1_000):  # their trigrams' rows fit the processor's cache
        part = words[start : start + 1_000]
        at, first = trigrams(part)
        out[start : start + len(part)] = np.add.reduceat(table[at], first)
    return out


def hashed(one: np.ndarray, two: np.ndarray, c1: np.ndarray, c2: np.ndarray, c3: np.ndarray, buckets: int) -> np.ndarray:
    """Four feature buckets per position, from the two hashes and the three classes before it; ``buckets`` is a power of two."""
    mix = np.uint64(0x9E3779B97F4A7C15)
    three = (c1 * np.uint64(64) + c2) * np.uint64(64) + c3
    raw = np.stack([one + np.uint64(1), two * mix + np.uint64(2), (one ^ (two * mix)) + np.uint64(3), three * mix + np.uint64(4)], axis=1)
    raw *= np.uint64(0xBF58476D1CE4E5B9)
    return (raw >> np.uint64(65 - int(buckets).bit_length())).astype(np.int32)


def stream_features(hashes: np.ndarray, cls: np.ndarray, buckets: int) -> np.ndarray:
    """Feature buckets of whole texts one after the other, each closed by its end token."""
    at = np.arange(len(cls))
    first = np.r_[True, cls[:-1] == CLASSES - 1] if len(cls) else np.zeros(0, bool)
    since = at - np.maximum.accumulate(np.where(first, at, 0))

    def before(values: np.ndarray, k: int, none: int) -> np.ndarray:
        return np.where(since >= k, values[np.maximum(at - k, 0)], np.uint64(none))

    h, c = hashes.view(np.uint64), cls.astype(np.uint64)
    return hashed(before(h, 1, 0), before(h, 2, 0), *(before(c, k, CLASSES) for k in (1, 2, 3)), buckets)


def summed(weights: np.ndarray, bias: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Sums of the weight rows that the features select, within what exp() can take: one row per position."""
    out = weights.take(features[:, 0], axis=0)
    for j in range(1, features.shape[1]):
        out += weights.take(features[:, j], axis=0)
    out += bias
    return np.clip(out, -60, 60, out=out)


def log_softmax(logits: np.ndarray) -> np.ndarray:
    """Logarithms of the class probabilities."""
    return logits - np.log(np.exp(logits) @ np.ones(logits.shape[1], logits.dtype))[:, None]


def streams(batch: pd.Series, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The texts of a batch one after the other, in stretches of bounded size: (word numbers, row of each, tokens repeated from the stretch before).

    A text that goes on in the next stretch begins there with its last three tokens, for the sake of their features.
    """
    found: list[np.ndarray] = []
    rows: list[int] = []
    held, again = 0, 0

    def stretch() -> tuple[np.ndarray, np.ndarray, int]:
        return np.concatenate(found), np.repeat(rows, [len(f) for f in found]), again

    for i, text in enumerate(batch):
        for piece in tokens(text):
            if held >= STRETCH:
                yield stretch()
                last = found[-1][-3:] if rows[-1] == i else np.zeros(0, np.int64)
                found, rows, held, again = ([last], [i], len(last), len(last)) if len(last) else ([], [], 0, 0)
            found.append(words.number(piece))
            rows.append(i)
            held += len(piece)
    if held:
        yield stretch()


def cluster(packs: DataFrame, frequent: list[bytes]) -> dict:
    """Classes of frequent words by their neighbours in all texts, and letter tables for all other words."""
    place = packs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(frequent)})
    size = max(1, len(frequent))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(size * 2 * COMPANY, np.int64)
        for batch in batches:
            for words, at in zip(batch["words"], batch["at"]):
                own, number = unpacked(words, at)
                at = np.fromiter((place.value.get(w, -1) for w in own), np.int64, len(own))[number]
                # An end token, which is never clustered, stands between any two texts.
                for here, near, shift in ((at[1:], at[:-1], 0), (at[:-1], at[1:], COMPANY)):
                    ok = (here >= 0) & (near >= 0) & (near < COMPANY)
                    cells, n = np.unique(here[ok] * (2 * COMPANY) + near[ok] + shift, return_counts=True)
                    table[cells] += n
        cells = np.flatnonzero(table)
        yield pd.DataFrame({"cell": cells, "n": table[cells]})

    # At most FREQUENT * 2 * COMPANY cells, summed on Spark.
    met = packs.mapInPandas(meet, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    company = np.zeros(size * 2 * COMPANY)
    company[met["cell"].to_numpy(np.int64)] = met["n"].to_numpy(float)
    company = company.reshape(size, 2 * COMPANY)
    x = np.sqrt(company)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    random = np.random.default_rng(8)
    centre = x[random.choice(len(x), CLASSES - 1, replace=len(x) < CLASSES - 1)]
    for _ in range(15):
        cls = (x @ centre.T).argmax(axis=1)
        for c in range(CLASSES - 1):
            if (cls == c).any():
                centre[c] = x[cls == c].sum(axis=0)
                centre[c] /= max(np.linalg.norm(centre[c]), 1e-9)
    letters = np.full((TRIGRAMS, CLASSES - 1), 0.1)
    if frequent:
        at, first = trigrams(frequent)
        np.add.at(letters, (at, np.repeat(cls, np.diff(np.r_[first, len(at)]))), 1)
    words_in = np.bincount(cls, minlength=CLASSES - 1)[: CLASSES - 1] if frequent else np.ones(CLASSES - 1)
    return {
        "known": {w: int(c) for w, c in zip(frequent, cls)}, "letters": np.log(letters / letters.sum(axis=0)).astype(np.float32),
        "prior": np.log((words_in + 1) / (words_in.sum() + CLASSES)).astype(np.float32),
    }


def unpacked(words: bytes, at: bytes) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of a row of :func:`packed`, and the number of each token's word."""
    own = bytes(words).split(b" ")
    return own, np.frombuffer(at, np.uint16 if len(own) <= 1 << 16 else np.uint32)


def share(row: int, rounds: int) -> int:
    """The round in which a task's n-th row trains: the first rows one each, later ones so that each round has four times the share of the one before.

    Early rounds, from which all tasks learn the frequent features, are short; what they send is small.
    """
    return row if row < rounds else max(0, rounds - 1 - ((row & -row).bit_length() - 1) // 2)


def packed(texts: DataFrame, rounds: int) -> DataFrame:
    """All texts as word numbers, so that later passes need not read words again.

    A row holds whole texts, one after the other: the distinct words in them, the end token first, the
    number of each token's word, and the round in which they train.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[bytes, int] = Words()
        found: list[np.ndarray] = []
        held, rows, size = 0, 0, PACK[0]  # growing rows deal small inputs over all rounds, too

        def row() -> pd.DataFrame:
            narrow = np.uint16 if len(words) <= 1 << 16 else np.uint32
            return pd.DataFrame({"words": [b" ".join(words)], "at": [np.concatenate(found).astype(narrow).tobytes()], "round": [share(rows, rounds)]})

        for batch in batches:
            for text in batch["text"]:
                if not held:
                    words.number([END])
                for piece in tokens(text):
                    found.append(words.number(piece))
                    held += len(piece)
                if held >= size:
                    yield row()
                    words, found, held, rows, size = Words(), [], 0, rows + 1, min(PACK[1], size * 2)
        if held:
            yield row()

    return materialize(texts.mapInPandas(pack, "words binary, at binary, round int"), "lm-packs")


def radix(values: np.ndarray) -> np.ndarray:
    """Stable order of whole numbers below 2**32 by two passes over 16 bits, for which numpy sorts by digits."""
    low = np.argsort(values.astype(np.uint16), kind="stable")
    return low[np.argsort((values[low] >> 16).astype(np.uint16), kind="stable")]


def train(packs: DataFrame, classes: dict, bias: np.ndarray, buckets: int, tasks: int, rounds: int, rate: float = 1.0, batch_size: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Weights and class biases, by rounds of distributed gradient steps over all rows of :func:`packed`.

    ``bias``: what the biases start from, the classes' log shares of all tokens.

    A feature row's changes are averaged by how much each task moved it: what only one task has seen is not thinned by the others.
    """
    spark = packs.sparkSession
    weights, bias = np.zeros((buckets, CLASSES), np.float32), bias.astype(np.float32)
    moved_by = np.full(buckets, 1e-3, np.float32)  # a feature's steps shrink with what it has moved already
    # As many tasks as the cluster runs at once, each over its own partitions: what they return does not grow with the input.
    tasks = max(tasks, spark.sparkContext.defaultParallelism)
    shared = spark.sparkContext.broadcast(classes)
    for turn in range(rounds):
        start = spark.sparkContext.broadcast((weights, bias, moved_by))

        def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            w, b, grown = (x.copy() for x in start.value)
            seen = 0
            known, ones = Words(shared.value), np.ones(CLASSES, np.float32)
            for batch in batches:
                for words, at in zip(batch["words"], batch["at"]):
                    own, at = unpacked(words, at)
                    number = known.number(own)
                    known.settle()
                    cls = known.cls[number][at]
                    found = stream_features(known.hash[number][at], cls, buckets)
                    seen += len(cls)
                    size = max(64, min(batch_size, len(cls) // 16))  # a task's first rows are small: more steps
                    for i in range(0, len(cls), size):
                        f, c = found[i : i + size], cls[i : i + size]
                        gradient = summed(w, b, f)
                        np.exp(gradient, out=gradient)
                        gradient /= (gradient @ ones)[:, None]
                        gradient[np.arange(len(c)), c] -= 1
                        b -= np.float32(rate / 10 / len(c)) * (np.ones(len(c), np.float32) @ gradient)
                        flat = f.ravel()
                        order = radix(flat)
                        flat = flat[order]
                        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
                        touched = flat[first]
                        step = np.add.reduceat(gradient.take(order // f.shape[1], axis=0), first)
                        more = grown[touched] + (step * step) @ ones / CLASSES
                        grown[touched] = more
                        step *= (rate / np.sqrt(CLASSES) / np.sqrt(more))[:, None]
                        w[touched] -= step
                    if known.full(TRAINED):
                        known = Words(shared.value)
            w -= start.value[0]
            # A change travels as its row's largest and a byte for each class, with what its steps have grown by.
            scale = np.maximum(np.abs(w).max(axis=1), 1e-30).astype(np.float32) / np.float32(127)
            out = []
            for i in range(0, buckets, BLOCK):
                here = slice(i, i + BLOCK)
                more = grown[here] - start.value[2][here]
                if more.any():
                    change = np.rint(w[here] / scale[here, None]).astype(np.int8)
                    out.append((i // BLOCK, more.tobytes(), scale[here].tobytes() + change.tobytes()))
            if seen:  # the biases, weighted by tokens
                out.append((-1, np.float32([seen]).tobytes(), (b - start.value[1]).tobytes()))
            yield pd.DataFrame(out, columns=["block", "grown", "change"])

        def average(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            total, change = 0.0, 0.0
            for g, c in zip(part["grown"], part["change"]):
                g = np.frombuffer(g, np.float32)
                if key[0] < 0:
                    c = np.frombuffer(c, np.float32)[None, :]
                else:
                    c = np.frombuffer(c[4 * len(g) :], np.int8).reshape(len(g), CLASSES) * np.frombuffer(c, np.float32, len(g))[:, None]
                total = total + g
                change = change + g[:, None] * c.astype(float)
            mean = change / np.maximum(total, 1e-30)[:, None]
            return pd.DataFrame({"block": [key[0]], "grown": [total.astype(np.float32).tobytes()], "change": [mean.astype(np.float32).tobytes()]})

        part = small_batches(packs.filter(F.col("round") == turn).coalesce(tasks), 16)
        moved = part.mapInPandas(steps, "block int, grown binary, change binary").groupBy("block").applyInPandas(average, "block int, grown binary, change binary")
        weights, bias, moved_by = weights.copy(), bias.copy(), moved_by.copy()
        for row in moved.collect():  # one row for each block
            change = np.frombuffer(row["change"], np.float32)
            if row["block"] < 0:
                bias += change
            else:
                here = slice(row["block"] * BLOCK, (row["block"] + 1) * BLOCK)
                weights[here] += change.reshape(-1, CLASSES)
                moved_by[here] += np.frombuffer(row["grown"], np.float32)
        start.destroy(blocking=True)  # its copies on disk, too: the round is over
    small_batches(packs)
    return weights, bias


def fit(training: DataFrame, text: str = "text", tasks: int = 6, rounds: int = 6, head: int = 1 << 16, max_buckets: int = 1 << 18) -> dict:
    """The model: classes, weights and counts, all from all texts.

    There are four feature rows for every word that stands ``OFTEN`` times or more in the texts, within ``BUCKETS`` and
    ``max_buckets``.  The driver holds the tables of classes and weights, ``head`` word counts and one
    row per class.  Counts of all words stay in a written table.
    """
    spark = training.sparkSession
    texts = small_batches(training).select(F.coalesce(F.col(text), F.lit("")).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, n = Words(), np.zeros(0, np.int64)

        def held() -> pd.DataFrame:
            return pd.DataFrame({"hash": words.hash, "word": list(words), "n": n})

        for batch in batches:
            for own, at in zip(batch["words"], batch["at"]):
                own, at = unpacked(own, at)
                number = words.number(own)
                words.settle()
                n = np.concatenate([n, np.zeros(len(words) - len(n), np.int64)])
                n[number] += np.bincount(at, minlength=len(number))
                if words.full(COUNTED):
                    yield held()
                    words, n = Words(), np.zeros(0, np.int64)
        yield held()

    packs = small_batches(packed(texts, rounds), 16)
    counts = materialize(packs.mapInPandas(count, "hash long, word binary, n long").groupBy("hash", "word").agg(F.sum("n").alias("n")), "lm-counts")
    often = counts.filter(F.col("n") >= OFTEN).count()
    buckets = min(max_buckets, max(BUCKETS, 1 << (4 * often - 1).bit_length())) if often else BUCKETS
    top = counts.filter(F.length("word") > 0).orderBy(F.col("n").desc(), "word").limit(FREQUENT).select("word").toPandas()
    classes = cluster(packs, [bytes(w) for w in top["word"]])
    shared = spark.sparkContext.broadcast(classes)

    def of_class(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = np.zeros((2, CLASSES), np.int64)
        for batch in batches:
            cls = Words(shared.value).classify([bytes(w) for w in batch["word"]])
            size[0] += np.bincount(cls, batch["n"].to_numpy(float), CLASSES).astype(np.int64)
            size[1] += np.bincount(cls, minlength=CLASSES)
        yield pd.DataFrame({"cls": np.arange(CLASSES), "n": size[0], "v": size[1]})

    small_batches(counts, 10_000)
    by_class = counts.select("word", "n").mapInPandas(of_class, "cls long, n long, v long").groupBy("cls").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toPandas()
    size, shares = np.ones(CLASSES), np.full(CLASSES, 0.5)
    size[by_class["cls"].to_numpy(np.int64)] += (by_class["n"] + by_class["v"]).to_numpy(float)
    shares[by_class["cls"].to_numpy(np.int64)] += by_class["n"].to_numpy(float)
    weights, bias = train(packs, classes, np.log(shares / shares.sum()), buckets, tasks, rounds)
    discard(packs)
    top = counts.orderBy(F.col("n").desc(), "hash").limit(head).select("hash", "n").toPandas().sort_values("hash")
    return {
        "classes": classes, "weights": weights, "bias": bias, "counts": counts.select("hash", "n"), "class_size": np.log10(size), "tokens": int(by_class["n"].sum()),
        "words": int(by_class["v"].sum()), "head": (top["hash"].to_numpy(np.int64), top["n"].to_numpy(np.int64)),
    }


def score(df: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(keep..., n_tokens, n_known, train_tokens, base_score, score) of each row."""
    shared = df.sparkSession.sparkContext.broadcast({k: v for k, v in model.items() if k != "counts"})

    @F.pandas_udf("n_tokens long, n_known long, counted double, classed double, hashes array<bigint>, times array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        hashes, n = m["head"]
        words = Words(m["classes"])
        of_word = np.zeros(0, np.int64)  # count of each numbered word, -1 for those outside the head
        for batch in batches:
            size = len(batch)
            total, known, counted, classed = np.zeros(size), np.zeros(size), np.zeros(size), np.zeros(size)
            rest: list[list[np.ndarray]] = [[] for _ in range(size)]
            times: list[list[np.ndarray]] = [[] for _ in range(size)]
            for number, row, again in streams(batch, words):
                words.settle()
                if len(of_word) < len(words.hash):
                    new = words.hash[len(of_word) :]
                    place = np.minimum(np.searchsorted(hashes, new), max(0, len(hashes) - 1))
                    found = np.where(hashes[place] == new, n[place], -1) if len(hashes) else np.full(len(new), -1)
                    of_word = np.concatenate([of_word, found])
                cls = words.cls[number]
                at = stream_features(words.hash[number], cls, len(m["weights"]))[again:]
                number, cls, row = number[again:], cls[again:], row[again:]
                chosen = np.empty(len(cls))
                for start in range(0, len(cls), 4096):
                    f, k = at[start : start + 4096], cls[start : start + 4096]
                    chosen[start : start + 4096] = log_softmax(summed(m["weights"], m["bias"], f))[np.arange(len(k)), k]
                c = of_word[number]
                inside = c >= 0
                total += np.bincount(row, minlength=size)
                known += np.bincount(row, inside, size)
                counted += np.bincount(row, np.where(inside, np.log10(np.maximum(c, 0) + 1.0), 0.0), size)
                classed += np.bincount(row, chosen / np.log(10) - m["class_size"][cls], size)
                # The other words of each text with their number, text by text.
                pairs, often = np.unique(row[~inside] * len(of_word) + number[~inside], return_counts=True)
                of, word = np.divmod(pairs, max(1, len(of_word)))
                first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
                for lo, hi in zip(first, np.r_[first[1:], len(of)]):
                    rest[of[lo]].append(words.hash[word[lo:hi]])
                    times[of[lo]].append(often[lo:hi])
            none = np.zeros(0, np.int64)
            yield pd.DataFrame({
                "n_tokens": total.astype(np.int64), "n_known": known.astype(np.int64), "counted": counted, "classed": classed,
                "hashes": [np.concatenate(r) if r else none for r in rest], "times": [np.concatenate(t) if t else none for t in times],
            })
            if words.full(SCORED):
                words, of_word = Words(m["classes"]), np.zeros(0, np.int64)

    told = small_batches(df).select(*keep, run(F.col(text)).alias("s")).select(*keep, "s.*").withColumn("_row", F.monotonically_increasing_id())
    told = materialize(told, "lm-texts")
    rest = told.select("_row", F.explode(F.arrays_zip("hashes", "times")).alias("r")).select("_row", F.col("r.hashes").alias("hash"), "r.times")
    counts = model["counts"].select("hash", "n")
    met = rest.join(counts, "hash").groupBy("_row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more"), F.sum("times").alias("known"))
    counted = F.col("counted") + F.coalesce("more", F.lit(0.0))
    size = float(np.log10(model["tokens"] + model["words"] + 1))
    return told.drop("hashes", "times").join(met, "_row", "left").select(
        *keep, "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("bigint").alias("n_known"), F.lit(model["tokens"]).cast("bigint").alias("train_tokens"),
        (counted - F.col("n_tokens") * size).alias("base_score"), (counted + F.col("classed")).alias("score"),
    )

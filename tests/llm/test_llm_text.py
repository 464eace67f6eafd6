"""Language, toxicity, near-duplicates, language model, tokens: edge cases and brute force."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaline.llm import bpe, common, langid, maxent, minhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, extra int, n int"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def words(seed, n, letters):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))


# --- components ------------------------------------------------------------------------------


def test_components_of_chain_star_and_none(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 30)] + [(50, 50)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 1 for i in range(1, 30)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- language --------------------------------------------------------------------------------


def test_language(spark):
    train = [(i, words(i, 60, "abcde" if i % 2 else "vwxyz"), "aa" if i % 2 else "zz") for i in range(60)]
    filters = langid.fit(frame(spark, train + [(99, None, "aa"), (98, "abc", None)], "doc_id long, text string, lang string"))
    assert filters.languages == ["aa", "zz"]
    asked = [(1, words(500, 30, "abcde"), 7), (2, words(501, 30, "vwxyz"), 7), (3, None, 7), (4, "", 7), (5, "12 !? 34", 7), (6, "żółć", 7), (1, words(500, 30, "abcde"), 7),
             (7, words(502, 400_000, "vwxyz"), 7)]
    got = langid.predict(frame(spark, asked, "doc_id long, text string, lang_score int"), filters)
    assert got.columns == ["doc_id", "text", "lang_score", "lang_pred", "lang_coverage"]
    rows = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in got.collect()}
    assert {k: v[0] for k, v in rows.items()} == {1: "aa", 2: "zz", 3: "und", 4: "und", 5: "und", 6: "aa", 7: "zz"}
    assert rows[3][1] == 0 and rows[6][1] == 0 and 0 <= min(v[1] for v in rows.values()) and max(v[1] for v in rows.values()) <= 1
    empty = langid.fit(frame(spark, [], "doc_id long, text string, lang string"))
    assert langid.predict(frame(spark, [(1, "abc")]), empty).first()["lang_pred"] == "und"
    assert langid.predict(frame(spark, []), filters).count() == 0


def test_slices_of_long_texts_count_every_ngram_once():
    text = words(3, 3000, "abcdé")
    letters = langid.letter_table()
    whole = np.sort(np.concatenate(list(langid.grams(text, letters))))
    size, langid.SLICE = langid.SLICE, 1000
    try:
        parts = np.sort(np.concatenate(list(langid.grams(text, letters))))
    finally:
        langid.SLICE = size
    assert (whole == parts).all()


def test_false_positive_correction():
    filters = langid.Filters(["a", "b"], np.zeros((1, 1 << langid.SLOT_BITS), np.uint64), np.array([0.5, 0.0]), 0)
    total, counts = filters.counts("abcdef", langid.letter_table())
    assert total and (counts == np.array([-total, 0])).all()


# --- toxicity --------------------------------------------------------------------------------


def labelled():
    rows = []
    for i in range(240):
        base = words(i, 40, "abcdefgh").split()
        if i % 4 == 0:
            base.insert(i % 30, "vile")
            base.insert(i % 20, "nasty")
        rows.append((i, " ".join(base), int(i % 4 == 0)))
    return rows


@pytest.fixture(scope="module")
def toxic_state(spark):
    rows = labelled()
    docs = frame(spark, [(i, t, 1) for i, t, _ in rows], "doc_id long, text string, toxic_score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    return toxicity.fit(docs, labels)


def test_toxicity(spark, toxic_state):
    assert {"vile", "nasty"} <= set(toxic_state["number"])
    asked = [(1, "such a vile nasty thing"), (2, "abc def"), (3, None), (4, ""), (1, "such a vile nasty thing"), (5, "x" * 3_000_000 + " vile nasty")]
    got = {r["doc_id"]: r for r in toxicity.score(frame(spark, asked), toxic_state).collect()}
    assert got[1]["toxic_score"] >= 0.7 and got[5]["toxic_score"] >= 0.7 and got[1]["toxic_evidence"][0]["label"] == 1
    assert max(got[i]["toxic_score"] for i in (2, 3, 4)) < 0.1 and got[3]["toxic_evidence"] == []
    none = toxicity.fit(frame(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(frame(spark, [(1, "vile")]), none).first()["toxic_score"] == 0


def test_block_max_search_equals_a_full_scan():
    r = np.random.default_rng(1)
    vectors = []
    for _ in range(700):
        terms = np.sort(r.choice(50, r.integers(1, 6), replace=False))
        w = r.random(len(terms)) + 0.1
        vectors.append((terms, w / np.linalg.norm(w)))
    index = toxicity.Index(vectors, 50)
    dense = np.zeros((700, 50))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for i in range(0, 700, 35):
        score = np.round(dense @ dense[i], 12)
        want = sorted((-s, j) for j, s in enumerate(score) if s > 0 and j != i)[:10]
        assert [j for _, j in index.search(*vectors[i], 10, skip=i)] == [j for _, j in want]


def test_monotone_fit():
    x, y = toxicity.monotone(np.array([0.0, 0.2, 0.4, 0.9]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert np.interp([0, 0.2, 0.4, 0.9], x, y).tolist() == [0, 0.5, 0.5, 1]


# --- near-duplicates -------------------------------------------------------------------------


def test_minhash_classes_against_brute_force(spark):
    r = random.Random(5)
    rows, n = [], 0
    for g in range(30):
        base = words(g, 120, "abcdefghij").split()
        for copy in range(6):
            w = list(base)
            for _ in range(copy):
                w[r.randrange(len(w))] = words(r.random(), 1, "klmnop")
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n + i, words(1000 + i, 100, "abcdefghij")) for i in range(20)]
    got = {x["doc_id"]: x["class_id"] for x in minhash.classes(frame(spark, rows)).collect()}
    shingles = {}
    for i, t in rows:
        w = t.split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    clear = missed = 0
    for i, _ in rows:
        for j, _ in rows[:i]:
            s = len(shingles[i] & shingles[j]) / len(shingles[i] | shingles[j])
            if s >= 0.83:
                clear += 1
                missed += got[i] != got[j]
            elif not s:
                assert got[i] != got[j]
    assert clear > 50 and missed == 0


def test_minhash_defined_results(spark):
    long = words(7, 60_000, "abcdef")
    rows = [(5, "One two three four five six"), (3, "one, TWO three four five six!"), (8, None), (9, ""), (10, " \n"), (11, "?!"), (12, "?!"), (13, "a b"), (14, "a b"), (None, "a b"),
            (20, long), (21, long + " x"), (30, "same text of these words here"), (30, "same text of these words here")]
    found = minhash.classes(frame(spark, [(i, t, 1) for i, t in rows], "doc_id long, text string, class_id int")).collect()
    got = collections.defaultdict(list)
    for x in found:
        got[x["doc_id"]].append((x["class_id"], x["kept"]))
    assert got[5] == [(3, False)] and got[3] == [(3, True)] and got[8] == [(8, True)] and got[9] == [(9, True)] and got[10] == [(10, True)]
    assert got[12] == [(11, False)] and got[14] == [(13, False)] and got[None] == [(13, False)] and got[21] == [(20, False)]
    assert sorted(got[30]) == [(30, False), (30, True)]
    assert minhash.classes(frame(spark, [])).count() == 0


def test_bucket_join_equals_all_pairs():
    r = np.random.default_rng(2)
    for size in (2, 7, 60):
        sets = [np.sort(r.choice(60, 40, replace=False)).astype(np.uint32) for _ in range(size)]
        sets += [s.copy() for s in sets[: size // 2]]
        levels = [r.integers(0, 3, len(s)).astype(np.uint8) for s in sets]
        levels[size:] = levels[: len(sets) - size]
        w = np.zeros((len(sets), 60))
        for i, s in enumerate(sets):
            w[i, s] = np.exp(levels[i] / minhash.GRID)
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                if np.minimum(w[i], w[j]).sum() / np.maximum(w[i], w[j]).sum() >= 0.55:
                    a, b = label[i], label[j]
                    label = [b if x == a else x for x in label]
        names = [bytes([i]) for i in range(len(sets))]
        root = dict(minhash.join_bucket(names, sets, levels, 0.55))
        got = [root.get(x, x) for x in names]
        assert all((got[i] == got[j]) == (label[i] == label[j]) for i in range(len(sets)) for j in range(i))


def test_sample_agreement_estimates_weighted_similarity():
    sampler, r, agree = minhash.Sampler(), np.random.default_rng(3), 0
    shared = r.integers(0, 1 << 63, 800).astype(np.uint64)
    one, two = (np.sort(np.r_[shared, r.integers(0, 1 << 63, 200).astype(np.uint64)]) for _ in range(2))
    level = np.full(1000, 3, np.uint8)
    for turn in range(60):
        mix = np.uint64(2 * turn + 1)
        agree += (sampler.bands(np.sort(one * mix), level) == sampler.bands(np.sort(two * mix), level)).sum()
    assert abs(agree / (60 * minhash.BANDS) - (800 / 1200) ** minhash.ROWS) < 0.05


# --- language model --------------------------------------------------------------------------


def test_maxent_base_is_exact_and_the_model_beats_it(spark):
    rows = [(i, words(i % 40, 50, "abc" if i % 2 else "xyz") if i % 9 else None) for i in range(200)] + [(500, ""), (501, "A b\tC\x0bd"), (None, "abc xyz"), (1, words(1, 50, "abc"))]
    training = [(i, t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = lambda t: (t or "").encode().lower().split() + [b""]
    c = collections.Counter(w for _, t in training for w in tokens(t))
    n, v = sum(c.values()), len(c)
    model = maxent.fit(frame(spark, training), head=20)
    got = maxent.score(frame(spark, [(i, t, 3) for i, t in rows], "doc_id long, text string, score int"), model).collect()
    assert len(got) == len(rows)
    want = {i: (sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), len(tokens(t)), sum(c[w] > 0 for w in tokens(t))) for i, t in rows}
    for x in got:
        base, size, known = want[x["doc_id"]]
        assert abs(x["base_score"] - base) < 1e-9 and (x["n_tokens"], x["n_known"], x["train_tokens"]) == (size, known, n)
    assert sum(x["score"] for x in got) > sum(x["base_score"] for x in got)


def test_maxent_learns_contexts_of_every_text(spark):
    # One text in a fifth of the rows, whose hash is among the largest: a draw by hash would miss all of them.
    text = F.concat(F.lit("zebra quagga zebra quagga zebra quagga n"), F.col("id"))
    told = spark.range(200).select(text.alias("t")).filter("pmod(xxhash64(t), 1000000) > 900000").first()["t"]
    rows = [(i, words(i, 12, "abc" if i % 2 else "xyz")) for i in range(4_000)] + [(9_000 + i, told) for i in range(1_000)]
    model = maxent.fit(frame(spark, rows))
    x = maxent.score(frame(spark, [(1, told)]), model).first()
    assert (x["score"] - x["base_score"]) / x["n_tokens"] > 0.5


def test_maxent_streams_have_the_features_of_their_texts():
    end = maxent.CLASSES - 1
    hashes, cls = np.arange(1, 7) * 2**40, np.array([3, 4, end, 5, 6, end])
    alone = [maxent.stream_features(hashes[i : i + 3], cls[i : i + 3], 1 << 16) for i in (0, 3)]
    assert (maxent.stream_features(hashes, cls, 1 << 16) == np.concatenate(alone)).all()
    one, none = np.array([7], np.uint64), np.array([maxent.CLASSES], np.uint64)
    first = maxent.hashed(0 * one, 0 * one, none, none, none, 1 << 16)
    second = maxent.hashed(hashes[:1].view(np.uint64), 0 * one, cls[:1].astype(np.uint64), none, none, 1 << 16)
    assert (alone[0][0] == first).all() and (alone[0][1] == second).all()


def test_maxent_scores_do_not_depend_on_stretches(spark, monkeypatch):
    rows = [(i, words(i, 40 + 10 * (i % 4), "abc")) for i in range(30)] + [(99, words(7, 5_000, "abcde")), (98, None)]
    model = maxent.fit(frame(spark, rows), head=10)
    want = sorted(map(tuple, maxent.score(frame(spark, rows), model).collect()), key=str)
    monkeypatch.setattr(maxent, "STRETCH", 70)
    monkeypatch.setattr(maxent, "PIECE", 300)
    got = sorted(map(tuple, maxent.score(frame(spark, rows), model).collect()), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    np.testing.assert_allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-6)
    assert maxent.score(frame(spark, []), model).count() == 0


def test_maxent_without_training(spark):
    model = maxent.fit(frame(spark, []))
    x = maxent.score(frame(spark, [(1, "a b")]), model).first()
    assert (x["n_tokens"], x["n_known"], x["train_tokens"], x["base_score"]) == (3, 0, 0, 0.0)


def test_class_probabilities_sum_to_one():
    p = np.exp(maxent.log_softmax(np.random.default_rng(0).normal(size=(5, maxent.CLASSES))))
    assert np.allclose(p.sum(axis=1), 1)


# --- tokens ----------------------------------------------------------------------------------


def test_bpe_round_trip_and_equality(spark):
    public = pytest.importorskip("public_tokenizers")
    import tiktoken

    ranks = public.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
    texts = ["", None, "Hello  world's 123\n\n x", "é" * 60_000 + " 1", "ab " * 40_000, " " * 70_000 + "a", "<|endoftext|>", "!?" * 60_000, "a　b\x1c c " * 20_000]
    df = frame(spark, [(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    for row in bpe.decode(bpe.encode(df, ranks, public.PATTERN), ranks).withColumn("n", bpe.count()).collect():
        text = texts[row["doc_id"]] or ""
        want = library.encode_ordinary(text)
        assert np.frombuffer(row["ids"], "<u4").tolist() == want and row["n"] == len(want) and bytes(row["decoded"]) == text.encode()
    assert bpe.encode(frame(spark, []), ranks, public.PATTERN).count() == 0


def test_minhash_of_many_rows_without_id(spark):
    """Near copies that share one null id: the second reading brings each text once, not all to each."""
    base = " ".join(f"word{i}" for i in range(120))
    rows = [(None, f"{base} end{i}") for i in range(5000)] + [(7, "a text by itself that nobody else has")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    read = spark.sparkContext.accumulator(0)
    plain = minhash.Shingler.fingerprint

    def counted(self, value, words):
        read.add(1)
        return plain(self, value, words)

    minhash.Shingler.fingerprint = counted
    try:
        got = [tuple(r) for r in minhash.classes(docs).collect()]
    finally:
        minhash.Shingler.fingerprint = plain
    assert sum(k for _, _, k in got) == 2 and {c for _, c, _ in got} == {None, 7}
    assert read.value <= 3 * len(rows)


def test_repeated_rows_do_not_grow_the_samples(spark, monkeypatch):
    texts = [(i, words(i, 30, "abcd" if i % 2 else "wxyz") + (" vile" if i % 4 == 0 else "")) for i in range(80)]
    docs = frame(spark, texts + [(8, f"{t} again{i}") for i, (_, t) in enumerate(texts * 20)])
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 9) for i in range(80)], "doc_id long, toxic int, quality int")
    kept = []
    plain = toxicity.materialize
    monkeypatch.setattr(toxicity, "materialize", lambda df, label: kept.append((label, plain(df, label))) or kept[-1][1])
    state = toxicity.fit(docs, labels)
    assert dict(kept)["toxicity-sample"].count() == 80
    got = toxicity.score(docs.limit(5).withColumn("toxic_found", F.lit("mine")), state)
    assert {r["toxic_found"] for r in got.collect()} == {"mine"} and "toxic_score" in got.columns

    copies = frame(spark, [("same text again", "aa")] * 3000 + [(t, "bb") for _, t in texts], "text string, lang string")
    filters = langid.fit(copies)
    out = langid.predict(frame(spark, [(1, "same text", "mine")], "id long, text string, lang_found string"), filters).first()
    assert (out["lang_pred"], out["lang_found"]) == ("aa", "mine")

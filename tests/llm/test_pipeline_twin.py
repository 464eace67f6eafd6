"""The pipeline's later stages against plain versions of what they promise, on all given documents."""

import collections
import re

import pytest

from glossaline.llm import bpe

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = re.findall(r"\w+", text.lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def targets(sizes):
    """Shares by weight, none above three times its source, as the rule is worded."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        rest, free = sum(sizes.values()) - sum(fixed.values()), [s for s in names if s not in fixed]
        goal = fixed | {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if goal[s] > 3 * sizes[s]]
        if not over:
            return goal
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_stages_against_plain_versions(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, tables = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    tables["documents"] = docs.collect()
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialize(stage(spark, docs, FOLDER), name)
        tables[name] = docs.collect()

    # Near-duplicates: what stays has no near copy among what stays, what goes has one among what came.
    before, kept = tables["toxicity"], tables["near_duplicates"]
    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    ids = [r["doc_id"] for r in kept]
    assert max(like(a, b) for i, a in enumerate(ids) for b in ids[:i]) < 0.9
    for gone in {r["doc_id"] for r in before} - set(ids):
        assert max(like(gone, r["doc_id"]) for r in before if r["doc_id"] != gone) >= 0.7

    # The mix: runs of words of the documents, none more than three times, each source's total its target to the word.
    words = {r["doc_id"]: WORD.findall(r["text"]) for r in kept}
    sizes, taken, per_doc = collections.Counter(), collections.Counter(), collections.Counter()
    for r in kept:
        sizes[r["source"]] += len(words[r["doc_id"]])
    for r in tables["mix"]:
        run, whole = WORD.findall(r["text"]), words[r["doc_id"]]
        assert run and any(whole[i : i + len(run)] == run for i in range(len(whole) - len(run) + 1)) and r["n_chars"] == len(r["text"])
        taken[r["source"]] += len(run)
        per_doc[r["doc_id"]] += len(run)
    goal = targets(sizes)
    assert all(abs(taken[s] - goal[s]) <= 0.5 for s in sizes)
    assert all(n <= 3 * len(words[i]) for i, n in per_doc.items())

    # Tokens: those of the library.
    public = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    library = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=bpe.read_ranks(public.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert len(tables["tokens"]) == len(tables["mix"])
    for r in tables["tokens"]:
        ids = library.encode_ordinary(r["text"])
        assert (r["n_tokens"], r["exact"], bytes(r["ids"])) == (len(ids), True, b"".join(i.to_bytes(4, "little") for i in ids))

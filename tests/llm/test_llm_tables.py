"""Vectors, mixing, preference pairs, pages, pipeline: edge cases and brute force."""

import math

import numpy as np
import pytest
from compare import difference, duck
from pyspark.sql import functions as F

from glossaline.llm import hnsw, html_templates, mixing, pivots, preference, queries, vectors

FOLDER = "/root/testdata/sf0.001"


def embeddings(spark, x, first=0):
    odd = [(9001, None), (9002, [0.0] * 4), (9003, [1.0, None, 0.0, 0.0]), (9004, [float("nan")] * 4), (9005, [float("inf"), 0.0, 0.0, 0.0]), (9006, [1.0, 2.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    rows = [(first + i, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, score int")


def cloud(n, dim, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    x[n // 2 : n // 2 + n // 6] = x[0]  # a large group of equal vectors
    x[: n // 8] = x[1] + 0.05 * r.normal(size=(n // 8, dim))  # and of near ones
    return x.astype(np.float32).astype(float)


def test_pivot_links_equal_brute_force(spark):
    x = cloud(400, 4, 1)
    got = {r["vec_id"]: r for r in pivots.near_duplicates(embeddings(spark, x)).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(400)
    for _ in range(400):
        new = np.minimum(label, np.where(near, label[None, :], 400).min(axis=1, initial=400))
        if (new == label).all():
            break
        label = new
    assert [got[i]["n_links"] for i in range(400)] == near.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(400)] == label.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(9001, 9007))
    assert pivots.near_duplicates(embeddings(spark, x).limit(0)).count() == 0


def test_pivot_blocks_agree_with_one_block(spark, monkeypatch):
    x = cloud(150, 16, 4)
    one = sorted(map(tuple, pivots.near_duplicates(embeddings(spark, x)).filter("vec_id is not null").collect()))
    monkeypatch.setattr(pivots, "BLOCK", 20)
    assert sorted(map(tuple, pivots.near_duplicates(embeddings(spark, x)).filter("vec_id is not null").collect())) == one


def test_pivot_links_where_few_vectors_stand_apart(spark):
    r = np.random.default_rng(6)
    pair = np.array([[1.0, 0.0, 0.0, 0.0], [0.95, math.sqrt(1 - 0.95**2), 0.0, 0.0]])
    family = np.ones(8) + 0.05 * r.normal(size=(50, 8))
    cone = np.ones(8) + 0.3 * r.normal(size=(80, 8))
    for x in (pair, family, cone):
        rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
        got = {i.vec_id: i for i in pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
        assert want.any() and [got[i]["n_links"] for i in range(len(x))] == want.tolist()
        if x is not cone:
            assert {i["component_id"] for i in got.values()} == {0} and sum(i["kept"] for i in got.values()) == 1


def test_hnsw_recall_and_ties(spark):
    x = cloud(600, 4, 2)
    df = embeddings(spark, x)
    asked = vectors.valid(df.filter(F.col("vec_id") % 20 == 0)).select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in hnsw.search(hnsw.index(df, shard_size=200), asked, block=10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 600, 20))
    found = 0
    for q, rows in got.items():
        score = x @ x[q]
        want = sorted((-score[i], i) for i in range(600) if i != q)[:20]
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, 21)) and rows == sorted(rows, key=lambda t: (-t[2], t[1])) and q not in [i for _, i, _ in rows]
        assert all(math.isclose(s, score[i], rel_tol=1e-12, abs_tol=1e-12) for _, i, s in rows)
        found += len({i for _, i in want} & {i for _, i, _ in rows})
    assert found >= 0.9 * 20 * len(got)


def test_hnsw_few_and_none(spark):
    df = embeddings(spark, np.eye(4)[:3])
    asked = vectors.valid(df).select(F.col("vec_id").alias("query_id"), "embedding")
    assert hnsw.search(hnsw.index(df), asked).count() == 6
    none = df.limit(0)
    assert hnsw.search(hnsw.index(none), vectors.valid(none).select(F.col("vec_id").alias("query_id"), "embedding")).count() == 0


def test_hypergeometric_frequencies(spark):
    rows = spark.range(6000).select(mixing.hypergeometric("3", "4", "2", "id").alias("k")).groupBy("k").count().collect()
    share = {r["k"]: r["count"] / 6000 for r in rows}
    assert all(abs(share[k] - p) < 0.03 for k, p in ((0.0, 2 / 7), (1.0, 4 / 7), (2.0, 1 / 7)))


def test_tree_deals_every_block_once(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 300), (2, 0), (3, 57)], "sid int, quota long")
    rows = mixing.split_tree(quotas, 7, 3).collect()
    for sid, quota in ((0, 1000), (1, 300), (2, 0), (3, 57)):
        at = 0
        for r in sorted((r for r in rows if r["sid"] == sid), key=lambda r: r["shard"]):
            assert r["start"] == at
            at += r["blocks"]
        assert at == quota
    sizes = [sum(r["blocks"] for r in rows if r["shard"] == s) for s in range(7)]
    assert sum(sizes) == 1357 and max(sizes) - min(sizes) <= 3


def test_mix_targets_limits_and_pieces(spark):
    texts = [(i, "w " * (5 + i % 90), "b" if i % 3 else ("a" if i % 2 else None), 7) for i in range(300)] + [(900, None, "b", 7), (901, " ", "c", 7), (5, "w " * 10, "b", 7), (5, "w " * 10, "b", 7)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string, target int")
    rows = mixing.sized(df)
    mixed = mixing.mix(rows, mixing.targets(rows), shards=4, block_words=8)
    got = mixed.withColumn("taken", mixing.taken()).collect()
    assert len(got) == len(texts)
    per = {}
    for r in got:
        s = per.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["size"]
        s[1] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and all(p["words"] > 0 and p["first"] + p["words"] <= r["size"] for p in r["pieces"])
    total = sum(s[0] for s in per.values())
    weight = {"a": 5, "b": 2, "c": 1, None: 5}
    target = dict.fromkeys(weight, 0.0)
    fixed = {}
    while True:  # the rule as it is worded
        rest = total - sum(fixed.values())
        free = [s for s in weight if s not in fixed]
        target = fixed | {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if target[s] > 3 * per[s][0]]
        if not over:
            break
        fixed |= {s: 3.0 * per[s][0] for s in over}
    for s, (size, taken, goal, source_size) in per.items():
        assert source_size == size and math.isclose(goal, target[s], rel_tol=1e-9, abs_tol=1e-9) and abs(taken - goal) <= 0.5
    again = mixing.mix(rows, mixing.targets(rows), shards=4, block_words=8).withColumn("taken", mixing.taken())
    assert sorted((str(r["doc_id"]), r["taken"]) for r in again.collect()) == sorted((str(r["doc_id"]), r["taken"]) for r in got)
    # Sources smaller than a block, and a target between two blocks, are met to the word.
    few = mixing.sized(spark.createDataFrame([(1, "w " * 10, "a"), (2, "w " * 500, "b"), (3, "w w", "c")], "doc_id long, text string, source string"))
    assert {r["source"]: r["taken"] for r in mixing.mix(few, mixing.targets(few)).withColumn("taken", mixing.taken()).collect()} == {"a": 30, "b": 476, "c": 6}
    none = mixing.sized(df.limit(0))
    assert mixing.mix(none, mixing.targets(none)).count() == 0


def test_cut_keeps_white_space_inside(spark):
    df = spark.createDataFrame([("a\n b  c d", 4)], "t string, n long")
    cut = lambda f, w: mixing.cut(F.col("t"), F.lit(f), F.lit(w), F.col("n"))
    assert tuple(df.select(cut(0, 4), cut(0, 2), cut(1, 2), cut(3, 1)).first()) == ("a\n b  c d", "a\n b", "b  c", "d")


def test_preference_pairs(spark):
    schema = "pair_id long, turn int, role string, text string, prompt string"
    chosen = spark.createDataFrame([(1, 0, "user", "hi", "x"), (1, 1, "assistant", "good", "x"), (2, 0, "user", None, "x"), (3, 0, "user", "same", "x"), (4, 0, "system", "s", "x"), (None, 0, None, "n", "x")], schema)
    rejected = spark.createDataFrame([(1, 0, "user", "hi", "x"), (1, 1, "assistant", "bad", "x"), (1, 2, "user", "why", "x"), (2, 0, "user", "", "x"), (3, 0, "user", "same", "x"), (3, 1, "assistant", "more", "x")], schema)
    got = {r["pair_id"]: r for r in preference.pairs(chosen, rejected).collect()}
    r = got[1]
    assert r["prompt_turns"] == 1 and r["prompt"] == "<|user|>\nhi<|end|>\n"
    assert [r["chosen"][s["start"] : s["end"]] for s in r["chosen_spans"]] == ["good<|end|>\n"]
    assert [r["rejected"][s["start"] : s["end"]] for s in r["rejected_spans"]] == ["bad<|end|>\n"] and r["rejected"].endswith("<|user|>\nwhy<|end|>\n")
    assert (got[2]["prompt_turns"], got[2]["chosen"], got[2]["rejected"]) == (1, "", "")
    assert (got[3]["prompt_turns"], got[3]["chosen"], got[3]["chosen_spans"]) == (1, "", []) and len(got[3]["rejected_spans"]) == 1
    assert (got[4]["prompt_turns"], got[4]["rejected"]) == (0, "") and None in got
    assert preference.pairs(chosen.limit(0), rejected.limit(0)).count() == 0


def test_preference_query_equals_sql(spark):
    assert difference(spark, duck(FOLDER), queries.QUERIES["op7_preference_pairs"], queries.ORACLES["op7_preference_pairs"], FOLDER) is None


PAGE = (
    "<html><head><title>T</title><style>p{{}}</style></head><body><nav>menu</nav><div class='cookie-notice'>cookies</div>{before}<h1>Head {i}</h1><p>Text &amp; <b>bold</b> {i}<br>line</p>"
    "<ul><li>one {i}<li>two</ul>{after}<form>Name <input></form><section id='comments'><p>first!</p></section><footer>f</footer><script>var t='</p>';</script></body></html>"
)


def test_pages(spark):
    box = "<div><p>Join our club</p></div>"
    rows = [(i, f"http://x.org/{i}", PAGE.format(i=i, before=box, after=""), 1) for i in range(8)]
    rows += [(100 + i, "http://y.org/a", PAGE.format(i=i, before="", after=f"<div><p>own {i}</p></div>"), 1) for i in range(2)]
    rows += [(200, None, None, 1), (201, "http://x.org", "", 1), (202, "u", "<p>a&nbsp;b<p>c<table><tr><td>d<td>e</table>", 1), (203, "u", "<b>" * 500 + "deep", 1)]
    rows += [(300, "u", "<body><aside>s</aside><article><header><h1>H</h1></header><p>p</p><footer>f</footer></article><p>outside</p></body>", 1)]
    got = {r["page_id"]: r["blocks"] for r in html_templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string, blocks int")).collect()}
    assert got[3] == ["Head 3", "Text & bold 3 line", "one 3", "two"]
    assert got[101] == ["Head 1", "Text & bold 1 line", "one 1", "two", "own 1"]
    assert got[200] == got[201] == [] and got[202] == ["a b", "c", "d", "e"] and got[203] == ["deep"] and got[300] == ["H", "p"]


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, "http://x.org/", PAGE.format(i=1, before="", after="<div><p>end</p></div>")) for i in range(9)]
    got = html_templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {tuple(r["blocks"]) for r in got} == {("Head 1", "Text & bold 1 line", "one 1", "two", "end")}


def test_template_of_articles_with_header_and_body(spark):
    page = "<body><article><header><h1>{title}</h1></header><div class='body'><p>{start} own words {i}</p></div><div><p>Join our club</p></div></article></body>"
    plain = "<body><article><h1>News</h1><p>{start} own words {i}</p><div><p>Join our club</p></div></article></body>"
    rows = [(i, "http://a.org/", page.format(title=f"Title {i}", start="", i=i)) for i in range(8)]
    rows += [(10 + i, "http://b.org/", plain.format(start="alike " * 400, i=i)) for i in range(8)]
    got = {r["page_id"]: r["blocks"] for r in html_templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(8)] == [[f"Title {i}", f"own words {i}"] for i in range(8)]
    assert [got[10 + i][1:] for i in range(8)] == [["alike " * 400 + f"own words {i}"] for i in range(8)]


def test_passages_that_few_articles_share_stay(spark):
    parts = ["<ul><li>one<li>two</ul>", "<table><tr><td>cell</table>", "<div>passage</div>", "<section><h2>licence</h2><p>terms</p></section>"]
    box = "<div class='x'><p>Join our club</p></div>"
    rows, want = [], {}
    for i in range(48):
        own = f"own words {i} of this article and no other, so many that they are most of it"
        shared = "".join(parts) if i < 6 else ""
        rows.append((i, "http://a.org/", f"<body><article><h1>T{i}</h1><p>{own}</p>{shared}{box}</article></body>"))
        want[i] = [f"T{i}", own, *(["one", "two", "cell", "passage", "licence", "terms"] if i < 6 else [])]
        # Without a marked article, around the deepest large element.
        rows.append((100 + i, "http://b.org/", f"<body><div><p>{own}</p>{''.join(parts[:3]) if i < 6 else ''}</div><div class='x'><p>Join our club</p></div></body>"))
        want[100 + i] = [own, *(["one", "two", "cell", "passage"] if i < 6 else [])]
    got = {r["page_id"]: r["blocks"] for r in html_templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_pipeline_rows_without_own_ids(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    found = [(None, text), (None, text), (None, text + " end"), (7, text), (8, other), (9, other + " end"), (9, "one more text that is alone in this table"), (None, "a last text without an id"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in found], schema)
    kept = pipeline.near_duplicates(spark, docs, FOLDER).select("doc_id", "text").collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [found[3], found[4], found[6], found[7], found[8]]))

    words = [(None, "w " * 100, "a")] * 10 + [(i, f"v{i} " * 100, "b") for i in range(20)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in words], schema)
    taken = {r["source"]: r["n"] for r in pipeline.mixed(spark, docs, FOLDER).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    assert abs(taken["a"] - 3000 * 5 / 7) <= 32 and abs(taken["b"] - 3000 * 2 / 7) <= 32


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialize(stage(spark, docs, FOLDER), name)
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(ids) <= seen and ids
        if name != "tokens":
            assert docs.columns == pipeline.COLUMNS
        if name in ("language", "toxicity", "near_duplicates"):
            assert len(ids) == len(set(ids))
        seen = set(ids)
    assert docs.filter("not exact or n_tokens = 0").count() == 0
    one = pipeline.run(spark, FOLDER)
    assert sorted(map(repr, one.select("doc_id", "n_tokens").collect())) == sorted(map(repr, docs.select("doc_id", "n_tokens").collect()))

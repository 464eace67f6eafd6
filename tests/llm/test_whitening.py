"""Whitening against numpy's own eigenvectors, and slicing on clusters and singular matrices."""

import numpy as np
import pytest

from glossaline.llm import queries, whitening

FOLDER = "/root/testdata/sf0.001"


def brute(rows, components=16):
    """Rows of (vec_id, component) -> (n, deviation, |whitened|, explained) by exact sums and a dense solver."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = {k: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for k, (_, v) in enumerate(kept)}
    fitted = np.array(sorted({tuple(v) for v in x.values()}), dtype=object)
    n, total = len(fitted), fitted.sum(axis=0)
    z = ((n * fitted - total) / n).astype(float)
    cov = z.T @ z / n
    values, vectors = np.linalg.eigh(cov)
    out = []
    for k, (i, _) in enumerate(kept):
        off = [n * c - t for c, t in zip(x[k], total)]
        for c in range(min(components, len(values))):
            e = values[-1 - c]
            w = np.array([o / n for o in off]) @ vectors[:, -1 - c] / np.sqrt(e)
            out.append((i, c + 1, n, sum(o * o for o in off), abs(w), e / np.trace(cov)))
    return out


def compared(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[3])
    got = sorted([(r["vec_id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got], key=key)
    want = sorted(want, key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    np.testing.assert_allclose([g[4] for g in got], [w[4] for w in want], rtol=1e-7, atol=1e-7)
    np.testing.assert_allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def run(spark, rows, tmp_path, name):
    spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, component int, whitened string").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    got = queries.QUERIES["op12_whitening"](spark, f"{tmp_path}/{name}").collect()
    assert all(r["identity_error"] < 1e-8 for r in got)
    return got


@pytest.mark.parametrize("dim", [5, 24])
def test_whitening_equals_brute_force(spark, tmp_path, dim):
    r = np.random.default_rng(dim)
    x = (r.normal(size=(300, dim)) * np.linspace(0.2, 2.0, dim)).astype(np.float32)
    x[200:] = x[0]  # a third of all rows is one vector
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(900, None), (901, [float("nan")] * dim), (902, [None] + [1.0] * (dim - 1)), (903, [float("inf")] * dim), (904, [0.0] * dim), (None, [0.5] * dim), (5, [0.25] * dim)]
    compared(run(spark, rows, tmp_path, "a"), brute([(i, v if v is None else [None if c is None else float(c) for c in v]) for i, v in rows]))


def test_whitening_of_given_vectors(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    compared(queries.QUERIES["op12_whitening"](spark, FOLDER).collect(), brute(rows))


def test_whitening_without_variance(spark, tmp_path):
    assert run(spark, [], tmp_path, "none") == []
    assert run(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])], tmp_path, "one") == []
    assert run(spark, [(1, []), (2, None)], tmp_path, "no-entries") == []
    flat = run(spark, [(k, [float(k), 2.0 * k, 1.0]) for k in range(9)] + [(77, [1.0])], tmp_path, "flat")
    assert {r["component"] for r in flat} == {1} and len(flat) == 9 and all(abs(r["explained"] - 1) < 1e-9 for r in flat)
    far = run(spark, [(1, [2.0**45, 0.0]), (2, [0.0, 2.0**45]), (3, [-(2.0**45), 1.0]), (4, [2.0**47, 0.0])], tmp_path, "far")
    assert {r["vec_id"] for r in far} == {1, 2, 3} and all(r["deviation"] is None for r in far)


def test_slices_number_every_eigenvalue():
    r = np.random.default_rng(1)
    for values in (np.arange(1.0, 41.0), np.r_[np.ones(6), 2.0, 2.0, 2.0 + 1e-13, 5.0], np.r_[np.zeros(5), 1e-3, 1.0, 1e3], np.r_[np.ones(3), np.ones(3) * (1 + 1e-9), 7.0], np.array([4.0])):
        q, _ = np.linalg.qr(r.normal(size=(len(values), len(values))))
        a = (q * values) @ q.T
        a = (a + a.T) / 2
        for shift in (-1.0, 0.5, 1.5, 2.5, 100.0):
            assert whitening.below(a, shift) == (values < shift).sum()
        got = whitening.leading(a, len(values))
        want = np.sort(values[values > 1e-9])[::-1]
        np.testing.assert_allclose(got.values, want, rtol=1e-9, atol=1e-12 * values.max())
        np.testing.assert_allclose(got.vectors.T @ got.vectors, np.eye(len(want)), atol=1e-5)
        np.testing.assert_allclose(a @ got.vectors, got.vectors * got.values, atol=1e-11 * values.max())

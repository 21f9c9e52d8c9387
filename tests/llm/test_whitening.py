"""Whitening against a dense eigendecomposition."""

import numpy as np
import pytest

from barspan.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, component string, n string, y string, v string"


def dense(vectors, k=16):
    x = np.array([np.floor(64 * np.asarray(v, float)) for v in vectors]) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    c = fit - sums / n
    e, q = np.linalg.eigh(c.T @ c / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(k, int((e > 1e-10 * max(e[0], 1e-300)).sum()))
    return n, ((n * x - sums) ** 2).sum(axis=1), e[:k] / e.sum(), (x - sums / n) @ q[:, :k] / np.sqrt(e[:k])


def check(got, ids, vectors, k=16):
    n, deviation, explained, z = dense(vectors, k)
    assert len(got) == z.size
    got = got.sort_values(["vec_id", "component"], kind="stable")
    order = np.argsort(ids, kind="stable")
    w = got["whitened"].to_numpy().reshape(z.shape)
    z = z[order]
    np.testing.assert_allclose(w * np.sign((w * z).sum(axis=0)), z, atol=1e-7)
    assert (got["n"] == n).all() and (got["deviation"].to_numpy().reshape(z.shape) == deviation[order][:, None]).all()
    np.testing.assert_allclose(got["explained"].to_numpy().reshape(z.shape), np.broadcast_to(explained, z.shape), rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_query_matches_dense(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    check(whitening.op13_embedding_whitening(spark, sf_dir).toPandas(), t["vec_id"].to_numpy(), t["embedding"].tolist())


@pytest.mark.parametrize("dims, rows", [(3, 40), (20, 12), (24, 90)])
def test_odd_rows(spark, dims, rows):
    rng = np.random.default_rng(dims)
    good = [(k, rng.normal(size=dims).astype(np.float32).tolist()) for k in range(rows)]
    good += [(500 + k, good[0][1]) for k in range(30)]  # one vector repeated: once in the fit list
    odd = [(900, None), (901, [float("nan")] * dims), (902, [None] * dims), (903, []), (904, [1.0]), (905, [float("inf")] + [0.0] * (dims - 1))]
    df = spark.createDataFrame([(i, v, "c", "n", "y", "v") for i, v in good + odd], SCHEMA).repartition(3)
    check(whitening.whiten(df).toPandas(), np.array([i for i, _ in good]), [v for _, v in good])


def test_nothing_to_whiten(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(none).count() == 0
    same = spark.createDataFrame([(k, [1.0, 2.0], None, None, None, None) for k in range(4)], SCHEMA)
    assert whitening.whiten(same).count() == 0


def test_null_ids_and_repeated_rows_get_their_rows(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0], None, None, None, None), (1, [0.0, 3.0], None, None, None, None), (1, [0.0, 3.0], None, None, None, None), (2, [5.0, 1.0], None, None, None, None)], SCHEMA)
    rows = whitening.whiten(df).collect()
    assert len(rows) == 8 and sum(r.vec_id is None for r in rows) == 2 and {r.n for r in rows} == {3}


def test_huge_entries_are_exact_or_null(spark):
    df = spark.createDataFrame([(k, [float(10 ** (4 * k)), float(k)], None, None, None, None) for k in range(4)], SCHEMA)
    got = {r.vec_id: r.deviation for r in whitening.whiten(df).filter("component = 1").collect()}
    x = [[int(np.floor(64 * np.float64(np.float32(10 ** (4 * k))))), 64 * k] for k in range(4)]
    want = [sum((4 * v[j] - sum(w[j] for w in x)) ** 2 for j in range(2)) for v in x]
    assert got == {k: (w if w < 1 << 63 else None) for k, w in enumerate(want)}


@pytest.mark.parametrize("spectrum", ["spread", "equal", "pairs", "rank"])
def test_jacobi_davidson_finds_leading_pairs(spectrum):
    rng = np.random.default_rng(2)
    d = 120
    e = {"spread": np.exp(-np.arange(d) / 9), "equal": np.ones(d), "pairs": np.repeat(np.arange(d // 2, 0, -1), 2), "rank": np.r_[np.arange(7, 0, -1), np.zeros(d - 7)]}[spectrum].astype(float)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    a = (q * e) @ q.T
    values, vectors = whitening.jacobi_davidson(lambda b: a @ b, d, 16)
    np.testing.assert_allclose(values, np.sort(e)[::-1][:16], atol=1e-12 * e.max())
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(16), atol=1e-12)
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-11 * e.max()


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(3)
    m = rng.normal(size=(15, 15))
    a, b = m + m.T, rng.normal(size=(15, 2))
    x = whitening.minres(lambda v: a @ v, b, 40)
    np.testing.assert_allclose(a @ x, b, atol=1e-6)

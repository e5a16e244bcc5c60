"""The randomised decomposition against an exact one."""

import numpy as np
import pytest

from sectorlens.operators import factors
from sectorlens.plans.embedding import learned_embedding


def sparse(rng, n, m, rank, noise):
    x = rng.normal(size=(n, rank)) * np.geomspace(8, 1, rank) @ rng.normal(size=(rank, m)) + noise * rng.normal(size=(n, m))
    return np.where(rng.random((n, m)) < 0.6, x, 0.0)


def as_cells(spark, x):
    return spark.createDataFrame([(int(i), f"t{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "row long, col string, value double").repartition(5)


@pytest.mark.parametrize("chunk", [7, factors.CHUNK])
def test_error_is_close_to_the_exact_decomposition(spark, monkeypatch, chunk):
    monkeypatch.setattr(factors, "CHUNK", chunk)
    x = sparse(np.random.default_rng(2), 90, 60, 6, 0.5)
    rows, weights, columns = factors.decompose(as_cells(spark, x), 6)
    u = {r["row"]: r["vector"] for r in rows.collect()}
    v = {r["col"]: r["vector"] for r in columns.collect()}
    assert len(u) == len(set(np.nonzero(x)[0])) and len(v) == len(set(np.nonzero(x)[1]))
    left, right = np.array([u[i] for i in range(90)]), np.array([v[f"t{j}"] for j in range(60)])
    exact = np.linalg.svd(x)
    best = np.linalg.norm(x - exact[0][:, :6] * exact[1][:6] @ exact[2][:6])
    assert np.linalg.norm(x - left * weights @ right.T) <= 1.05 * best
    assert np.allclose(weights, exact[1][:6], rtol=0.02)
    assert np.allclose(left.T @ left, np.eye(6), atol=1e-6) and np.allclose(right.T @ right, np.eye(6), atol=1e-6)
    assert ((right**3).sum(0) >= -1e-9).all()


def test_low_rank_and_empty_tables(spark):
    x = np.outer(np.arange(1.0, 6), [1.0, -2.0, 0.0, 3.0])
    rows, weights, columns = factors.decompose(as_cells(spark, x), 4)
    assert len(weights) == 1 and weights[0] == pytest.approx(np.linalg.norm(x))
    left = np.array([r["vector"] for r in rows.orderBy("row").collect()])
    right = {r["col"]: r["vector"][0] for r in columns.collect()}
    assert np.allclose(left * weights[0] * right["t3"], x[:, 3:4])
    rows, weights, columns = factors.decompose(as_cells(spark, x).limit(0), 4)
    assert rows.collect() == [] and columns.collect() == [] and len(weights) == 0


def test_documents_of_one_topic_are_close(spark):
    rng = np.random.default_rng(0)
    topics = [[f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)], [f"c{i}" for i in range(30)]]
    docs = [(i, list(rng.choice(topics[i % 3], 5)) + ["common"]) for i in range(90)] + [(100, [])]
    corpus = spark.createDataFrame(docs, "org_id long, tokens array<string>")
    got = {r["org_id"]: np.array(r["embedding"]) for r in learned_embedding(corpus, 3).collect()}
    assert set(got) == {d[0] for d in docs} and not got[100].any() and all(len(v) == 3 for v in got.values())
    x = np.array([got[i] for i in range(90)])
    assert np.allclose(np.linalg.norm(x, axis=1), 1, atol=1e-5)
    near = x @ x.T
    same = np.equal.outer(np.arange(90) % 3, np.arange(90) % 3)
    assert near[same].min() > near[~same].max()


def test_vectors_go_once_to_a_block(spark, monkeypatch):
    """Products of several blocks of whole rows; a vector travels to each block that has a cell of it, not to every cell."""
    monkeypatch.setattr(factors, "BLOCK_CELLS", 400)
    x = sparse(np.random.default_rng(4), 90, 60, 6, 0.5)
    blocks = factors.in_blocks(as_cells(spark, x))
    n_blocks = -(-np.count_nonzero(x) // 400)
    stored = [tuple(r) for r in blocks.cells.select("block", "row").distinct().collect()]
    assert len({b for b, _ in stored}) == n_blocks > 4 and len(stored) == 90
    assert blocks.columns.count() <= n_blocks * 60 < np.count_nonzero(x) / 2
    for by, to, matrix in (("col", "row", x), ("row", "col", x.T)):
        names = [f"t{j}" for j in range(60)] if by == "col" else list(range(90))
        vectors = np.random.default_rng(5).normal(size=(len(names), 3))
        sent = spark.createDataFrame([(n, v.tolist()) for n, v in zip(names, vectors)], f"{by} {'string' if by == 'col' else 'long'}, vector array<double>")
        got = {r[to]: r["vector"] for r in factors.multiply(blocks, sent, by, to).collect()}
        keys = [f"t{j}" for j in range(60)] if to == "col" else list(range(90))
        assert np.allclose([got[k] for k in keys], matrix @ vectors)

"""Nested co-clustering on planted groups."""

from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectorlens.operators import cocluster as cc
from sectorlens.operators import graph, merging, nested


def rand_index(a, b):
    """Adjusted for chance."""
    both, left, right = Counter(zip(a, b)), Counter(a), Counter(b)
    pairs = [sum(comb(n, 2) for n in c.values()) for c in (both, left, right)]
    expected = pairs[1] * pairs[2] / comb(len(a), 2)
    most = (pairs[1] + pairs[2]) / 2
    return 1.0 if most == expected else (pairs[0] - expected) / (most - expected)


def planted(groups, n_docs, n_words, seed, family=1, own=0.7, near=0.0):
    """(doc, word, count) edges, and the groups of documents and words; ``family`` groups share a part of their words."""
    rng = np.random.default_rng(seed)
    shares = rng.dirichlet(np.full(groups, 3.0)) + 0.3 / groups
    docs, words = rng.choice(groups, n_docs, p=shares / shares.sum()), np.arange(n_words) % groups
    edges = Counter()
    for d, g in enumerate(docs):
        n = rng.integers(30, 120)
        where = rng.random(n)
        pools = np.flatnonzero(words == g), np.flatnonzero(words // family == g // family), np.arange(n_words)
        for pool, some in zip(pools, (where < own, (where >= own) & (where < own + near), where >= own + near)):
            edges.update((d, int(w)) for w in rng.choice(pool, some.sum()))
    return [(d, w, n) for (d, w), n in edges.items()], docs, words


def as_table(spark, sectors):
    rows = [(s, d, f"w{w}", n) for s, (edges, _, _) in sectors.items() for d, w, n in edges]
    return spark.createDataFrame(rows, "sector string, doc_id long, word string, cnt long")


def groups_of(levels, sector, level):
    rows = levels.where((F.col("sector") == sector) & (F.col("level") == level)).collect()
    out = {"doc": {}, "word": {}}
    for r in rows:
        out[r["kind"]][int(r["node"].lstrip("w"))] = r["grp"]
    return out


@pytest.mark.parametrize("start", [2, 24])
def test_planted_groups_from_any_start(spark, start):
    sectors = {f"k{k}": planted(k, 500, 300, seed=k) for k in (3, 7, 20)}
    sectors["two"] = planted(12, 600, 360, seed=5, family=3, own=0.45, near=0.35)
    levels, report = nested.fit_levels(as_table(spark, sectors), start_groups=start, n_init=2)
    levels = levels.cache()
    found = {r["sector"]: r for r in report.collect()}
    assert set(found) == set(sectors)
    for name, (_, docs, words) in sectors.items():
        got = groups_of(levels, name, 0)
        assert rand_index([got["doc"][d] for d in sorted(got["doc"])], [docs[d] for d in sorted(got["doc"])]) >= 0.95, name
        assert rand_index([got["word"][w] for w in sorted(got["word"])], [words[w] for w in sorted(got["word"])]) >= 0.9, name
    _, docs, words = sectors["two"]
    assert found["two"]["n_levels"] >= 2
    above = groups_of(levels, "two", 1)
    assert rand_index([above["doc"][d] for d in sorted(above["doc"])], [docs[d] // 3 for d in sorted(above["doc"])]) >= 0.95
    assert rand_index([above["word"][w] for w in sorted(above["word"])], [words[w] // 3 for w in sorted(above["word"])]) >= 0.95


def test_one_document_and_no_edges(spark):
    schema = "sector string, doc_id long, word string, cnt long"
    levels, report = nested.fit_levels(spark.createDataFrame([("a", 1, "x", 2)], schema), start_groups=2)
    assert sorted(tuple(r) for r in levels.collect()) == [("a", "doc", 0, "1", 0), ("a", "word", 0, "x", 0)]
    assert report.select("n_levels", "n_doc_groups", "n_word_groups").collect() == [(1, 1, 1)]
    levels, report = nested.fit_levels(spark.createDataFrame([], schema))
    assert levels.collect() == [] and report.collect() == []


def plain_length(matrix, docs, words):
    """The flat description length from its definition."""
    lf, choose = merging.log_factorial, merging.log_choose
    total = matrix.sum()
    fit = sum(e * np.log(e / (matrix.sum(1)[r] * matrix.sum(0)[s])) for (r, s), e in np.ndenumerate(matrix) if e)
    sides = sum(float(lf(np.sum(n)) - lf(n).sum() + choose(np.sum(n) - 1, len(n) - 1)) for n in (np.array(docs), np.array(words)))
    return sides + float(choose(matrix.size + total - 1, total)) - fit


@pytest.mark.parametrize("cell,margin", [(merging.bottom_cell, merging._entropy), (merging.upper_cell, merging.no_margin)])
def test_every_step_merges_the_cheapest_pair(cell, margin):
    rng = np.random.default_rng(0)
    matrix = rng.integers(0, 40, (6, 5)) * (rng.random((6, 5)) < 0.7) + np.eye(6, 5) * 30
    sizes = [rng.integers(1, 9, n) for n in matrix.shape]

    def merged(m, side, i, j):
        edges, own = m.edges.copy() if side == 0 else m.edges.T.copy(), [s.copy() for s in m.sizes]
        edges[i] += edges[j]
        own[side][i] += own[side][j]
        own[side] = np.delete(own[side], j)
        edges = np.delete(edges, j, 0)
        return merging.Merging(edges if side == 0 else edges.T, own, cell, margin).cost()

    m = merging.Merging(matrix, sizes, cell, margin)
    if cell is merging.bottom_cell:
        assert m.cost() == pytest.approx(plain_length(m.edges, *m.sizes))
    while not m.over:
        least = min(merged(m, side, i, j) for side in (0, 1) for i in range(len(m.sizes[side])) for j in range(i + 1, len(m.sizes[side])))
        m.step()
        assert m.cost() == pytest.approx(least)


def test_flat_lengths_agree_with_the_operator(spark):
    """The same description length as `cocluster.description_lengths` on given labels."""
    edges, docs, words = planted(4, 60, 40, seed=1)
    table = as_table(spark, {"s": (edges, docs, words)})
    nodes = [
        spark.createDataFrame([("s", i, [int(g)]) for i, g in enumerate(docs)], "sector string, doc_id long, labels array<int>"),
        spark.createDataFrame([("s", f"w{i}", [int(g)]) for i, g in enumerate(words)], "sector string, word string, labels array<int>"),
    ]
    used = nodes[1].join(table.select("word").distinct(), "word", "left_semi")
    state = cc._tally(table, nodes[0], "doc_id", "word").join(used, ["sector", "word"])
    got = cc.description_lengths(cc._blocks(state, 1), nodes[0], used).first()["description_length"]
    matrix = np.zeros((4, 4))
    for d, w, n in edges:
        matrix[docs[d], words[w]] += n
    seen = sorted({w for _, w, _ in edges})
    m = merging.Merging(matrix, [np.bincount(docs), np.bincount(words[seen])], merging.bottom_cell, merging._entropy)
    assert m.cost() == pytest.approx(got, abs=1e-3)


def test_levels_give_statistics(spark):
    labels = spark.createDataFrame(
        [("s", "doc", "1", 0), ("s", "doc", "2", 1), ("s", "doc", "3", 2), ("s", "word", "a", 0), ("s", "word", "b", 1), ("t", "doc", "9", 0)],
        "sector string, kind string, node string, grp int",
    )
    parents = spark.createDataFrame(
        [("s", "doc", 1, 0, 0), ("s", "doc", 1, 1, 0), ("s", "doc", 1, 2, 1), ("s", "word", 1, 0, 0), ("s", "word", 1, 1, 0), ("s", "doc", 2, 0, 0), ("s", "doc", 2, 1, 0)],
        "sector string, kind string, level int, grp int, parent int",
    )
    levels = nested.project_levels(labels, parents)
    assert levels.where("level = 2").count() == 3 and levels.where("sector = 't'").count() == 1
    docs, words = nested.at_level(levels, 1)
    edges = spark.createDataFrame([("s", "1", "a", 3), ("s", "2", "b", 1), ("s", "3", "a", 2)], "sector string, doc_id string, word string, cnt long")
    assert {tuple(r) for r in graph.group_mixture(edges, docs, words, norm=False).collect()} == {("s", 0, 0, 4), ("s", 1, 0, 2)}
    with pytest.raises(ValueError):
        nested.at_level(levels, -1)

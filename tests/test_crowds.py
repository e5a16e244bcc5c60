"""Pairs that meet in cells against the joins, and their scores against plain ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectorlens.operators import crowds
from sectorlens.operators import matching as m


def names_of(seed, n):
    rng = random.Random(seed)
    words = ["north", "sea", "trading", "house", "müller", "\U0001f600x", "a", "of", "limited" * 9]
    made = {" ".join(rng.choices(words, k=rng.randint(1, 4))) + f" {rng.randrange(40):05d}" for _ in range(n)} | {"", "zq"}
    return list(enumerate(sorted(made)))


@pytest.mark.parametrize("share", [0, 1e9])
def test_cells_equal_join(spark, monkeypatch, share):
    """Small blocks and few pairs at a time, and names longer than a machine word."""
    crowded = m.crowded
    monkeypatch.setattr(m, "crowded", lambda xs, ys: crowded(xs, ys, share))
    monkeypatch.setattr(crowds, "BLOCKS", {"x": 7, "y": 11})
    monkeypatch.setattr(crowds, "PAIRS", 5)
    left, right = (spark.createDataFrame(names_of(seed, 50), "id long, name string") for seed in (1, 2))
    vectors = m.tfidf_vectors(left, right)
    lsh = m.lsh_candidates(left, right)
    assert ("MapInArrow" in lsh._jdf.queryExecution().optimizedPlan().toString()) == (share == 0)
    signed = {s: m.signed_names(df, s, 16, 4, 3) for s, df in (("x", left), ("y", right))}
    want = sorted(map(tuple, m.lsh_meetings(signed["x"], signed["y"], 16, 50).select("x", "y").collect()))
    assert len(want) > 100 and sorted(map(tuple, lsh.collect())) == want
    pairs, others = m.union_of_all(left, right, vectors, 3)
    met = m.union_candidates(lsh, m.cosine_candidates(vectors, 3))
    assert others is None and sorted(map(tuple, pairs.pairs().collect())) == sorted(map(tuple, met.collect()))
    scored = m.score_pairs(met, vectors, min_score=0)
    assert sorted(map(str, m.score_union(pairs, None, vectors).collect())) == sorted(map(str, scored.collect()))
    for score in crowds.SCORES:
        got = m.score_union(pairs, None, vectors, scores=[score], digits=6)
        assert sorted(map(str, got.collect())) == sorted(map(str, scored.select("x", "y", F.round(score, 6).alias(score)).collect()))


def test_crowds_do_not_move_pairs(spark):
    """Names that nearly all share a bucket: no join on buckets, and a task's batches stay small."""
    left = spark.createDataFrame([(i, f"customer {i:09d}") for i in range(400)], "id long, name string")
    right = spark.createDataFrame([(i, f"customer {i:07d} 7") for i in range(300)], "id long, name string")
    pairs, _ = m.union_of_all(left, right, m.tfidf_vectors(left, right), 2)
    assert pairs.crowd is not None
    assert "Join Inner, ((band#" not in m.lsh_candidates(left, right)._jdf.queryExecution().optimizedPlan().toString()


def test_half_up():
    assert crowds.half_up(np.array([0.0000005, 2.5e-6, 33.3333335, 1.0000004999]), 6).tolist() == [1e-6, 3e-6, 33.333334, 1.0]

"""Ranked search against plain scoring of every pair."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectorlens.llm import search

SCHEMA = "doc_id long, text string"


def plain_terms(text):
    return re.findall(search.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, best=search.BEST):
    counted = [(d, Counter(plain_terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for d, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for term in plain_terms(text):
                if c[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * ((10**9 * c[term]) // (1000 * c[term] + 12 * m))
            if score > 0:
                scores.append((-score, d is None, d))
        scores.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item_id, rank, d, -s) for rank, (s, _, d) in enumerate(scores[:best], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def made():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Über", "über", "x1y", "Ab-c", "the", "The", "THE"]
    weights = [1 / (i + 1) for i in range(len(words))]

    def text(n):
        return "".join(w + rng.choice([" ", "\n", ", ", "_", "-"]) for w in rng.choices(words, weights, k=n))

    docs = [(i, text(rng.choice([0, 1, 3, 30, 200, 900]))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)]  # ties
    docs += [(5, docs[5][1]), (5, "the w1"), (None, "w3 w3 w4"), (901, None), (902, ""), (903, "...")]
    items = [(i, text(rng.choice([1, 2, 8, 40]))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "unseenterm"), (3, items[3][1]), (None, "w2 w2 über"), (53, docs[7][1])]
    return docs, items


@pytest.mark.parametrize("blocks", [False, True])
def test_search_equals_plain_scores(spark, monkeypatch, blocks):
    docs, items = made()
    monkeypatch.setattr(search, "LEADERS", 40)
    monkeypatch.setattr(search, "BUCKET", 16)
    monkeypatch.setattr(search, "FOCUS", 3)
    table = spark.createDataFrame(docs, SCHEMA).withColumns({c: F.lit("x") for c in ("row", "n", "terms", "item", "score", "rank", "length")})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(1) for c in ("item", "doc_id", "term", "times")})
    out = search.search(table.repartition(7), asked.repartition(3), block_terms=30 if blocks else 1 << 18)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(out) == plain_search(docs, items)


def test_fewer_documents_than_asked_and_other_numbers(spark):
    docs = [(3, "a b c"), (1, "a a d"), (2, "d e")]
    items = [(0, "a b"), (1, "e")]
    got = search.search(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), best=1)
    assert found(got) == plain_search(docs, items, 1)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], SCHEMA)
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for table, queries in ((docs, items), (docs, asked), (some, items), (spark.createDataFrame([(1, None)], SCHEMA), asked)):
        out = search.search(table, queries)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.collect() == []


def test_very_long_text(spark):
    long = " ".join(f"t{i % 5000}" for i in range(400_000))
    docs = [(1, long), (2, "t1 t2 t3"), (3, "t4999 t1")]
    items = [(0, "t1 t2"), (1, "t4999")]
    got = search.search(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert found(got) == plain_search(docs, items)


def test_bounds_leave_documents_out_and_never_a_needed_one():
    """A bucket of short vectors is skipped, and inside a bucket the bound is at least the score."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    lists = [np.sort(rng.choice(40, rng.integers(1, 12), replace=False)).astype(np.int32) for _ in range(80)]
    values = [rng.integers(1, 10**6, len(x)) for x in lists]
    lengths = [float(np.sqrt(np.sum(v.astype(float) ** 2))) for v in values]
    table = pa.table({"doc_id": np.arange(80), "length": lengths, "terms": pa.array(lists, pa.list_(pa.int32())), "impacts": pa.array(values, pa.list_(pa.int64()))})
    bucket = search.Bucket(table, 40)
    for _ in range(50):
        terms = rng.choice(40, 10, replace=False)
        times = rng.integers(1, 3, 10)
        scores = np.array([sum(int(v[np.flatnonzero(x == t)].sum()) * int(c) for t, c in zip(terms, times)) for x, v in zip(lists, values)])
        needed = int(np.sort(scores)[-5]) or 1
        at, got = bucket.search(terms, times, float(np.sqrt(np.sum(times.astype(float) ** 2))), needed)
        assert dict(zip(at.tolist(), got.tolist())) == {i: s for i, s in enumerate(scores.tolist()) if s >= needed}
    assert len(bucket.search(terms, times, 1.0, int(bucket.longest) + 2)[0]) == 0

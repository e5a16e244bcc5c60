"""Joining and filtering inside the tasks against the joins, also for ids that repeat or are null."""

import math
import random
from collections import Counter

import pytest

from sectorlens.operators import phrases


def rows(df):
    return sorted((str(r["org_id"]), r["tokens"]) for r in df.collect())


def corpus_of(spark):
    rng = random.Random(3)
    docs = [(i, [rng.choice("abcdefg") + rng.choice("xy") for _ in range(rng.randrange(12))] + ["new", "york"] * (i % 3)) for i in range(60)]
    docs += [(7, ["new", "york", "ax"]), (None, ["new", "york"]), (None, []), (200, None), (201, ["new"]), (202, ["new", None, "york"])]
    return spark.createDataFrame(docs, "org_id long, tokens array<string>").repartition(3)


@pytest.mark.parametrize("sent", [0, 1 << 25])
def test_filter_equals_join(spark, monkeypatch, sent):
    corpus = corpus_of(spark)
    want = rows(phrases._filtered_by_join(corpus, phrases.kept_tokens(corpus, 9, 0.6).select("token")))
    monkeypatch.setattr(phrases, "SENT_BYTES", sent)
    assert rows(phrases.filter_frequency(corpus, 9, 0.6)) == want


@pytest.mark.parametrize("pairs", [0, 1000])
def test_phrases_equal_join(spark, monkeypatch, pairs):
    corpus = corpus_of(spark).where("org_id is null or org_id <> 7")
    want = rows(phrases._joined_by_join(corpus, phrases.accepted_phrases(corpus, 0.05).select("first", "second")))
    monkeypatch.setattr(phrases, "SENT_PAIRS", pairs)
    assert rows(phrases.detect_phrases(corpus, 0.05)) == want
    assert any("new_york" in (tokens or ()) for _, tokens in want)


def test_tokens_do_not_move(spark):
    """Only the counts are shuffled: neither the filter nor the joining explodes the tokens by document again."""
    docs = spark.createDataFrame([(i, ["new", "york", f"w{i}"]) for i in range(30)], "org_id long, tokens array<string>")
    for df in (phrases.filter_frequency(docs, 2, 1.0), phrases.detect_phrases(docs)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert len(df.collect()) == 30


@pytest.mark.parametrize("sent", [0, 120, 1 << 25])
def test_pairs_are_counted_as_numbers(spark, monkeypatch, sent):
    """Whatever share of the tokens is sent, the accepted pairs are those of a plain count, and their words aren't shuffled."""
    corpus = corpus_of(spark)
    monkeypatch.setattr(phrases, "SENT_BYTES", sent)
    docs = [r.tokens for r in corpus.collect() if r.tokens]
    pairs, words = (Counter(p for d in docs for p in zip(d, d[1:])), Counter(t for d in docs for t in d))
    total = sum(words.values())

    def npmi(pair):
        return math.log(pairs[pair] * total / (words[pair[0]] * words[pair[1]])) / -math.log(pairs[pair] / total)

    want = {(*p, n) for p, n in pairs.items() if n >= 2 and None not in p and round(npmi(p), 9) > 0.05}
    found = phrases.accepted_phrases(corpus, 0.05)
    assert want and {(r["first"], r["second"], r["n"]) for r in found.collect()} == want
    if sent > 120:
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [code#" in plan and "Aggregate [first#" not in plan


def test_a_long_batch_is_taken_in_parts(spark, monkeypatch):
    corpus = corpus_of(spark).where("org_id is null or org_id <> 7")
    want = [rows(phrases.detect_phrases(corpus, 0.05)), rows(phrases.filter_frequency(corpus, 9, 0.6))]
    monkeypatch.setattr(phrases, "PART_TOKENS", 5)
    assert [rows(phrases.detect_phrases(corpus, 0.05)), rows(phrases.filter_frequency(corpus, 9, 0.6))] == want
    batch = corpus.coalesce(1).toArrow().combine_chunks().to_batches()[0]
    parts = list(phrases.in_parts([batch]))
    assert len(parts) > 10 and sum(p.num_rows for p in parts) == batch.num_rows

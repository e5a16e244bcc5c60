"""Sub-word tokens against a plain longest-match loop."""

import random
import re

from pyspark.sql import functions as F

from sectorlens.operators import subwords as sw
from sectorlens.plans.embedding import subword_report


def plain_pieces(word, vocabulary):
    if len(word) > sw.LONGEST_WORD:
        return [sw.UNKNOWN]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                out.append(piece)
                at = end
                break
        else:
            return [sw.UNKNOWN]
    return out


def made(seed=0):
    rng = random.Random(seed)
    vocabulary = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(25)}
    vocabulary |= {"##" + "".join(rng.choice("abcé") for _ in range(rng.randint(1, 3))) for _ in range(14)} | {"##", ".", "a"}
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(300)} | {"a" * 100, "a" * 101, ".", "!", "##"}
    return sorted(vocabulary), sorted(words)


def test_segments_equal_a_plain_loop(spark):
    vocabulary, words = made()
    table = spark.createDataFrame([(w,) for w in words for _ in range(2)], "word string")
    pieces = spark.createDataFrame([(p,) for p in [*vocabulary, vocabulary[0], ""]], "piece string")
    got = {r["word"]: r["pieces"] for r in sw.segment_words(table, pieces).collect()}
    assert got == {w: plain_pieces(w, set(vocabulary)) for w in words}
    assert {len(p) for p in got.values()} > {1, 2, 3} and [sw.UNKNOWN] in got.values()


def test_counts_and_truncation(spark, monkeypatch):
    monkeypatch.setattr(sw, "HOT", 5)
    vocabulary, words = made(1)
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))) + rng.choice(["", ".", " A!"])) for i in range(60)] + [(99, None), (98, "")]
    table = spark.createDataFrame(texts, "org_id long, description string").withColumns({"word": F.lit(1), "n": F.lit(2)})
    pieces = spark.createDataFrame([(p,) for p in vocabulary], "piece string")
    got = {r["org_id"]: (r["n_tokens"], r["n_kept"]) for r in sw.subword_counts(table, pieces, max_length=20).collect()}
    want = {}
    for i, text in texts:
        found = re.findall(r"\w+|[^\w\s]", (text or "").lower())
        n = 2 + sum(len(plain_pieces(w, set(vocabulary))) for w in found)
        want[i] = (n, min(n, 20))
    assert got == want
    assert got[99] == got[98] == (2, 2)
    shares = subword_report(table, pieces, 20, None)[0].first()["percentile"]
    below, upto = sum(n < 20 for n, _ in want.values()), sum(n <= 20 for n, _ in want.values())
    assert shares == (below + upto + (upto > below)) * 50 / len(want)


def test_no_pieces_and_no_words(spark):
    none = spark.createDataFrame([], "piece string")
    words = spark.createDataFrame([("ab",)], "word string")
    assert sw.segment_words(words, none).collect() == [("ab", [sw.UNKNOWN])]
    assert sw.segment_words(words.limit(0), none).collect() == []

"""Fingerprints and likeness against plain I-Match."""

import math
import random
import re
from collections import Counter

import pytest
import xxhash

from sectorlens.llm import fingerprints as fp

SEED = 42


def hash_text(value):
    return xxhash.xxh64_intdigest(value.encode(), SEED)


def hash_longs(values):
    seed = SEED
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), seed)
    return seed


def hash_drawn(term, rate):
    """A long, then an integer."""
    seed = xxhash.xxh64_intdigest(term.to_bytes(8, "little", signed=True), SEED)
    return xxhash.xxh64_intdigest(rate.to_bytes(4, "little", signed=True), seed)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def terms(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {signed(hash_text(w)) % fp.BUCKETS for w in words}


def plain_fingerprint(text, counts, total):
    def steps(t):
        if t not in counts:
            return fp.FARTHEST
        idf = math.log(total / counts[t])
        return min(math.ceil(max(fp.IDF_BAND[0] - idf, idf - fp.IDF_BAND[1], 0.0) / fp.STEP), fp.FARTHEST - 1)

    placed = sorted((steps(t), t) for t in terms(text))
    band = sorted(t for _, t in placed[: max(fp.FEW, sum(s == 0 for s, _ in placed))])
    subsets = [band]
    for rate in fp.RATES:
        drawn = [(signed(hash_drawn(t, rate)) % rate, t) for t in band]
        subsets += [[(k << 20) | t for d, t in drawn if d == k] for k in range(fp.LEXICONS)]
    return [hash_longs(s) & 0xFFFFFF if s else None for s in subsets]


def plain_likeness(left, right):
    if left == right:
        return 1.0
    out = None
    for i in range(len(fp.RATES)):
        at = slice(1 + i * fp.LEXICONS, 1 + (i + 1) * fp.LEXICONS)
        pairs = [(x, y) for x, y in zip(left[at], right[at]) if x is not None or y is not None]
        share = sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0
        out = share if out is None or len(pairs) >= fp.ENOUGH else out
    return out


def made():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    weights = [1 / (i + 1) for i in range(500)]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 2, 5, 9, 60, 400]))) for _ in range(250)]
    return [*enumerate(texts), (900, None), (901, ""), (902, "ONLY Here"), (903, texts[3])]


def test_fingerprints_equal_plain_i_match(spark):
    docs = made()
    counts = Counter(t for _, text in docs for t in terms(text))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in fp.fingerprints(table).collect()}
    order = sorted(docs, key=lambda d: -d[0])
    plain = {d: plain_fingerprint(text, counts, len(docs)) for d, text in docs}

    def shown(hashes):
        return "".join("-" * 6 if h is None else f"{h:06x}" for h in hashes)

    for (doc, text), (after, following) in zip(order, order[1:] + order[:1]):
        text, following = text or "", following or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        other = plain_fingerprint(edited, counts, len(docs))
        assert got[doc]["fingerprint"] == shown(plain[doc])
        assert got[doc]["edited_fingerprint"] == shown(other)
        assert got[doc]["near_edited"] == pytest.approx(plain_likeness(plain[doc], other))
        assert got[doc]["near_next"] == pytest.approx(plain_likeness(plain[doc], plain[after]))


@pytest.mark.parametrize("inside", [6, 7, 8, 9])
def test_one_term_changes_one_term(spark, inside):
    """Two texts that differ in one term of the band are alike, whether they hold few terms of it or enough."""
    rare, common = [f"r{i}" for i in range(10)], [f"c{i}" for i in range(40)]
    filler = [(100 + i, " ".join(common + [rare[i % 10]])) for i in range(400)]
    docs = [(0, " ".join(common + rare[:inside])), (1, " ".join(common + rare[: inside + 1])), *filler]
    lexicon = fp.lexicon_of(spark.createDataFrame(docs, "doc_id long, text string"), band=(math.log(5), math.log(100)))
    table = spark.createDataFrame(docs[:2], "doc_id long, text string").select("doc_id", fp.terms_of("text").alias("t"))
    near = table.select("doc_id", fp._nearest("t", lexicon).alias("near"))
    kept = {r[0]: set(r[1]) for r in near.select("doc_id", fp._kept("near")).collect()}
    assert len(kept[0] ^ kept[1]) <= 2 and len(kept[0]) == max(inside, fp.FEW)

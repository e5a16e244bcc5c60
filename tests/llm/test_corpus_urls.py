"""The URL filter against plain segmentation and plain naive Bayes."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sectorlens.llm import urls

SCHEMA = "page_id long, url string, html string"


def plain_scores(pages):
    """Probability of `block` per page by the whole dictionary and plain counts."""
    counts = Counter()
    for _, _, html in pages:
        text = re.sub(r"<[^>]*>", " ", html or "").lower()
        counts.update(w for w in re.split(r"[^a-z]+", text) if 2 <= len(w) <= urls.LONGEST)
    cut = urls.Segmenter(dict(counts))

    def features(url):
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        labels = host.split(":")[0].split(".")
        out = [f"h:.{labels[-1]}"]
        for kind, texts in (("h", labels[:-1]), ("p", [path.lower()])):
            for text in texts:
                for part in re.findall(r"[a-zà-ÿ]+|\d+", text):
                    out += [f"{kind}:#"] if part.isdigit() else [f"{kind}:{w}" for w in cut.split(part)]
        fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return out, max(fits, key=lambda r: len(r.text)).verdict if fits else None

    known = [features(u) for _, u, _ in pages]
    tables = {v: Counter(urls.bucket(t) for f, own in known if own == v for t in f) for v in (urls.ALLOW, urls.BLOCK)}
    n = Counter(own for _, own in known)
    sums = {v: sum(tables[v].values()) + urls.BUCKETS for v in tables}
    out = {}
    for (page_id, _, _), (found, _) in zip(pages, known):
        logit = math.log(n[urls.BLOCK] / n[urls.ALLOW])
        for t in found:
            b = urls.bucket(t)
            logit += math.log((tables[urls.BLOCK][b] + 1) / sums[urls.BLOCK]) - math.log((tables[urls.ALLOW][b] + 1) / sums[urls.ALLOW])
        out[page_id] = 1 / (1 + math.exp(-logit))
    return out


def test_scores_equal_plain_bayes(spark, monkeypatch):
    monkeypatch.setattr(urls, "HOT", 10)
    rng = random.Random(5)
    words = ["casino", "poker", "garden", "school", "club", "shop", "best", "news", "the", "ing", "red"]
    pages = []
    for i in range(240):
        host = "".join(rng.choices(words, k=rng.randint(1, 4))) + rng.choice(["", "9", "-x", ".sub"])
        tld, path = rng.choice([("com", "fr/"), ("com", "de/"), ("org", ""), ("net", "a1/"), ("net", "Red/Garden?x")])
        pages.append((i, f"http://{host}.{tld}/{path}{'-'.join(rng.choices(words, k=2))}/{i}", "<p>" + " ".join(rng.choices(words[:9], k=8)) + "</p>"))
    pages += [(900, None, None), (901, "http://", ""), (5, pages[5][1], pages[5][2])]
    table = spark.createDataFrame(pages, SCHEMA).withColumns({c: F.lit("x") for c in ("row", "name", "words", "splits", "host", "ruled", "word", "n")})
    got = {r["page_id"]: r["score"] for r in urls.judge(table.repartition(4)).collect()}
    want = plain_scores(pages)
    assert set(got) == set(want)
    for page_id, score in want.items():
        assert got[page_id] == pytest.approx(score, abs=1e-9)


def test_every_word_of_the_texts_counts(spark):
    """A word seen once splits a name, however many words are seen more often."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = [a + b + c + d for a in letters for b in letters for c in letters for d in letters[:4]]
    assert len(many) > 60_000
    rows = [(" ".join(many),), (" ".join(many),), ("quixotic landfall",)]
    words = urls.word_counts(spark.createDataFrame(rows, "html string"))
    names = spark.createDataFrame([("quixoticlandfall",), ("q",), ("ünix",)], "name string")
    got = {r["name"]: r["words"] for r in urls.split_names(names, words).collect()}
    assert got["quixoticlandfall"] == ["quixotic", "landfall"] and got["q"] == ["q"] and "".join(got["ünix"]) == "ünix"

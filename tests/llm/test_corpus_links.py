"""Jaccard join, embedding near-duplicates, language, URLs, quality and the pipeline."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sectorlens.llm import components, jaccard, language, neardup, packing, quality, secrets, urls
from sectorlens.llm.words import shingle_sets

SMALL = "/root/testdata/sf0.001"
EDGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("n", "rep", "component", "key", "band", "id", "c0", "c1", "digest", "held_out", "score", "grade", "buckets", "h", "a", "b")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHES if c not in df.columns})


def plain_sets(docs):
    out = {}
    for doc_id, text in docs:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        out[doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())
    return out


def plain_components(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_links(docs):
    sets = plain_sets(docs)
    ids = sorted(sets)
    pairs = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                pairs.append((a, b))
    comp = plain_components(ids, pairs)
    return {d: (len(sets[d]), comp[d]) for d in ids}


def made_documents():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(12):  # groups around a base, edits from none to a fifth
        base = [rng.choice(words) for _ in range(rng.choice([4, 6, 30, 90, 200]))]
        for _ in range(rng.randint(1, 14)):
            copy = base[:]
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy[: len(copy) - rng.randint(0, len(copy) // 12)]))
    passage = " ".join(rng.choice(words) for _ in range(60))
    for _ in range(40):  # a passage that many documents share
        docs.append(" ".join(rng.choice(words) for _ in range(rng.choice([2, 9, 60, 200]))) + " " + passage)
    docs += ["one two three", "One  two\tthree", "one two", "", None, "x" * 30]
    rng.shuffle(docs)
    return list(enumerate(docs, 50))


def test_jaccard_equals_all_pairs(spark):
    docs = made_documents()
    table = clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table).collect()}
    want = plain_links(docs)
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_jaccard_needs_no_leaders(spark, monkeypatch):
    """The complete pass finds every link by itself, and frequent shingles don't change the result."""
    docs = made_documents()
    table = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "leader_pairs", lambda light: light.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where("false"))
    monkeypatch.setattr(jaccard, "frequent_shingles", lambda sets: (np.zeros(0, np.uint64), np.zeros(0, np.uint64)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table).collect()}
    assert got == plain_links(docs)


def test_jaccard_group_of_unlinked_texts(spark, monkeypatch):
    """Texts around one base that mostly don't link leave few pairs to the exact comparison."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(130)]
    docs = []
    for i in range(400):
        copy = base[:]
        for place in rng.sample(range(130), rng.randint(2, 6)):
            copy[place] = f"x{i}_{place}"
        docs.append((i, " ".join(copy)))
    compared, bounded = [], jaccard.within_bound

    def counted(pairs, classes, percent):
        pairs = pairs.cache()
        compared.append(pairs.count())
        return bounded(pairs, classes, percent)

    monkeypatch.setattr(jaccard, "within_bound", counted)
    out = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == plain_links(docs)
    assert sum(compared) < 10_000  # of 79,800 pairs


def test_tile_pairs_by_place_and_signature():
    def record(rep, n, at):
        return (7, at, n, rep, rep)

    records = np.array([record(1, 100, 0), record(2, 100, 11), record(3, 100, 12), record(4, 100, 2)], jaccard.RECORD)
    # 89 common shingles of 100 and 100 are enough, 88 are not
    assert jaccard.tile_pairs(records).tolist() == [[1, 2], [1, 4], [2, 4]]
    assert len(jaccard.tile_pairs(records, nearest=1)) < 3
    signed = np.zeros(4, jaccard.SIGNED_RECORD)
    for name in jaccard.RECORD.names:
        signed[name] = records[name]
    sets = [np.arange(0, 100), np.arange(5, 105), np.arange(0, 100), np.arange(30, 130)]
    for i, x in enumerate(sets):
        signed["narrow"][i] = np.frombuffer(jaccard.narrow(jaccard.signature(x.astype(np.uint64))), np.uint64)
    assert jaccard.tile_pairs(signed).tolist() == [[1, 2]]


def test_jaccard_edge_cases(spark):
    schema = "doc_id long, text string"
    empty = spark.createDataFrame([], schema)
    assert jaccard.jaccard_components(empty).collect() == []
    long = " ".join(f"t{i}" for i in range(60_000))
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "A b c d e f"), (9, long), (8, long + " end"), (7, None), (6, "q r"), (6, "z z")]
    out = jaccard.jaccard_components(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == len(rows)
    comp = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in out}
    assert comp[4, 2] == comp[2, 2] == 2 and comp[9, 59_996] == comp[8, 59_997] == 8
    assert comp[7, 0] == 7 and comp[6, 1] == 6


def test_signatures_bound_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(2))
        common = len(np.intersect1d(a, b))
        assert jaccard.overlap_bound(jaccard.signature(a), jaccard.signature(b), len(a), len(b)) >= common
    half = jaccard.signature(np.arange(500, dtype=np.uint64))
    assert jaccard.overlap_bound(half, jaccard.signature(np.arange(400, 900, dtype=np.uint64)), 500, 500) < 400


def test_shingles_cut_at_texts():
    texts = ["A b c d e f", "a B c d e F", "", "x y", "a b c d e f g"]
    raw = [t.encode() for t in texts]
    sets = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])])
    assert [len(s) for s in sets] == [2, 2, 0, 1, 3]
    assert set(sets[0]) == set(sets[1]) < set(sets[4])


def test_components_against_union_find(spark):
    rng = random.Random(7)
    for links in (
        [(i, i + 1) for i in range(60)],
        [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        [(0, i) for i in range(1, 50)] + [(99, i) for i in range(40, 90)],
    ):
        got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
        nodes = {x for p in links if p[0] != p[1] for x in p}
        assert got == plain_components(nodes, [p for p in links if p[0] != p[1]])
    assert components.components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).collect() == []


def plain_cosines(vectors, least):
    usable = [i for i, v in enumerate(vectors) if v is not None and None not in v and len(v) and np.isfinite(v).all() and np.any(v)]
    units = {i: np.array(vectors[i], float) / np.linalg.norm(np.array(vectors[i], float)) for i in usable}
    return [
        (i, j) for n, i in enumerate(usable) for j in usable[n + 1 :]
        if len(vectors[i]) == len(vectors[j]) and units[i] @ units[j] >= least
    ]


@pytest.mark.parametrize("block", [1024, 7])
def test_near_vectors_against_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    vectors = []
    for _ in range(25):
        base = rng.standard_normal(16)
        vectors += [(base + rng.standard_normal(16) * s).tolist() for s in rng.choice([0.0, 0.05, 0.15, 0.3], rng.integers(1, 12))]
    vectors += [[1.0] * 16] * 30 + [[2.0] * 16, [0.0] * 16, None, [], [float("nan")] * 16, [1.0, None], [1.0, 1.0], [1e100] * 16, [-0.0, 1.0]]
    table = clashing(spark.createDataFrame([(i + 5, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"))
    rows = {r["vec_id"] - 5: r for r in neardup.near_vectors(table, miss=1e-7, block=block).collect()}
    pairs = plain_cosines(vectors, 0.9)
    comp = plain_components(range(len(vectors)), pairs)
    assert len(rows) == len(vectors) and len(pairs) > 400
    for i, r in rows.items():
        assert r["n_links"] == sum(i in p for p in pairs)
        assert r["component_id"] - 5 == comp[i]
        assert r["kept"] == (comp[i] == i)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neardup.near_vectors(empty).collect() == []


def test_tables_meet_the_stated_miss():
    for n in (2, 10**3, 10**6, 10**9):
        bits, tables = neardup.plan(n)
        agree = (1 - np.arccos(0.9) / np.pi) ** bits
        assert (1 - agree) ** tables <= neardup.MISS


def plain_segmentations(word, probability):
    """Sum over all segmentations, by recursion."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, min(len(word), language.WIDEST) + 1):
        p = probability(word[:k])
        if p:
            total += p * plain_segmentations(word[k:], probability)
    return total


def test_forward_sums_all_segmentations():
    import sentencepiece
    from sectorlens.llm.words import span_hashes

    path = language.vocabulary_path()
    hashes, _ = language.pieces_of(path)
    rng = np.random.default_rng(0)
    table = rng.random((len(hashes), 2)) / 1000
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    known = {model.id_to_piece(i) for i in range(model.get_piece_size())}

    def probability(piece, column):
        if piece in known:
            points = np.array([ord(c) for c in piece], np.uint64)
            return table[np.searchsorted(hashes, span_hashes(points, np.array([0]), np.array([len(piece)])))[0], column]
        return language.UNKNOWN if len(piece) == 1 else 0.0

    words = ["the", "straße", "a", "nation", "ꙮx", "información"]
    lattice = language.Lattice(words, path)
    got = lattice.log_probability(table)
    for i, word in enumerate(words):
        for column in (0, 1):
            want = plain_segmentations("▁" + word, lambda p, c=column: probability(p, c))
            assert got[i, column] == pytest.approx(np.log(want), rel=1e-9)
    # Expected uses: every segmentation uses pieces that cover the word once.
    uses = language.Lattice(["nation"], path).expected(table[:, 0], np.array([3.0]))
    assert 3.0 <= uses.sum() <= 3.0 * 7


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = language.predict_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"] and r["lang"] is not None]
    assert len(held) > 20 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def test_language_edge_cases(spark):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the garden", "en"), ("das haus und der garten", "de")] * 12)]
    rows = train + [
        (500, None, "en"), (501, "", None), (502, "12 ² !!! \n", "en"), (503, "und das " * 20_000, None), (504, "ꙮ", None), (None, "the house", None),
        (505, "x" * 5000, None), (503, "und das", None),
    ]
    table = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    out = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict_documents(table).collect()]
    assert len(out) == len(rows)
    by = {r[0]: r for r in out}
    assert all(by[i][1:] == ("und", 0.0) for i in (500, 501, 502))
    assert by[503][1] == "de" and by[None][1] == "en" and by[504][1] in ("de", "en")
    assert all(0 <= r[2] <= 1 for r in out)
    none = table.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.predict_documents(none).collect()} == {"und"}
    assert language.predict_documents(table.where("false")).collect() == []


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match("[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match("[^?#]*", rest[len(host) :])[0]


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG", "http://a.example.org/", "https://x.example.org/es/1", "https://example.org/en/12?x=1",
    "http://example.org/en/2", "http://notexample.org/es/", "ftp://shop.com/de/x#y", "http://shop.com/fr", "http://shop.com/fr/", "http://org/",
    "http://ÄB.net/a?b://c", "http://k.net#/org/", "http://stopspam.net/de/9\nx", "http://x.com:80/de/", "://h.net/p", "http://thewordsite.net/" + "ab" * 9000,
]


def test_url_rules(spark):
    pages = clashing(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("html", F.lit("<p>the word site stop spam</p>")))
    rows = urls.judge(pages).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path = plain_url(URLS[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        fits = [
            rule for rule in urls.RULES
            if (host == rule.host or host.endswith("." + rule.host)) and path.startswith(rule.path)
        ]
        best = max(fits, key=lambda rule: len(rule.text), default=None)
        assert r["rule"] == (best.text if best else None)
        assert r["verdict"] == best.verdict if best else r["verdict"] in ("allow", "block")
    assert urls.judge(pages.where("false")).collect() == []


def plain_best(name, logs, unknown):
    if not name:
        return 0.0
    return max(
        (logs.get(name[:k], unknown if k == 1 else -1e9) + plain_best(name[k:], logs, unknown)) for k in range(1, len(name) + 1)
    )


def test_segmentation_is_the_most_probable():
    cut = urls.Segmenter({"the": 50, "word": 9, "words": 3, "site": 5, "sit": 2, "then": 4, "new": 6, "news": 6})
    assert cut.split("thewordsite") == ["the", "word", "site"]
    assert cut.split("thenews") == ["the", "news"] and cut.split("") == []
    for name in ("thenewsite", "xword", "sitthe", "qqq"):
        total = sum(cut.logs.get(w, cut.unknown) for w in cut.split(name))
        assert "".join(cut.split(name)) == name and total == pytest.approx(plain_best(name, cut.logs, cut.unknown))


def test_url_words_decide(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        bad = i % 2
        host = rng.choice(["casino", "poker"] if bad else ["garden", "school"]) + rng.choice(["club", "shop"])
        rows.append((i, f"http://{host}.com/{'de' if bad else 'fr'}/{i}"))
    rows += [(1000, "http://bestcasino.net/x"), (1001, "http://bestschool.net/x")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("html", F.lit("casino poker garden school club shop best"))
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages).collect()}
    assert got[1000] == "block" and got[1001] == "allow"


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.grade_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good = [r for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    rest = [r for r in rows if r["quality"] == 0 or r["toxic"] == 1]
    assert sum(r["keep"] for r in good) >= 0.95 * len(good)
    assert sum(not r["keep"] for r in rest) >= 0.85 * len(rest)
    assert all(0 <= r["p_good"] <= 1 and 0 <= r["expected_grade"] <= 2 for r in rows)


def test_ordinal_gradient_fits_thresholds():
    rng = np.random.default_rng(3)
    truth = rng.standard_normal(50)
    texts = [np.sort(rng.choice(50, 12, replace=False)) for _ in range(1500)]
    score = np.array([truth[t].sum() for t in texts]) + rng.logistic(size=1500)
    grades = np.digitize(score, [-2.0, 2.0])
    model = quality.fit_model(texts, np.zeros((1500, quality.SHARES)), grades)
    assert model.thresholds[0] < model.thresholds[1]
    assert np.corrcoef(model.weights[:50], truth)[0, 1] > 0.9
    places = np.r_[0, np.cumsum([12] * 1500)]
    tails = model.tails(np.concatenate(texts), places, np.zeros((1500, quality.SHARES)))
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert np.corrcoef(tails.sum(axis=1), grades)[0, 1] > 0.7


def test_quality_edge_cases(spark):
    rows = [(i, "good text " * 5 if i % 3 else "### bad %%%") for i in range(40)] + [(90, None), (91, ""), (92, "word " * 40_000), (None, "x"), (3, "good text"), (93, "é日 😀")]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)] + [(3, None, 0), (None, 1, 0), (1, 1, None)], "doc_id long, quality int, toxic int")
    out = quality.grade_documents(docs, labels).collect()
    assert len(out) == len(rows) and all(r["p_good"] is not None for r in out)
    bare = quality.grade_documents(docs, labels.where("false")).collect()
    assert len(bare) == len(rows) and all(r["keep"] and r["p_good"] is None for r in bare)
    assert quality.grade_documents(docs.where("false"), labels).collect() == []


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "jaccard_join", "secret_scan", "packing"]
    kept = stages["language_id"](spark, docs, SMALL)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    cleaned = stages["line_dedup"](spark, kept, SMALL)
    assert cleaned.columns == docs.columns and cleaned.where("n_chars <> length(text)").count() == 0
    once = stages["jaccard_join"](spark, cleaned, SMALL)
    groups = plain_links([(r["doc_id"], r["text"]) for r in cleaned.collect()])
    assert {r["doc_id"] for r in once.collect()} == {d for d, (_, c) in groups.items() if c == d}
    safe = stages["secret_scan"](spark, once, SMALL)
    assert safe.columns == docs.columns
    assert all(r["spans"] == "" for r in secrets.digest(safe).collect())
    packed = stages["packing"](spark, safe, SMALL)
    assert packed.select("doc_id").distinct().count() == safe.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(F.col("n") > packing.SIZE).count() == 0


def test_dropped_documents_without_moving_texts(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (2, text), (3, "other words than those of the texts above"), (3, "other words than those of the texts above"), (None, text), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "LISTED", 2)
    near = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert "SortMergeJoin" not in near._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(corpus_pipeline, "LISTED", 0)
    far = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    want = sorted([rows[0], rows[2], rows[4], rows[5]], key=str)
    assert sorted(map(tuple, near.collect()), key=str) == sorted(map(tuple, far.collect()), key=str) == want


def test_pipeline_edge_cases(spark):
    rows = [
        (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "the house and the garden are large", "en", "s", 3),
        (3, "the house and the garden are large", "en", "s", 3), (4, "the house and the garden are large", "en", None, 3), (5, "12 34", None, "s", 5),
    ]
    rows += [(10 + i, f"the old garden number w{'abcdefghijkl'[i]} behind the house", "en", "s", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, EDGE_SCHEMA).withColumn("key", F.lit(1)).withColumn("drops", F.lit(None).cast("string"))
    docs = docs.withColumns({c: F.lit("x") for c in ("score", "lang_pred", "component_id", "_row", "_column0")}).withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    for table in (docs, docs.where("false")):
        out = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, "")
            assert out.columns == docs.columns
        ids = sorted(r["doc_id"] for r in out.collect())
        assert ids == ([3, *range(10, 22)] if table is docs else [])
        corpus_pipeline.STAGES[-1][1](spark, out, "").collect()

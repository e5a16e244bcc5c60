"""Learned lemmas on a planted vocabulary."""

import random

from sectorlens.operators import lemmas as lm

VERBS = """walk trend bolt grant clean storm hunt farm paint print export import weld drill roast craft test report
    mend repair train guard heat cook plant""".split()
SILENT = "bake tune shape grade frame race trade produce serve promote divide purchase".split()
NOUNS = [a + "y" for a in ("compan", "part", "stud", "factor", "jell", "bod", "cit", "pon", "ferr", "lorr")]


def corpus_rows():
    rng = random.Random(1)
    forms = []
    for v in VERBS:
        forms += [v, v + "s", v + "ed", v + "ing"]
    for v in SILENT:
        forms += [v, v + "s", v[:-1] + "ed", v[:-1] + "ing"]
    for n in NOUNS:
        forms += [n, n[:-1] + "ies"]
    forms += ["walkings", "sing", "ring", "glass", "Upper", "x1", "ox"]
    rng.shuffle(forms)
    return forms, [(i, forms[i::7]) for i in range(7)] + [(50, []), (51, None)]


def test_verbs_and_plurals_fall_together(spark):
    forms, rows = corpus_rows()
    corpus = spark.createDataFrame(rows, "org_id long, tokens array<string>")
    words = lm.vocabulary(corpus).cache()
    assert {r["word"] for r in words.collect()} == {f for f in forms if f.isalpha() and f.islower()}
    rules = {(r["suffix"], r["replacement"]) for r in lm.suffix_rules(words).collect()}
    assert {("s", ""), ("ed", ""), ("ing", ""), ("ies", "y"), ("ing", "e"), ("d", "")} <= rules
    table = lm.lemma_table(words, lm.suffix_rules(words))
    got = {r["word"]: r["lemma"] for r in table.collect()}
    for v in VERBS + SILENT:
        stem = v[:-1] if v.endswith("e") else v
        assert {got[v], got[v + "s"], got[stem + "ed"], got[stem + "ing"]} == {v}, v
    assert all(got[n[:-1] + "ies"] == n for n in NOUNS)
    assert got["walkings"] == "walk" and got["sing"] == "sing" and got["ring"] == "ring" and got["glass"] == "glass"
    out = {r["org_id"]: r["tokens"] for r in lm.lemmatise(corpus, table).collect()}
    assert out == {i: None if t is None else [got.get(w, w) for w in t] for i, t in rows}


def test_long_texts_are_lemmatised_in_one_pass(spark):
    corpus = spark.createDataFrame([(1, ["walks", "x"] * 20_000), (2, ["walks"]), (3, ["x", "x"]), (4, []), (5, None)], "org_id long, tokens array<string>")
    lemmas = spark.createDataFrame([("walks", "walk"), ("x", "x")], "word string, lemma string")
    out = lm.lemmatise(corpus, lemmas)
    assert "map_from_entries" not in out._jdf.queryExecution().toString()
    assert {r["org_id"]: r["tokens"] for r in out.collect()} == {1: ["walk", "x"] * 20_000, 2: ["walk"], 3: ["x", "x"], 4: [], 5: None}


def test_rules_need_support(spark):
    words = spark.createDataFrame([("talk", 1), ("talks", 1), ("walk", 1), ("walks", 1)], "word string, n long")
    assert lm.suffix_rules(words).collect() == []
    assert [tuple(r)[:3] for r in lm.suffix_rules(words, 2, 0.1).collect()] == [("s", "", 2)]
    assert lm.lemma_of(words, lm.suffix_rules(words)).where("word <> lemma").collect() == []


def test_texts_stay_where_they_are(spark, monkeypatch):
    """Lemmas go to the texts; keys that repeat or are null, and too many lemmas, take the join."""
    rows = [(i, ["walks", None, f"w{i}", "walk"]) for i in range(20)] + [(30, []), (31, None)]
    lemmas = spark.createDataFrame([("walks", "walk"), ("w3", "w"), ("walk", "walk")], "word string, lemma string")
    once = spark.createDataFrame(rows, "org_id long, tokens array<string>")
    out = lm.lemmatise(once, lemmas)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    several = spark.createDataFrame([*rows, (3, ["a", "w3"]), (None, ["walks"])], "org_id long, tokens array<string>")

    def found(corpus):
        return sorted(map(str, lm.lemmatise(corpus, lemmas).collect()))

    got = [found(once), found(several)]
    monkeypatch.setattr(lm, "SENT_BYTES", 0)
    assert got == [found(once), found(several)]

"""Learned legal forms on a planted register."""

import math
import random
from collections import Counter

from sectorlens.operators import legal_forms as lf

FORMS = ["zrt", "kft", "oyj", "aktiebolag"]


def register():
    rng = random.Random(3)
    words = [a + b for a in ("nor", "sul", "bel", "tam", "ved", "kor", "lun", "mar") for b in ("ta", "vik", "dor", "sen", "pil", "rax", "mo")]
    names = []
    for i in range(2000):
        body = rng.sample(words, rng.randint(1, 3))
        end = rng.choice([["Zrt."], ["KFT"], ["Oyj"], ["holding", "Aktiebolag"], [], []])
        names.append((i, " ".join([*body, *end])))
    return [*names, (5000, "Kft"), (5001, "Zrt. Kft"), (5002, None), (5003, ""), (5004, "Oyj House"), (5005, "...")]


def test_unseen_forms_go_and_names_stay(spark):
    rows = register()
    names = spark.createDataFrame(rows, "id long, name string")
    forms = lf.learn_forms(names)
    learned = {r["word"] for r in forms.collect()}
    assert learned == {*FORMS, "holding"}
    got = {r["id"]: r["name"] for r in lf.clean_names(names, forms).collect()}
    for i, name in rows[:2000]:
        words = name.lower().replace(".", "").split()
        while words[-1] in learned:
            words.pop()
        assert got[i] == " ".join(words)
    assert got[5000] == "kft" and got[5001] == "zrt kft" and got[5002] == "" and got[5003] == "" and got[5005] == ""
    assert got[5004] == "oyj house"


def test_ratio_is_the_log_likelihood_ratio(spark):
    rows = [r for r in register() if r[0] % 10 == 0]
    table = spark.createDataFrame(rows, "id long, name string").select(lf.name_words("name").alias("words"))
    lists = [r["words"] for r in table.collect() if len(r["words"]) > 1]
    last, other = Counter(x[-1] for x in lists), Counter(w for x in lists for w in x[:-1])
    n, m = len(lists), sum(other.values())
    got = {r["word"]: r for r in lf.place_ratios(table).collect()}
    assert set(got) == set(last) | set(other)
    for word, r in got.items():
        a, b = last[word], other[word]
        table_of = [[a, b], [n - a, m - b]]
        want = 0.0
        for i in range(2):
            for j, column in enumerate((n, m)):
                k = table_of[i][j]
                if k:
                    want += 2 * k * math.log(k * (n + m) / (sum(table_of[i]) * column))
        assert (r["n_last"], r["n_other"]) == (a, b)
        assert abs(r["ratio"] - (want if a * m >= b * n else -want)) < 1e-4


def test_no_names(spark):
    empty = spark.createDataFrame([], "id long, name string")
    forms = lf.learn_forms(empty)
    assert forms.collect() == [] and lf.clean_names(empty, forms).collect() == []
    one = spark.createDataFrame([(1, "Solo Ltd")], "id long, name string")
    assert lf.clean_names(one, forms).collect() == [(1, "solo ltd")]

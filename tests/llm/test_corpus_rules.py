"""Quality rules against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sectorlens.llm import rules

SCHEMA = "doc_id long, source string, text string"
WORD = "[^\x20\x09-\x0d]+"


def words(text):
    return re.findall(WORD, text)


def normal(line):
    return " ".join(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(line))


def plain_rules(rows, limit=rules.LINE_LIMIT, least_left=rules.LEAST_LEFT):
    holders = defaultdict(set)
    for _, source, text in rows:
        for line in (text or "").split("\n"):
            if words(line):
                holders[source, normal(line)].add(text)
    out, texts = [], []
    for doc_id, source, text in rows:
        text = text or ""
        w = words(text)
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if words(x)]
        left = len(w) - sum(len(words(x)) for x in lines if len(holders[source, normal(x)]) > limit)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        kept = not failed and left >= 50 and 100 * left >= least_left * len(w)
        out.append(
            (doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed, kept, left)
        )
        if kept:
            whole = re.findall("[^\n]*\n|[^\n]+$", text)
            texts.append((doc_id, source, "".join(x for x in whole if not (words(x) and len(holders[source, normal(x)]) > limit))))
    return sorted(out, key=str), sorted(texts, key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("doc_id", *rules.RULE_COLUMNS)) for r in df.collect()), key=str)


def made():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)] + ["Größe", "naïve", "A#b", "<p>", "$5", "x|y", "日本"]

    def text(n, common):
        out, used = "", 0
        while used < n:
            k = rng.randint(1, 14)
            used += k
            line = " ".join(rng.choice(vocabulary) for _ in range(k)) if rng.random() > common else rng.choice(shared)
            out += line + rng.choice(["\n", "\n", "\n\n", " \n", "\r\n", " "])
        return out

    shared = ["Cookie  notice: ACCEPT all", "Share this\tpage now please", "All rights reserved by the owner of this page and its parts"]
    docs = [(i, rng.choice(["a", "b", None, ""]), text(rng.choice([5, 60, 90, 300]), rng.choice([0, 0.2, 0.8]))) for i in range(160)]
    docs += [(1000 + i, "a", docs[3][2]) for i in range(30)]  # copies count once
    docs += [(2000 + i, "a", " ".join(f"u{i}x{j}" for j in range(70)) + "\n" + "\n".join(shared) + "\n") for i in range(20)]
    docs += [(7, "a", docs[7][2]), (7, "b", "one two three one two three"), (None, "a", "q " * 60), (3000, "a", None), (3001, "a", ""), (3002, "a", " \n\t\n")]
    docs += [(3003, "c", " ".join(f"v{i % 9000}" for i in range(200_000))), (3004, "c", "lone line without end " * 1)]
    return docs


@pytest.mark.parametrize("heavy", [rules.HEAVY, 5])
def test_rules_equal_plain_counting(spark, monkeypatch, heavy):
    monkeypatch.setattr(rules, "HEAVY", heavy)  # with few heavy lines and with some
    rows = made()
    clash = {c: F.lit("x") for c in ("row", "host", "key", "lines", "words", "kept", "texts", "d", "gone", "n_words")}
    table = spark.createDataFrame(rows, SCHEMA).withColumns(clash).repartition(5)
    want, texts = plain_rules(rows)
    assert found(rules.quality_rules(table)) == want
    assert {w[6] for w in want} == {w[7] for w in want} == {True, False}
    assert any(not failed and not kept for *_, failed, kept, _ in want)
    out = rules.clean(table)
    assert out.columns == table.columns
    assert sorted(((r["doc_id"], r["source"], r["text"]) for r in out.collect()), key=str) == texts


def test_other_limits_and_host(spark):
    rows = made()[:150]
    table = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "site")
    assert found(rules.quality_rules(table, host="site", limit=3, least_left=90)) == plain_rules(rows, 3, 90)[0]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert rules.quality_rules(empty).collect() == [] and rules.clean(empty).collect() == []


def test_map_columns_travel(spark):
    table = spark.createDataFrame([(1, "a", " ".join(f"w{i}" for i in range(60)), {"k": 1})], SCHEMA + ", m map<string,int>")
    assert rules.clean(table).collect() == table.collect()

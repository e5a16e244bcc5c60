import math
import random

import pytest
from pyspark.sql import functions as F

from sectorlens.functions import text as x
from sectorlens.operators import graph as g
from sectorlens.operators import phrases
from sectorlens.plans.descriptions import description_tokens, tokenized


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expression("s")).collect()]


def test_html(spark):
    got = column(
        spark,
        ["<p>a &amp; b</p>", "p> cut</p>", "x<!-- n -->y<script>1<2</script>z", "&#233;&#8364;&#128512;&#x;", "&amp;lt;", None, "1 < 2 > 1"],
        x.strip_html,
    )
    assert got == ["a & b", "p> cut", "xyz", "é€😀&#x;", "&lt;", None, "1 < 2 > 1"]


def test_tokens(spark):
    got = column(spark, ["The companies made 3 glasses for £5m in 2019, and two buses!"], x.tokenize)
    assert got == [["company", "made", "CARDINAL", "glass", "MONEY", "DATE", "CARDINAL", "buse"]]
    kept = column(spark, ["two 5% apples"], lambda c: x.tokenize(c, {"PERCENT": "SHARE"}))
    assert kept == [["two", "SHARE", "apple"]]


def test_token_filters(spark):
    df = spark.createDataFrame([(["ab", "abc", "of_the", "of_steel", "with", "a_b_c"],)], "t array<string>")
    assert df.select(x.filter_tokens("t")).first()[0] == ["abc", "of_steel", "a_b_c"]
    df = spark.createDataFrame([(["MORGAN", "steel", "my_DATE_x", "PERCENT"],)], "t array<string>")
    assert df.select(x.strip_placeholders("t")).first()[0] == ["steel", "PERCENT"]


def greedy(documents, threshold=0.25, min_count=2):
    uni, bi = {}, {}
    for d in documents:
        for t in d:
            uni[t] = uni.get(t, 0) + 1
        for p in zip(d, d[1:]):
            bi[p] = bi.get(p, 0) + 1
    n = sum(uni.values())

    def accepted(p):
        if bi[p] < min_count:
            return False
        both = bi[p] / n
        return math.log(both / (uni[p[0]] / n * uni[p[1]] / n)) / -math.log(both) > threshold

    out = []
    for d in documents:
        i, joined = 0, []
        while i < len(d):
            if i + 1 < len(d) and accepted((d[i], d[i + 1])):
                joined.append(f"{d[i]}_{d[i + 1]}")
                i += 2
            else:
                joined.append(d[i])
                i += 1
        out.append(joined)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_equal_a_greedy_scan(spark, seed):
    random.seed(seed)
    docs = [[random.choice("aabbcdefghij") for _ in range(random.randint(0, 30))] for _ in range(120)]
    docs += [list("xyxyx"), list("xyxyx"), [], ["x"]]
    df = spark.createDataFrame(list(enumerate(docs)), "org_id int, tokens array<string>")

    def tokens(corpus):
        return [r.tokens for r in corpus.orderBy("org_id").collect()]

    assert tokens(phrases.detect_phrases(df)) == greedy(docs)
    assert tokens(phrases.ngrams(df, 3)) == greedy(greedy(docs))
    assert tokens(phrases.ngrams(df, 1)) == docs


def test_frequency_limits(spark):
    df = spark.createDataFrame(
        [(1, ["a", "b", "a"]), (2, ["a", "c"]), (3, ["b"]), (4, [])], "org_id int, tokens array<string>"
    )
    got = {r.org_id: r.tokens for r in phrases.filter_frequency(df, 2, 0.5).collect()}
    assert got == {1: ["a", "b", "a"], 2: ["a"], 3: ["b"], 4: []}
    assert {r.token for r in phrases.kept_tokens(df, 1, 1.0, keep_n=2).collect()} == {"a", "b"}
    assert {r.token for r in phrases.kept_tokens(df, 1, 1.0, keep_n=1).collect()} == {"a"}


def test_no_document_is_lost(spark):
    df = spark.createDataFrame([(i, "steel pipes") for i in range(12)] + [(99, ""), (100, "!!")], "org_id int, description string")
    got = {r.org_id: r.tokens for r in description_tokens(df, n=2).collect()}
    assert len(got) == 14 and got[99] == got[100] == [] and got[0] == ["steel_pipe"]


def test_shares_and_text_sectors(spark):
    groups = spark.createDataFrame([("s", i, i % 2) for i in range(10)], "sector string, doc_id long, doc_group int")
    found = g.text_sectors(groups, [2, 0.35, "all"]).groupBy("param").count().collect()
    assert {r.param: r["count"] for r in found} == {"assigned_2": 4, "assigned_0.35": 6, "assigned_all": 10}
    for wrong in (None, True, [1]):
        with pytest.raises(ValueError):
            g.docs_to_assign(wrong, F.lit(1))


def test_matrix_edges(spark):
    matrix = spark.createDataFrame([("w", 2.0, 0.5), ("v", 0.0, 1.0)], "word string, d1 double, d2 double")
    got = {(r.doc_id, r.word, r.cnt) for r in g.matrix_edges(matrix, "word", ["d1", "d2"], "s").collect()}
    assert got == {("d1", "w", 2.0), ("d2", "v", 1.0)}
    assert g.matrix_edges(matrix, "word", ["d1", "d2"], "s", counts=False).count() == 3
    half = spark.createDataFrame([("w", 1.5)], "word string, d1 double")
    with pytest.raises(ValueError):
        g.matrix_edges(half, "word", ["d1"], "s", counts=False)


@pytest.mark.parametrize(
    "text,want",
    [
        ("it&#x27;s 3 &times; 4", "it's 3 × 4"), ("&#65;&#X42;&#0;&#xD800;", "AB&#0;&#xD800;"), ("a&nbsp;b &amp;lt; c", "a b &lt; c"),
        ("fish & chips &unknown; &lt", "fish & chips &unknown; &lt"), ("&Eacute;&eacute;&hearts;&#128512;", "Éé♥😀"), ("&", "&"), ("", ""), (None, None),
    ],
)
def test_character_references(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(x.decode_references("s").alias("s")).first().s == want


def test_gazetteer_names(spark):
    df = spark.createDataFrame(
        [(1, "we trade in north wales and wales"), (2, "no places here"), (3, ""), (4, "new york city limits, new york"), (5, "the stag inn of wales")],
        "org_id int, description string",
    )
    names = spark.createDataFrame(
        [("Wales", "GPE"), ("North Wales", "LOC"), ("New York", "GPE"), ("New York City", "GPE"), ("york city limits", "ORG"), ("", "LOC"), ("Wales", "ORG")],
        "name string, kind string",
    )
    got = {r.org_id: r.tokens for r in tokenized(df, gazetteer=names).collect()}
    assert got[1] == ["trade", "LOC", "GPE"] and got[2] == ["place"] and got[3] == []
    assert got[4] == ["GPE", "limit", "GPE"] and got[5] == ["stag", "inn", "GPE"]


def test_long_gazetteer_names(spark):
    df = spark.createDataFrame(
        [(1, "grants from royal steel harbour bridge engine makers guild london"), (2, "royal steel")], "org_id int, description string"
    )
    names = spark.createDataFrame(
        [("Royal Steel Harbour Bridge Engine Makers Guild", "ORG"), ("royal steel", "GPE"), ("London", "LOC")], "name string, kind string"
    )
    got = {r.org_id: r.tokens for r in tokenized(df, gazetteer=names).collect()}
    assert got == {1: ["grant", "ORG", "LOC"], 2: ["GPE"]}


def test_only_matched_descriptions_are_tokenised(spark):
    df = spark.createDataFrame([(i, "steel pipes") for i in range(12)], "org_id int, description string")
    matched = spark.createDataFrame([(i,) for i in range(11)], "org_id int")
    got = description_tokens(df, n=2, matched=matched).collect()
    assert sorted(r.org_id for r in got) == list(range(11))

"""Markup that is not well formed, against a plain reader with states."""

import random
import re

import pytest

from sectorlens.functions.markup import PLAIN, RAW, strip_markup

CASES = {
    'a <b title="x > y">bold</b> end': "a bold end",
    "a <b title='x > y' c=\"'>'\">bold</b>": "a bold",
    "p> This is a description</p>": "p> This is a description",
    "something <word-without-end": "something ",
    "open <!-- comment <b> never closed": "open ",
    "x<!-- > -->y<!---->z": "xyz",
    "s<script>if (a < b) { '</b>' }</script>t<SCRIPT src='a>b'>x": "st",
    "<style>p > a {}</style >text": "text",
    "<title>A <b> &amp; C</title>|<textarea rows=2>1 < 2 <i></textarea>|": "A <b> & C|1 < 2 <i>|",
    "<textarea>open <b>": "open <b>",
    "5 < 6 > 4 & <3": "5 < 6 > 4 & <3",
    "<!DOCTYPE html><?xml x?>t<br/>u<hr / >v": "tuv",
    "<scripted>kept</scripted><titles>also</titles>": "keptalso",
    "<a href=\"open>quote": "",
    "": "",
}


@pytest.mark.parametrize("text", CASES)
def test_cases(spark, text):
    assert spark.createDataFrame([(text,)], "t string").select(strip_markup("t")).first()[0] == CASES[text]


def plain(text):
    """The same by a loop over characters with a state."""
    out, at = [], 0

    def tag_end(i):
        while i < len(text) and text[i] != ">":
            if text[i] in "'\"":
                close = text.find(text[i], i + 1)
                if close < 0:
                    return len(text)
                i = close
            i += 1
        return i + 1

    while at < len(text):
        if text.startswith("<!--", at):
            end = text.find("-->", at + 4)
            at = len(text) if end < 0 else end + 3
        elif text[at] == "<" and re.match(r"</?[A-Za-z]", text[at:]):
            name = re.match(r"<(script|style|textarea|title)(?=[\s/>]|\Z)", text[at:], re.I)
            at = tag_end(at + 2)
            if name:
                close = re.compile(rf"</{name[1]}\s*>", re.I).search(text, at)
                if name[1].lower() in PLAIN:
                    out.append(text[at : close.start() if close else len(text)])
                at = close.end() if close else len(text)
        elif text[at] == "<" and text[at + 1 : at + 2] in ("!", "?"):
            end = text.find(">", at)
            at = len(text) if end < 0 else end + 1
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def test_random_texts_equal_a_plain_reader(spark):
    assert RAW == ("script", "style")
    rng = random.Random(9)
    parts = ["<b>", "</b>", "<", ">", "x", " ", '"', "'", "<!--", "-->", "<script>", "</script>", "<title a='", "</title>", "<textarea>", "</TEXTAREA >", "<p q=\"", "/", "<!d>", "\n", "<style", "é"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", strip_markup("t").alias("s")).collect()
    for r in rows:
        assert r["s"] == plain(texts[r["i"]]), texts[r["i"]]


def test_long_tags(spark):
    long = "a<b " + "x='>' y=1 " * 50_000 + ">b" + "<!-- " + "-" * 200_000 + "-->c"
    assert spark.createDataFrame([(long,), (None,)], "t string").select(strip_markup("t")).collect() == [("abc",), (None,)]

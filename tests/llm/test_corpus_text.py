"""Secret scans, fingerprints, BPE, line dedup and packing on small documents and edge cases."""

import hashlib
import json
import random
import re
import zlib
from collections import defaultdict

import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sectorlens.llm import bpe, fingerprints, lines, packing, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
KEY = "AKIA" + "Q7" * 8
HEX = "0123456789abcdef" * 2 + "0f"
EDGE = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, "password = hunter2hunter2 and " + KEY, "en", None, 1),
    (3, "password = hunter2hunter2 and " + KEY, "en", None, 1),
    (None, "token:" + HEX, "fr", "s", None),
    (5, "é日本 😀\n" * 3, "de", "s", 7),
    (6, "word " * 30_000 + "PassWd='" + "Zz" * 9 + "'", "en", "s", 9),
    (7, "<|endoftext|>x <|endoftext|>", "en", "s", 9),
]


@pytest.fixture(scope="module")
def edge(spark):
    """Edge cases, with columns whose names clash with those the operators add."""
    docs = spark.createDataFrame(EDGE, SCHEMA)
    return docs.withColumns({c: F.lit("x") for c in ("id", "key", "digest", "line", "spans", "ids", "length", "part", "c1", "c0", "drops")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_spans(text, rules):
    out = []
    for i, rule in enumerate(rules):
        flags = re.ASCII | (re.IGNORECASE if rule.ignore_case else 0)
        out += [(m.start(), i, m.end()) for m in re.finditer(rule.pattern, text or "", flags) if len(m[rule.group]) >= rule.least]
    return sorted(out)


def test_secrets_against_full_scans(spark, edge):
    rng = random.Random(3)
    bits = [
        "password", "PASSWD", "api_key", "ApiKey", "secret", "token", "pass", "=", ":", " ", '"', "'", KEY, "AKIA", "akia", "AKIAKIA",
        HEX, "deadbeef", "ghp_" + "a1" * 18, "xoxb-12345678901", "eyJabcdefghij.eyJabcdefghij.abcdefgh", "AIza" + "b" * 35,
        "-----BEGIN RSA PRIVATE KEY-----", "sk_live_" + "x" * 16, "ſecret", "toKen", "é", "\n", "abcdefgh1", "x.y/z+w=",
    ]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in secrets.digest(docs.union(edge.where("doc_id = 6").select("doc_id", "text"))).collect():
        text = texts[r["doc_id"]] if r["spans"].count("assign:150") == 0 else EDGE[6][1]
        want = plain_spans(text, secrets.RULES)
        assert r["spans"] == ",".join(f"{secrets.RULES[k].kind}:{s}:{e}" for s, k, e in want)
        base = ",".join(f"{secrets.RULES[k].kind}:{s}:{e}" for s, k, e in want if k < 3)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == i for _, k, _ in want) for i in range(3)]


def test_trigram_queries():
    by_kind = {r.kind: secrets.trigram_query(r) for r in secrets.RULES}
    assert by_kind["hex"] == secrets.ALL
    assert secrets.grams_of(by_kind["access"]) == {"aki", "kia"}
    assert {"pas", "tok", "api", "ike"[::-1][::-1], "sec"} - {"ike"} <= secrets.grams_of(by_kind["assign"])
    assert secrets.trigram_query(secrets.Rule("x", r"(abc|d)e")) == secrets.ALL
    assert secrets.trigram_query(secrets.Rule("x", r"[a-z]+foobar")) != secrets.ALL


def test_secrets_edge_cases(edge, empty):
    rows = secrets.digest(edge).collect()
    assert len(rows) == len(EDGE)
    by = {r["doc_id"]: r for r in rows}
    nothing = hashlib.sha256(b"").hexdigest()
    assert by[1]["base_sha256"] == by[2]["base_sha256"] == nothing and by[1]["spans"] == ""
    assert by[3]["n_assign"] == 1 and by[3]["n_access"] == 1 and by[None]["n_hex"] == 1 and by[6]["n_assign"] == 1
    assert secrets.digest(empty).collect() == []
    redacted = secrets.redact(edge)
    assert redacted.columns == edge.columns
    texts = {r["doc_id"]: r["text"] for r in redacted.collect()}
    assert texts[1] is None and texts[3] == "[assign] and [access]" and texts[5] == EDGE[5][1]
    assert {r["secret"] for r in secrets.scan(edge).where("doc_id = 3").collect()} == {"password = hunter2hunter2", KEY}


PIECES = ["a", "b", "'", "'s", "'re", "'LL", " ", "  ", "\n", "\t", "1", "²", "é", "日", "!", "…", "\u00a0", "\u2003", "😀", "e\u0301",
          " the", "<|endoftext|>", "<|endof", "\x1c", "\x85", "\u200b", "aaaa", "\U0001d7d8", "ingly", "0x1F"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=20).map("".join), min_size=1, max_size=30))
def test_bpe_equals_the_library(texts):
    import numpy as np

    library = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    merged = bpe.merged_of(bpe.vocabulary_path())
    raw = [t.encode() for t in texts]
    bounds = np.r_[0, np.cumsum([len(r) for r in raw])]
    ids, places = bpe.encode(np.frombuffer(b"".join(raw), np.uint8), bounds, merged)
    for i, text in enumerate(texts):
        own = ids[places[i] : places[i + 1]].tolist()
        assert own == library.encode(text, add_special_tokens=False).ids
        assert bpe.decode(np.array(own, np.int64), merged.vocabulary) == library.decode(own, skip_special_tokens=False)


def test_bpe_documents(edge, empty):
    library = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    rows = bpe.round_trip(edge).collect()
    assert len(rows) == len(EDGE)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, *_ in EDGE}
    for r in rows:
        ids = want[r["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(empty).collect() == []
    back = bpe.decode_column(bpe.encode_column(edge)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((i or 0, t or "") for i, t, *_ in EDGE)


def test_cache_of_pre_tokens_is_emptied():
    import numpy as np

    small = bpe.Merged(bpe.load_vocabulary(bpe.vocabulary_path()), most=3)
    large = bpe.merged_of(bpe.vocabulary_path())
    for text in ("one two three", "four five six seven", "one two eight nine ten"):
        raw = np.frombuffer(text.encode(), np.uint8)
        bounds = np.array([0, len(raw)])
        assert bpe.encode(raw, bounds, small)[0].tolist() == bpe.encode(raw, bounds, large)[0].tolist()


def test_patterns_place_every_piece():
    rng = random.Random(5)
    for size in (8, 64, 1024):
        histogram = {k: rng.randint(1, 500) for k in rng.sample(range(1, size + 1), min(size, 60))}
        patterns = packing.patterns_of(histogram, size)
        placed = defaultdict(int)
        for count, lengths in patterns:
            assert sum(lengths) <= size and count > 0
            for length in lengths:
                placed[length] += count
        assert placed == histogram
        assert len(patterns) <= 2 * len(histogram)
    assert packing.patterns_of({}, 8) == []
    # Shortest pack first: the 3 goes to the pack of 4 and not to that of 5.
    assert sorted(packing.patterns_of({5: 1, 4: 1, 3: 1}, 8)) == [(1, (4, 3)), (1, (5,))]


def check_packed(rows, tokens_of, size):
    spans, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    assert sorted(spans) == list(range(len(spans)))
    for own in spans.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= size
    for doc_id, own in pieces.items():
        ids = tokens_of[doc_id]
        repeats = len(own) // -(-len(ids) // size)
        assert sum(r["length"] for r in own) == repeats * len(ids)
        for r in own:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["doc_tokens"] == len(ids) and r["length"] == len(part)
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))


def test_packing(spark, edge, empty):
    library = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    tokens = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t, *_ in EDGE}
    rows = packing.pack(edge.repartition(3)).collect()
    check_packed(rows, tokens, packing.SIZE)
    assert packing.pack(empty).collect() == []
    short = packing.pack(edge, size=16, with_ids=True)
    check_packed(short.collect(), tokens, 16)
    joined = packing.assemble(short, size=16, pad=-1).collect()
    assert sum(i != -1 for r in joined for i in r["ids"]) == sum(len(tokens[i]) for i, *_ in EDGE)
    for r in joined:
        own = [i for i in r["ids"] if i != -1]
        assert len(r["ids"]) == (len(own) if len(own) & (len(own) - 1) == 0 else 16)


def plain_terms(text):
    return {w for w in re.split(r"[^\W_]+(?<!_)|_", text.lower())}


def test_fingerprints(spark, edge, empty):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnprst"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 300]))) for _ in range(60)]
    texts[10] = texts[3]
    docs = spark.createDataFrame([(7 * i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in fingerprints.fingerprints(docs, band=(0.0, 99.0)).collect()}
    order = sorted(rows, reverse=True)
    for i, doc_id in enumerate(order):
        own, after = texts[doc_id // 7], texts[order[(i + 1) % len(order)] // 7]
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        r = rows[doc_id]
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert rows[30 * 1 if False else 21]["fingerprint"] == rows[70]["fingerprint"]
    assert rows[21]["fingerprint"] != rows[14]["fingerprint"]
    long = [d for d in rows if len(texts[d // 7].split()) == 300]
    assert sum(rows[d]["near_edited"] for d in long) > 0


def test_fingerprints_edge_cases(spark, edge, empty):
    rows = fingerprints.fingerprints(edge).collect()
    assert len(rows) == len(EDGE)
    assert fingerprints.fingerprints(empty).collect() == []
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_chars"] == 0 and by[1]["fingerprint"] == by[2]["fingerprint"]
    assert len({r["fingerprint"] for r in rows if r["doc_id"] == 3}) == 1
    # Descending ids, nulls last; the two equal rows of 3 are one document in the order.
    assert by[1]["near_next"] < 1 and by[2]["near_next"] == 1.0
    alone = fingerprints.fingerprints(spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")).collect()[0]
    assert alone["edited_sha256"] == hashlib.sha256(b"ab ab").hexdigest() and alone["near_next"] == 1.0


def test_lexicon_band(spark):
    texts = spark.createDataFrame([(f"common w{i} pair{i // 2}",) for i in range(40)], "text string")
    count = lambda bitmap: sum(bin(x & (1 << 64) - 1).count("1") for x in bitmap)
    import math

    assert count(fingerprints.lexicon_of(texts, band=(0.0, 99.0))) == 61
    assert count(fingerprints.lexicon_of(texts, band=(math.log(40 / 2), math.log(40 / 2)))) == 20
    assert count(fingerprints.lexicon_of(texts, band=(0.0, 0.1))) == 1


def test_boilerplate_lines_are_dropped(spark, edge, empty):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    own = lambda: " ".join(word() for _ in range(14))
    docs, boiler = [], "All rights reserved by the owner"
    for i in range(30):
        text = [own(), boiler, f"Posted on {i} May by member {word()} in the public forum today", own(), f"Page {i} of {i + 3}", "Ok"]
        docs.append((i, "\n".join(text)))
    copied = "\n".join(own() for _ in range(5))
    docs += [(100 + i, copied) for i in range(20)]  # copies aren't boilerplate
    near = [own() for _ in range(12)]
    for i in range(20):
        changed = near[:]
        changed[i % 12] = own()
        docs.append((200 + i, "\n".join(changed)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: r for r in lines.drop_recurring(table, n_lines="n", n_dropped="gone").collect()}
    assert len(out) == len(docs)
    for doc_id, text in docs[:30]:
        parts = text.split("\n")
        assert out[doc_id]["text"] == "\n".join([parts[0], parts[3], "Ok"]), out[doc_id]["text"]
        assert (out[doc_id]["n"], out[doc_id]["gone"]) == (6, 3)
    for doc_id, text in docs[30:]:
        assert out[doc_id]["text"] == text


def plain_exact_lines(docs, shapes):
    """Lines whose masked form occurs in enough documents, when no line can be generalised."""
    seen = defaultdict(set)
    for _, text in docs:
        for line in text.split("\n"):
            tokens = tuple("#" if re.search("[0-9]", t) else t for t in line.split())
            if len(tokens) >= lines.SHORTEST:
                seen[tokens].add(text)
    return {t for t, texts in seen.items() if len(texts) >= shapes}


def test_lines_against_plain_counting(spark):
    rng = random.Random(4)
    pool = [" ".join(f"w{''.join(rng.choice('abcdef') for _ in range(5))}" for _ in range(5)) for _ in range(60)]
    docs = []
    for i in range(80):
        body = [" ".join("".join(rng.choice("klmnop") for _ in range(7)) for _ in range(30)) for _ in range(2)]
        docs.append((i, "\n".join([*body, *rng.sample(pool, rng.randint(0, 12)), ""])))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in lines.drop_recurring(table).collect()}
    assert out == {r["doc_id"]: r["text"] for r in lines.drop_recurring(table, listed=0).collect()}
    gone = plain_exact_lines(docs, lines.SHAPES)
    assert 0 < len(gone) < 60
    for doc_id, text in docs:
        assert out[doc_id] == "\n".join(x for x in text.split("\n") if tuple(x.split()) not in gone)


def test_lines_edge_cases(edge, empty):
    out = lines.drop_recurring(edge)
    assert out.columns == edge.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, edge.collect()))
    assert lines.drop_recurring(empty).collect() == []


def test_queries_need_no_other_package():
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "sectorlens")):
        for name in names:
            path = os.path.join(folder, name)
            if name.endswith(".py") and f"{os.sep}llm" not in folder:
                assert "sectorlens.llm" not in open(path).read(), path
    assert json.loads("[]") == []


def unlike(rng, words):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(words))


def test_lines_of_long_passages_and_of_copies_are_dropped(spark):
    rng = random.Random(6)
    passage = [unlike(rng, 15) for _ in range(4)]
    docs = [(i, "\n".join([*passage, unlike(rng, 40)])) for i in range(60)]  # 60 % passage
    common, base = "Printed with the kind permission of nobody", [unlike(rng, 14) for _ in range(12)]
    docs += [(100 + i, "\n".join([common, unlike(rng, 60)])) for i in range(20)]
    for i in range(100):  # near copies that differ, with the line of the others
        changed = base[:]
        changed[i % 12] = unlike(rng, 14)
        docs.append((200 + i, "\n".join([common, *changed])))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in lines.drop_recurring(table).collect()}
    for doc_id, text in docs:
        parts = text.split("\n")
        assert out[doc_id] == "\n".join(parts[4:] if doc_id < 100 else parts[1:]), doc_id


def test_several_templates_share_a_leaf(spark):
    rng = random.Random(8)
    later = [unlike(rng, 10).split() for _ in range(4)]
    docs = []
    for i in range(96):  # four templates and as many unrelated lines of the same leaf
        words = later[i % 4][:]
        for place in (2, 5, 9):
            words[place] = unlike(rng, 1)
        docs.append((i, "\n".join([unlike(rng, 40), f"{i} {i + 1} {i + 2} " + " ".join(words), f"7 8 {i} {unlike(rng, 10)}"])))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (lines.BLOCK, 10):
        out = {r["doc_id"]: r["text"] for r in lines.drop_recurring(table, block=block).collect()}
        for doc_id, text in docs:
            parts = text.split("\n")
            assert out[doc_id] == "\n".join([parts[0], parts[2]]), (block, doc_id)

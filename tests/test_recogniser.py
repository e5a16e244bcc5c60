"""The entity recogniser on planted sentences, and its fold against plain Viterbi."""

import math
import random

from sectorlens.operators import recogniser as rec

STEMS = ["Alder", "Bram", "Corin", "Dunmor", "Ester", "Farring", "Glen", "Holl", "Inver", "Kelm", "Lang", "Mar", "Nor", "Oxen", "Penn", "Quorn"]
PLACES = [s + e for s in STEMS for e in ("ville", "burgh", "land")]
FIRMS = [s + e for s in STEMS for e in ("tech", "corp")]
PATTERNS = [
    "We make small parts in {p} for many buyers.", "{f} sells paint and glue.", "Our shop in {p} opened early.", "The firm {f} of {p} builds boats.",
    "Visit us near {p} or call the sales team.", "Good food is sold by {f} every day.", "Most work is done at home.", "It supplies {f} with steel.",
]


def made(seed, places, firms, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text, truth = [], []
        for _ in range(rng.randint(1, 4)):
            p, f = rng.choice(places), rng.choice(firms)
            line = rng.choice(PATTERNS)
            text.append(line.format(p=p, f=f))
            truth += [w for w in (p if "{p}" in line else None, f if "{f}" in line else None) if w]
        out.append((i, " ".join(text), truth))
    return out


def test_unseen_names_are_found(spark):
    rng = random.Random(1)
    places, firms = PLACES[:], FIRMS[:]
    rng.shuffle(places)
    rng.shuffle(firms)
    known_places, known_firms = places[:30], firms[:20]
    train = made(2, known_places, known_firms, 300)
    names = [([w], "GPE") for w in known_places] + [([w], "ORG") for w in known_firms]
    texts = spark.createDataFrame([r[:2] for r in train], "org_id long, description string")
    gazetteer = spark.createDataFrame(names, "tokens array<string>, kind string")
    model, symbols = rec.learn(rec.tag_names(rec.sentences(texts), gazetteer))
    asked = made(3, places[30:], firms[20:], 150)
    table = spark.createDataFrame([r[:2] for r in asked], "org_id long, description string")
    found = rec.recognise(rec.sentences(table), model, symbols).collect()
    right = told = true = 0
    kinds = dict.fromkeys(places, "GPE") | dict.fromkeys(firms, "ORG")
    for r in found:
        for token, tag in zip(r["tokens"], r["tags"]):
            told += tag != rec.OUTSIDE
            true += token in kinds
            right += kinds.get(token) == tag
    assert true == sum(len(r[2]) for r in asked)
    assert right / told >= 0.95 and right / true >= 0.9


def plain_viterbi(tokens, model, own, forms):
    tags, scores, back = model["tags"], None, []
    for i, token in enumerate(tokens):
        logs = own.get(token) or forms.get(form_of(token, i == 0)) or [0.0] * len(tags)
        if scores is None:
            ways = [(round(model["begin"][t], 9), 0) for t in range(len(tags))]
        else:
            ways = [max((round(scores[b] + model["moves"][b][t], 9), -b) for b in range(len(tags))) for t in range(len(tags))]
        back.append([-b for _, b in ways])
        scores = [s + x for (s, _), x in zip(ways, logs)]
    at = -max((round(s, 9), -i) for i, s in enumerate(scores))[1]
    path = [at]
    for row in reversed(back[1:]):
        at = row[at]
        path.append(at)
    return [tags[p] for p in reversed(path)]


def form_of(token, first):
    if token.upper() == token.lower():
        case = "9" if token[0].isnumeric() else "."
    elif token == token.upper() and len(token) > 1:
        case = "XX"
    else:
        case = "Xx" if token[0] != token[0].lower() else "x"
    return "|".join([case, "" if token.upper() == token.lower() else token.lower()[-3:], "1" if first else "0"])


def test_fold_equals_plain_viterbi_and_counts(spark):
    train = made(4, PLACES[:12], FIRMS[:9], 60)
    texts = spark.createDataFrame([r[:2] for r in train] + [(900, None), (901, ""), (902, " . ")], "org_id long, description string")
    names = spark.createDataFrame(
        [([w], "GPE") for w in PLACES[:12]] + [([w], "ORG") for w in FIRMS[:9]] + [(["sales", "team"], "X"), (["sales"], "Y"), ([], "Z")],
        "tokens array<string>, kind string",
    )
    tagged = rec.tag_names(rec.sentences(texts), names).cache()
    rows = tagged.collect()
    assert any(t == "X" for r in rows for t in r["tags"]) and not any(t == "Y" for r in rows for t in r["tags"])
    pairs = {}
    for r in rows:
        for a, b in zip([rec.BEGIN, *r["tags"]], r["tags"]):
            pairs[a, b] = pairs.get((a, b), 0) + 1
    assert {(r["before"], r["tag"]): r["n"] for r in rec.transition_counts(tagged).collect()} == pairs
    model, symbols = rec.learn(tagged)
    one = model.first()
    for b, before in enumerate(one["tags"]):
        total = sum(n for (a, _), n in pairs.items() if a == before)
        for t, tag in enumerate(one["tags"]):
            want = math.log((pairs.get((before, tag), 0) + rec.SMOOTH) / (total + rec.SMOOTH * len(one["tags"])))
            assert abs(one["moves"][b][t] - want) < 1e-9
    known = symbols.collect()
    own, forms = ({r["symbol"]: r["logs"] for r in known if r["whole"] == w} for w in (True, False))
    asked = [(i, t) for i, t, _ in made(5, PLACES, FIRMS, 40)] + [(77, "ÉTÉ 12 x9 !!")]
    table = spark.createDataFrame(asked, "org_id long, description string")
    got = rec.recognise(rec.sentences(table), model, symbols).collect()
    assert len(got) > 40
    for r in got:
        assert r["tags"] == plain_viterbi(r["tokens"], one, own, forms)


def test_entities_replaced(spark):
    rows = [(1, 0, ["In", "New", "York", "now"], ["O", "GPE", "GPE", "O"]), (1, 1, ["Acme"], ["ORG"])]
    tagged = spark.createDataFrame(rows, "org_id long, sentence int, tokens array<string>, tags array<string>")
    assert rec.replace_entities(tagged).collect() == [(1, "In GPE now ORG")]
    empty = spark.createDataFrame([], "org_id long, description string")
    model, symbols = rec.learn(rec.tag_names(rec.sentences(empty), spark.createDataFrame([], "tokens array<string>, kind string")))
    assert rec.recognise(rec.sentences(empty), model, symbols).collect() == []

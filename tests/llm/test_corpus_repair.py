"""Conversation repair against plain recursion over every conversation."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from sectorlens.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = {"su", "ua", "au"}
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def plain_edits(rows):
    """Least (cost, audit) of (initial, mark) rows, by recursion over (row, last role) with at most two insertions in turn."""

    @lru_cache(None)
    def go(i, last, inserted):
        options = [(0, "")] if i == len(rows) and last in ("", "a") else []

        def option(cost, letter, rest):
            if rest is not None:
                options.append((cost + rest[0], letter + rest[1]))

        for new in "ua":
            if (last, new) in STEP and inserted < 3:
                option(2, "I", go(i, new, inserted + 1))
        if i < len(rows):
            letter, mark = rows[i]
            option(3, "D", go(i + 1, last, 0))
            if mark not in ("blank", "duplicate"):
                late = mark == "truncated"
                if (last, letter) in STEP:
                    option(late, "K", go(i + 1, letter, 0))
                for new in "ua":
                    if (last, new) in STEP:
                        option(2 + late, "R", go(i + 1, new, 0))
        return min(options) if options else None

    return go(0, "", 0)


def plain_repair(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in plain_damage([r for r in rows if r[0] == conv])]
        md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], md5(md5(r[1]) + r[2])))
        seen, faults = set(), []
        for _, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "none")
            seen.add((role, text))
        turns = [t for t, *_ in own if t is not None]
        cost, audit = plain_edits(tuple((r[1][:1], f) for r, f in zip(own, faults)))
        text, last, i = [], "", 0
        for e in audit:
            if e == "I":
                last = "u" if last != "u" else "a"
                text.append({"u": "user:", "a": "assistant:"}[last])
                continue
            _, role, body = own[i]
            i += 1
            if e == "D":
                continue
            if e == "K":
                last = role[:1]
            else:
                last = "u" if last != "u" else "a"
                role = {"u": "user", "a": "assistant"}[last]
            text.append(f"{role}:{body}")
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(own, own[1:])),
            cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest(),
        )
    return out


def found(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[n] for n in names) for r in rows}
    assert len(out) == len(rows)
    return out


def made():
    rng = random.Random(8)
    texts = ["Yes.", "No", "Why?", "", " \n", "a b!", "Größe. \t", "x" * 3000 + ".", "end.\n\n"]

    def rows(conv, n):
        out = []
        for turn in range(n):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            out.append((conv, turn if rng.random() < 0.95 else None, role, rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randint(0, 30)}."))
        if rng.random() < 0.4:
            out.insert(0, (conv, -1, "system", "Be brief."))
        return out

    out = [r for conv in range(150) for r in rows(conv, rng.randint(1, 9))]
    out += rows(500, 90) + rows(501, 33) + rows(None, 20)
    out += [(600, 1, None, None), (600, None, "tool", "t."), (600, None, "user", "t."), (601, None, None, None), (602, 3, "", "q."), (602, 3, "", "q.")]
    out += [(603, t, "assistant", "same.") for t in range(40)]
    return out


@pytest.mark.parametrize("piece", [3, repair.PIECE])
def test_repair_equals_plain_recursion(spark, piece):
    rows = made()
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    clash = {c: F.lit("x") for c in ("row", "key", "part", "seq", "done", "messages", "code", "cost", "_id", "before", "first")}
    assert found(repair.repair_damaged(table.withColumns(clash), piece)) == plain_repair(rows)


def test_conversations_across_tasks(spark):
    """Ranges cut long conversations, and equal rows may lie in several tasks."""
    rows = [r for r in made() if r[0] in (500, 501, 603, None)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert found(repair.repair_damaged(spark.createDataFrame(rows, SCHEMA))) == plain_repair(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_empty_table(spark):
    assert repair.repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repaired_messages_are_whole(spark):
    """The operator's own output: rows in order, roles that alternate, no blank or repeated row kept."""
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There?"), (1, 2, "assistant", " "), (1, 3, "assistant", "Yes"), (2, 0, "assistant", "Hm.")]
    got = {r["conv_id"]: r for r in repair.repair(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [tuple(m) for m in got[1]["messages"]] == [("user", "Hi."), ("assistant", ""), ("user", "There?"), ("assistant", "Yes")]
    assert got[1]["audit"] == "KIKDK" and got[1]["cost"] == 6
    assert [tuple(m) for m in got[2]["messages"]] == [("user", ""), ("assistant", "Hm.")] and got[2]["audit"] == "IK"


def test_search_equals_recursion_between_all_states():
    rng = random.Random(2)
    marks = {"x": "blank", "t": "truncated", ".": "none"}
    for n in [*range(9)] * 40:
        rows = "".join(rng.choice("suaua-") + rng.choice("xt...") for _ in range(n))
        plain = plain_edits(tuple((a, marks[b]) for a, b in zip(rows[::2], rows[1::2])))
        assert repair.cheapest(rows, repair.START, repair.WHOLE) == plain
        middle = 2 * (n // 2)
        chain = repair.Chain()
        for part in (rows[:middle], rows[middle:]):
            all_ways = [repair.cheapest(part, a, (b,)) for a in range(4) for b in range(4)]
            chain.add(0, 0, [w and w[0] for w in all_ways], [w and w[1] for w in all_ways])
        ways = list(chain.path())[::-1]
        assert [w[3] for w in ways[:-1]] == [w[2] for w in ways[1:]]
        halves = [repair.cheapest(p, w[2], (w[3],)) for p, w in zip((rows[:middle], rows[middle:]), ways)]
        assert (sum(h[0] for h in halves), "".join(h[1] for h in halves)) == plain


def test_bounds_never_exceed_the_cost():
    rng = random.Random(4)
    for _ in range(300):
        rows = "".join(rng.choice("sua-") + rng.choice("xt..") for _ in range(rng.randint(0, 10)))
        for i, bound in enumerate(repair.suffix_bounds(rows)):
            ways = [repair.cheapest(rows[2 * i :], a, (b,)) for a in range(4) for b in range(4)]
            assert bound <= min(w[0] for w in ways if w)

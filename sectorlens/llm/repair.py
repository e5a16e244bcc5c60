"""Conversation structure repair: the cheapest edits that make roles alternate and rows whole.

Rows of a conversation go by turn (nulls first), then role and a hash of role and text. A row's first
fault counts: blank text, a repetition of an earlier row, a text that ends in no `.`, `!` or `?`.
Edits keep a row (0), give it the role user or assistant (2), delete it (3, required for blank and
repeated rows) or insert an empty user or assistant row (2); a truncated row that stays adds 1. The
repaired roles read `(s?(ua)+)?`. Of the cheapest edits the ASCII-least initials (D, I, K, R) win.

The edits are found by depth-first branch and bound with an explicit stack. A suffix bound adds what
the remaining rows cost at least; the incumbent is the best finished (cost, audit); a table per node
(row, role before it) drops prefixes that a cheaper, or equally cheap and smaller, one dominates.

Rows are dealt by ranges of conversation and turn, so a conversation of any size is spread over
tasks. One that lies whole in a task and in one piece is repaired there. Others are cut into pieces
of at most `PIECE` rows: a piece is searched for every role before and after it, the pieces' results
are chained (a role and a few letters per piece), and the chosen edits go back to the pieces. Equal
costs compare right piece by piece, as of two audits to the same node with equal cost neither begins
the other. Only a digest of a whole conversation has to stream through one task, piece by piece.

Null roles and texts count as one space, so such rows are deleted or get a role. A role that begins
with no s, u or a can't be kept. Repeated rows are duplicates. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorlens.session import cut

PIECE = 32
PIECE_CHARS = 1 << 22
BLANKS = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
LEGAL = ("su", "ua", "au")
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
AFTER_INSERT = (USER, USER, ASSISTANT, USER)  # the row that may follow each state, with the state it leads to
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
REACHED_BY = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
WHOLE = (START, ASSISTANT)  # states in which a conversation may end


# The search. A row is a letter (role initial, `-` for any other) and a mark: `x` must go, `t` truncated, `.` neither.


def suffix_bounds(rows: str) -> list[int]:
    """What the rows from each place on cost at least.

    Forced deletions and truncated rows cost their own; two rows that stay neighbours against the
    order of roles need an edit of one of them or an insertion between, and such pairs are disjoint.
    """
    own = [{"x": 3, "t": 1, ".": 0}[m] for m in rows[1::2]]
    letters, n = rows[0::2], len(own)
    bound = [0] * (n + 1)
    after: int | None = None  # the next row that may stay
    pairs = [0] * (n + 1)  # cost of disjoint pairs from here on
    forced = 0
    for i in range(n - 1, -1, -1):
        forced += own[i]
        pairs[i] = pairs[i + 1]
        if rows[2 * i + 1] != "x":
            if after is not None and letters[i] + letters[after] not in LEGAL:
                pairs[i] = max(pairs[i], 2 + pairs[after + 1])
            after = i
        bound[i] = forced + pairs[i]
    return bound


@lru_cache(maxsize=4096)
def cheapest(rows: str, entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """The least (cost, audit) that leads from the state ``entry`` through the rows to one of the ``exits``."""
    n, bound = len(rows) // 2, suffix_bounds(rows)
    best: tuple[int, str] | None = None
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if best is not None and (cost + bound[i], audit) > (best[0], best[1][: len(audit)]):
            continue
        known = table.get((i, state))
        if known is not None and known <= (cost, audit):
            continue
        table[i, state] = cost, audit
        if i == n and state in exits and (best is None or (cost, audit) < best):
            best = cost, audit
        nodes = [(i, AFTER_INSERT[state], cost + 2, audit + "I")]
        if i < n:
            letter, mark = rows[2 * i], rows[2 * i + 1]
            nodes.append((i + 1, state, cost + 3, audit + "D"))
            if mark != "x":
                extra = mark == "t"
                kept = REACHED_BY.get((letter, state))
                if kept is not None:
                    nodes.append((i + 1, kept, cost + extra, audit + "K"))
                nodes.append((i + 1, AFTER_INSERT[state], cost + 2 + extra, audit + "R"))
        nodes.sort(key=lambda node: (node[2] + bound[node[0]], node[3]), reverse=True)
        stack += nodes
    return best


def apply_edits(audit: str, entry: int, messages: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The repaired (role, text) rows; the state before the first row tells the roles of inserted and changed ones."""
    out, state, rows = [], entry, iter(messages)
    for edit in audit:
        if edit == "I":
            state = AFTER_INSERT[state]
            out.append((ROLE_OF[state], ""))
            continue
        role, text = next(rows)
        if edit == "K":
            state = REACHED_BY[role[:1], state]
            out.append((role, text))
        elif edit == "R":
            state = AFTER_INSERT[state]
            out.append((ROLE_OF[state], text))
    return out


# Faults and counts of a run of rows.


def marked(messages: list[tuple[str, str]], keys: list[str], before: set[str]) -> tuple[str, list[int]]:
    """The rows as letters and marks, and how many are blank, repeated and truncated; ``before`` are keys of earlier rows."""
    seen, out, counts = set(before), [], [0, 0, 0]
    for (role, text), key in zip(messages, keys):
        body = text.rstrip(BLANKS)
        fault = 0 if not body else 1 if key in seen else 2 if not body.endswith(ENDS) else None
        seen.add(key)
        if fault is not None:
            counts[fault] += 1
        out.append((role[:1] if role[:1] in tuple("sua") else "-") + {0: "x", 1: "x", 2: "t", None: "."}[fault])
    return "".join(out), counts


def span(messages: list[tuple[str, str]], turns: list[int | None]) -> dict:
    """What two neighbouring runs of rows need to add up their gaps and illegal neighbours."""
    known = [t for t in turns if t is not None]
    letters = [role[:1] for role, _ in messages]
    return {
        "low": known[0] if known else None,
        "high": known[-1] if known else None,
        "distinct": len(set(known)),
        "illegal": sum(a + b not in LEGAL for a, b in zip(letters, letters[1:])),
        "first": letters[0],
        "last": letters[-1],
    }


COUNTS = ("blank", "duplicate", "truncated")
MESSAGES = "array<struct<role:string,text:string>>"
_SPAN = "low long, high long, distinct long, illegal long, first string, last string"
_ARROW = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(),
    MESSAGES: pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])),
    "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()),
}


class Rows:
    """Rows of a stated schema, handed out as record batches of bounded size."""

    def __init__(self, schema: str, first: pa.DataType, limit: int = 1 << 23):
        fields = [f.strip().split(" ", 1) for f in schema.split(", ")]
        self.schema = pa.schema([(fields[0][0], first), *[(name, _ARROW[kind]) for name, kind in fields[1:]]])
        self.limit, self.held, self.size = limit, [], 0

    def add(self, row: dict, size: int = 64):
        self.held.append(row)
        self.size += size

    def ready(self, end: bool = False):
        if self.size >= self.limit or end and self.held:
            yield pa.RecordBatch.from_pylist(self.held, self.schema)
            self.held, self.size = [], 0


def _flat(batch: pa.RecordBatch) -> list[dict]:
    """Rows whose message structs are pairs."""
    rows = batch.to_pylist()
    for row in rows:
        if row.get("messages") is not None:
            row["messages"] = [(m["role"], m["text"]) for m in row["messages"]]
    return rows


def _stored(messages: list[tuple[str, str]]) -> list[dict]:
    return [{"role": r, "text": t} for r, t in messages]


def ordered(turns: DataFrame) -> DataFrame:
    """The rows dealt by ranges of conversation and turn, and sorted there."""
    chosen = turns.select(
        "conv_id",
        F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("key", F.md5(F.concat(F.md5("role"), F.col("text"))))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("key"), F.col("row")]
    return chosen.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")


def pieces(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """Runs of rows of one conversation, in order by (part, seq); those of whole conversations are repaired already.

    ``done`` tells them. Of the others ``messages`` are still the rows as they came, with their keys.
    """
    schema = (
        f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, part int, seq int, done boolean, "
        f"blank long, duplicate long, truncated long, {_SPAN}, cost long, audit string, messages {MESSAGES}, keys array<string>"
    )

    def rows(batches):
        out, part, seq = None, TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size, head, conv, started = 0, False, None, False

        def close(tail: bool):
            nonlocal held, size, seq, head
            messages, keys = [(r, t) for _, r, t, _ in held], [k for *_, k in held]
            row = {"conv_id": conv, "part": part, "seq": seq, "done": head and tail, **span(messages, [t for t, *_ in held])}
            if row["done"]:
                marks, counts = marked(messages, keys, set())
                row["cost"], row["audit"] = cheapest(marks, START, WHOLE)
                row |= dict(zip(COUNTS, counts)) | {"messages": _stored(apply_edits(row["audit"], START, messages)), "keys": None}
            else:
                row |= {"messages": _stored(messages), "keys": keys}
            out.add(row, size + 128 * len(held))
            held, size, head, seq = [], 0, False, seq + 1

        for batch in batches:
            out = out or Rows(schema, batch.schema.field("conv_id").type)
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "key")]
            for own, turn, role, text, key in zip(*columns):
                if started and own != conv:
                    close(True)
                    head = True
                elif len(held) >= piece or size > PIECE_CHARS:
                    close(False)
                    yield from out.ready()
                conv, started = own, True
                held.append((turn, role, text, key))
                size += len(text)
            yield from out.ready()
        if started:
            close(False)
            yield from out.ready(end=True)

    return ordered(turns).mapInArrow(rows, schema)


def earlier_keys(parts: DataFrame) -> DataFrame:
    """``(part, seq, before)``: the keys of a piece that an earlier piece of its conversation holds."""
    each = parts.select("conv_id", F.struct("part", "seq").alias("at"), F.explode(F.array_distinct("keys")).alias("key"))
    first = each.groupBy(F.col("conv_id").alias("_conv"), F.col("key").alias("_key")).agg(F.min("at").alias("first"))
    again = each.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key"))).where("at > first")
    return again.groupBy("at.part", "at.seq").agg(F.collect_list("key").alias("before"))


def transitions(parts: DataFrame) -> DataFrame:
    """The pieces' counts, and the cheapest edits from every state before to every state after them."""
    schema = (
        f"conv_id {parts.schema['conv_id'].dataType.simpleString()}, part int, seq int, blank long, duplicate long, truncated long, "
        "costs array<int>, audits array<string>"
    )

    def rows(batches):
        out = None
        for batch in batches:
            out = out or Rows(schema, batch.schema.field("conv_id").type)
            for row in _flat(batch):
                marks, counts = marked(row["messages"], row["keys"], set(row["before"] or ()))
                found = [cheapest(marks, entry, (end,)) for entry in range(STATES) for end in range(STATES)]
                out.add(
                    {k: row[k] for k in ("conv_id", "part", "seq")} | dict(zip(COUNTS, counts))
                    | {"costs": [f and f[0] for f in found], "audits": [f and f[1] for f in found]},
                    32 * len(marks),
                )
            yield from out.ready()
        if out:
            yield from out.ready(end=True)

    joined = parts.select("conv_id", "part", "seq", "messages", "keys").join(earlier_keys(parts), ["part", "seq"], "left")
    return joined.select("conv_id", "part", "seq", "messages", "keys", "before").mapInArrow(rows, schema)


class Chain:
    """The cheapest edits up to a piece for each state after it, of which common beginnings are dropped."""

    def __init__(self):
        self.states: dict[int, tuple[int, str]] = {START: (0, "")}
        self.steps: list[tuple[int, int, dict[int, int]]] = []

    def add(self, part: int, seq: int, costs: list[int | None], audits: list[str | None]):
        after: dict[int, tuple[int, str]] = {}
        came: dict[int, int] = {}
        for entry, (cost, audit) in self.states.items():
            for end in range(STATES):
                i = STATES * entry + end
                if costs[i] is not None and (end not in after or (cost + costs[i], audit + audits[i]) < after[end]):
                    after[end], came[end] = (cost + costs[i], audit + audits[i]), entry
        shared = _common([audit for _, audit in after.values()])
        self.states = {end: (cost, audit[shared:]) for end, (cost, audit) in after.items()}
        self.steps.append((part, seq, came))

    def path(self):
        """(part, seq, state before, state after) of every piece, the last first."""
        end = min((s for s in self.states if s in WHOLE), key=lambda s: self.states[s])
        for part, seq, came in reversed(self.steps):
            yield part, seq, came[end], end
            end = came[end]


def _common(texts: list[str]) -> int:
    low, high = min(texts), max(texts)
    n = min(len(low), len(high))
    return next((i for i in range(n) if low[i] != high[i]), n)


def chained(found: DataFrame) -> DataFrame:
    """``(part, seq, entry, end)``: the states around each piece on its conversation's cheapest way."""
    order = [F.asc_nulls_first("conv_id"), F.col("part"), F.col("seq")]

    def rows(batches):
        out = Rows("part int, seq int, entry int, end int", pa.int32())
        chain, conv = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if chain is None or row["conv_id"] != conv:
                    if chain is not None:
                        for step in chain.path():
                            out.add(dict(zip(("part", "seq", "entry", "end"), step)))
                            yield from out.ready()
                    chain, conv = Chain(), row["conv_id"]
                chain.add(row["part"], row["seq"], row["costs"], row["audits"])
        if chain is not None:
            for step in chain.path():
                out.add(dict(zip(("part", "seq", "entry", "end"), step)))
                yield from out.ready()
        yield from out.ready(end=True)

    by_conversation = found.select("conv_id", "part", "seq", "costs", "audits").repartition("conv_id").sortWithinPartitions(*order)
    return by_conversation.mapInArrow(rows, "part int, seq int, entry int, end int")


REPAIRED = ("conv_id", "part", "seq", "done", *COUNTS, "low", "high", "distinct", "illegal", "first", "last", "cost", "audit", "messages")


def repair(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """The repaired conversations in pieces, most of them one: counts, ``cost``, ``audit`` and ``messages`` (role, text).

    Pieces of a conversation go by (part, seq); ``done`` tells that it has one only.
    """
    table = cut(pieces(turns, piece))
    parts = table.where(~F.col("done")).drop("cost", "audit", *COUNTS)
    found = cut(transitions(parts))
    place = F.col("entry") * STATES + F.col("end")
    chosen = found.join(chained(found), ["part", "seq"]).select(
        "part", "seq", *COUNTS, "entry", F.get("costs", place).cast("long").alias("cost"), F.get("audits", place).alias("audit")
    )
    names = [c for c in REPAIRED if c != "messages"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.select(*names, "messages").schema)

    def rows(batches):
        for batch in batches:
            messages = [_stored(apply_edits(r["audit"], r["entry"], r["messages"])) for r in _flat(batch.select(["audit", "entry", "messages"]))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(messages, _ARROW[MESSAGES])], [*names, "messages"]
            )

    edited = parts.join(chosen, ["part", "seq"]).select(*REPAIRED, "entry").mapInArrow(rows, schema)
    return table.where("done").select(*REPAIRED).unionByName(edited)


def digests(repaired: DataFrame) -> DataFrame:
    """A row per conversation: ``gaps``, the counts, ``cost``, ``audit`` and ``repaired_sha256``."""
    conv = repaired.schema["conv_id"].dataType.simpleString()
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0))
    written = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    names = ("gaps", *COUNTS, "illegal", "cost", "audit", "repaired_sha256")
    single = repaired.where("done").select("conv_id", gaps.alias("gaps"), *COUNTS, "illegal", "cost", "audit", F.sha2(written, 256).alias("repaired_sha256"))
    schema = f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def rows(batches):
        out, total = None, None

        def finish():
            gaps = total["high"] - total["low"] + 1 - total["distinct"] if total["low"] is not None else 0
            out.add({n: total[n] for n in ("conv_id", *COUNTS, "illegal", "cost")} | {
                "gaps": gaps, "audit": "".join(total["audits"]), "repaired_sha256": total["hash"].hexdigest()}, 256)

        for batch in batches:
            out = out or Rows(schema, batch.schema.field("conv_id").type)
            for row in _flat(batch):
                if total is None or row["conv_id"] != total["conv_id"]:
                    if total is not None:
                        finish()
                        yield from out.ready()
                    total = {"conv_id": row["conv_id"], "audits": [], "hash": hashlib.sha256(), "any": False, "last": None,
                             "low": None, "high": None, "distinct": 0, "illegal": 0, "cost": 0, **dict.fromkeys(COUNTS, 0)}
                for name in (*COUNTS, "illegal", "cost"):
                    total[name] += row[name]
                if total["last"] is not None and total["last"] + row["first"] not in LEGAL:
                    total["illegal"] += 1
                total["last"] = row["last"]
                if row["low"] is not None:
                    total["distinct"] += row["distinct"] - (total["high"] == row["low"])
                    total["low"] = row["low"] if total["low"] is None else total["low"]
                    total["high"] = row["high"]
                total["audits"].append(row["audit"])
                for role, text in row["messages"]:
                    total["hash"].update((("\n" if total["any"] else "") + f"{role}:{text}").encode())
                    total["any"] = True
        if total is not None:
            finish()
            yield from out.ready(end=True)

    order = [F.asc_nulls_first("conv_id"), F.col("part"), F.col("seq")]
    several = repaired.where(~F.col("done")).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(rows, schema)
    return single.select("conv_id", *names).unionByName(several.select("conv_id", *names))


# Planted damage: what the query repairs.


def damage(conversations: DataFrame) -> DataFrame:
    """The rows after a fault drawn by the checksum of `conv_id:turn`: dropped, emptied, without ends, repeated or made user's."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    code: Column = F.crc32(F.concat(shown[0], F.lit(":"), shown[1])) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    drawn = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), code.alias("code")).where("code <> 0")
    return drawn.select(
        "conv_id",
        "turn",
        F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(True), F.when(F.col("code") == 3, 2).otherwise(1))).alias("_"),
    ).drop("_")


def repair_damaged(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """Every conversation's digest columns after damage and repair; one without rows has zeros and empty texts."""
    found = digests(repair(damage(conversations), piece))
    every = conversations.select(F.col("conv_id").alias("_id")).distinct()
    joined = every.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select(
        F.col("_id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *COUNTS, "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )

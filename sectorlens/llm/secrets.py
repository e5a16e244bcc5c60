"""Secret scans over a trigram inverted index.

A rule's regex gives a Boolean query over trigrams that any match must contain. Every slice of
texts gets an inverted index of the trigrams that the rules ask for; a rule's query intersects and
unites the postings, and only candidate texts are matched against the regex. A rule without
mandatory trigrams (such as a long run of hex digits) reads every text.

Null texts count as empty and have no spans. Texts are scanned whole. Repeated rows are scanned row
by row. Columns other than the id and the text aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlens.llm.arrow import text_slices

ALL = ("all",)
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
RULES = (
    *BASE_RULES,
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("api_token", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("live_key", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def both(a, b):
    return b if a == ALL else a if b == ALL else ("and", a, b)


def either(queries):
    queries = list(dict.fromkeys(queries))
    return ALL if ALL in queries or not queries else queries[0] if len(queries) == 1 else ("or", *queries)


def contains(text: str):
    """The query of all trigrams of a string; one shorter than three asks for nothing."""
    grams = dict.fromkeys(text[i : i + 3] for i in range(len(text) - 2))
    query = ALL
    for gram in grams:
        query = both(query, ("gram", gram))
    return query


def trigram_query(rule: Rule):
    """The Boolean trigram query of a rule, over lower-cased text."""
    strings, query = _sequence(_parser.parse(rule.pattern, re.ASCII))
    return query if strings is None else both(query, either(contains(s) for s in strings))


def _sequence(items):
    """``(strings, query)``: all strings the items can match, None if too many; the query otherwise."""
    current, query, exact = {""}, ALL, True
    for item in items:
        strings, inner = _item(item)
        query = both(query, inner)
        if strings is not None and len(strings) * len(current) <= MOST_STRINGS:
            current = {a + b for a in current for b in strings}
            continue
        exact = False
        query = both(query, either(contains(s) for s in sorted(current)))
        current = strings if strings is not None else {""}
    if exact:
        return current, query
    return None, both(query, either(contains(s) for s in sorted(current)))


def _item(item):
    code, value = item
    if code is op.LITERAL:
        return ({chr(value).lower()}, ALL) if value < 128 else (None, ALL)
    if code is op.IN:
        chars = set()
        for kind, part in value:
            if kind is op.LITERAL and part < 128:
                chars.add(chr(part).lower())
            elif kind is op.RANGE and part[1] < 128:
                chars |= {chr(c).lower() for c in range(part[0], part[1] + 1)}
            else:
                return None, ALL
        return (chars if len(chars) <= 8 else None), ALL
    if code is op.SUBPATTERN:
        return _sequence(value[-1])
    if code is op.BRANCH:
        branches = [_sequence(b) for b in value[1]]
        if all(s is not None for s, _ in branches):
            return set().union(*(s for s, _ in branches)), ALL
        return None, either(q if s is None else both(q, either(contains(x) for x in s)) for s, q in branches)
    if code in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = value
        strings, query = _sequence(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ALL
        if low == 0:
            return None, ALL
        if strings is not None and low == high and len(strings) == 1:
            return {s * low for s in strings}, query
        return None, query if strings is None else both(query, either(contains(s) for s in strings))
    return None, ALL


def grams_of(query) -> set[str]:
    if query[0] == "gram":
        return {query[1]}
    return set().union(*(grams_of(q) for q in query[1:])) if len(query) > 1 else set()


class SliceIndex:
    """Postings of some trigrams in one slice of texts: the sorted places of texts that hold them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, grams: Sequence[str], table: np.ndarray):
        lower = data.astype(np.uint32)
        lower[(data >= 65) & (data <= 90)] += 32
        codes = lower[:-2] << 16 | lower[1:-1] << 8 | lower[2:] if len(lower) > 2 else lower[:0]
        hits = np.flatnonzero(table[codes])
        texts = np.searchsorted(bounds, hits, "right") - 1
        inside = hits + 2 < bounds[texts + 1]
        pairs = np.unique(table[codes[hits[inside]]].astype(np.int64) * len(bounds) + texts[inside])
        which, place = pairs // len(bounds), pairs % len(bounds)
        self.postings = {g: place[which == i + 1] for i, g in enumerate(grams)}
        self.everything = np.arange(len(bounds) - 1)

    @staticmethod
    def table(grams: Sequence[str]) -> np.ndarray:
        """For each trigram code: 1 + its place in ``grams``, else 0."""
        table = np.zeros(1 << 24, np.uint16)
        for i, gram in enumerate(grams):
            a, b, c = gram.encode()
            table[a << 16 | b << 8 | c] = i + 1
        return table

    def candidates(self, query) -> np.ndarray:
        if query[0] == "all":
            return self.everything
        if query[0] == "gram":
            return self.postings[query[1]]
        parts = [self.candidates(q) for q in query[1:]]
        found = parts[0]
        for part in parts[1:]:
            found = np.intersect1d(found, part, True) if query[0] == "and" else np.union1d(found, part)
        return found


def found_spans(batches, rules: Sequence[Rule]):
    """Yield ``(rows, texts, spans)`` of each slice; a text's spans are ``(start, rule, end)``, sorted."""
    queries = [trigram_query(r) for r in rules]
    patterns = [r.compiled() for r in rules]
    grams = sorted(set().union(*(grams_of(q) for q in queries)))
    table = SliceIndex.table(grams)
    for batch, data, bounds in text_slices(batches):
        index = SliceIndex(data, bounds, grams, table)
        texts = batch.column("text").to_pylist()
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for i, (rule, pattern) in enumerate(zip(rules, patterns, strict=True)):
            if rule.group == 0 and pattern.pattern.endswith("]+") and rule.least > 1:
                # A greedy run is long enough or not whatever follows, so short runs are never built.
                pattern = re.compile(f"{pattern.pattern[:-1]}{{{_rest(rule)},}}", pattern.flags)
            for row in index.candidates(queries[i]).tolist():
                if texts[row]:
                    spans[row] += [
                        (m.start(), i, m.end()) for m in pattern.finditer(texts[row]) if len(m[rule.group]) >= rule.least
                    ]
        yield batch, texts, [sorted(s) for s in spans]


def _rest(rule: Rule) -> int:
    """How often the last class must repeat for the shortest match, after the literals before it."""
    return rule.least - (len(_parser.parse(rule.pattern)) - 1)


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, kind, start, stop, secret)``: one row per span, in code points, ``stop`` exclusive."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches):
        for batch, texts, spans in found_spans(batches, rules):
            at = [i for i, s in enumerate(spans) for _ in s]
            flat = [x for s in spans for x in s]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(at, pa.int64())),
                    pa.array([rules[k].kind for _, k, _ in flat], pa.string()),
                    pa.array([s for s, _, _ in flat], pa.int64()),
                    pa.array([e for _, _, e in flat], pa.int64()),
                    pa.array([texts[i][s:e] for i, (s, _, e) in zip(at, flat, strict=True)], pa.string()),
                ],
                ["id", "kind", "start", "stop", "secret"],
            )

    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = chosen.mapInArrow(rows, f"id {kind}, kind string, start long, stop long, secret string")
    return out.withColumnRenamed("id", id_col)


def digest(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per document: spans of each base kind counted, a digest of the base spans, and all spans."""
    base = len(BASE_RULES)

    def written(spans) -> str:
        return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans)

    def rows(batches):
        for batch, _, spans in found_spans(batches, rules):
            counts = [pa.array([sum(k == i for _, k, _ in s) for s in spans], pa.int64()) for i in range(base)]
            sha = [hashlib.sha256(written([x for x in s if x[1] < base]).encode()).hexdigest() for s in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(sha), pa.array([written(s) for s in spans])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The same rows and columns, each secret in the text replaced by its kind in brackets.

    Spans that overlap are replaced together, under the kind of the first. A null text stays null.
    """
    names = docs.columns

    def rows(batches):
        for batch, texts, spans in found_spans(batches, rules):
            clean = []
            for text, own in zip(texts, spans, strict=True):
                parts, done = [], 0
                for start, kind, end in own:
                    if start >= done:
                        parts += [text[done:start], f"[{rules[kind].kind}]"]
                    done = max(done, end)
                clean.append("".join([*parts, text[done:]]) if parts else text)
            arrays = list(batch.columns)
            arrays[batch.schema.get_field_index("text")] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, [f"c{i}" for i in range(len(arrays))])

    chosen = docs.select(*[F.col(f"`{c}`").alias("text" if c == text_col else f"c{i}") for i, c in enumerate(names)])
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    return chosen.mapInArrow(rows, schema).toDF(*names)

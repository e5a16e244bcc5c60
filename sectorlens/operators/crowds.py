"""Pairs of names that meet in crowded buckets, found and scored cell by cell.

Where the buckets of two tables hold a good part of all their pairs, names are dealt into blocks and
every block of one side meets every block of the other. A task holds one block of each side and
hands the pairs of a few names over at a time, so its memory doesn't follow the buckets, and only
names are moved.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCKS = {"x": 2048, "y": 8192}  # names of a block
PAIRS = 1 << 14  # pairs that are scored at a time
BITS = 64
SCORES = ("jaccard", "levenshtein", "cosine")
NEEDED = {"jaccard": ["grams"], "levenshtein": ["name"], "cosine": ["terms", "norm"]}


def in_blocks(names: DataFrame, side: str, columns: Sequence[str]) -> DataFrame:
    """(names_x or names_y): rows of lists, dealt by hash, a partition each; as many as there are partitions at least for x."""
    n = names.count()
    least = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")) if side == "x" else 1
    parts = max(1, -(-n // BLOCKS[side]), min(least, n))
    block = F.pmod(F.xxhash64(side), F.lit(parts)).alias("_block")
    dealt = names.select(block, F.struct(side, *[f"{c}_{side}" for c in columns]).alias("name")).repartition(parts, "_block")
    return dealt.groupBy("_block").agg(F.collect_list("name").alias(f"names_{side}")).select(f"names_{side}")


def crowd_pairs(xs: DataFrame, ys: DataFrame, scores: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """(x, y) of the names that agree on a band's key, with the wanted ``scores``; with three of them their mean, too.

    Scores are those of :mod:`sectorlens.operators.matching`, rounded to ``digits`` if given.
    """
    columns = ["keys", *[c for score in scores for c in NEEDED[score]]]
    cells = in_blocks(xs, "x", columns).crossJoin(in_blocks(ys, "y", columns))
    names = [*scores, "sim_mean"] if len(scores) == len(SCORES) else list(scores)
    schema = T.StructType([xs.schema["x"], ys.schema["y"], *[T.StructField(c, T.DoubleType()) for c in names]])

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                sides = {side: _rows_of(batch.column(f"names_{side}"), i) for side in ("x", "y")}
                ids = {side: rows.field(side) for side, rows in sides.items()}
                scorers = [SCORERS[score](sides["x"], sides["y"]) for score in scores]
                for x, y in _meetings(*(_matrix(sides[side].field(f"keys_{side}")) for side in ("x", "y"))):
                    values = [scorer(x, y) for scorer in scorers]
                    if len(scores) == len(SCORES):
                        values.append(half_up(sum(values[1:], values[0]) / 3, 6))
                    values = values if digits is None else [half_up(v, digits) for v in values]
                    taken = [ids["x"].take(pa.array(x)), ids["y"].take(pa.array(y))]
                    yield pa.RecordBatch.from_arrays([*taken, *map(pa.array, values)], ["x", "y", *names])

    return cells.mapInArrow(rows, schema)


def _rows_of(column: pa.ListArray, i: int) -> pa.StructArray:
    return column.slice(i, 1).flatten()


def _lists(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The entries of all lists, and where each list begins and the last one ends."""
    return column.flatten(), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _meetings(x_keys: np.ndarray, y_keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the x and y that have a key in common in the same column, each pair once, some x at a time."""
    orders = np.argsort(y_keys, axis=0, kind="stable")
    bounds = []
    for band, order in enumerate(orders.T):
        keys = y_keys[order, band]
        bounds.append((np.searchsorted(keys, x_keys[:, band], "left"), np.searchsorted(keys, x_keys[:, band], "right")))
    low, high = (np.stack(b, axis=1) for b in zip(*bounds))
    orders, held, n_held = np.ascontiguousarray(orders.T), [], 0
    marks = np.zeros(len(y_keys), bool)
    for i in np.flatnonzero((high > low).any(1)):
        for band in np.flatnonzero(high[i] > low[i]):
            marks[orders[band, low[i, band] : high[i, band]]] = True
        found = np.flatnonzero(marks)
        marks[found] = False
        held.append((i, found))
        n_held += len(found)
        if n_held >= PAIRS:
            yield _flat(held)
            held, n_held = [], 0
    if held:
        yield _flat(held)


def _flat(held: list) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat([i for i, _ in held], [len(found) for _, found in held]), np.concatenate([found for _, found in held])


def _runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(x, begin, end) of the pairs of each x, which lie together."""
    begins = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return list(zip(x[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(x)]))


class _Postings:
    """Which y hold the terms of an x; the terms that no y holds are left away."""

    def __init__(self, x_terms: pa.Array, x_ends: np.ndarray, y_terms: pa.Array, y_ends: np.ndarray):
        kinds = y_terms.dictionary_encode()
        codes = kinds.indices.to_numpy()
        self.order = np.argsort(codes, kind="stable")
        self.ends = np.r_[0, np.cumsum(np.bincount(codes, minlength=len(kinds.dictionary)))]
        self.holders = np.repeat(np.arange(len(y_ends) - 1), np.diff(y_ends))[self.order]
        at = pc.fill_null(pc.index_in(x_terms, value_set=kinds.dictionary), -1)
        self.at, self.x_ends = at.to_numpy(zero_copy_only=False), x_ends

    def of(self, x: int) -> list[tuple[int, int, int]]:
        """Per term of the x: its place, and where the list of its y begins and ends."""
        places = range(self.x_ends[x], self.x_ends[x + 1])
        return [(p, self.ends[t], self.ends[t + 1]) for p in places if (t := self.at[p]) >= 0]


class JaccardOf:
    def __init__(self, xs: pa.StructArray, ys: pa.StructArray):
        (x_grams, x_ends), (y_grams, y_ends) = _lists(xs.field("grams_x")), _lists(ys.field("grams_y"))
        self.sizes = np.diff(x_ends), np.diff(y_ends)
        self.postings = _Postings(x_grams, x_ends, y_grams, y_ends)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        shared = np.zeros(len(x))
        for i, begin, end in _runs(x):
            lists = [self.postings.holders[a:b] for _, a, b in self.postings.of(i)]
            if lists:
                shared[begin:end] = np.bincount(np.concatenate(lists), minlength=len(self.sizes[1]))[y[begin:end]]
        return 100.0 * shared / (self.sizes[0][x] + self.sizes[1][y] - shared)


class CosineOf:
    def __init__(self, xs: pa.StructArray, ys: pa.StructArray):
        (x_terms, x_ends), (y_terms, y_ends) = _lists(xs.field("terms_x")), _lists(ys.field("terms_y"))
        self.postings = _Postings(x_terms.field("term"), x_ends, y_terms.field("term"), y_ends)
        self.x_weights = x_terms.field("w").to_numpy(zero_copy_only=False)
        self.y_weights = y_terms.field("w").to_numpy(zero_copy_only=False)[self.postings.order]
        self.norms = [rows.field(f"norm_{side}").to_numpy(zero_copy_only=False) for rows, side in ((xs, "x"), (ys, "y"))]

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        dots = np.zeros(len(x))
        for i, begin, end in _runs(x):
            dot = np.zeros(len(self.norms[1]))
            for p, a, b in self.postings.of(i):  # in the order of the terms
                dot[self.postings.holders[a:b]] += self.x_weights[p] * self.y_weights[a:b]
            dots[begin:end] = dot[y[begin:end]]
        return half_up(dots / (self.norms[0][x] * self.norms[1][y]), 9) * 100


class LevenshteinOf:
    """Edit distances by bit vectors (Myers 1999, Hyyrö 2003), of many pairs at a time."""

    def __init__(self, xs: pa.StructArray, ys: pa.StructArray):
        self.names = xs.field("name_x").to_pylist(), ys.field("name_y").to_pylist()
        x_codes, y_codes = ([np.frombuffer(n.encode("utf-32-le"), np.uint32) for n in names] for names in self.names)
        self.lengths = [np.array([len(c) for c in codes], np.int64) for codes in (x_codes, y_codes)]
        letters = np.unique(np.concatenate(y_codes)) if y_codes else np.zeros(0, np.uint32)
        self.n_letters = len(letters) + 1  # the last one stands for letters of no y
        self.kind = np.uint32 if self.lengths[0].max(initial=0) <= 32 else np.uint64
        self.letters = np.zeros((self.lengths[1].max(initial=0), len(y_codes)), np.int64)
        for i, codes in enumerate(y_codes):
            self.letters[: len(codes), i] = np.searchsorted(letters, codes)
        self.places = np.zeros((len(x_codes), self.n_letters), self.kind)
        for i, codes in enumerate(x_codes):
            if len(codes) <= BITS and len(letters):
                at = np.minimum(np.searchsorted(letters, codes), len(letters) - 1)
                at = np.where(letters[at] == codes, at, len(letters))
                np.bitwise_or.at(self.places[i], at, self.kind(1) << np.arange(len(codes), dtype=self.kind))

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        lengths = self.lengths[0][x], self.lengths[1][y]
        distances = self.distances(x, y, *lengths)
        for i in np.flatnonzero(lengths[0] > BITS):
            distances[i] = long_distance(self.names[0][x[i]], self.names[1][y[i]])
        longest = np.maximum(*lengths)
        return np.where(longest == 0, 100.0, 100.0 * (1 - distances / np.maximum(longest, 1)))

    def distances(self, x: np.ndarray, y: np.ndarray, x_lengths: np.ndarray, y_lengths: np.ndarray) -> np.ndarray:
        one, score = self.kind(1), np.where(x_lengths == 0, y_lengths, x_lengths)
        last = np.where((x_lengths > 0) & (x_lengths <= BITS), one << np.clip(x_lengths - 1, 0, BITS - 1).astype(self.kind), self.kind(0))
        up, down = np.full(len(x), ~self.kind(0)), np.zeros(len(x), self.kind)
        begins, places, letters = x * self.n_letters, self.places.ravel(), self.letters[:, y]
        shortest = y_lengths.min(initial=1 << 30)
        for j in range(y_lengths.max(initial=0)):
            same = places[begins + letters[j]]
            vertical = same | down
            across = (((same & up) + up) ^ up) | same
            more, less = down | ~(across | up), up & across
            step = ((more & last) != 0).astype(np.int64) - ((less & last) != 0)
            score += step if j < shortest else np.where(j < y_lengths, step, 0)
            more, less = (more << one) | one, less << one
            up, down = less | ~(vertical | more), more & vertical
        return score


def long_distance(a: str, b: str) -> int:
    """The same for one pair whose first name is longer than a machine word."""
    places: dict[str, int] = {}
    for i, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << i
    full, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = full, 0
    for letter in b:
        same = places.get(letter, 0)
        vertical = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | ~(across | up) & full, up & across
        score += bool(more & last) - bool(less & last)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | ~(vertical | more) & full, more & vertical
    return score


SCORERS = {"jaccard": JaccardOf, "levenshtein": LevenshteinOf, "cosine": CosineOf}


def half_up(values: np.ndarray, digits: int) -> np.ndarray:
    """Rounded as Spark does: halves of the decimal number go up."""
    scaled = values * 10.0**digits
    whole = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3):
        whole[i] = float(Decimal(repr(float(values[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP).scaleb(digits))
    return whole / 10.0**digits

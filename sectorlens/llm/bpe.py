"""Byte-level BPE: batched encoding in numpy merge rounds, and decoding.

A slice of texts becomes one array of code points. Pre-tokens are cut by character class with
array operations, equal pre-tokens are encoded once, and all of them are merged together: their
symbols lie in one flat array, the rank of each neighbouring pair is found by binary search over
the sorted pair keys, and a round merges each pre-token's lowest-ranked pair.

Null texts count as empty and give no ids. Texts of any length are encoded whole. Repeated rows
are encoded row by row. Columns beside the id and text are not read, so clashing names don't matter.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlens.llm.arrow import text_slices
from sectorlens.llm.words import span_hashes

VOCABULARY = "byte_bpe_50k.json"
LETTER, NUMBER, SPACE, OTHER = range(4)
NO_RANK = np.int32(2**31 - 1)


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """The class of every code point."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            kinds[c] = LETTER
        elif major == "N":
            kinds[c] = NUMBER
    # Code points with the Unicode property White_Space.
    spaces = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    kinds[spaces] = SPACE
    return kinds


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class Vocabulary:
    single: np.ndarray  # id of each byte
    keys: np.ndarray  # sorted pair keys, left << 16 | right
    ranks: np.ndarray  # rank of each key
    merged: np.ndarray  # id that replaces the pair
    content: np.ndarray  # bytes of all ids
    place: np.ndarray  # where an id's bytes begin, and the end
    special: dict[str, int]


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    letters, ids = byte_letters(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    pieces = {i: bytes(letters[c] for c in t) for t, i in ids.items() if t not in special}
    pieces |= {i: t.encode() for t, i in special.items()}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    keys = np.array([ids[a] << 16 | ids[b] for a, b in pairs], np.uint32)
    order = np.argsort(keys)
    single = np.zeros(256, np.uint32)
    for letter, byte in letters.items():
        single[byte] = ids[letter]
    lengths = np.array([len(pieces.get(i, b"")) for i in range(max(pieces) + 1)])
    return Vocabulary(
        single=single,
        keys=keys[order],
        ranks=order.astype(np.int32),
        merged=np.array([ids[a + b] for a, b in pairs], np.uint32)[order],
        content=np.frombuffer(b"".join(pieces.get(i, b"") for i in range(len(lengths))), np.uint8),
        place=np.r_[0, np.cumsum(lengths)],
        special=special,
    )


def pre_tokens(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in the texts between ``bounds``.

    A run of letters, of numbers or of other signs is one pre-token, with the blank before it. The
    last sign of a run of white space goes to the next pre-token if it is a blank, else stands
    alone; white space at a text's end stays together. An apostrophe takes an English ending.
    """
    n = len(points)
    kind = char_classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    begins = edge[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    follows = np.zeros(n, bool)  # a sign of another class follows in the same text
    follows[:-1] = begins[1:] & ~edge[1:n]
    last = (kind == SPACE) & follows
    begins |= last
    glued = np.flatnonzero(last & (points == 0x20)) + 1
    begins[glued] = False
    quotes = np.flatnonzero((points == 0x27) & begins & follows)
    quotes = quotes[kind[quotes + 1] == LETTER]
    for ending in ("s", "t", "re", "ve", "m", "ll", "d"):
        size = len(ending)
        fits = quotes[quotes + size < n]
        for i, letter in enumerate(ending):
            fits = fits[(points[fits + 1 + i] == ord(letter)) & ~edge[fits + 1 + i]]
        begins[fits + 1] = False
        after = fits + 1 + size
        after = after[after < n]
        begins[after] |= kind[after] == LETTER
    return np.flatnonzero(begins)


def merge(symbols: np.ndarray, starts: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merge all pre-tokens that begin at ``starts``; returns the ids and how many each has."""
    count = len(starts)
    done_owner, done_ids = [], []
    owner = np.repeat(np.arange(count), np.diff(np.r_[starts, len(symbols)]))

    def pair_ranks(left, right, same):
        keys = left << np.uint32(16) | right
        at = np.minimum(np.searchsorted(vocabulary.keys, keys), len(vocabulary.keys) - 1)
        return np.where(same & (vocabulary.keys[at] == keys), vocabulary.ranks[at], NO_RANK), at

    rank = np.full(len(symbols), NO_RANK, np.int32)
    place = np.zeros(len(symbols), np.int64)
    if len(symbols) > 1:
        rank[:-1], place[:-1] = pair_ranks(symbols[:-1], symbols[1:], owner[:-1] == owner[1:])
    while len(symbols):
        begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        lowest = np.minimum.reduceat(rank, begins)
        sizes = np.diff(np.r_[begins, len(symbols)])
        open_ = np.repeat(lowest < NO_RANK, sizes)
        if not open_.all():  # finished pre-tokens leave the flat array
            done_owner.append(owner[~open_])
            done_ids.append(symbols[~open_])
            symbols, owner, rank, place = symbols[open_], owner[open_], rank[open_], place[open_]
            sizes, lowest = sizes[lowest < NO_RANK], lowest[lowest < NO_RANK]
        if not len(symbols):
            break
        hits = np.flatnonzero(rank == np.repeat(lowest, sizes))
        run = np.r_[True, np.diff(hits) != 1]  # in a run of one sign, every second pair is free
        within = np.arange(len(hits)) - np.flatnonzero(run)[np.cumsum(run) - 1]
        hits = hits[within % 2 == 0]
        symbols[hits] = vocabulary.merged[place[hits]]
        keep = np.ones(len(symbols), bool)
        keep[hits + 1] = False
        new = np.cumsum(keep)[hits] - 1
        symbols, owner, rank, place = symbols[keep], owner[keep], rank[keep], place[keep]
        touched = np.zeros(len(symbols), bool)
        touched[new] = True
        touched[new[new > 0] - 1] = True
        fresh = np.flatnonzero(touched)
        rank[fresh] = NO_RANK
        fresh = fresh[fresh + 1 < len(symbols)]
        rank[fresh], place[fresh] = pair_ranks(symbols[fresh], symbols[fresh + 1], owner[fresh] == owner[fresh + 1])
    if not done_owner:
        return np.zeros(0, np.uint32), np.zeros(count, np.int64)
    owners, ids = np.concatenate(done_owner), np.concatenate(done_ids)
    order = np.argsort(owners, kind="stable")
    return ids[order], np.bincount(owners, minlength=count)


def spread(lengths: np.ndarray) -> np.ndarray:
    """0 to length - 1 for each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def gather(content: np.ndarray, place: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts ``content[place[i]:place[i + 1]]`` of each i, joined, and their lengths."""
    lengths = (place[1:] - place[:-1])[which]
    return content[np.repeat(place[which], lengths) + spread(lengths)], lengths


class Merged:
    """Ids of pre-tokens met before, by hash; emptied when it holds too many."""

    def __init__(self, vocabulary: Vocabulary, most: int = 400_000):
        self.vocabulary, self.most = vocabulary, most
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.where = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.place = np.zeros(1, np.int64)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.where[at], -1)

    def add(self, hashes: np.ndarray, symbols: np.ndarray, starts: np.ndarray) -> None:
        ids, counts = merge(symbols, starts, self.vocabulary)
        entry = len(self.place) - 1 + np.arange(len(hashes))
        self.ids = np.r_[self.ids, ids]
        self.place = np.r_[self.place, self.place[-1] + np.cumsum(counts)]
        merged = np.r_[self.hashes, hashes]
        order = np.argsort(merged, kind="stable")  # two sorted runs
        self.hashes, self.where = merged[order], np.r_[self.where, entry][order]


@lru_cache(maxsize=1)
def merged_of(path: str) -> Merged:
    return Merged(load_vocabulary(path))


def _encode_plain(points: np.ndarray, bounds: np.ndarray, merged: Merged) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts without special tokens, and the n + 1 bounds of each text's ids."""
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
    starts = pre_tokens(points, bounds)
    ends = np.r_[starts[1:], len(points)]
    hashes = span_hashes(points.astype(np.uint64), starts, ends)
    order = np.argsort(hashes)
    ordered = hashes[order]
    fresh = np.r_[True, ordered[1:] != ordered[:-1]]
    unique, first = ordered[fresh], order[fresh]
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(fresh) - 1
    if len(merged.hashes) + len(unique) > merged.most:
        merged.clear()
    entry = merged.look_up(unique)
    new = entry < 0
    if new.any():
        at = first[new]
        size = ends[at] - starts[at]
        signs = points[np.repeat(starts[at], size) + spread(size)]
        width = 1 + (signs >= 0x80) + (signs >= 0x800).astype(np.int64) + (signs >= 0x10000)
        raw = np.frombuffer(signs.tobytes().decode("utf-32-le").encode(), np.uint8)
        merged.add(unique[new], merged.vocabulary.single[raw], np.r_[0, np.cumsum(width)][np.cumsum(size) - size])
        entry = merged.look_up(unique)
    out, lengths = gather(merged.ids, merged.place, entry[kind])
    filled = np.r_[0, np.cumsum(lengths)]
    return out, filled[np.searchsorted(starts, bounds)]


def encode(data: np.ndarray, bounds: np.ndarray, merged: Merged) -> tuple[np.ndarray, np.ndarray]:
    """Ids of UTF-8 texts, one after the other, and the n + 1 bounds of each text's ids."""
    content, vocabulary = data.tobytes(), merged.vocabulary
    marks = sorted(
        (at, token) for token in vocabulary.special for at in _find_all(content, token.encode())
    )
    leads = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    points = np.frombuffer(content.decode().encode("utf-32-le"), np.uint32)
    inside = [
        (at, at + len(token.encode()), vocabulary.special[token])
        for at, token in marks
        if bounds[np.searchsorted(bounds, at, "right")] >= at + len(token.encode())
    ]
    if not inside:
        return _encode_plain(points, leads[bounds], merged)
    # Each special token ends a text, as the encoder cuts there first.
    kept, cuts, previous = [], [], 0
    for low, high, _ in inside:
        if low < previous:
            continue
        kept.append((low, high, _))
        cuts += [low, high]
        previous = high
    edges = np.unique(np.r_[bounds, cuts])
    ids, places = _encode_plain(points, leads[edges], merged)
    sizes, tokens = np.diff(places), {low: token for low, _, token in kept}
    parts, lengths = [], np.zeros(len(sizes), np.int64)
    for i, low in enumerate(edges[:-1].tolist()):
        part = np.array([tokens[low]], np.uint32) if low in tokens else ids[places[i] : places[i + 1]]
        parts.append(part)
        lengths[i] = len(part)
    filled = np.r_[0, np.cumsum(lengths)]
    return np.concatenate(parts), filled[np.searchsorted(edges, bounds)]


def _find_all(content: bytes, token: bytes):
    at = content.find(token)
    while at >= 0:
        yield at
        at = content.find(token, at + len(token))


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The text of some ids; bytes that are no UTF-8 become U+FFFD."""
    raw, _ = gather(vocabulary.content, vocabulary.place, ids)
    return raw.tobytes().decode(errors="replace")


def encode_column(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None
) -> DataFrame:
    """``(id, ids array<int>)``: the ids of each text; an empty array for an empty or null text."""
    path = path or vocabulary_path()

    def rows(batches):
        merged = merged_of(path)
        for batch, data, bounds in text_slices(batches):
            ids, places = encode(data, bounds, merged)
            arrays = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), arrays], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(rows, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_column(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``(id, text)``: the text of each array of ids; null stays null."""
    path = path or vocabulary_path()

    def rows(batches):
        vocabulary = load_vocabulary(path)
        for batch in batches:
            texts = [
                None if v.as_py() is None else decode(np.asarray(v.as_py(), np.int64), vocabulary)
                for v in batch.column("ids")
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    chosen = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return chosen.mapInArrow(rows, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: its number of ids, and digests of the ids and of the text decoded from them."""
    path = path or vocabulary_path()

    def rows(batches):
        merged = merged_of(path)
        vocabulary = merged.vocabulary
        for batch, data, bounds in text_slices(batches):
            ids, places = encode(data, bounds, merged)
            raw, lengths = gather(vocabulary.content, vocabulary.place, ids)
            byte_places = np.r_[0, np.cumsum(lengths)][places].tolist()
            stored, content = ids.astype("<u4").tobytes(), raw.tobytes()
            marks = places.tolist()
            ids_sha, text_sha = [], []
            for i in range(len(marks) - 1):
                ids_sha.append(hashlib.sha256(stored[4 * marks[i] : 4 * marks[i + 1]]).hexdigest())
                text = content[byte_places[i] : byte_places[i + 1]].decode(errors="replace")
                text_sha.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(places)), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )

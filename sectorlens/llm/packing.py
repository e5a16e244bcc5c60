"""Packing token pieces into sequences by shortest-pack-first over the length histogram.

A document's ids and one closing id are cut into pieces of the sequence size and a rest. Only the
histogram of piece lengths, at most `size` rows, reaches the driver. Lengths are placed longest
first, each into the patterns with the most room, and the patterns say which sequence and offset
the n-th piece of a length gets. A piece's rank among its length is its rank in its own partition
plus the pieces of that length in earlier partitions, so no length has to meet in one task.

A null text counts as empty: one piece with the closing id. An empty table gives no rows. Repeated
rows are packed each. Columns other than the id and text aren't read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sectorlens.llm.arrow import text_slices
from sectorlens.llm.bpe import encode, merged_of, vocabulary_path
from sectorlens.session import cut

SIZE = 1024
END = 0


def patterns_of(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """``(count, lengths)``: how many sequences hold pieces of these lengths, in this order.

    Each length splits one pattern at most and opens one at most, so there are at most twice as
    many patterns as lengths.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left, space = histogram[length], size
        while left and space >= length:
            if not room[space]:
                space -= 1
                continue
            count, lengths = room[space].pop()
            placed = min(left, count)
            room[space - length].append((placed, (*lengths, length)))
            if count > placed:
                room[space].append((count - placed, lengths))
            left -= placed
        if left:
            room[size - length].append((left, (length,)))
    return [pattern for space in sorted(room) for pattern in room[space]]


def slots_of(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[str, np.ndarray]:
    """Where ranks of each length go: from ``rank`` on, to ``sequence`` on, at ``offset``; sorted."""
    rows, used, sequence = [], defaultdict(int), 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pieces_of(docs: DataFrame, size: int = SIZE, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece, with its partition and its rank among that partition's pieces of its length."""
    path = path or vocabulary_path()

    def rows(batches):
        merged, part = merged_of(path), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for batch, data, bounds in text_slices(batches):
            ids, places = encode(data, bounds, merged)
            tokens = np.diff(places) + 1
            closed = np.insert(ids, places[1:], END).astype("<u4")
            begin = np.cumsum(tokens) - tokens
            n = -(-tokens // size)
            doc = np.repeat(np.arange(len(tokens)), n)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * size
            length = np.minimum(size, tokens[doc] - start)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            nth = np.empty(len(order), np.int64)
            nth[order] = np.arange(len(order)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(length, minlength=size + 1)
            low = begin[doc] + start
            content = closed.tobytes()
            crc = [zlib.crc32(content[4 * a : 4 * (a + k)]) for a, k in zip(low.tolist(), length.tolist(), strict=True)]
            arrays = [
                batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                pa.array(tokens[doc]), pa.array(np.full(len(doc), part, np.int64)), pa.array(nth),
            ]
            if with_ids:
                ends = pa.array(np.r_[0, np.cumsum(length)], pa.int32())
                arrays.append(pa.ListArray.from_arrays(ends, pa.array(closed.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, names)

    kinds = {k: "long" for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth")}
    kinds["doc_id"] = docs.schema["doc_id"].dataType.simpleString()
    if with_ids:
        kinds["ids"] = "array<int>"
    names = list(kinds)
    return docs.select("doc_id", "text").mapInArrow(rows, ", ".join(f"{k} {v}" for k, v in kinds.items()))


def pack(docs: DataFrame, size: int = SIZE, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece: its document, place and checksum, and the sequence and offset it goes to."""
    pieces = cut(pieces_of(docs, size, path, with_ids))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = slots_of(patterns_of(histogram, size))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    kept = [c for c in pieces.columns if c not in ("part", "nth")]
    ranked = pieces.join(before, ["part", "length"]).select(*kept, (F.col("nth") + F.col("before")).alias("rank"))
    top = 1 << 48  # beyond any rank: one sorted key for length and rank

    def rows(batches):
        keys = slots["length"] * top + slots["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length * top + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in kept],
                    pa.array(slots["sequence"][at] + rank - slots["rank"][at]),
                    pa.array(slots["offset"][at]),
                ],
                [*kept, "sequence_id", "offset"],
            )

    schema = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in kept)
    return ranked.mapInArrow(rows, f"{schema}, sequence_id long, offset long")


def assemble(packed: DataFrame, size: int = SIZE, pad: int = END) -> DataFrame:
    """``(sequence_id, ids)`` from pieces with ids: joined by offset and padded.

    A sequence whose ids number a power of two keeps its length.
    """
    joined = packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids")
    )
    n = F.size("ids")
    padded = F.concat("ids", F.array_repeat(F.lit(pad), F.lit(size) - n))
    return joined.select("sequence_id", F.when(F.bit_count(n) == 1, F.col("ids")).otherwise(padded).alias("ids"))

"""Exact Jaccard join of word shingle sets: size-banded tiles, bitmap signatures, exact intersection.

1. Each text becomes its sorted set of shingle hashes, a bitmap of parities (its width follows the size)
   and a digest. Texts with equal sets are one class, kept by its smallest doc_id.
2. A cheap pass ties each class to the leaders (lowest and highest hash) of the tiles that its few
   smallest shingles and its size band name, and verifies those pairs. This finds most copies with
   a few pairs per class, whatever the size of a group.
3. The complete pass: two sets that link share a shingle among the first ``n - ceil(0.8 n) + 1`` of
   any common order, so each class enters the tiles of those shingles, frequent ones ordered last.
   A tile is sorted by size and only compares sizes within the band that can link, only classes
   of different components, as the components already found need no further link, and only where the
   places of the tile's shingle leave enough shingles after it. Tiles of more than one component are
   kept: first each class meets its neighbours there, and what these links leave apart is compared in full.
4. Bit counts of the signatures, narrow ones inside the tile and whole ones after it, bound a pair's
   overlap from above; what may still link is verified on the sorted arrays. Components of all links give the result.

No link is lost: step 2 and the first meeting of a tile only save pairs, and frequent shingles only change the common order.
Shingles are compared as 64-bit hashes.

Null and empty texts have the empty set and link with nothing. A repeated row is in the class of its
copy; rows that share a doc_id belong to one component. Rows with a null doc_id have a null
component. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlens.llm.arrow import SLICE_BYTES, release, runs, text_slices
from sectorlens.llm.components import components
from sectorlens.llm.words import shingle_sets
from sectorlens.session import bucketed, cut

WORDS = 5
PERCENT = 80
LOW = 12  # shingles per class in the cheap pass
OFTEN = 3  # occurrences among COUNTED shingles from which a task reports a shingle
COUNTED = 4_000_000
TRIALS = 4  # classes on either side that a class of a tile is tried with first
FREQUENT = 500_000  # so many of the most frequent shingles are known by frequency
RECORDS = 250_000  # tile records per bucket
NARROWEST, WIDEST = 512, 8192  # bits of signatures


def signature(shingles: np.ndarray) -> bytes:
    """Parities of the shingles dealt over at least twice as many bits, a power of two, up to the widest."""
    width = NARROWEST
    while width < 2 * len(shingles) and width < WIDEST:
        width *= 2
    odd = np.bincount((shingles % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def narrow(bits: bytes) -> bytes:
    """The signature at the narrowest width."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.uint64).reshape(-1, NARROWEST // 64), axis=0).tobytes()


def _folded(bits: bytes, size: int) -> int:
    value = int.from_bytes(bits, "little")
    for half in (4 * len(bits) >> i for i in range(32)):
        if half < 8 * size:
            return value
        value = value >> half ^ value & (1 << half) - 1
    return value


def overlap_bound(left: bytes, right: bytes, n_left: int, n_right: int) -> int:
    """No more common shingles than this: each bit that differs stands for a shingle of one side alone."""
    size = min(len(left), len(right))
    apart = (_folded(left, size) ^ _folded(right, size)).bit_count()
    return min(n_left, n_right, (n_left + n_right - apart) // 2)


def links(common: int, n_left: int, n_right: int, percent: int = PERCENT) -> bool:
    return 100 * common >= percent * (n_left + n_right - common)


def band(n: int, percent: int = PERCENT) -> int:
    """Sizes whose ratio is below 100 / percent share a band or lie in neighbouring bands."""
    return int(np.log(max(n, 1)) / np.log(100 / percent))


def sets_of(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Size, digest, signature, its narrow form, smallest shingles and compressed text per document.

    Some rows, with a null doc_id and size -1, carry shingles that a task met often.
    """

    def frequent(seen: list[np.ndarray]):
        values, counts = np.unique(np.concatenate(seen), return_counts=True)
        often = counts >= OFTEN
        empty = [pa.nulls(1, kind) for kind in (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary())]
        lists = [pa.array([x[often].astype(np.int64)], pa.list_(pa.int64())) for x in (values.view(np.int64), counts)]
        return pa.RecordBatch.from_arrays([empty[0], pa.array([-1], pa.int64()), *empty[1:], *lists], names)

    def rows(batches):
        press = zstandard.ZstdCompressor(level=3)
        seen, held = [], 0
        for batch, data, bounds in text_slices(batches):
            sets = shingle_sets(data, bounds, k)
            seen += sets
            held += sum(len(x) for x in sets)
            if held > COUNTED:
                yield frequent(seen)
                seen, held = [], 0
            marks, content = bounds.tolist(), data.tobytes()
            signatures = [signature(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([band(len(s), percent) for s in sets], pa.int32()),
                    pa.array(signatures, pa.binary()),
                    pa.array([narrow(x) for x in signatures], pa.binary()),
                    pa.array([s[:LOW].view(np.int64) for s in sets], pa.list_(pa.int64())),
                    pa.array([press.compress(content[a:b]) for a, b in zip(marks[:-1], marks[1:], strict=True)], pa.binary()),
                    *[pa.nulls(len(sets), pa.list_(pa.int64()))] * 2,
                ],
                names,
            )
        if seen:
            yield frequent(seen)

    schema = (
        "doc_id long, n long, digest binary, band int, signature binary, narrow binary, low array<long>, packed binary, "
        "frequent array<long>, times array<long>"
    )
    names = [part.split(" ")[0] for part in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, schema)


def sets_of_packed(packed: list[bytes], k: int) -> list[np.ndarray]:
    """Shingle sets of compressed texts, opened a few megabytes at a time."""
    open_, sets, texts, held = zstandard.ZstdDecompressor(), [], [], 0
    for i, one in enumerate(packed, 1):
        texts.append(open_.decompress(one))
        held += len(texts[-1])
        if held > SLICE_BYTES or i == len(packed):
            bounds = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
            sets += shingle_sets(np.frombuffer(b"".join(texts), np.uint8), bounds, k)
            texts, held = [], 0
    return sets


def verify(pairs: DataFrame, classes: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs ``(a, b)`` that link, by exact intersection of their sets."""
    sides = [
        classes.select(F.col("rep").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "signature", "packed")])
        for c in ("a", "b")
    ]

    def rows(batches):
        known: dict[int, np.ndarray] = {}
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                part = {c: batch.column(c).to_pylist() for c in batch.schema.names}
                may = [
                    i for i in range(batch.num_rows)
                    if links(
                        overlap_bound(part["signature_a"][i], part["signature_b"][i], part["n_a"][i], part["n_b"][i]),
                        part["n_a"][i], part["n_b"][i], percent,
                    )
                ]
                need = {part[c][i]: part[f"packed_{c}"][i] for i in may for c in ("a", "b")}
                known = {key: known[key] for key in need if key in known}
                new = [key for key in need if key not in known]
                known |= zip(new, sets_of_packed([need[key] for key in new], k), strict=True)
                kept = [
                    i for i in may
                    if links(
                        len(np.intersect1d(known[part["a"][i]], known[part["b"][i]], True)),
                        part["n_a"][i], part["n_b"][i], percent,
                    )
                ]
                yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))
        release()

    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(rows, "a long, b long")


def leader_pairs(classes: DataFrame) -> DataFrame:
    """Each class with the two leaders of every tile that its smallest shingles and its band name."""
    rows = classes.select("rep", "band", F.explode("low").alias("key")).withColumn("h", F.xxhash64("rep"))
    leaders = rows.groupBy("key", "band").agg(
        F.min_by("rep", "h").alias("first"), F.max_by("rep", "h").alias("last")
    ).where("first <> last")
    paired = rows.join(leaders, ["key", "band"]).select("rep", F.explode(F.array("first", "last")).alias("lead"))
    return (
        paired.where("rep <> lead")
        .select(F.least("rep", "lead").alias("a"), F.greatest("rep", "lead").alias("b")).distinct()
    )


def frequent_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent shingles, at most `FREQUENT`, and a rank class of their counts.

    They only set the common order of shingles: results don't depend on them, the sizes of tiles do.
    """
    pairs = sets.where("n < 0").select(F.explode(F.arrays_zip("frequent", "times")).alias("x"))
    counts = pairs.groupBy(F.col("x.frequent").alias("h")).agg(F.sum("x.times").alias("t"))
    found = counts.orderBy(F.desc("t"), "h").limit(FREQUENT).toPandas()
    hashes = found["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], np.floor(2 * np.log2(found["t"].to_numpy(np.float64)[order] + 1)).astype(np.uint64)


def _prefix(shingles: np.ndarray, frequent: np.ndarray, times: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set, rare ones before frequent ones, then by hash."""
    n = len(shingles)
    size = n - (percent * n + 99) // 100 + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        weight = np.where(frequent[at] == shingles, times[at], np.uint64(0))
        if weight.any():
            return shingles[np.lexsort((shingles, weight))[:size]]
    return shingles[:size]


#: The key is half of the shingle's hash, as a bucket has few enough shingles; a clash only adds a candidate.
RECORD = np.dtype([("key", np.uint32), ("at", np.uint32), ("n", np.int64), ("rep", np.int64), ("component", np.int64)])
SIGNED_RECORD = np.dtype([*RECORD.descr, ("narrow", np.uint64, (NARROWEST // 64,))])


def tile_records(classes: DataFrame, frequent, times, buckets: int, k: int, percent: int) -> DataFrame:
    """Tile records of all classes, packed by bucket: ``(bucket, records)``."""

    def rows(batches):
        press = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                sets = sets_of_packed(batch.column("packed").to_pylist(), k)
                keys = [_prefix(s, frequent, times, percent) for s in sets]
                lengths = np.array([len(x) for x in keys])
                records = np.zeros(lengths.sum(), RECORD)
                shingles = np.concatenate(keys)
                records["key"] = shingles >> np.uint64(32)
                records["at"] = np.arange(len(records)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                for name, column in (("n", "n"), ("rep", "rep"), ("component", "component")):
                    records[name] = np.repeat(batch.column(column).to_numpy(zero_copy_only=False), lengths)
                bucket = (shingles % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                records, bucket = records[order], bucket[order]
                begins = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, int)
                ends = np.r_[begins[1:], len(bucket)] if len(bucket) else begins
                stored = [
                    _packed(records[a:b], press)
                    for a, b in zip(begins.tolist(), ends.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[begins], pa.int64()), pa.array(stored, pa.binary())], ["bucket", "records"]
                )
        release()

    return classes.select("rep", "n", "component", "packed").mapInArrow(rows, "bucket long, records binary")


def _packed(records: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    return press.compress(b"".join(records[name].tobytes() for name in RECORD.names))


def _unpacked(stored: bytes, open_: zstandard.ZstdDecompressor) -> np.ndarray:
    raw = open_.decompress(stored)
    records = np.zeros(len(raw) // RECORD.itemsize, RECORD)
    at = 0
    for name in RECORD.names:
        records[name] = np.frombuffer(raw, RECORD[name], len(records), at)
        at += RECORD[name].itemsize * len(records)
    return records


def _shared(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The records of tiles with more than one component, and which don't lie in the largest block of their tile."""
    records = records[np.lexsort((records["component"], records["key"]))]
    key, component = records["key"], records["component"]
    if not len(key):
        return records, np.zeros(0, bool)
    tile = np.r_[True, key[1:] != key[:-1]]
    block = tile | np.r_[True, component[1:] != component[:-1]]
    tile_of_block = (np.cumsum(tile) - 1)[np.flatnonzero(block)]
    size = np.diff(np.r_[np.flatnonzero(block), len(key)])
    first = np.flatnonzero(np.r_[True, tile_of_block[1:] != tile_of_block[:-1]])
    n_blocks = np.diff(np.r_[first, len(size)])
    largest = np.zeros(len(size), bool)
    order = np.lexsort((size, tile_of_block))
    largest[order[np.r_[first[1:], len(size)] - 1]] = True
    several = np.repeat(np.repeat(n_blocks > 1, n_blocks), size)
    return records[several], np.repeat(~largest, size)[several]


def tile_pairs(records: np.ndarray, percent: int = PERCENT, nearest: int | None = None) -> np.ndarray:
    """Pairs of classes of different components that share a tile and whose sizes and places can link.

    With ``nearest`` a class only meets so many others on either side in the order of sizes.
    """
    # The largest block of a tile is never compared with itself.
    records, minor = _shared(records)
    if not len(records):
        return np.zeros((0, 2), np.int64)
    mixed = (records["rep"].view(np.uint64) ^ records["key"].astype(np.uint64) << np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    by_size = np.lexsort((mixed, records["n"], records["key"]))
    records, minor = records[by_size], minor[by_size]
    key, n, rep, component = (records[c] for c in ("key", "n", "rep", "component"))
    rest = n - records["at"]
    found = [np.zeros((0, 2), np.int64)]
    held = 0
    for step in (1, -1):
        at, far = np.flatnonzero(minor), step
        while len(at) and (nearest is None or abs(far) <= nearest):
            to = at + far
            inside = (to >= 0) & (to < len(key))
            at, to = at[inside], to[inside]
            near = (key[at] == key[to]) & (100 * np.minimum(n[at], n[to]) >= percent * np.maximum(n[at], n[to]))
            at, to = at[near], to[near]
            # In the tile of the first common shingle no common one lies before the two places.
            enough = (100 + percent) * np.minimum(rest[at], rest[to]) >= percent * (n[at] + n[to])
            apart = (component[at] != component[to]) & enough
            left, right = at[apart], to[apart]
            if "narrow" in records.dtype.names and len(left):
                differ = np.bitwise_count(records["narrow"][left] ^ records["narrow"][right]).sum(axis=1, dtype=np.int64)
                total = n[left] + n[right]
                may = (100 + percent) * ((total - differ) // 2) >= percent * total
                left, right = left[may], right[may]
            pair = np.stack([np.minimum(rep[left], rep[right]), np.maximum(rep[left], rep[right])], 1)
            found.append(pair)
            held += len(pair)
            if held > 1_000_000:
                found = [np.unique(np.concatenate(found), axis=0)]
                held = 0
            far += step
    return np.unique(np.concatenate(found), axis=0)


def shared_tiles(tiles: DataFrame) -> DataFrame:
    """The records of tiles with more than one component, one row per bucket: ``(bucket, records)``."""

    def rows(batches):
        open_, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for (bucket,), table in runs(batches, ["bucket"]):
            records, _ = _shared(np.concatenate([_unpacked(x, open_) for x in table.column("records").to_pylist()]))
            if len(records):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket], pa.int64()), pa.array([_packed(records, press)], pa.binary())], ["bucket", "records"]
                )

    return tiles.sortWithinPartitions("bucket").mapInArrow(rows, "bucket long, records binary")


def trial_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """A few pairs of each tile, which tie most of what links."""

    def rows(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for stored in batch.column("records").to_pylist():
                pairs = tile_pairs(_unpacked(stored, open_), percent, TRIALS)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
        release()

    return shared.mapInArrow(rows, "a long, b long").distinct()


def tile_rows(shared: DataFrame) -> DataFrame:
    """The records as rows without their component."""

    def rows(batches):
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for bucket, stored in zip(*(batch.column(c).to_pylist() for c in ("bucket", "records")), strict=True):
                records = _unpacked(stored, open_)
                for low in range(0, len(records), 100_000):
                    part = records[low : low + 100_000]
                    columns = [pa.array(part[c].astype(np.int64)) for c in ("key", "at", "n", "rep")]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), bucket)), *columns], ["bucket", "key", "at", "n", "rep"]
                    )
        release()

    return shared.mapInArrow(rows, "bucket long, key long, at long, n long, rep long")


def candidate_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """All pairs of the rows of tiles that can link."""

    def rows(batches):
        for _, table in runs(batches, ["bucket"]):
            records = np.zeros(table.num_rows, SIGNED_RECORD)
            for name in RECORD.names:
                records[name] = table.column(name).to_numpy()
            narrow_ = b"".join(table.column("narrow").to_pylist())
            records["narrow"] = np.frombuffer(narrow_, np.uint64).reshape(-1, NARROWEST // 64)
            pairs = tile_pairs(records, percent)
            for low in range(0, len(pairs), 100_000):
                part = pairs[low : low + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["a", "b"])

    return tiles.sortWithinPartitions("bucket").mapInArrow(rows, "a long, b long").distinct()


def within_bound(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose signatures don't rule out a link."""
    sides = [
        classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("signature").alias(f"signature_{c}"))
        for c in ("a", "b")
    ]

    def rows(batches):
        for batch in batches:
            sizes, bits = ([batch.column(f"{x}_{c}").to_pylist() for c in ("a", "b")] for x in ("n", "signature"))
            may = [
                links(overlap_bound(x, y, m, n), m, n, percent)
                for x, y, m, n in zip(*bits, *sizes, strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(may, pa.bool_()))
        release()

    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(rows, "a long, b long")


def _placed(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows with the component of their class, so far."""
    placed = rows.join(known.withColumnRenamed("node", "rep"), "rep", "left")
    return placed.withColumn("component", F.coalesce("component", "rep"))


def _joined(known: DataFrame, found: DataFrame) -> DataFrame:
    """The components with more links."""
    return known if found.isEmpty() else components(
        known.select(F.col("component").alias("a"), F.col("node").alias("b")).union(found)
    )


def jaccard_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: one row per document; see the module's text."""
    spark = docs.sparkSession
    stored = cut(sets_of(docs, k, percent))
    sets = stored.where("n >= 0")
    named = sets.where("doc_id is not null and n > 0")
    reps = named.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    members = cut(sets.select("doc_id", "n", "digest").join(reps, "digest", "left").drop("digest"))
    owner = members.where("rep is not null and doc_id is not null")
    # Rows that share a doc_id but not a text: tie their classes.
    ids = owner.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    same_id = owner.join(ids, "doc_id").where("rep <> a").select("a", F.col("rep").alias("b"))
    chosen = owner.where("doc_id = rep").select("rep").distinct()
    # Joined by id and not by digest, and kept in buckets of the id, so that the texts move once.
    texts = bucketed(named.select(F.col("doc_id").alias("rep"), "n", "signature", "packed").join(chosen, "rep", "left_semi"), "rep")
    light = bucketed(
        named.select(F.col("doc_id").alias("rep"), "n", "band", "signature", "narrow", "low").join(chosen, "rep").distinct(), "rep"
    )

    likely = cut(within_bound(leader_pairs(light), light, percent))
    first = cut(verify(likely, texts, k, percent).union(same_id))
    known = components(first)

    sizes = light.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    expected = sizes[0] + (100 - percent) * sizes[1] // 100
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), expected // RECORDS)
    frequent, times = frequent_shingles(stored)
    placed = _placed(chosen, known).join(texts.drop("signature"), "rep")
    tiles = tile_records(placed, frequent, times, buckets, k, percent).repartition(buckets, "bucket")
    shared = cut(shared_tiles(tiles))
    known = _joined(known, cut(verify(cut(within_bound(trial_pairs(shared, percent), light, percent)), texts, k, percent)))
    left = _placed(tile_rows(shared).join(light.select("rep", "narrow"), "rep"), known).repartition(buckets, "bucket")
    pairs = cut(within_bound(candidate_pairs(left, percent), light, percent))
    total = _joined(known, cut(verify(pairs, texts, k, percent)))
    out = members.join(total.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))

"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosine, components.

Equal vectors are one class with a multiplicity. A table gives a class the signs of its vector
against random hyperplanes as a bucket; bits and tables follow the number of classes, so that a
bucket holds a few dozen unrelated classes and a pair at the threshold is missed by all tables with
the stated probability. Buckets above ``BLOCK`` classes are cut into a grid of tiles, so every pair
of the bucket still meets in one task of bounded size. Tiles compute exact cosines in double
precision; a pair counts in the first table where it meets, and a tile hands on one edge per vector
and not its pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing, and neither
do vectors of different lengths. Repeated rows count as other vectors. Columns other than vec_id and
embedding aren't read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlens.llm.arrow import runs
from sectorlens.llm.components import components
from sectorlens.session import cut

COSINE = 0.9
MISS = 0.002
BUCKET = 64
BLOCK = 1024
SEED = 20_011


def vectors_of(table: DataFrame) -> DataFrame:
    """``(vec_id, digest, dim, vector)``; all but the id null where a vector can't link."""

    def rows(batches):
        for batch in batches:
            digests, dims, vectors = [], [], []
            for value in batch.column("embedding").to_pylist():
                usable = value is not None and len(value) > 0 and None not in value
                vector = np.array(value, np.float64) + 0.0 if usable else np.zeros(0)
                if usable and np.isfinite(vector).all() and vector.any():
                    raw = vector.tobytes()
                    digests.append(hashlib.blake2b(raw, digest_size=16).digest())
                    dims.append(len(vector))
                    vectors.append(raw)
                else:
                    digests.append(None)
                    dims.append(None)
                    vectors.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary())],
                ["vec_id", "digest", "dim", "vector"],
            )

    chosen = table.select(F.col("vec_id").cast("long"), "embedding")
    return chosen.mapInArrow(rows, "vec_id long, digest binary, dim int, vector binary")


def plan(classes: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits per table and number of tables for this many classes."""
    bits = min(30, max(2, round(math.log2(max(classes, 2) / BUCKET)))) if classes > BUCKET else 1
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def units_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = np.stack([np.frombuffer(v, np.float64) for v in column.to_pylist()])
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the norm
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def bucket_codes(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """``(rep, times, dim, vector, codes)``: the bucket of each class in every table."""

    def rows(batches):
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits)
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([SEED, dim]).standard_normal((dim, tables * bits))
                signs = units_of(part.column("vector")) @ planes[dim] >= 0
                codes = signs.reshape(-1, tables, bits) @ weights
                ends = pa.array(np.arange(len(codes) + 1) * tables, pa.int32())
                arrays = pa.ListArray.from_arrays(ends, pa.array(codes.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, arrays], [*part.schema.names, "codes"])

    return classes.mapInArrow(rows, "rep long, times long, dim int, vector binary, codes array<int>")


def tile_links(left: dict, right: dict | None, table: int, cosine: float):
    """Linked pairs of a tile as places in ``left`` and ``right`` (or in ``left`` twice), and whether each is new."""
    other = left if right is None else right
    found = []
    for low in range(0, len(left["rep"]), 256):
        close = left["unit"][low : low + 256] @ other["unit"].T >= cosine
        i, j = np.nonzero(close)
        i += low
        keep = i < j if right is None else left["rep"][i] != other["rep"][j]
        i, j = i[keep], j[keep]
        meets = left["codes"][i, :table] == other["codes"][j, :table]
        found.append(np.stack([i, j, ~meets.any(axis=1)], 1))
    return np.concatenate(found).astype(np.int64)


def _labels(n: int, i: np.ndarray, j: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """The smallest rep of each place's component within the tile."""
    label = rep.copy()
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (label == before).all():
            return label


def near_vectors(table: DataFrame, cosine: float = COSINE, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: one row per vector; see the module's text."""
    rows_of = cut(vectors_of(table))
    classes = cut(
        rows_of.where("vec_id is not null and digest is not null").groupBy("digest", "dim")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.first("vector").alias("vector"))
    )
    bits, tables = plan(classes.count(), cosine, miss)
    coded = cut(bucket_codes(classes.select("rep", "times", "dim", "vector"), bits, tables))
    placed = coded.select("*", F.posexplode("codes").alias("table", "code"))
    crowded = (
        coded.select("dim", F.posexplode("codes").alias("table", "code")).groupBy("dim", "table", "code").count()
        .where(F.col("count") > block)
        .select("dim", "table", "code", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    )
    tiled = (
        placed.join(crowded, ["dim", "table", "code"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("own", "with")).withColumn("high", F.greatest("own", "with"))
        .select("dim", "table", "code", "low", "high", "own", "rep", "times", "vector", "codes")
    )
    keys = ["dim", "table", "code", "low", "high"]

    def rows(batches):
        for key, found in runs(batches, keys):
            sides = []
            for own in dict.fromkeys(key[3:]):
                part = found.filter(pa.compute.equal(found.column("own"), own))
                if part.num_rows:
                    sides.append(
                        {
                            "rep": part.column("rep").to_numpy(), "times": part.column("times").to_numpy(),
                            "unit": units_of(part.column("vector")),
                            "codes": np.array(part.column("codes").to_pylist(), np.int32),
                        }
                    )
            if len(sides) < len(set(key[3:])) or len(sides) == 1 and len(sides[0]["rep"]) < 2:
                continue
            left, right = sides[0], sides[1] if len(sides) == 2 else None
            pairs = tile_links(left, right, key[1], cosine)
            if not len(pairs):
                continue
            rep, times = left["rep"], left["times"]
            i, j, new = pairs.T
            if right is not None:
                j = j + len(rep)
                rep, times = np.r_[rep, right["rep"]], np.r_[times, right["times"]]
            label = _labels(len(rep), i, j, rep)
            new = new.astype(bool)
            count = np.zeros(len(rep), np.int64)
            np.add.at(count, i[new], times[j[new]])
            np.add.at(count, j[new], times[i[new]])
            told = (count > 0) | (label != rep)
            yield pa.RecordBatch.from_arrays([pa.array(x[told]) for x in (rep, label, count)], ["rep", "label", "links"])

    found = cut(
        tiled.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(rows, "rep long, label long, links long")
    )
    linked = components(found.select(F.col("label").alias("a"), F.col("rep").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    each = (
        classes.select("digest", "rep", "times").join(counts, "rep", "left")
        .join(linked.withColumnRenamed("node", "rep"), "rep", "left")
        .select("digest", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    )
    out = rows_of.select("vec_id", "digest").join(each, "digest", "left")
    return out.select(
        "vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    ).withColumn("kept", F.col("vec_id") == F.col("component_id"))

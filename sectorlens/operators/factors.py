"""Truncated decomposition of a sparse table (row, col, value) by a randomised range finder.

After Halko, Martinsson and Tropp (2011): the table times a random sketch spans its strongest
directions, power rounds sharpen them, and a small problem gives the factors. Vectors of rows and of
columns are tables of one short array per row; multiplying joins the cells to the vectors of one
side and adds up, first inside each task and then across tasks, so a column that nearly every row
holds is no bottleneck. Only matrices of ``rank + extra`` squared reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectorlens.session import bucketed, cut

EXTRA, ROUNDS = 10, 2
CHUNK = 1 << 15
BLOCK_CELLS, LEAST_CELLS = 1_000_000, 50_000  # of a block: at most, and not less for the sake of more tasks


def _dense(column) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))


def _summed(placed: DataFrame, key: str) -> DataFrame:
    """``(key, vector)``: the sums of ``value`` times ``vector`` per key, inside each task chunk by chunk."""
    schema = f"{key} {placed.schema[key].dataType.simpleString()}, vector array<double>"

    def rows(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK):
                part = batch.slice(low, CHUNK)
                codes = part.column(key).dictionary_encode()
                total = np.zeros((len(codes.dictionary), len(part.column("vector")[0])))
                weighted = _dense(part.column("vector")) * part.column("value").to_numpy(zero_copy_only=False)[:, None]
                order = np.argsort(codes.indices.to_numpy(), kind="stable")
                at = codes.indices.to_numpy()[order]
                begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                total[at[begins]] = np.add.reduceat(weighted[order], begins)
                yield pa.RecordBatch.from_arrays([codes.dictionary, _lists(total)], [key, "vector"])

    return placed.mapInArrow(rows, schema)


@dataclass
class Blocks:
    """Cells (block, row, col, value) stored by block, and which columns a block has."""

    cells: DataFrame
    columns: DataFrame
    block_of: Column


def in_blocks(cells: DataFrame) -> Blocks:
    """The cells in blocks of whole rows, as many as there are partitions or more."""
    spark, n_cells = cells.sparkSession, cells.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, -(-n_cells // BLOCK_CELLS), min(parts, n_cells // LEAST_CELLS))
    numbers = _one_per_partition(spark, n, parts)
    block = F.element_at(F.array(*map(F.lit, numbers)), (F.pmod(F.xxhash64("row"), F.lit(n)) + 1).cast("int")).alias("block")
    stored = bucketed(cells.select(block, "row", "col", "value"), "block")
    return Blocks(stored, cut(stored.select("block", "col").distinct()), block)


def _one_per_partition(spark, n: int, parts: int) -> list[int]:
    """``n`` numbers that a shuffle deals evenly to the partitions."""
    place = F.pmod(F.hash("id"), F.lit(parts))
    dealt = spark.range(50 * max(n, parts)).groupBy(place.alias("place")).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    turns = dealt.select("place", F.posexplode("ids").alias("turn", "id")).orderBy("turn", "place").limit(n)
    return [row["id"] for row in turns.collect()]


def multiply(blocks: Blocks, vectors: DataFrame, by: str, to: str) -> DataFrame:
    """``(to, vector)``: the cells times the vectors of their ``by`` side."""
    sent = vectors.select(blocks.block_of, by, "vector") if by == "row" else blocks.columns.join(vectors, by)
    kind = blocks.cells.schema[to].dataType

    def product(cells: pa.Table, sent: pa.Table) -> pa.Table:
        at = pc.index_in(cells.column(by), value_set=sent.column(by).combine_chunks()) if len(sent) else pa.nulls(len(cells), pa.int32())
        cells, at = cells.filter(pc.is_valid(at)), pc.drop_null(at).to_numpy()
        keys = cells.column(to).combine_chunks().dictionary_encode()
        if not len(cells):
            return pa.table({to: keys.dictionary, "vector": pa.array([], pa.list_(pa.float64()))})
        found, value = _dense(sent.column("vector")), cells.column("value").to_numpy()
        total, codes = np.zeros((len(keys.dictionary), found.shape[1])), keys.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        for low in range(0, len(order), CHUNK):
            part = order[low : low + CHUNK]
            begins = np.flatnonzero(np.r_[True, np.diff(codes[part]) != 0])
            total[codes[part[begins]]] += np.add.reduceat(found[at[part]] * value[part, None], begins)
        return pa.table({to: keys.dictionary, "vector": _lists(total)})

    schema = f"{to} {kind.simpleString()}, vector array<double>"
    inside = blocks.cells.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(product, schema)
    if to == "row":  # a row lies in one block
        return inside
    ones = F.lit(1.0).alias("value")
    # Equal keys come together, and runs are added up in the tasks.
    return _runs(_summed(inside.repartition(to).sortWithinPartitions(to).select(to, ones, "vector"), to), to)


def _runs(partial: DataFrame, key: str) -> DataFrame:
    """Add up the rows of one key that chunk borders left apart; partitioned by the key already, so no shuffle."""
    schema = f"{key} {partial.schema[key].dataType.simpleString()}, vector array<double>"

    def rows(batches):
        held, kind = None, None

        def table(found):
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], kind), _lists(np.stack([v for _, v in found]))], [key, "vector"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kind, out = batch.schema.field(key).type, []
            for k, v in zip(batch.column(key).to_pylist(), _dense(batch.column("vector"))):
                if held is not None and held[0] == k:
                    held = (k, held[1] + v)
                else:
                    out += [held] if held is not None else []
                    held = (k, v)
            if out:
                yield table(out)
        if held is not None:
            yield table([held])

    return partial.mapInArrow(rows, schema)


def gram(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the outer products of all vectors, and the sums of their third powers."""

    def rows(batches):
        total = cubes = None
        for batch in batches:
            if batch.num_rows:
                x = _dense(batch.column("vector"))
                total = x.T @ x if total is None else total + x.T @ x
                cubes = (x**3).sum(0) if cubes is None else cubes + (x**3).sum(0)
        if total is not None:
            yield pa.RecordBatch.from_arrays([_lists(total.reshape(1, -1)), _lists(cubes.reshape(1, -1))], ["g", "c"])

    # A small matrix per task; they are added up here.
    found = vectors.select("vector").mapInArrow(rows, "g array<double>, c array<double>").toLocalIterator()
    total = cubes = None
    for row in found:
        g, c = np.array(row["g"]), np.array(row["c"])
        total, cubes = (g, c) if total is None else (total + g, cubes + c)
    if total is None:
        return np.zeros((0, 0)), np.zeros(0)
    return total.reshape(len(cubes), -1), cubes


def turned(vectors: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """Every vector times a small matrix."""

    def rows(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(key), _lists(_dense(batch.column("vector")) @ matrix)], [key, "vector"])

    return vectors.select(key, "vector").mapInArrow(rows, f"{key} {vectors.schema[key].dataType.simpleString()}, vector array<double>")


def whitening(g: np.ndarray) -> np.ndarray:
    """What makes vectors with this Gram matrix orthonormal; directions without weight become zero."""
    values, directions = np.linalg.eigh(g)
    least = values.max(initial=0) * len(values) * np.finfo(float).eps
    return directions * np.where(values > least, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)


def random_signs(key: Column, size: int, seed: int) -> Column:
    """A vector of plus and minus ones from the key's hash."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(F.pmod(F.xxhash64(F.lit(seed), i, key), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    )


def decompose(
    cells: DataFrame, rank: int, rounds: int = ROUNDS, extra: int = EXTRA, seed: int = 100
) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """``(row, vector)``, singular values, ``(col, vector)``: the strongest directions of (row, col, value).

    Vectors are unit directions; a direction's sign makes the sum of the third powers over the
    columns positive. Fewer directions come back where the table has fewer.
    """
    size = rank + extra
    cells = in_blocks(cells.select("row", "col", F.col("value").cast("double").alias("value")).where("value <> 0"))
    columns = cells.columns.select("col").distinct()
    rows = cut(multiply(cells, columns.select("col", random_signs(F.col("col"), size, seed).alias("vector")), "col", "row"))
    for _ in range(rounds):
        rows = turned(rows, "row", whitening(gram(rows)[0]))
        back = cut(multiply(cells, rows, "row", "col"))
        back = turned(back, "col", whitening(gram(back)[0]))
        rows = cut(multiply(cells, back, "col", "row"))
    base = whitening(gram(rows)[0])
    rows = cut(turned(rows, "row", base))
    back = cut(multiply(cells, rows, "row", "col"))
    g, _ = gram(back)
    values, directions = np.linalg.eigh(g) if len(g) else (np.zeros(0), np.zeros((0, 0)))
    order = np.argsort(-values)[:rank]
    order = order[values[order] > values.max(initial=0) * 1e-12]
    weights, directions = np.sqrt(values[order]), directions[:, order]
    right = turned(back, "col", directions / weights)
    signs = np.where(gram(right)[1] < 0, -1.0, 1.0) if len(order) else np.zeros(0)
    return turned(rows, "row", directions * signs), weights, turned(back, "col", directions / weights * signs)

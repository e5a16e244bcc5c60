"""Ranking and carrying values inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sectorlens.session import cut


def latest_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    nulls: str = "last",
    tie: Sequence[str] = (),
) -> DataFrame:
    """One row per key: the latest by ``order_col``, then the first by ``tie``.

    ``nulls="last"``: a row without a date loses; ``"first"``: it wins.
    Spark trims to one row per key and input task before the shuffle, so a hot key is cheap.
    """
    if nulls not in ("first", "last"):
        raise ValueError(f"nulls must be 'first' or 'last', not {nulls!r}")
    newest = F.desc_nulls_first(order_col) if nulls == "first" else F.desc_nulls_last(order_col)
    window = W.partitionBy(*keys).orderBy(newest, *[F.asc_nulls_last(c) for c in tie])
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """The first ``n`` rows per key, numbered from 1; trimmed before the shuffle."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= n)


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str = "rn",
    slice_rows: int = 1_000_000,
) -> DataFrame:
    """Exact ``row_number`` by ascending ``order``, with each group spread over many tasks.

    The rows are dealt by ranges of ``order`` into slices of about ``slice_rows``, so their number
    follows the table. Rows are numbered inside a slice and shifted by the rows of earlier slices.
    ``order`` must be unique within a group.
    """
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    keyed = cut(df.withColumn("_key", key))
    slices = max(1, -(-keyed.count() // slice_rows))
    # Written, so that all uses see the same slices.
    sliced = cut(keyed.repartitionByRange(slices, "_key").withColumn("_slice", F.spark_partition_id()))
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = W.partitionBy(*keys, "_slice").orderBy("_key")
    return (
        sliced.withColumn("_pos", F.row_number().over(inside))
        .join(shifts, [*keys, "_slice"])
        .withColumn(out, (F.col("_pos") + F.col("_shift")).cast("long"))
        .drop("_key", "_slice", "_pos", "_shift")
    )


def fill_down(
    df: DataFrame,
    columns: Sequence[str],
    row_no: str,
    keys: Sequence[str] = (),
    chunk_rows: int = 100_000,
) -> DataFrame:
    """Carry the last non-null value of each column to the rows below it.

    Rows are cut into chunks of the row number; a chunk takes over the last value of the
    chunks before it from a table of one row per chunk, so no sheet has to fit in one task.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(row_no) / F.lit(chunk_rows)))
    tails = chunked.groupBy(*keys, "_chunk").agg(
        *[
            F.max_by(c, F.when(F.col(c).isNotNull(), F.col(row_no))).alias(f"_tail_{c}")
            for c in columns
        ]
    )
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = tails.select(
        *keys, "_chunk",
        *[F.last(f"_tail_{c}", ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in columns],
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy(row_no).rowsBetween(W.unboundedPreceding, 0)
    filled = chunked.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns})
    return (
        filled.join(carried, [*keys, "_chunk"])
        .withColumns({c: F.coalesce(c, f"_carry_{c}") for c in columns})
        .drop("_chunk", *[f"_carry_{c}" for c in columns])
    )


def next_row(
    df: DataFrame,
    columns: Sequence[str],
    row_no: str,
    keys: Sequence[str] = (),
    chunk_rows: int = 100_000,
    prefix: str = "next_",
) -> DataFrame:
    """Add the following row's values, chunk by chunk as in :func:`fill_down`."""
    chunked = df.withColumn("_chunk", F.floor(F.col(row_no) / F.lit(chunk_rows))).withColumn(
        "_row", F.struct(*columns)
    )
    heads = chunked.groupBy(*keys, "_chunk").agg(F.min_by("_row", row_no).alias("_head"))
    following = heads.select(
        *keys, "_chunk",
        F.lead("_head").over(W.partitionBy(*keys).orderBy("_chunk")).alias("_next_head"),
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy(row_no)
    return (
        chunked.withColumn("_lead", F.lead("_row").over(inside))
        .join(following, [*keys, "_chunk"])
        .withColumn("_lead", F.coalesce("_lead", "_next_head"))
        .select(*df.columns, *[F.col(f"_lead.{c}").alias(f"{prefix}{c}") for c in columns])
    )

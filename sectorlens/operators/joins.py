"""Joins whose hot keys are spread over tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_join(
    dealt: DataFrame, visitors: DataFrame, keys: Sequence[str], row: str, block: int, few_copies: bool = False
) -> DataFrame:
    """Inner join on ``keys`` in which no task holds all rows of a key.

    The rows of ``dealt`` that share a key are dealt by the hash of ``row`` into blocks of about
    ``block``; each visitor meets every block of its key. ``dealt`` is read twice. With
    ``few_copies`` a key has only the square root of that many blocks, so visitors are copied less.
    """
    n_blocks = F.col("count") / block
    blocks = (
        dealt.groupBy(*keys).count().where(F.col("count") > block)
        .select(*keys, F.ceil(F.sqrt(n_blocks) if few_copies else n_blocks).cast("int").alias("_blocks"))
    )
    n = F.coalesce("_blocks", F.lit(1))
    placed = dealt.join(blocks, list(keys), "left").withColumn("_block", F.pmod(F.xxhash64(row), n).cast("int"))
    visits = visitors.join(blocks, list(keys), "left").withColumn("_block", F.explode(F.sequence(F.lit(0), n - 1)))
    if few_copies:  # few small rows may give many pairs, so they are dealt to as many tasks as there are partitions
        placed = placed.repartition(int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_block")
    return placed.drop("_blocks").join(visits.drop("_blocks"), [*keys, "_block"]).drop("_block")

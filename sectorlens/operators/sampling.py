"""Truncation and exact samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HASH_BINS = 65_536


def first_rows(df: DataFrame, keys: Sequence[str], n: int | None) -> DataFrame:
    """The first ``n`` rows by key, for trial runs; all rows when ``n`` is None."""
    return df if n is None else df.orderBy(*keys).limit(n)


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 100) -> DataFrame:
    """Exactly ``n`` rows without replacement, the same for the same seed; error if there are fewer.

    Rows go by the hash of seed and key. A histogram over the hashes' first digits finds where
    the n-th lies, so only about ``n`` rows are sorted.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    hashed = df.withColumn("_hash", digest).withColumn("_bin", F.substring("_hash", 1, 4))
    bins = hashed.groupBy("_bin").agg(F.count("*").alias("c"))  # at most HASH_BINS rows
    upto = bins.withColumn("upto", F.sum("c").over(W.orderBy("_bin")))
    found = upto.agg(F.max("upto").alias("total"), F.min(F.when(F.col("upto") >= n, F.col("_bin"))).alias("last")).first()
    if (found.total or 0) < n:
        raise ValueError(f"cannot draw {n} of {found.total or 0} rows")
    if n == 0:
        return df.limit(0)
    return hashed.where(F.col("_bin") <= found.last).orderBy("_hash", key).limit(n).drop("_hash", "_bin")

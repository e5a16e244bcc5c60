"""Distribution of text lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def percentile_rank(df: DataFrame, column: str, score: float) -> DataFrame:
    """Percentage of values below ``score``, values equal to it counted half ("rank" kind)."""
    below = F.count_if(F.col(column) < score)
    upto = F.count_if(F.col(column) <= score)
    n = F.count(column)
    rank = (below + upto + F.when(upto > below, 1).otherwise(0)) * 50.0
    return df.agg(F.try_divide(rank, n).alias("percentile"))


def cumulative_histogram(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """(bin, upper, n, cumulative): counts in equal bins from minimum to maximum and their running share.

    Without ``bins`` there are as many as the largest value.
    """
    bounds = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(column).alias("total"))
    bounds = bounds.withColumn("bins", F.lit(bins) if bins else F.greatest(F.col("hi"), F.lit(1)))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / F.col("bins")).otherwise(1.0)
    placed = (
        df.where(F.col(column).isNotNull())
        .join(F.broadcast(bounds.withColumn("width", width)))  # a single row
        .withColumn("bin", F.least(F.floor((F.col(column) - F.col("lo")) / F.col("width")), F.col("bins") - 1))
    )
    counts = placed.groupBy("bin", "lo", "width", "total").agg(F.count("*").alias("n"))
    # The window runs over the bins that occur, no longer over the rows.
    running = F.sum("n").over(W.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    return counts.select(
        F.col("bin").cast("long").alias("bin"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("upper"),
        "n",
        (running / F.col("total")).alias("cumulative"),
    )

"""Choosing the run whose tables are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorlens.operators.ranking import latest_per_key

PRODUCTION = "prod"


def _finished(runs: DataFrame, flow: str) -> DataFrame:
    return runs.where(
        (F.col("flow_name") == flow) & (F.col("branch") == PRODUCTION) & F.col("successful")
    )


def latest_snapshot(runs: DataFrame, flow: str) -> DataFrame:
    """The latest successful production run of a flow, as one row; error if there is none."""
    chosen = (
        _finished(runs, flow)
        .groupBy("flow_name")
        .agg(F.max_by(F.struct("run_id", "finished_at"), F.struct("finished_at", "run_id")).alias("run"))
        .select("flow_name", "run.*")
    )
    if chosen.isEmpty():
        raise LookupError(f"no successful production run of {flow!r}")
    return chosen


def latest_snapshot_per_model(runs: DataFrame, flow: str) -> DataFrame:
    """The latest successful production run of a flow for each embedding model."""
    named = _finished(runs, flow).where(F.col("model_name").isNotNull())
    ordered = named.withColumn("_order", F.struct("finished_at", "run_id"))
    return latest_per_key(ordered, ["model_name"], "_order").select(
        "model_name", "run_id", "finished_at"
    )


def read_pinned(spark: SparkSession, path: str, runs: DataFrame, flow: str, run_id: int) -> DataFrame:
    """A table's partition of one configured run; error if that run did not succeed."""
    pinned = runs.where((F.col("flow_name") == flow) & (F.col("run_id") == run_id) & F.col("successful"))
    if pinned.isEmpty():
        raise ValueError(f"run {run_id} of {flow!r} was not successful")
    return spark.read.parquet(path).where(F.col("run_id") == run_id)

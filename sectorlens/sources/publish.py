"""Runs whose tables become visible together.

A run writes its tables into a folder of its own and then one manifest of a single file, which the
commit of the write job moves into place at once. Readers go by manifests only: a run that failed,
was killed or still writes has none, so nothing of it is ever read. Writers never touch each other's
folders; where two publish the same run, the manifest that finished first counts, with all its
tables. Readers may pin a run id, or take the latest of a flow.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorlens.operators.ranking import latest_per_key
from sectorlens.sources.snapshots import PRODUCTION, latest_snapshot

MANIFEST = "flow_name string, run_id long, branch string, model_name string, attempt string, finished_at timestamp, tables map<string,string>"


def publish(
    spark: SparkSession,
    root: str,
    flow: str,
    run_id: int,
    tables: Mapping[str, DataFrame],
    branch: str = PRODUCTION,
    model_name: str | None = None,
    finished_at: datetime.datetime | None = None,
) -> str:
    """Write all tables of a run and make them visible; returns the attempt's name.

    If any table fails nothing becomes visible; what was written stays unread in its own folder.
    """
    attempt = uuid.uuid4().hex
    places = {name: f"{root.rstrip('/')}/data/{flow}/{run_id}/{attempt}/{name}" for name in tables}
    for name, table in tables.items():
        table.write.parquet(places[name])
    at = finished_at or datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    row = (flow, run_id, branch, model_name, attempt, at, places)
    manifest = spark.createDataFrame([row], MANIFEST).coalesce(1)
    manifest.write.parquet(f"{root.rstrip('/')}/manifests/{flow}-{run_id}-{attempt}")
    return attempt


def published_runs(spark: SparkSession, root: str) -> DataFrame:
    """A row per published run, as `snapshots` reads them; of several attempts at a run the first finished."""
    try:
        manifests = spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").parquet(f"{root.rstrip('/')}/manifests")
    except AnalysisException:  # no run was ever published there
        manifests = spark.createDataFrame([], MANIFEST)
    ordered = manifests.withColumn("_age", -F.unix_micros("finished_at"))
    first = latest_per_key(ordered, ["flow_name", "branch", "run_id"], "_age", tie=["attempt"]).drop("_age")
    return first.withColumn("successful", F.lit(True))


def read_published(
    spark: SparkSession, root: str, flow: str, table: str, run_id: int | None = None, branch: str = PRODUCTION
) -> DataFrame:
    """A table of the pinned run, or of the latest one; an error if no such run or table was published."""
    runs = published_runs(spark, root).where(F.col("branch") == branch)
    if run_id is None:
        run_id = latest_snapshot(runs, flow).first()["run_id"]
    found = runs.where((F.col("flow_name") == flow) & (F.col("run_id") == run_id)).select(F.try_element_at("tables", F.lit(table))).first()
    if found is None:
        raise ValueError(f"run {run_id} of {flow!r} was not published")
    if found[0] is None:
        raise ValueError(f"run {run_id} of {flow!r} has no table {table!r}")
    return spark.read.parquet(found[0])

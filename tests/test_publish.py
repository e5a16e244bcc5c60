"""Runs become visible whole or not at all."""

import datetime
import glob
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from sectorlens.sources.publish import publish, published_runs, read_published


def at(minute):
    return datetime.datetime(2024, 5, 1, 12, minute)


def numbers(spark, n):
    return spark.range(n).withColumn("x", F.lit(n))


def test_latest_and_pinned(spark, tmp_path):
    root = f"{tmp_path}/runs"
    assert published_runs(spark, root).collect() == []
    with pytest.raises(LookupError):
        read_published(spark, root, "match", "pairs")
    for run, n in ((1, 5), (2, 7)):
        publish(spark, root, "match", run, {"pairs": numbers(spark, n), "names": numbers(spark, n + 1)}, finished_at=at(run))
    publish(spark, root, "match", 9, {"pairs": numbers(spark, 3)}, branch="test", finished_at=at(30))
    assert read_published(spark, root, "match", "pairs").count() == 7
    assert read_published(spark, root, "match", "names", run_id=1).count() == 6
    assert read_published(spark, root, "match", "pairs", run_id=9, branch="test").count() == 3
    for run, table in ((3, "pairs"), (1, "other")):
        with pytest.raises(ValueError):
            read_published(spark, root, "match", table, run_id=run)
    with pytest.raises(LookupError):
        read_published(spark, root, "embed", "pairs")


def test_failed_run_is_never_read(spark, tmp_path):
    root = f"{tmp_path}/runs"
    publish(spark, root, "match", 1, {"pairs": numbers(spark, 5)}, finished_at=at(1))
    broken = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") == 900, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        publish(spark, root, "match", 2, {"pairs": numbers(spark, 6), "names": broken}, finished_at=at(2))
    assert glob.glob(f"{root}/data/match/2/*/pairs/*.parquet")  # written in part, and unread
    assert read_published(spark, root, "match", "pairs").count() == 5
    with pytest.raises(ValueError):
        read_published(spark, root, "match", "pairs", run_id=2)
    publish(spark, root, "match", 2, {"pairs": numbers(spark, 8), "names": numbers(spark, 1)}, finished_at=at(3))
    assert read_published(spark, root, "match", "pairs").count() == 8


def test_two_writers_of_one_run_never_mix(spark, tmp_path):
    root = f"{tmp_path}/runs"

    def write(n):
        return n, publish(spark, root, "match", 1, {"a": numbers(spark, n), "b": numbers(spark, n)})

    with ThreadPoolExecutor(4) as pool:
        attempts = dict((a, n) for n, a in pool.map(write, (3, 4, 5, 6)))
    runs = published_runs(spark, root).collect()
    assert len(runs) == 1 and runs[0]["attempt"] in attempts
    n = attempts[runs[0]["attempt"]]
    for table in ("a", "b"):
        assert read_published(spark, root, "match", table).agg(F.count("*"), F.max("x")).first() == (n, n)

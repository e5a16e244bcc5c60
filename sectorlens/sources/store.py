"""Tables that jobs persist, and the selections other jobs read from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a result table as parquet."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def persist_pairs(pairs: DataFrame, path: str) -> DataFrame:
    """Write scored name pairs once and return them as read back, so that scoring never reruns."""
    save_table(pairs.select("x", "y", "sim_mean"), path)
    return load_table(pairs.sparkSession, path)


def save_graph(edges: DataFrame, path: str) -> None:
    """Word-document edges, one directory per sector."""
    save_table(edges, path, ["sector"])


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    return load_table(spark, path).withColumn("sector", F.col("sector").cast("string"))


def graph_words(edges: DataFrame) -> DataFrame:
    return edges.select("sector", "word").distinct()


def graph_documents(edges: DataFrame) -> DataFrame:
    return edges.select("sector", "doc_id").distinct()


# Selections from the text-sector, token, match and embedding tables.


def text_sectors_of(assignments: DataFrame, param: str) -> DataFrame:
    return assignments.where(F.col("param") == param).select("sector_id", "org_id")


def description_tokens_of(tokens: DataFrame) -> DataFrame:
    return tokens.select("org_id", "tokens")


def matches_of(matches: DataFrame) -> DataFrame:
    return matches.select("sim_mean", "org_id", "org_name", "company_number", "company_name")


def embeddings_of(embedded: DataFrame, model_name: str) -> DataFrame:
    return embedded.where(F.col("model_name") == model_name).select("org_id", "embedding", "description")


def encoder_names(embedded: DataFrame) -> DataFrame:
    return embedded.select("model_name").distinct()


# Selections from the reassignment table; `clustered=False` gives the organisations left over.


def reassigned_orgs(table: DataFrame, clustered: bool = True) -> DataFrame:
    return table.where(F.col("clustered") == clustered)


def org_ids(table: DataFrame, clustered: bool = True) -> DataFrame:
    return reassigned_orgs(table, clustered).select("param", "org_id")


def original_text_sector(table: DataFrame, clustered: bool = True) -> DataFrame:
    return reassigned_orgs(table, clustered).select("param", "org_id", "original_text_sector")


def assigned_text_sector(table: DataFrame, clustered: bool = True) -> DataFrame:
    return reassigned_orgs(table, clustered).select("param", "org_id", "assigned_text_sector")


def knn_org_ids(table: DataFrame, clustered: bool = True) -> DataFrame:
    return reassigned_orgs(table, clustered).select("param", "org_id", "knn_org_ids")


def knn_original_text_sectors(table: DataFrame, clustered: bool = True) -> DataFrame:
    return reassigned_orgs(table, clustered).select("param", "org_id", "knn_original_text_sectors")


def knn_assigned_text_sectors(table: DataFrame, clustered: bool = True) -> DataFrame:
    return reassigned_orgs(table, clustered).select("param", "org_id", "knn_assigned_text_sectors")


def knn_sims(table: DataFrame, clustered: bool = True) -> DataFrame:
    return reassigned_orgs(table, clustered).select("param", "org_id", "knn_sims")


def knn_sector_means(table: DataFrame, clustered: bool = True) -> DataFrame:
    return reassigned_orgs(table, clustered).select("param", "org_id", "agg_sectors", "agg_sims")

"""Reassigning organisations to text sectors by their nearest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlens.operators import reassign as r
from sectorlens.operators.knn import clustered_vectors, knn_join, left_over_vectors
from sectorlens.session import cut


def neighbour_tables(
    clusters: DataFrame, embeddings: DataFrame, k: int = 20, block_rows: int = 4096
) -> tuple[DataFrame, DataFrame]:
    """Neighbours of the clustered organisations and of those left over, always among the clustered.

    Both are asked in one search and told apart by the column ``clustered``.
    """
    clusters = clusters.select("param", "org_id")
    index = clustered_vectors(clusters, embeddings).select("param", "org_id", "embedding")
    asked = index.unionByName(left_over_vectors(clusters, embeddings))
    found = knn_join(asked, index, k, by=["param"], block_rows=block_rows)
    inside = clusters.select("param", F.col("org_id").alias("query_id"), F.lit(True).alias("clustered"))
    told = cut(found.join(inside, ["param", "query_id"], "left").withColumn("clustered", F.coalesce("clustered", F.lit(False))))
    return told.where("clustered").drop("clustered"), told.where("not clustered").drop("clustered")


def reassign_orgs(
    clusters: DataFrame,
    embeddings: DataFrame,
    k: int = 20,
    min_sim: float = 0.6,
    n_iter: int = 20,
    epsilon: float = 0.05,
    block_rows: int = 4096,
) -> tuple[DataFrame, DataFrame]:
    """(reassignment table, entropy table) for every assignment parameter in the same jobs.

    ``clusters`` is (param, sector_id, org_id); organisations without a cluster are assigned by
    the original labels of their neighbours.
    """
    original = cut(r.int_ids(clusters).select("param", "org_id", F.col("sector_id").alias("label")))
    knn, knn_rest = neighbour_tables(original, embeddings, k, block_rows)
    assigned, means = r.reassign(knn, original, min_sim, n_iter, epsilon)
    rest = r.assign_rest(knn_rest, original, min_sim)

    def table(neighbours, before, after, label_means, clustered):
        return (
            r.neighbour_records(neighbours, original, assigned)
            .join(before, ["param", "org_id"], "left")
            .join(after.withColumnRenamed("label", "assigned_text_sector"), ["param", "org_id"])
            .join(r.sector_means(label_means), ["param", "org_id"])
            .withColumn("clustered", F.lit(clustered))
        )

    known = original.withColumnRenamed("label", "original_text_sector")
    # The columns of the result table.
    columns = [
        "param", "clustered", "org_id", "original_text_sector", "assigned_text_sector", "knn_org_ids",
        "knn_original_text_sectors", "knn_assigned_text_sectors", "knn_sims", "agg_sectors", "agg_sims",
    ]
    records = table(knn, known, assigned, means, True).select(*columns).unionByName(
        table(knn_rest, known, rest, r.label_means(knn_rest, original), False).select(*columns)
    )
    before = r.neighbour_entropy(knn, original).withColumnRenamed("entropy", "entropy_before")
    after = r.neighbour_entropy(knn, assigned).withColumnRenamed("entropy", "entropy_after")
    return records, before.join(after, ["param", "org_id"])

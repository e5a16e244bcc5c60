"""Moving organisations between text sectors by the labels of their neighbours.

Neighbours are (param, query_id, rank, neighbour_id, sim), labels are (param, org_id, label).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlens.session import cut


def int_ids(clusters: DataFrame) -> DataFrame:
    """Organisation ids as whole numbers."""
    return clusters.withColumn("org_id", F.col("org_id").cast("long"))


def neighbour_labels(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """Neighbours with their label."""
    return knn.join(labels.withColumnRenamed("org_id", "neighbour_id"), ["param", "neighbour_id"])


def label_means(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """(param, query_id, label, mean_sim) over the neighbours of each label."""
    return (
        neighbour_labels(knn, labels)
        .groupBy("param", "query_id", "label")
        .agg(F.round(F.avg("sim"), 12).alias("mean_sim"))  # so that equal means tie exactly
    )


def best_label(means: DataFrame) -> DataFrame:
    """The label of the highest mean similarity per query; of equals the highest label."""
    best = means.groupBy("param", "query_id").agg(F.max(F.struct("mean_sim", "label")).alias("b"))
    return best.select("param", "query_id", "b.label", "b.mean_sim")


def changed_fraction(old: DataFrame, new: DataFrame) -> DataFrame:
    """(param, shift): the fraction of organisations whose label changed."""
    both = old.join(new.withColumnRenamed("label", "new_label"), ["param", "org_id"])
    return both.groupBy("param").agg(F.avg((F.col("label") != F.col("new_label")).cast("double")).alias("shift"))


def one_pass(knn: DataFrame, labels: DataFrame, min_sim: float) -> DataFrame:
    """Labels after one pass: every organisation takes its neighbours' best label if similar enough."""
    best = best_label(label_means(knn, labels)).select(
        "param", F.col("query_id").alias("org_id"), F.col("label").alias("best"), "mean_sim"
    )
    moved = F.coalesce(F.col("mean_sim") >= min_sim, F.lit(False))
    return labels.join(best, ["param", "org_id"], "left").select(
        "param", "org_id", F.when(moved, F.col("best")).otherwise(F.col("label")).alias("label")
    )


def reassign(
    knn: DataFrame, labels: DataFrame, min_sim: float = 0.6, n_iter: int = 20, epsilon: float = 0.05
) -> tuple[DataFrame, DataFrame]:
    """(labels, label means of the last pass).

    All organisations move at once; a parameter stops when less than ``epsilon`` of its
    organisations changed, or after ``n_iter`` passes. At least one pass runs.
    """
    moving = cut(labels.select("param", "org_id", "label"))
    settled, bases = [], []  # per parameter: final labels, and the labels its last pass read
    for step in range(1, n_iter + 1):
        after = cut(one_pass(knn, moving, min_sim))
        shifts = changed_fraction(moving, after).collect()  # one row per parameter
        stopped = [s.param for s in shifts if s.shift < epsilon or step == n_iter]
        if stopped:
            settled.append(after.where(F.col("param").isin(stopped)))
            bases.append(moving.where(F.col("param").isin(stopped)))
        if len(stopped) == len(shifts):
            break
        moving = after.where(~F.col("param").isin(stopped)) if stopped else after
    if not settled:
        return moving, label_means(knn, moving)
    return reduce(DataFrame.unionByName, settled), label_means(knn, reduce(DataFrame.unionByName, bases))


def assign_rest(knn: DataFrame, labels: DataFrame, min_sim: float = 0.6) -> DataFrame:
    """(param, org_id, label): the best label among the neighbours, null when below ``min_sim``."""
    best = best_label(label_means(knn, labels))
    return best.select(
        "param",
        F.col("query_id").alias("org_id"),
        F.when(F.col("mean_sim") >= min_sim, F.col("label")).alias("label"),
    )


def neighbour_entropy(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """(param, org_id, entropy): Shannon diversity, base 2, of the neighbours' labels."""
    counts = neighbour_labels(knn, labels).groupBy("param", "query_id", "label").agg(F.count("*").alias("c"))
    total = F.sum("c")
    bits = F.log2(total.cast("double")) - F.sum(F.col("c") * F.log2(F.col("c").cast("double"))) / total
    return counts.groupBy("param", F.col("query_id").alias("org_id")).agg(F.abs(F.round(bits, 9)).alias("entropy"))


def neighbour_records(knn: DataFrame, original: DataFrame, assigned: DataFrame) -> DataFrame:
    """Per organisation the ids, similarities, original and assigned sectors of its neighbours, nearest first."""
    named = (
        neighbour_labels(knn, original)
        .withColumnRenamed("label", "original")
        .join(
            assigned.select("param", F.col("org_id").alias("neighbour_id"), F.col("label").alias("assigned")),
            ["param", "neighbour_id"],
        )
    )
    entry = F.struct("rank", "neighbour_id", "original", "assigned", "sim")
    return (
        named.groupBy("param", F.col("query_id").alias("org_id"))
        .agg(F.sort_array(F.collect_list(entry)).alias("n"))  # k entries
        .select(  # fixed values: the columns' names
            "param", "org_id",
            F.col("n.neighbour_id").alias("knn_org_ids"),
            F.col("n.original").alias("knn_original_text_sectors"),
            F.col("n.assigned").alias("knn_assigned_text_sectors"),
            F.col("n.sim").alias("knn_sims"),
        )
    )


def sector_means(means: DataFrame) -> DataFrame:
    """Per organisation its neighbours' labels in order and the mean similarity of each."""
    return (
        means.groupBy("param", F.col("query_id").alias("org_id"))
        .agg(F.sort_array(F.collect_list(F.struct("label", "mean_sim"))).alias("m"))  # at most k entries
        .select("param", "org_id", F.col("m.label").alias("agg_sectors"), F.col("m.mean_sim").alias("agg_sims"))
    )


def smallest_params(clusters: DataFrame) -> DataFrame:
    """The clusters of the parameters with the fewest rows, for trial runs."""
    sizes = clusters.groupBy("param").agg(F.count("*").alias("n"))  # one row per parameter
    fewest = sizes.agg(F.min("n").alias("n"))
    return clusters.join(sizes.join(fewest, "n").select("param"), "param", "left_semi")

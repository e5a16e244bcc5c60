"""Name matching end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sectorlens.operators import matching as m
from sectorlens.session import scratch_path
from sectorlens.sources.store import persist_pairs


def match_names(
    companies: DataFrame,
    orgs: DataFrame,
    clean: bool = False,
    k: int = 3,
    bands: int = 16,
    rows: int = 4,
    top_k: int = 10,
    min_score: float = 50,
    hot_pairs: int = 1_000_000,
    pairs_path: str | None = None,
) -> DataFrame:
    """(sim_mean, org_id, org_name, company_number, company_name): the best company of each organisation.

    ``companies`` has (company_number, company_name), ``orgs`` (org_id, org_name), each id once.
    Rows that share a name share its match. All scored pairs of distinct names are kept under
    ``pairs_path``, or in the shared folder.
    """
    x_rows = companies.select(F.col("company_number").alias("x"), F.col("company_name").alias("name"))
    y_rows = m.cleaned(orgs.select(F.col("org_id").alias("y"), F.col("org_name").alias("name")), "y", clean)
    left, right = m.distinct_names(m.cleaned(x_rows, "x", clean)), m.distinct_names(y_rows)
    vectors = m.tfidf_vectors(left, right, hot_pairs)
    pairs = m.union_candidates(
        m.lsh_candidates(left, right, k, bands, rows, min_score, vectors=vectors), m.cosine_candidates(vectors, top_k)
    )
    scored = persist_pairs(
        m.score_pairs(pairs, vectors, k, min_score), pairs_path or scratch_path(companies.sparkSession, "pairs")
    )
    named = m.best_matches(scored).withColumnRenamed("y", "first_y").join(
        right.select(F.col("id").alias("first_y"), "name"), "first_y"
    )
    best = y_rows.select(F.col("id").alias("y"), "name").join(named, "name").select("x", "y", "sim_mean")
    return m.attach_names(
        best, companies.withColumn("x", F.col("company_number")), orgs.withColumn("y", F.col("org_id"))
    )
